"""Evaluability curves: paired metrics by seed, penalty of selective loss, monotone inverse interpolation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators import guards


def by_seed(df: DataFrame) -> DataFrame:
    """Differences within a seed: gap = real - measurable, advantage = measurable - persistence."""
    return df.withColumn("brecha", F.col("real") - F.col("medible")).withColumn("ventaja", F.col("medible") - F.col("persist"))


def aggregated(seeds: DataFrame, keys: tuple[str, ...] = ("curva", "rate")) -> DataFrame:
    """Mean and sample deviation (missing for one seed), percent of wins and number of seeds."""
    out = []
    for c in ("medible", "real", "persist", "brecha", "ventaja"):
        out += [F.round(F.avg(c), 6).alias(f"{c}_mean"), F.round(F.stddev_samp(c), 6).alias(f"{c}_sd")]
    return seeds.groupBy(*keys).agg(*out, F.round(100 * F.avg(F.col("feat_gana").cast("double")), 6).alias("feat_gana_pct"), F.count_distinct("seed").alias("n_semillas"))


def penalty(seeds: DataFrame, a: str, b: str, by: str = "curva") -> DataFrame:
    """Paired difference of two mechanisms by rate: pairs are formed by (rate, seed), incomplete ones dropped."""
    left = seeds.where(F.col(by) == a).select("rate", "seed", F.col("medible").alias("m1"), F.col("real").alias("r1"))
    right = seeds.where(F.col(by) == b).select("rate", "seed", F.col("medible").alias("m2"), F.col("real").alias("r2"))
    pairs = left.join(right, ["rate", "seed"]).withColumn("dm", F.col("m1") - F.col("m2")).withColumn("dr", F.col("r1") - F.col("r2"))
    stats = [f(c) for c in ("dm", "dr") for f in (lambda c: F.round(F.avg(c), 6).alias(f"{c}_mean"), lambda c: F.round(F.stddev_samp(c), 6).alias(f"{c}_sd"))]
    return pairs.groupBy("rate").agg(*stats, F.count_distinct("seed").alias("n_semillas"))


def replica_deviation(a: DataFrame, b: DataFrame, column: str = "medible_mean") -> DataFrame:
    """Shared rates of two curves and the largest deviation between them."""
    both = a.select("rate", F.col(column).alias("x")).join(b.select("rate", F.col(column).alias("y")), "rate")
    return both.agg(F.count("*").alias("rates"), F.round(F.max(F.abs(F.col("x") - F.col("y"))), 6).alias("deviation"))


def verify_replica(a: DataFrame, b: DataFrame, tolerance: float, column: str = "medible_mean") -> None:
    """Raise if the curves share no rate or diverge."""
    guards.holds(replica_deviation(a, b, column), (F.col("rates") > 0) & (F.col("deviation") <= tolerance), "the replica diverges")


def verify_falling(curve: DataFrame, column: str, by: str = "curva") -> None:
    """Raise if the curve rises anywhere with the rate."""
    w = Window.partitionBy(by).orderBy("rate")
    guards.holds(curve.withColumn("before__", F.lag(column).over(w)), F.coalesce(F.col(column) <= F.col("before__"), F.lit(True)), f"{column} is not monotone")


def floors(curve: DataFrame, column: str, tolerances: list[float], by: str = "curva") -> DataFrame:
    """For each curve and tolerance, the rate at which a falling curve has lost ``tolerance`` of its first value.

    Linear between measured rates, clamped at the ends, never extrapolated.
    """
    w = Window.partitionBy(by).orderBy("rate")
    first = F.first(column).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    last = F.row_number().over(Window.partitionBy(by).orderBy(F.col("rate").desc())) == 1
    steps = curve.select(by, "rate", F.col(column).alias("v"), first.alias("v0"), F.lead("rate").over(w).alias("r2"), F.lead(column).over(w).alias("v2"), last.alias("last"), (F.row_number().over(w) == 1).alias("first"))
    # each step meets a short list of tolerances
    steps = steps.withColumn("tau", F.explode(F.array(*[F.lit(float(t)) for t in tolerances]))).withColumn("goal", F.col("v0") - F.col("tau"))
    inside = (F.col("v") >= F.col("goal")) & (F.col("v2") < F.col("goal"))
    at = F.when(inside, F.col("rate") + (F.col("v") - F.col("goal")) / (F.col("v") - F.col("v2")) * (F.col("r2") - F.col("rate"))).when(F.col("last") & (F.col("v") >= F.col("goal")), F.col("rate")).when(F.col("first") & (F.col("v") < F.col("goal")), F.col("rate"))
    return steps.withColumn("at", at).groupBy(by, "tau").agg(F.round(F.min("at"), 6).alias("piso"))


def measured_level(curve: DataFrame, rate: float, tolerance: float = 5e-4) -> DataFrame:
    """Is ``rate`` one of the measured levels?"""
    return curve.agg((F.min(F.abs(F.col("rate") - rate)) < tolerance).alias("measured"))

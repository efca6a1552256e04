"""Ranks, percentiles, top lists and precision at k. Every order is total: ties end at the key.

A window without partitions would send a whole table to one task. Ranks are therefore computed from
counts of the distinct values: quantiles cut the values into buckets, sums of the buckets give each
its offset, and a window runs within a bucket. The counts are written once and read for each of these
steps, so that the table behind them is read once. Top lists order only the rows that they return.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators import guards

from tessera.sources.shared import stored

BUCKETS = 256


def value_ranks(df: DataFrame, column: str, buckets: int = BUCKETS) -> DataFrame:
    """``(column, n, below, total)`` for each distinct value: its rows, the rows with smaller values, all rows."""
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
    counts = stored(counts, "values")
    # every ``step``-th bound first, then those between two of them
    step = math.isqrt(buckets - 1) + 1
    fine = counts.agg(F.percentile_approx(column, [k / buckets for k in range(1, buckets)], 10_000).alias("fine"))
    bounds = fine.select(F.struct("fine", F.filter("fine", lambda b, k: (k + 1) % step == 0).alias("coarse"))).scalar()
    passed = lambda among: F.size(F.filter(among, lambda b: b <= F.col(column)))
    dealt = counts.withColumn("bounds__", bounds).withColumn("coarse__", passed(F.col("bounds__.coarse")))
    dealt = dealt.withColumn("bucket__", F.col("coarse__") * step + passed(F.slice("bounds__.fine", F.col("coarse__") * step + 1, F.lit(step)))).drop("bounds__", "coarse__")
    sums = dealt.groupBy("bucket__").agg(F.sum("n").alias("sum__"))
    # the window without partitions runs over at most ``buckets`` rows
    before = Window.orderBy("bucket__").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("bucket__", F.coalesce(F.sum("sum__").over(before), F.lit(0)).alias("offset__"), F.sum("sum__").over(Window.partitionBy()).alias("total"))
    within = Window.partitionBy("bucket__").orderBy(column).rowsBetween(Window.unboundedPreceding, -1)
    below = F.col("offset__") + F.coalesce(F.sum("n").over(within), F.lit(0))
    return dealt.join(F.broadcast(offsets), "bucket__").select(column, "n", below.alias("below"), "total")


def with_ranks(df: DataFrame, column: str, best: str | None = None, average: str | None = None, percentile: str | None = None, of: DataFrame | None = None) -> DataFrame:
    """``df`` with the rank from the largest (ties share the best), the rank from the smallest (ties
    averaged), and 100 * that rank / rows. Rows without a value have none. ``of``: the rows that are ranked, if not ``df``."""
    ranks = value_ranks(df if of is None else of, column)
    mean = F.col("below") + (F.col("n") + 1) / 2
    found = {best: F.col("total") - F.col("below") - F.col("n") + 1, average: mean, percentile: 100 * mean / F.col("total")}
    return df.join(ranks.select(column, *[v.alias(k) for k, v in found.items() if k]), column, "left")


def row_rank(column: str, key: str) -> Column:
    """Place from the largest, ties by key, over the few rows of a top list."""
    return F.row_number().over(Window.orderBy(F.col(column).desc(), F.col(key).asc()))


def top(df: DataFrame, column: str, key: str, k: int) -> DataFrame:
    """The ``k`` largest with their place, from 1; missing values are left out, a short table gives fewer."""
    best = df.where(F.col(column).isNotNull()).orderBy(F.col(column).desc(), F.col(key).asc()).limit(k)
    return best.withColumn("rango", row_rank(column, key))


def overlap(a: DataFrame, b: DataFrame, key: str, k: int) -> DataFrame:
    """Share of ``k`` that two top lists have in common."""
    return a.select(key).join(b.select(key), key, "left_semi").agg((F.count("*") / k).alias("overlap"))


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """Correlation of average ranks over the rows that have both values."""
    both = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    return with_ranks(with_ranks(both, a, average="ra__"), b, average="rb__", of=both).agg(F.count("*").alias("rows"), F.round(F.corr("ra__", "rb__"), 6).alias("spearman"))


def base_rate(df: DataFrame, flag: str, length: str) -> DataFrame:
    """Share of flagged rows, by count and by length; a table without rows raises, as there is no rate to measure."""
    hit = F.when(F.col(flag), F.col(length)).otherwise(0.0)
    share = F.when(F.count("*") == 0, F.raise_error(F.lit("no rows: there is no base rate")).cast("double")).otherwise(F.avg(F.col(flag).cast("double")))
    return df.agg(F.round(share, 6).alias("base"), F.round(F.sum(hit) / F.sum(length), 6).alias("base_length"))


def precision_curve(df: DataFrame, column: str, key: str, flag: str, ks: tuple[int, ...]) -> DataFrame:
    """Precision among the first k, its excess over the base rate and lift, for each k that the table reaches."""
    ladder = df.sparkSession.createDataFrame([(int(k),) for k in ks], "k int")
    all_ = df.agg(F.struct(F.avg(F.col(flag).cast("double")).alias("b"), F.count("*").alias("rows"))).scalar()
    # the top list has at most max(ks) rows
    hits = top(df, column, key, max(ks)).join(F.broadcast(ladder), F.col("rango") <= F.col("k")).groupBy("k").agg(F.avg(F.col(flag).cast("double")).alias("p"))
    out = hits.withColumn("all__", all_).withColumn("b", F.col("all__.b")).where(F.col("k") <= F.col("all__.rows"))
    return out.select("k", F.round("p", 6).alias("precision"), F.round("b", 6).alias("base"), F.round(F.col("p") - F.col("b"), 6).alias("excess"), F.round(F.when(F.col("b") > 0, F.col("p") / F.col("b")), 6).alias("lift"))


def fitting(df: DataFrame, ks: tuple[int, ...]) -> tuple[int, ...]:
    """The k that a table reaches, in order; larger ones are left out, as they would repeat its end. Raises if none is left."""
    rows = df.count()
    found = tuple(sorted({int(k) for k in ks if 1 <= k <= rows}))
    if not found:
        raise ValueError(f"no k of {tuple(ks)} fits {rows} rows")
    return found


def reached(df: DataFrame, k: int) -> DataFrame:
    """``df`` if it has at least ``k`` rows; else, or for ``k`` under 1, it raises."""
    if k < 1 or df.limit(k).count() < k:
        raise ValueError(f"k = {k} is out of range")
    return df


def precision_at(df: DataFrame, column: str, key: str, flag: str, k: int) -> DataFrame:
    """One row of ``precision_curve``; ``k`` out of range raises."""
    return precision_curve(reached(df, k), column, key, flag, (k,))


def united(rows: DataFrame, measures: DataFrame, key: str, columns: tuple[str, ...]) -> DataFrame:
    """``rows`` with their ``columns`` of ``measures``, one to one; a repeated key, or a row that stays without a measure, raises.

    Left alone, such a row would sort to the end and read as one that carries nothing.
    """
    lost = set(columns) - set(measures.columns)
    if lost:
        raise ValueError(f"no columns {sorted(lost)}")
    joined = guards.unique(rows, key).join(guards.unique(measures.select(key, *columns), key), key, "left")
    return guards.no_missing(joined, *columns)


def undeclared(df: DataFrame, column: str, key: str, flag: str, k: int) -> DataFrame:
    """Of the first k, those that the hierarchy does not declare."""
    return top(df, column, key, k).where(~F.col(flag))


def weak(df: DataFrame, column: str, flag: str, most_percentile: float = 50.0) -> DataFrame:
    """Declared rows whose percentile is at most ``most_percentile``."""
    return with_ranks(df, column, best="rango", percentile="percentil").where(F.col(flag) & (F.col("percentil") <= most_percentile))


def ranked_table(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Best rank and percentile for each weight; the table is written once, as each weight reads it."""
    out = rows = stored(df, "ranked")
    for c in columns:
        out = with_ranks(out, c, best=f"rank_{c}", percentile=f"pct_{c}", of=rows).withColumn(f"pct_{c}", F.round(f"pct_{c}", 6))
    return out


def normalised(df: DataFrame, column: str, gamma: float = 1.0) -> DataFrame:
    """Min-max to [0, 1] to the power ``gamma`` as ``norm``; missing stays, a constant column is 0.5."""
    out = df.withColumn("lo__", df.agg(F.min(column)).scalar()).withColumn("hi__", df.agg(F.max(column)).scalar())
    share = F.pow((F.col(column) - F.col("lo__")) / (F.col("hi__") - F.col("lo__")), F.lit(gamma))
    value = F.when(F.col(column).isNull(), F.lit(None).cast("double")).when(F.col("hi__") > F.col("lo__"), share).otherwise(0.5)
    return out.withColumn("norm", F.round(value, 6)).drop("lo__", "hi__")


def histogram(df: DataFrame, column: str, bins: int = 60) -> DataFrame:
    """Counts of equal-width bins between the extremes; missing values are bin -1."""
    out = df.withColumn("lo__", df.agg(F.min(column)).scalar()).withColumn("hi__", df.agg(F.max(column)).scalar())
    at = F.least(F.floor((F.col(column) - F.col("lo__")) / (F.col("hi__") - F.col("lo__")) * bins), F.lit(bins - 1))
    place = F.when(F.col(column).isNull(), -1).when(F.col("hi__") > F.col("lo__"), at).otherwise(0).cast("int")
    return out.groupBy(place.alias("bin")).agg(F.count("*").alias("n"))


def shares(df: DataFrame, column: Column, name: str) -> DataFrame:
    """Distribution of a value in percent."""
    counts = df.groupBy(column.alias(name)).agg(F.count("*").alias("n"))
    return counts.select(name, "n", F.round(100 * F.col("n") / F.sum("n").over(Window.partitionBy()), 6).alias("pct"))


def ranking(df: DataFrame, column: str, key: str, k: int) -> DataFrame:
    """``top`` that raises where the table has fewer than ``k`` rows (it runs a job)."""
    if df.limit(k).count() < k:
        raise ValueError(f"top {k} of a table with fewer rows")
    return top(df, column, key, k)


def ordinal(df: DataFrame, column: str, key: str) -> DataFrame:
    """``df`` with ``orden``: places from the smallest, from 0, without ties (equal values by key)."""
    places = F.row_number().over(Window.partitionBy(column).orderBy(key)) - 1
    return df.join(value_ranks(df, column).select(column, "below"), column).withColumn("orden", (F.col("below") + places).cast("long")).drop("below")


def covered(top_list: DataFrame, near: DataFrame, key: str) -> DataFrame:
    """Share of a top list that ``near`` holds; an empty list raises."""
    hits = top_list.join(near.select(key).distinct().withColumn("hit__", F.lit(1.0)), key, "left")
    return hits.agg(F.coalesce(F.avg(F.coalesce("hit__", F.lit(0.0))), F.raise_error(F.lit("the top list is empty")).cast("double")).alias("cobertura"))


def both_ends(top_lines: DataFrame, top_nodes: DataFrame, lines: DataFrame, key: str = "tramo_id") -> DataFrame:
    """Share of the top lines both of whose ends (``u``, ``v``, compared as text) are top nodes; unknown lines and an empty list raise."""
    nodes = top_nodes.select(F.col("node_id").cast("string").alias("node")).distinct().withColumn("top__", F.lit(True))
    ends = top_lines.select(key).join(lines.select(key, F.col("u").cast("string").alias("u"), F.col("v").cast("string").alias("v")), key, "left")
    ends = ends.withColumn("u", F.coalesce("u", F.raise_error(F.concat(F.lit("unknown line "), F.col(key))).cast("string")))
    for end in ("u", "v"):
        ends = ends.join(nodes.select(F.col("node").alias(end), F.col("top__").alias(f"top_{end}")), end, "left")
    both = F.coalesce(F.col("top_u") & F.col("top_v"), F.lit(False)).cast("double")
    return ends.agg(F.coalesce(F.avg(both), F.raise_error(F.lit("the top list is empty")).cast("double")).alias("ambos_extremos"))


def agreement(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Places (``rango``) of two rankings, and how many hold the same key."""
    pairs = a.select("rango", F.col(key).alias("ka")).join(b.select("rango", F.col(key).alias("kb")), "rango")
    return pairs.agg(F.count("*").alias("lugares"), F.count(F.when(F.col("ka") == F.col("kb"), 1)).alias("iguales"))


def split_share(table: DataFrame, unit: str, within: str, mass: str) -> DataFrame:
    """Percent of the units that lie in several parts, by count and by mass."""
    units = table.groupBy(unit).agg(F.count_distinct(within).alias("parts"), F.sum(mass).alias("m"))
    return units.agg(F.round(100 * F.avg((F.col("parts") > 1).cast("double")), 6).alias("pct"), F.round(100 * F.sum(F.when(F.col("parts") > 1, F.col("m")).otherwise(0.0)) / F.sum("m"), 6).alias("pct_mass"))


def extremes(df: DataFrame, key: str, measures: tuple[str, ...]) -> DataFrame:
    """Least and largest of each measure over one row for each key (its least row, so that repeats count once)."""
    one = df.groupBy(key).agg(F.min(F.struct(*measures)).alias("m"))
    return one.agg(*[f(F.col(f"m.{c}")).alias(f"{name}_{c}") for c in measures for name, f in (("min", F.min), ("max", F.max))])


def reduction(before: Column, after: Column) -> Column:
    """Percent by which a count fell; a count that rose raises."""
    return F.when(after > before, F.raise_error(F.lit("the simplified graph is larger")).cast("double")).otherwise(100 * (before - after) / before)

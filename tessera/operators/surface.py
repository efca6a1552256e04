"""Observed against latent: pooled cells, composition, multiplier, rank stability."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.scalar import ratio
from tessera.operators.rank import overlap, spearman, top, value_ranks
from tessera.sources.shared import stored


def pooled_cells(surface: DataFrame) -> DataFrame:
    """Sums over years and categories of each cell, with pooled ratios (sum over sum)."""
    out = surface.groupBy("h3_index").agg(
        F.min("ubigeo").alias("ubigeo"), *[F.sum(c).alias(c) for c in ("observado", "latente", "latente_ic_low", "latente_ic_high")], F.sum(F.when(F.col("inestable") == 1, F.col("latente"))).alias("unstable")
    )
    return out.select(
        "h3_index", "ubigeo", "observado", "latente", ratio(F.coalesce("unstable", F.lit(0.0)), F.col("latente")).alias("share_inestable"),
        ratio(F.col("latente_ic_high") - F.col("latente_ic_low"), F.col("latente")).alias("ic_ancho_rel"), (F.col("observado") <= 0).alias("sin_registro"),
    )


def category_pivot(surface: DataFrame, categories: list[str], measures: tuple[str, ...] = ("observado", "latente")) -> DataFrame:
    """One column for each measure and category of a fixed list; absent is 0."""
    cells = surface.groupBy("h3_index").pivot("crime_cat", categories).agg(*[F.sum(m).alias(m) for m in measures])
    return cells.fillna(0.0, subset=[c for c in cells.columns if c != "h3_index"])


def composition(surface: DataFrame) -> DataFrame:
    """Share of each category in the observed and the latent total, and the latent to observed ratio of sums."""
    sums = surface.groupBy("crime_cat").agg(F.sum("observado").alias("o"), F.sum("latente").alias("l"))
    all_ = Window.partitionBy()
    return sums.select("crime_cat", ratio(100 * F.col("o"), F.sum("o").over(all_)).alias("share_observado"), ratio(100 * F.col("l"), F.sum("l").over(all_)).alias("share_latente"), ratio(F.col("l"), F.col("o")).alias("multiplicador"))


def rank_stability(cells: DataFrame, k: int = 50) -> DataFrame:
    """Spearman correlation of observed and latent over cells with records, and the overlap of both top lists."""
    # both rankings and both top lists read the cells
    kept = stored(cells.where("not sin_registro").select("h3_index", "observado", "latente"), "cells")
    common = overlap(top(kept, "observado", "h3_index", k), top(kept, "latente", "h3_index", k), "h3_index", k)
    return spearman(kept, "observado", "latente").withColumn("overlap", common.scalar())


def quantiles(df: DataFrame, column: str, shares: tuple[float, ...] = (0.05, 0.5, 0.95, 0.995)) -> DataFrame:
    """Exact quantiles with linear interpolation, mean and population deviation, one row.

    A quantile lies between the values at two places of the order; no task holds all values.
    """
    name = lambda q: f"p{q * 1000:.0f}"
    place = lambda q: F.lit(q) * (F.col("total") - 1)
    holds = lambda p: F.max(F.when((F.col("below") <= p) & (p < F.col("below") + F.col("n")), F.col(column)))
    found = [F.struct(holds(F.floor(place(q))).alias("lo"), holds(F.ceil(place(q))).alias("hi"), F.max(place(q) - F.floor(place(q))).alias("part")).alias(name(q)) for q in shares]
    out = value_ranks(df, column).agg(*found).select(*[F.round(F.col(name(q))["lo"] + F.col(name(q))["part"] * (F.col(name(q))["hi"] - F.col(name(q))["lo"]), 6).alias(name(q)) for q in shares])
    rest = df.agg(F.struct(F.round(F.avg(column), 6).alias("mean"), F.round(F.stddev_pop(column), 6).alias("sd_pop"))).scalar()
    return out.withColumn("rest__", rest).select(*[name(q) for q in shares], "rest__.mean", "rest__.sd_pop")

"""Structured Streaming versions of the event operators (an extension: the batch run gives the same numbers)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hourly_counts(events: DataFrame, time: str, keys: list[str], late: str = "2 hours", hours: int = 1) -> DataFrame:
    """Counts by key and window of a stream, closed when the watermark has passed."""
    seen = events.withWatermark(time, late).groupBy(F.window(time, f"{hours} hours").alias("w"), *keys).agg(F.count("*").alias("n"))
    return seen.select(F.col("w.start").alias("start"), *keys, "n")


def stratum_hits(events: DataFrame, time: str, looks: DataFrame, late: str = "2 hours") -> DataFrame:
    """Events that fall into a stratum's window: a stream joined with the static strata (stadium, from_ts, to_ts, stratum).

    They meet by place and day, as strata grow with the data; Spark broadcasts them only while they are small.
    """
    marked = events.withWatermark(time, late).withColumn("day__", F.to_date(time))
    by_day = looks.withColumn("day__", F.explode(F.sequence(F.to_date("from_ts"), F.to_date("to_ts"))))
    return marked.join(by_day, ["stadium", "day__"]).where((F.col(time) >= F.col("from_ts")) & (F.col(time) < F.col("to_ts"))).select("stratum", "stadium", time)

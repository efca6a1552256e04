"""Sinks: artifacts, sidecars, manifests and fingerprinted caches, all written by Spark."""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def artifact(df: DataFrame, path: str, key: str, partitions: int | None = None) -> None:
    """A Parquet dataset in the order of its key; ``partitions`` only for artifacts known to be small."""
    ordered = df.repartitionByRange(partitions, key) if partitions else df.repartitionByRange(key)
    ordered.sortWithinPartitions(key).write.mode("overwrite").parquet(path)


def sidecar(spark: SparkSession, fields: dict, path: str) -> None:
    """One JSON document of run parameters and figures."""
    spark.createDataFrame([(json.dumps(fields, sort_keys=True, ensure_ascii=False),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_sidecar(spark: SparkSession, path: str) -> dict | None:
    """The fields of a sidecar, None if there is none."""
    try:
        rows = spark.read.text(path).take(1)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
    return json.loads(rows[0][0]) if rows else None


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """``(path, length, sha256)`` of files, hashed where they are read."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"))


def compared(mine: DataFrame, other: DataFrame) -> DataFrame:
    """State of each file by name between two manifests: same, different, only here, only there."""
    name = F.element_at(F.split("path", "/"), -1)
    a, b = mine.select(name.alias("name"), F.col("sha256").alias("a")), other.select(name.alias("name"), F.col("sha256").alias("b"))
    state = F.when(F.col("b").isNull(), "only_here").when(F.col("a").isNull(), "only_there").when(F.col("a") == F.col("b"), "same").otherwise("different")
    return a.join(b, "name", "full").select("name", state.alias("state"))


def cached(spark: SparkSession, path: str, fingerprint: dict, make) -> DataFrame:
    """``make()`` once for each fingerprint (inputs, constants, code version): a hit is read, a miss replaces what was there."""
    if read_sidecar(spark, f"{path}.fingerprint") != json.loads(json.dumps(fingerprint)):
        make().write.mode("overwrite").parquet(path)
        sidecar(spark, fingerprint, f"{path}.fingerprint")
    return spark.read.parquet(path)

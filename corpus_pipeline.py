"""Corpus pipeline over ``documents``: each stage's rows are written as Parquet and reread as the next one's docs.

Every stage but the last returns the columns of ``documents``. SQL cannot express the learnt, sketched
and sampled stages, so there is no oracle SQL; tests hold each stage against a brute-force version.

Edge cases: columns beyond those of ``documents`` are left behind by the first stage, whatever they are
called; an empty table passes as no rows through every stage. A null or empty text scores like any
other, leaves the line stage as an empty text, links with nothing, and is no part of a mix, which counts
words. Rows that repeat a ``doc_id`` are scored and cleaned one by one, and stay where their texts
differ; of rows that repeat text and id alike one stays, unless the text has no words.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import line_dedup, minhash_dedup, mixing, sentencepiece_bpe, toxicity
from tessera.llm.common import DOCUMENT_COLUMNS, stored
from tessera.llm.queries import PIECES


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under the threshold; the classifier learns from ``labels`` and ``docs``."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.clean(docs.select(*DOCUMENT_COLUMNS), model)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that ten documents or more share; ``n_chars`` follows the text."""
    kept = line_dedup.drop_lines(docs.select(*DOCUMENT_COLUMNS))
    return kept.withColumn("n_chars", F.char_length("text").cast("long")).select(*DOCUMENT_COLUMNS)


def minhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, that with the smallest id."""
    return minhash_dedup.deduplicated(docs.select(*DOCUMENT_COLUMNS))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a document that is taken twice stands twice."""
    weighed = mixing.quality_weights(mixing.sized(docs), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return mixing.repeated(docs.select(*DOCUMENT_COLUMNS), mixing.mixed(weighed))


def sentencepiece_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded text for every row of the mix."""
    return sentencepiece_bpe.encode_digests(docs, PIECES)


STAGES = [
    ("toxicity", toxicity_stage),
    ("line_dedup", line_dedup_stage),
    ("minhash_dedup", minhash_stage),
    ("mixing", mixing_stage),
    ("sentencepiece", sentencepiece_stage),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

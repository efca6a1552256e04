"""Queries of the registry operators over texts, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import registry
from tessera.plans import standins as st


def _numbers(spark, d):
    sums = st.table(spark, d, "documents").groupBy("source").agg(F.sum("n_chars").cast("double").alias("value"))
    return sums.select(F.lit("chars").alias("family"), F.col("source").alias("variant"), "value", F.lit("chars").alias("unit"), F.lit("0").alias("script_sha"))


def _policies(spark):
    return spark.createDataFrame([("cha*", 2, "floor", "src9"), ("chars", 0, "half_up", "src1")], "pattern string, decimals int, mode string, variant_canonical string")


def registry_entries(spark, d):
    return registry.emitted(_numbers(spark, d), _policies(spark)).select("key", "shown", "canonical")


def anchor_check(spark, d):
    """Every document cites its source's total (every third one its own length; every fifth with decimals), half of them flagged, some by family."""
    docs = st.table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars")
    total = docs.groupBy("source").agg(F.sum("n_chars").alias("total"))
    cited = F.when(F.col("doc_id") % 3 == 0, F.col("n_chars")).otherwise(F.col("total")).cast("string")
    places = F.when(F.col("doc_id") % 5 == 0, ".5").otherwise("")
    key = F.when(F.col("doc_id") % 7 == 0, "chars").otherwise(F.concat(F.lit("chars."), F.col("source")))
    text = F.concat(F.lit("In all CANON: "), key, F.lit(" = ~"), cited, places, F.when(F.col("doc_id") % 2 == 0, " variant-ok").otherwise(""), F.lit(" characters"))
    lines = docs.join(total, "source").select(F.col("lang").alias("file"), F.col("doc_id").alias("line"), text.alias("text"))
    return registry.checked(registry.anchors(lines), registry.emitted(_numbers(spark, d), _policies(spark)))


def document_anchors(spark, d):
    """Lines of documents with a decimal number and no anchor nearby, by language."""
    lines = st.table(spark, d, "documents").select("lang", F.col("doc_id").alias("file"), F.posexplode(F.split("text", "\n")).alias("line", "text"))
    found = registry.audit(lines).join(st.table(spark, d, "documents").select(F.col("doc_id").alias("file"), "lang"), "file")
    return found.groupBy("lang").agg(F.count("*").alias("lines"))


QUERIES = {f.__name__: f for f in (registry_entries, anchor_check, document_anchors)}

ORACLE_SQL = {
    "registry_entries": "SELECT 'chars.' || source AS key, sum(n_chars)::VARCHAR AS shown, source = 'src1' AS canonical FROM documents GROUP BY source",
    "anchor_check": """WITH t AS (SELECT source, sum(n_chars) AS total FROM documents GROUP BY source), x AS (SELECT d.*, CASE WHEN doc_id % 3 = 0 THEN n_chars ELSE total END AS c, total, (SELECT total FROM t WHERE source = 'src1') AS canon FROM documents d JOIN t USING (source))
      SELECT lang AS file, doc_id AS line, CASE WHEN doc_id % 7 = 0 THEN 'chars' ELSE 'chars.' || source END AS key, '~' || c::VARCHAR || CASE WHEN doc_id % 5 = 0 THEN '.5' ELSE '' END AS cited,
        CASE WHEN doc_id % 7 <> 0 AND source <> 'src1' AND doc_id % 2 <> 0 THEN 'not_canonical' WHEN doc_id % 5 = 0 THEN 'too_precise' WHEN c <> CASE WHEN doc_id % 7 = 0 THEN canon ELSE total END THEN 'mismatch' ELSE 'ok' END AS verdict FROM x""",
    "document_anchors": r"""WITH l AS (SELECT doc_id, lang, unnest(string_split(text, chr(10))) AS line FROM documents) SELECT lang, count(*) AS lines FROM l WHERE regexp_matches(line, '(^|[^\w.])[×xX~]?\s*\d+\.\d+') GROUP BY lang""",
}

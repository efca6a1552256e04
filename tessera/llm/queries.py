"""The registered queries: each applies its operator to the whole of its table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bytes_bpe, centroid_clustering, chat, fingerprints, lattice_dedup, line_dedup, minhash_dedup, mixing, sentencepiece_bpe, sharding, spelling_variants, toxicity, wavelet

#: Paths of the public vocabulary files; the operators take them as parameters.
BYTES = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    found = toxicity.scored(docs, model).withColumn("held_out", toxicity.held_out())
    return found.select("doc_id", "held_out", "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    back = chat.read_back(chat.formatted(chat.as_events(rows)))
    lines = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(lines, 256).alias("turns_sha256"),
        F.char_length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        "formatted_chars",
    )


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.components(table(spark, sf_dir, "documents"))


def op4_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice_dedup.linked(table(spark, sf_dir, "embeddings"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.sharded(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op6_wavelet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wavelet.read_documents(wavelet.written(table(spark, sf_dir, "documents"), BYTES))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.drop_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.sized(table(spark, sf_dir, "documents"))
    mix = mixing.mixed(mixing.quality_weights(rows, table(spark, sf_dir, "labels")))
    return mix.select("doc_id", "size", "source_size", "target", "taken")


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fingerprints.fingerprinted(table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        fingerprints.as_text(F.col("sketch")).alias("fingerprint"),
        fingerprints.as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        fingerprints.resemblance(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        fingerprints.resemblance(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
        fingerprints.containment(F.col("sketch"), F.col("edited_sketch")).alias("held_by_edited"),
    )


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_bpe.encode_digests(table(spark, sf_dir, "documents"), PIECES)


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants.grouped(table(spark, sf_dir, "documents"))


def op12_bytes_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bytes_bpe.encode_digests(table(spark, sf_dir, "documents"), RANKS, public_tokenizers.PATTERN)


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroid_clustering.clustered(table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vec")))


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_chat": op2_chat,
    "op3_minhash": op3_minhash,
    "op4_lattice": op4_lattice,
    "op5_sharding": op5_sharding,
    "op6_wavelet": op6_wavelet,
    "op7_line_dedup": op7_line_dedup,
    "op8_mixing": op8_mixing,
    "op9_fingerprints": op9_fingerprints,
    "op10_sentencepiece": op10_sentencepiece,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_bytes_bpe": op12_bytes_bpe,
    "op13_centroid_clustering": op13_centroid_clustering,
}
#: A line's white space and the letters whose case counts for nothing, as DuckDB's trim and translate take them.
LINE_KEY = "translate(trim(line, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
OP7_SQL = f"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS n FROM documents
), keyed AS (SELECT doc_id, n, line, {LINE_KEY} AS key FROM lines),
common AS (SELECT key FROM keyed WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE common.key IS NOT NULL)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (WHERE common.key IS NULL), '')) AS kept_sha256
FROM keyed LEFT JOIN common USING (key) GROUP BY doc_id
"""
OP2_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), marked AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS n,
    replace(replace(replace(replace(replace(text, '\', '\\'), '<s>', '<\!s>'), '</s>', '<\!/s>'), '[INST]', '[\!INST]'), '[/INST]', '[\!/INST]') AS t,
    replace(replace(replace(replace(replace(role, '\', '\\'), '<s>', '<\!s>'), '</s>', '<\!/s>'), '[INST]', '[\!INST]'), '[/INST]', '[\!/INST]') AS r
  FROM turns
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(length('[INST] ' || r || ' [/INST]' || t || '</s>'))::BIGINT AS formatted_chars
FROM marked GROUP BY conv_id
"""
OP3_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM words
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id JOIN sizes x ON x.doc_id = a.doc_id JOIN sizes y ON y.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 75 * (any_value(x.n) + any_value(y.n) - count(*))
), reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT r.a AS doc_id, coalesce(any_value(n), 0)::BIGINT AS n_shingles, min(r.b) AS component_id, min(r.b) = r.a AS kept FROM reach r LEFT JOIN sizes ON sizes.doc_id = r.a GROUP BY r.a
"""
OP4_SQL = """
WITH RECURSIVE usable AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE list_cosine_similarity(a.v, b.v) >= 0.9
), counts AS (SELECT a, count(*) AS n FROM links GROUP BY a),
reach(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT r.a AS vec_id, coalesce(any_value(n), 0)::BIGINT AS n_links, min(r.b) AS component_id, min(r.b) = r.a AS kept FROM reach r LEFT JOIN counts ON counts.a = r.a GROUP BY r.a
"""
ORACLE_SQL: dict[str, str] = {"op2_chat": OP2_SQL, "op3_minhash": OP3_SQL, "op4_lattice": OP4_SQL, "op7_line_dedup": OP7_SQL, "op11_spelling_variants": spelling_variants.variants_sql(), "op13_centroid_clustering": centroid_clustering.cluster_sql()}

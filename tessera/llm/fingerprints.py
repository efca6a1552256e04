"""Document fingerprints: threshold-scaled sketches of five-word shingles.

Native: DataFrame functions only. Every shingle is hashed once; a sketch keeps each hash under the
fixed fraction ``1 / SCALE`` of the hash range, so that sketches of any two documents, however
unequal, can be merged and compared: shared retained hashes over retained hashes estimate both
resemblance and containment. A text none of whose hashes is under the fraction keeps its smallest
one, which a merge keeps or drops by the same rule.

``with_next`` puts the following document by ascending ``doc_id`` beside each one without sorting all
rows in one task: quantiles of the ids cut buckets, a window runs within each bucket, and the first
document of each bucket visits the bucket before it.

Edge cases: null is the empty text, whose sketch is empty; texts of one to four words are one shingle;
two empty sketches are alike (1), an empty and a filled one are not (0); the only document of a table
is its own next; null ids come first; rows that repeat a ``doc_id`` follow each other by a hash of
their text; an empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SCALE, SHINGLE = 8, 5
LIMIT = -(1 << 63) + (1 << 64) // SCALE
ROWS_PER_BUCKET, MOST_BUCKETS = 500, 1 << 14


def with_sketch(df: DataFrame, text: str, name: str) -> DataFrame:
    """``df`` with the sorted retained hashes of the column ``text`` as ``name``.

    Words are lower-cased runs of no white space. One projection for each step: each array is made once.
    """
    words = F.split(F.trim(F.regexp_replace(F.lower(text), r"[\x20\x09-\x0D]+", " ")), " ")
    df = df.withColumn("words__", F.transform(words, lambda w: F.xxhash64(w))).withColumn("words__", F.when(F.rlike(text, F.lit(r"[^\x20\x09-\x0D]")), F.col("words__")).otherwise(F.array().cast("array<long>")))
    long = F.transform(F.slice("words__", 1, F.greatest(F.size("words__") - SHINGLE + 1, F.lit(0))), lambda w, i: F.xxhash64(w, *[F.get("words__", i + k) for k in range(1, SHINGLE)]))
    short = F.when(F.size("words__") > 0, F.array(F.xxhash64("words__"))).otherwise(F.array().cast("array<long>"))
    df = df.withColumn("shingles__", F.when(F.size("words__") >= SHINGLE, long).otherwise(short))
    df = df.withColumn("low__", F.filter("shingles__", lambda h: h < LIMIT))
    least = F.when(F.size("shingles__") > 0, F.array(F.array_min("shingles__"))).otherwise(F.array().cast("array<long>"))
    return df.withColumn(name, F.when(F.size("low__") > 0, F.array_sort(F.array_distinct("low__"))).otherwise(least)).drop("words__", "shingles__", "low__")


def merged(a: Column, b: Column) -> Column:
    """The sketch of two documents' union."""
    both = F.array_sort(F.array_union(a, b))
    low = F.filter(both, lambda h: h < LIMIT)
    return F.when(F.size(low) > 0, low).otherwise(F.slice(both, 1, 1))


def resemblance(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of two sketches."""
    both = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - both
    return F.when(union == 0, 1.0).otherwise(both / F.greatest(union, F.lit(1)))


def containment(a: Column, b: Column) -> Column:
    """Estimated share of the first document that the second holds too."""
    return F.when(F.size(a) == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / F.greatest(F.size(a), F.lit(1)))


def as_text(sketch: Column) -> Column:
    return F.array_join(F.transform(sketch, lambda h: F.lower(F.hex(h))), ".")


def _bucket(bounds: list[int], value: Column) -> Column:
    """How many of the sorted ``bounds`` are at most ``value``: first by strides, then within one."""
    stride = max(1, math.isqrt(len(bounds)))
    coarse = F.array(*[F.lit(x) for x in bounds[::stride]])
    fine = F.array(*[F.array(*[F.lit(x) for x in bounds[k : k + stride]]) for k in range(0, len(bounds), stride)])
    at = F.size(F.filter(coarse, lambda x: x <= value))
    inside = F.size(F.filter(F.element_at(fine, F.greatest(at, F.lit(1))), lambda x: x <= value))
    return F.when(at == 0, 0).otherwise((at - 1) * stride + inside)


def with_next(docs: DataFrame, columns: list[str]) -> DataFrame:
    """``docs`` with ``next_<column>`` of the following document by ascending ``doc_id`` (the last one's is the first)."""
    docs = docs.withColumn("tie__", F.xxhash64("text"))
    ids = docs.select("doc_id", "tie__")
    n = ids.count()
    cuts = max(1, min(MOST_BUCKETS, n // ROWS_PER_BUCKET))
    shares = [k / cuts for k in range(1, cuts)]
    bounds = (ids.agg(F.percentile_approx("doc_id", shares, max(10_000, 20 * cuts))).first()[0] or []) if shares else []
    bounds = sorted(set(bounds))
    bucket = (_bucket(bounds, F.col("doc_id")) if bounds else F.lit(0)).cast("int")
    bucket = F.coalesce(F.when(F.col("doc_id").isNotNull(), bucket), F.lit(-1))
    first = F.min(F.struct(F.col("doc_id").isNotNull().alias("known"), F.coalesce("doc_id", F.lit(0)).alias("id"), "tie__"))
    # one row for each bucket: at most MOST_BUCKETS + 1
    firsts = ids.withColumn("bucket__", bucket).groupBy("bucket__").agg(first.alias("f"))
    all_ = Window.partitionBy()
    visits = firsts.withColumn("to__", F.coalesce(F.lag("bucket__").over(Window.orderBy("bucket__")), F.max("bucket__").over(all_)))
    visits = visits.select(F.col("f.known").alias("known__"), F.col("f.id").alias("id__"), F.col("f.tie__").alias("tie2__"), "to__")
    own = F.col("doc_id").isNotNull() == F.col("known__")
    found = docs.withColumn("bucket__", bucket).join(F.broadcast(visits), own & (F.coalesce("doc_id", F.lit(0)) == F.col("id__")) & (F.col("tie__") == F.col("tie2__")), "left")
    places = F.when(F.col("to__").isNull(), F.array(F.struct(F.col("bucket__").alias("b"), F.lit(False).alias("guest")))).otherwise(
        F.array(F.struct(F.col("bucket__").alias("b"), F.lit(False).alias("guest")), F.struct(F.col("to__").alias("b"), F.lit(True).alias("guest")))
    )
    dealt = found.withColumn("place__", F.explode(places)).select(*docs.columns, F.col("place__.b").alias("b__"), F.col("place__.guest").alias("guest__"))
    order = Window.partitionBy("b__").orderBy("guest__", F.col("doc_id").asc_nulls_first(), "tie__")
    out = dealt
    for c in columns:
        out = out.withColumn(f"next_{c}", F.lead(c).over(order))
    return out.where("not guest__").drop("b__", "guest__", "tie__")


def fingerprinted(docs: DataFrame) -> DataFrame:
    """Each document's sketch, that of its text with the last half replaced from the next document, and their likeness.

    Returns ``doc_id, n_chars, text, edited, sketch, edited_sketch, next_sketch``.
    """
    rows = with_sketch(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), "text", "sketch")
    rows = with_next(rows, ["text", "sketch"]).withColumn("n_chars", F.char_length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - half), F.substring("next_text", F.lit(1), half))
    return with_sketch(rows.withColumn("edited", edited), "edited", "edited_sketch").drop("next_text")

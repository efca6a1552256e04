"""Mixing sources to target weights: whole epochs first, then Efraimidis-Spirakis selection.

Native: DataFrame functions only. A source's target is its share of the budget by weight, at most
``max_epochs`` times its size, the excess reshared by weight. Each document is taken once for every
whole epoch that fits into the target. The rest of the target is filled in the order of exponential
keys ``-ln(u) / w`` (``u`` from a hash of the document, ``w`` its quality weight): this is weighted
sampling without replacement. The document that crosses the target gives its first words up to it.

A hot source is no single sort: keys fall into many ranges of each source, sums of the ranges give
each range its offset, and only within a range are words summed in order.

Edge cases: null, empty and blank texts have size 0 and are taken 0 times; a null ``source`` is a
source of its own, last; sources without words have target 0; equal keys are ordered by ``doc_id``,
then text hash; repeated rows are documents of their own; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import stored

#: Weights of the sources in code-point order, repeating (fixed by the mix asked for).
SOURCE_WEIGHTS = (3, 1, 2)
BUDGET, MAX_EPOCHS = 1.5, 2
#: Ranges to an octave of the exponential keys.
PARTS = 128


def n_words(text: str = "text") -> Column:
    """Runs outside ``[\\x20\\x09-\\x0D]``: every white-space run becomes one space, and spaces part words."""
    spaced = F.trim(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"[\x20\x09-\x0D]+", " "))
    return F.when(spaced == "", 0).otherwise(F.length(spaced) - F.length(F.translate(spaced, " ", "")) + 1).cast("long")


def targets(sized: DataFrame, weights: tuple[int, ...] = SOURCE_WEIGHTS, budget: float = BUDGET, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """``(source, source_size, target)`` for each source of ``sized`` (columns ``source``, ``size``).

    Water-filling in closed form: sources in the order of cap per weight; a source is capped if the
    level that all later sources would share is not below its own cap per weight. The windows run
    over one row for each source, not over documents.
    """
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    pick = F.array(*[F.lit(float(x)) for x in weights])
    s = sums.withColumn("w", F.element_at(pick, ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")))
    s = s.withColumn("cap", F.col("source_size") * float(max_epochs)).withColumn("ratio", F.col("cap") / F.col("w"))
    order = Window.orderBy("ratio", F.col("source").isNull(), "source")
    before, onward = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    total = F.sum("source_size").over(Window.partitionBy())
    s = s.withColumn("level", (total * budget - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(onward))
    s = s.withColumn("capped", F.col("ratio") <= F.col("level"))
    rest = F.min(F.when(~F.col("capped"), F.struct("ratio", "level"))).over(Window.partitionBy()).getField("level")
    return s.select("source", "source_size", F.when(F.col("capped"), F.col("cap")).otherwise(rest * F.col("w")).alias("target"))


def exponential_key(weight: Column, *parts: str) -> Column:
    """``-ln(u) / weight`` with ``u`` in (0, 1] from 53 bits of a hash: the same in every run."""
    u = (F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double") + 1) / F.lit(float(1 << 53))
    return -F.log(u) / weight


def sized(docs: DataFrame) -> DataFrame:
    """``doc_id, source, size, tie__`` of every row, counted once and written: later steps carry no texts."""
    return stored(docs.select("doc_id", "source", n_words().alias("size"), F.xxhash64("text").alias("tie__")), "sized")


def quality_weights(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """``rows`` with ``weight``: 2 for documents labelled as good, 0.5 as bad, 1 without a label."""
    best = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("quality__"))
    weight = F.when(F.col("quality__") == 1, 2.0).when(F.col("quality__") == 0, 0.5).otherwise(1.0)
    return rows.join(best, "doc_id", "left").withColumn("weight", weight).drop("quality__")


def mixed(rows: DataFrame, weights: tuple[int, ...] = SOURCE_WEIGHTS, budget: float = BUDGET, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Rows of ``sized`` with ``source_size``, ``target`` and ``taken`` (words, repeats counted).

    A column ``weight`` (positive; null is 1) ranks documents within their source; without it all
    weigh the same.
    """
    weight = F.coalesce(F.col("weight").cast("double"), F.lit(1.0)) if "weight" in rows.columns else F.lit(1.0)
    source = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))
    keyed = rows.withColumn("key__", exponential_key(weight, "doc_id", "tie__")).withColumn("source__", source)
    # The octave of a key, in parts: monotone, and no part holds more than about 0.5 % of a source whatever the weights' scale.
    keyed = keyed.withColumn("range__", F.coalesce(F.floor(F.log2("key__") * PARTS), F.lit(-(1 << 30))).cast("int"))
    plan = targets(rows, weights, budget, max_epochs).withColumn("source__", source).drop("source")
    sums = keyed.groupBy("source__", "range__").agg(F.sum("size").alias("words__"))
    before = Window.partitionBy("source__").orderBy("range__").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("source__", "range__", F.coalesce(F.sum("words__").over(before), F.lit(0)).alias("offset__")).join(plan, "source__")
    found = keyed.join(offsets, ["source__", "range__"])
    within = Window.partitionBy("source__", "range__").orderBy("key__", "doc_id", "tie__").rowsBetween(Window.unboundedPreceding, -1)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    left = F.floor(F.col("target")) - epochs * F.col("source_size")
    reached = F.col("offset__") + F.coalesce(F.sum("size").over(within), F.lit(0))
    part = F.greatest(F.lit(0), F.least(F.col("size"), left - reached))
    return found.withColumn("taken", (epochs * F.col("size") + part).cast("long")).select(*rows.columns, "source_size", "target", "taken")


def repeated(docs: DataFrame, mix: DataFrame) -> DataFrame:
    """The mix as rows: each document of ``docs`` once for every time, or started time, that ``mix`` takes it.

    So of each source at most one document, that which crosses the target, stands whole where its first words would do.
    """
    times = F.ceil(F.col("taken") / F.col("size")).cast("int")
    of_row = mix.where("taken > 0").groupBy("doc_id", "source", "tie__").agg(F.max(times).alias("times"))
    # rows that agree in these three are taken alike; the document's own columns travel as one, so that no name can clash
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.xxhash64("text").alias("tie"))
    same = F.col("doc.doc_id").eqNullSafe(F.col("doc_id")) & F.col("doc.source").eqNullSafe(F.col("source")) & (F.col("tie") == F.col("tie__"))
    return rows.join(of_row, same).select("doc", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("copy")).select("doc.*")

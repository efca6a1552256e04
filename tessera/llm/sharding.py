"""Sharding by balanced label propagation: linked documents move together while sizes stay even.

Native: DataFrame functions only. Equal texts are linked. Every document starts with a label by a
hash of its id. In each round every group of equal texts looks where most of its bytes are, and its
other parts ask to move there; a shard admits them, in a fixed order, up to its free capacity. Parts
move as chunks (the documents of a group with one of ``PARTS`` starting labels), so that a group
larger than a shard, or a third of all rows, is spread and no key gathers it. Documents without links
can stand anywhere: at the end large ones (at least ``1 / LARGE`` of a shard, of which there can be no
more than ``LARGE`` for each shard) go one by one, the largest first, to the shard that holds least; all
others then fill the shards to equal size, in the order of a hash, which leaves every shard within
``1 / LARGE`` of the mean as long as linked and large documents fit in.

Prefix sums over movers, free documents and slots run in two levels: sums of hash ranges,
then order within a range; no window holds a shard.

Edge cases: a null text has 0 bytes (size 1) and is linked with the empty text's like; repeated rows
are documents of their own; a null ``doc_id`` hashes like any value; an empty table gives no rows;
fewer documents than shards leave shards empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import stored

SHARDS, PARTS, ROUNDS, SLACK, LARGE = 8, 128, 6, 0.01, 100
#: Hash ranges of a prefix sum: as many as give each about so many rows, within a window of one row for each range.
ROWS_PER_RANGE, LEAST_RANGES = 100_000, 1024
GROUP = ["group__", "size", "text_crc32"]


def sized(docs: DataFrame) -> DataFrame:
    """``doc_id, size, text_crc32`` and what links equal texts: their hash, next to size and crc."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("group__"))


def ranges_of(rows: int) -> int:
    return max(LEAST_RANGES, -(-rows // ROWS_PER_RANGE))


def running(rows: DataFrame, keys: list[str], value: Column, by: list[str], ranges: int) -> DataFrame:
    """``rows`` with ``before__``: the sum of ``value`` over the earlier rows of the same ``keys``, in an order by hash."""
    rows = rows.withColumn("value__", value).withColumn("range__", F.pmod(F.xxhash64(*by), F.lit(ranges)))
    sums = rows.groupBy(*keys, "range__").agg(F.sum("value__").alias("sum__"))
    earlier = Window.partitionBy(*keys).orderBy("range__").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*keys, "range__", F.coalesce(F.sum("sum__").over(earlier), F.lit(0)).alias("offset__"))
    within = Window.partitionBy(*keys, "range__").orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    out = rows.join(offsets, [*keys, "range__"])
    return out.withColumn("before__", F.col("offset__") + F.coalesce(F.sum("value__").over(within), F.lit(0))).drop("value__", "range__", "offset__")


def _loads(chunks: DataFrame, shards: int) -> list[int]:
    held = {r["shard"]: r["b"] for r in chunks.groupBy("shard").agg(F.sum("bytes").alias("b")).collect()}
    return [held.get(k, 0) for k in range(shards)]


def propagated(chunks: DataFrame, total: int, ranges: int, shards: int = SHARDS, rounds: int = ROUNDS, slack: float = SLACK) -> DataFrame:
    """``chunks`` (group, part, bytes, shard) after rounds of moves under the shards' quotas."""
    capacity = total / shards * (1 + slack)
    for _ in range(rounds):
        free = [max(0, int(capacity - x)) for x in _loads(chunks, shards)]
        held = chunks.groupBy(*GROUP, "shard").agg(F.sum("bytes").alias("here"))
        goal = held.groupBy(*GROUP).agg(F.max_by("shard", F.struct("here", -F.col("shard"))).alias("goal"))
        asked = chunks.join(goal, GROUP).where("shard <> goal")
        asked = running(asked, ["goal"], F.col("bytes"), [*GROUP, "part"], ranges)
        quota = F.element_at(F.array(*[F.lit(x).cast("long") for x in free]), F.col("goal") + 1)
        admitted = stored(asked.where(F.col("before__") + F.col("bytes") <= quota).select(*GROUP, "part", "goal"), "moves")
        if admitted.isEmpty():
            break
        chunks = stored(chunks.join(admitted, [*GROUP, "part"], "left").withColumn("shard", F.coalesce("goal", "shard")).drop("goal"), "chunks")
    return chunks


def levelled(large: DataFrame, loads: list[int]) -> DataFrame:
    """``large`` (at most ``LARGE`` rows for each shard) with ``shard``: from the largest on, each goes where least is held."""
    kind = "array<struct<group__:bigint,size:bigint,text_crc32:bigint,shard:int>>"
    start = F.struct(F.array(*[F.lit(x).cast("long") for x in loads]).alias("loads"), F.array().cast(kind).alias("out"))

    def place(state: Column, doc: Column) -> Column:
        goal = (F.array_position(state["loads"], F.array_min(state["loads"])) - 1).cast("int")
        held = F.transform(state["loads"], lambda x, k: F.when(k == goal, x + doc["size"]).otherwise(x))
        one = F.struct(doc["group__"].alias("group__"), doc["size"].alias("size"), doc["text_crc32"].alias("text_crc32"), goal.alias("shard"))
        return F.struct(held.alias("loads"), F.concat(state["out"], F.array(one).cast(kind)).alias("out"))

    order = F.array_sort(F.collect_list(F.struct((-F.col("size")).alias("least"), *GROUP)))
    goals = large.agg(order.alias("docs")).select(F.inline(F.aggregate("docs", start, place)["out"]))
    return large.join(goals, GROUP)


def sharded(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """``doc_id, size, text_crc32, shard, slot`` for every row of ``docs`` (columns ``doc_id``, ``text``)."""
    rows = stored(sized(docs).withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(PARTS)).cast("int")), "sized")
    groups = rows.groupBy(*GROUP).agg(F.count("*").alias("copies")).where("copies > 1")
    linked = rows.join(groups, GROUP, "left_semi")
    chunks = linked.groupBy(*GROUP, "part").agg(F.sum("size").alias("bytes")).withColumn("shard", F.col("part") % shards)
    total, n = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    ranges = ranges_of(n)
    chunks = propagated(stored(chunks, "chunks"), total, ranges, shards)
    placed = linked.join(chunks.select(*GROUP, "part", "shard"), [*GROUP, "part"]).select("doc_id", "size", "text_crc32", "shard")
    alone = rows.join(groups, GROUP, "left_anti")
    is_large = F.col("size") * (shards * LARGE) >= total
    large = stored(levelled(alone.where(is_large), _loads(chunks, shards)).select("doc_id", "size", "text_crc32", "shard"), "large")
    loads = [x + y for x, y in zip(_loads(chunks, shards), _loads(large.withColumnRenamed("size", "bytes"), shards), strict=True)]
    room = [max(0.0, total / shards - x) for x in loads]
    free = total - sum(loads)
    scale = free / sum(room) if sum(room) else 0.0
    ends = [scale * sum(room[: k + 1]) for k in range(shards)]
    alone = running(alone.where(~is_large).withColumn("all__", F.lit(0)), ["all__"], F.col("size"), ["doc_id", "group__"], ranges)
    at = F.col("before__") + F.col("size") / 2
    shard = F.lit(shards - 1)
    for k in range(shards - 2, -1, -1):
        shard = F.when(at < ends[k], k).otherwise(shard)
    both = placed.unionByName(large).unionByName(alone.select("doc_id", "size", "text_crc32", shard.alias("shard")))
    return running(both.withColumn("shard", F.col("shard").cast("int")), ["shard"], F.lit(1).cast("long"), ["doc_id", "text_crc32"], ranges).withColumnRenamed("before__", "slot")

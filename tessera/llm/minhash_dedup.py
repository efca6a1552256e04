"""Near-duplicate documents by bottom-k sketches from one hash function.

Every document is a set of five-word shingles, each hashed once; its sketch is the ``k`` smallest
hashes. Documents with equal sets are one class and are handled once. Then

1. inverted lists: every retained value with two or more classes has a list. Two sketches of
   similar sets overlap so far that they meet within a prefix of each, when both are ordered
   rarest value first; only these prefixes enter the lists, so that a passage which thousands of
   documents share makes no lists for documents with text of their own;
2. overlaps: a list is never paired within itself at once. In rounds of ``LEADERS`` leaders, every
   class of a list meets the list's leaders, those from its smallest components first; a leader has
   then met its whole list and leaves it;
3. union-sketch estimation decides each meeting: sets that ``k`` holds whole are decided for good, others
   go on if they share as much as similar sets do at least (``sketch_overlap``);
4. exact Jaccard on full sets confirms what goes on, a leader's set against all it met in one pass. Links
   make components, and a list whose classes are all in one is done: a group of near copies costs
   its size times a few leaders;
5. lists that are still open, dense in classes that are alike and not linked, are dealt out as pairs
   of blocks: first their sketches, whose overlaps make families, then the texts of each family. The
   classes of the largest component do not meet each other again. Only spanning forests leave a task.

The sketch margins are set at ``MARGIN`` standard deviations, sets of up to three quarters of ``k``
are held whole, and for them the prefixes are exact.

Edge cases: null, empty and blank texts have empty sets and link with nothing; rows with a null
``doc_id`` link with nothing, have no component and are kept; rows that repeat a ``doc_id`` share
the component of their own text; ties take the smallest ``doc_id``; a very long text counts as a block
of its own; extra columns of any name pass through ``deduplicated``. Sets are told apart by 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import WordHashes, connected_components, dealt, forest, runs, shingle_set, sliced, stored, unused, weighed

K = 64
THRESHOLD = 0.75
MARGIN = 5.0
#: Leaders of each list that all its classes meet, by round; what is open then is dealt in blocks.
LEADERS = (1, 4)
#: Classes of a block, and bytes of its texts.
BLOCK, BLOCK_BYTES, COLUMNS = 512, 16 << 20, 4096
#: Text that is read at a time (one text at least), and meetings that are judged at a time.
BATCH_BYTES, MEETINGS = 4 << 20, 2048


def sketch_overlap(k: int = K, threshold: float = THRESHOLD, margin: float = MARGIN) -> int:
    """Values that two sketches of similar sets share at least, up to ``margin`` standard deviations."""
    return max(1, math.floor(threshold * k - margin * math.sqrt(k * threshold * (1 - threshold))))


def _node(shingles: np.ndarray) -> int | None:
    return xxhash.xxh3_64_intdigest(shingles.tobytes()) - (1 << 63) if len(shingles) else None


def _sketches(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in weighed(batches, "text", BATCH_BYTES):
            sizes, nodes, sketches = [], [], []
            for text in batch.column("text").to_pylist():
                s = shingle_set(text, hashes)
                sizes.append(len(s))
                nodes.append(_node(s))
                sketches.append(s[:k].view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("th"), pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64()), pa.array(sketches, pa.list_(pa.int64()))], names=["doc_id", "th", "n_shingles", "node", "sketch"])

    return run


def sketched(docs: DataFrame, k: int = K) -> DataFrame:
    """``(doc_id, th, n_shingles, node, sketch)``; ``th`` is a hash of the text, ``node`` names the set, null where it is empty."""
    return docs.select("doc_id", "text", F.xxhash64("text").alias("th")).mapInArrow(_sketches(k), "doc_id long, th long, n_shingles long, node long, sketch array<long>")


def inverted_lists(classes: DataFrame, k: int = K, threshold: float = THRESHOLD) -> DataFrame:
    """``(h, node, size)``: the values in each class's prefix that another class retains too."""
    entries = classes.select("node", F.col("n_shingles").alias("size"), F.explode("sketch").alias("h"))
    shared = entries.groupBy("h").agg(F.count("*").alias("df")).where("df > 1")
    common = entries.join(shared, "h")
    w = Window.partitionBy("node")
    held = F.least(F.col("size"), F.lit(k))
    exact = F.ceil(F.col("size") * threshold)
    overlap = F.when(F.col("size") <= math.floor(threshold * k), exact).otherwise(F.least(exact, F.lit(sketch_overlap(k, threshold))))
    place = held - F.count("*").over(w) + F.row_number().over(w.orderBy("df", "h"))
    lists = common.withColumn("place", place).where(F.col("place") <= held - overlap + 1).select("h", "node", "size")
    # a list's classes told by their number and two hashes
    sets = lists.groupBy("h").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y")).where("n > 1")
    return lists.join(sets.groupBy("n", "x", "y").agg(F.min("h").alias("h")).select("h"), "h", "left_semi")


def _padded(sketches: pa.ListArray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sketches as rows of ``k`` unsigned values, filled with the largest one, and their lengths."""
    length = sketches.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.full((len(length), k), np.iinfo(np.uint64).max)
    if length.sum():
        out[np.repeat(np.arange(len(length)), length), np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)] = sketches.flatten().to_numpy().view(np.uint64)
    return out, length


def meeting(x: np.ndarray, nx: np.ndarray, y: np.ndarray, ny: np.ndarray, k: int, threshold: float) -> np.ndarray:
    """For each pair of sketches: 0 unlike, 1 perhaps alike, 2 alike for certain.

    Estimated by the values shared among the ``k`` smallest of both; certain if both hold their sets whole.
    """
    both = np.sort(np.concatenate([x, y], axis=1), axis=1)
    again = both[:, 1:] == both[:, :-1]
    # the padding of one side may equal the other's, or a hash: only so many columns are real
    again &= np.arange(1, both.shape[1])[None, :] < (nx + ny)[:, None]
    place = np.cumsum(np.c_[np.ones(len(both), bool), ~again], axis=1)[:, 1:]
    whole = (nx < k) & (ny < k)
    shared = (again & ((place <= k) | whole[:, None])).sum(1)
    alike = 100 * shared >= round(100 * threshold) * (nx + ny - shared)
    return np.where(whole, np.where(alike, 2, 0), shared >= sketch_overlap(k, threshold))


def _met(k: int, threshold: float):
    """The pairs (``lead``, ``node``) that may be alike, with what their ``meeting`` gives.

    Pairs are judged and left out in one step: a filter on a UDF's result is pushed below it and judges again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, MEETINGS):
            met = meeting(*_padded(batch.column("sa"), k), *_padded(batch.column("sb"), k), k, threshold)
            on = pa.array(met > 0)
            yield pa.RecordBatch.from_arrays([batch.column("lead").filter(on), batch.column("node").filter(on), pa.array(met[met > 0], pa.int32())], names=["lead", "node", "met"])

    return run


def shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections, over the values that two sets or more hold."""
    values = np.concatenate(sets)
    rows = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, at, count = np.unique(values, return_inverse=True, return_counts=True)
    shared = count > 1
    column = np.cumsum(shared) - 1
    keep = shared[at]
    rows, columns = rows[keep], column[at[keep]]
    order = np.argsort(columns, kind="stable")
    rows, columns = rows[order], columns[order]
    total = np.zeros((len(sets), len(sets)), np.float64)
    for start in range(0, int(shared.sum()), COLUMNS):
        a, b = np.searchsorted(columns, [start, start + COLUMNS])
        held = np.zeros((len(sets), COLUMNS), np.float32)
        held[rows[a:b], columns[a:b] - start] = 1
        total += held @ held.T
    return total


def _alike(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, in whole numbers."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _stars(threshold: float):
    """Links of leaders: each group's first row is its leader, whose set all further rows meet."""
    percent = round(100 * threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, leader, held = WordHashes(), None, None
        for batch in weighed(batches, "text", BATCH_BYTES):
            a, b = [], []
            for lead, node, text in zip(*(batch.column(c).to_pylist() for c in ("lead", "node", "text")), strict=True):
                s = shingle_set(text, hashes)
                if lead == node:
                    leader, held = lead, s
                elif lead == leader and _alike(held, s, percent):
                    a.append(lead)
                    b.append(node)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def confirmed_stars(pairs: DataFrame, texts: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """The pairs (``lead``, ``node``) whose full sets are alike, as ``a, b``.

    A leader's text goes once to every ``block`` of its pairs, each of which is one sorted run.
    """
    sizes = pairs.groupBy("lead").agg(F.ceil(F.count("*") / block).cast("int").alias("parts"))
    members = pairs.join(sizes, "lead").join(texts, "node").select("lead", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("part"), "node", "text")
    leaders = sizes.join(texts.withColumnRenamed("node", "lead"), "lead").select("lead", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("lead").alias("node"), "text")
    rows = leaders.unionByName(members).repartition("lead", "part").sortWithinPartitions("lead", "part", F.col("node") != F.col("lead"))
    return rows.select("lead", "node", "text").mapInArrow(_stars(threshold), "a long, b long")


def _sketch_families(k: int, threshold: float):
    """Forests of the classes of a pair of blocks whose sketches share as much as similar sets do."""
    least = sketch_overlap(k, threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches, ["h", "low", "high"]):
            nodes, block = t["node"].to_numpy(), t["block"].to_numpy()
            sets = [np.array(x, np.int64).view(np.uint64) for x in t["sketch"].to_pylist()]
            both, size = shared_counts(sets), np.array([len(x) for x in sets])
            whole = size < k
            links = np.where(whole[:, None] & whole[None, :], 100 * both >= round(100 * threshold) * (size[:, None] + size[None, :] - both), both >= least)
            yield _forest_of(links, nodes, block, t["low"][0].as_py(), t["high"][0].as_py())

    return run


def _forest_of(links: np.ndarray, nodes: np.ndarray, block: np.ndarray, low: int, high: int) -> pa.RecordBatch:
    links &= (block == low)[:, None] & (block == high)[None, :] & (nodes[:, None] != nodes[None, :])
    a, b = forest(nodes, nodes, links) if links.any() else (nodes[:0], nodes[:0])
    return pa.RecordBatch.from_arrays([pa.array(a[a != b], pa.int64()), pa.array(b[a != b], pa.int64())], names=["a", "b"])


def _text_links(threshold: float):
    """Forests of the links of a pair of blocks of texts, by their full sets."""
    percent = round(100 * threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for t in runs(batches, ["family", "low", "high"]):
            if t.num_rows < 2:
                continue
            sets = [shingle_set(x, hashes) for x in t["text"].to_pylist()]
            both, size = shared_counts(sets), np.array([len(x) for x in sets])
            links = 100 * both >= percent * (size[:, None] + size[None, :] - both)
            yield _forest_of(links, t["node"].to_numpy(), t["block"].to_numpy(), t["low"][0].as_py(), t["high"][0].as_py())

    return run


def _open(lists: DataFrame, found: DataFrame | None) -> DataFrame:
    """The entries of lists with classes of two components or more, with their ``component``."""
    now = lists.withColumn("component", F.col("node")) if found is None else lists.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    open_ = now.groupBy("h").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("h")
    return stored(now.join(open_, "h"), "open-lists")


def linked(classes: DataFrame, lists: DataFrame, texts: DataFrame, k: int = K, threshold: float = THRESHOLD, block: int = BLOCK, leaders: tuple[int, ...] = LEADERS) -> DataFrame | None:
    """``(node, component)`` of the classes that are linked to another; None if there are none."""
    sketch = classes.select("node", "sketch")
    edges = found = None

    def grown(new: DataFrame) -> tuple[DataFrame, DataFrame]:
        links = new if edges is None else edges.unionByName(new)
        return links, stored(connected_components(links), "labels")

    for count in leaders:
        now = _open(lists, found)
        if now.isEmpty():
            return found
        within = now.groupBy("h", "component").agg(F.count("*").alias("members"))
        slot = F.pmod(F.xxhash64("node", F.lit(count)), F.lit(count)).alias("slot")
        chosen = now.join(within, ["h", "component"]).groupBy("h", slot).agg(F.min(F.struct("members", "node", "size", "component")).alias("x"))
        chosen = stored(chosen.select("h", F.col("x.node").alias("lead"), F.col("x.size").alias("lead_size"), F.col("x.component").alias("lead_component")), "leaders")
        fit = F.least("size", "lead_size") >= threshold * F.greatest("size", "lead_size")
        pairs = now.join(chosen, "h").where((F.col("component") != F.col("lead_component")) & fit).select("lead", "node").distinct()
        near = pairs.join(sketch.withColumnRenamed("sketch", "sb"), "node").join(sketch.select(F.col("node").alias("lead"), F.col("sketch").alias("sa")), "lead")
        near = stored(near.select("lead", "node", "sa", "sb").mapInArrow(_met(k, threshold), "lead long, node long, met int"), "met")
        sure = near.where("met = 2").select(F.col("lead").alias("a"), F.col("node").alias("b"))
        lists = now.join(chosen.select("h", F.col("lead").alias("node")), ["h", "node"], "left_anti").select("h", "node", "size")
        new = stored(sure.unionByName(confirmed_stars(near.where("met = 1").select("lead", "node"), texts, threshold, block)), "links")
        edges, found = grown(new)
    now = _open(lists, found)
    if now.isEmpty():
        return found
    rows = _settled(now, "h").select("h", "node", "settled").join(sketch, "node")
    related = stored(dealt(rows, "h", block, settled="settled").mapInArrow(_sketch_families(k, threshold), "a long, b long").distinct(), "related")
    family = stored(connected_components(related).withColumnRenamed("component", "family"), "families")
    named = family.withColumn("component", F.col("node")) if found is None else family.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    rows = _settled(named, "family").select("node", "family", "settled").join(texts, "node").withColumn("bytes", F.octet_length("text"))
    edges, found = grown(stored(dealt(rows, "family", block, "bytes", BLOCK_BYTES, "settled").mapInArrow(_text_links(threshold), "a long, b long"), "links"))
    return found


def _settled(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` with ``settled``: is its component the largest of its group?"""
    sizes = rows.groupBy(key, "component").agg(F.count("*").alias("n"))
    largest = sizes.groupBy(key).agg(F.max_by("component", F.struct("n", "component")).alias("largest"))
    return rows.join(largest, key).withColumn("settled", F.col("component") == F.col("largest")).drop("largest")


def _assigned(docs: DataFrame, k: int, threshold: float, block: int, leaders: tuple[int, ...]) -> tuple[DataFrame, DataFrame]:
    """Every row's ``(doc_id, th, n_shingles, node)``, and the ``first`` (doc_id, th) of every node's component."""
    docs = docs.select("doc_id", "text")
    base = stored(sketched(docs, k), "sketches")
    named = base.where("node is not null and doc_id is not null")
    classes = named.groupBy("node").agg(F.min(F.struct("doc_id", "th")).alias("first"), F.first("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch"))
    classes = stored(classes, "classes")
    lists = stored(inverted_lists(classes, k, threshold), "lists")
    wanted = classes.join(lists.select("node").distinct(), "node", "left_semi").select("node", F.col("first.doc_id").alias("id"), F.col("first.th").alias("th"))
    # rows that agree in id and hash have one text
    texts = docs.join(wanted, (F.col("doc_id") == F.col("id")) & (F.xxhash64("text") == F.col("th"))).select("node", "text")
    found = linked(classes, lists, stored(texts.dropDuplicates(["node"]), "texts"), k, threshold, block, leaders)
    groups = classes.select("node", "first")
    groups = groups.withColumn("component", F.col("node")) if found is None else groups.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    smallest = groups.groupBy("component").agg(F.min("first").alias("first"))
    return base.drop("sketch"), groups.drop("first").join(smallest, "component").select("node", "first")


def components(docs: DataFrame, k: int = K, threshold: float = THRESHOLD, block: int = BLOCK, leaders: tuple[int, ...] = LEADERS) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)``, one row for each row of ``docs``."""
    base, of_node = _assigned(docs, k, threshold, block, leaders)
    out = base.join(of_node, "node", "left")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("first.doc_id", "doc_id"))
    return out.select("doc_id", "n_shingles", own.alias("component_id"), F.coalesce(F.col("doc_id") == own, F.lit(True)).alias("kept"))


def deduplicated(docs: DataFrame, k: int = K, threshold: float = THRESHOLD, block: int = BLOCK, leaders: tuple[int, ...] = LEADERS) -> DataFrame:
    """``docs`` with one row of each near-duplicate group: that with the smallest id (then hash of its text).

    Rows that repeat it in id and text go too; rows that link with nothing for their blank text or null id stay.
    """
    base, of_node = _assigned(docs, k, threshold, block, leaders)
    named = base.where("node is not null and doc_id is not null").groupBy("doc_id", "th", "node").agg(F.count("*").alias("rows"))
    fate = named.join(of_node, "node").withColumn("stays", (F.col("doc_id") == F.col("first.doc_id")) & (F.col("th") == F.col("first.th")))
    th, id_, th_ = unused(docs, "th", "id", "th_")
    rows = docs.withColumn(th, F.xxhash64("text"))

    def keys(condition: Column | str) -> DataFrame:
        return fate.where(condition).select(F.col("doc_id").alias(id_), F.col("th").alias(th_)).distinct()

    same = (F.col("doc_id") == F.col(id_)) & (F.col(th) == F.col(th_))
    repeated = rows.join(keys("stays and rows > 1"), same, "left_semi").dropDuplicates(["doc_id", th])
    return rows.join(keys("not stays or rows > 1"), same, "left_anti").unionByName(repeated).drop(th)

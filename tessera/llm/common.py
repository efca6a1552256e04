"""Shared helpers of the training-data operators: slices, shingles, components, blocks."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.sources.shared import stored

DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Arrow batches of at most ``rows`` rows, so that a task's Python memory stays bounded."""
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)


def weighed(batches: Iterator[pa.RecordBatch], column: str, most: int) -> Iterator[pa.RecordBatch]:
    """Arrow batches whose texts in ``column`` take at most ``most`` bytes together, or of one row."""
    for batch in batches:
        sizes = np.array(pc.fill_null(pc.binary_length(batch.column(column)), 0), np.int64)
        start = held = 0
        for k, size in enumerate(sizes.tolist()):
            if held and held + size > most:
                yield batch.slice(start, k - start)
                start, held = k, 0
            held += size
        if start < batch.num_rows:
            yield batch.slice(start)


class WordHashes(dict):
    """64-bit hashes of words, kept for the first ``limit`` different words of a task."""

    def __init__(self, limit: int = 400_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) < self.limit:
            self[word] = value
        return value


#: Odd multipliers, one for each position of a shingle (any odd 64-bit numbers would do).
POSITION = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)
SHINGLE = 5


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every input bit (xorshift-multiply)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's five-word shingles.

    Words are runs outside ``[\\x20\\x09-\\x0D]`` with A-Z lower-cased, which is what
    ``bytes.lower`` and ``bytes.split`` do. One to four words make one shingle; no words, none.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(hashes.__getitem__, words), np.uint64, n)
    if n < SHINGLE:
        return mixed((w * POSITION[:n]).sum(dtype=np.uint64, keepdims=True) + np.uint64(n))
    h = w[: n - 4] * POSITION[0]
    for k in range(1, SHINGLE):
        h += w[k : n - 4 + k] * POSITION[k]
    return np.unique(mixed(h))


def connected_components(edges: DataFrame, name: str = "components", rounds: int = 60) -> DataFrame:
    """``(node, component)`` for every node of ``edges`` (columns ``a``, ``b``), smallest member as component.

    Large-star and small-star steps: every step joins a node's edges with its smallest neighbour,
    which is found by a partial aggregate, so that a hub is split by the join and not gathered.
    Rounds grow with the logarithm of the longest path; they end when every node has one edge, to a
    node without any. Edges that are null or loops are ignored.
    """
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    for _ in range(rounds):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        edges = stored(small, name)
        parents = edges.groupBy("u").agg(F.count("*").alias("n"))
        # a node with two parents, or a parent that has one itself
        if edges.join(parents.select(F.col("u").alias("v")), "v", "left_semi").isEmpty() and parents.where("n > 1").isEmpty():
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = edges.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The groups of a partition that is sorted by ``keys``, one table each; at most one group is held over."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        new = np.zeros(batch.num_rows, bool)
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
        first = tuple(c[0] for c in columns)
        cuts = [0, *np.flatnonzero(new).tolist(), batch.num_rows]
        for k, (a, b) in enumerate(itertools.pairwise(cuts)):
            if held and (k or first != last):
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
        last = tuple(c[-1] for c in columns)
    if held:
        yield pa.Table.from_batches(held)


def forest(a: np.ndarray, b: np.ndarray, links: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, node) that connect what ``links`` (rows a, columns b) connects: one for each node at most."""
    i, j = np.nonzero(links)
    nodes, at = np.unique(np.concatenate([a[i], b[j]]), return_inverse=True)
    left, right = at[: len(i)], at[len(i) :]
    label = np.arange(len(nodes))
    while True:
        before = label.copy()
        np.minimum.at(label, left, label[right])
        np.minimum.at(label, right, label[left])
        label = label[label]
        if (label == before).all():
            return nodes, nodes[label]


def unused(df: DataFrame, *names: str) -> list[str]:
    """Column names that ``df`` does not have: ``names``, lengthened where they clash."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def dealt(rows: DataFrame, key: str, block: int, weight: str | None = None, most: int = 1, settled: str | None = None) -> DataFrame:
    """``rows`` sorted within partitions by ``key, low, high``: groups of over ``block`` rows are dealt out as pairs of blocks.

    Each row gets the ``block`` it belongs to and stands in every pair of blocks that has it. With a
    column ``weight``, blocks hold about ``most`` of it at most too, or one row. Rows that are
    ``settled`` among each other need not meet: they have blocks of their own, which are not paired.
    """
    rows = rows.withColumn("settled__", F.col(settled) if settled else F.lit(False))

    def parts(of: Column) -> Column:
        n = F.count(F.when(of, 1))
        by_weight = F.least(n, F.ceil(F.coalesce(F.sum(F.when(of, F.col(weight))), F.lit(0)) / most)) if weight else F.lit(0)
        return F.greatest(F.ceil(n / block), by_weight).cast("int")

    large = rows.groupBy(key).agg(parts(F.lit(True)).alias("all__"), parts(~F.col("settled__")).alias("open__"), parts(F.col("settled__")).alias("shut__")).where("all__ > 1").drop("all__")
    rows = rows.join(large, key, "left").withColumn("open__", F.coalesce("open__", F.lit(1))).withColumn("shut__", F.coalesce("shut__", F.lit(0)))
    apart, of_hash = F.col("settled__") & (F.col("shut__") > 0), F.xxhash64("node")
    rows = rows.withColumn("block", F.when(apart, F.col("open__") + F.pmod(of_hash, F.col("shut__"))).otherwise(F.pmod(of_hash, F.col("open__"))).cast("int"))
    rows = rows.withColumn("other__", F.explode(F.sequence(F.lit(0), F.when(apart, F.col("open__") - 1).otherwise(F.col("open__") + F.col("shut__") - 1))))
    rows = rows.withColumn("low", F.least("block", "other__")).withColumn("high", F.greatest("block", "other__")).drop("open__", "shut__", "other__", "settled__")
    return rows.repartition(key, "low", "high").sortWithinPartitions(key, "low", "high")

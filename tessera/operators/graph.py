"""Street graphs: segments, collapsed arcs, shortest-path centralities, components, clustering, orientation.

``arcs``: ``u, v, key`` and weights (``length``, ``travel_time``); ``nodes``: ``node_id, x, y``. Ids are text:
undirected keys are lexicographic in the text of the ids.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.sources.shared import stored

#: Largest graph, in arcs, that a task of shortest paths holds in arrays (about 32 bytes each), and arcs of a row that travels there.
TASK_ARCS, ROW_ARCS = 10_000_000, 1 << 15
#: Buckets of hashed ids in which nodes are numbered.
NUMBER_BUCKETS = 256
#: Sources that a task takes at once, distances that it holds at most, and arcs that it relaxes at a time.
SOURCES_AT_ONCE, BLOCK_CELLS, RUN_ARCS = 32, 1 << 22, 1 << 15


def segments(arcs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Undirected segments: both directions of a street are one row, ``tramo_id = u-v-key`` with the ids in text order.

    ``keep``: attributes of the direction whose ends come first.
    """
    u, v = F.col("u").cast("string"), F.col("v").cast("string")
    pairs = arcs.withColumn("a", F.least(u, v)).withColumn("b", F.greatest(u, v))
    best = pairs.groupBy("a", "b", "key").agg(F.min("length").alias("length"), *[F.min_by(c, F.struct("u", "v")).alias(c) for c in keep])
    return best.select(F.concat_ws("-", "a", "b", F.col("key").cast("string")).alias("tramo_id"), F.col("a").alias("u"), F.col("b").alias("v"), "key", "length", *keep)


def quality(arcs: DataFrame, observed: str, fields: tuple[str, ...]) -> DataFrame:
    """Sizes of a graph, percent of imputed arcs by count and by length, and percent of segments that lack each field.

    What is imputed counts over arcs, as paths use them; what is missing over segments, which are the streets.
    """
    pct = lambda top, all_: F.round(100 * top / all_, 6)
    made = ~F.coalesce(F.col(observed), F.lit(False))
    lines = segments(arcs, fields).agg(F.count("*").alias("n"), *[F.round(100 * F.avg(F.col(c).isNull().cast("double")), 6).alias(c) for c in fields])
    ends = arcs.select(F.explode(F.array("u", "v")).alias("node")).agg(F.count_distinct("node").alias("n"))
    out = arcs.agg(
        F.count("*").alias("n_aristas"), pct(F.count(F.when(made, 1)), F.count("*")).alias("pct_imputado_aristas"),
        pct(F.sum(F.when(made, F.col("length")).otherwise(0.0)), F.sum("length")).alias("pct_imputado_largo"),
    )
    out = out.withColumn("n_nodos", ends.scalar()).withColumn("lines__", lines.select(F.struct("*")).scalar())
    return out.select("n_nodos", "n_aristas", F.col("lines__.n").alias("n_tramos"), "pct_imputado_aristas", "pct_imputado_largo", *[F.col(f"lines__.{c}").alias(f"pct_sin_{c}") for c in fields])


def undirected(pairs: DataFrame) -> DataFrame:
    """Each unordered pair once, without loops."""
    return pairs.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def collapsed(arcs: DataFrame, weights: tuple[str, ...]) -> DataFrame:
    """Parallel arcs as one: for each weight the least value and the key that has it (ties: the smallest key)."""
    out = [f for w in weights for f in (F.min(w).alias(w), F.min_by("key", F.struct(w, "key")).alias(f"key_{w}"))]
    return arcs.where("u <> v").groupBy("u", "v").agg(*out)


class Paths:
    """Shortest paths over a directed graph in arrays, from a block of sources at a time; weights are positive.

    Only arcs between nodes that lead on are relaxed in rounds: all at once (only those from nodes that came closer in
    the last round), in blocks of arcs that share targets. Arcs to nodes that lead nowhere follow once, from the nodes
    that the block reaches. Path counts and dependencies then follow the arcs that shortest paths use, round by round,
    until nothing changes.
    """

    def __init__(self, n: int, u: np.ndarray, v: np.ndarray, w: np.ndarray, every: bool = False):
        """``every``: all nodes lead on, if not in this graph."""
        order = np.lexsort((u, v))
        self.n, self.u, self.v, w = n, u[order].astype(np.int32), v[order].astype(np.int32), w[order]
        self.leads = np.full(n, every)
        self.leads[self.u] = True
        # nodes that lead on, and the place of each among them
        self.inner, self.place = np.flatnonzero(self.leads), (np.cumsum(self.leads) - 1).astype(np.int32)
        self.on, self.last = (np.flatnonzero(x).astype(np.int32) for x in (self.leads[self.v], ~self.leads[self.v]))
        self.on_u, self.on_v, self.on_w = self.place[self.u[self.on]], self.place[self.v[self.on]], w[self.on]
        self.last_u, self.last_v, self.last_w = self.place[self.u[self.last]], self.v[self.last], w[self.last]

    @staticmethod
    def _runs(arcs: np.ndarray, head: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """``arcs`` in slices that end with a target's last arc, and where in each slice the targets begin."""
        v, at = head[arcs], 0
        while at < len(arcs):
            end = min(at + RUN_ARCS, len(arcs))
            if end < len(arcs):
                end = int(np.searchsorted(v, v[end - 1], side="right"))
            yield arcs[at:end], np.flatnonzero(np.r_[True, v[at + 1 : end] != v[at : end - 1]])
            at = end

    def near(self, sources: np.ndarray) -> np.ndarray:
        """``(inner nodes, sources)``: distances of the nodes that lead on; sources that do not reach none."""
        dist = np.full((len(self.inner), len(sources)), np.inf)
        leads = np.flatnonzero(self.leads[sources])
        dist[self.place[sources[leads]], leads] = 0
        fresh = np.zeros(len(self.inner), bool)
        fresh[self.place[sources[leads]]] = True
        while fresh.any():
            moved = np.zeros(len(self.inner), bool)
            for arcs, starts in self._runs(np.flatnonzero(fresh[self.on_u]), self.on_v):
                best = np.minimum.reduceat(dist[self.on_u[arcs]] + self.on_w[arcs, None], starts, axis=0)
                at = self.on_v[arcs[starts]]
                # closer by more than rounding: equal paths must not take turns
                closer = best < dist[at] * (1 - 1e-12)
                moved[at[closer.any(1)]] = True
                dist[at] = np.where(closer, best, dist[at])
            fresh = moved
        return dist

    def distances(self, sources: np.ndarray) -> np.ndarray:
        """``(n, sources)``, infinite where there is no path."""
        near = self.near(sources)
        dist = np.full((self.n, len(sources)), np.inf)
        dist[self.inner] = near
        for arcs, starts in self._runs(np.flatnonzero(np.isfinite(near).any(1)[self.last_u]), self.last_v):
            dist[self.last_v[arcs[starts]]] = np.minimum.reduceat(near[self.last_u[arcs]] + self.last_w[arcs, None], starts, axis=0)
        dist[sources, np.arange(len(sources))] = 0
        return dist

    def tight(self, near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The (arc, source) pairs of arcs between inner nodes in which the arc ends a shortest path."""
        found = [(np.empty(0, np.int64),) * 2]
        for arcs, _ in self._runs(np.flatnonzero(np.isfinite(near).any(1)[self.on_u]), self.on_v):
            far = near[self.on_v[arcs]]
            with np.errstate(invalid="ignore"):
                a, b = np.nonzero(np.abs(near[self.on_u[arcs]] + self.on_w[arcs, None] - far) <= 1e-12 * np.maximum(1.0, far))
            found.append((arcs[a], b))
        return tuple(np.concatenate([f[k] for f in found]) for k in range(2))

    def _tight_last(self, near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same of arcs to nodes that lead nowhere."""
        found = [(np.empty(0, np.int64),) * 2]
        for arcs, starts in self._runs(np.flatnonzero(np.isfinite(near).any(1)[self.last_u]), self.last_v):
            through = near[self.last_u[arcs]] + self.last_w[arcs, None]
            far = np.repeat(np.minimum.reduceat(through, starts, axis=0), np.diff(np.r_[starts, len(arcs)]), axis=0)
            with np.errstate(invalid="ignore"):
                a, b = np.nonzero(through - far <= 1e-12 * np.maximum(1.0, far))
            found.append((arcs[a], b))
        return tuple(np.concatenate([f[k] for f in found]) for k in range(2))

    def _settled(self, step, first: np.ndarray) -> np.ndarray:
        now = first
        for _ in range(self.n + 1):
            new = step(now)
            if np.array_equal(new, now):
                return now
            now = new
        raise RuntimeError("shortest paths did not settle")

    def counts(self, near: np.ndarray, arcs: np.ndarray, column: np.ndarray) -> np.ndarray:
        """``(inner nodes, sources)``, flat: numbers of shortest paths (``arcs, column``: ``tight``)."""
        k = near.shape[1]
        tail, head, root = self.on_u[arcs] * k + column, self.on_v[arcs] * k + column, (near == 0).ravel().astype(float)
        return self._settled(lambda c: root + np.bincount(head, c[tail], len(root)), root)

    def owed(self, arcs: np.ndarray, column: np.ndarray, count: np.ndarray, k: int, base: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Dependencies of inner nodes on each source, flat, and of each of the ``arcs``; ``base``: what the last arcs add to their tails."""
        tail, head = self.on_u[arcs] * k + column, self.on_v[arcs] * k + column
        share = count[tail] / count[head]
        owed = self._settled(lambda x: base + np.bincount(tail, share * (1 + x[head]), len(base)), base)
        return owed, share * (1 + owed[head])

    def dependencies(self, sources: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Brandes' dependencies of these sources, summed: by node, and by arc."""
        node, arc = np.zeros(self.n), np.zeros(len(self.u))
        sources = sources[self.leads[sources]]
        near = self.near(sources)
        # sources that reach few nodes share a block, so that the last arcs of the others are not looked at for them
        order = np.argsort(np.isfinite(near).sum(0), kind="stable")
        most = max(1, min(SOURCES_AT_ONCE, BLOCK_CELLS // max(1, self.n)))
        for at in range(0, len(order), most):
            block = near[:, order[at : at + most]]
            k = block.shape[1]
            arcs, column = self.tight(block)
            count = self.counts(block, arcs, column)
            last, place = self._tight_last(block)
            tail, head = self.last_u[last] * k + place, self.last_v[last] * k + place
            share = count[tail] / np.bincount(head, count[tail], self.n * k)[head]
            owed, on = self.owed(arcs, column, count, k, np.bincount(tail, share, len(count)))
            arc[self.on] += np.bincount(arcs, on, len(self.on))
            arc[self.last] += np.bincount(last, share, len(self.last))
            node[self.inner] += np.where(block == 0, 0.0, owed.reshape(block.shape)).sum(1)
        return node, arc


def _pairs(arcs: DataFrame, weight: str) -> DataFrame:
    return _kept(arcs.groupBy("u", "v").agg(F.min(weight).alias("w")).where("u <> v"))


def _numbered(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(at, node)`` with the nodes numbered from 0, and ``(u, v, a, b, w)``, the arcs with the numbers of their ends.

    Nodes are numbered in buckets of their hashes, behind the nodes of the buckets before; weights that are not
    positive raise.
    """
    names = _names(pairs.select(F.col("u").alias("node")).union(pairs.select("v")).distinct())
    weight = F.when(F.col("w") > 0, F.col("w").cast("double")).otherwise(F.raise_error(F.lit("weights must be positive")).cast("double"))
    ends = pairs.join(names.toDF("a", "u"), "u").join(names.toDF("b", "v"), "v").select("u", "v", "a", "b", weight.alias("w"))
    return names, _kept(ends)


def _names(nodes: DataFrame) -> DataFrame:
    """``nodes`` (``node`` and more) numbered from 0 (``at``)."""
    more = [c for c in nodes.columns if c != "node"]
    nodes = _kept(nodes.withColumn("bucket", F.pmod(F.xxhash64("node"), F.lit(NUMBER_BUCKETS)).cast("int")))
    # the window without partitions runs over at most NUMBER_BUCKETS rows
    before = F.coalesce(F.sum("n").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = nodes.groupBy("bucket").agg(F.count("*").alias("n")).select("bucket", before.alias("before"))
    place = F.row_number().over(Window.partitionBy("bucket").orderBy("node"))
    return _kept(nodes.join(F.broadcast(offsets), "bucket").select((F.col("before") + place - 1).cast("int").alias("at"), "node", *more))


def _by_sources(ends: DataFrame, sources: DataFrame, run, schema: str) -> DataFrame:
    """``run(arrays, rows)`` in tasks, each with the graph in arrays and its share of the ``sources`` (``at``; ``a`` and ``w``, if they have a list of nodes and numbers).

    The arcs are packed into rows of arrays once; a shuffle hands every task all of these rows and its sources, so
    the driver holds none of them. ``run`` yields Arrow batches.
    """
    tasks = max(1, min(sources.count(), ends.sparkSession.sparkContext.defaultParallelism * 2))
    row = F.pmod(F.xxhash64("a", "b"), F.lit(max(1, ends.count() // ROW_ARCS))).alias("row")
    packed = ends.groupBy(row).agg(F.collect_list(F.struct("a", "b", "w")).alias("arcs"))
    packed = _kept(packed.select(*[F.col(f"arcs.{c}").alias(c) for c in ("a", "b", "w")]))
    everywhere = packed.select(F.explode(F.sequence(F.lit(0), F.lit(tasks - 1))).alias("task"), F.lit(None).cast("int").alias("at"), "a", "b", "w")
    shares = sources.repartition(tasks).select(F.spark_partition_id().alias("task"), *sources.columns)
    # a task's arcs stand before its sources
    dealt = everywhere.unionByName(shares, allowMissingColumns=True).repartitionById(tasks, F.col("task")).sortWithinPartitions(F.col("at").asc_nulls_first())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, first = {"a": [], "b": [], "w": []}, []
        for batch in batches:
            arcs = batch.filter(batch.column("at").is_null())
            for column, arrays in parts.items():
                arrays.append(arcs.column(column).flatten().to_numpy())
            if arcs.num_rows < batch.num_rows:
                first.append(batch.filter(batch.column("at").is_valid()))
                break
        if first:
            arrays = [np.concatenate(parts.pop(c)) for c in ("a", "b", "w")]
            yield from run(arrays, itertools.chain(first, batches))

    return dealt.drop("task").mapInArrow(work, schema)


def _blocks(rows: Iterator[pa.RecordBatch], nodes: int, most: int = SOURCES_AT_ONCE) -> Iterator[tuple[np.ndarray, pa.RecordBatch]]:
    """Sources, at most ``most`` and so many that a number for each of them and of ``nodes`` is held in bounded memory, and their rows."""
    step = max(1, min(most, BLOCK_CELLS // max(1, nodes)))
    for batch in rows:
        for k in range(0, batch.num_rows, step):
            part = batch.slice(k, step)
            yield part.column("at").to_numpy(), part


def _scored(graph: Paths, node: np.ndarray, arc: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Dependencies by node (``b`` is -1) and by arc."""
    at, on = np.flatnonzero(node), np.flatnonzero(arc)
    for a, b, score in ((at, np.full(len(at), -1), node[at]), (graph.u[on], graph.v[on], arc[on])):
        whole = pa.record_batch({"a": pa.array(a, pa.int32()), "b": pa.array(b, pa.int32()), "score": pa.array(score)})
        yield from (whole.slice(k, ROW_ARCS) for k in range(0, len(a), ROW_ARCS))


def _summed(n: int, ends: DataFrame, sources: DataFrame) -> DataFrame:
    """``(a, b, score)``: dependencies of the ``sources`` by node (``b`` is -1) and by arc; each task adds up those of its sources."""

    def run(arrays: list[np.ndarray], rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graph = Paths(n, *arrays)
        node = arc = 0.0
        for ids, _ in _blocks(rows, len(graph.inner), 8 * SOURCES_AT_ONCE):
            more = graph.dependencies(ids)
            node, arc = node + more[0], arc + more[1]
        yield from _scored(graph, node, arc)

    return _by_sources(ends, sources, run, _SCORES).groupBy("a", "b").agg(F.sum("score").alias("score"))


_SCORES = "a int, b int, score double"


def betweenness(arcs: DataFrame, weight: str, sources: int | None = None, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """``(nodes, arcs)`` with betweenness, exact or from ``sources`` sources in the order of a seeded hash.

    Brandes: the sources are spread over the tasks, each task adds up its own dependencies, and one
    aggregate sums them. Normalised by (n - 1)(n - 2) and n(n - 1); a sample is scaled by n / sources.
    A source that leads nowhere owes nothing and is not dealt out. Tasks do not hold a graph of over ``TASK_ARCS`` arcs:
    they then hold the arcs between nodes that lead on, and if these are as many, joins do all the work.
    """
    pairs = _pairs(arcs, weight)
    order = lambda c: [F.xxhash64(F.lit(seed), c), c]
    leads = lambda c: pairs.select(F.col("u").alias(c)).distinct()
    if pairs.count() > TASK_ARCS:
        names = _kept(pairs.select(F.col("u").alias("node")).union(pairs.select("v")).distinct())
        n = names.count()
        picked = names.orderBy(*order("node")).limit(sources) if sources else names
        picked = _kept(picked.join(leads("node"), "node", "left_semi").select(F.col("node").alias("s")))
        inner = _kept(pairs.join(leads("v"), "v", "left_semi"))
        if inner.count() > TASK_ARCS:
            node, arc = dependencies_by_joins(pairs, picked)
        else:
            node, arc = dependencies_by_inner(inner, _kept(pairs.join(leads("v"), "v", "left_anti")), picked)
        node, arc = names.join(node, "node", "left"), pairs.select("u", "v").join(arc, ["u", "v"], "left")
    else:
        names, ends = _numbered(pairs)
        n = names.count()
        picked = names.orderBy(*order("node")).limit(sources) if sources else names
        sums = _kept(_summed(n, ends, picked.join(leads("node"), "node", "left_semi").select("at")))
        node = names.join(sums.where("b = -1").select(F.col("a").alias("at"), "score"), "at", "left")
        arc = ends.select("u", "v", "a", "b").join(sums, ["a", "b"], "left")
    scale = n / sources if sources and sources < n else 1.0
    scored = lambda most: (F.coalesce("score", F.lit(0.0)) * scale / max(1, most)).alias("bc")
    return node.select("node", scored((n - 1) * (n - 2))), arc.select("u", "v", scored(n * (n - 1)))


def dependencies_by_inner(inner: DataFrame, last: DataFrame, sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``dependencies_by_joins`` where only the ``inner`` arcs, between nodes that lead on, travel to the tasks.

    Tasks find distances and path counts over them; joins carry these over the ``last`` arcs, to nodes that lead nowhere,
    and what a source's last arcs add to their tails goes back to the tasks, which add up the dependencies.
    """
    names, ends = _numbered(inner)
    n = names.count()

    def reached(arrays: list[np.ndarray], rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graph = Paths(n, *arrays, every=True)
        for ids, _ in _blocks(rows, n):
            near = graph.near(ids)
            count = graph.counts(near, *graph.tight(near)).reshape(near.shape)
            at, column = np.nonzero(np.isfinite(near))
            whole = pa.record_batch({"at": pa.array(ids[column], pa.int32()), "node": pa.array(at, pa.int32()), "d": pa.array(near[at, column]), "c": pa.array(count[at, column])})
            yield from (whole.slice(k, ROW_ARCS) for k in range(0, len(at), ROW_ARCS))

    def owed(arrays: list[np.ndarray], rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graph = Paths(n, *arrays, every=True)
        node, arc = np.zeros(n), np.zeros(len(graph.u))
        for ids, part in _blocks(rows, n):
            near, base = graph.near(ids), np.zeros((n, len(ids)))
            sizes = part.column("a").value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            base[part.column("a").flatten().to_numpy(), np.repeat(np.arange(len(ids)), sizes)] = part.column("w").flatten().to_numpy()
            arcs, column = graph.tight(near)
            back, on = graph.owed(arcs, column, graph.counts(near, arcs, column), len(ids), base.ravel())
            node += np.where(near == 0, 0.0, back.reshape(near.shape)).sum(1)
            arc += np.bincount(arcs, on, len(arc))
        yield from _scored(graph, node, arc)

    own = sources.join(names.withColumnRenamed("node", "s"), "s")
    found = _by_sources(ends, own.select("at"), reached, "at int, node int, d double, c double")
    found = found.join(own, "at").join(names.toDF("node", "u"), "node").select("s", "u", "d", "c")
    alone = sources.join(names.select(F.col("node").alias("s")), "s", "left_anti").select("s", F.col("s").alias("u"), F.lit(0.0).alias("d"), F.lit(1.0).alias("c"))
    met = found.unionByName(alone).join(last, "u").select("s", "u", "v", (F.col("d") + F.col("w")).alias("far"), "c")
    same = Window.partitionBy("s", "v")
    tight = met.withColumn("best", F.min("far").over(same)).where(F.col("far") - F.col("best") <= 1e-12 * F.greatest(F.lit(1.0), "best"))
    shares = _kept(tight.select("s", "u", "v", (F.col("c") / F.sum("c").over(same)).alias("share")))
    base = shares.groupBy("s", "u").agg(F.sum("share").alias("w")).join(names.toDF("a", "u"), "u").groupBy("s").agg(F.collect_list(F.struct("a", "w")).alias("of"))
    rows = own.join(base, "s", "left").select("at", F.col("of.a").alias("a"), F.col("of.w").alias("w"))
    sums = _kept(_by_sources(ends, _kept(rows), owed, _SCORES).groupBy("a", "b").agg(F.sum("score").alias("score")))
    node = names.join(sums.where("b = -1").select(F.col("a").alias("at"), "score"), "at").select("node", "score")
    arc = ends.select("u", "v", "a", "b").join(sums, ["a", "b"]).select("u", "v", "score")
    return node, arc.unionByName(shares.groupBy("u", "v").agg(F.sum("share").alias("score")))


def distances_by_joins(pairs: DataFrame, sources: DataFrame) -> DataFrame:
    """``(s, node, d)``: the least distance from each source ``s`` to each node it reaches.

    Every round the nodes that came closer go over their arcs, and one aggregate keeps the least.
    """
    best = front = _kept(sources.select("s", F.col("s").alias("node"), F.lit(0.0).alias("d")))
    while not front.isEmpty():
        step = front.join(pairs.withColumnRenamed("u", "node"), "node").groupBy("s", F.col("v").alias("node")).agg(F.min(F.col("d") + F.col("w")).alias("near"))
        new = _kept(best.join(step, ["s", "node"], "full").select("s", "node", "d", F.least("d", "near").alias("now")))
        # closer by more than rounding: equal paths must not take turns
        closer = F.coalesce(F.col("now") < F.col("d") * (1 - 1e-12), F.lit(True))
        front = new.where(closer).select("s", "node", F.col("now").alias("d"))
        best = new.select("s", "node", F.when(closer, F.col("now")).otherwise(F.col("d")).alias("d"))
    return best


def dependencies_by_joins(pairs: DataFrame, sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(node, score)`` and ``(u, v, score)``: Brandes' dependencies with every table distributed, keyed by source and node."""
    dist = distances_by_joins(pairs, sources)
    tail, head = dist.select("s", F.col("node").alias("u"), F.col("d").alias("du")), dist.select("s", F.col("node").alias("v"), F.col("d").alias("dv"))
    tight = tail.join(pairs, "u").join(head, ["s", "v"]).where(F.abs(F.col("du") + F.col("w") - F.col("dv")) <= 1e-12 * F.greatest(F.lit(1.0), "dv"))
    tight = _kept(tight.select("s", "u", "v"))

    def settled(state: DataFrame, step) -> DataFrame:
        while True:
            new = _kept(step(state).join(state.withColumnRenamed("x", "old"), ["s", "node"], "full"))
            state = new.select("s", "node", "x")
            if new.where("not (x <=> old)").isEmpty():
                return state

    root = sources.select("s", F.col("s").alias("node"), F.lit(1.0).alias("x"))
    count = settled(root, lambda c: tight.join(c.withColumnRenamed("node", "u"), ["s", "u"]).groupBy("s", F.col("v").alias("node")).agg(F.sum("x").alias("x")).unionByName(root))
    share = _kept(tight.join(count.select("s", F.col("node").alias("u"), F.col("x").alias("cu")), ["s", "u"]).join(count.select("s", F.col("node").alias("v"), F.col("x").alias("cv")), ["s", "v"]).select("s", "u", "v", (F.col("cu") / F.col("cv")).alias("share")))
    owed = lambda x: share.join(x.withColumnRenamed("node", "v"), ["s", "v"], "left").withColumn("part", F.col("share") * (1 + F.coalesce("x", F.lit(0.0))))
    last = settled(root.where("false"), lambda x: owed(x).groupBy("s", F.col("u").alias("node")).agg(F.sum("part").alias("x")))
    node = last.where("s <> node").groupBy("node").agg(F.sum("x").alias("score"))
    return node, owed(last).groupBy("u", "v").agg(F.sum("part").alias("score"))


def to_segments(bc: DataFrame, tramos: DataFrame, weight: str = "length") -> DataFrame:
    """Arc betweenness on segments: both directions summed, on the lightest parallel segment (ties: smallest id), 0 on others."""
    pairs = bc.groupBy(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).agg(F.sum("bc").alias("bc"))
    lightest = tramos.groupBy("u", "v").agg(F.min_by("tramo_id", F.struct(weight, "tramo_id")).alias("tramo_id"))
    return tramos.join(lightest.join(pairs, ["u", "v"]).select("tramo_id", "bc"), "tramo_id", "left").withColumn("bc", F.coalesce("bc", F.lit(0.0)))


def closeness(arcs: DataFrame, weight: str) -> DataFrame:
    """Incoming closeness ``(N - 1) / sum of distances towards the node`` within the largest strong component."""
    # read once: the components and the paths follow from the pairs
    lightest = _pairs(arcs, weight)
    strong = _strong(lightest.select("u", "v"))
    giant = strong.groupBy("component").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "component").limit(1)
    inside = _kept(strong.join(F.broadcast(giant.select("component")), "component").select("node"))
    kept = lightest.join(inside.select(F.col("node").alias("u")), "u", "left_semi").join(inside.select(F.col("node").alias("v")), "v", "left_semi")
    # distances towards a node are those from it against the arcs
    pairs = _kept(kept.select(F.col("v").alias("u"), F.col("u").alias("v"), "w"))
    if pairs.count() > TASK_ARCS:
        far = distances_by_joins(pairs, inside.select(F.col("node").alias("s")))
        return far.groupBy(F.col("s").alias("node")).agg(F.when(F.sum("d") > 0, (F.count("*") - 1) / F.sum("d")).alias("closeness"))
    names, ends = _numbered(pairs)
    n = names.count()

    def sums(arrays: list[np.ndarray], rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graph = Paths(n, *arrays)
        for ids, _ in _blocks(rows, n):
            yield pa.record_batch({"at": pa.array(ids, pa.int32()), "total": pa.array(graph.distances(ids).sum(0))})

    found = _by_sources(ends, names.select("at"), sums, "at int, total double")
    return names.join(found, "at").select("node", F.when(F.col("total") > 0, (n - 1) / F.col("total")).alias("closeness"))


def _kept(df: DataFrame) -> DataFrame:
    return stored(df, "graph")


def weak_components(arcs: DataFrame) -> DataFrame:
    """``(node, component)``: the smallest node reachable over arcs in either direction.

    Each round takes the least label of the neighbours and then the label's own label, so rounds grow
    with the logarithm of the diameter, not with it.
    """
    edges = _kept(arcs.select("u", "v").union(arcs.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    labels = _kept(edges.groupBy(F.col("u").alias("node")).agg(F.least(F.first("u"), F.min("v")).alias("component")))
    while True:
        near = edges.join(labels.select(F.col("node").alias("v"), "component"), "v").groupBy(F.col("u").alias("node")).agg(F.min("component").alias("near"))
        step = labels.join(near, "node").select("node", "component", F.least("component", "near").alias("next"))
        far = labels.select(F.col("node").alias("next"), F.col("component").alias("far"))
        new = _kept(step.join(far, "next", "left").select("node", F.col("component").alias("old"), F.least("next", F.coalesce("far", "next")).alias("component")))
        moved = new.where("old <> component").limit(1).count()
        labels = new.select("node", "component")
        if not moved:
            return labels


def strong_components(arcs: DataFrame) -> DataFrame:
    """``(node, component)``: nodes that reach each other; the component is its smallest node.

    The graph first shrinks in rounds that do not depend on its diameter: places joined by two-way arcs become one
    (in streets, most), a node that only one other leads to joins that one (``_hung``), and nodes that nothing
    leads to, or that lead nowhere, leave. Every round turns the arcs round, so that the same holds for what follows. The core that no longer
    shrinks by a quarter in two rounds is coloured (``_coloured``), and its components go back over the rounds.
    """
    both = _kept(arcs.select("u", "v").distinct())
    loops = both.where("u = v").select(F.col("u").alias("node"))
    return _strong(both.where("u <> v"), loops)


def _strong(left: DataFrame, more: DataFrame | None = None) -> DataFrame:
    """``strong_components`` of distinct arcs without loops, as stored, and of ``more`` nodes."""
    nodes = left.select(F.col("u").alias("node")).union(left.select("v"))
    nodes = _kept((nodes if more is None else nodes.union(more)).distinct())
    undo, sizes = [], [left.count()]
    while sizes[-1] and (len(sizes) < 3 or sizes[-1] < 0.75 * sizes[-3]):
        # nodes that nothing leads to, or that lead nowhere, are components of their own
        left = _kept(left.join(left.select(F.col("v").alias("u")).distinct(), "u", "left_semi").join(left.select(F.col("u").alias("v")).distinct(), "v", "left_semi"))
        twice = _kept(left.join(left.select(F.col("v").alias("u"), F.col("u").alias("v")), ["u", "v"], "left_semi").where("u < v"))
        if not twice.isEmpty():
            roots = weak_components(twice).withColumnRenamed("component", "root")
            undo.append(lambda found, roots=roots: _with_roots(found, roots))
            left = _kept(_moved(_moved(left, roots, "u"), roots, "v").where("u <> v").distinct())
        left, back = _hung(left)
        if back:
            undo.append(back)
        left = left.select(F.col("v").alias("u"), F.col("u").alias("v"))
        sizes.append(left.count())
    # (node, root) of all nodes that are not their own root
    found = _coloured(left).withColumnRenamed("component", "root").where("node <> root") if sizes[-1] else nodes.select("node", F.col("node").alias("root")).where("false")
    for back in reversed(undo):
        found = _kept(back(found))
    every = _kept(nodes.join(found, "node", "left").select("node", F.coalesce("root", "node").alias("root")))
    least = every.groupBy("root").agg(F.min("node").alias("component"))
    return every.join(least, "root").select("node", "component")


def _moved(arcs: DataFrame, roots: DataFrame, end: str) -> DataFrame:
    """``arcs`` with one end replaced by its root, if it has one."""
    moved = arcs.join(roots.select(F.col("node").alias(end), "root"), end, "left")
    return moved.withColumn(end, F.coalesce("root", end)).select("u", "v")


def _with_roots(found: DataFrame, roots: DataFrame) -> DataFrame:
    """``found`` and the nodes of ``roots``, which share what their root has found."""
    through = roots.join(found.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    # a root is among the nodes of both, with the same result
    return through.unionByName(found).distinct().where("node <> root")


def _hung(left: DataFrame):
    """The arcs after each node that only one node leads to has joined that one, and what undoes it (None if none has).

    Such nodes hang in trees, whose roots pointer jumping finds; a ring of them has its smallest node as its root.
    All other arcs then lead to roots. A node is strongly connected with its root if it, or a node that hangs below
    it, has an arc to a root of the same component; else it is a component of its own.
    """
    hanging = _kept(left.groupBy("v").agg(F.count("*").alias("n"), F.min("u").alias("up")).where("n = 1").select(F.col("v").alias("node"), "up"))
    n = hanging.count()
    if not n:
        return left, None
    # ``low``: the smallest of the nodes passed; ``open``: the way up has not come to an end
    jumps = [_kept(hanging.join(hanging.select(F.col("node").alias("up"), F.lit(True).alias("open")), "up", "left").select("node", "up", F.least("node", "up").alias("low"), F.coalesce("open", F.lit(False)).alias("open")))]
    while 2 ** (len(jumps) - 1) < n and not jumps[-1].where("open").isEmpty():
        last = jumps[-1]
        far = last.select(F.col("node").alias("up"), F.col("up").alias("far"), F.col("low").alias("below"), F.col("open").alias("on"))
        step = last.join(far, "up", "left").select("node", F.coalesce("far", "up").alias("up"), F.least("low", F.coalesce("below", "low")).alias("low"), (F.col("open") & F.coalesce("on", F.lit(False))).alias("open"))
        jumps.append(_kept(step))
    last = jumps[-1]
    # who is still under way has passed a whole ring, and stands on it
    ring = last.select(F.col("node").alias("up"), F.col("low").alias("least"))
    roots = _kept(last.join(ring, "up", "left").select("node", F.when(F.col("open"), F.col("least")).otherwise(F.col("up")).alias("root")))
    hung = roots.where("node <> root")
    exits = _kept(left.join(hung.select(F.col("node").alias("v")), "v", "left_anti").select("u", "v"))

    def back(found: DataFrame) -> DataFrame:
        top = found.select(F.col("node").alias("r"), F.col("root").alias("top"))
        named = lambda df, c, name: df.join(top.withColumnRenamed("r", c), c, "left").withColumn(name, F.coalesce("top", c)).drop("top")
        own = exits.join(hung.select(F.col("node").alias("u"), "root"), "u")
        marked = _kept(named(named(own, "root", "a"), "v", "b").where("a = b").select(F.col("u").alias("node")).distinct())
        for jump in jumps:
            marked = _kept(marked.unionByName(jump.join(marked, "node").select(F.col("up").alias("node"))).distinct())
        joined = named(hung.join(marked, "node", "left_semi"), "root", "a").select("node", F.col("a").alias("root"))
        return joined.unionByName(found)

    return _kept(_moved(exits, hung, "u").where("u <> v").distinct()), back


def _coloured(left: DataFrame) -> DataFrame:
    """``(node, component)`` by forward colouring and backward sweep.

    Every node takes the smallest node that reaches it, and the part of a colour that reaches back to its root is a
    component. It leaves, and the rest goes on.
    """
    done = None
    nodes = _kept(left.select(F.col("u").alias("node")).union(left.select("v")).distinct())
    while True:
        colour = _spread(nodes.select("node", F.col("node").alias("c")), left)
        same = _kept(left.join(colour.select(F.col("node").alias("u"), F.col("c").alias("cu")), "u").join(colour.select(F.col("node").alias("v"), F.col("c").alias("cv")), "v").where("cu = cv").select("u", "v"))
        back = _reach(colour.where("node = c").select("node", "c"), same)
        found = _kept(back.select("node", F.col("c").alias("component")))
        done = found if done is None else done.unionByName(found)
        nodes = _kept(nodes.join(found.select("node"), "node", "left_anti"))
        if nodes.isEmpty():
            return done
        left = _kept(left.join(nodes.select(F.col("node").alias("u")), "u", "left_semi").join(nodes.select(F.col("node").alias("v")), "v", "left_semi"))


def _spread(labels: DataFrame, arcs: DataFrame) -> DataFrame:
    """The least label that reaches each node along the arcs."""
    while True:
        arriving = arcs.join(labels.select(F.col("node").alias("u"), "c"), "u").groupBy(F.col("v").alias("node")).agg(F.min("c").alias("n"))
        new = _kept(labels.join(arriving, "node", "left").select("node", F.col("c").alias("old"), F.least("c", F.coalesce("n", "c")).alias("c")))
        moved = new.where("old <> c").limit(1).count()
        labels = new.select("node", "c")
        if not moved:
            return labels


def _reach(roots: DataFrame, arcs: DataFrame) -> DataFrame:
    """Nodes that reach a root against the arcs, with the root's colour."""
    seen = front = _kept(roots)
    while True:
        step = arcs.join(front.select(F.col("node").alias("v"), "c"), "v").select(F.col("u").alias("node"), "c").distinct()
        front = _kept(step.join(seen.select("node"), "node", "left_anti"))
        if front.isEmpty():
            return seen
        seen = _kept(seen.unionByName(front))


def degrees(arcs: DataFrame) -> DataFrame:
    """``(node, n_in, n_out)``."""
    both = arcs.select(F.col("u").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o")).union(arcs.select("v", F.lit(1), F.lit(0)))
    return both.groupBy("node").agg(F.sum("i").cast("long").alias("n_in"), F.sum("o").cast("long").alias("n_out"))


def intersections(nodes: DataFrame) -> DataFrame:
    """One row for each node, with its id as text, its place and the number of streets that meet there."""
    return nodes.select(F.col("node_id").cast("string").alias("node_id"), "x", "y", "street_count")


def street_counts(arcs: DataFrame) -> DataFrame:
    """``(node, street_count)``: the streets that end at each node, a street of two directions once."""
    streets = segments(arcs)
    return streets.select(F.explode(F.array("u", "v")).alias("node")).groupBy("node").agg(F.count("*").alias("street_count"))


def degree_shares(nodes: DataFrame, n_arcs: Column | int) -> DataFrame:
    """Mean out-degree, mean streets at a node and percent of dead ends, three-way and larger crossings; a missing count raises."""
    count = F.coalesce("street_count", F.raise_error(F.lit("nodes without street_count")).cast("long"))
    pct = lambda c: F.round(100 * F.avg(c.cast("double")), 6)
    out = nodes.select(count.alias("c"))
    n = n_arcs if isinstance(n_arcs, Column) else F.lit(n_arcs)
    return out.agg(
        F.round(F.first(n) / F.count("*"), 6).alias("grado_medio_salida"), F.round(F.avg("c"), 6).alias("calles_por_nodo"),
        pct(F.col("c") == 1).alias("pct_nodos_callejon"), pct(F.col("c") == 3).alias("pct_nodos_3_calles"), pct(F.col("c") >= 4).alias("pct_nodos_4_o_mas"),
    )


def street_density(nodes: DataFrame, tramos: DataFrame, area_km2: float) -> DataFrame:
    """Crossings (two streets or more), kilometres of street for each square kilometre, and the mean segment length."""
    crossings = nodes.agg(F.count(F.when(F.col("street_count") > 1, 1)).alias("crossings"))
    sums = tramos.agg(F.sum("length").alias("length"), F.avg("length").alias("mean"))
    both = crossings.withColumn("length", sums.select("length").scalar()).withColumn("mean", sums.select("mean").scalar())
    return both.select(F.round(F.col("crossings") / area_km2, 6).alias("intersecciones_por_km2"), F.round(F.col("length") / 1000 / area_km2, 6).alias("km_calle_por_km2"), F.round("mean", 6).alias("largo_medio_tramo_m"))


def with_degree(cells: DataFrame, edges: DataFrame, key: str = "id") -> DataFrame:
    """``cells`` with the number of their edges (``src``, ``dst``); a cell without any has 0, which is data."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias(key)).groupBy(key).agg(F.count("*").alias("grado"))
    return cells.join(ends, key, "left").withColumn("grado", F.coalesce("grado", F.lit(0)))


def density(arcs: DataFrame) -> DataFrame:
    """Arcs, nodes, mean degree and directed density times 10,000, one row."""
    d = degrees(arcs)
    out = d.agg(F.count("*").alias("nodes"), F.sum("n_out").alias("arcs"))
    return out.select("nodes", "arcs", F.round(F.col("arcs") / F.col("nodes"), 6).alias("mean_degree"), F.round(F.col("arcs") * 10000 / (F.col("nodes") * (F.col("nodes") - 1)), 6).alias("density_x1e4"))


def clustering(arcs: DataFrame) -> DataFrame:
    """Mean clustering of the simple undirected graph; nodes of degree under 2 count 0.

    Every triangle is found once, from its node of least (degree, id): edges point from lower to higher, so
    a hub's neighbours are not paired at the hub. An edge can close a triangle if its lower end is the higher one of another:
    up to ``TASK_ARCS`` such edges travel to the tasks, which look up the pairs of neighbours of their nodes; beyond, joins do.
    """
    edges = _kept(undirected(arcs))
    both = edges.union(edges.select("v", "u")).toDF("node", "other")
    degree = _names(both.groupBy("node").agg(F.count("*").alias("d")))
    ends = edges.join(degree.toDF("a", "u", "da"), "u").join(degree.toDF("b", "v", "db"), "v")
    low, a, b = F.struct("da", "u") < F.struct("db", "v"), F.col("a"), F.col("b")
    directed = _kept(ends.select(F.when(low, a).otherwise(b).alias("a"), F.when(low, b).otherwise(a).alias("b")))
    closing = _kept(directed.join(directed.select(F.col("b").alias("a")).distinct(), "a", "left_semi"))
    if closing.count() > TASK_ARCS:
        wedges = directed.toDF("a", "b").join(directed.toDF("a", "c"), "a").where("b < c")
        closed = wedges.join(closing.select(F.least("a", "b").alias("b"), F.greatest("a", "b").alias("c")), ["b", "c"])
        tri = closed.select(F.explode(F.array("a", "b", "c")).alias("at")).groupBy("at").agg(F.count("*").alias("t"))
    else:
        near = _kept(directed.groupBy("a").agg(F.collect_list("b").alias("of")).where(F.size("of") > 1).select(F.col("a").alias("at"), F.col("of").alias("a")))
        tri = _by_sources(closing.withColumn("w", F.lit(0.0)), near, _triangles, "at int, t long").groupBy("at").agg(F.sum("t").alias("t"))
    each = degree.join(tri, "at", "left").select(F.when(F.col("d") > 1, 2 * F.coalesce("t", F.lit(0)) / (F.col("d") * (F.col("d") - 1))).otherwise(0.0).alias("c"))
    return each.agg(F.count("*").alias("nodes"), F.round(F.avg("c"), 6).alias("clustering"))


def _triangles(arrays: list[np.ndarray], rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(at, t)``: triangles of each node, from nodes with their neighbours (``a``) and the edges that close them."""
    key = lambda b, c: np.minimum(b, c).astype(np.int64) << 32 | np.maximum(b, c)
    edges = np.sort(key(arrays[0], arrays[1]))
    bits = max(10, min(26, int(len(edges) * 8).bit_length()))
    mixed = lambda k: ((k * 0x1E3779B97F4A7C15) & 0x7FFFFFFFFFFFFFFF) >> (63 - bits)
    seen = np.zeros(1 << bits, bool)
    with np.errstate(over="ignore"):
        seen[mixed(edges)] = True
        found = np.zeros(0, np.int64)
        for batch in rows:
            at, of = batch.column("at").to_numpy(), batch.column("a")
            size, values = of.value_lengths().to_numpy(zero_copy_only=False), of.flatten().to_numpy()
            first = np.cumsum(size) - size
            for k in np.unique(size):
                own = np.flatnonzero(size == k)
                step = max(1, BLOCK_CELLS // (int(k) * int(k)))
                wide = max(1, BLOCK_CELLS // (2 * int(k) * min(step, len(own))))  # left neighbours of a pair at a time
                for r in range(0, len(own), step):
                    lists = values[first[own[r : r + step]][:, None] + np.arange(k)]
                    for i in range(0, int(k) - 1, wide):
                        p, q = np.nonzero(np.arange(i, min(i + wide, k))[:, None] < np.arange(k))
                        b, c = lists[:, p + i], lists[:, q]
                        pair = key(b, c)
                        row, col = np.nonzero(seen[mixed(pair)])
                        maybe = pair[row, col]
                        hit = edges[np.minimum(np.searchsorted(edges, maybe), len(edges) - 1)] == maybe
                        row, col = row[hit], col[hit]
                        nodes = np.concatenate([at[own[r + row]], b[row, col], c[row, col]])
                        if len(nodes):
                            more = np.bincount(nodes, minlength=len(found))
                            more[: len(found)] += found
                            found = more
    on = np.flatnonzero(found)
    whole = pa.record_batch({"at": pa.array(on, pa.int32()), "t": pa.array(found[on])})
    yield from (whole.slice(k, ROW_ARCS) for k in range(0, len(on), ROW_ARCS))


def with_ends(lines: DataFrame, nodes: DataFrame) -> DataFrame:
    """``lines`` (u, v) with ``dx, dy`` from the coordinates of both ends, loops left out."""
    a = nodes.select(F.col("node_id").alias("u"), F.col("x").alias("ax"), F.col("y").alias("ay"))
    b = nodes.select(F.col("node_id").alias("v"), F.col("x").alias("bx"), F.col("y").alias("by"))
    return lines.where("u <> v").join(a, "u").join(b, "v").withColumn("dx", F.col("bx") - F.col("ax")).withColumn("dy", F.col("by") - F.col("ay"))


def bearing(dx: str = "dx", dy: str = "dy"):
    """Degrees clockwise from north, in [0, 360)."""
    return F.pmod(F.degrees(F.atan2(F.col(dx), F.col(dy))), F.lit(360.0))


def orientation_histogram(lines: DataFrame, weight: str, bins: int = 36) -> DataFrame:
    """Weight of each bearing bin, both directions counted, bins centred on north; empty bins are 0."""
    width = 360 / bins
    b = lines.withColumn("b", bearing()).select(F.explode(F.array(F.col("b"), F.pmod(F.col("b") + 180, F.lit(360.0)))).alias("b"), weight)
    sums = b.groupBy(F.floor(F.pmod(F.col("b") + width / 2, F.lit(360.0)) / width).cast("int").alias("bin")).agg(F.sum(weight).alias("mass"))
    every = lines.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(sums, "bin", "left").select("bin", F.coalesce("mass", F.lit(0.0)).alias("mass"))


def orientation_order(histogram: DataFrame, bins: int = 36) -> DataFrame:
    """Shannon entropy in nats and order phi: 1 for a grid, 0 for even bearings."""
    total = histogram.agg(F.sum("mass")).scalar()
    p = histogram.withColumn("total__", total).withColumn("p", F.col("mass") / F.col("total__"))
    h = p.agg((-F.sum(F.when(F.col("p") > 0, F.col("p") * F.log("p")))).alias("h"))
    low, high = F.log(F.lit(4.0)), F.log(F.lit(float(bins)))
    return h.select(F.round("h", 6).alias("entropy"), F.round(1 - F.pow((F.col("h") - low) / (high - low), F.lit(2.0)), 6).alias("phi"))


def circuity(lines: DataFrame, length: str) -> DataFrame:
    """Street length over straight distance, loops left out (``lines`` from ``with_ends``)."""
    return lines.agg(F.round(F.sum(length) / F.sum(F.hypot("dx", "dy")), 6).alias("circuity"))

"""Near-duplicate vectors by E8 lattice hashing.

Vectors are scaled to length 1, projected at random to ``8 * blocks`` dimensions in each of
several tables, and every block of eight is decoded to the nearest point of the lattice E8. A
vector stands in the cell of its own point and in those of its nearest neighbouring points (``MEETS``),
so pairs cut apart by a cell wall still meet. Within a cell all vectors are compared;
only a spanning forest of the links leaves the task, never all pairs. Cells with more than ``BLOCK``
rows are dealt out as pairs of blocks. Components of the links follow, and then every vector's links
are counted exactly, in double precision, against its whole component, again in pairs of blocks: a
link never leaves a component, so all links inside one are found, whether or not cells met.

One block suits up to about ``ROWS_PER_BLOCK`` different vectors; more vectors take more blocks, so
that cells do not grow with the table, and more cells and tables, so that a pair at cosine 0.9 is missed
about once in a thousand whatever the blocks (``MEETS``, ``MISS``). Cells take 18, 144, 576 or 2,736 keys
of a vector with one to four blocks; a pair above 0.9 meets more often.

Equal vectors are one class, compared once. Edge cases: vectors that are null, empty, zero or hold
null or non-finite components link with nothing (0 links, themselves as component); vectors of
different lengths are never linked; a row with a null ``vec_id`` has no component and is kept;
rows that repeat a ``vec_id`` count as vectors of their own; an empty table gives no rows; extra columns
are ignored.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import connected_components, dealt, forest, mixed, runs, sliced, stored

THRESHOLD = 0.9
SCALE, SEED = 0.2, 11
#: By blocks: neighbouring points of a block, cells of a table, and how often a pair at cosine 0.9 meets in one table (measured over random pairs).
MEETS = {1: (5, 6, 0.90), 2: (8, 36, 0.88), 3: (8, 72, 0.58), 4: (8, 144, 0.31)}
#: Pairs at the threshold that no table may find.
MISS = 0.001
BLOCK, ROWS_PER_BLOCK = 2048, 1 << 18
#: Twice the largest error of a half-precision component of a unit vector, rounded up: a bound on the error of a cosine.
HALF_ERROR = 0.0015


def _roots() -> np.ndarray:
    """The 240 shortest vectors of E8: two entries of 1 or -1, or eight of a half with evenly many minus signs."""
    out = []
    for i, j in itertools.combinations(range(8), 2):
        for a, b in itertools.product((1, -1), repeat=2):
            v = [0.0] * 8
            v[i], v[j] = a, b
            out.append(v)
    out += [list(x) for x in itertools.product((0.5, -0.5), repeat=8) if sum(y < 0 for y in x) % 2 == 0]
    return np.array(out)


ROOTS = _roots()


def _d8(x: np.ndarray) -> np.ndarray:
    """Nearest points with whole coordinates of even sum."""
    r = np.rint(x)
    e = x - r
    odd = np.flatnonzero(r.sum(1).astype(np.int64) & 1)
    k = np.abs(e[odd]).argmax(1)
    r[odd, k] += np.where(e[odd, k] >= 0, 1, -1)
    return r


def nearest(x: np.ndarray) -> np.ndarray:
    """The nearest E8 point of each row: whole coordinates, or all shifted by a half."""
    a, b = _d8(x), _d8(x - 0.5) + 0.5
    return np.where((((x - a) ** 2).sum(1) <= ((x - b) ** 2).sum(1))[:, None], a, b)


def _cells(x: np.ndarray, probes: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys and squared distances of each row's own point and its ``probes`` nearest neighbours."""
    v = nearest(x)
    e = x - v
    g = e @ ROOTS.T
    best = np.argpartition(-g, probes, axis=1)[:, :probes]
    points = np.concatenate([v[:, None, :], v[:, None, :] + ROOTS[best]], axis=1)
    far = ((x[:, None, :] - points) ** 2).sum(2)
    weights = mixed(np.arange(1, 9, dtype=np.uint64))
    keys = ((2 * points).astype(np.int64).view(np.uint64) * weights).sum(2, dtype=np.uint64)
    return keys, far


def blocks_and_tables(rows: int, miss: float = MISS) -> tuple[int, int]:
    """Blocks of eight dimensions for so many vectors, and tables that leave ``miss`` of the pairs at the threshold."""
    blocks = 1
    while blocks < max(MEETS) and rows > ROWS_PER_BLOCK * 100 ** (blocks - 1):
        blocks += 1
    return blocks, max(1, math.ceil(round(math.log(miss) / math.log(1 - MEETS[blocks][2]), 6)))


def cell_keys(x: np.ndarray, blocks: int, tables: int, scale: float = SCALE, seed: int = SEED) -> np.ndarray:
    """``(rows, tables * cells)`` cell keys of unit vectors."""
    out, dim = [], x.shape[1]
    probes, cells, _ = MEETS[blocks]
    for t in range(tables):
        rng = np.random.default_rng((seed, t, dim))
        axes = rng.normal(size=(dim, 8 * blocks))
        if dim >= 8 * blocks:
            axes = np.linalg.qr(axes)[0]
        else:
            axes /= np.sqrt(dim)
        y = x @ axes / scale * math.sqrt(dim / 64)
        keys, far = _cells(y[:, :8], probes)
        keys = mixed(keys + np.uint64(t * 1000 + 1))
        for b in range(1, blocks):
            more, farther = _cells(y[:, 8 * b : 8 * b + 8], probes)
            keys = mixed(keys[:, :, None] + mixed(more)[:, None, :] + np.uint64(b)).reshape(len(x), -1)
            far = (far[:, :, None] + farther[:, None, :]).reshape(len(x), -1)
            # the nearest combinations of points go on
            if far.shape[1] > cells:
                keep = np.argpartition(far, cells - 1, axis=1)[:, :cells]
                keys, far = np.take_along_axis(keys, keep, 1), np.take_along_axis(far, keep, 1)
        out.append(keys + np.uint64(dim))
    return np.concatenate(out, axis=1)


def _classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row's class (a hash of the vector, null if it cannot be linked) and the vector as bytes."""
    for batch in sliced(batches, 4096):
        nodes, raws = [], []
        for x in batch.column("embedding").to_pylist():
            node = raw = None
            if x and None not in x:
                v = np.array(x, np.float64)
                if np.isfinite(v).all() and v.any():
                    raw = v.tobytes()
                    node = xxhash.xxh3_64_intdigest(raw) - (1 << 63)
            nodes.append(node)
            raws.append(raw)
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(nodes, pa.int64()), pa.array(raws, pa.binary())], names=["vec_id", "node", "vector"])


def _unit(raws: list[bytes]) -> np.ndarray:
    x = np.stack([np.frombuffer(r, np.float64) for r in raws])
    x = x / np.abs(x).max(1, keepdims=True)  # so that no square under- or overflows
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _hash(blocks: int, tables: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, max(16, 4096 // tables)):
            raws, nodes = batch.column("vector").to_pylist(), np.array(batch.column("node").to_pylist(), np.int64)
            sizes = np.array([len(r) for r in raws])
            for size in np.unique(sizes):
                at = np.flatnonzero(sizes == size)
                x = _unit([raws[i] for i in at])
                keys = cell_keys(x, blocks, tables)
                half = x.astype(np.float16)
                owner = np.repeat(np.arange(len(at)), keys.shape[1])
                packed = [half[i].tobytes() for i in range(len(at))]
                yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1).view(np.int64)), pa.array(nodes[at][owner]), pa.array(packed, pa.binary()).take(pa.array(owner))], names=["cell", "node", "half"])

    return run


def _links(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches, ["cell", "low", "high"]):
            if t.num_rows < 2:
                continue
            nodes, block = t["node"].to_numpy(), t["block"].to_numpy()
            x = np.frombuffer(b"".join(t["half"].to_pylist()), np.float16).reshape(len(nodes), -1).astype(np.float32)
            low, high = t["low"][0].as_py(), t["high"][0].as_py()
            p, q = np.flatnonzero(block == low), np.flatnonzero(block == high)
            cos = x[p] @ x[q].T
            near = cos >= threshold - HALF_ERROR
            near &= nodes[p][:, None] != nodes[q][None, :]
            if not near.any():
                continue
            a, b = forest(nodes[p], nodes[q], near & (cos >= threshold + HALF_ERROR))
            root = dict(zip(a.tolist(), b.tolist(), strict=True))
            i, j = np.nonzero(near & (cos < threshold + HALF_ERROR))
            open_ = {(min(u, v), max(u, v)) for u, v in zip(nodes[p][i].tolist(), nodes[q][j].tolist(), strict=True) if root.get(u, u) != root.get(v, v)}
            rows = [(u, v, True) for u, v in root.items() if u != v] + [(u, v, False) for u, v in sorted(open_)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.bool_())], names=["a", "b", "sure"])

    return run


def _verified(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 4096):
            x, y = _unit(batch.column("va").to_pylist()), _unit(batch.column("vb").to_pylist())
            yield batch.select(["a", "b"]).filter(pa.array((x * y).sum(1) >= threshold))

    return run


def _counts(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches, ["component", "low", "high"]):
            nodes, block, copies = t["node"].to_numpy(), t["block"].to_numpy(), t["copies"].to_numpy()
            raws = t["vector"].to_pylist()
            x = _unit(raws)
            low, high = t["low"][0].as_py(), t["high"][0].as_py()
            p, q = np.flatnonzero(block == low), np.flatnonzero(block == high)
            near = (x[p] @ x[q].T >= threshold) & (nodes[p][:, None] != nodes[q][None, :])
            found = [(nodes[p], near @ copies[q])]
            if low != high:
                found.append((nodes[q], copies[p] @ near))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([f[0] for f in found])), pa.array(np.concatenate([f[1] for f in found]).astype(np.int64))], names=["node", "linked"])

    return run


def linked(vectors: DataFrame, threshold: float = THRESHOLD, miss: float = MISS, block: int = BLOCK) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)``, one row for each row of ``vectors`` (``vec_id``, ``embedding``)."""
    base = stored(vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).mapInArrow(_classes, "vec_id long, node long, vector binary"), "vectors")
    usable = base.where("node is not null and vec_id is not null")
    classes = stored(usable.groupBy("node").agg(F.count("*").alias("copies"), F.min("vec_id").alias("vec_id"), F.first("vector").alias("vector")), "vector-classes")
    blocks, tables = blocks_and_tables(classes.count(), miss)
    cells = classes.select("node", "vector").mapInArrow(_hash(blocks, tables), "cell long, node long, half binary")
    met = dealt(cells, "cell", block).mapInArrow(_links(threshold), "a long, b long, sure boolean")
    met = stored(met.distinct(), "met")
    vector = classes.select("node", "vector")
    doubtful = met.where("not sure").join(vector.select(F.col("node").alias("a"), F.col("vector").alias("va")), "a").join(vector.select(F.col("node").alias("b"), F.col("vector").alias("vb")), "b")
    links = met.where("sure").select("a", "b").unionByName(doubtful.mapInArrow(_verified(threshold), "a long, b long"))
    labels = stored(connected_components(stored(links, "vector-links"), "vector-edges"), "vector-labels")
    rows = classes.join(labels.withColumnRenamed("component", "root"), "node").select(F.col("root").alias("component"), "node", "copies", "vector")
    counts = dealt(rows, "component", block).mapInArrow(_counts(threshold), "node long, linked long").groupBy("node").agg(F.sum("linked").alias("linked"))
    groups = classes.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    smallest = groups.groupBy("component").agg(F.min("vec_id").alias("component_id"))
    of_node = groups.join(smallest, "component").join(counts, "node", "left").select("node", "component_id", (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    own = F.when(F.col("vec_id").isNotNull(), F.coalesce("component_id", "vec_id"))
    out = base.select("vec_id", F.when(F.col("vec_id").isNotNull(), F.col("node")).alias("node")).join(of_node, "node", "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), own.alias("component_id"), F.coalesce(F.col("vec_id") == own, F.lit(True)).alias("kept"))

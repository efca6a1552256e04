"""Clustering by centroids over whole numbers, with a table of distances to fixed pivots (LAESA).

Vectors become whole numbers once and are written with their distances to ``PIVOTS`` fixed pivots. In a round the
centroids' distances to the same pivots are known, so by the triangle inequality the largest difference of the
two, over the pivots, bounds the distance of a vector from a centroid from below. The centroid of the smallest
bound gets its exact distance first; only centroids whose bound does not exceed it are measured too. Distances
are exact whole numbers; the bounds carry a margin for the roots, so that no nearest centroid and no tie is lost.

A task keeps sums and counts of its vectors by centroid and emits these alone, which Spark adds up: a round
shuffles ``k`` times the components of numbers a task and no vectors, however uneven the clusters are. The driver
holds the ``k`` centroids.

Edge cases: vectors that are null, of another length or with null or non-finite components are left out; equal
vectors go to one cluster; repeated rows count as often as they stand; fewer vectors than ``k`` give as many
centroids; null ids never start a centroid but are assigned like others; columns beyond id and vector are not
read; an empty table gives no rows. Components from 2**17 up in size would not fit the whole numbers and raise.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.sources.shared import stored

#: Fixed pivots, the vectors they are chosen from, rows measured at a time, and the largest whole component.
PIVOTS, CHOICE, ROWS, LARGEST = 12, 256, 4096, 1 << 27
#: Relative margin of the bounds: roots of whole numbers under 2**62 are good to far less.
MARGIN = 1e-9


def whole(batch: pa.RecordBatch, dims: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a batch whose ``vec`` is usable, and their components as ``floor(scale * x)``."""
    column = batch.column("vec")
    sizes = np.nan_to_num(np.array(column.value_lengths(), dtype=float), nan=-1.0)
    rows = np.flatnonzero(sizes == dims)
    flat = column.take(pa.array(rows)).flatten()
    x = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)  # null components become NaN
    good = np.isfinite(x).all(axis=1)
    x = np.floor(x[good] * scale)
    if x.size and np.abs(x).max() >= LARGEST:
        raise ValueError(f"a component of {np.abs(x).max() / scale} does not fit whole numbers of scale {scale}")
    return rows[good], x.astype(np.int64)


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of each row of ``a`` from the row of ``b`` beside it."""
    d = a - b
    return np.einsum("ij,ij->i", d, d)


def to_pivots(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.stack([squares(vectors, p[None, :]) for p in pivots], axis=1).astype(np.float64))


def chosen_pivots(candidates: np.ndarray, n: int) -> np.ndarray:
    """Up to ``n`` different rows, each the one farthest from those before it."""
    taken = [0]
    near = squares(candidates, candidates[:1])
    while len(taken) < n and near.max() > 0:
        taken.append(int(near.argmax()))
        near = np.minimum(near, squares(candidates, candidates[taken[-1]][None, :]))
    return candidates[taken]


def nearest(vectors: np.ndarray, table: np.ndarray, centroids: np.ndarray, of_pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Nearest centroid of each vector (ties: the smaller number), its squared distance, and how many distances were measured."""
    bound = np.zeros((len(vectors), len(centroids)))
    for p in range(table.shape[1]):
        np.maximum(bound, np.abs(table[:, p, None] - of_pivots[None, :, p]), out=bound)
    scale = np.maximum(table.max(axis=1)[:, None], of_pivots.max(axis=1)[None, :])
    bound = np.maximum(bound - MARGIN * (scale + 1), 0.0) ** 2 * (1 - MARGIN)
    first = bound.argmin(axis=1)
    best = squares(vectors, centroids[first])
    open_ = bound <= best[:, None]
    open_[np.arange(len(vectors)), first] = False
    found, measured = first, len(vectors)
    for c in range(len(centroids)):
        rows = np.flatnonzero(open_[:, c] & (bound[:, c] <= best))
        if len(rows):
            d = squares(vectors[rows], centroids[c][None, :])
            measured += len(rows)
            closer = (d < best[rows]) | ((d == best[rows]) & (c < found[rows]))
            best[rows[closer]], found[rows[closer]] = d[closer], c
    return found, best, measured


def _arrays(batch: pa.RecordBatch, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors and their pivot distances, as they are stored."""
    v = np.frombuffer(b"".join(batch.column("v").to_pylist()), "<i4").reshape(-1, dims).astype(np.int64)
    t = np.frombuffer(b"".join(batch.column("t").to_pylist()), "<f8").reshape(len(v), -1)
    return v, t


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, batch.num_rows, ROWS):
            yield batch.slice(k, ROWS)


def _rows(data: np.ndarray) -> list[bytes]:
    return [r.tobytes() for r in data]


class Clustering:
    """``k`` centroids over the column ``vec`` of ``vectors`` (``vec_id``, ``vec``)."""

    def __init__(self, vectors: DataFrame, k: int, dims: int, scale: int, order: Column):
        """``order`` ranks the vectors that start the centroids; equal ranks follow the components."""
        self.dims = dims

        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in _cut(batches):
                rows, x = whole(batch, dims, scale)
                yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(pa.array(rows)), pa.array(_rows(x.astype("<i4")), pa.binary())], names=["vec_id", "v"])

        usable = vectors.select("vec_id", "vec").mapInArrow(read, "vec_id long, v binary")
        first = usable.where("vec_id is not null").orderBy(order, "v").limit(max(CHOICE, k)).select("v").toArrow().column("v").to_pylist()
        sample = np.frombuffer(b"".join(first), "<i4").reshape(-1, dims).astype(np.int64)
        self.centroids = sample[:k].copy()
        self.pivots = pivots = chosen_pivots(sample[:CHOICE], PIVOTS) if len(sample) else sample

        def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in _cut(batches):
                v = np.frombuffer(b"".join(batch.column("v").to_pylist()), "<i4").reshape(-1, dims).astype(np.int64)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(_rows(to_pivots(v, pivots)), pa.binary())], names=["vec_id", "v", "t"])

        if len(sample):
            self.table = stored(usable.mapInArrow(measure, "vec_id long, v binary, t binary"), "pivot-table")
        else:
            self.table = usable.withColumn("t", F.lit(None).cast("binary"))

    def round(self) -> bool:
        """Assign every vector and move the centroids to the floor of their means; false if none moved."""
        if not len(self.centroids):
            return False
        centroids, pivots, dims = self.centroids, self.pivots, self.dims

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, count = np.zeros(centroids.shape, np.int64), np.zeros(len(centroids), np.int64)
            of_pivots = to_pivots(centroids, pivots)
            for batch in _cut(batches):
                v, t = _arrays(batch, dims)
                found = nearest(v, t, centroids, of_pivots)[0]
                np.add.at(total, found, v)
                count += np.bincount(found, minlength=len(centroids))
            # place 0 of a centroid is its count, the others are the sums of its components
            flat = np.c_[count, total]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(flat)), dims + 1), pa.int32()), pa.array(np.tile(np.arange(dims + 1), len(flat)), pa.int32()), pa.array(flat.ravel(), pa.int64())], names=["cluster", "place", "sum"])

        parts = self.table.select("v", "t").mapInArrow(sums, "cluster int, place int, sum long")
        found = np.zeros((len(centroids), dims + 1), object)
        for row in parts.groupBy("cluster", "place").agg(F.sum(F.col("sum").cast("decimal(38,0)")).alias("sum")).collect():
            found[row["cluster"], row["place"]] = int(row["sum"])
        moved = centroids.copy()
        for n in np.flatnonzero(found[:, 0]):
            moved[n] = found[n, 1:] // found[n, 0]
        self.centroids = moved
        return bool((moved != centroids).any())

    def assigned(self) -> DataFrame:
        """``vec_id, cluster, distance`` (squared) of every usable vector."""
        if not len(self.centroids):
            return self.table.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance"))
        centroids, pivots, dims = self.centroids, self.pivots, self.dims

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            of_pivots = to_pivots(centroids, pivots)
            for batch in _cut(batches):
                v, t = _arrays(batch, dims)
                found, best, _ = nearest(v, t, centroids, of_pivots)
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(found, pa.int32()), pa.array(best, pa.int64())], names=["vec_id", "cluster", "distance"])

        return self.table.mapInArrow(run, "vec_id long, cluster int, distance long")

    def digest(self, n: int) -> str:
        return hashlib.sha256(",".join(map(str, self.centroids[n].tolist())).encode()).hexdigest()


def clustered(vectors: DataFrame, k: int = 8, rounds: int = 10, dims: int = 64, scale: int = 1024, order: Callable[[Column], Column] | None = None) -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256`` of every usable vector (``vec_id``, ``vec``).

    Centroids start as the ``k`` vectors first by ``order`` (default: the hexadecimal sha256 of ``3:<vec_id>``).
    A round that moves no centroid ends the rounds, as all later ones would repeat it.
    """
    rank = (order or (lambda c: F.sha2(F.concat(F.lit("3:"), c.cast("string")), 256)))(F.col("vec_id"))
    found = Clustering(vectors, k, dims, scale, rank)
    for _ in range(rounds):
        if not found.round():
            break
    rows = stored(found.assigned(), "clusters")
    parts = {row["cluster"]: row["part"] for row in rows.groupBy("cluster").agg(F.sum("distance").alias("part")).collect()}  # k rows at most
    clusters = range(len(found.centroids))
    of = lambda values: F.element_at(F.array(*values), F.col("cluster") + 1)
    return rows.select(
        "vec_id",
        "cluster",
        "distance",
        of([F.lit(parts.get(c, 0)).cast("long") for c in clusters] or [F.lit(0).cast("long")]).alias("cluster_inertia"),
        F.lit(sum(parts.values())).cast("long").alias("inertia"),
        of([F.lit(found.digest(c)) for c in clusters] or [F.lit("")]).alias("centroid_sha256"),
    )


def cluster_sql(k: int = 8, rounds: int = 10, dims: int = 64, scale: int = 1024) -> str:
    """The same over ``embeddings`` as DuckDB SQL, one pair of steps for each round."""
    apart = f"list_sum(list_transform(range(1, {dims + 1}), lambda i: (v[i] - c[i]) * (v[i] - c[i])))"

    def near(n: int) -> str:
        return f"a{n} AS MATERIALIZED (SELECT vec_id, v, min(struct_pack(d := d, cluster := cluster)) AS m FROM (SELECT vec_id, v, cluster, {apart} AS d FROM kept, c{n}) GROUP BY vec_id, v)"

    def moved(n: int) -> str:
        mean = "list((s - (s % n + n) % n) // n ORDER BY i)"
        return f"""s{n} AS (SELECT cluster, i, sum(v[i]) AS s, count(*) AS n FROM (SELECT m.cluster AS cluster, v, unnest(range(1, {dims + 1})) AS i FROM a{n}) GROUP BY cluster, i),
c{n + 1} AS MATERIALIZED (SELECT c{n}.cluster, coalesce(new.c, c{n}.c) AS c FROM c{n} LEFT JOIN (SELECT cluster, {mean}::BIGINT[] AS c FROM s{n} GROUP BY cluster) new USING (cluster))"""

    steps = ",\n".join(x for n in range(rounds) for x in (near(n), moved(n)))
    return f"""
WITH kept AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1)::INTEGER AS cluster, v AS c FROM kept ORDER BY sha256('3:' || vec_id) LIMIT {k}),
{steps},
{near(rounds)},
done AS (SELECT vec_id, m.cluster AS cluster, m.d::BIGINT AS distance FROM a{rounds})
SELECT vec_id, cluster, distance, sum(distance) OVER (PARTITION BY cluster)::BIGINT AS cluster_inertia, sum(distance) OVER ()::BIGINT AS inertia,
  sha256(array_to_string(c{rounds}.c, ',')) AS centroid_sha256
FROM done JOIN c{rounds} USING (cluster)
"""

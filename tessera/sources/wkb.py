"""Well-known binary: points, lines, polygons and their collections, read and written in Arrow batches.

A geometry becomes a struct of its ``kind`` and its ``parts``: a list of polygons, each a list of rings, each a list of
points; lines are rings of a part each, and points rings of one point. Rings of polygons have no repeated last
point here and have one in the binary. Heights and measures are skipped. Both byte orders are read, little-endian
ones are written. NULL stays NULL; a broken or unknown geometry raises.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Numbers of the kinds (fixed values of the format).
KINDS = {1: "point", 2: "line", 3: "polygon", 4: "multipoint", 5: "multiline", 6: "multipolygon"}
NUMBERS = {name: number for number, name in KINDS.items()}
#: Marks of heights, measures and a reference number in the kind of the extended format (fixed values).
HEIGHT, MEASURE, REFERENCE = 0x80000000, 0x40000000, 0x20000000
POINT = pa.struct([("x", pa.float64()), ("y", pa.float64())])
PARTS = pa.list_(pa.list_(pa.list_(POINT)))
SHAPE = "array<array<array<struct<x:double,y:double>>>>"


class _Reader:
    def __init__(self, raw: bytes):
        self.raw, self.at = raw, 0

    def _count(self, order: str) -> int:
        (n,) = struct.unpack_from(order + "I", self.raw, self.at)
        self.at += 4
        return n

    def _points(self, order: str, n: int, width: int) -> np.ndarray:
        if self.at + 8 * n * width > len(self.raw):
            raise ValueError("a geometry ends too early")
        out = np.frombuffer(self.raw, np.dtype(order + "f8"), n * width, self.at).reshape(n, width)[:, :2]
        self.at += 8 * n * width
        return out

    def read(self) -> tuple[str, list[list[np.ndarray]]]:
        if not self.raw[self.at :]:
            raise ValueError("a geometry ends too early")
        order = "<" if self.raw[self.at] else ">"
        self.at += 1
        code = self._count(order)
        width = 2 + bool(code & HEIGHT) + bool(code & MEASURE)
        if code & REFERENCE:
            self.at += 4
        code &= ~(HEIGHT | MEASURE | REFERENCE)
        # thousands tell heights and measures too
        width += (0, 1, 1, 2)[code // 1000] if code // 1000 < 4 else 0
        kind = KINDS.get(code % 1000)
        if kind is None:
            raise ValueError(f"geometry of kind {code}")
        if kind == "point":
            p = self._points(order, 1, width)
            return kind, [] if np.isnan(p).all() else [[p]]
        n = self._count(order)
        if kind == "line":
            return kind, [[self._points(order, n, width)]] if n else []
        if kind == "polygon":
            rings = [self._points(order, self._count(order), width) for _ in range(n)]
            return kind, [[r[:-1] if len(r) > 1 and (r[0] == r[-1]).all() else r for r in rings]] if n else []
        return kind, [part for _ in range(n) for part in self.read()[1]]


def parsed(raw: bytes) -> tuple[str, list[list[np.ndarray]]]:
    """Kind and parts of one geometry."""
    return _Reader(raw).read()


def _head(kind: str) -> bytes:
    return struct.pack("<BI", 1, NUMBERS[kind])


def written(kind: str, parts: list[list[np.ndarray]]) -> bytes:
    """The binary of one geometry."""
    if kind not in NUMBERS:
        raise ValueError(f"geometry of kind {kind}")
    flat = lambda r: np.ascontiguousarray(r, "<f8").tobytes()
    if kind.startswith("multi"):
        return _head(kind) + struct.pack("<I", len(parts)) + b"".join(written(kind[5:], [p]) for p in parts)
    if kind == "point":
        return _head(kind) + (flat(parts[0][0]) if parts else struct.pack("<2d", np.nan, np.nan))
    if kind == "line":
        return _head(kind) + (struct.pack("<I", len(parts[0][0])) + flat(parts[0][0]) if parts else struct.pack("<I", 0))
    rings = [np.r_[r, r[:1]] for r in parts[0]] if parts else []
    return _head(kind) + struct.pack("<I", len(rings)) + b"".join(struct.pack("<I", len(r)) + flat(r) for r in rings)


def read(df: DataFrame, column: str = "wkb") -> DataFrame:
    """``df`` with ``kind`` and ``parts`` in place of the binary ``column``."""
    rest = df.drop("kind", "parts")
    names = [f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema if f.name != column]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [None if raw is None else parsed(raw) for raw in batch.column(column).to_pylist()]
            parts = [None if f is None else [[[{"x": x, "y": y} for x, y in ring.tolist()] for ring in part] for part in f[1]] for f in found]
            kept = [c for c in batch.schema.names if c != column]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array([f and f[0] for f in found], pa.string()), pa.array(parts, PARTS)], names=[*kept, "kind", "parts"])

    return rest.mapInArrow(run, ", ".join([*names, "kind string", f"parts {SHAPE}"]))


def write(df: DataFrame, column: str = "wkb") -> DataFrame:
    """``df`` with the binary ``column`` in place of ``kind`` and ``parts``."""
    kept = [f for f in df.schema if f.name not in ("kind", "parts", column)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(batch.column("kind").to_pylist(), batch.column("parts").to_pylist(), strict=True)
            raw = [None if kind is None or parts is None else written(kind, [[np.array([(p["x"], p["y"]) for p in ring], float).reshape(-1, 2) for ring in part] for part in parts]) for kind, parts in rows]
            yield pa.RecordBatch.from_arrays([*[batch.column(f.name) for f in kept], pa.array(raw, pa.binary())], names=[*[f.name for f in kept], column])

    return df.drop(column).mapInArrow(run, ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in kept], f"`{column}` binary"]))


def polygons(df: DataFrame) -> DataFrame:
    """Polygons of ``read`` as ``shape``, all rings of all parts together by the even-odd rule; other kinds are left out."""
    return df.where(F.col("kind").isin("polygon", "multipolygon")).withColumn("shape", F.flatten("parts")).drop("kind", "parts")


def multipolygon(pieces: Column) -> tuple[Column, Column]:
    """``kind`` and ``parts`` of a list of rings, one polygon each."""
    return F.lit("multipolygon").alias("kind"), F.transform(pieces, lambda r: F.array(r)).alias("parts")

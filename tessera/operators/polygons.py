"""Polygons of any shape as convex pieces: decomposition, union, offsets, outlines.

A shape is one ring or a list of rings, read by the even-odd rule, so that a ring inside another is a hole. The
half-plane cuts of ``space`` need convex rings; here a sweep over horizontal strips turns any shape, or any number
of shapes together, into trapezoids: between two events no edges cross, so the edges of a strip have one order, and
what is inside follows from counting along it. Trapezoids between the same two edges are one.

A union is swept in grid cells, each by itself: pieces are cut at the cells' borders, a crowded cell is first
swept in parts and then quartered. What lies on a border of two cells, or of two trapezoids, cancels in ``outline``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators import cuts, space
from tessera.sources.shared import stored

RING = "array<struct<x:double,y:double>>"
_RING = T.ArrayType(T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())]))
ARROW_RING = pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))
#: Numbers held by a sweep at a time, pieces of a cell that are swept together, and quarterings of a cell at most.
BLOCK, CELL_PIECES, DEPTH = 1 << 21, 512, 12
#: Corners of a circle, as many in each quarter.
CORNERS = 64


def edges_of(rings: list[np.ndarray]) -> np.ndarray:
    """Rows ``x0, y0, x1, y1, sign``: lower end first; the sign tells an edge that runs down (+1) from one that runs up (-1)."""
    parts = [np.c_[r, np.roll(r, -1, axis=0)] for r in rings if len(r) > 2]
    if not parts:
        return np.empty((0, 5))
    e = np.concatenate(parts)
    e = e[e[:, 1] != e[:, 3]]
    down = e[:, 3] < e[:, 1]
    e[down] = e[down][:, [2, 3, 0, 1]]
    return np.c_[e, np.where(down, 1.0, -1.0)]


def _crossings(e: np.ndarray) -> np.ndarray:
    """Heights at which two edges cross between their ends."""
    out = []
    dx, dy = e[:, 2] - e[:, 0], e[:, 3] - e[:, 1]
    step = max(1, BLOCK // max(len(e), 1))
    for k in range(0, len(e), step):
        a = slice(k, k + step)
        cross = dx[a, None] * dy[None] - dy[a, None] * dx[None]
        ox, oy = e[None, :, 0] - e[a, 0, None], e[None, :, 1] - e[a, 1, None]
        with np.errstate(divide="ignore", invalid="ignore"):
            s, t = (ox * dy[None] - oy * dx[None]) / cross, (ox * dy[a, None] - oy * dx[a, None]) / cross
        i, j = np.nonzero((cross != 0) & (s > 0) & (s < 1) & (t > 0) & (t < 1))
        out.append(e[a][i, 1] + s[i, j] * dy[a][i])
    return np.concatenate(out) if out else np.empty(0)


def swept(edges: np.ndarray, union: bool) -> list[np.ndarray]:
    """Disjoint trapezoids, counter-clockwise, of what is inside: an odd number of edges to the left, or for a union more that open than that close.

    Without ``union`` the edges are those of one shape, which must not cross; crossing ones raise.
    """
    if not len(edges):
        return []
    tiny = 1e-12 * (1 + np.abs(edges[:, :4]).max())
    ys = np.unique(np.r_[edges[:, 1], edges[:, 3], _crossings(edges)] if union else np.r_[edges[:, 1], edges[:, 3]])
    ys = ys[np.r_[True, np.diff(ys) > tiny]]
    e = edges[np.argsort(edges[:, 1], kind="stable")]
    slope = (e[:, 2] - e[:, 0]) / (e[:, 3] - e[:, 1])
    at = lambda k, y: e[k, 0] + (y - e[k, 1]) * slope[k]
    strips, lefts, rights = [], [], []
    first, step = 0, max(1, BLOCK // len(e))
    while first < len(ys) - 1:
        last = min(first + step, len(ys) - 1)
        near = np.flatnonzero((e[:, 1] < ys[last]) & (e[:, 3] > ys[first]))
        low, high = ys[first:last], ys[first + 1 : last + 1]
        middle = (low + high) / 2
        live = (e[None, near, 1] < middle[:, None]) & (e[None, near, 3] > middle[:, None])
        # edges that open come before edges that close at the same place, so that touching pieces grow together
        x = np.where(live, at(near, middle[:, None]) - (tiny * e[None, near, 4] if union else 0), np.inf)
        order = np.argsort(x, axis=1, kind="stable")
        sign = np.where(np.take_along_axis(live, order, 1), e[near, 4][order], 0.0)
        found = near[order]
        if union:
            count = np.cumsum(sign, axis=1)
            inside, before = count > 0.5, np.c_[np.zeros(len(middle)), count[:, :-1]] > 0.5
        else:
            inside = (np.cumsum(sign != 0, axis=1) % 2 == 1) & (sign != 0)
            before = np.c_[np.zeros((len(middle), 1), bool), inside[:, :-1]]
            for y in (low, high):
                xs = np.where(sign != 0, at(found, y[:, None]), np.inf)
                with np.errstate(invalid="ignore"):
                    if (np.diff(xs, axis=1) < -1e3 * tiny).any():
                        raise ValueError("a ring crosses itself or another ring of its shape")
        row, k = np.nonzero(inside & ~before)
        row_end, k_end = np.nonzero(before & ~inside & (sign != 0))
        if len(row) != len(row_end) or (row != row_end).any():
            raise ValueError("a ring is not closed")
        strips.append(row + first)
        lefts.append(found[row, k])
        rights.append(found[row_end, k_end])
        first = last
    strip, left, right = np.concatenate(strips), np.concatenate(lefts), np.concatenate(rights)
    order = np.lexsort((strip, right, left))
    strip, left, right = strip[order], left[order], right[order]
    new = np.r_[True, (left[1:] != left[:-1]) | (right[1:] != right[:-1]) | (strip[1:] != strip[:-1] + 1)] if len(strip) else np.empty(0, bool)
    starts = np.flatnonzero(new)
    ends = np.r_[starts[1:], len(strip)] - 1
    low, high, left, right = ys[strip[starts]], ys[strip[ends] + 1], left[starts], right[starts]
    corners = np.stack([at(left, low), low, at(right, low), low, at(right, high), high, at(left, high), high], axis=1).reshape(-1, 4, 2)
    keep = np.abs(corners - corners[:, [3, 0, 1, 2]]).max(axis=2) > tiny
    return [c if k.all() else c[k] for c, k in zip(corners, keep, strict=True) if k.sum() > 2]


def signed_area(ring: np.ndarray) -> float:
    x, y = (ring - ring[0]).T
    return float((x * np.roll(y, -1) - np.roll(x, -1) * y).sum() / 2)


def union_of(convex: list[np.ndarray]) -> list[np.ndarray]:
    """Disjoint trapezoids of the union of convex rings."""
    return swept(edges_of([r if signed_area(r) >= 0 else r[::-1] for r in convex if len(r) > 2]), True)  # all counter-clockwise


def _points(ring: np.ndarray) -> list[dict]:
    return [{"x": x, "y": y} for x, y in ring.tolist()]


def is_convex(ring: Column) -> Column:
    """Does a ring turn one way only, once around?"""
    ways = lambda r, after: F.zip_with(r, after, lambda a, b: F.struct((b["x"] - a["x"]).alias("x"), (b["y"] - a["y"]).alias("y")))
    angle = lambda a, b: F.atan2(a["x"] * b["y"] - a["y"] * b["x"], a["x"] * b["x"] + a["y"] * b["y"])
    turns = space._let(ring, lambda r: space._let(ways(r, space._turned(r)), lambda way: F.zip_with(way, space._turned(way), angle)))

    def once(t: Column) -> Column:
        one_way = F.forall(t, lambda z: z >= -1e-12) | F.forall(t, lambda z: z <= 1e-12)
        return (F.size(t) > 2) & one_way & (F.abs(F.aggregate(t, F.lit(0.0), lambda s, z: s + z)) < 6.5)

    return space._let(turns, once)


def decomposed(df: DataFrame, shape: str = "shape", out: str = "pieces") -> DataFrame:
    """``df`` with ``out``, disjoint convex pieces of the column ``shape`` (a ring, or a list of rings by the even-odd rule).

    A convex ring is its own piece and stays in the JVM. Rings of fewer than three points have no piece. Crossing rings raise.
    """
    one = isinstance(df.schema[shape].dataType.elementType, T.StructType)
    rings = F.array(F.col(shape)) if one else F.col(shape)
    kind = T.ArrayType(T.ArrayType(T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])))
    marked = df.withColumn(out, rings.cast(kind))
    plain = F.when(F.size(out) == 1, is_convex(F.element_at(out, 1)))
    at = marked.columns.index(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 2048):
                part = batch.slice(k, 2048)
                columns = part.columns
                columns[at] = cuts.decomposed(part.column(at), lambda rings: swept(edges_of(rings), False))
                yield pa.RecordBatch.from_arrays(columns, names=part.schema.names)

    simple = F.coalesce(plain, F.lit(False))
    # a small file of many shapes is one split, and their sweeps are the work
    tasks = df.sparkSession.sparkContext.defaultParallelism * 2
    return marked.where(simple).unionByName(marked.where(~simple).repartition(tasks).mapInArrow(run, marked.schema))


def exploded(df: DataFrame, shape: str, number: str, area: str) -> DataFrame:
    """One row for each convex piece of ``shape``, in that column, with its ``number`` and the ``area`` of the whole shape."""
    rows = decomposed(df, shape, "pieces__").withColumn(area, space.pieces_area(F.col("pieces__")))
    return rows.select(*[c for c in df.columns if c != shape], area, F.posexplode("pieces__").alias(number, shape))


def _cells(rows: DataFrame, side: Column) -> DataFrame:
    """Pieces in every square cell of ``side`` that their box meets (``bx``, ``by``), not cut yet."""
    at = lambda f, c: F.floor(f(F.transform("piece", lambda p: p[c])) / side).alias(f"{c}{f.__name__}__")
    rows = rows.select("*", *[at(f, c) for c in "xy" for f in (F.array_min, F.array_max)])
    spread = lambda c: F.explode(F.sequence(f"{c}array_min__", f"{c}array_max__"))
    return rows.withColumn("bx", spread("x")).withColumn("by", spread("y")).drop(*[f"{c}{f}__" for c in "xy" for f in ("array_min", "array_max")])


def dissolved(df: DataFrame, by: str, size: float, shape: str = "shape", most: int = CELL_PIECES) -> DataFrame:
    """``(by, level, cell_x, cell_y, piece)``: the union of the shapes of each ``by``, as disjoint convex pieces in square cells.

    Cells have the side ``size / 2**level``. A cell of over ``most`` pieces is swept in parts, whose unions meet in its
    quarters; after ``DEPTH`` quarterings what is left is swept at once. Shapes that are NULL or without area add nothing.
    """
    rows = decomposed(df.select(F.col(by).alias("key__"), F.col(shape).alias("shape__")), "shape__", "pieces__")
    return _united(rows.select("key__", F.explode("pieces__").alias("piece")), by, size, most)


def _united(rows: DataFrame, by: str, size: float, most: int = CELL_PIECES) -> DataFrame:
    """``dissolved`` convex pieces (``key__``, ``piece``)."""
    kind = rows.schema["key__"].dataType.simpleString()
    rows = _cells(rows.where(F.size("piece") > 2).withColumn("level", F.lit(0)), F.lit(float(size)))
    keys = ["key__", "level", "bx", "by"]

    def run(key: tuple, table: pa.Table) -> pa.Table:
        level, i, j = (key[k].as_py() for k in (1, 2, 3))
        side = size / 2**level
        pieces = cuts.padded(table.column("piece").combine_chunks())
        found = swept(cuts.sides(*cuts.boxed(*pieces, i * side, j * side, (i + 1) * side, (j + 1) * side)), True)
        n = len(found)
        points = np.concatenate(found) if n else np.empty((0, 2))
        ends = np.r_[0, np.cumsum([len(p) for p in found])]
        rings = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(points[:, c])) for c in range(2)], ["x", "y"]))
        head = [pa.array([key[k].as_py()] * n, table.schema.field(keys[k]).type) for k in range(4)]
        return pa.Table.from_arrays([*head, rings], names=[*keys, "piece"])

    schema = f"key__ {kind}, level int, bx long, by long, piece {RING}"
    ready = None
    for depth in range(DEPTH + 1):
        counts = stored(rows.groupBy(*keys).agg(F.count("*").alias("n__")).where(F.col("n__") > most), "crowded")
        if depth == DEPTH or counts.isEmpty():
            ready = rows if ready is None else ready.unionByName(rows)
            break
        calm = rows.join(counts, keys, "left_anti")
        ready = calm if ready is None else ready.unionByName(calm)
        parts = rows.join(counts, keys).withColumn("part__", F.pmod(F.xxhash64("piece"), F.ceil(F.col("n__") / most)).cast("int"))
        merged = parts.select(*keys, "part__", "piece").groupBy(*keys, "part__").applyInArrow(run, schema)
        side = F.lit(float(size)) / F.pow(F.lit(2.0), F.col("level"))
        rows = stored(_cells(merged.select("key__", (F.col("level") + 1).alias("level"), "piece"), side).select(*keys, "piece"), "quartered")
    out = ready.select(*keys, "piece").groupBy(*keys).applyInArrow(run, schema)
    return out.select(F.col("key__").alias(by), "level", F.col("bx").alias("cell_x"), F.col("by").alias("cell_y"), "piece")


def areas(pieces: DataFrame, by: str) -> DataFrame:
    """``(by, area, pieces)`` of disjoint pieces."""
    return pieces.groupBy(by).agg(F.sum(space.ring_area(F.col("piece"))).alias("area"), F.count("*").alias("pieces"))


def outline(pieces: DataFrame, by: str) -> DataFrame:
    """``(by, x0, y0, x1, y1)``: the border of a union, without what lies between two of its pieces (``dissolved``).

    Pieces meet along horizontal lines and along borders of cells, which are vertical: on each such line sides of
    opposite direction cancel, wherever they overlap. All other sides are border as they are. A line is looked at in
    one cell of the grid at a time, which no side leaves.
    """
    sides = F.explode(F.zip_with("piece", space._turned(F.col("piece")), lambda p, q: F.struct(p["x"].alias("x0"), p["y"].alias("y0"), q["x"].alias("x1"), q["y"].alias("y1"))))
    rows = pieces.select(by, *[F.expr(f"shiftright({c}, level)").alias(c) for c in ("cell_x", "cell_y")], sides.alias("s")).select(by, "cell_x", "cell_y", "s.*").where("x0 <> x1 OR y0 <> y1")
    flat, upright = F.col("y0") == F.col("y1"), F.col("x0") == F.col("x1")
    lines = rows.where(flat | upright).withColumn("flat", flat).withColumn("line", F.when(flat, F.col("y0")).otherwise(F.col("x0"))).withColumn("square", F.when(flat, F.col("cell_x")).otherwise(F.col("cell_y")))
    a, b = F.when(flat, F.col("x0")).otherwise(F.col("y0")), F.when(flat, F.col("x1")).otherwise(F.col("y1"))
    ends = lines.select(by, "flat", "line", "square", F.explode(F.array(F.struct(F.least(a, b).alias("at"), F.when(a < b, 1).otherwise(-1).alias("turn")), F.struct(F.greatest(a, b).alias("at"), F.when(a < b, -1).otherwise(1).alias("turn")))).alias("e"))
    steps = ends.select(by, "flat", "line", "square", "e.*").groupBy(by, "flat", "line", "square", "at").agg(F.sum("turn").alias("turn")).where("turn <> 0")
    along = Window.partitionBy(by, "flat", "line", "square").orderBy("at")
    parts = steps.withColumn("count", F.sum("turn").over(along)).withColumn("end", F.lead("at").over(along)).where("count <> 0")
    forward = F.col("count") > 0
    first, second = F.when(forward, F.col("at")).otherwise(F.col("end")), F.when(forward, F.col("end")).otherwise(F.col("at"))
    kept = parts.select(by, F.when(F.col("flat"), first).otherwise(F.col("line")).alias("x0"), F.when(F.col("flat"), F.col("line")).otherwise(first).alias("y0"), F.when(F.col("flat"), second).otherwise(F.col("line")).alias("x1"), F.when(F.col("flat"), F.col("line")).otherwise(second).alias("y1"))
    return rows.where(~flat & ~upright).select(*kept.columns).unionByName(kept)


def circle(x: Column, y: Column, radius: Column, corners: int = CORNERS) -> Column:
    """A regular polygon inscribed in a circle, its first corner east."""
    angle = [2 * math.pi * k / corners for k in range(corners)]
    return F.array(*[F.struct((x + radius * math.cos(t)).cast("double").alias("x"), (y + radius * math.sin(t)).cast("double").alias("y")) for t in angle])


def offset_pieces(rings: Column, radius: float) -> Column:
    """Convex pieces that cover what lies within ``radius`` of the border of a shape.

    A strip on both sides of each edge, and at each corner a sector of the circle where it turns away from the strips.
    """
    step = 2 * math.pi / CORNERS
    place = lambda p, t: F.struct((p["x"] + radius * F.cos(t)).alias("x"), (p["y"] + radius * F.sin(t)).alias("y"))

    def strip(a: Column, b: Column) -> Column:
        far = F.hypot(b["x"] - a["x"], b["y"] - a["y"])
        nx, ny = -(b["y"] - a["y"]) / far * radius, (b["x"] - a["x"]) / far * radius
        corner = lambda p, s: F.struct((p["x"] + s * nx).alias("x"), (p["y"] + s * ny).alias("y"))
        return F.array(corner(a, 1), corner(a, -1), corner(b, -1), corner(b, 1))

    def sector(a: Column, b: Column) -> Column:
        """At the end of edge ``a``, where edge ``b`` begins: from one edge's normal to the other's, on the outer side of the turn."""
        ux, uy, vx, vy = a["q"]["x"] - a["p"]["x"], a["q"]["y"] - a["p"]["y"], b["q"]["x"] - b["p"]["x"], b["q"]["y"] - b["p"]["y"]
        turn = F.atan2(ux * vy - uy * vx, ux * vx + uy * vy)
        begin = F.when(turn > 0, F.atan2(uy, ux) - math.pi / 2).otherwise(F.atan2(vy, vx) + math.pi / 2)
        first, last = F.floor(begin / step) + 1, F.ceil((begin + F.abs(turn)) / step) - 1
        arc = F.when(first <= last, F.transform(F.sequence(first, last), lambda k: place(b["p"], k * step))).otherwise(F.slice(F.array(place(b["p"], begin)), 1, 0))
        return F.when(F.abs(turn) > 1e-9, F.concat(F.array(b["p"], place(b["p"], begin)), arc, F.array(place(b["p"], begin + F.abs(turn)))))

    def of(ring: Column) -> Column:
        edges = F.filter(F.zip_with(ring, space._turned(ring), lambda p, q: F.struct(p.alias("p"), q.alias("q"))), lambda e: F.hypot(e["q"]["x"] - e["p"]["x"], e["q"]["y"] - e["p"]["y"]) > 0)
        return space._let(edges, lambda e: F.concat(F.transform(e, lambda z: strip(z["p"], z["q"])), F.filter(F.zip_with(e, space._turned(e), sector), lambda x: x.isNotNull())))

    return F.flatten(F.transform(rings, of))


def buffered(df: DataFrame, by: str, radius: float, size: float, shape: str = "shape") -> DataFrame:
    """``dissolved`` shapes of each ``by``, widened by ``radius`` all around; holes shrink."""
    if radius <= 0:
        raise ValueError("the radius has to be positive")
    one = isinstance(df.schema[shape].dataType.elementType, T.StructType)
    rings = F.array(F.col(shape)) if one else F.col(shape)
    # a small file of many shapes is one split, and their strips and sectors are much work
    dealt = df.repartition(df.sparkSession.sparkContext.defaultParallelism * 2)
    around = dealt.select(F.col(by).alias("key__"), F.explode(offset_pieces(rings, radius)).alias("piece"))
    inner = decomposed(df.select(by, shape), shape, "pieces__").select(F.col(by).alias("key__"), F.explode("pieces__").alias("piece"))
    return _united(inner.unionByName(around), by, size)


def mask(shapes: DataFrame, radius: float, size: float, shape: str = "shape") -> DataFrame:
    """``(cell_x, cell_y, id_b, shape_b)``: where anything lies within ``radius``, as disjoint convex pieces in square cells of ``size``."""
    pieces = buffered(shapes.select(F.lit(0).alias("all__"), shape), "all__", radius, size, shape)
    return pieces.select("cell_x", "cell_y", F.xxhash64("level", "cell_x", "cell_y", "piece").alias("id_b"), F.col("piece").alias("shape_b"))


def ring_polygons(places: DataFrame, edges: tuple[float, ...]) -> DataFrame:
    """``(place, ring, pieces)``: the ground between two distances of each place (``place, px, py``), as convex pieces; the first ring may start at 0."""
    hulls = [circle(F.col("px"), F.col("py"), F.lit(float(r))).alias(f"c{k}__") if r else F.lit(None).cast(RING).alias(f"c{k}__") for k, r in enumerate(edges)]
    names = [f"r{lo:g}_{hi:g}" for lo, hi in zip(edges, edges[1:], strict=False)]
    schema = T.StructType([places.schema["place"], T.StructField("ring", T.StringType()), T.StructField("pieces", T.ArrayType(_RING))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 1024):
                part = batch.slice(k, 1024)
                for j, name in enumerate(names):
                    outer, inner = (cuts.padded(part.column(f"c{i}__")) for i in (j + 1, j))
                    whole = (np.arange(part.num_rows), *outer)
                    row, pieces, n = cuts.difference(*outer, *inner) if edges[j] else whole
                    yield pa.RecordBatch.from_arrays([part.column("place"), pa.array([name] * part.num_rows), cuts.nested(row, cuts.ring_array(pieces, n), part.num_rows)], names=schema.names)

    tasks = places.sparkSession.sparkContext.defaultParallelism * 2
    return places.repartition(tasks).select("place", *hulls).mapInArrow(run, schema)

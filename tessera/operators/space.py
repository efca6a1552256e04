"""Planar geometry: projection, hexagon cells, within joins, overlays, contested ground.

Rings are ``array<struct<x:double,y:double>>`` without a repeated last point. Candidate pairs come from
a bucket grid: each geometry stands in the buckets that its bounding box touches, and a pair is kept
in the one bucket that holds the lower corner of the common box, so no pair is counted twice.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators import cuts

#: WGS84 and the transverse Mercator zone 18 south (fixed values).
A, FLAT, SCALE0, MERIDIAN, EAST, NORTH = 6378137.0, 1 / 298.257223563, 0.9996, -75.0, 500000.0, 10000000.0


def utm18s(lat: Column, lng: Column) -> tuple[Column, Column]:
    """EPSG:4326 to EPSG:32718 by the Krueger series to the fourth order."""
    n = FLAT / (2 - FLAT)
    radius = A / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = (
        n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180,
        13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440,
        61 * n**3 / 240 - 103 * n**4 / 140,
        49561 * n**4 / 161280,
    )
    e = 2 * math.sqrt(n) / (1 + n)
    s = F.sin(F.radians(lat))
    t = F.sinh(F.atanh(s) - e * F.atanh(e * s))
    dl = F.radians(lng - MERIDIAN)
    xi, eta = F.atan2(t, F.cos(dl)), F.atanh(F.sin(dl) / F.sqrt(1 + t * t))
    x, y = eta, xi
    for j, a in enumerate(alpha, 1):
        x = x + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        y = y + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return EAST + SCALE0 * radius * x, NORTH + SCALE0 * radius * y


def from_utm18s(x: Column, y: Column) -> tuple[Column, Column]:
    """EPSG:32718 to latitude and longitude, by the inverse series to the fourth order."""
    n = FLAT / (2 - FLAT)
    radius = A / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    beta = (
        n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360,
        n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440,
        17 * n**3 / 480 - 37 * n**4 / 840,
        4397 * n**4 / 161280,
    )
    delta = (
        2 * n - 2 * n**2 / 3 - 2 * n**3 + 116 * n**4 / 45,
        7 * n**2 / 3 - 8 * n**3 / 5 - 227 * n**4 / 45,
        56 * n**3 / 15 - 136 * n**4 / 35,
        4279 * n**4 / 630,
    )
    eta, xi = (x - EAST) / (SCALE0 * radius), (y - NORTH) / (SCALE0 * radius)
    e, s = eta, xi
    for j, b in enumerate(beta, 1):
        e = e - b * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        s = s - b * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    chi = F.asin(F.sin(s) / F.cosh(e))
    lat = chi
    for j, d in enumerate(delta, 1):
        lat = lat + d * F.sin(2 * j * chi)
    return F.degrees(lat), F.degrees(F.atan2(F.sinh(e), F.cos(s))) + MERIDIAN


def metric(crs: str | None) -> str:
    """``crs`` if it is the metric zone in which lengths and areas hold; any other, or none, raises."""
    if crs is None or crs.strip().upper() not in ("EPSG:32718", "32718"):
        raise ValueError(f"EPSG:32718 is required, got {crs!r}")
    return crs


def equirectangular(lat: Column, lng: Column, lat0: float, lng0: float) -> tuple[Column, Column]:
    """Metres east and north of a point, good for a few kilometres."""
    k = math.pi / 180 * 6371000.0
    return (lng - lng0) * k * math.cos(math.radians(lat0)), (lat - lat0) * k


def hex_axial(x: Column, y: Column, size: float) -> tuple[Column, Column]:
    """Axial coordinates of the pointy-top hexagon (side ``size``) that holds a point."""
    q, r = (math.sqrt(3) / 3 * x - y / 3) / size, (2 / 3 * y) / size
    s = -q - r
    rq, rr, rs = F.rint(q), F.rint(r), F.rint(s)
    dq, dr, ds = F.abs(rq - q), F.abs(rr - r), F.abs(rs - s)
    out_q = F.when((dq > dr) & (dq > ds), -rr - rs).otherwise(rq)
    out_r = F.when((dq > dr) & (dq > ds), rr).when(dr > ds, -rq - rs).otherwise(rr)
    return out_q.cast("long"), out_r.cast("long")


def hex_ring(q: Column, r: Column, size: float) -> Column:
    """Corners of a hexagon."""
    cx, cy = size * math.sqrt(3) * (q + r / 2), size * 1.5 * r
    corner = [(size * math.cos(math.radians(60 * k - 30)), size * math.sin(math.radians(60 * k - 30))) for k in range(6)]
    return F.array(*[F.struct((cx + dx).alias("x"), (cy + dy).alias("y")) for dx, dy in corner])


def box_ring(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.array(*[F.struct(x.cast("double").alias("x"), y.cast("double").alias("y")) for x, y in ((x0, y0), (x1, y0), (x1, y1), (x0, y1))])


def ring_area(ring: Column) -> Column:
    """Shoelace area."""
    nxt = F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1))
    parts = F.zip_with(ring, nxt, lambda a, b: a["x"] * b["y"] - b["x"] * a["y"])
    return F.abs(F.aggregate(parts, F.lit(0.0), lambda s, p: s + p)) / 2


def centroid(ring: Column) -> Column:
    """Centre of gravity of a ring; of one without area, the mean of its corners."""

    def of(pairs: Column) -> Column:
        total = lambda f: F.aggregate(F.transform(pairs, f), F.lit(0.0), lambda s, v: s + v)
        cross = lambda z: z["a"]["x"] * z["b"]["y"] - z["b"]["x"] * z["a"]["y"]
        twice = total(cross)
        at = lambda c: F.when(F.abs(twice) > 0, total(lambda z: (z["a"][c] + z["b"][c]) * cross(z)) / (3 * twice)).otherwise(total(lambda z: z["a"][c]) / F.size(pairs))
        return F.struct(at("x").alias("x"), at("y").alias("y"))

    nxt = F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1))
    return of(F.zip_with(ring, nxt, lambda a, b: F.struct(a.alias("a"), b.alias("b"))))


def line_length(line: Column) -> Column:
    parts = F.zip_with(F.slice(line, 1, F.size(line) - 1), F.slice(line, 2, F.size(line)), lambda a, b: F.hypot(b["x"] - a["x"], b["y"] - a["y"]))
    return F.aggregate(parts, F.lit(0.0), lambda s, p: s + p)


def in_ring(x: Column, y: Column, ring: Column) -> Column:
    """Ray casting: an odd number of edges lies to the right."""
    nxt = F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1))
    hits = F.zip_with(ring, nxt, lambda a, b: F.when((a["y"] > y) != (b["y"] > y), (x < (b["x"] - a["x"]) * (y - a["y"]) / (b["y"] - a["y"]) + a["x"]).cast("int")).otherwise(0))
    return F.aggregate(hits, F.lit(0), lambda s, h: s + h) % 2 == 1


def _box(shape: str) -> list[Column]:
    of = lambda f, c: f(F.transform(shape, lambda p: p[c]))
    return [of(F.array_min, "x").alias("x0__"), of(F.array_min, "y").alias("y0__"), of(F.array_max, "x").alias("x1__"), of(F.array_max, "y").alias("y1__")]


def _bucketed(df: DataFrame, shape: str, size: float, mark: str) -> DataFrame:
    df = df.select("*", *_box(shape))
    cell = lambda c: F.floor(F.col(c) / size)
    df = df.withColumn("bx", F.explode(F.sequence(cell("x0__"), cell("x1__")))).withColumn("by", F.explode(F.sequence(cell("y0__"), cell("y1__"))))
    return df.withColumnsRenamed({f"{c}__": f"{c}{mark}" for c in ("x0", "y0", "x1", "y1")})


def candidates(a: DataFrame, b: DataFrame, size: float, shape_a: str = "shape_a", shape_b: str = "shape_b", dealt: bool = True) -> DataFrame:
    """Pairs (``id_a``, ``id_b``) whose bounding boxes meet, each once.

    Cutting shapes costs far more than moving them, so the pairs are dealt out by their ids: neither the
    pairs of a crowded bucket nor those of a broadcast join over few splits stay in one task. Pieces of one shape
    (``k_a``) are dealt out by their numbers too. Cuts in arrays cost less than moving the pairs: they go without (``dealt``).
    """
    pairs = _bucketed(a, shape_a, size, "_a").join(_bucketed(b, shape_b, size, "_b"), ["bx", "by"])
    meet = (F.col("x0_a") <= F.col("x1_b")) & (F.col("x0_b") <= F.col("x1_a")) & (F.col("y0_a") <= F.col("y1_b")) & (F.col("y0_b") <= F.col("y1_a"))
    own = (F.floor(F.greatest("x0_a", "x0_b") / size) == F.col("bx")) & (F.floor(F.greatest("y0_a", "y0_b") / size) == F.col("by"))
    found = pairs.where(meet & own).drop("bx", "by", *[f"{c}_{m}" for m in "ab" for c in ("x0", "y0", "x1", "y1")])
    return found.repartition("id_a", "id_b", *(c for c in a.columns if c == "k_a")) if dealt else found


def _measured(pairs: DataFrame, name: str, value: Column) -> DataFrame:
    """``pairs`` with a costly value, computed once for each: filters on it stay behind it, where the pairs are dealt out."""
    return pairs.select("*", F.inline(F.array(F.struct(value.alias(name)))))


def _let(value: Column, f) -> Column:
    """``f(value)`` with the value computed once, however often ``f`` uses it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _side(e: Column, p: Column) -> Column:
    """Positive left of the directed edge ``e`` (from ``p`` to ``q``)."""
    return (e["q"]["x"] - e["p"]["x"]) * (p["y"] - e["p"]["y"]) - (e["q"]["y"] - e["p"]["y"]) * (p["x"] - e["p"]["x"])


def _turned(ring: Column) -> Column:
    return F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1))


def _edges(ring: Column) -> Column:
    """Edges of a ring, counter-clockwise."""
    signed = F.aggregate(F.zip_with(ring, _turned(ring), lambda a, b: a["x"] * b["y"] - b["x"] * a["y"]), F.lit(0.0), lambda s, p: s + p)
    return _let(F.when(signed < 0, F.reverse(ring)).otherwise(ring), lambda way: F.zip_with(way, _turned(way), lambda p, q: F.struct(p.alias("p"), q.alias("q"))))


def _cut(shape: Column, e: Column) -> Column:
    """The part of a convex shape left of an edge, its border included."""

    def step(a: Column, b: Column) -> Column:
        sa, sb = _side(e, a), _side(e, b)
        at = lambda c: (a[c] + (b[c] - a[c]) * sa / (sa - sb)).alias(c)
        cross = F.when(((sa > 0) & (sb < 0)) | ((sa < 0) & (sb > 0)), F.array(F.struct(at("x"), at("y")))).otherwise(F.slice(shape, 1, 0))
        return F.concat(F.when(sa >= 0, F.array(a)).otherwise(F.slice(shape, 1, 0)), cross)

    return F.flatten(F.zip_with(shape, _turned(shape), step))


def _column(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def clipped(shape: Column, ring: Column) -> Column:
    """A convex polygon inside a convex ring: cut by one edge's half plane after the other. Polygons that touch leave points."""
    return F.aggregate(_edges(ring), shape, _cut)


def clipped_area(shape: Column | str, ring: Column | str) -> Column:
    """Area of a convex polygon inside a convex ring."""
    return _let(clipped(_column(shape), _column(ring)), ring_area)


def difference(pieces: Column, ring: Column, least: float = 1e-9) -> Column:
    """Convex pieces without a convex ring, as convex pieces: for each edge, what lies right of it and left of those before."""

    def step(state: Column, e: Column) -> Column:
        away = _cut(state["rest"], F.struct(e["q"].alias("p"), e["p"].alias("q")))
        kept = F.filter(F.array(away), lambda z: (F.size(z) > 2) & (ring_area(z) > least))
        return F.struct(_cut(state["rest"], e).alias("rest"), F.concat(state["out"], kept).alias("out"))

    def without(piece: Column) -> Column:
        none = F.slice(F.array(piece), 1, 0)
        return F.aggregate(_edges(ring), F.struct(piece.alias("rest"), none.alias("out")), step, lambda s: s["out"])

    return F.flatten(F.transform(pieces, without))


def pieces_area(pieces: Column) -> Column:
    return F.aggregate(F.transform(pieces, ring_area), F.lit(0.0), lambda s, a: s + a)


def _spans(line: Column, ring: Column) -> Column:
    """For each part of a line its ``far`` and the share of it, from ``lo`` to ``hi``, inside a convex ring: cut by every edge's half plane."""
    edges = _edges(ring)

    def inside(a: Column, b: Column) -> Column:
        def step(s: Column, e: Column) -> Column:
            fa, fb = _side(e, a), _side(e, b)
            at = fa / F.when(fa == fb, F.lit(1.0)).otherwise(fa - fb)
            lo = F.when((fa < 0) & (fb >= 0), F.greatest(s["lo"], at)).otherwise(s["lo"])
            hi = F.when((fa < 0) & (fb < 0), F.lit(-1.0)).when((fa >= 0) & (fb < 0), F.least(s["hi"], at)).otherwise(s["hi"])
            return F.struct(lo.alias("lo"), hi.alias("hi"))

        span = F.aggregate(edges, F.struct(F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi")), step)
        return F.struct(span["lo"].alias("lo"), span["hi"].alias("hi"), F.hypot(b["x"] - a["x"], b["y"] - a["y"]).alias("far"))

    return F.zip_with(F.slice(line, 1, F.size(line) - 1), F.slice(line, 2, F.size(line)), inside)


def clipped_length(line: Column | str, ring: Column | str) -> Column:
    """Length of a line inside a convex ring."""
    parts = F.transform(_spans(_column(line), _column(ring)), lambda s: F.greatest(F.lit(0.0), s["hi"] - s["lo"]) * s["far"])
    return F.aggregate(parts, F.lit(0.0), lambda s, p: s + p)


def covers(x: Column, y: Column, ring: Column) -> Column:
    """Does a ring hold a point, its border included?"""
    on = F.exists(F.zip_with(ring, _turned(ring), lambda a, b: distance_to_part(x, y, a, b) <= 1e-9), lambda z: z)
    return on | in_ring(x, y, ring)


def distance_to_part(x: Column, y: Column, a: Column, b: Column) -> Column:
    """Distance of a point from the straight part from ``a`` to ``b``."""
    dx, dy = b["x"] - a["x"], b["y"] - a["y"]
    square = dx * dx + dy * dy
    t = F.when(square > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((x - a["x"]) * dx + (y - a["y"]) * dy) / square))).otherwise(0.0)
    return F.hypot(x - a["x"] - t * dx, y - a["y"] - t * dy)


def distance_to_line(x: Column, y: Column, line: Column) -> Column:
    return F.array_min(F.zip_with(F.slice(line, 1, F.size(line) - 1), F.slice(line, 2, F.size(line)), lambda a, b: distance_to_part(x, y, a, b)))


def assigned(points: DataFrame, cells: DataFrame, size: float) -> DataFrame:
    """``points`` (id, x, y) with the cell (``id_b``, ``shape_b``) that holds them; on a shared border the smallest, outside none."""
    cell = lambda c: F.floor(F.col(c) / size)
    near = points.select("id", "x", "y").withColumn("bx", cell("x")).withColumn("by", cell("y")).join(_bucketed(cells, "shape_b", size, "_b"), ["bx", "by"])
    held = near.where(F.col("x").between(F.col("x0_b"), F.col("x1_b")) & F.col("y").between(F.col("y0_b"), F.col("y1_b"))).where(covers(F.col("x"), F.col("y"), F.col("shape_b")))
    return points.join(held.groupBy("id").agg(F.min("id_b").alias("id_b")), "id", "left")


def lines_near(points: DataFrame, lines: DataFrame, radius: float) -> DataFrame:
    """``(id, id_a, distance)``: lines (``id_a``, ``shape_a``) within ``radius`` of each point, with the distance from the line itself."""
    r = F.lit(float(radius))
    box = lines.select("*", *_box("shape_a"))
    low, high = (lambda c: F.floor((F.col(c) - r) / r)), (lambda c: F.floor((F.col(c) + r) / r))
    box = box.withColumn("bx", F.explode(F.sequence(low("x0__"), high("x1__")))).withColumn("by", F.explode(F.sequence(low("y0__"), high("y1__"))))
    pairs = points.withColumn("bx", F.floor(F.col("x") / r)).withColumn("by", F.floor(F.col("y") / r)).join(box.select("id_a", "shape_a", "bx", "by"), ["bx", "by"])
    return pairs.select("id", "id_a", distance_to_line(F.col("x"), F.col("y"), F.col("shape_a")).alias("distance")).where(F.col("distance") <= r)


def _exploded(df: DataFrame, shape: str, number: str, area: str) -> DataFrame:
    """A row for each convex piece: overlays cut by half planes, whatever the shapes are."""
    from tessera.operators import polygons  # which is made of the cuts of this module

    return polygons.exploded(df, shape, number, area)


def resolved(cells: DataFrame, size: float, least: float = 1e-3) -> DataFrame:
    """Cells (``id``, ``shape``: a ring or rings of any form) as a partition: on contested ground the smallest id keeps it.

    Returns ``id, pieces, disputed``: convex pieces, and the area that went to smaller ids; a cell with nothing left is
    dropped. What a smaller cell itself gave up went to a still smaller one that meets this cell there too, so every cell
    is cut by its smaller neighbours as they came: no order of cells has to be followed.
    """
    parts = _exploded(cells.select("id", "shape"), "shape", "k", "area")
    a, b = parts.select(F.col("id").alias("id_a"), F.col("shape").alias("shape_a"), F.col("k").alias("k_a")), parts.select(F.col("id").alias("id_b"), F.col("shape").alias("shape_b"), F.col("k").alias("k_b"))
    pairs = _measured(candidates(a, b, size).where("id_b < id_a"), "common", clipped_area("shape_a", "shape_b")).where("common > 0")
    contested = pairs.groupBy("id_a", "id_b").agg(F.sum("common").alias("common"), F.collect_set(F.struct("k_b", "shape_b")).alias("cuts")).where(F.col("common") > least)
    before = contested.groupBy(F.col("id_a").alias("id")).agg(F.array_sort(F.collect_list(F.struct("id_b", F.array_sort("cuts").alias("cuts")))).alias("before"))
    whole = parts.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("k", "shape"))).alias("whole"), F.first("area").alias("area"))
    out = whole.join(before, "id", "left").withColumn("whole", F.transform("whole", lambda x: x["shape"]))
    cuts = F.flatten(F.transform("before", lambda o: F.transform(o["cuts"], lambda c: c["shape_b"])))
    pieces = F.when(F.col("before").isNull(), F.col("whole")).otherwise(F.aggregate(cuts, F.col("whole"), lambda p, o: difference(p, o)))
    done = _let(pieces, lambda p: F.struct(p.alias("pieces"), pieces_area(p).alias("left")))
    return out.select("id", "area", F.inline(F.filter(F.array(done), lambda x: F.size(x["pieces"]) > 0))).select("id", "pieces", (F.col("area") - F.col("left")).alias("disputed"))


def clipped_to(cells: DataFrame, mask: DataFrame, size: float, least: float = 1e-9) -> DataFrame:
    """``(id, pieces)``: cells (``id``, ``shape``) inside a mask (``id_b``, ``shape_b``), as disjoint convex pieces; cells outside are gone.

    Shapes of both sides may have any form. Shapes of the mask that overlap are dissolved first, which a job finds out.
    """
    from tessera.operators import polygons

    parts = _exploded(mask.select("id_b", "shape_b"), "shape_b", "k_b", "area_b").select("id_b", "k_b", "shape_b")
    others = parts.select(F.col("id_b").alias("id_a"), F.col("k_b").alias("k_a"), F.col("shape_b").alias("shape_a"))
    twice = _measured(candidates(others, parts, size).where("id_a < id_b"), "common", clipped_area("shape_a", "shape_b")).where(F.col("common") > least)
    if not twice.isEmpty():
        one = polygons.dissolved(parts.select(F.lit(0).alias("all__"), F.col("shape_b").alias("shape")), "all__", size)
        parts = one.select(F.xxhash64("level", "cell_x", "cell_y", "piece").alias("id_b"), F.lit(0).alias("k_b"), F.col("piece").alias("shape_b"))
    own = _exploded(cells.select(F.col("id").alias("id_a"), F.col("shape").alias("shape_a")), "shape_a", "k_a", "area_a")
    cut = _measured(candidates(own, parts, size), "part", clipped(F.col("shape_a"), F.col("shape_b"))).where(ring_area(F.col("part")) > least)
    return cut.groupBy(F.col("id_a").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("id_b", "k_b", "k_a", "part"))), lambda x: x["part"]).alias("pieces"))


def touching(edges: DataFrame, cells: DataFrame) -> DataFrame:
    """The edges (``src``, ``dst``) both of whose cells (``id``, ``pieces``) are there and still meet, if only in a point."""
    ends = edges.join(cells.select(F.col("id").alias("src"), F.col("pieces").alias("ps")), "src").join(cells.select(F.col("id").alias("dst"), F.col("pieces").alias("pd")), "dst")
    low, high = (lambda r, c: F.array_min(F.transform(r, lambda z: z[c]))), (lambda r, c: F.array_max(F.transform(r, lambda z: z[c])))
    near = lambda p, q: (low(p, "x") <= high(q, "x")) & (low(q, "x") <= high(p, "x")) & (low(p, "y") <= high(q, "y")) & (low(q, "y") <= high(p, "y"))
    meet = F.exists("ps", lambda p: F.exists("pd", lambda q: near(p, q) & (F.size(clipped(p, q)) > 0)))
    return ends.where(meet).select(*edges.columns)


def coordinate_lists(cells: DataFrame) -> DataFrame:
    """``(id, lng, lat)`` as lists of the largest piece's corners, rounded to six places; empty shapes are left out."""
    largest = F.array_max(F.transform("pieces", lambda p: F.struct(ring_area(p).alias("area"), p.alias("ring"))))["ring"]
    rows = cells.where(F.size("pieces") > 0).withColumn("ring", largest)
    return rows.select("id", *[F.transform(F.col("ring")[c], lambda v: F.round(v, 6)).alias(name) for name, c in (("lng", "x"), ("lat", "y"))])


def correspondence(a: DataFrame, b: DataFrame, size: float, least: float = 1.0) -> DataFrame:
    """Area of each overlapping pair from ``least`` up, and its share of either side. Shares are never normalised.

    Shapes of both sides are rings or lists of rings of any form; each is counted by its convex pieces.
    """
    left, right = _exploded(a.select("id_a", "shape_a"), "shape_a", "k_a", "area_a"), _exploded(b.select("id_b", "shape_b"), "shape_b", "k_b", "area_b")
    met = candidates(left, right, size, dealt=False).select("id_a", "id_b", "shape_a", "shape_b", "area_a", "area_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 2048):
                part = batch.slice(k, 2048)
                common = cuts.clipped(*cuts.padded(part.column("shape_a")), *cuts.padded(part.column("shape_b")))
                area = np.abs(cuts.signed(*common)) / 2
                columns = [*(part.column(c) for c in ("id_a", "id_b", "area_a", "area_b")), pa.array(area)]
                yield pa.RecordBatch.from_arrays(columns, names=["id_a", "id_b", "area_a", "area_b", "area"]).filter(pa.array(area > 0))

    kept = met.drop("shape_a", "shape_b").withColumn("area", F.lit(0.0))
    sums = met.mapInArrow(run, kept.schema).groupBy("id_a", "id_b").agg(F.sum("area").alias("area"), F.first("area_a").alias("of_a"), F.first("area_b").alias("of_b")).where(F.col("area") >= least)
    return sums.select("id_a", "id_b", "area", (F.col("area") / F.col("of_a")).alias("frac_a"), (F.col("area") / F.col("of_b")).alias("frac_b"))


def line_correspondence(lines: DataFrame, cells: DataFrame, size: float, least: float = 1.0) -> DataFrame:
    """Length of each line within each cell, of any form, from ``least`` up, and its share of the line's length.

    Along a border of two pieces of a cell a line is in both, so the shares of its parts are united before they are added.
    """
    pieces = _exploded(cells.select("id_b", "shape_b"), "shape_b", "k_b", "area_b")
    pairs = candidates(lines.select("id_a", "shape_a"), pieces, size).select("id_a", "id_b", line_length(F.col("shape_a")).alias("whole"), F.posexplode(_spans(F.col("shape_a"), F.col("shape_b"))).alias("part", "s"))
    spans = pairs.where("s.hi > s.lo").groupBy("id_a", "id_b").agg(F.first("whole").alias("whole"), F.array_sort(F.collect_list(F.struct("part", "s.lo", "s.hi", "s.far"))).alias("spans"))

    def step(s: Column, x: Column) -> Column:
        begin = F.when(x["part"] == s["part"], F.greatest(x["lo"], s["end"])).otherwise(x["lo"])
        end = F.when(x["part"] == s["part"], F.greatest(x["hi"], s["end"])).otherwise(x["hi"])
        return F.struct(x["part"].alias("part"), end.alias("end"), (s["sum"] + F.greatest(F.lit(0.0), x["hi"] - begin) * x["far"]).alias("sum"))

    united = F.aggregate("spans", F.struct(F.lit(-1).alias("part"), F.lit(0.0).alias("end"), F.lit(0.0).alias("sum")), step, lambda s: s["sum"])
    return spans.select("id_a", "id_b", united.alias("length"), "whole").where(F.col("length") >= least).select("id_a", "id_b", "length", (F.col("length") / F.col("whole")).alias("frac_a"))


def whole_shares(table: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """``table`` if the shares of no grid cell add up to more than 1; else it raises, as mass would be counted twice."""
    from tessera.operators import guards

    guards.holds(table.groupBy("id_b").agg(F.sum("frac_b").alias("covered")), F.col("covered") <= 1 + tolerance, "the shares of a cell add up to more than 1")
    return table


def mass_deviation(table: DataFrame, complete: DataFrame) -> DataFrame:
    """Largest |sum of shares - 1| over the cells that lie wholly in the grid."""
    sums = table.join(complete, "id_a", "left_semi").groupBy("id_a").agg(F.sum("frac_a").alias("s"))
    return sums.agg(F.count("*").alias("cells"), F.round(F.max(F.abs(F.col("s") - 1)), 6).alias("deviation"))


def coverage(table: DataFrame, grid: DataFrame) -> DataFrame:
    """Covered share and number of pieces of each grid cell; cells without any stay with 0."""
    sums = table.groupBy("id_b").agg(F.sum("frac_b").alias("covered"), F.count_distinct("id_a").alias("pieces"))
    return grid.select("id_b").join(sums, "id_b", "left").fillna(0, subset=["covered", "pieces"])


def within(points: DataFrame, targets: DataFrame, radius: float) -> DataFrame:
    """All targets within ``radius`` of each point, with the distance (``id, x, y`` and ``target, tx, ty``)."""
    cell = lambda c: F.floor(F.col(c) / radius)
    near = F.array(*[F.lit(k) for k in (-1, 0, 1)])
    spread = targets.withColumn("bx", F.explode(F.transform(near, lambda k: k + cell("tx")))).withColumn("by", F.explode(F.transform(near, lambda k: k + cell("ty"))))
    pairs = points.withColumn("bx", cell("x")).withColumn("by", cell("y")).join(spread, ["bx", "by"]).drop("bx", "by")
    return pairs.withColumn("distance", F.hypot(F.col("x") - F.col("tx"), F.col("y") - F.col("ty"))).where(F.col("distance") <= radius)


def densest_disc(pieces: DataFrame, n: int, reach: int = 2) -> DataFrame:
    """``(q, r, pieces)``: the ``n`` densest cells within ``reach`` steps of the densest (``pieces``: q, r, id).

    The disc first, then the order, so that the window hangs together; ties go to the smallest cell.
    """
    dense = pieces.groupBy("q", "r").agg(F.count_distinct("id").alias("pieces"))
    seed = dense.agg(F.max_by(F.struct("q", "r"), F.struct("pieces", -F.col("q"), -F.col("r")))).scalar()
    away = dense.withColumn("seed__", seed).withColumn("dq__", F.col("q") - F.col("seed__.q")).withColumn("dr__", F.col("r") - F.col("seed__.r"))
    steps = F.greatest(F.abs("dq__"), F.abs("dr__"), F.abs(F.col("dq__") + F.col("dr__")))
    return away.where(steps <= reach).select("q", "r", "pieces").orderBy(F.desc("pieces"), "q", "r").limit(n)


def names_near(pairs: DataFrame, separator: str = " · ") -> DataFrame:
    """Distinct names of each key by distance, then name, in one text (``id, name, distance``)."""
    first = pairs.groupBy("id", "name").agg(F.min("distance").alias("distance"))
    return first.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("distance", "name"))), lambda x: x["name"]), separator).alias("names"))

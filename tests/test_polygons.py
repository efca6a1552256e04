"""Shapes of any form against an even-odd count of grid points, formulas and inclusion-exclusion."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import polygons, space

RINGS = "id long, shape array<array<struct<x:double,y:double>>>"
RING = "id long, shape array<struct<x:double,y:double>>"
L = [(0, 0), (10, 0), (10, 2), (2, 2), (2, 10), (0, 10)]


def box(x0, y0, x1, y1):
    return [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]


def ring(points):
    return [(float(x), float(y)) for x, y in points]


def sides(df, mark):
    return df.select(F.col("id").alias(f"id_{mark}"), F.col("shape").alias(f"shape_{mark}"))


def area(points):
    return abs(polygons.signed_area(np.array(points, float)))


def star(rng, x, y, corners=9):
    spokes = [(2 * math.pi * (k + rng.uniform(0, 0.8)) / corners, rng.uniform(1, 5)) for k in range(corners)]
    return [(x + r * math.cos(t), y + r * math.sin(t)) for t, r in spokes]


def test_an_l_shape_inside_a_box_has_its_own_area(spark):
    a = spark.createDataFrame([(1, ring(box(0, 0, 10, 10)))], RING)
    b = spark.createDataFrame([(2, ring(L))], RING)
    for size in (3.0, 50.0):
        (row,) = space.correspondence(sides(a, "a"), sides(b, "b"), size).collect()
        assert (row.area, row.frac_a, row.frac_b) == pytest.approx((36, 0.36, 1))


def test_an_l_shape_of_smaller_id_leaves_the_rest(spark):
    cells = spark.createDataFrame([(1, ring(L)), (2, ring(box(0, 0, 10, 10)))], RING)
    got = {r.id: (r.a, r.disputed) for r in space.resolved(cells, 4.0).select("id", space.pieces_area(F.col("pieces")).alias("a"), "disputed").collect()}
    assert got[1] == pytest.approx((36, 0)) and got[2] == pytest.approx((64, 36))


def test_overlapping_masks_count_once(spark):
    cells = spark.createDataFrame([(1, ring(box(0, 0, 10, 10))), (2, ring(box(50, 50, 51, 51)))], RING)
    mask = spark.createDataFrame([(1, ring(box(-1, -1, 6, 11))), (2, ring(box(4, -1, 11, 11)))], RING)
    (row,) = space.clipped_to(cells, sides(mask, "b"), 7.0).collect()
    assert row.id == 1 and sum(area([(p.x, p.y) for p in q]) for q in row.pieces) == pytest.approx(100)


def test_a_hole_is_no_ground(spark):
    holed = spark.createDataFrame([(1, [ring(box(0, 0, 10, 10)), ring(box(2, 2, 6, 6)[::-1]), ring(box(3, 3, 4, 4))])], RINGS)
    tiles = spark.createDataFrame([(k, ring(box(5 * (k % 2), 5 * (k // 2), 5 * (k % 2) + 5, 5 * (k // 2) + 5))) for k in range(4)], RING)
    got = {r.id_b: r.area for r in space.correspondence(sides(holed, "a"), sides(tiles, "b"), 4.0).collect()}
    assert got == pytest.approx({0: 25 - 9 + 1, 1: 25 - 3, 2: 25 - 3, 3: 25 - 1})
    # a line across it, and one along a border of its pieces
    lines = spark.createDataFrame([(1, ring([(0, 5), (10, 5)])), (2, ring([(0, 2), (10, 2)])), (3, ring([(-5, 3.5), (3.5, 3.5), (3.5, 20)]))], RING)
    got = {r.id_a: r.length for r in space.line_correspondence(sides(lines, "a"), sides(holed, "b"), 4.0, 0.1).collect()}
    assert got == pytest.approx({1: 6, 2: 10, 3: 2 + 0.5 + 0.5 + 4})


def test_random_shapes_against_a_count_of_points(spark):
    rng = random.Random(4)
    shapes = [(k, ring(star(rng, rng.uniform(0, 20), rng.uniform(0, 20)))) for k in range(24)]
    frame = spark.createDataFrame(shapes, RING)
    step = 0.04
    xs, ys = np.meshgrid(np.arange(-6, 27, step) + step / 2, np.arange(-6, 27, step) + step / 2)

    def inside(points):
        odd = np.zeros(xs.shape, bool)
        for (x0, y0), (x1, y1) in zip(points, points[1:] + points[:1], strict=True):
            if y0 != y1:
                odd ^= ((y0 > ys) != (y1 > ys)) & (xs < (x1 - x0) * (ys - y0) / (y1 - y0) + x0)
        return odd

    grids = {k: inside(s) for k, s in shapes}
    got = {(r.id_a, r.id_b): r.area for r in space.correspondence(sides(frame, "a"), sides(frame, "b"), 3.0, 1e-6).collect()}
    for a, b in itertools.product(grids, repeat=2):
        assert got.get((a, b), 0) == pytest.approx((grids[a] & grids[b]).sum() * step**2, abs=0.35)
    assert all(got[k, k] == pytest.approx(area(s), rel=1e-9) for k, s in shapes)
    pieces = polygons.dissolved(frame.withColumn("g", F.col("id") % 2), "g", 4.0)
    for r in polygons.areas(pieces, "g").collect():
        assert r.area == pytest.approx(np.logical_or.reduce([g for k, g in grids.items() if k % 2 == r.g]).sum() * step**2, rel=0.01)
    left = {r.id: r.a for r in space.resolved(frame, 4.0).select("id", space.pieces_area(F.col("pieces")).alias("a")).collect()}
    taken = np.zeros(xs.shape, bool)
    for k, g in grids.items():
        assert left.get(k, 0) == pytest.approx((g & ~taken).sum() * step**2, abs=0.4)
        taken |= g


@pytest.mark.parametrize("most", [512, 3])
def test_union_of_boxes_by_unit_squares(spark, most):
    rng = random.Random(1)
    boxes = [(k, k % 3, *(rng.randint(-9, 9), rng.randint(-9, 9)), rng.randint(1, 6), rng.randint(1, 6)) for k in range(60)]
    frame = spark.createDataFrame([(k, g, ring(box(x, y, x + w, y + h))) for k, g, x, y, w, h in boxes], "id long, g long, shape array<struct<x:double,y:double>>")
    pieces = polygons.dissolved(frame, "g", 4.0, most=most)
    got = {r.g: r.area for r in polygons.areas(pieces, "g").collect()}
    length = {r.g: r.n for r in polygons.outline(pieces, "g").groupBy("g").agg(F.sum(F.hypot(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))).alias("n")).collect()}
    for g in range(3):
        units = {(x + i, y + j) for _, h_, x, y, w, h in boxes if h_ == g for i in range(w) for j in range(h)}
        assert got[g] == pytest.approx(len(units))
        assert length[g] == pytest.approx(sum((x + dx, y + dy) not in units for x, y in units for dx, dy in ((0, 1), (1, 0), (0, -1), (-1, 0))))


def test_outlines_of_slanted_unions_close(spark):
    rng = random.Random(9)
    frame = spark.createDataFrame([(k, ring(star(rng, rng.uniform(0, 9), rng.uniform(0, 9)))) for k in range(7)], RING).withColumn("g", F.lit("all"))
    rows = polygons.outline(polygons.dissolved(frame, "g", 2.5), "g").collect()
    # the border runs counter-clockwise, so its signed area is that of the union
    total = sum(r.x0 * r.y1 - r.x1 * r.y0 for r in rows) / 2
    assert total == pytest.approx(polygons.areas(polygons.dissolved(frame, "g", 100.0), "g").first().area, rel=1e-9)


def test_offsets_and_rings_by_formula(spark):
    r = 2.0
    disc = 32 * r**2 * math.sin(2 * math.pi / 64)
    frame = spark.createDataFrame([(1, [ring(box(0, 0, 7, 3))]), (2, [ring(box(0, 0, 20, 20)), ring(box(5, 5, 15, 15))]), (3, [ring(box(100, 0, 101, 1)), ring(box(100, 30, 101, 31))])], RINGS)
    got = {x.id: x.area for x in polygons.areas(polygons.buffered(frame, "id", r, 6.0), "id").collect()}
    assert got == pytest.approx({1: 21 + 20 * r + disc, 2: 400 + 80 * r + disc - (10 - 2 * r) ** 2, 3: 2 * (1 + 4 * r + disc)})
    places = spark.createDataFrame([("a", 3.0, 4.0)], "place string, px double, py double")
    rings = {x.ring: x.a for x in polygons.ring_polygons(places, (0, 50, 100)).select("ring", space.pieces_area(F.col("pieces")).alias("a")).collect()}
    assert rings == pytest.approx({"r0_50": disc * 625, "r50_100": disc * 1875})
    cells = polygons.mask(frame.where("id = 1"), r, 4.0)
    assert cells.agg(F.sum(space.ring_area(F.col("shape_b")))).first()[0] == pytest.approx(21 + 20 * r + disc)
    assert cells.agg(F.max(F.array_max(F.transform("shape_b", lambda p: p["x"])) - F.col("cell_x") * 4)).first()[0] <= 4 + 1e-9


def test_crossing_rings_raise_and_odd_shapes_have_no_piece(spark):
    bow = spark.createDataFrame([(1, ring([(0, 0), (4, 4), (4, 0), (0, 4)]))], RING)
    with pytest.raises(Exception, match="crosses itself"):
        polygons.decomposed(bow).collect()
    odd = spark.createDataFrame([(1, None), (2, []), (3, ring([(0, 0), (1, 1)])), (4, ring([(0, 0), (1, 0), (2, 0)])), (5, ring([(0, 0), (0, 0), (1, 0), (1, 1), (1, 1)]))], RING)
    got = {r.id: r.pieces for r in polygons.decomposed(odd).collect()}
    assert all(sum(area([(p.x, p.y) for p in q]) for q in v or ()) == (0.5 if k == 5 else 0) for k, v in got.items())
    assert [r.id for r in polygons.areas(polygons.dissolved(odd, "id", 3.0), "id").collect()] == [5]


def test_a_crowd_of_equal_and_nested_shapes_in_one_cell(spark):
    frame = spark.range(400).select((F.col("id") * 0).alias("g"), space.box_ring(F.lit(0.0), F.lit(0.0), 1 + F.col("id") % 20, 1 + F.col("id") % 15).alias("shape"))
    (row,) = polygons.areas(polygons.dissolved(frame, "g", 64.0, most=40), "g").collect()
    assert row.area == pytest.approx(len({(x, y) for k in range(400) for x in range(1 + k % 20) for y in range(1 + k % 15)}))

"""Shapes swept and cut together against the same one by one, and how the work is dealt out."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.operators import cuts, polygons, space


def box(x0, y0, x1, y1):
    return [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]


def column(shapes):
    return pa.array([None if s is None else [None if r is None else [{"x": x, "y": y} for x, y in r] for r in s] for s in shapes], pa.list_(cuts.RING))


def star(k, corners):
    rng = np.random.default_rng(k)
    t, r = np.sort(rng.uniform(0, 2 * np.pi, corners)), rng.uniform(2, 6, corners)
    return list(zip((r * np.cos(t)).tolist(), (r * np.sin(t)).tolist(), strict=True))


def test_shapes_swept_together_are_those_swept_alone():
    rng = random.Random(1)
    shapes = [None, [], [None], [[(1.0, 2.0), (2.0, 3.0)]]]
    for k in range(60):
        x, y, w, h = rng.uniform(-50, 50), rng.uniform(-50, 50), rng.randint(2, 7), rng.randint(2, 5)
        shapes.append([box(x, y, x + w, y + h), box(x + w / 4, y + h / 4, x + w * 3 / 4, y + h * 3 / 4)])
        shapes.append([[(x, y), (x + w, y), (x + w, y + 1), (x + 1, y + 1), (x + 1, y + h), (x, y + h)]])
        shapes.append([star(k, rng.randint(3, 40))])
        shapes.append([box(x, y, x + 9, y + 9)[::-1], box(x + 1, y + 1, x + 8, y + 8), box(x + 2, y + 2, x + 4, y + 3)])
    alone = lambda rings: polygons.swept(polygons.edges_of(rings), False)
    got = cuts.decomposed(column(shapes), alone).to_pylist()
    assert got == [[polygons._points(t) for t in alone([np.array(r) for r in s or () if r])] for s in shapes]
    with pytest.raises(ValueError, match="crosses"):
        cuts.decomposed(column([shapes[4], [[(0.0, 0.0), (2.0, 2.0), (2.0, 0.0), (0.0, 2.0)]]]), alone)


def test_cuts_together_are_those_of_the_columns(spark):
    rng = random.Random(3)
    pairs = []
    for k in range(40):
        x, y = rng.uniform(-4, 4), rng.uniform(-4, 4)
        ring = [[(0.0, 0.0), (4.0, 0.0), (0.0, 3.0)], box(0.0, 0.0, 3.0, 3.0)[::-1], [(0.0, 0.0)]][k % 3]
        pairs.append((k, box(x, y, x + 3, y + 2) if k % 2 else [(x, y), (x + 3, y), (x + 1, y + 3)], ring))
    df = spark.createDataFrame(pairs, f"k int, a {polygons.RING}, b {polygons.RING}")
    want = df.select("k", space.clipped_area("a", "b").alias("common"), space.difference(F.array("a"), F.col("b")).alias("rest")).orderBy("k").collect()
    a, b = (cuts.padded(column([[p[k] for p in pairs]])[0].values) for k in (1, 2))
    assert (np.abs(cuts.signed(*cuts.clipped(*a, *b))) / 2).tolist() == pytest.approx([r.common for r in want])
    row, pieces, n = cuts.difference(*a, *b)
    got = cuts.nested(row, cuts.ring_array(pieces, n), len(pairs)).to_pylist()
    assert got == [[[c.asDict() for c in p] for p in r.rest] for r in want]


def test_shapes_of_one_split_are_dealt_out(spark):
    shapes = [(k, [box(float(k), 0.0, k + 4.0, 4.0), box(k + 1.0, 1.0, k + 3.0, 3.0)]) for k in range(200)]
    df = spark.createDataFrame(shapes, f"id int, shape array<{polygons.RING}>").coalesce(1)
    found = polygons.decomposed(df).select(F.spark_partition_id().alias("task"), F.size("pieces").alias("n"))
    assert found.select("task").distinct().count() > 1 and found.agg(F.sum("n")).first()[0] == 800
    places = spark.range(200).coalesce(1).select(F.col("id").alias("place"), F.col("id").cast("double").alias("px"), F.lit(0.0).alias("py"))
    rings = polygons.ring_polygons(places, (0, 50, 100)).select(F.spark_partition_id().alias("task"), F.size("pieces").alias("n"))
    assert rings.select("task").distinct().count() > 1 and sorted({r.n for r in rings.collect()}) == [1, 64]


def test_pieces_of_a_cell_are_cut_and_turned_together():
    rings = [box(-1.0, 0.0, 3.0, 2.0)[::-1], [(1.0, 1.0), (9.0, 1.0), (1.0, 6.0)], box(5.0, 5.0, 6.0, 6.0), [(0.0, 0.0), (1.0, 1.0)]]
    edges = cuts.sides(*cuts.boxed(*cuts.padded(column([rings])[0].values), 0.0, 0.0, 4.0, 4.0))
    assert sum(polygons.signed_area(r) for r in polygons.swept(edges, True)) == pytest.approx(6 + 9 - 2)
    assert edges[:, :4].min() >= 0 and edges[:, :4].max() <= 4 and polygons.swept(cuts.sides(np.zeros((1, 4, 2)), np.array([0])), True) == []

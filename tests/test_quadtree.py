"""Nearest neighbours against brute force: clusters, far outliers, ties, odd rows; and how many pairs meet."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import quadtree

POINTS, TARGETS = "id long, x double, y double", "target long, tx double, ty double"


def brute(points, targets):
    out = {}
    for i, x, y in points:
        best = min(((np.hypot(x - a, y - b), t) for t, a, b in targets), default=(None, None))
        out[i] = best
    return out


def cluster(n, seed=1, far=20):
    """One crowded cluster, points around it, and some very far away."""
    rng = np.random.default_rng(seed)
    near = rng.normal(size=(n, 2))
    away = rng.uniform(-1e6, 1e6, size=(far, 2))
    return np.r_[near, away].round(3).tolist()


def frames(spark, points, targets):
    return spark.createDataFrame(points, POINTS), spark.createDataFrame(targets, TARGETS)


def test_nearest_against_brute_force(spark):
    targets = [(k, x, y) for k, (x, y) in enumerate(cluster(600))]
    points = [(k, x, y) for k, (x, y) in enumerate(cluster(200, seed=2))]
    got = {r.id: (r.distance, r.target) for r in quadtree.nearest(*frames(spark, points, targets)).collect()}
    want = brute(points, targets)
    assert {i: t for i, (_, t) in got.items()} == {i: t for i, (_, t) in want.items()}
    assert all(got[i][0] == pytest.approx(want[i][0]) for i in got)


def test_ties_go_to_the_smallest_target_and_odd_rows_have_none(spark):
    grid = [(100 - 10 * i - j, float(i), float(j)) for i in range(10) for j in range(10)] + [(7, 3.0, 3.0), (500, float("nan"), 0.0), (501, None, 1.0)]
    points = [(k, i + 0.5, j + 0.5) for k, (i, j) in enumerate((i, j) for i in range(9) for j in range(9))] + [(900, None, 1.0), (901, float("inf"), 1.0), (902, 3.0, 3.0)]
    got = {r.id: r.target for r in quadtree.nearest(*frames(spark, points, grid)).collect()}
    want = {i: min((round(np.hypot(x - a, y - b), 9), t) for t, a, b in grid[:-2])[1] for i, x, y in points if i not in (900, 901)}
    assert got == want | {900: None, 901: None}


def test_nothing_and_one_place(spark):
    points, none = frames(spark, [(1, 0.0, 0.0), (2, 5.0, 5.0)], [])
    assert [tuple(r)[3:] for r in quadtree.nearest(points, none).collect()] == [(None, None)] * 2
    assert quadtree.nearest(points.where("false"), spark.createDataFrame([(3, 0.0, 0.0)], TARGETS)).count() == 0
    same = spark.createDataFrame([(k, 1.0, 1.0) for k in range(200, 0, -1)], TARGETS)
    assert {r.target for r in quadtree.nearest(points, same).collect()} == {1}


def test_pairs_that_meet_grow_with_the_points(spark):
    counts = []
    for n in (500, 2000, 8000):
        points, targets = frames(spark, [(k, *p) for k, p in enumerate(cluster(n, 3, n // 25))], [(k, *p) for k, p in enumerate(cluster(n, 4, n // 25))])
        tree = quadtree.Tree(targets)
        own = tree.own(points)
        rest = points.withColumn("most", F.lit(float("inf"))).join(own.where("sure"), "id", "left_anti")
        counts.append(tree.met(rest).count() / n)
    assert counts[2] < 1.5 * counts[0] and counts[2] < 8 * quadtree.LEAF

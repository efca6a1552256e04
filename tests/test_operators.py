"""Hand-computed cases and guards of the operators."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import scalar
from tessera.operators import coverage, curves, events, graph, guards, rank, registry, space, surface


def one(df):
    return df.first().asDict()


def test_missing_boundary(spark):
    df = spark.createDataFrame([(float("nan"), " "), (0.0, "x"), (None, None)], "v double, s string")
    got = df.select(scalar.no_nan(F.col("v")).alias("v"), scalar.no_blank(F.col("s")).alias("s"), scalar.missing(F.col("v")).alias("m")).collect()
    assert [tuple(r) for r in got] == [(None, None, True), (0.0, "x", False), (None, None, True)]


def test_strict_bool_raises(spark):
    df = spark.createDataFrame([("True",), ("maybe",)], "b string")
    with pytest.raises(Exception, match="not a boolean"):
        df.select(scalar.strict_bool(F.col("b"))).collect()


def test_clock_and_classes(spark):
    df = spark.createDataFrame([("20:30", "Primary"), ("x", " "), (None, "lane"), ("19:45:10", "busway"), ("7:x", "secondary")], "k string, h string")
    got = df.select(scalar.clock_hours(F.col("k")), scalar.road_class(F.col("h"))).collect()
    assert [tuple(r) for r in got] == [(20.5, "arterial"), (None, "sin_dato"), (None, "local"), (19.75, "busway"), (None, "intermedia")]


def test_reason_precedence_and_zero_counts(spark):
    grid = spark.createDataFrame([("a", ""), ("b", "1"), ("c", "2"), ("d", "2")], "h3_index string, ubigeo string").select("*", F.lit("x").alias("distrito"), F.lit("y").alias("departamento"))
    obs = spark.createDataFrame([("d", "2", 2020, "k", 3, 0.5)], "h3_index string, ubigeo string, year int, crime_cat string, obs_geo_count long, real_coord_ratio double")
    audit = spark.createDataFrame([("2", 5, 0.4, 0.6)], "ubigeo string, n_geo int, exito_geo double, sin_coord double")
    got = {r.h3_index: r for r in coverage.build(grid, grid, obs, audit).collect()}
    assert [got[k].motivo for k in "abcd"] == ["sin_ubigeo", "sin_auditoria", "sin_registro", "observado"]
    assert got["c"].soporte_registros == 0 and got["b"].n_geo is None and got["d"].evaluable
    with pytest.raises(ValueError, match="unknown"):
        coverage.build(grid, grid.where("h3_index <> 'a'"), obs, audit)


def test_guards(spark):
    df = spark.createDataFrame([(1, 2), (1, 3)], "k int, v int")
    with pytest.raises(ValueError, match="duplicate"):
        guards.unique(df, "k")
    with pytest.raises(ValueError, match="varies"):
        guards.constant_within(df, "k", "v")
    guards.unique(df, "k", "v")


def test_mantel_haenszel_by_hand(spark):
    df = spark.createDataFrame([("x", 4, 3, 3), ("x", 2, 4, 1), ("y", 1, 0, 2)], "w string, a long, c long, nc long")
    got = {r.w: r for r in events.rate_ratio(df, "w").collect()}
    assert got["x"].rr == pytest.approx((4 * 3 / 4 + 2 * 1 / 2) / (3 / 4 + 4 / 2), abs=1e-6)
    assert got["y"].rr is None and got["y"].with_controls == 1


def test_windows_cross_midnight_and_are_half_open(spark):
    strata = spark.createDataFrame([(0, 1, 23.0, 8)], "stadium int, day int, kh double, ctrl_day int")
    hits = spark.createDataFrame([(0, 24 + 23.0), (0, 48 + 1.5), (0, 48 + 2.0), (0, 8 * 24 + 23.5)], "stadium int, t double")
    got = one(events.window_counts(strata, hits, [("w", 0, 3)]))
    assert (got["a"], got["c"], got["nc"]) == (2, 1, 1)


def test_crosswalk_later_rule_wins(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "k string")
    got = df.select(events.category(F.col("k"), F.col("k"), F.col("k"), [(F.col("k") == "a", "first"), (F.col("k").isin("a", "b"), "second")])).collect()
    assert [r[0] for r in got] == ["second", "second", None]


def test_bootstrap_is_stable_and_holds_the_estimate(spark):
    df = spark.createDataFrame([("w", a, c, 3) for a, c in ((3, 2), (4, 5), (1, 3), (6, 4)) * 10], "w string, a long, c long, nc long")
    a, b = one(events.bootstrap(df, "w", 400)), one(events.bootstrap(df.repartition(3), "w", 400))
    assert a == b and a["lo"] < one(events.rate_ratio(df, "w"))["rr"] < a["hi"]


def test_bootstrap_intervals_are_those_of_drawn_strata(spark):
    rng = np.random.default_rng(8)
    rows = [(k % 3, int(rng.poisson(3)), int(rng.poisson(9)), int(rng.integers(1, 5))) for k in range(3000)]
    got = {r.w: (r.lo, r.hi, r.finite) for r in events.bootstrap(spark.createDataFrame(rows, "w int, a long, c long, nc long"), "w", 2000).collect()}
    for w in range(3):
        a, c, nc = np.array([r[1:] for r in rows if r[0] == w], float).T
        times = rng.multinomial(len(a), np.full(len(a), 1 / len(a)), 2000)
        lo, hi = np.percentile((times @ (a * nc / (1 + nc))) / (times @ (c / (1 + nc))), [2.5, 97.5])
        assert got[w] == (pytest.approx(lo, rel=0.01), pytest.approx(hi, rel=0.01), 2000)


def test_bootstrap_of_groups_without_controls_is_missing(spark, monkeypatch):
    monkeypatch.setattr(events, "GROUPS_HELD", 1)
    rows = [("none", 0, 0, 3), ("bare", 2, 0, 1), ("rare", 1, 1, 1), *[("full", 2, 3, 2)] * 50]
    got = {r.w: (r.lo is None, r.finite) for r in events.bootstrap(spark.createDataFrame(rows, "w string, a long, c long, nc long"), "w", 200).collect()}
    assert got["none"] == got["bare"] == (True, 0) and got["full"] == (False, 200) and 0 < got["rare"][1] < 200


def test_excess_of_nothing_is_zero_in_any_order(spark):
    rows = [("w", 1, 1, 3), ("w", 0, 1, 3), ("w", 0, 1, 3), ("w", 1, 5, 6), ("w", 0, 1, 6)] * 7
    for n in (1, 4):
        r = events.rate_ratio(spark.createDataFrame(rows, "w string, a long, c long, nc long").repartition(n), "w").first()
        assert r.expected == 14 and math.copysign(1, r.excess) == 1 and r.excess == 0


def test_ranks_with_ties_and_missing(spark):
    df = spark.createDataFrame([(1, 5.0), (2, 5.0), (3, 1.0), (4, None)], "k int, v double")
    got = {r.k: r for r in rank.with_ranks(df, "v", best="b", average="m", percentile="p").collect()}
    assert (got[1].b, got[2].b, got[3].b, got[4].b) == (1, 1, 3, None)
    assert got[1].m == 2.5 and got[3].p == pytest.approx(100 / 3)
    assert [r.k for r in rank.top(df, "v", "k", 9).orderBy("rango").collect()] == [1, 2, 3]


def test_value_ranks_match_a_full_sort(spark):
    random.seed(1)
    values = [random.choice([random.random(), 0.5, 1e9 * random.random()]) for _ in range(3000)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for r in rank.value_ranks(df, "v").collect():
        assert (r.below, r.n, r.total) == (sum(x < r.v for x in values), values.count(r.v), 3000)


def test_constant_column_is_a_half(spark):
    df = spark.createDataFrame([(1.0,), (1.0,), (None,)], "v double")
    assert [r.norm for r in rank.normalised(df, "v").orderBy("v").collect()] == [None, 0.5, 0.5]


def test_floor_interpolates_and_clamps(spark):
    df = spark.createDataFrame([("c", 0.0, 1.0), ("c", 0.5, 0.8), ("c", 1.0, 0.4)], "curva string, rate double, v double")
    got = {r.tau: r.piso for r in curves.floors(df, "v", [0.1, 0.4, 0.9]).collect()}
    assert got == {0.1: 0.25, 0.4: 0.75, 0.9: 1.0}
    with pytest.raises(ValueError, match="monotone"):
        curves.verify_falling(df.withColumn("v", -F.col("v")), "v")


def test_single_seed_has_no_deviation(spark):
    df = spark.createDataFrame([("c", 0.1, 1, 1.0, 2.0, 0.5, True)], "curva string, rate double, seed int, medible double, real double, persist double, feat_gana boolean")
    got = one(curves.aggregated(curves.by_seed(df)))
    assert got["medible_sd"] is None and got["brecha_mean"] == 1.0


def test_shares_sum_to_a_hundred(spark):
    df = spark.createDataFrame([("a", 1.0, 3.0), ("b", 3.0, 1.0)], "crime_cat string, observado double, latente double")
    got = surface.composition(df).collect()
    assert sum(r.share_observado for r in got) == pytest.approx(100)


def brute_betweenness(arcs):
    nodes = sorted({x for a in arcs for x in a[:2]})
    out = {}
    for u, v, w in arcs:
        if u != v:
            out[u, v] = min(w, out.get((u, v), math.inf))
    score, on_arc = dict.fromkeys(nodes, 0.0), dict.fromkeys(out, 0.0)
    for s, t in itertools.permutations(nodes, 2):
        best, found, todo = math.inf, [], [((s,), 0)]
        while todo:
            path, far = todo.pop()
            if far > best:
                continue
            if path[-1] == t:
                found = [path] if far < best else [*found, path]
                best = far
                continue
            todo += [((*path, b), far + w) for (a, b), w in out.items() if a == path[-1] and b not in path]
        for path in found:
            for x in path[1:-1]:
                score[x] += 1 / len(found)
            for e in itertools.pairwise(path):
                on_arc[e] += 1 / len(found)
    n = len(nodes)
    return {k: v / ((n - 1) * (n - 2)) for k, v in score.items()}, {k: v / (n * (n - 1)) for k, v in on_arc.items()}


@pytest.mark.parametrize("seed", [1, 2])
def test_betweenness_against_all_paths(spark, seed, monkeypatch):
    random.seed(seed)
    arcs = [(random.choice("abcdefg"), random.choice("abcdefg"), random.randint(1, 3)) for _ in range(22)]
    df = spark.createDataFrame([(u, v, 0, w) for u, v, w in arcs], "u string, v string, key int, length long")
    nodes, edges = brute_betweenness(arcs)
    got, on = graph.betweenness(df, "length")
    assert {r.node: pytest.approx(r.bc) for r in got.collect()} == {k: v for k, v in nodes.items() if any(k in a[:2] and a[0] != a[1] for a in arcs)}
    assert {(r.u, r.v): pytest.approx(r.bc) for r in on.collect()} == edges
    full = graph.betweenness(df, "length", len(nodes))[0]
    want = {r.node: pytest.approx(r.bc) for r in got.collect()}
    assert {r.node: r.bc for r in full.collect()} == want
    if seed == 1:  # the same without arrays of the graph in the tasks
        near = {r.node: pytest.approx(r.closeness) for r in graph.closeness(df, "length").collect()}
        monkeypatch.setattr(graph, "TASK_ARCS", 0)
        got, on = graph.betweenness(df, "length")
        assert {r.node: r.bc for r in got.collect()} == want and {(r.u, r.v): pytest.approx(r.bc) for r in on.collect()} == edges
        assert {r.node: r.closeness for r in graph.closeness(df, "length").collect()} == near


def test_closeness_towards_the_node(spark):
    df = spark.createDataFrame([("a", "b", 0, 1), ("b", "c", 0, 2), ("c", "a", 0, 4), ("c", "d", 0, 1)], "u string, v string, key int, length long")
    got = {r.node: r.closeness for r in graph.closeness(df, "length").collect()}
    assert got == {"a": pytest.approx(2 / (4 + 6)), "b": pytest.approx(2 / (1 + 5)), "c": pytest.approx(2 / (2 + 3))}


def test_segment_keys_are_textual_and_parallels_tie_to_the_smallest(spark):
    df = spark.createDataFrame([("9", "10", 0, 5), ("10", "9", 0, 5), ("10", "9", 1, 5)], "u string, v string, key int, length long")
    segments = graph.segments(df)
    assert sorted(r.tramo_id for r in segments.collect()) == ["10-9-0", "10-9-1"]
    bc = spark.createDataFrame([("9", "10", 0.25), ("10", "9", 0.5)], "u string, v string, bc double")
    assert {r.tramo_id: r.bc for r in graph.to_segments(bc, segments).collect()} == {"10-9-0": 0.75, "10-9-1": 0.0}


def test_grid_orientation_is_one_and_even_is_zero(spark):
    grid = spark.createDataFrame([(1.0, 0.0, 1.0), (0.0, 1.0, 1.0)], "dx double, dy double, length double")
    assert one(graph.orientation_order(graph.orientation_histogram(grid, "length")))["phi"] == pytest.approx(1)
    even = spark.createDataFrame([(math.sin(math.radians(10 * k)), math.cos(math.radians(10 * k)), 1.0) for k in range(36)], "dx double, dy double, length double")
    assert one(graph.orientation_order(graph.orientation_histogram(even, "length")))["phi"] == pytest.approx(0, abs=1e-6)


def test_utm_central_meridian_and_scale(spark):
    df = spark.createDataFrame([(0.0, -75.0), (-12.0, -75.0), (-12.046374, -77.042793)], "lat double, lng double")
    got = df.select(*space.utm18s(F.col("lat"), F.col("lng"))).collect()
    assert got[0][0] == pytest.approx(500000) and got[0][1] == pytest.approx(10000000)
    assert got[1][1] == pytest.approx(10000000 - 0.9996 * 1326968.26, abs=700) and 270000 < got[2][0] < 285000


def test_clipped_area_of_a_diamond_and_mass(spark):
    df = spark.createDataFrame([(1,)], "k int").select(
        F.expr("array(named_struct('x', 1d, 'y', 0d), named_struct('x', 2d, 'y', 1d), named_struct('x', 1d, 'y', 2d), named_struct('x', 0d, 'y', 1d))").alias("shape_a"),
        space.box_ring(F.lit(0), F.lit(0), F.lit(1), F.lit(1)).alias("shape_b"),
    )
    assert one(df.select(space.clipped_area("shape_a", "shape_b").alias("a")))["a"] == pytest.approx(0.5)
    assert one(df.select(space.ring_area(F.col("shape_a")).alias("a")))["a"] == pytest.approx(2)
    assert one(df.select(space.in_ring(F.lit(1.0), F.lit(1.0), F.col("shape_a")).alias("i")))["i"]


def test_hexagons_tile_the_plane(spark):
    random.seed(3)
    pts = spark.createDataFrame([(k, random.uniform(-99, 99), random.uniform(-99, 99)) for k in range(500)], "k int, x double, y double")
    q, r = space.hex_axial(F.col("x"), F.col("y"), 7.0)
    inside = pts.select(space.in_ring(F.col("x"), F.col("y"), space.hex_ring(q, r, 7.0)).alias("i"))
    assert inside.where("not i").count() == 0


def test_registry_policies_rounding_and_no_churn(spark):
    numbers = spark.createDataFrame([("cover", "all", 2.675, "%", "s1", "old"), ("other", "x", 1.5, "", "s2", "old")], "family string, variant string, value double, unit string, script string, script_sha string")
    policies = spark.createDataFrame([("*", 0, "floor", "none"), ("cov*", 1, "half_even", "all"), ("cover", 2, "half_up", "all")], "pattern string, decimals int, mode string, variant_canonical string")
    old = registry.emitted(numbers, policies)
    got = {r.key: r for r in old.collect()}
    assert got["cover.all"].shown == "2.68" and got["cover.all"].canonical and got["other.x"].shown == "1"
    new = registry.emitted(numbers.withColumn("script_sha", F.lit("new")).withColumn("value", F.when(F.col("family") == "other", 7.0).otherwise(F.col("value"))), policies)
    merged = {r.key: r.script_sha for r in registry.merged(old, new).collect()}
    assert merged == {"cover.all": "old", "other.x": "new"}
    texts = [
        ("a CANON: cover.all = ~2.68 b CANON: cover.all=2.7", ["ok", "mismatch"]), ("CANON: nope = 1", ["unknown"]), ("CANON: cover = 2.68", ["ok"]), ("CANON: other.x = 1", ["not_canonical"]),
        ("CANON: other.x = 1 variant-ok", ["ok"]), ("CANON: cover.all = 2.680", ["too_precise"]), ("CANON: cover.all = 3,5", ["unreadable"]), ("canon cover.all = 2", []), ("canon of a kind", []),
    ]
    lines = spark.createDataFrame([("f", k, t) for k, (t, _) in enumerate(texts)], "file string, line int, text string")
    got = sorted((r.line, r.verdict) for r in registry.checked(registry.anchors(lines), old).collect())
    assert got == sorted((k, v) for k, (_, x) in enumerate(texts) for v in x)
    assert [r.line for r in registry.malformed(lines).collect()] == [7]
    aged = registry.checked(registry.anchors(lines.where("line = 2")), old, old.select("key"))
    assert [r.verdict for r in aged.collect()] == ["stale"]
    numbers = spark.createDataFrame([("f", 0, "x 1.5"), ("f", 1, "CANON: a = 1"), ("f", 2, "2.5"), ("f", 3, "plain 7"), ("f", 4, "~ 3.25")], "file string, line int, text string")
    assert [r.line for r in registry.audit(numbers).collect()] == [4]


def test_policy_patterns_take_only_stars_for_any_text(spark):
    policies = spark.createDataFrame([("r_pooled.*", 1, "half_up", "v")], "pattern string, decimals int, mode string, variant_canonical string")
    entries = spark.createDataFrame([("r_pooled.x", "v", 1.0), ("rXpooled.x", "v", 1.0), ("r_pooledZx", "v", 1.0)], "family string, variant string, value double")
    assert {r.family: r.decimals for r in registry.with_policy(entries, policies).collect()} == {"r_pooled.x": 1, "rXpooled.x": None, "r_pooledZx": None}


@pytest.mark.parametrize(("decimals", "want"), [(9, "0.000000990"), (0, "0"), (12, "0.000000990000")])
def test_small_values_keep_their_decimals(spark, decimals, want):
    df = spark.createDataFrame([(9.9e-7, decimals, "half_up")], "v double, d int, m string")
    assert df.select(registry.rounded(F.col("v"), F.col("d"), F.col("m"))).first()[0] == want


def test_projection_known_point_and_guard(spark):
    df = spark.range(1).select(F.lit(-12.0464).alias("lat"), F.lit(-77.0428).alias("lng"))
    x, y = space.utm18s(F.col("lat"), F.col("lng"))
    back = space.from_utm18s(x, y)
    r = df.select(x, y, *back).first()
    # the centre of Lima, from public tables of the zone
    assert abs(r[0] - 277_600) < 300 and abs(r[1] - 8_667_500) < 500
    assert abs(r[2] + 12.0464) < 1e-9 and abs(r[3] + 77.0428) < 1e-9
    assert space.metric("EPSG:32718") == "EPSG:32718"
    for wrong in (None, "EPSG:4326"):
        with pytest.raises(ValueError, match="32718"):
            space.metric(wrong)


def test_densest_disc_before_density(spark):
    rows = [(0, 0, k) for k in range(5)] + [(9, 9, k) for k in range(4)] + [(1, 1, 0), (1, 0, 0), (1, 0, 1), (3, 0, 0)]
    got = space.densest_disc(spark.createDataFrame(rows, "q long, r long, id long"), 3).collect()
    assert [tuple(r) for r in got] == [(0, 0, 5), (1, 0, 2), (1, 1, 1)]


def test_quantiles_against_numpy(spark):
    values = [float(x) for x in np.random.default_rng(3).integers(0, 40, 301)]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
    r = surface.quantiles(df, "v").first()
    assert np.allclose([r.p50, r.p500, r.p950, r.p995], np.quantile(values, [0.05, 0.5, 0.95, 0.995]), atol=1e-6)
    assert surface.quantiles(df.where("v < 0"), "v").first().p500 is None
    assert surface.quantiles(df.limit(0).union(spark.createDataFrame([(7.0,)], "v double")), "v").first().p995 == 7.0


def test_stage_counts_meet_the_registry(spark):
    entries = spark.createDataFrame([("tramos", "3")], "key string, shown string")
    assert guards.same_count(spark.range(3), entries, "tramos").count() == 3
    for rows, key in ((4, "tramos"), (3, "nodos")):
        with pytest.raises(ValueError, match="earlier stages"):
            guards.same_count(spark.range(rows), entries, key)


def test_segments_keep_the_first_direction(spark):
    arcs = spark.createDataFrame([("b", "a", 0, 5.0, "back"), ("a", "b", 0, 7.0, None)], "u string, v string, key int, length double, name string")
    assert tuple(graph.segments(arcs, ("name",)).first()) == ("a-b-0", "a", "b", 0, 5.0, None)
    assert tuple(graph.segments(arcs.where("u = 'b'"), ("name",)).first()) == ("a-b-0", "a", "b", 0, 5.0, "back")


def test_any_number_of_decimals_is_rounded_once(spark):
    import decimal

    rng = random.Random(7)
    values = [0.0, -0.0, 12.5, 0.1, 2.5, -2.5, 9.9e-7, 1e22, 123456789.123456789, -0.05, 0.045, 99.95, -99.995, 1.0e-300, 5e-324, *[rng.uniform(-1, 1) * 10 ** rng.randint(-9, 9) for _ in range(40)]]
    modes = {"half_up": decimal.ROUND_HALF_UP, "half_even": decimal.ROUND_HALF_EVEN, "floor": decimal.ROUND_FLOOR}
    rows = [(v, d, m) for v in values for d in (0, 1, 2, 5, 14, 20) for m in modes]
    got = spark.createDataFrame(rows, "v double, d int, m string").select("v", "d", "m", F.col("v").cast("string").alias("t"), registry.rounded(F.col("v"), F.col("d"), F.col("m")).alias("r")).collect()
    with decimal.localcontext() as ctx:
        ctx.prec = 400
        for r in got:
            want = decimal.Decimal(r.t).quantize(decimal.Decimal(1).scaleb(-r.d), rounding=modes[r.m])
            assert r.r == f"{abs(want) if want == 0 else want:f}", (r.v, r.d, r.m)
    assert spark.createDataFrame([(float("nan"), 2, "half_up"), (None, 2, "half_up")], "v double, d int, m string").select(registry.rounded(F.col("v"), F.col("d"), F.col("m")).alias("r")).collect() == [(None,), (None,)]


def test_raises_of_rates_ladders_and_joins(spark):
    rows = spark.createDataFrame([("a", 3.0, True, 5.0), ("b", 1.0, False, 5.0)], "id string, v double, f boolean, l double")
    with pytest.raises(Exception, match="no base rate"):
        rank.base_rate(rows.where("false"), "f", "l").collect()
    assert rank.fitting(rows, (5, 2, 1, 0)) == (1, 2) and rank.precision_at(rows, "v", "id", "f", 1).first().precision == 1
    for call in (lambda: rank.fitting(rows, (3, 0)), lambda: rank.precision_at(rows, "v", "id", "f", 3), lambda: rank.reached(rows, 0)):
        with pytest.raises(ValueError):
            call()
    bc = spark.createDataFrame([("a", 0.5), ("b", 0.25)], "id string, bc double")
    assert {r.id: r.bc for r in rank.united(rows, bc, "id", ("bc",)).collect()} == {"a": 0.5, "b": 0.25}
    for wrong, columns in ((bc.where("id = 'a'"), ("bc",)), (bc.union(bc), ("bc",)), (bc, ("other",))):
        with pytest.raises(ValueError):
            rank.united(rows, wrong, "id", columns)
    shares = spark.createDataFrame([(1, 0.6), (1, 0.5)], "id_b long, frac_b double")
    assert space.whole_shares(shares.limit(1)).count() == 1
    with pytest.raises(ValueError, match="more than 1"):
        space.whole_shares(shares)


def test_cleaning_keeps_its_order(spark):
    # 3 reports at one spot, of which one alone has the wanted category: the pile-up is seen before the category is
    at = 1546387200000  # 2019-01-02 00:00 UTC, 19:00 of the day before in Lima
    spot = [(1, "2019", "con coordenada", "-12.1", "-77.0", "c", at, kind) for kind in ("robo", "estafa", "estafa")]
    rows = [*spot, (1, "2019", "CON COORDENADA", "-12.2", "-77.0", "c", at, "robo"), (1, "2019", "SIN", "-12.3", "-77.0", "c", at, "robo"), (1, "x", "CON COORDENADA", "-12.4", "-77.0", "c", at, "robo"), (0, "2019", "CON COORDENADA", "-12.5", "-77.0", "c", at, "robo")]
    rows += [(1, "2019", "CON COORDENADA", "-12.6", "-77.0", "elsewhere", at, "robo"), (1, "2019", "CON COORDENADA", "-12.7", "-77.0", "c", at + 5 * 3600000, "robo"), (1, "2019", "CON COORDENADA", "-12.8", "-77.0", "c", at, None)]
    raw = spark.createDataFrame(rows, "flag int, year string, located string, lat string, lng string, cell string, at_ms long, kind string")
    rules = [(F.col("kind") == "robo", "street"), (F.col("kind") == "estafa", "fraud")]
    got = events.cleaned(raw, rules, (2019, 2023), (-13.0, -78.0, -12.0, -76.0), 2, spark.createDataFrame([("c",)], "cell string"), "America/Lima", "street").collect()
    assert sorted((r.lat, r.hour, r.midnight) for r in got) == [(-12.7, 0.0, True), (-12.2, 19.0, False)]
    files = {"liga": spark.createDataFrame([("s", "2024-01-03", "19:30"), ("s", "2024-01-03", "19:30"), ("s", "2024-01-04", None), ("s", "2024-01-05", "late")], "stadium string, date string, kickoff string")}
    files["extra"] = spark.createDataFrame([("s", "cup", "2024-01-02", "20:15"), ("s", "concert", "2024-01-02", "21:00")], "stadium string, event string, date string, kickoff string")
    assert sorted(map(tuple, events.kickoffs(files, ("liga", "cup"), "2024-01-01").collect())) == [("s", "cup", 1, 20.25), ("s", "liga", 2, 19.5)]


def test_small_functions_by_hand(spark):
    row = spark.createDataFrame([([7, 8], [], "50 mph", "none", 40.0, 7000.0, 2.0, 10.0)], "a array<int>, e array<int>, t string, u string, lo double, ext double, obs double, lat_ double")
    got = row.select(
        scalar.first_of(F.col("a")).alias("a"), scalar.first_of(F.col("e")).alias("e"), scalar.leading_number(F.col("t")).alias("t"), scalar.leading_number(F.col("u")).alias("u"),
        scalar.scale_bar(F.col("ext")).alias("bar"), scalar.scale_bar(F.col("lo")).alias("ten"), scalar.blend(F.col("obs"), F.col("lat_"), 0.25).alias("mix"),
    ).first()
    assert tuple(got) == (7, None, 50.0, None, 1000.0, 10.0, 4.0)
    assert scalar.downcast(row).dtypes[4:] == [(n, "float") for n in ("lo", "ext", "obs", "lat_")] and scalar.downcast(row).dtypes[2] == ("t", "string")
    curve = spark.createDataFrame([(0.1,), (0.25,)], "rate double")
    assert curves.measured_level(curve, 0.2504).first()[0] and not curves.measured_level(curve, 0.2).first()[0]
    nodes = spark.createDataFrame([(5, 1.0, 2.0, 3, "more")], "node_id long, x double, y double, street_count int, other string")
    assert graph.intersections(nodes).first().asDict() == {"node_id": "5", "x": 1.0, "y": 2.0, "street_count": 3}
    east, north = spark.range(1).select(*space.equirectangular(F.lit(-11.99), F.lit(-76.99), -12.0, -77.0)).first()
    assert north == pytest.approx(1111.95, abs=0.1) and east == pytest.approx(1111.95 * math.cos(math.radians(12)), abs=0.1)
    square = lambda s: [(0.0, 0.0), (s, 0.0), (s, s), (0.0, s)]
    cells = spark.createDataFrame([(1, [square(1.0), square(3.1234567)]), (2, [])], "id long, pieces array<array<struct<x:double,y:double>>>")
    assert [tuple(r) for r in space.coordinate_lists(cells).collect()] == [(1, [0.0, 3.123457, 3.123457, 0.0], [0.0, 0.0, 3.123457, 3.123457])]


@pytest.mark.parametrize("most", [None, 3, 0])
def test_betweenness_with_nodes_that_lead_nowhere(spark, most, monkeypatch):
    """Arcs to dead ends, ties among them, a source beside the inner graph; in the tasks, half in them, and by joins."""
    random.seed(4)
    arcs = [(random.choice("abcd"), random.choice("abcdwxyz"), random.randint(1, 2)) for _ in range(26)] + [("s", "x", 1), ("s", "y", 2)]
    df = spark.createDataFrame([(u, v, 0, w) for u, v, w in arcs], "u string, v string, key int, length long")
    nodes, edges = brute_betweenness(arcs)
    inner = {(u, v) for u, v in edges if v in {e[0] for e in edges}}
    if most is not None:
        monkeypatch.setattr(graph, "TASK_ARCS", len(inner) if most else 0)
    dealt, kept = [], graph._by_sources
    monkeypatch.setattr(graph, "_by_sources", lambda ends, sources, *a: dealt.append((ends.count(), sources.count())) or kept(ends, sources, *a))
    got, on = graph.betweenness(df, "length")
    assert {r.node: pytest.approx(r.bc) for r in got.collect()} == nodes
    assert {(r.u, r.v): pytest.approx(r.bc) for r in on.collect()} == edges
    assert dealt == {None: [(len(edges), 5)], 3: [(len(inner), 4)] * 2, 0: []}[most]


def test_closeness_reads_its_arcs_once(spark):
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    rows = [("a", "b", 0, 1), ("b", "c", 0, 2), ("c", "a", 0, 4), ("c", "d", 0, 1), ("d", "d", 0, 1)]
    df = spark.createDataFrame(rows, "u string, v string, key int, length long")
    got = {r.node: r.closeness for r in graph.closeness(df.mapInArrow(counted, df.schema), "length").collect()}
    assert got == {"a": pytest.approx(2 / (4 + 6)), "b": pytest.approx(2 / (1 + 5)), "c": pytest.approx(2 / (2 + 3))}
    assert read.value == len(rows)


@pytest.mark.parametrize("most", [None, 0])
def test_clustering_looks_pairs_up_and_moves_none(spark, most, monkeypatch):
    random.seed(3)
    pairs = {(random.randint(0, 30), random.randint(0, 30)) for _ in range(160)} | {(0, k) for k in range(1, 31)}
    if most is not None:
        monkeypatch.setattr(graph, "TASK_ARCS", most)
    dealt, kept = [], graph._by_sources
    monkeypatch.setattr(graph, "_by_sources", lambda *a: dealt.append(1) or kept(*a))
    got = graph.clustering(spark.createDataFrame([(str(u), str(v)) for u, v in pairs], "u string, v string"))
    edges = {frozenset(p) for p in pairs if len(set(p)) == 2}
    near = {k: {x for e in edges if k in e for x in e} - {k} for k in range(31)}
    each = [2 * sum(frozenset(p) in edges for p in itertools.combinations(n, 2)) / (len(n) * (len(n) - 1)) if len(n) > 1 else 0 for n in near.values() if n]
    assert one(got) == {"nodes": len(each), "clustering": pytest.approx(sum(each) / len(each), abs=1e-6)}
    # the pairs of a node's neighbours are rows of a join only if the edges that close them do not fit
    assert len(dealt) == (0 if most == 0 else 1)


def test_triangles_in_slices(monkeypatch):
    import numpy as np
    import pyarrow as pa

    monkeypatch.setattr(graph, "BLOCK_CELLS", 16)
    rng = np.random.default_rng(2)
    directed = [(a, b) for a in range(40) for b in range(a + 1, 40) if rng.random() < 0.4]
    of = {a: [b for x, b in directed if x == a] for a in range(40)}
    rows = pa.record_batch({"at": pa.array([a for a in of if of[a]], pa.int32()), "a": pa.array([b for b in of.values() if b], pa.list_(pa.int32()))})
    ends = np.array(directed, np.int32)
    got = {x["at"]: x["t"] for batch in graph._triangles([ends[:, 0], ends[:, 1], None], iter([rows])) for x in batch.to_pylist()}
    want = {}
    for a, b, c in itertools.combinations(range(40), 3):
        if {(a, b), (a, c), (b, c)} <= set(directed):
            for x in (a, b, c):
                want[x] = want.get(x, 0) + 1
    assert got == want

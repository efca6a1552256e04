"""Queries of the event, graph and space operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import events as ev
from tessera.operators import graph, quadtree, space
from tessera.plans import standins as st

# --- events: place = user_id % 3, crowd day = purchases at or above the CROWD quantile of the place's days, incident = an error ---

CROWD, FIRST, DAYS = 0.8, "2024-01-01", 30
WINDOWS = [(f"w{lo:+d}", float(lo), float(lo + 3)) for lo in range(-12, 13, 3)]


def _incidents(spark, d):
    e = st.table(spark, d, "events").where("event_type = 'error'")
    t = F.datediff(F.to_date("ts"), F.lit(FIRST)) * 24 + F.hour("ts") + F.minute("ts") / 60
    return e.select((F.col("user_id") % 3).cast("int").alias("stadium"), t.cast("double").alias("t"))


def _crowds(spark, d):
    e = st.table(spark, d, "events").where("event_type = 'purchase'")
    day = F.datediff(F.to_date("ts"), F.lit(FIRST))
    got = e.groupBy((F.col("user_id") % 3).cast("int").alias("stadium"), day.alias("day")).agg(F.count("*").alias("n"), F.min(F.hour("ts")).cast("double").alias("kh"))
    # days without a purchase count in the quantile; a place has DAYS rows here at any size
    all_days = _place_days(spark).join(got, ["stadium", "day"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    least = all_days.groupBy("stadium").agg(F.percentile("n", F.lit(CROWD)).alias("least"))
    return all_days.join(least, "stadium").where("n >= least and n > 0").select("stadium", "day", "kh")


def _place_days(spark):
    return ev.calendar(spark, FIRST, DAYS).withColumn("stadium", F.explode(F.array(*[F.lit(k) for k in range(3)])))


def _strata(spark, d):
    places = spark.range(3).select(F.col("id").cast("int").alias("stadium"))
    near = places.where("stadium = 0").select("stadium", F.lit(1).alias("other"))
    crowds = _crowds(spark, d)
    return ev.matched_strata(_place_days(spark), crowds, ev.contaminated(crowds, near))


INCIDENTS = f"incidents AS (SELECT (user_id % 3)::INTEGER AS stadium, date_diff('day', DATE '{FIRST}', ts::DATE) * 24 + hour(ts) + minute(ts) / 60.0 AS t FROM events WHERE event_type = 'error')"
STRATA = f"""bought AS (
  SELECT (user_id % 3)::INTEGER AS stadium, date_diff('day', DATE '{FIRST}', ts::DATE)::INTEGER AS day, min(hour(ts))::DOUBLE AS kh, count(*) AS n FROM events WHERE event_type = 'purchase' GROUP BY 1, 2),
every AS (SELECT s::INTEGER AS stadium, k::INTEGER AS day, kh, coalesce(n, 0) AS n FROM range(3) a(s) CROSS JOIN range({DAYS}) b(k) LEFT JOIN bought ON stadium = s AND day = k),
crowds AS (SELECT stadium, day, kh FROM every JOIN (SELECT stadium, quantile_cont(n, {CROWD}) AS least FROM every GROUP BY stadium) q USING (stadium) WHERE n >= least AND n > 0),
days AS (SELECT s::INTEGER AS stadium, k::INTEGER AS day, (isodow(DATE '{FIRST}' + k::INTEGER) - 1)::INTEGER AS dow, (year(DATE '{FIRST}' + k::INTEGER) * 12 + month(DATE '{FIRST}' + k::INTEGER))::INTEGER AS ym FROM range(3) a(s), range({DAYS}) b(k)),
spoilt AS (SELECT DISTINCT 0 AS stadium, day FROM crowds WHERE stadium = 1),
controls AS (SELECT * FROM days d WHERE NOT EXISTS (SELECT 1 FROM crowds c WHERE c.stadium = d.stadium AND c.day = d.day) AND NOT EXISTS (SELECT 1 FROM spoilt p WHERE p.stadium = d.stadium AND p.day = d.day)),
strata AS (SELECT d.stadium, d.day, c.kh, k.day AS ctrl_day FROM days d JOIN crowds c ON c.stadium = d.stadium AND c.day = d.day JOIN controls k ON k.stadium = d.stadium AND k.ym = d.ym AND k.dow = d.dow AND k.day <> d.day),
looks AS (SELECT DISTINCT stadium, day, kh, day AS at_day, true AS treated FROM strata UNION ALL SELECT stadium, day, kh, ctrl_day, false FROM strata),
sizes AS (SELECT stadium, day, any_value(kh) AS kh, count(*) AS nc FROM strata GROUP BY 1, 2)"""


def _counted(windows) -> str:
    rows = ", ".join(f"('{n}', {lo}, {hi})" for n, lo, hi in windows)
    return f"""{INCIDENTS}, {STRATA}, w(win, lo, hi) AS (VALUES {rows}),
    hits AS (SELECT win, l.stadium, l.day, count(*) FILTER (WHERE treated) AS a, count(*) FILTER (WHERE NOT treated) AS c FROM looks l, w, incidents i
      WHERE i.stadium = l.stadium AND i.t >= l.at_day * 24 + kh + lo AND i.t < l.at_day * 24 + kh + hi GROUP BY 1, 2, 3),
    counts AS (SELECT w.win AS "window", s.stadium, s.day, coalesce(a, 0) AS a, coalesce(c, 0) AS c, nc FROM sizes s CROSS JOIN w LEFT JOIN hits h ON h.win = w.win AND h.stadium = s.stadium AND h.day = s.day)"""


_RR = """round(CASE WHEN sum(c / (1.0 + nc)) > 0 THEN sum(a * nc / (1.0 + nc)) / sum(c / (1.0 + nc)) END, 6) AS rr, count(*) AS strata, count(*) FILTER (WHERE a > 0) AS with_events,
  count(*) FILTER (WHERE nc > 0) AS with_controls, sum(a)::BIGINT AS observed, round(_EXPECTED / 1e18, 6) + 0.0 AS expected, round((sum(a)::HUGEINT * 1000000000000000000 - _EXPECTED) / 1e18, 6) + 0.0 AS excess""".replace(
    # whole numbers of 10**-18: the sum is the same in any order
    "_EXPECTED", "sum(c::HUGEINT * 1000000000000000000 // greatest(nc, 1))::HUGEINT"
)
DOOR = [("door", -1.0, 2.0)]


def event_calendar(spark, d):
    days = ev.calendar(spark, FIRST, DAYS)
    busy = _crowds(spark, d).groupBy("day").agg(F.count("*").alias("crowds"))
    return days.join(busy, "day", "left").select("day", F.col("date").cast("string").alias("date"), "dow", "ym", F.coalesce("crowds", F.lit(0)).alias("crowds"))


def matched_strata(spark, d):
    return _strata(spark, d)


def window_counts(spark, d):
    return ev.window_counts(_strata(spark, d), _incidents(spark, d), DOOR)


def complement_counts(spark, d):
    return ev.complement_counts(_strata(spark, d), _incidents(spark, d), -1.0, 2.0)


def mh_rate_ratio(spark, d):
    return ev.rate_ratio(ev.window_counts(_strata(spark, d), _incidents(spark, d), DOOR), "stadium")


def event_profile(spark, d):
    hours = [(f"h{k:+03d}", float(k), float(k + 1)) for k in ev.OFFSETS]
    return ev.rate_ratio(ev.window_counts(_strata(spark, d), _incidents(spark, d), hours), "window")


def moving_estimate(spark, d):
    hours = [(f"h{k:+03d}", k - 1.5, k + 1.5) for k in ev.OFFSETS]
    return ev.rate_ratio(ev.window_counts(_strata(spark, d), _incidents(spark, d), hours), "window")


def bootstrap_ci(spark, d):
    return ev.bootstrap(ev.window_counts(_strata(spark, d), _incidents(spark, d), WINDOWS), "window")


HOURS = [(f"h{k:+03d}", float(k), float(k + 1)) for k in ev.OFFSETS]
OUTSIDE = ("outside", -1.0, 2.0)


def event_bundle(spark, d):
    """All hours, the window at the door and the rest of the day, for two rings and two variants, from one pass."""
    e = st.table(spark, d, "events").where("event_type = 'error'")
    t = F.datediff(F.to_date("ts"), F.lit(FIRST)) * 24 + F.hour("ts") + F.minute("ts") / 60
    ring = F.when(F.col("value") < 100, "near").otherwise("far")
    variant = F.explode(F.array_compact(F.array(F.lit("all"), F.when(F.minute("ts") > 0, "known"))))
    rows = e.select((F.col("user_id") % 3).cast("int").alias("stadium"), t.cast("double").alias("t"), ring.alias("ring"), variant.alias("variant"))
    return ev.rate_ratio(ev.bundle(_strata(spark, d), rows, HOURS + DOOR, OUTSIDE), "ring", "variant", "measure")


def gap_fill_log2(spark, d):
    e = _incidents(spark, d).groupBy("stadium", F.floor(F.col("t") / 4).cast("int").alias("slot")).agg(F.count("*").alias("n"))
    every = spark.range(DAYS * 6).select(F.col("id").cast("int").alias("slot")).withColumn("stadium", F.explode(F.array(*[F.lit(k) for k in range(3)])))
    out = ev.filled(every.join(e.where("n > 3"), ["stadium", "slot"], "left"), "stadium", "slot", "n")
    return out.select("stadium", "slot", "n", F.round(F.col("filled").cast("double"), 6).alias("filled"))


def pileup_filter(spark, d):
    """Pile-ups over all types first, then the type filter: the order changes the result."""
    e = st.table(spark, d, "events").withColumn("spot", F.floor(F.col("value")).cast("int")).withColumn("uid", (F.col("user_id") % 10).cast("int"))
    kept = ev.without_pileups(e, ("spot", "uid"), 6).where(F.upper("event_type").isin("ERROR", "CLICK") & F.col("value").between(10, 400))
    return kept.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("value"))


def crosswalk_case(spark, d):
    p = st.table(spark, d, "part")
    rules = [(F.upper("p_type") == "PROMO", "hurto"), (F.col("p_brand").like("%1"), "robo"), (F.col("p_size") > 40, "lesiones"), (F.upper("p_type") == "ECONOMY", "secuestro")]
    out = p.withColumn("cat", F.coalesce(ev.category(F.col("p_type"), F.col("p_brand"), F.col("p_name"), rules), F.lit("otro")))
    return out.groupBy("cat").agg(F.count("*").alias("n"))


def json_props(spark, d):
    e = st.table(spark, d, "events").select("event_type", F.from_json("props", "k int")["k"].alias("k"))
    return e.groupBy("event_type").agg(F.count("k").alias("n"), F.sum("k").alias("total"), F.max("k").alias("most"))


# --- graph: lanes = supplier nation -> customer nation; arcs = place -> place, supplier k and customer k being place k --


def _lanes(spark, d):
    li, o = st.table(spark, d, "lineitem"), st.table(spark, d, "orders")
    out = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(st.table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(st.table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return _lightest(out.select(F.col("s_nationkey").cast("string").alias("u"), F.col("c_nationkey").cast("string").alias("v"), *map(F.expr, _LANE)))


def arcs(spark, d):
    """Every line of every order is an arc from its supplier's place to its customer's: the places grow with the tables."""
    out = st.table(spark, d, "lineitem").join(st.table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    lines = out.select(F.col("l_suppkey").cast("string").alias("u"), F.col("o_custkey").cast("string").alias("v"), *map(F.expr, _LANE))
    # dealt out by their ends, so that neither the lines of a pair nor the pairs move again
    return _lightest(lines.repartition("u", "v"))


_LANE = ("l_linenumber AS key", "CAST(round(l_extendedprice / l_quantity) AS long) AS length")


#: Sampled sources, as many as the reference takes.
SOURCES = 500


def _lightest(lines):
    return lines.groupBy("u", "v", "key").agg(F.min("length").alias("length"))


LANES = """arcs AS (SELECT s_nationkey::VARCHAR AS u, c_nationkey::VARCHAR AS v, l_linenumber AS key, min(round(l_extendedprice / l_quantity)::BIGINT) AS length FROM lineitem JOIN orders ON l_orderkey = o_orderkey
      JOIN supplier ON l_suppkey = s_suppkey JOIN customer ON o_custkey = c_custkey GROUP BY ALL)"""
ARCS = "arcs AS (SELECT l_suppkey::VARCHAR AS u, o_custkey::VARCHAR AS v, l_linenumber AS key, min(round(l_extendedprice / l_quantity)::BIGINT) AS length FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL)"


def segment_key(spark, d):
    return graph.segments(_lanes(spark, d)).select("tramo_id", "length")


def collapse_parallel(spark, d):
    return graph.collapsed(_lanes(spark, d), ("length",))


def betweenness_nodes(spark, d):
    return graph.betweenness(arcs(spark, d), "length")[0].withColumn("bc", F.round("bc", 6))


def betweenness_arcs(spark, d):
    return graph.betweenness(arcs(spark, d), "length")[1].withColumn("bc", F.round("bc", 6))


def betweenness_sampled(spark, d):
    return graph.betweenness(arcs(spark, d), "length", SOURCES)[0].withColumn("bc", F.round("bc", 6))


def arc_to_segment(spark, d):
    a = arcs(spark, d)
    bc = graph.betweenness(a, "length")[1]
    return graph.to_segments(bc, graph.segments(a.where("u <> v"))).select("tramo_id", F.round("bc", 6).alias("bc"))


def components(spark, d):
    return graph.weak_components(arcs(spark, d))


def strong_components(spark, d):
    return graph.strong_components(arcs(spark, d))


def closeness(spark, d):
    return graph.closeness(arcs(spark, d), "length").withColumn("closeness", F.round("closeness", 9))


def degree_density(spark, d):
    return graph.density(graph.collapsed(_lanes(spark, d), ("length",)))


def degree_table(spark, d):
    return graph.degrees(graph.collapsed(arcs(spark, d), ("length",)))


def clustering(spark, d):
    return graph.clustering(arcs(spark, d))


_REACH = "edge AS (SELECT DISTINCT u, v FROM arcs), reach(a, b) AS (SELECT u, u FROM edge UNION SELECT v, v FROM edge UNION SELECT a, v FROM reach JOIN edge ON b = u)"


# --- space: points are the first two coordinates of the embeddings ------------------------------------------------


def _points(spark, d):
    e = st.table(spark, d, "embeddings")
    return e.select(F.col("vec_id").alias("id"), F.round(F.col("embedding")[0].cast("double") * 1000, 3).alias("x"), F.round(F.col("embedding")[1].cast("double") * 1000, 3).alias("y"), "label")


POINTS = "points AS (SELECT vec_id AS id, round(embedding[1]::DOUBLE * 1000, 3) AS x, round(embedding[2]::DOUBLE * 1000, 3) AS y, label FROM embeddings)"


def _targets(spark, d):
    return _points(spark, d).where("label = 0").select(F.col("id").alias("target"), F.col("x").alias("tx"), F.col("y").alias("ty"))


def nearest_point(spark, d):
    out = quadtree.nearest(_points(spark, d).where("label <> 0"), _targets(spark, d))
    return out.select("id", "target", F.round("distance", 6).alias("distance"), (F.col("distance") > 50).alias("far"))


def within_radius(spark, d):
    return space.within(_points(spark, d).where("label <> 0"), _targets(spark, d), 30.0).select("id", "target", F.round("distance", 6).alias("distance"))


def distance_rings(spark, d):
    places = spark.createDataFrame([("a", 0.0, 0.0), ("b", 50.0, 50.0)], "place string, px double, py double")
    return ev.distance_rings(_points(spark, d), places, (0, 50, 100, 200)).groupBy("place", "ring").agg(F.count("*").alias("n"))


def label_names(spark, d):
    near = space.within(_points(spark, d).where("label <> 0"), _targets(spark, d), 40.0)
    return space.names_near(near.select("id", F.concat(F.lit("L"), F.col("target") % 20).alias("name"), "distance"))


def hex_coverage(spark, d):
    q, r = space.hex_axial(F.col("x"), F.col("y"), 25.0)
    return _points(spark, d).groupBy(q.alias("q"), r.alias("r")).agg(F.count("*").alias("n"), F.count_distinct("label").alias("labels"))


def _tiles(spark, d):
    """Regular tiles of side 5 over the boxes; their number follows the boxes."""
    k = F.floor(F.col("p_partkey") / 8)
    return st.table(spark, d, "part").select(k.alias("k")).distinct().select(F.col("k").alias("id_b"), space.box_ring(F.col("k") % 40 * 5, F.floor(F.col("k") / 40) * 5, F.col("k") % 40 * 5 + 5, F.floor(F.col("k") / 40) * 5 + 5).alias("shape_b"))


def _corner():
    """Corner, width and height of a part's box."""
    return F.col("p_partkey") * 7 % 190 + 0.25, F.col("p_partkey") * 11 % 30 + 0.25, 1 + F.col("p_size") % 7, 1 + F.col("p_size") % 5


def _boxes(spark, d):
    x, y, w, h = _corner()
    return st.table(spark, d, "part").select(F.col("p_partkey").alias("id_a"), space.box_ring(x, y, x + w, y + h).alias("shape_a"))


def polygon_overlap(spark, d):
    out = space.correspondence(_boxes(spark, d), _tiles(spark, d), 10.0, 0.5)
    return out.select("id_a", "id_b", *[F.round(c, 6).alias(c) for c in ("area", "frac_a", "frac_b")])


def mass_deviation(spark, d):
    x, y, w, h = _corner()
    inside = st.table(spark, d, "part").where((x + w <= 200) & (y + h <= 25)).select(F.col("p_partkey").alias("id_a"))
    return space.mass_deviation(space.correspondence(_boxes(spark, d), _tiles(spark, d), 10.0, 1e-9), inside)


def grid_coverage(spark, d):
    tiles = _tiles(spark, d)
    return space.coverage(space.correspondence(_boxes(spark, d), tiles, 10.0, 0.5), tiles).select("id_b", F.round("covered", 6).alias("covered"), "pieces")


def line_overlay(spark, d):
    x, y, w, _ = _corner()
    p = F.struct(x.alias("x"), y.alias("y")), F.struct((x + 3 * w).alias("x"), y.alias("y"))
    lines = st.table(spark, d, "part").select(F.col("p_partkey").alias("id_a"), F.array(*p).alias("shape_a"))
    out = space.line_correspondence(lines, _tiles(spark, d), 10.0, 0.5)
    return out.select("id_a", "id_b", F.round("length", 6).alias("length"), F.round("frac_a", 6).alias("frac_a"))


def length_deviation(spark, d):
    return line_overlay(spark, d).groupBy("id_a").agg(F.sum("frac_a").alias("s")).agg(F.count("*").alias("lines"), F.round(F.max(F.greatest(F.col("s") - 1, F.lit(0.0))), 6).alias("excess"))


def _lines(spark, d):
    pts = _points(spark, d)
    seg = pts.select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"), (F.col("label") + 200.0).alias("length"))
    return graph.with_ends(seg, pts.withColumnRenamed("id", "node_id"))


def orientation(spark, d):
    return graph.orientation_order(graph.orientation_histogram(_lines(spark, d), "length"))


def orientation_bins(spark, d):
    return graph.orientation_histogram(_lines(spark, d), "length").withColumn("mass", F.round("mass", 6))


def circuity(spark, d):
    return graph.circuity(_lines(spark, d), "length")


QUERIES = {
    f.__name__: f
    for f in (
        event_calendar, matched_strata, window_counts, complement_counts, mh_rate_ratio, event_profile, moving_estimate, bootstrap_ci, event_bundle, gap_fill_log2, pileup_filter, crosswalk_case, json_props,
        segment_key, collapse_parallel, betweenness_nodes, betweenness_arcs, betweenness_sampled, arc_to_segment, components, strong_components, closeness, degree_density, degree_table, clustering,
        nearest_point, within_radius, distance_rings, label_names, hex_coverage, polygon_overlap, mass_deviation, grid_coverage, line_overlay, length_deviation, orientation, orientation_bins, circuity,
    )
}

_LINES = f"{POINTS}, lines AS (SELECT a.label + 200.0 AS length, b.x - a.x AS dx, b.y - a.y AS dy FROM points a JOIN points b ON b.id = a.id + 1)"
_BINS = f"""{_LINES}, b AS (SELECT (degrees(atan2(dx, dy)) + 720) % 360 AS b, length FROM lines), both_ways AS (SELECT b, length FROM b UNION ALL SELECT (b + 180) % 360, length FROM b),
  bins AS (SELECT k::INTEGER AS bin, coalesce(sum(length), 0)::DOUBLE AS mass FROM range(36) t(k) LEFT JOIN both_ways ON floor((b + 5) % 360 / 10) = k GROUP BY k)"""
_SHAPES = """boxes AS (SELECT p_partkey AS id_a, p_partkey * 7 % 190 + 0.25 AS x0, p_partkey * 11 % 30 + 0.25 AS y0, 1 + p_size % 7 AS w, 1 + p_size % 5 AS h FROM part),
  tiles AS (SELECT DISTINCT p_partkey // 8 AS id_b, (p_partkey // 8) % 40 * 5 AS tx, (p_partkey // 8) // 40 * 5 AS ty FROM part)"""
_PAIRS = f"""{_SHAPES}, pairs AS (SELECT *, (greatest(0, least(x0 + w, tx + 5) - greatest(x0, tx)) * greatest(0, least(y0 + h, ty + 5) - greatest(y0, ty)))::DOUBLE AS area FROM boxes JOIN tiles ON x0 <= tx + 5 AND x0 + w >= tx AND y0 <= ty + 5 AND y0 + h >= ty)"""
_HITS = f"""{_SHAPES}, hits AS (SELECT id_a, id_b, greatest(0, least(x0 + 3 * w, tx + 5) - greatest(x0, tx))::DOUBLE AS length, w FROM boxes JOIN tiles ON y0 > ty AND y0 < ty + 5 AND x0 <= tx + 5 AND x0 + 3 * w >= tx)"""
_HEX = "(sqrt(3) / 3 * x - y / 3) / 25.0 AS q, (2.0 / 3 * y) / 25.0 AS r"

ORACLE_SQL = {
    "event_calendar": f"""WITH {STRATA} SELECT k::INTEGER AS day, (DATE '{FIRST}' + k::INTEGER)::VARCHAR AS date, (isodow(DATE '{FIRST}' + k::INTEGER) - 1)::INTEGER AS dow, (year(DATE '{FIRST}' + k::INTEGER) * 12 + month(DATE '{FIRST}' + k::INTEGER))::INTEGER AS ym,
      count(c.day) AS crowds FROM range({DAYS}) t(k) LEFT JOIN crowds c ON c.day = k GROUP BY k""",
    "matched_strata": f"WITH {STRATA} SELECT * FROM strata",
    "window_counts": f"WITH {_counted(DOOR)} SELECT * FROM counts",
    "complement_counts": f"""WITH {INCIDENTS}, {STRATA}, hits AS (SELECT l.stadium, l.day, count(*) FILTER (WHERE treated) AS a, count(*) FILTER (WHERE NOT treated) AS c FROM looks l JOIN incidents i ON i.stadium = l.stadium AND floor(i.t / 24) = at_day
      WHERE i.t - 24 * at_day < kh - 1 OR i.t - 24 * at_day >= kh + 2 GROUP BY 1, 2) SELECT s.stadium, s.day, coalesce(a, 0) AS a, coalesce(c, 0) AS c, nc FROM sizes s LEFT JOIN hits h ON h.stadium = s.stadium AND h.day = s.day""",
    "mh_rate_ratio": f"WITH {_counted(DOOR)} SELECT stadium, {_RR} FROM counts GROUP BY stadium",
    "event_profile": f"""WITH {_counted([(f"h{k:+03d}", float(k), float(k + 1)) for k in ev.OFFSETS])} SELECT "window", {_RR} FROM counts GROUP BY 1""",
    "moving_estimate": f"""WITH {_counted([(f"h{k:+03d}", k - 1.5, k + 1.5) for k in ev.OFFSETS])} SELECT "window", {_RR} FROM counts GROUP BY 1""",
    "event_bundle": f"""WITH i AS (SELECT (user_id % 3)::INTEGER AS stadium, date_diff('day', DATE '{FIRST}', ts::DATE) * 24 + hour(ts) + minute(ts) / 60.0 AS t, CASE WHEN value < 100 THEN 'near' ELSE 'far' END AS ring, minute(ts) > 0 AS known FROM events WHERE event_type = 'error'),
      incidents AS (SELECT stadium, t, ring, 'all' AS variant FROM i UNION ALL SELECT stadium, t, ring, 'known' FROM i WHERE known), {STRATA}, w(measure, lo, hi) AS (VALUES {", ".join(f"('{n}', {lo}, {hi})" for n, lo, hi in HOURS + DOOR)}),
      met AS (SELECT ring, variant, l.stadium, l.day, treated, i.t - l.at_day * 24 - kh AS gap, floor(i.t / 24) = at_day AS same FROM looks l JOIN incidents i ON i.stadium = l.stadium),
      seen AS (SELECT ring, variant, measure, stadium, day, treated FROM met JOIN w ON gap >= lo AND gap < hi UNION ALL SELECT ring, variant, 'outside', stadium, day, treated FROM met WHERE same AND (gap < -1 OR gap >= 2)),
      hits AS (SELECT ring, variant, measure, stadium, day, count(*) FILTER (WHERE treated) AS a, count(*) FILTER (WHERE NOT treated) AS c FROM seen GROUP BY ALL), kinds AS (SELECT DISTINCT ring, variant FROM incidents), measures AS (SELECT measure FROM w UNION ALL SELECT 'outside'),
      counts AS (SELECT k.ring, k.variant, m.measure, s.stadium, s.day, coalesce(a, 0) AS a, coalesce(c, 0) AS c, nc FROM sizes s CROSS JOIN kinds k CROSS JOIN measures m LEFT JOIN hits h ON h.ring = k.ring AND h.variant = k.variant AND h.measure = m.measure AND h.stadium = s.stadium AND h.day = s.day)
      SELECT ring, variant, measure, {_RR} FROM counts GROUP BY ALL""",
    "gap_fill_log2": f"""WITH {INCIDENTS}, e AS (SELECT stadium, floor(t / 4)::INTEGER AS slot, count(*) AS n FROM incidents GROUP BY 1, 2 HAVING count(*) > 3),
      g AS (SELECT s::INTEGER AS stadium, k::INTEGER AS slot, n FROM range(3) a(s) CROSS JOIN range({DAYS * 6}) b(k) LEFT JOIN e ON e.stadium = s AND e.slot = k),
      f AS (SELECT *, last_value(CASE WHEN n > 0 THEN {{'t': slot, 'l': log2(n)}} END IGNORE NULLS) OVER (PARTITION BY stadium ORDER BY slot) AS p,
        first_value(CASE WHEN n > 0 THEN {{'t': slot, 'l': log2(n)}} END IGNORE NULLS) OVER (PARTITION BY stadium ORDER BY slot ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS x FROM g)
      SELECT stadium, slot, n, round(CASE WHEN n > 0 THEN n WHEN p IS NOT NULL AND x IS NOT NULL THEN pow(2, p.l + (slot - p.t) / (x.t - p.t)::DOUBLE * (x.l - p.l)) END, 6)::DOUBLE AS filled FROM f""",
    "pileup_filter": """WITH c AS (SELECT *, count(*) OVER (PARTITION BY floor(value), user_id % 10) AS k FROM events) SELECT event_type, count(*) AS n, round(sum(value), 6) AS value FROM c
      WHERE k <= 6 AND upper(event_type) IN ('ERROR', 'CLICK') AND value BETWEEN 10 AND 400 GROUP BY event_type""",
    "crosswalk_case": """SELECT CASE WHEN upper(p_type) = 'ECONOMY' THEN 'secuestro' WHEN p_size > 40 THEN 'lesiones' WHEN p_brand LIKE '%1' THEN 'robo' WHEN upper(p_type) = 'PROMO' THEN 'hurto' ELSE 'otro' END AS cat, count(*) AS n FROM part GROUP BY 1""",
    "json_props": """WITH e AS (SELECT event_type, (props->>'k')::INTEGER AS k FROM events) SELECT event_type, count(k) AS n, sum(k)::BIGINT AS total, max(k) AS most FROM e GROUP BY 1""",
    "segment_key": f"WITH {LANES} SELECT least(u, v) || '-' || greatest(u, v) || '-' || key AS tramo_id, min(length) AS length FROM arcs GROUP BY 1",
    "collapse_parallel": f"WITH {LANES} SELECT u, v, min(length) AS length, arg_min(key, length * 100 + key) AS key_length FROM arcs WHERE u <> v GROUP BY u, v",
    "components": f"""WITH RECURSIVE {ARCS}, edge AS (SELECT u, v FROM arcs UNION SELECT v, u FROM arcs), reach(a, b) AS (SELECT u, u FROM edge UNION SELECT a, v FROM reach JOIN edge ON b = u)
      SELECT a AS node, min(b) AS component FROM reach GROUP BY a""",
    "strong_components": f"WITH RECURSIVE {ARCS}, {_REACH} SELECT x.a AS node, min(x.b) AS component FROM reach x JOIN reach y ON x.a = y.b AND x.b = y.a GROUP BY x.a",
    "degree_density": f"""WITH {LANES}, e AS (SELECT DISTINCT u, v FROM arcs WHERE u <> v), n AS (SELECT u FROM e UNION SELECT v FROM e), k AS (SELECT (SELECT count(*) FROM n) AS nodes, (SELECT count(*) FROM e) AS arcs)
      SELECT nodes, arcs::BIGINT AS arcs, round(arcs / nodes, 6) AS mean_degree, round(arcs * 10000 / (nodes * (nodes - 1)), 6) AS density_x1e4 FROM k""",
    "degree_table": f"""WITH {ARCS}, e AS (SELECT DISTINCT u, v FROM arcs WHERE u <> v), b AS (SELECT u AS node, 0 AS i, 1 AS o FROM e UNION ALL SELECT v, 1, 0 FROM e) SELECT node, sum(i)::BIGINT AS n_in, sum(o)::BIGINT AS n_out FROM b GROUP BY node""",
    "clustering": f"""WITH {ARCS}, e AS (SELECT DISTINCT least(u, v) AS a, greatest(u, v) AS b FROM arcs WHERE u <> v), s AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e), d AS (SELECT a AS node, count(*) AS d FROM s GROUP BY a),
      t AS (SELECT x.a AS node, count(*) AS t FROM s x JOIN s y ON x.a = y.a AND x.b < y.b JOIN e ON e.a = x.b AND e.b = y.b GROUP BY 1) SELECT count(*) AS nodes, round(avg(CASE WHEN d > 1 THEN 2.0 * coalesce(t, 0) / (d * (d - 1)) ELSE 0 END), 6) AS clustering FROM d LEFT JOIN t ON d.node = t.node""",
    "nearest_point": f"""WITH {POINTS}, p AS (SELECT a.id, b.id AS target, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS far, row_number() OVER (PARTITION BY a.id ORDER BY sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2), b.id) AS k FROM points a, points b WHERE a.label <> 0 AND b.label = 0)
      SELECT id, target, round(far, 6) AS distance, far > 50 AS far FROM p WHERE k = 1""",
    "within_radius": f"WITH {POINTS}, p AS (SELECT a.id, b.id AS target, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS d FROM points a, points b WHERE a.label <> 0 AND b.label = 0) SELECT id, target, round(d, 6) AS distance FROM p WHERE d <= 30",
    "distance_rings": f"""WITH {POINTS}, p AS (SELECT place, sqrt((x - px) ** 2 + (y - py) ** 2) AS d FROM points, (VALUES ('a', 0.0, 0.0), ('b', 50.0, 50.0)) t(place, px, py))
      SELECT place, CASE WHEN d < 50 THEN 'r0_50' WHEN d < 100 THEN 'r50_100' ELSE 'r100_200' END AS ring, count(*) AS n FROM p WHERE d < 200 GROUP BY 1, 2""",
    "label_names": f"""WITH {POINTS}, p AS (SELECT a.id, 'L' || (b.id % 20) AS name, min(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2)) AS d FROM points a, points b WHERE a.label <> 0 AND b.label = 0 AND sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) <= 40 GROUP BY 1, 2)
      SELECT id, string_agg(name, ' · ' ORDER BY d, name) AS names FROM p GROUP BY id""",
    "hex_coverage": f"""WITH {POINTS}, h AS (SELECT label, {_HEX} FROM points), k AS (SELECT *, round_even(q, 0) AS rq, round_even(r, 0) AS rr, round_even(-q - r, 0) AS rs FROM h),
      c AS (SELECT label, CASE WHEN abs(rq - q) > abs(rr - r) AND abs(rq - q) > abs(rs + q + r) THEN -rr - rs ELSE rq END AS q, CASE WHEN abs(rq - q) > abs(rr - r) AND abs(rq - q) > abs(rs + q + r) THEN rr WHEN abs(rr - r) > abs(rs + q + r) THEN -rq - rs ELSE rr END AS r FROM k)
      SELECT q::BIGINT AS q, r::BIGINT AS r, count(*) AS n, count(DISTINCT label) AS labels FROM c GROUP BY 1, 2""",
    "polygon_overlap": f"WITH {_PAIRS} SELECT id_a, id_b, round(area, 6) AS area, round(area / (w * h), 6) AS frac_a, round(area / 25, 6) AS frac_b FROM pairs WHERE area >= 0.5",
    "mass_deviation": f"WITH {_PAIRS}, s AS (SELECT id_a, sum(area / (w * h)) AS s FROM pairs WHERE area >= 1e-9 AND x0 + w <= 200 AND y0 + h <= 25 GROUP BY id_a) SELECT count(*) AS cells, round(max(abs(s - 1)), 6) AS deviation FROM s",
    "grid_coverage": f"WITH {_PAIRS}, s AS (SELECT id_b, sum(area / 25) AS covered, count(DISTINCT id_a) AS pieces FROM pairs WHERE area >= 0.5 GROUP BY id_b) SELECT t.id_b, round(coalesce(covered, 0), 6) AS covered, coalesce(pieces, 0) AS pieces FROM tiles t LEFT JOIN s ON t.id_b = s.id_b",
    "line_overlay": f"WITH {_HITS} SELECT id_a, id_b, round(length, 6) AS length, round(length / (3 * w), 6) AS frac_a FROM hits WHERE length >= 0.5",
    "length_deviation": f"WITH {_HITS}, s AS (SELECT id_a, sum(round(length / (3 * w), 6)) AS s FROM hits WHERE length >= 0.5 GROUP BY id_a) SELECT count(*) AS lines, round(max(greatest(s - 1, 0)), 6) AS excess FROM s",
    "orientation": f"WITH {_BINS}, p AS (SELECT mass / sum(mass) OVER () AS p FROM bins), h AS (SELECT -sum(p * ln(p)) FILTER (WHERE p > 0) AS h FROM p) SELECT round(h, 6) AS entropy, round(1 - ((h - ln(4)) / (ln(36) - ln(4))) ** 2, 6) AS phi FROM h",
    "orientation_bins": f"WITH {_BINS} SELECT bin, round(mass, 6) AS mass FROM bins",
    "circuity": f"WITH {_LINES} SELECT round(sum(length) / sum(sqrt(dx ** 2 + dy ** 2)), 6) AS circuity FROM lines",
}

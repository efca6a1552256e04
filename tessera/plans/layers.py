"""Queries of the corridor, tissue and flag operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import scalar
from tessera.operators import events as ev
from tessera.operators import graph, rank, registry, space
from tessera.plans import relational
from tessera.plans import spatial as sp
from tessera.plans import standins as st

_ROADS = ("primary", " Secondary ", "tertiary_link", "busway", "residential", "", None)


def road_flags(spark, d):
    """Parts as roads: both taxonomies, and a flag text read strictly and leniently."""
    k = F.col("p_partkey") % 7 + 1
    texts = F.array(*[F.lit(x) for x in ("yes", "no", "1", "0", "-1", " TRUE", "")])
    rows = st.table(spark, d, "part").select(F.element_at(F.array(*[F.lit(x) for x in _ROADS]), k.cast("int")).alias("highway"), F.element_at(texts, k.cast("int")).alias("flag"))
    out = scalar.with_class(rows).withColumn("display", scalar.display_class(F.col("highway")))
    return out.withColumn("strict", scalar.strict_bool(F.col("flag"))).withColumn("lenient", scalar.lenient_bool(F.col("flag"))).groupBy("clase", "arterial", "display", "strict", "lenient").agg(F.count("*").alias("n"))


def coerced_points(spark, d):
    """Event texts become numbers, or missing; flag, years and box filter them."""
    e = st.table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    rows = e.select(F.when(F.col("user_id") % 4 == 0, "bad").otherwise(F.col("value").cast("string")).alias("lat"), (F.col("user_id") % 90).cast("string").alias("lng"), F.when(F.col("user_id") % 5 == 0, "x").otherwise("1").alias("flag"), F.year("ts").cast("string").alias("year"), "event_type", "ts")
    kept = ev.with_known_hour(ev.coerced(rows, (2020, 2024), (5.0, 10.0, 300.0, 80.0)), "ts", "event_type", ("signup",))
    return kept.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("lng").alias("lng"))


def firm_support(spark, d):
    """Of each customer's orders: is the support firm, how opaque is the interval, and what was latent?"""
    o = st.table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.min("o_totalprice").alias("lo"), F.when(F.count("*") > 3, F.max("o_totalprice")).alias("hi"))
    width = F.col("hi") - F.col("lo")
    bounds = o.agg(F.min(width).alias("a"), F.max(width).alias("b"))
    o = o.withColumn("a", bounds.select("a").scalar()).withColumn("b", bounds.select("b").scalar())
    return o.select("o_custkey", scalar.firm(F.col("n"), F.col("o_custkey") % 3, F.col("lo"), F.col("hi"), 5).alias("firm"), F.round(scalar.opacity(width, F.col("a"), F.col("b"), 150000.0), 6).alias("opacity"), F.round(ev.latent(F.col("n"), F.col("o_custkey") % 4 / 4.0), 6).alias("latent"))


def _boxes(spark, d):
    """Boxes along a band that grows with the parts, so that each overlaps about as many others at any size."""
    _, y, w, h = sp._corner()
    x = F.floor(F.col("p_partkey") / 4) + 0.25
    return st.table(spark, d, "part").select(F.col("p_partkey").alias("id"), space.box_ring(x, y, x + w, y + h).alias("shape"))


def overlap_resolved(spark, d):
    """Boxes as a partition: contested ground stays with the smallest key."""
    out = space.resolved(_boxes(spark, d), 10.0)
    return out.select("id", F.round(space.pieces_area(F.col("pieces")), 6).alias("area"), F.round("disputed", 6).alias("disputed"))


def clipped_cells(spark, d):
    """Boxes inside a mask of every second tile; boxes outside the mask are gone."""
    mask = sp._tiles(spark, d).where("id_b % 2 = 0")
    boxes = sp._boxes(spark, d).select(F.col("id_a").alias("id"), F.col("shape_a").alias("shape"))
    out = space.clipped_to(boxes, mask, 10.0)
    return out.select("id", F.size("pieces").alias("pieces"), F.round(space.pieces_area(F.col("pieces")), 6).alias("area"))


def _edges(spark, d):
    return st.table(spark, d, "part").select(F.col("p_partkey").alias("src"), (F.col("p_partkey") + F.col("p_size") % 5 + 1).alias("dst"))


def still_touching(spark, d):
    """Edges between boxes that meet, and every box's degree in them, 0 too."""
    cells = _boxes(spark, d).select("id", F.array("shape").alias("pieces"))
    return graph.with_degree(cells.select("id"), space.touching(_edges(spark, d), cells))


def point_in_cell(spark, d):
    """Points on a lattice of 20 in squares of 40: on a shared border the smallest square."""
    snap = lambda c: (F.rint(F.col(c) / 20) * 20).alias(c)
    points = sp._points(spark, d).select("id", snap("x"), snap("y"))
    k = F.explode(F.sequence(F.lit(-5), F.lit(4)))
    cells = spark.range(1).select(k.alias("i")).select("i", k.alias("j")).select(((F.col("i") + 5) * 10 + F.col("j") + 5).alias("id_b"), space.box_ring(F.col("i") * 40, F.col("j") * 40, F.col("i") * 40 + 40, F.col("j") * 40 + 40).alias("shape_b"))
    return space.assigned(points, cells, 40.0).select("id", F.col("id_b").alias("cell"))


def line_within(spark, d):
    """Lines within 30 of points, by the distance from the line itself."""
    p = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    lines = sp._targets(spark, d).select(F.col("target").alias("id_a"), F.array(p(F.col("tx"), F.col("ty")), p(F.col("tx") + 15, F.col("ty") + 9)).alias("shape_a"))
    return space.lines_near(sp._points(spark, d).where("label <> 0"), lines, 30.0).select("id", F.col("id_a").alias("line"), F.round("distance", 6).alias("distance"))


def _segments(spark, d):
    return st.segments(spark, d).select("tramo_id", "revenue", "quantity", (F.col("tramo_id") % 40).alias("u"), (F.col("tramo_id") % 23).alias("v"))


def top_contrasts(spark, d):
    """Coverage of the top segments, share with both ends among the top nodes, and places where two rankings agree."""
    s = _segments(spark, d)
    best, other = rank.ranking(s, "revenue", "tramo_id", 50), rank.top(s, "quantity", "tramo_id", 50)
    nodes = spark.range(30).select(F.col("id").alias("node_id"))
    out = rank.covered(best, s.where("quantity > 800"), "tramo_id").withColumn("ambos", rank.both_ends(best, nodes, s).scalar())
    same = rank.agreement(best, other, "tramo_id")
    return out.select(F.round("cobertura", 6).alias("cobertura"), F.round("ambos", 6).alias("ambos"), same.select("lugares").scalar().alias("lugares"), same.select("iguales").scalar().alias("iguales"))


def ordinal_ranks(spark, d):
    return rank.ordinal(st.table(spark, d, "part").select("p_partkey", "p_size"), "p_size", "p_partkey")


def split_share(spark, d):
    """Percent of boxes that lie in several tiles, by count and by area."""
    return rank.split_share(space.correspondence(sp._boxes(spark, d), sp._tiles(spark, d), 10.0, 0.5), "id_a", "id_b", "area")


def figures(spark, d):
    """Extremes over suppliers (each once, however often a line names it) and a reduction, as rows of figures."""
    rows = st.table(spark, d, "lineitem").select("l_suppkey").join(st.table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    out = rank.extremes(rows, "s_suppkey", ("s_acctbal", "s_nationkey"))
    counts = st.table(spark, d, "orders").agg(F.count("*").alias("n"), F.count_distinct("o_custkey").alias("k"))
    out = out.withColumn("reduction", rank.reduction(counts.select("n").scalar(), counts.select("k").scalar()))
    return registry.figures(out).withColumn("value", F.round("value", 6))


def street_shares(spark, d):
    """Streets at each place, their shares, and densities over 100 square kilometres."""
    arcs = sp.arcs(spark, d).where("u <> v")
    nodes, tramos = graph.street_counts(arcs), graph.segments(arcs)
    shares = graph.degree_shares(nodes, arcs.agg(F.count("*")).scalar())
    dense = graph.street_density(nodes, tramos, 100.0)
    for c in dense.columns:
        shares = shares.withColumn(c, dense.select(c).scalar())
    return shares


def reprojected_points(spark, d):
    """Customers' places to metres and back, and to the unit square and back: what comes out is what went in."""
    k = F.col("c_custkey")
    points = st.table(spark, d, "customer").select("c_custkey", (-12 + k % 997 / 1000.0).alias("lat"), (-77 + k % 1009 / 500.0).alias("lng"))
    back = space.from_utm18s(*space.utm18s(F.col("lat"), F.col("lng")))
    square = scalar.inverse_mercator(*scalar.mercator(F.col("lat"), F.col("lng")))
    names = ("utm_lat", "utm_lng", "square_lat", "square_lng")
    return points.select("c_custkey", *[F.round(c, 7).alias(n) for c, n in zip((*back, *square), names, strict=True)])


def ring_centroids(spark, d):
    """Centres of the tiles' triangles (box corners but one)."""
    tiles = sp._tiles(spark, d).select("id_b", space.centroid(F.slice("shape_b", 1, 3)).alias("c"))
    return tiles.select("id_b", F.round("c.x", 6).alias("x"), F.round("c.y", 6).alias("y"))


def densest_window(spark, d):
    """The seven densest hexagons within two steps of the densest, by the different labels in them."""
    q, r = space.hex_axial(F.col("x"), F.col("y"), 25.0)
    return space.densest_disc(sp._points(spark, d).select(q.alias("q"), r.alias("r"), F.col("label").alias("id")), 7)


def graph_quality(spark, d):
    """Sizes of the supplier-to-customer graph, imputed speeds by arcs and by length, and missing attributes of its segments."""
    arcs = sp.arcs(spark, d).withColumn("seen", F.col("length") % 3 >= 1)
    fields = arcs.withColumn("lanes", F.when(F.col("key") % 2 == 0, F.lit("2"))).withColumn("name", F.when(F.col("length") > 2000, F.lit("a")))
    return graph.quality(fields, "seen", ("lanes", "name"))


def coverage_emission(spark, d):
    """Figures of the coverage table as registry entries: percentages with two decimals, counts with none."""
    policies = spark.createDataFrame([("cobertura.pct*", 2, "half_up", "base"), ("cobertura.*", 0, "half_up", "base")], "pattern string, decimals int, mode string, variant_canonical string")
    out = registry.emission(registry.figures(relational.coverage_summary(spark, d)), policies, "cobertura", "base", "celdas", "-")
    return out.select("key", "family", F.round("value", 6).alias("value"), "shown", "canonical")


QUERIES = {f.__name__: f for f in (road_flags, coerced_points, firm_support, overlap_resolved, clipped_cells, still_touching, point_in_cell, line_within, top_contrasts, ordinal_ranks, split_share, figures, street_shares, reprojected_points, ring_centroids, densest_window, graph_quality, coverage_emission)}

_BOXES = "boxes AS (SELECT p_partkey AS id, p_partkey // 4 AS x, p_partkey * 11 % 30 AS y, 1 + p_size % 7 AS w, 1 + p_size % 5 AS h FROM part)"
_SEGMENTS = f"{st.SEGMENTS}, s AS (SELECT tramo_id, revenue, quantity, tramo_id % 40 AS u, tramo_id % 23 AS v FROM segments), best AS (SELECT *, row_number() OVER (ORDER BY revenue DESC, tramo_id) AS k FROM s QUALIFY k <= 50), other AS (SELECT *, row_number() OVER (ORDER BY quantity DESC, tramo_id) AS k FROM s QUALIFY k <= 50)"

ORACLE_SQL = {
    "road_flags": """WITH r AS (SELECT ['primary', ' Secondary ', 'tertiary_link', 'busway', 'residential', '', NULL][p_partkey % 7 + 1] AS h, ['yes', 'no', '1', '0', '-1', ' TRUE', ''][p_partkey % 7 + 1] AS f FROM part),
      t AS (SELECT CASE WHEN coalesce(trim(h), '') = '' THEN 'sin_dato' WHEN h = 'primary' THEN 'arterial' WHEN trim(lower(h)) = 'secondary' THEN 'intermedia' WHEN h = 'busway' THEN 'busway' ELSE 'local' END AS clase,
        CASE WHEN coalesce(trim(h), '') = '' THEN 'sin declarar' WHEN h = 'primary' THEN 'arterial' WHEN trim(lower(h)) IN ('secondary', 'tertiary_link') THEN 'secundaria' WHEN h = 'busway' THEN 'busway' ELSE 'local' END AS display, lower(trim(f)) IN ('yes', '1', '-1', 'true') AS b FROM r)
      SELECT clase, clase = 'arterial' AS arterial, display, b AS strict, b AS lenient, count(*) AS n FROM t GROUP BY ALL""",
    "coerced_points": """SELECT event_type, count(*) AS n, sum(user_id % 90)::DOUBLE AS lng FROM events WHERE user_id % 4 <> 0 AND user_id % 5 <> 0 AND year(ts) BETWEEN 2020 AND 2024 AND value BETWEEN 5 AND 300 AND user_id % 90 BETWEEN 10 AND 80
      AND ts <> date_trunc('day', ts) AND event_type <> 'signup' GROUP BY event_type""",
    "firm_support": """WITH o AS (SELECT o_custkey, count(*) AS n, min(o_totalprice) AS lo, CASE WHEN count(*) > 3 THEN max(o_totalprice) END AS hi FROM orders GROUP BY 1), w AS (SELECT *, hi - lo AS wd, min(hi - lo) OVER () AS a, max(hi - lo) OVER () AS b FROM o)
      SELECT o_custkey, n >= 5 AND o_custkey % 3 > 0 AND hi IS NOT NULL AS firm, round(CASE WHEN wd IS NULL THEN 1 WHEN wd > 150000 THEN NULL ELSE 1 - (wd - a) / (b - a) END, 6) AS opacity, round(CASE WHEN o_custkey % 4 > 0 THEN n / (o_custkey % 4 / 4.0) END, 6) AS latent FROM w""",
    "overlap_resolved": f"""WITH {_BOXES}, units AS (SELECT id, w * h AS size, x + i AS ux, y + j AS uy FROM boxes, range(7) a(i), range(5) b(j) WHERE i < w AND j < h), own AS (SELECT ux, uy, min(id) AS id FROM units GROUP BY 1, 2)
      SELECT o.id, count(*)::DOUBLE AS area, (any_value(b.w * b.h) - count(*))::DOUBLE AS disputed FROM own o JOIN boxes b ON b.id = o.id GROUP BY o.id""",
    "clipped_cells": f"""WITH {sp._PAIRS} SELECT id_a AS id, count(*)::INTEGER AS pieces, round(sum(area), 6) AS area FROM pairs WHERE id_b % 2 = 0 AND area > 1e-9 GROUP BY 1""",
    "still_touching": f"""WITH {_BOXES}, e AS (SELECT a.id AS s, b.id AS t FROM part JOIN boxes a ON a.id = p_partkey JOIN boxes b ON b.id = p_partkey + p_size % 5 + 1 WHERE a.x <= b.x + b.w AND b.x <= a.x + a.w AND a.y <= b.y + b.h AND b.y <= a.y + a.h),
      g AS (SELECT k, count(*) AS n FROM (SELECT s AS k FROM e UNION ALL SELECT t FROM e) GROUP BY 1) SELECT id, coalesce(n, 0) AS grado FROM boxes LEFT JOIN g ON k = id""",
    "point_in_cell": f"""WITH {sp.POINTS}, q AS (SELECT id, round_even(x / 20, 0) * 20 AS x, round_even(y / 20, 0) * 20 AS y FROM points), c AS (SELECT (i + 5) * 10 + j + 5 AS cell, i * 40 AS cx, j * 40 AS cy FROM range(-5, 5) a(i), range(-5, 5) b(j))
      SELECT id, min(cell) AS cell FROM q LEFT JOIN c ON x BETWEEN cx AND cx + 40 AND y BETWEEN cy AND cy + 40 GROUP BY id""",
    "line_within": f"""WITH {sp.POINTS}, p AS (SELECT a.id, b.id AS line, a.x - b.x AS px, a.y - b.y AS py FROM points a, points b WHERE a.label <> 0 AND b.label = 0), t AS (SELECT *, greatest(0.0, least(1.0, (px * 15 + py * 9) / 306.0)) AS t FROM p),
      f AS (SELECT id, line, sqrt((px - 15 * t) ** 2 + (py - 9 * t) ** 2) AS f FROM t) SELECT id, line, round(f, 6) AS distance FROM f WHERE f <= 30""",
    "top_contrasts": f"""WITH {_SEGMENTS} SELECT (SELECT round(avg((quantity > 800)::INTEGER), 6) FROM best) AS cobertura, (SELECT round(avg((u < 30 AND v < 30)::INTEGER), 6) FROM best) AS ambos, (SELECT count(*) FROM best JOIN other USING (k)) AS lugares,
      (SELECT count(*) FROM best b JOIN other o ON b.k = o.k AND b.tramo_id = o.tramo_id) AS iguales""",
    "ordinal_ranks": "SELECT p_partkey, p_size, row_number() OVER (ORDER BY p_size, p_partkey) - 1 AS orden FROM part",
    "split_share": f"WITH {sp._PAIRS}, u AS (SELECT id_a, count(DISTINCT id_b) AS n, sum(area) AS m FROM pairs WHERE area >= 0.5 GROUP BY 1) SELECT round(100 * avg((n > 1)::INTEGER), 6) AS pct, round(100 * sum(m) FILTER (WHERE n > 1) / sum(m), 6) AS pct_mass FROM u",
    "figures": """WITH s AS (SELECT * FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem)) SELECT 'min_s_acctbal' AS key, min(s_acctbal)::DOUBLE AS value FROM s UNION ALL SELECT 'max_s_acctbal', max(s_acctbal)::DOUBLE FROM s UNION ALL SELECT 'min_s_nationkey', min(s_nationkey)::DOUBLE FROM s
      UNION ALL SELECT 'max_s_nationkey', max(s_nationkey)::DOUBLE FROM s UNION ALL SELECT 'reduction', round(100.0 * (count(*) - count(DISTINCT o_custkey)) / count(*), 6)::DOUBLE FROM orders""",
    "street_shares": f"""WITH {sp.ARCS}, a AS (SELECT * FROM arcs WHERE u <> v), t AS (SELECT least(u, v) AS u, greatest(u, v) AS v, key, min(length) AS length FROM a GROUP BY 1, 2, 3), n AS (SELECT k, count(*) AS c FROM (SELECT u AS k FROM t UNION ALL SELECT v FROM t) GROUP BY 1)
      SELECT round((SELECT count(*) FROM a) / count(*), 6) AS grado_medio_salida, round(avg(c), 6) AS calles_por_nodo, round(100 * avg((c = 1)::INTEGER), 6) AS pct_nodos_callejon, round(100 * avg((c = 3)::INTEGER), 6) AS pct_nodos_3_calles, round(100 * avg((c >= 4)::INTEGER), 6) AS pct_nodos_4_o_mas,
        round(count(*) FILTER (WHERE c > 1) / 100.0, 6) AS intersecciones_por_km2, (SELECT round(sum(length) / 1000.0 / 100.0, 6) FROM t) AS km_calle_por_km2, (SELECT round(avg(length), 6) FROM t) AS largo_medio_tramo_m FROM n""",
    "reprojected_points": """WITH p AS (SELECT c_custkey, round(-12 + c_custkey % 997 / 1000.0, 7) AS a, round(-77 + c_custkey % 1009 / 500.0, 7) AS o FROM customer)
      SELECT c_custkey, a AS utm_lat, o AS utm_lng, a AS square_lat, o AS square_lng FROM p""",
    "ring_centroids": f"WITH {sp._SHAPES} SELECT id_b, round((3 * tx + 10) / 3.0, 6) AS x, round((3 * ty + 5) / 3.0, 6) AS y FROM tiles",
    "densest_window": f"""WITH {sp.POINTS}, h AS (SELECT label, {sp._HEX} FROM points), k AS (SELECT *, round_even(q, 0) AS rq, round_even(r, 0) AS rr, round_even(-q - r, 0) AS rs FROM h),
      c AS (SELECT label, CASE WHEN abs(rq - q) > abs(rr - r) AND abs(rq - q) > abs(rs + q + r) THEN -rr - rs ELSE rq END AS q, CASE WHEN abs(rq - q) > abs(rr - r) AND abs(rq - q) > abs(rs + q + r) THEN rr WHEN abs(rr - r) > abs(rs + q + r) THEN -rq - rs ELSE rr END AS r FROM k),
      g AS (SELECT q::BIGINT AS q, r::BIGINT AS r, count(DISTINCT label) AS pieces FROM c GROUP BY 1, 2), s AS (SELECT q AS sq, r AS sr FROM g ORDER BY pieces DESC, q, r LIMIT 1)
      SELECT q, r, pieces FROM g, s WHERE greatest(abs(q - sq), abs(r - sr), abs(q - sq + r - sr)) <= 2 ORDER BY pieces DESC, q, r LIMIT 7""",
    "graph_quality": f"""WITH {sp.ARCS}, t AS (SELECT key, arg_min(length, u) AS l FROM arcs GROUP BY least(u, v), greatest(u, v), key)
      SELECT (SELECT count(DISTINCT k) FROM (SELECT u AS k FROM arcs UNION ALL SELECT v FROM arcs)) AS n_nodos, count(*) AS n_aristas, (SELECT count(*) FROM t) AS n_tramos, round(100.0 * count(*) FILTER (WHERE length % 3 = 0) / count(*), 6) AS pct_imputado_aristas,
        round(100.0 * sum(length) FILTER (WHERE length % 3 = 0) / sum(length), 6) AS pct_imputado_largo, (SELECT round(100 * avg((key % 2 = 1)::INTEGER), 6) FROM t) AS pct_sin_lanes, (SELECT round(100 * avg((l <= 2000)::INTEGER), 6) FROM t) AS pct_sin_name FROM arcs""",
    "coverage_emission": f"""WITH s AS ({relational.ORACLE_SQL["coverage_summary"]}), f AS (SELECT COLUMNS(*)::DOUBLE FROM s), u AS (UNPIVOT f ON COLUMNS(*) INTO NAME k VALUE v)
      SELECT 'cobertura.' || k || '.base' AS key, 'cobertura.' || k AS family, round(v, 6) AS value, CASE WHEN k LIKE 'pct%' THEN v::DECIMAL(38,15)::DECIMAL(18,2)::VARCHAR ELSE v::BIGINT::VARCHAR END AS shown, true AS canonical FROM u""",
}

"""Queries of the coverage, surface, curve and rank operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import coverage as cov
from tessera.operators import curves, rank, surface
from tessera.plans import standins as st

KS = (10, 25, 50, 100, 200)
WIDE = ("n_geo", "exito_geo", "sin_coord", "coord_real")


def _coverage(spark: SparkSession, d: str) -> DataFrame:
    return cov.coverage(st.grid(spark, d), st.registry(spark, d), st.audit(spark, d))


def coverage_reason(spark, d):
    out = _coverage(spark, d)
    return out.select(*[F.round(F.col(c).cast("double"), 6).alias(c) if c in WIDE else F.col(c) for c in out.columns])


def coverage_summary(spark, d):
    return cov.summary(_coverage(spark, d))


def support_threshold_view(spark, d):
    return cov.threshold_view(_coverage(spark, d), "exito_geo", 0.35, 2)


def district_rollup(spark, d):
    return cov.district_rollup(_coverage(spark, d))


def pooled_cells(spark, d):
    out = surface.pooled_cells(st.surface(spark, d))
    return out.withColumn("share_inestable", F.round("share_inestable", 6)).withColumn("ic_ancho_rel", F.round("ic_ancho_rel", 6))


PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def category_pivot(spark, d):
    out = surface.category_pivot(st.surface(spark, d), PRIORITIES)
    names = {f"{p}_{m}": f"{m}_{k}" for k, p in enumerate(PRIORITIES, 1) for m in ("observado", "latente")}
    return out.withColumnsRenamed(names)


def composition_multiplier(spark, d):
    out = surface.composition(st.surface(spark, d))
    return out.select("crime_cat", *[F.round(c, 6).alias(c) for c in out.columns[1:]])


def rank_stability(spark, d):
    return surface.rank_stability(surface.pooled_cells(st.surface(spark, d)), 50)


def surface_quantiles(spark, d):
    return surface.quantiles(st.table(spark, d, "lineitem"), "l_extendedprice")


def paired_seed_stats(spark, d):
    return curves.aggregated(curves.by_seed(st.seeds(spark, d)))


def selective_penalty(spark, d):
    return curves.penalty(st.seeds(spark, d), "R", "A")


def replica_check(spark, d):
    mean = curves.aggregated(curves.by_seed(st.seeds(spark, d)))
    return curves.replica_deviation(mean.where("curva = 'R'"), mean.where("curva = 'A'"))


TAUS = [0.1, 0.25, 0.5, 0.9]


def evaluability_floor(spark, d):
    return curves.floors(st.falling(spark, d), "v", TAUS)


def precision_curve(spark, d):
    return rank.precision_curve(st.segments(spark, d), "revenue", "tramo_id", "arterial", KS)


def precision_at_k(spark, d):
    return rank.precision_curve(st.segments(spark, d), "quantity", "tramo_id", "arterial", (100,))


def base_rate(spark, d):
    return rank.base_rate(st.segments(spark, d), "arterial", "length")


def undeclared_corridors(spark, d):
    return rank.undeclared(st.segments(spark, d), "revenue", "tramo_id", "arterial", 50).select("rango", "tramo_id", "p_type", "revenue")


def weak_arteries(spark, d):
    return rank.weak(st.segments(spark, d), "revenue", "arterial").select("tramo_id", "revenue", "rango", F.round("percentil", 6).alias("percentil"))


def ranked_table(spark, d):
    return rank.ranked_table(st.segments(spark, d), ("revenue", "quantity")).select("tramo_id", "rank_revenue", "pct_revenue", "rank_quantity", "pct_quantity")


def busway_summary(spark, d):
    """Weight of one class in the table, in its lengths, in the flow and among the first 100; is it the first?"""
    s = st.segments(spark, d)
    bus = F.col("p_type") == "STANDARD"
    pct = lambda c: F.round(100 * F.sum(F.when(bus, c).otherwise(0.0)) / F.sum(c), 6)
    first = rank.top(s, "revenue", "tramo_id", 100)
    return s.agg(pct(F.lit(1.0)).alias("pct_count"), pct(F.col("length")).alias("pct_length"), pct(F.col("revenue")).alias("pct_flow"), F.max_by(bus, F.struct("revenue", -F.col("tramo_id"))).alias("is_first")).withColumn(
        "in_top", first.agg(F.count(F.when(bus, 1))).scalar()
    )


def normalise_gamma(spark, d):
    return rank.normalised(st.segments(spark, d).select("tramo_id", F.when(F.col("tramo_id") % 7 != 0, F.col("revenue")).alias("revenue")), "revenue", 0.5).select("tramo_id", "norm")


def histogram(spark, d):
    return rank.histogram(st.table(spark, d, "orders"), "o_totalprice", 60)


def value_shares(spark, d):
    lines = st.table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n_lines"))
    return rank.shares(lines, F.least("n_lines", F.lit(5)), "lines")


def missing_profile(spark, d):
    """Percent missing of each attribute; an attribute that the table lacks is missing everywhere."""
    part = st.table(spark, d, "part").select(F.when(F.col("p_partkey") % 3 != 0, F.col("p_brand")).alias("lanes"), F.when(F.col("p_size") > 10, F.col("p_type")).alias("highway"), F.col("p_name").alias("name"))
    return missing_percent(part, ("lanes", "highway", "name", "maxspeed"))


def missing_percent(df: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    share = [F.struct(F.lit(f).alias("field"), (F.round(100 * F.avg(F.col(f).isNull().cast("double")), 6) if f in df.columns else F.lit(100.0)).alias("pct")) for f in fields]
    return df.agg(F.array(*share).alias("x")).select(F.inline("x"))


def impute_by_group(spark, d):
    """Missing speeds from the mean of their road type, else from the mean of all; then travel time."""
    part = st.table(spark, d, "part").select("p_partkey", "p_type", "p_retailprice", F.when((F.col("p_partkey") % 5 != 0) & (F.col("p_type") != "PROMO"), F.col("p_size").cast("double")).alias("speed"))
    return imputed(part, "p_type", "speed", "p_retailprice").select("p_partkey", F.round("speed", 6).alias("speed"), "imputed", F.round("travel_time", 6).alias("travel_time"))


def imputed(df: DataFrame, kind: str, speed: str, length: str) -> DataFrame:
    means = df.groupBy(kind).agg(F.avg(speed).alias("mean__"))
    # a window over a road type would gather it; the means are one row for each type
    out = df.join(means, kind, "left").withColumn("all__", df.agg(F.avg(speed)).scalar())
    out = out.withColumn("imputed", F.col(speed).isNull()).withColumn(speed, F.coalesce(speed, "mean__", "all__"))
    return out.withColumn("travel_time", F.col(length) / 1000 / F.col(speed) * 3600).drop("mean__", "all__")


QUERIES = {
    f.__name__: f
    for f in (
        coverage_reason, coverage_summary, support_threshold_view, district_rollup, pooled_cells, category_pivot, composition_multiplier, rank_stability, surface_quantiles, paired_seed_stats,
        selective_penalty, replica_check, evaluability_floor, precision_curve, precision_at_k, base_rate, undeclared_corridors, weak_arteries, ranked_table, busway_summary, normalise_gamma,
        histogram, value_shares, missing_profile, impute_by_group,
    )
}

POOLED = f"""{st.SURFACE}, cells AS (
  SELECT h3_index, min(ubigeo) AS ubigeo, sum(observado) AS observado, sum(latente) AS latente, coalesce(sum(latente) FILTER (WHERE inestable = 1), 0) / sum(latente) AS share_inestable,
    (sum(latente_ic_high) - sum(latente_ic_low)) / sum(latente) AS ic_ancho_rel, sum(observado) <= 0 AS sin_registro FROM surface GROUP BY h3_index)"""
_STATS = ", ".join(f'round(avg({c}), 6) AS {n}_mean, round(stddev_samp({c}), 6) AS {n}_sd' for c, n in (("medible", "medible"), ('"real"', "real"), ("persist", "persist"), ('"real" - medible', "brecha"), ("medible - persist", "ventaja")))
CURVE = f"""{st.SEEDS}, curve AS (SELECT curva, rate, {_STATS}, round(100 * avg(feat_gana::INTEGER), 6) AS feat_gana_pct, count(DISTINCT seed) AS n_semillas FROM seeds GROUP BY curva, rate)"""


def _precision(column: str, ks: tuple[int, ...]) -> str:
    return f"""WITH {st.SEGMENTS}, placed AS (SELECT *, row_number() OVER (ORDER BY {column} DESC, tramo_id) AS rango FROM segments),
      ladder AS (SELECT unnest([{", ".join(map(str, ks))}])::INTEGER AS k), base AS (SELECT avg(arterial::INTEGER) AS b, count(*) AS n FROM segments)
      SELECT k, round(avg(arterial::INTEGER), 6) AS precision, round(any_value(b), 6) AS base, round(avg(arterial::INTEGER) - any_value(b), 6) AS excess,
        round(CASE WHEN any_value(b) > 0 THEN avg(arterial::INTEGER) / any_value(b) END, 6) AS lift FROM placed JOIN ladder ON rango <= k, base WHERE k <= n GROUP BY k"""


_PCT = "100.0 * (rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0) / count(*) OVER ()"

ORACLE_SQL = {
    "coverage_reason": f"WITH {st.COVERAGE} SELECT * REPLACE (round(n_geo::DOUBLE, 6) AS n_geo, round(exito_geo::DOUBLE, 6) AS exito_geo, round(sin_coord::DOUBLE, 6) AS sin_coord, round(coord_real::DOUBLE, 6) AS coord_real) FROM coverage",
    "coverage_summary": f"""WITH {st.COVERAGE} SELECT count(*) AS cells, round(100 * avg(tiene_registro::INTEGER), 6) AS pct_registro, round(100 * avg(tiene_auditoria::INTEGER), 6) AS pct_auditoria,
      round(100 * avg(evaluable::INTEGER), 6) AS pct_evaluable, {", ".join(f"count(*) FILTER (WHERE motivo = '{r}') AS {r}" for r in cov.REASONS)} FROM coverage""",
    "support_threshold_view": f"""WITH {st.COVERAGE} SELECT CASE WHEN evaluable AND exito_geo >= 0.35 AND soporte_registros >= 2 THEN 'firme' WHEN evaluable THEN 'evaluable' ELSE 'no_evaluable' END AS estado,
      count(*) AS cells, sum(soporte_registros)::BIGINT AS records FROM coverage GROUP BY 1""",
    "district_rollup": f"WITH {st.COVERAGE} SELECT departamento, distrito, count(*) AS cells, sum(soporte_registros)::BIGINT AS records FROM coverage WHERE NOT evaluable GROUP BY 1, 2",
    "pooled_cells": f"WITH {POOLED} SELECT * REPLACE (round(share_inestable, 6) AS share_inestable, round(ic_ancho_rel, 6) AS ic_ancho_rel) FROM cells",
    "category_pivot": f"""WITH {st.SURFACE} SELECT h3_index, {", ".join(f"coalesce(sum({m}) FILTER (WHERE crime_cat = '{p}'), 0)::DOUBLE AS {m}_{k}" for k, p in enumerate(PRIORITIES, 1) for m in ("observado", "latente"))} FROM surface GROUP BY h3_index""",
    "composition_multiplier": f"""WITH {st.SURFACE}, s AS (SELECT crime_cat, sum(observado) AS o, sum(latente) AS l FROM surface GROUP BY crime_cat)
      SELECT crime_cat, round(100 * o / sum(o) OVER (), 6) AS share_observado, round(100 * l / sum(l) OVER (), 6) AS share_latente, round(l / o, 6) AS multiplicador FROM s""",
    "rank_stability": f"""WITH {POOLED}, k AS (SELECT *, rank() OVER (ORDER BY observado) + (count(*) OVER (PARTITION BY observado) - 1) / 2.0 AS ro, rank() OVER (ORDER BY latente) + (count(*) OVER (PARTITION BY latente) - 1) / 2.0 AS rl,
      row_number() OVER (ORDER BY observado DESC, h3_index) AS po, row_number() OVER (ORDER BY latente DESC, h3_index) AS pl FROM cells WHERE NOT sin_registro)
      SELECT count(*) AS rows, round(corr(ro, rl), 6) AS spearman, count(*) FILTER (WHERE po <= 50 AND pl <= 50) / 50 AS overlap FROM k""",
    "surface_quantiles": "SELECT " + ", ".join(f"round(quantile_cont(l_extendedprice, {q}), 6) AS p{q * 1000:.0f}" for q in (0.05, 0.5, 0.95, 0.995)) + ", round(avg(l_extendedprice), 6) AS mean, round(stddev_pop(l_extendedprice), 6) AS sd_pop FROM lineitem",
    "paired_seed_stats": f"WITH {CURVE} SELECT * FROM curve",
    "selective_penalty": f"""WITH {st.SEEDS}, p AS (SELECT a.rate, a.seed, a.medible - b.medible AS dm, a."real" - b."real" AS dr FROM seeds a JOIN seeds b ON a.rate = b.rate AND a.seed = b.seed WHERE a.curva = 'R' AND b.curva = 'A')
      SELECT rate, round(avg(dm), 6) AS dm_mean, round(stddev_samp(dm), 6) AS dm_sd, round(avg(dr), 6) AS dr_mean, round(stddev_samp(dr), 6) AS dr_sd, count(DISTINCT seed) AS n_semillas FROM p GROUP BY rate""",
    "replica_check": f"WITH {CURVE} SELECT count(*) AS rates, round(max(abs(a.medible_mean - b.medible_mean)), 6) AS deviation FROM curve a JOIN curve b ON a.rate = b.rate WHERE a.curva = 'R' AND b.curva = 'A'",
    "evaluability_floor": f"""WITH {st.FALLING}, s AS (SELECT *, first_value(v) OVER w AS v0, lead(rate) OVER w AS r2, lead(v) OVER w AS v2, row_number() OVER w = 1 AS is_first FROM falling WINDOW w AS (PARTITION BY curva ORDER BY rate)),
      t AS (SELECT *, v0 - tau AS goal FROM s, (SELECT unnest({TAUS})::DOUBLE AS tau))
      SELECT curva, tau, round(min(CASE WHEN v >= goal AND v2 < goal THEN rate + (v - goal) / (v - v2) * (r2 - rate) WHEN r2 IS NULL AND v >= goal THEN rate WHEN is_first AND v < goal THEN rate END), 6)::DOUBLE AS piso FROM t GROUP BY curva, tau""",
    "precision_curve": _precision("revenue", KS),
    "precision_at_k": _precision("quantity", (100,)),
    "base_rate": f"WITH {st.SEGMENTS} SELECT round(avg(arterial::INTEGER), 6) AS base, round(sum(length) FILTER (WHERE arterial) / sum(length), 6) AS base_length FROM segments",
    "undeclared_corridors": f"WITH {st.SEGMENTS}, p AS (SELECT row_number() OVER (ORDER BY revenue DESC, tramo_id)::INTEGER AS rango, * FROM segments) SELECT rango, tramo_id, p_type, revenue FROM p WHERE rango <= 50 AND NOT arterial",
    "weak_arteries": f"WITH {st.SEGMENTS}, p AS (SELECT tramo_id, revenue, arterial, rank() OVER (ORDER BY revenue DESC) AS rango, {_PCT.format(c='revenue')} AS percentil FROM segments) SELECT tramo_id, revenue, rango, round(percentil, 6) AS percentil FROM p WHERE arterial AND percentil <= 50",
    "ranked_table": f"""WITH {st.SEGMENTS} SELECT tramo_id, rank() OVER (ORDER BY revenue DESC) AS rank_revenue, round({_PCT.format(c='revenue')}, 6) AS pct_revenue, rank() OVER (ORDER BY quantity DESC) AS rank_quantity,
      round({_PCT.format(c='quantity')}, 6) AS pct_quantity FROM segments""",
    "busway_summary": f"""WITH {st.SEGMENTS}, f AS (SELECT p_type FROM segments ORDER BY revenue DESC, tramo_id LIMIT 100)
      SELECT round(100 * avg((p_type = 'STANDARD')::INTEGER), 6) AS pct_count, round(100 * coalesce(sum(length) FILTER (WHERE p_type = 'STANDARD'), 0) / sum(length), 6) AS pct_length,
        round(100 * coalesce(sum(revenue) FILTER (WHERE p_type = 'STANDARD'), 0) / sum(revenue), 6) AS pct_flow, (SELECT p_type = 'STANDARD' FROM f LIMIT 1) AS is_first, (SELECT count(*) FROM f WHERE p_type = 'STANDARD') AS in_top FROM segments""",
    "normalise_gamma": f"WITH {st.SEGMENTS}, x AS (SELECT tramo_id, CASE WHEN tramo_id % 7 <> 0 THEN revenue END AS r FROM segments) SELECT tramo_id, round(sqrt((r - min(r) OVER ()) / (max(r) OVER () - min(r) OVER ())), 6) AS norm FROM x",
    "histogram": "WITH e AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders) SELECT least(floor((o_totalprice - lo) / (hi - lo) * 60), 59)::INTEGER AS bin, count(*) AS n FROM orders, e GROUP BY 1",
    "value_shares": "WITH l AS (SELECT least(count(*), 5) AS lines FROM lineitem GROUP BY l_orderkey) SELECT lines, count(*) AS n, round(100 * count(*) / sum(count(*)) OVER (), 6) AS pct FROM l GROUP BY lines",
    "missing_profile": """SELECT 'lanes' AS field, round(100 * avg((p_partkey % 3 = 0)::INTEGER), 6) AS pct FROM part UNION ALL SELECT 'highway', round(100 * avg((p_size <= 10)::INTEGER), 6) FROM part
      UNION ALL SELECT 'name', round(100 * avg((p_name IS NULL)::INTEGER), 6) FROM part UNION ALL SELECT 'maxspeed', 100.0::DOUBLE""",
    "impute_by_group": """WITH p AS (SELECT p_partkey, p_type, p_retailprice, CASE WHEN p_partkey % 5 <> 0 AND p_type <> 'PROMO' THEN p_size END AS s FROM part),
      f AS (SELECT *, coalesce(s, avg(s) OVER (PARTITION BY p_type), avg(s) OVER ()) AS speed FROM p)
      SELECT p_partkey, round(speed, 6)::DOUBLE AS speed, s IS NULL AS imputed, round(p_retailprice / 1000 / speed * 3600, 6) AS travel_time FROM f""",
}

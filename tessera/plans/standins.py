"""Stand-ins: the driver's tables in the shape of the operators' inputs, in Spark and in SQL.

Cell = customer, district = nation, department = region, category = order priority, registry = orders of
all market segments but one, audit = nations with an even key, incident and event day = rows of ``events``,
points = first two coordinates of ``embeddings``, lanes = supplier nation to customer nation, arcs =
supplier to customer, where one number is one place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    # nation and region are fixed dimensions of 25 and 5 rows
    districts = nation.join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey"))
    out = table(spark, sf_dir, "customer").join(F.broadcast(districts), F.col("c_nationkey") == F.col("n_nationkey"))
    ubigeo = F.when(F.col("c_acctbal") < 0, "").otherwise(F.col("c_nationkey").cast("string"))
    return out.select(F.col("c_custkey").cast("string").alias("h3_index"), ubigeo.alias("ubigeo"), F.col("n_name").alias("distrito"), F.col("r_name").alias("departamento"))


GRID = """grid AS (
  SELECT c_custkey::VARCHAR AS h3_index, CASE WHEN c_acctbal < 0 THEN NULL ELSE c_nationkey::VARCHAR END AS ubigeo, n_name AS distrito, r_name AS departamento
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders of the market segments that the register covers: every customer has orders, and some cells must have no record."""
    customer = table(spark, sf_dir, "customer").where("c_mktsegment <> 'MACHINERY'").select("c_custkey", "c_nationkey")
    out = table(spark, sf_dir, "orders").join(customer, F.col("o_custkey") == F.col("c_custkey"))
    return out.select(
        F.col("o_custkey").cast("string").alias("h3_index"), F.col("c_nationkey").cast("string").alias("ubigeo"), F.year("o_orderdate").alias("year"), F.col("o_orderpriority").alias("crime_cat"),
        F.lit(1).cast("long").alias("obs_geo_count"), (F.col("c_nationkey") / 50.0).alias("real_coord_ratio"),
    )


REGISTRY = """registry AS (
  SELECT o_custkey::VARCHAR AS h3_index, c_nationkey::VARCHAR AS ubigeo, year(o_orderdate) AS year, o_orderpriority AS crime_cat, 1 AS obs_geo_count, c_nationkey / 50.0 AS real_coord_ratio
  FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment <> 'MACHINERY')"""


def audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    even = table(spark, sf_dir, "nation").where("n_nationkey % 2 = 0")
    share = (F.col("n_nationkey") % 10) / 10.0
    return even.select(F.col("n_nationkey").cast("string").alias("ubigeo"), (F.col("n_nationkey") * 10).alias("n_geo"), share.alias("exito_geo"), (1 - share).alias("sin_coord"))


AUDIT = """audit AS (
  SELECT n_nationkey::VARCHAR AS ubigeo, n_nationkey * 10 AS n_geo, (n_nationkey % 10) / 10.0 AS exito_geo, 1 - (n_nationkey % 10) / 10.0 AS sin_coord FROM nation WHERE n_nationkey % 2 = 0)"""

COVERAGE = f"""{GRID}, {REGISTRY}, {AUDIT},
support AS (SELECT h3_index, sum(obs_geo_count) AS r, count(DISTINCT year) AS y, count(DISTINCT crime_cat) AS k FROM registry GROUP BY h3_index),
ratio AS (SELECT ubigeo, max(real_coord_ratio) AS coord_real FROM registry GROUP BY ubigeo),
quality AS (SELECT coalesce(a.ubigeo, q.ubigeo) AS ubigeo, n_geo, exito_geo, sin_coord, coord_real FROM audit a FULL JOIN ratio q ON a.ubigeo = q.ubigeo),
coverage AS (
  SELECT g.h3_index, g.ubigeo, distrito, departamento, coalesce(r, 0)::INTEGER AS soporte_registros, coalesce(y, 0)::SMALLINT AS soporte_anios, coalesce(k, 0)::SMALLINT AS soporte_categorias,
    n_geo::FLOAT AS n_geo, exito_geo::FLOAT AS exito_geo, sin_coord::FLOAT AS sin_coord, coord_real::FLOAT AS coord_real, coalesce(r, 0) > 0 AS tiene_registro, n_geo IS NOT NULL AS tiene_auditoria,
    coalesce(r, 0) > 0 AND n_geo IS NOT NULL AS evaluable,
    CASE WHEN g.ubigeo IS NULL THEN 'sin_ubigeo' WHEN n_geo IS NULL THEN 'sin_auditoria' WHEN coalesce(r, 0) = 0 THEN 'sin_registro' ELSE 'observado' END AS motivo
  FROM grid g LEFT JOIN support s ON g.h3_index = s.h3_index LEFT JOIN quality q ON g.ubigeo = q.ubigeo)"""


def surface(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    q = F.col("l_quantity")
    return rows.select(
        F.col("o_custkey").cast("string").alias("h3_index"), (F.col("o_custkey") % 25).cast("string").alias("ubigeo"), F.year("o_orderdate").alias("year"), F.col("o_orderpriority").alias("crime_cat"),
        F.when(F.col("l_returnflag") == "R", q).otherwise(0.0).alias("observado"), q.alias("latente"), (q * (1 - F.col("l_discount"))).alias("latente_ic_low"),
        (q * (1 + F.col("l_tax"))).alias("latente_ic_high"), (F.col("l_linenumber") == 1).cast("int").alias("inestable"),
    )


SURFACE = """surface AS (
  SELECT o_custkey::VARCHAR AS h3_index, (o_custkey % 25)::VARCHAR AS ubigeo, year(o_orderdate) AS year, o_orderpriority AS crime_cat, CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END AS observado,
    l_quantity AS latente, l_quantity * (1 - l_discount) AS latente_ic_low, l_quantity * (1 + l_tax) AS latente_ic_high, (l_linenumber = 1)::INTEGER AS inestable
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


def seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Return flag as curve, line number as seed, tens of quantity as rate."""
    rate = (F.floor(F.col("l_quantity") / 10) / 10).alias("rate")
    out = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("curva"), rate, F.col("l_linenumber").alias("seed"))
    out = out.agg((10 * F.avg("l_discount")).alias("medible"), (10 * F.avg("l_tax")).alias("real"), (F.avg("l_extendedprice") / 1e5).alias("persist"))
    return out.withColumn("feat_gana", F.col("medible") > F.col("real"))


SEEDS = """seeds AS (
  SELECT *, medible > "real" AS feat_gana FROM (SELECT l_returnflag AS curva, floor(l_quantity / 10) / 10 AS rate, l_linenumber AS seed, 10 * avg(l_discount) AS medible, 10 * avg(l_tax) AS "real",
    avg(l_extendedprice) / 1e5 AS persist FROM lineitem GROUP BY ALL))"""


def falling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A curve that falls by construction: the share of lines with a quantity of at least 10 * rate * 10."""
    cuts = [k / 10 for k in range(6)]
    share = [F.avg((F.col("l_quantity") >= 100 * c).cast("double")) for c in cuts]
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("curva")).agg(F.array(*[F.struct(F.lit(c).alias("rate"), s.alias("v")) for c, s in zip(cuts, share, strict=True)]).alias("x"))
    return rows.select("curva", F.inline("x"))


FALLING = """falling AS (
  SELECT l_returnflag AS curva, k / 10.0 AS rate, avg(CASE WHEN l_quantity >= 10 * k THEN 1.0 ELSE 0.0 END) AS v FROM lineitem, range(6) t(k) GROUP BY ALL)"""


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as street segments: revenue and quantity as weights, size as length, type as road class."""
    sums = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.round(F.sum("l_extendedprice"), 2).alias("revenue"), F.sum("l_quantity").alias("quantity"))
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("tramo_id"), "p_type", "p_brand", F.col("p_size").cast("double").alias("length"))
    out = part.join(sums, F.col("tramo_id") == F.col("l_partkey"), "left").drop("l_partkey")
    out = out.withColumn("revenue", F.coalesce("revenue", F.lit(0.0))).withColumn("quantity", F.coalesce("quantity", F.lit(0.0)))
    return out.withColumn("arterial", F.col("p_type").isin("ECONOMY", "PROMO"))


SEGMENTS = """segments AS (
  SELECT p_partkey AS tramo_id, p_type, p_brand, p_size::DOUBLE AS length, coalesce(revenue, 0) AS revenue, coalesce(quantity, 0) AS quantity, p_type IN ('ECONOMY', 'PROMO') AS arterial
  FROM part LEFT JOIN (SELECT l_partkey, round(sum(l_extendedprice), 2) AS revenue, sum(l_quantity) AS quantity FROM lineitem GROUP BY l_partkey) ON p_partkey = l_partkey)"""

"""Coverage: which cells of the canonical grid carry evidence, why not, and how good it is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.scalar import cast_to, no_blank
from tessera.operators import guards

#: Reasons in the order of precedence (fixed values).
REASONS = ("sin_ubigeo", "sin_auditoria", "sin_registro", "observado")

CONTRACT = {
    "h3_index": "string", "ubigeo": "string", "distrito": "string", "departamento": "string", "soporte_registros": "int", "soporte_anios": "smallint", "soporte_categorias": "smallint",
    "n_geo": "float", "exito_geo": "float", "sin_coord": "float", "coord_real": "float", "tiene_registro": "boolean", "tiene_auditoria": "boolean", "evaluable": "boolean", "motivo": "string",
}


def support(observed: DataFrame) -> DataFrame:
    """Records, years and categories of each cell."""
    return observed.groupBy("h3_index").agg(F.sum("obs_geo_count").alias("soporte_registros"), F.count_distinct("year").alias("soporte_anios"), F.count_distinct("crime_cat").alias("soporte_categorias"))


def district_quality(observed: DataFrame, audit: DataFrame) -> DataFrame:
    """Audit and share of real coordinates of each district, from either side (full outer); a district with several shares raises."""
    ratio = F.col("real_coord_ratio")
    one = F.when(F.min(ratio) < F.max(ratio), F.raise_error(F.lit("a district has several values of real_coord_ratio")).cast("double")).otherwise(F.max(ratio))
    share = observed.where(no_blank(F.col("ubigeo")).isNotNull()).groupBy("ubigeo").agg(one.alias("coord_real"))
    return audit.join(share, "ubigeo", "full")


def reason(district: str = "ubigeo", audited: str = "tiene_auditoria", recorded: str = "tiene_registro") -> Column:
    """No district, then no audit, then no record, else observed."""
    return F.when(F.col(district).isNull(), REASONS[0]).when(~F.col(audited), REASONS[1]).when(~F.col(recorded), REASONS[2]).otherwise(REASONS[3])


def coverage(grid: DataFrame, observed: DataFrame, audit: DataFrame) -> DataFrame:
    """The grid, left joined with support and quality: counts are filled with 0, qualities stay missing."""
    grid = grid.withColumns({c: no_blank(F.col(c)) for c in ("ubigeo", "distrito", "departamento") if c in grid.columns})
    out = grid.join(support(observed), "h3_index", "left").join(district_quality(observed, audit), "ubigeo", "left")
    out = out.fillna(0, subset=["soporte_registros", "soporte_anios", "soporte_categorias"])
    out = out.withColumn("tiene_registro", F.col("soporte_registros") > 0).withColumn("tiene_auditoria", F.col("n_geo").isNotNull())
    return cast_to(out.withColumn("evaluable", F.col("tiene_registro") & F.col("tiene_auditoria")).withColumn("motivo", reason()), CONTRACT)


def build(grid: DataFrame, matrix: DataFrame, observed: DataFrame, audit: DataFrame) -> DataFrame:
    """``coverage`` behind its guards: same grid in both files, unique keys, one ratio for each district."""
    guards.same_keys(grid, matrix, "h3_index")
    guards.unique(grid, "h3_index")
    guards.unique(audit, "ubigeo")
    guards.constant_within(observed, "ubigeo", "real_coord_ratio")
    return coverage(grid, observed, audit)


def summary(table: DataFrame) -> DataFrame:
    """Percentages over the grid and the number of cells for each reason, one row."""
    pct = lambda c: F.round(100 * F.avg(c.cast("double")), 6)
    return table.agg(
        F.count("*").alias("cells"), pct(F.col("tiene_registro")).alias("pct_registro"), pct(F.col("tiene_auditoria")).alias("pct_auditoria"), pct(F.col("evaluable")).alias("pct_evaluable"),
        *[F.count(F.when(F.col("motivo") == r, 1)).alias(r) for r in REASONS],
    )


def threshold_view(table: DataFrame, quality: str, least_quality: float, least_support: int) -> DataFrame:
    """Cells and records in three exclusive states: passing both thresholds, evaluable only, not evaluable."""
    passes = F.col("evaluable") & (F.col(quality) >= least_quality) & (F.col("soporte_registros") >= least_support)
    state = F.when(F.coalesce(passes, F.lit(False)), "firme").when(F.col("evaluable"), "evaluable").otherwise("no_evaluable")
    return table.groupBy(state.alias("estado")).agg(F.count("*").alias("cells"), F.sum("soporte_registros").cast("long").alias("records"))


def district_rollup(table: DataFrame) -> DataFrame:
    """Cells that are not evaluable and their records by district."""
    return table.where("not evaluable").groupBy("departamento", "distrito").agg(F.count("*").alias("cells"), F.sum("soporte_registros").cast("long").alias("records"))

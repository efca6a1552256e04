"""Column functions shared by the operators. Missing is NULL everywhere; NaN is turned into NULL at the boundary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def no_nan(x: Column) -> Column:
    """NaN as NULL."""
    return F.nanvl(x, F.lit(None).cast("double"))


def no_blank(x: Column) -> Column:
    """Empty and blank strings as NULL: an empty key must never join."""
    return F.nullif(F.trim(x), F.lit(""))


def missing(x: Column) -> Column:
    """True for NULL and NaN; a measured zero is not missing."""
    return F.isnull(x) | F.isnan(x.cast("double"))


def ratio(top: Column, bottom: Column) -> Column:
    """``top / bottom`` where the denominator is positive, else missing."""
    return F.when(bottom > 0, top / bottom)


def first_of(x: Column) -> Column:
    """First element of an array, NULL where it is empty."""
    return F.when(F.size(x) > 0, F.element_at(x, 1))


#: Texts of a true and of a false flag, lower-cased (fixed values).
TRUE, FALSE = ("true", "yes", "1", "-1"), ("false", "no", "0", "", "none")


def lenient_bool(x: Column) -> Column:
    """The true texts are true, anything else is false."""
    return F.coalesce(F.lower(F.trim(x)).isin(*TRUE), F.lit(False))


def strict_bool(x: Column) -> Column:
    """The true and the false texts, missing for NULL; any other text raises."""
    y = F.lower(F.trim(x))
    return F.when(x.isNull(), F.lit(None).cast("boolean")).when(y.isin(*TRUE), True).when(y.isin(*FALSE), False).otherwise(F.raise_error(F.concat(F.lit("not a boolean: "), x)).cast("boolean"))


def clock_hours(x: Column) -> Column:
    """``HH:MM``, or that and more parts, as hours; missing where the first two do not parse."""
    part = lambda k: F.nullif(F.regexp_extract(x, r"^\s*(\d+(?:\.\d+)?)\s*:\s*(\d+(?:\.\d+)?)\s*(?::.*)?$", k), F.lit("")).cast("double")
    return part(1) + part(2) / 60


def leading_number(x: Column) -> Column:
    """The number that a text such as ``"50 mph"`` begins with, missing without one."""
    return F.nullif(F.regexp_extract(x, r"^\s*(\d+(?:\.\d+)?)", 1), F.lit("")).cast("double")


#: Road classes of the hierarchy (fixed values).
ARTERIAL = ("motorway", "motorway_link", "trunk", "trunk_link", "primary", "primary_link")
MIDDLE = ("secondary", "secondary_link")
BUSWAY = ("busway",)


def road_class(x: Column) -> Column:
    """Arterial, intermedia, busway or local; blank is ``sin_dato``, unknown is local."""
    y = F.lower(F.trim(x))
    return F.when(no_blank(x).isNull(), "sin_dato").when(y.isin(*ARTERIAL), "arterial").when(y.isin(*MIDDLE), "intermedia").when(y.isin(*BUSWAY), "busway").otherwise("local")


#: Classes between arterial and local in the second taxonomy (fixed values).
SECONDARY = ("secondary", "secondary_link", "tertiary", "tertiary_link")


def display_class(x: Column) -> Column:
    """The second taxonomy: tertiary counts as ``secundaria``, blank is ``sin declarar``."""
    y = F.lower(F.trim(x))
    return F.when(no_blank(x).isNull(), "sin declarar").when(y.isin(*ARTERIAL), "arterial").when(y.isin(*SECONDARY), "secundaria").when(y.isin(*BUSWAY), "busway").otherwise("local")


def with_class(df: DataFrame, column: str = "highway", display: bool = False) -> DataFrame:
    """``df`` with ``clase`` (and ``arterial`` in the first taxonomy); raises without the column."""
    if column not in df.columns:
        raise KeyError(column)
    if display:
        return df.withColumn("clase", display_class(F.col(column)))
    return df.withColumn("clase", road_class(F.col(column))).withColumn("arterial", F.col("clase") == "arterial")


def opacity(width: Column, low: Column, high: Column, cut: float | None = None) -> Column:
    """1 for the narrowest interval down to 0 for the widest; a missing width is 1, one above ``cut`` is missing."""
    share = F.when(high > low, 1 - (width - low) / (high - low)).otherwise(1.0)
    out = F.when(width.isNull(), 1.0).otherwise(share)
    return out if cut is None else F.when(~F.coalesce(width > cut, F.lit(False)), out)


def firm(support: Column, controls: Column, low: Column, high: Column, least: int) -> Column:
    """Enough support, controls, and a finite interval."""
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))
    return F.coalesce((support >= least) & (controls > 0) & finite(low) & finite(high), F.lit(False))


def blend(observed: Column, latent: Column, a: float) -> Column:
    """Surface between the observed (0) and the latent (1)."""
    return observed * (1 - a) + latent * a


def mercator(lat: Column, lng: Column) -> tuple[Column, Column]:
    """Web-Mercator x, y in the unit square."""
    s = F.sin(F.radians(lat))
    return lng / 360 + 0.5, F.lit(0.5) - F.log((1 + s) / (1 - s)) / (4 * F.pi())


def inverse_mercator(x: Column, y: Column) -> tuple[Column, Column]:
    """Latitude and longitude of Web-Mercator x, y in the unit square."""
    return F.degrees(F.atan(F.sinh((F.lit(0.5) - y) * 2 * F.pi()))), (x - 0.5) * 360


def scale_bar(extent: Column, fraction: float = 0.25) -> Column:
    """Largest 1, 2 or 5 times a power of ten that is at most ``fraction`` of the extent."""
    goal = extent * fraction
    base = F.pow(F.lit(10.0), F.floor(F.log10(goal)))
    return F.when(goal >= 5 * base, 5 * base).when(goal >= 2 * base, 2 * base).otherwise(base)


def downcast(df: DataFrame) -> DataFrame:
    """All double columns as float, at the end of a computation."""
    return df.select(*[F.col(n).cast("float").alias(n) if t == "double" else F.col(n) for n, t in df.dtypes])


def cast_to(df: DataFrame, contract: dict[str, str]) -> DataFrame:
    """Exactly the contract's columns, in its order and types."""
    return df.select(*[F.col(n).cast(t).alias(n) for n, t in contract.items()])

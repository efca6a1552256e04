"""Event study: calendars, matched strata, window counts, Mantel-Haenszel rate ratio, bootstrap.

Time is a number of hours on one absolute axis (day * 24 + hour), so windows may cross midnight.
Windows are half open, ``[lo, hi)``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tessera.functions.scalar import clock_hours

OFFSETS = tuple(range(-12, 13))
#: Text of a report that has a place, upper-cased (fixed value).
LOCATED = "CON COORDENADA"
#: Groups whose draws a task of the bootstrap holds at a time.
GROUPS_HELD = 256


def calendar(spark, first: str, days: int) -> DataFrame:
    """One row for each day: date, ordinal from 0, weekday (Monday 0) and year * 12 + month."""
    day = spark.range(days).select(F.date_add(F.to_date(F.lit(first)), F.col("id").cast("int")).alias("date"), F.col("id").cast("int").alias("day"))
    return day.withColumn("dow", F.weekday("date")).withColumn("ym", F.year("date") * 12 + F.month("date"))


def coerced(points: DataFrame, years: tuple[int, int], box: tuple[float, float, float, float]) -> DataFrame:
    """Points as numbers (what does not parse is missing) with flag 1, a year in range and a place in the box (south, west, north, east)."""
    number = {c: F.col(c).try_cast("double") for c in ("lat", "lng", "flag")} | {"year": F.col("year").try_cast("int")}
    south, west, north, east = box
    return points.withColumns(number).where((F.col("flag") == 1) & F.col("year").between(*years) & F.col("lat").between(south, north) & F.col("lng").between(west, east))


def with_known_hour(events: DataFrame, time: str, category: str, aoristic: tuple[str, ...]) -> DataFrame:
    """Events whose hour means something: not exactly midnight, and of no category that is dated by a range."""
    midnight = F.date_trunc("day", time) == F.col(time)
    return events.where(~midnight & ~F.col(category).isin(*aoristic))


def latent(excess: Column, reporting_rate: Column) -> Column:
    """Excess of reported events as events that took place; missing without a rate."""
    return F.when(reporting_rate > 0, excess / reporting_rate)


def without_pileups(points: DataFrame, keys: tuple[str, ...], most: int) -> DataFrame:
    """Points at coordinates with at most ``most`` rows. Counted over all rows, before any category filter."""
    counts = points.groupBy(*keys).agg(F.count("*").alias("n__")).where(F.col("n__") <= most).drop("n__")
    return points.join(counts, list(keys), "left_semi")


def category(kind: Column, subtype: Column, mode: Column, rules: list[tuple[Column, str]]) -> Column:
    """Crosswalk in which a later rule overrides an earlier one: CASE in reverse order."""
    out = F.lit(None).cast("string")
    for condition, name in rules:
        out = F.when(F.coalesce(condition, F.lit(False)), name).otherwise(out)
    return out


def contaminated(event_days: DataFrame, neighbours: DataFrame) -> DataFrame:
    """Days of a place on which a place nearer than the limit (``neighbours``: stadium, other) had a crowd."""
    return neighbours.join(event_days.select(F.col("stadium").alias("other"), "day"), "other").select("stadium", "day").distinct()


def matched_strata(calendars: DataFrame, events: DataFrame, spoilt: DataFrame) -> DataFrame:
    """``(stadium, day, kh, ctrl_day)``: controls of the same place, month and weekday without event or crowd nearby.

    The earliest kickoff of a day counts. Days without controls have no strata.
    """
    first = events.groupBy("stadium", "day").agg(F.min("kh").alias("kh"))
    treated = calendars.join(first, ["stadium", "day"])
    free = calendars.join(events.select("stadium", "day").distinct(), ["stadium", "day"], "left_anti").join(spoilt, ["stadium", "day"], "left_anti")
    controls = free.select("stadium", "ym", "dow", F.col("day").alias("ctrl_day"))
    return treated.join(controls, ["stadium", "ym", "dow"]).where("ctrl_day <> day").select("stadium", "day", "kh", "ctrl_day")


def long_strata(strata: DataFrame) -> DataFrame:
    """One row for each day to look at: the treated one and its controls, with the hour from which windows count."""
    treated = strata.select("stadium", "day", "kh", F.col("day").alias("at_day"), F.lit(True).alias("treated")).distinct()
    return treated.unionByName(strata.select("stadium", "day", "kh", F.col("ctrl_day").alias("at_day"), F.lit(False).alias("treated")))


def window_counts(strata: DataFrame, incidents: DataFrame, windows: list[tuple[str, float, float]]) -> DataFrame:
    """``(window, stadium, day, a, c, nc)``: incidents in the window of the treated day, of all its controls, and the number of controls.

    Incidents are joined by place and day (a window reaches a bounded number of days), then filtered
    to the hours: an equi join instead of a range join, and it holds for any number of incidents.
    """
    every = F.explode(F.array(*[F.struct(F.lit(n).alias("window"), F.lit(float(lo)).alias("lo"), F.lit(float(hi)).alias("hi")) for n, lo, hi in windows]))
    base = long_strata(strata).withColumn("base", F.col("at_day") * 24 + F.col("kh"))
    looks = base.withColumn("w__", every).select("*", "w__.*").drop("w__")
    looks = looks.withColumn("from", F.col("base") + F.col("lo")).withColumn("to", F.col("base") + F.col("hi"))
    looks = looks.withColumn("d", F.explode(F.sequence(F.floor(F.col("from") / 24), F.floor((F.col("to") - 1e-9) / 24))))
    seen = incidents.select("stadium", F.floor(F.col("t") / 24).alias("d"), "t").groupBy("stadium", "d", "t").agg(F.count("*").alias("n"))
    hits = looks.join(seen, ["stadium", "d"]).where((F.col("t") >= F.col("from")) & (F.col("t") < F.col("to")))
    hits = hits.groupBy("window", "stadium", "day").agg(F.sum(F.when(F.col("treated"), F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(~F.col("treated"), F.col("n")).otherwise(0)).alias("c"))
    sizes = strata.groupBy("stadium", "day").agg(F.count("*").alias("nc")).withColumn("window", F.explode(F.array(*[F.lit(n) for n, _, _ in windows])))
    out = sizes.join(hits, ["window", "stadium", "day"], "left")
    return out.select("window", "stadium", "day", F.coalesce("a", F.lit(0)).alias("a"), F.coalesce("c", F.lit(0)).alias("c"), "nc")


def complement_counts(strata: DataFrame, incidents: DataFrame, lo: float, hi: float) -> DataFrame:
    """Incidents of the calendar day outside ``[kh + lo, kh + hi)``, for the treated day and its controls."""
    base = long_strata(strata)
    seen = incidents.select("stadium", F.floor(F.col("t") / 24).cast("int").alias("at_day"), (F.col("t") - 24 * F.floor(F.col("t") / 24)).alias("h"))
    rows = base.join(seen, ["stadium", "at_day"])
    out = (F.col("h") < F.col("kh") + lo) | (F.col("h") >= F.col("kh") + hi)
    count = lambda c: F.count(F.when(c & out, 1))
    found = rows.groupBy("stadium", "day").agg(count(F.col("treated")).alias("a"), count(~F.col("treated")).alias("c"))
    sizes = strata.groupBy("stadium", "day").agg(F.count("*").alias("nc"))
    return sizes.join(found, ["stadium", "day"], "left").select("stadium", "day", F.coalesce("a", F.lit(0)).alias("a"), F.coalesce("c", F.lit(0)).alias("c"), "nc")


def cleaned(raw: DataFrame, rules: list[tuple[Column, str]], years: tuple[int, int], box: tuple[float, float, float, float], most: int, cells: DataFrame, zone: str, wanted: str) -> DataFrame:
    """Reports as incidents, in the one order of steps that keeps the counts: ``cat, lat, lng, cell, at, hour, midnight``.

    ``raw``: ``flag, year, located, lat, lng, cell, at_ms`` and what ``rules`` read. Flag and years, then any category at
    all, then a place in the box; pile-ups are counted over all categories, as a police station piles up every kind; then the
    cells of ``cells`` and the local time of ``zone``; the ``wanted`` category comes last.
    """
    none = F.lit(None).cast("string")
    known = raw.withColumn("cat", category(none, none, none, rules)).where("cat IS NOT NULL")
    placed = coerced(known.where(F.upper("located") == LOCATED), years, box)
    kept = without_pileups(placed, ("lat", "lng"), most).join(cells.select("cell").distinct(), "cell", "left_semi")
    at = kept.withColumn("at", F.from_utc_timestamp(F.timestamp_millis("at_ms"), zone)).where(F.col("cat") == wanted)
    hour = F.hour("at") + F.minute("at") / 60.0
    return at.select("cat", "lat", "lng", "cell", "at", hour.alias("hour"), (F.col("at") == F.date_trunc("day", "at")).alias("midnight"))


def kickoffs(files: dict[str, DataFrame], domain: tuple[str, ...], first: str) -> DataFrame:
    """``(stadium, event, day, kh)`` of calendars (``stadium, event, date, kickoff``): each file's events, or those of its name where
    it names none, in the ``domain``; a kickoff that is missing or no clock time is left out, and of equal rows one stays."""
    out = None
    for name, df in files.items():
        event = F.col("event") if "event" in df.columns else F.lit(name)
        part = df.select("stadium", event.alias("event"), F.datediff(F.to_date("date"), F.lit(first)).alias("day"), clock_hours(F.col("kickoff")).alias("kh"))
        out = part if out is None else out.unionByName(part)
    return out.where(F.col("event").isin(*domain) & F.col("kh").isNotNull() & F.col("day").isNotNull()).distinct()


def bundle(strata: DataFrame, incidents: DataFrame, windows: list[tuple[str, float, float]], outside: tuple[str, float, float], by: tuple[str, ...] = ("ring", "variant")) -> DataFrame:
    """Counts of every measure, ring and variant at once: ``(by, measure, stadium, day, a, c, nc)``, zeros too.

    ``incidents``: ``stadium, t`` and ``by``. They are counted by minute, meet the days that look at them in one join, and
    each adds to all windows that hold its distance from the kickoff, and to the measure ``outside`` if it lies on
    the calendar day but beyond ``[lo, hi)``: one pass over the incidents, however many measures there are.
    """
    name, lo, hi = outside
    reach = (min([lo, *[w[1] for w in windows]]), max([hi, *[w[2] for w in windows]]))
    base = long_strata(strata).withColumn("base", F.col("at_day") * 24 + F.col("kh"))
    days = F.sequence(F.least(F.floor((F.col("base") + reach[0]) / 24), F.col("at_day").cast("long")), F.greatest(F.floor((F.col("base") + reach[1] - 1e-9) / 24), F.col("at_day").cast("long")))
    looks = base.withColumn("d", F.explode(days))
    seen = incidents.groupBy("stadium", F.floor(F.col("t") / 24).alias("d"), "t", *by).agg(F.count("*").alias("n"))
    met = looks.join(seen, ["stadium", "d"]).withColumn("off", F.col("t") - F.col("base"))
    within = [F.when((F.col("off") >= a) & (F.col("off") < b), F.lit(w)) for w, a, b in windows]
    beyond = F.when((F.col("d") == F.col("at_day")) & ((F.col("off") < lo) | (F.col("off") >= hi)), F.lit(name))
    hits = met.withColumn("measure", F.explode(F.array_compact(F.array(*within, beyond))))
    sums = hits.groupBy(*by, "measure", "stadium", "day").agg(F.sum(F.when(F.col("treated"), F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(~F.col("treated"), F.col("n")).otherwise(0)).alias("c"))
    # a handful of rings and variants, as many as the incidents have
    sizes = strata.groupBy("stadium", "day").agg(F.count("*").alias("nc")).withColumn("measure", F.explode(F.array(*[F.lit(w) for w, _, _ in windows], F.lit(name))))
    kinds = incidents.groupBy("stadium", *by).agg(F.lit(1).alias("one")).select(*by).distinct()
    listed = kinds.agg(F.collect_set(F.struct(*by)).alias("kinds"))
    every = sizes.withColumn("kinds", listed.scalar()).withColumn("k", F.explode("kinds")).select("stadium", "day", "nc", "measure", "k.*")
    out = every.join(sums, [*by, "measure", "stadium", "day"], "left")
    return out.select(*by, "measure", "stadium", "day", F.coalesce("a", F.lit(0)).alias("a"), F.coalesce("c", F.lit(0)).alias("c"), "nc")


def rate_ratio(counts: DataFrame, *by: str) -> DataFrame:
    """Mantel-Haenszel: sum of a * nc / (1 + nc) over sum of c / (1 + nc); missing if nothing was expected.

    Support travels beside the value: strata, strata with incidents, controls, expected and excess. These two are sums of
    decimals, so that they are the same in whatever order rows come and an excess of nothing is 0.
    """
    a, c, nc = F.col("a"), F.col("c"), F.col("nc")
    bottom = F.sum(c / (1 + nc))
    expected = F.sum(c.cast("decimal(18,0)") / F.greatest(nc, F.lit(1)).cast("decimal(18,0)"))
    return counts.groupBy(*by).agg(
        F.round(F.when(bottom > 0, F.sum(a * nc / (1 + nc)) / bottom), 6).alias("rr"), F.count("*").alias("strata"), F.count(F.when(a > 0, 1)).alias("with_events"), F.count(F.when(nc > 0, 1)).alias("with_controls"),
        F.sum("a").cast("long").alias("observed"), F.round(expected, 6).cast("double").alias("expected"), F.round(F.sum("a").cast("decimal(18,0)") - expected, 6).cast("double").alias("excess"),
    )


def bootstrap(counts: DataFrame, by: str, draws: int = 2000, seed: int = 1) -> DataFrame:
    """95 % interval of the rate ratio of each group: strata drawn anew ``draws`` times.

    A stratum stands in a draw Poisson(1) times, which leaves the spread of a ratio of sums as if as many strata as there
    are had been drawn. ``n`` strata with equal (a, c, nc) stand Poisson(n) times together, from a generator that the seed
    and these numbers key. So a draw is a sum, which tasks add up in parts: a task holds two numbers for each draw and
    group, whatever the size of a group. Missing if fewer than half the draws are finite.
    """
    packed = counts.groupBy(by, "a", "c", "nc").agg(F.count("*").alias("n")).where("a > 0 OR c > 0")
    share = packed.select(by, F.xxhash64(F.lit(seed), by, *[F.col(c).cast("double") for c in ("a", "c", "nc")]).alias("h"), "n", (F.col("a") * F.col("nc") / (1 + F.col("nc"))).alias("top"), (F.col("c") / (1 + F.col("nc"))).alias("bottom"))
    kind = dict(counts.dtypes)[by]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}

        def out() -> Iterator[pa.RecordBatch]:
            for key, sums in held.items():
                yield pa.RecordBatch.from_arrays([pa.array([key] * draws, share_type), pa.array(np.arange(draws, dtype=np.int32)), pa.array(sums[0]), pa.array(sums[1])], names=[by, "draw", "top", "bottom"])
            held.clear()

        for batch in batches:
            for key, h, n, top, bottom in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                times = np.random.Generator(np.random.Philox(key=h % 2**64)).poisson(n, draws)
                if key not in held:
                    if len(held) >= GROUPS_HELD:
                        yield from out()
                    held[key] = np.zeros((2, draws))
                held[key] += np.outer((top, bottom), times)
        yield from out()

    share_type = to_arrow_type(counts.schema[by].dataType)
    sums = share.mapInArrow(run, f"`{by}` {kind}, draw int, top double, bottom double").groupBy(by, "draw").agg(F.sum("top").alias("top"), F.sum("bottom").alias("bottom"))
    ratio = F.col("top") / F.col("bottom")
    ratios = sums.where("bottom > 0").groupBy(by).agg(F.percentile(ratio, F.lit(0.025)).alias("lo"), F.percentile(ratio, F.lit(0.975)).alias("hi"), F.count("*").cast("int").alias("finite"))
    out = counts.select(by).distinct().join(ratios, by, "left")
    enough = F.col("finite") >= draws / 2
    return out.select(by, F.round(F.when(enough, F.col("lo")), 9).alias("lo"), F.round(F.when(enough, F.col("hi")), 9).alias("hi"), F.coalesce("finite", F.lit(0)).alias("finite"))


def filled(profile: DataFrame, by: str, at: str, value: str) -> DataFrame:
    """Gaps between known values filled by a straight line in log2; borders stay missing."""
    w = Window.partitionBy(by).orderBy(at)
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    known = F.when(F.col(value) > 0, F.struct(F.col(at).alias("t"), F.log2(value).alias("l")))
    p, n = F.last(known, True).over(back), F.first(known, True).over(ahead)
    out = profile.withColumn("p__", p).withColumn("n__", n)
    share = (F.col(at) - F.col("p__.t")) / (F.col("n__.t") - F.col("p__.t"))
    line = F.pow(F.lit(2.0), F.col("p__.l") + share * (F.col("n__.l") - F.col("p__.l")))
    return out.withColumn("filled", F.when(F.col(value) > 0, F.col(value)).when(F.col("p__").isNotNull() & F.col("n__").isNotNull(), line)).drop("p__", "n__")


def distance_rings(points: DataFrame, places: DataFrame, edges: tuple[float, ...]) -> DataFrame:
    """Ring ``[lo, hi)`` of each point around each place; a point may lie in rings of several.

    Points meet the places of their own and the neighbouring squares of the outermost edge's length: an
    equi join, however many places there are.
    """
    side = float(edges[-1])
    square = lambda c, name: F.floor(F.col(c) / side).cast("long").alias(name)
    around = F.explode(F.array(*[F.struct((F.floor(F.col("px") / side) + i).cast("long").alias("i__"), (F.floor(F.col("py") / side) + j).cast("long").alias("j__")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    places = places.withColumn("s__", around).select(*places.columns, "s__.*")
    met = points.select("*", square("x", "i__"), square("y", "j__")).join(places, ["i__", "j__"]).drop("i__", "j__")
    far = F.hypot(F.col("x") - F.col("px"), F.col("y") - F.col("py"))
    ring = F.lit(None).cast("string")
    for lo, hi in zip(edges, edges[1:], strict=False):
        ring = F.when((far >= lo) & (far < hi), f"r{lo:g}_{hi:g}").otherwise(ring)
    return met.withColumn("ring", ring).where("ring is not null")

"""Canonical numbers with provenance, and the check of numbers that documents cite.

Entries: ``key, family, variant, value, shown, decimals, mode, canonical, unit, script_sha``. Policies:
``pattern, decimals, mode, canonical`` where ``*`` stands for anything; an exact pattern wins, then the
longest, then the first in the alphabet. An anchor is ``CANON: KEY = CITED [variant-ok]``; KEY names an
entry, or a family, which stands for its canonical variant.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: An anchor, what looks like one, and a number with decimals that might need one (fixed patterns).
ANCHOR = r"CANON:\s*([\w.\-]+)\s*=\s*([~×xX]?\s*[-\d.,]+)(\s+variant-ok)?"
MALFORMED = r"(?i)\bcanon\b"
NUMBER = r"(^|[^\w.])[×xX~]?\s*\d+\.\d+"
#: Rounding without a policy, and the most decimals that are shown.
DECIMALS, MODE = 4, "half_up"


def with_policy(entries: DataFrame, policies: DataFrame) -> DataFrame:
    """Each family's policy; a family without one keeps NULLs and is not canonical."""
    plain = F.regexp_replace("pattern", r"[.+^${}()|\[\]\\]", r"\\$0")
    regex = F.concat(F.lit("(?s)^"), F.replace(F.replace(plain, F.lit("*"), F.lit(".*")), F.lit("?"), F.lit(".")), F.lit("$"))
    # only a pattern with a star stands for others than itself: such patterns meet families by their text before the first sign
    fixed = F.when(F.col("pattern").contains("*"), F.regexp_extract("pattern", r"^[^*?]*", 0)).otherwise(F.col("pattern"))
    found = policies.withColumn("regex__", regex).withColumn("begin__", fixed)
    begins = F.explode(F.transform(F.sequence(F.lit(0), F.char_length("family")), lambda n: F.substring("family", F.lit(1), n)))
    families = entries.select("family").distinct().withColumn("begin__", begins)
    hits = families.join(found, "begin__").where(F.expr("family = pattern OR (pattern LIKE '%*%' AND family RLIKE regex__)"))
    best = F.struct((F.col("pattern") != F.col("family")).alias("a"), (-F.length("pattern")).alias("b"), "pattern", "decimals", "mode", "variant_canonical")
    chosen = hits.groupBy("family").agg(F.min(best).alias("p")).select("family", "p.decimals", "p.mode", F.col("p.variant_canonical").alias("wanted__"))
    out = entries.join(chosen, "family", "left")
    return out.withColumn("canonical", F.coalesce(F.col("variant") == F.col("wanted__"), F.lit(False))).drop("wanted__")


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f(value)`` with the value computed once, however often ``f`` uses it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def rounded(value: Column, decimals: Column, mode: Column) -> Column:
    """Decimal rounding of the shortest text of a value: half_up, half_even or floor; as text with that many decimals.

    The text is rounded once, digit by digit, so any number of decimals holds. NULL for values that are not finite; a
    negative number of decimals raises.
    """
    zeros = lambda n: F.repeat(F.lit("0"), F.greatest(F.lit(0), n).cast("int"))
    first = lambda x, n: F.substring(x, F.lit(1), n)

    def read(s: Column) -> Column:
        """All digits, and how many of them are kept."""
        parts = F.split(F.ltrim(F.replace(s["text"], F.lit("-"), F.lit(" "))), "[.E]")
        power = F.when(s["text"].contains("E"), F.regexp_extract(s["text"], "E(.*)$", 1).cast("int")).otherwise(0)
        digits = F.concat(parts[0], F.when(s["text"].contains("."), parts[1]).otherwise(""))
        keep = F.length(parts[0]) + power + s["decimals"]
        return F.struct(digits.alias("digits"), keep.cast("int").alias("keep"), s["text"].startswith("-").alias("negative"), s["decimals"].alias("decimals"), s["mode"].alias("mode"))

    def cut(s: Column) -> Column:
        """The digits that are kept, one at least, and the rest."""
        padded = F.concat(zeros(1 - s["keep"]), s["digits"], zeros(s["keep"] - F.length(s["digits"])))
        at = F.greatest(s["keep"], F.lit(1))
        return F.struct(padded.alias("padded"), at.alias("at"), s["negative"].alias("negative"), s["decimals"].alias("decimals"), s["mode"].alias("mode"))

    def turn(s: Column) -> Column:
        """Does the last digit grow, and what does not change before it?"""
        head, rest = first(s["padded"], s["at"]), F.substring(s["padded"], s["at"] + 1, F.length(s["padded"]))
        tie, half = F.rtrim(F.replace(rest, F.lit("0"), F.lit(" "))) == "5", rest >= "5"
        odd = F.substring(head, -1, 1).cast("int") % 2 == 1
        up = F.when(s["mode"] == "floor", s["negative"] & (F.replace(rest, F.lit("0"), F.lit("")) != "")).when(s["mode"] == "half_even", half & (~tie | odd)).otherwise(half)
        return F.struct(head.alias("head"), up.alias("up"), F.rtrim(F.replace(head, F.lit("9"), F.lit(" "))).alias("front"), s["negative"].alias("negative"), s["decimals"].alias("decimals"))

    def grown(s: Column) -> Column:
        """All digits after the rounding: the last that is no 9 grows by one, and 9s behind it turn to 0."""
        front = F.replace(s["front"], F.lit(" "), F.lit("9"))
        nines = zeros(F.length(s["head"]) - F.length(front))
        more = F.concat(F.substring(front, F.lit(1), F.length(front) - 1), (F.substring(front, -1, 1).try_cast("int") + 1).cast("string"), nines)
        digits = F.when(~s["up"], s["head"]).when(front == "", F.concat(F.lit("1"), nines)).otherwise(more)
        return F.struct(F.concat(zeros(s["decimals"] + 1 - F.length(digits)), digits).alias("digits"), s["negative"].alias("negative"), s["decimals"].alias("decimals"))

    def shown(s: Column) -> Column:
        point = F.length(s["digits"]) - s["decimals"]
        whole = F.regexp_replace(first(s["digits"], point), "^0+(?=.)", "")
        text = F.when(s["decimals"] == 0, whole).otherwise(F.concat(whole, F.lit("."), F.substring(s["digits"], point + 1, s["decimals"])))
        return F.when(s["negative"] & (F.replace(s["digits"], F.lit("0"), F.lit("")) != ""), F.concat(F.lit("-"), text)).otherwise(text)

    def checked(s: Column) -> Column:
        out = s
        for step in (read, cut, turn, grown):
            out = _let(out, step)
        out = F.when(s["decimals"] < 0, F.raise_error(F.lit("negative number of decimals")).cast("string")).otherwise(_let(out, shown))
        return F.when(s["text"].rlike("^-?[0-9]"), out)

    return _let(F.struct(value.cast("string").alias("text"), decimals.alias("decimals"), mode.alias("mode")), checked)


def emitted(numbers: DataFrame, policies: DataFrame) -> DataFrame:
    """Entries of ``numbers`` (family, variant, value, unit, script_sha), rounded as the policy says."""
    out = with_policy(numbers, policies).withColumn("key", F.concat_ws(".", "family", "variant"))
    return out.withColumn("shown", rounded(F.col("value"), F.coalesce("decimals", F.lit(DECIMALS)), F.coalesce("mode", F.lit(MODE))))


def merged(old: DataFrame, new: DataFrame) -> DataFrame:
    """The registry after an emission: an unchanged number keeps its old provenance, so a rerun makes no churn."""
    both = old.select("*", F.lit(0).alias("turn__")).unionByName(new.select("*", F.lit(1).alias("turn__")), allowMissingColumns=True)
    by_key = Window.partitionBy("key")
    same = (F.min("shown").over(by_key) == F.max("shown").over(by_key)) & (F.count("*").over(by_key) == 2)
    kept = both.withColumn("same__", F.coalesce(same, F.lit(False))).withColumn("last__", F.max("turn__").over(by_key))
    return kept.where((F.col("same__") & (F.col("turn__") == 0)) | (~F.col("same__") & (F.col("turn__") == F.col("last__")))).drop("turn__", "same__", "last__")


def stale(entries: DataFrame, scripts: DataFrame) -> DataFrame:
    """Keys whose script has changed or gone (``scripts``: script, sha256)."""
    now = scripts.select("script", F.col("sha256").alias("now__"))
    return entries.join(now, "script", "left").where("now__ is null or now__ <> script_sha").select("key", "script")


def anchors(lines: DataFrame) -> DataFrame:
    """``(file, line, key, cited, flag)`` of every anchor in ``lines`` (file, line, text)."""
    found = lines.where(F.col("text").contains("CANON:")).withColumn("a", F.explode(F.regexp_extract_all("text", F.lit(ANCHOR), F.lit(0))))
    part = lambda k: F.regexp_extract("a", ANCHOR, k)
    return found.select("file", "line", part(1).alias("key"), F.trim(part(2)).alias("cited"), (part(3) != "").alias("flag"))


def malformed(lines: DataFrame) -> DataFrame:
    """Lines that mean an anchor and are none."""
    return lines.where(~F.col("text").rlike(ANCHOR) & F.col("text").contains("=") & F.col("text").rlike(MALFORMED)).select("file", "line")


def cited_number(text: Column) -> Column:
    """A cited number without signs of about or times and spaces; commas part thousands only beside a point; missing if unreadable."""
    s = F.replace(F.regexp_replace(F.trim(text), "^[×xX~]+", ""), F.lit(" "), F.lit(""))
    s = F.when(s.contains(",") & s.contains("."), F.replace(s, F.lit(","), F.lit(""))).otherwise(s)
    return s.try_cast("decimal(38,15)")


def checked(found: DataFrame, entries: DataFrame, stale_keys: DataFrame | None = None) -> DataFrame:
    """``found`` with a verdict for each anchor, the first that holds.

    ``unknown``, ``no_policy``, ``not_canonical`` (named in full without the flag), ``unreadable``,
    ``too_precise`` (more decimals than the policy's), ``mismatch``, ``stale`` (``stale_keys``: key), ``ok``.
    """
    named = entries.select("key", F.col("key").alias("entry"), F.lit(False).alias("by_family"), "shown", "canonical", "decimals")
    families = entries.where("canonical").select(F.col("family").alias("key"), F.col("key").alias("entry"), F.lit(True).alias("by_family"), "shown", "canonical", "decimals")
    known = named.unionByName(families.join(named.select("key"), "key", "left_anti"))
    old = known.limit(0).select(F.col("key").alias("entry")) if stale_keys is None else stale_keys.select(F.col("key").alias("entry")).distinct()
    out = found.join(known, "key", "left").join(old.withColumn("stale", F.lit(True)), "entry", "left")
    n = cited_number(F.col("cited"))
    verdict = (
        F.when(F.col("entry").isNull(), "unknown").when(F.col("decimals").isNull(), "no_policy")
        .when(~F.col("by_family") & ~F.col("canonical") & ~F.coalesce("flag", F.lit(False)), "not_canonical").when(n.isNull(), "unreadable")
        .when(F.length(F.regexp_extract("cited", r"\.(\d*)$", 1)) > F.col("decimals"), "too_precise").when(n != F.col("shown").cast("decimal(38,15)"), "mismatch")
        .when(F.col("stale"), "stale").otherwise("ok")
    )
    return out.select("file", "line", "key", "cited", verdict.alias("verdict"))


def audit(lines: DataFrame) -> DataFrame:
    """Lines (file, line) that hold a number with decimals and no anchor in themselves or a neighbouring line (heuristic)."""
    near = Window.partitionBy("file").orderBy("line")
    marked = lines.withColumn("anchor", F.col("text").contains("CANON:"))
    for c, beside in (("before", F.lag("anchor").over(near)), ("after", F.lead("anchor").over(near))):
        marked = marked.withColumn(c, F.coalesce(beside, F.lit(False)))
    return marked.where(F.col("text").rlike(NUMBER) & ~F.col("anchor") & ~F.col("before") & ~F.col("after")).select("file", "line")


def figures(one_row: DataFrame) -> DataFrame:
    """A row of figures as ``(key, value)`` rows, ready to be emitted."""
    return one_row.select(*[F.col(c).cast("double").alias(c) for c in one_row.columns]).unpivot([], one_row.columns, "key", "value")


def emission(figures_: DataFrame, policies: DataFrame, prefix: str, variant: str, unit: str, script_sha: str) -> DataFrame:
    """A block of figures ``(key, value)`` as registry entries of the families ``prefix.key``."""
    rows = figures_.select(F.concat(F.lit(prefix + "."), F.col("key")).alias("family"), F.lit(variant).alias("variant"), "value", F.lit(unit).alias("unit"), F.lit(script_sha).alias("script_sha"))
    return emitted(rows, policies)

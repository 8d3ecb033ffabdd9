"""Partial dates (`YYYY-MM` or `YYYY`, never a month that was not given) and ranges of them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .core import let, lookup, strip

_NAMES = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
MONTHS = {n: f"{k:02d}" for k, n in enumerate(_NAMES, 1)} | {n[:3]: f"{k:02d}" for k, n in enumerate(_NAMES, 1)}
#: Terms for the present, and what separates the ends of a range (tried in this order).
CURRENT = ("present", "current", "now", "today", "ongoing", "—", "–", "-", "till date", "till now", "to date")
SEPARATORS = (" – ", " — ", " - ", "–", "—", " to ")


def _found(value: Column, conf: float) -> Column:
    return F.struct(value.cast("string").alias("value"), F.lit(False).alias("current"), F.when(value.isNotNull(), conf).otherwise(0.0).cast("double").alias("conf"))


def date(raw: Column) -> Column:
    """struct<value, current, conf>. The first form that fits decides, even if its month or year is not valid."""

    def forms(t: Column) -> Column:
        def part(pattern: str, k: int) -> Column:
            return F.regexp_extract(t, pattern, k)

        def month(number: Column) -> Column:
            two = F.lpad(number, 2, "0")
            return F.when(two.between("01", "12"), two)

        dash = lambda year, m: F.concat(year, F.lit("-"), m)
        short = part(r"^[a-z]+\.?(?U:\s)+['`](\d{2})$", 1)
        rows = [
            (p := r"^(\d{4})[-/](\d{1,2})$", dash(part(p, 1), month(part(p, 2))), 1.0),
            (p := r"^(\d{1,2})[-/](\d{4})$", dash(part(p, 2), month(part(p, 1))), 1.0),
            (p := r"^([a-z]+)\.?(?U:\s)+(\d{4})$", dash(part(p, 2), lookup(MONTHS, part(p, 1))), 1.0),
            (p := r"^(\d{4})(?U:\s)+([a-z]+)$", dash(part(p, 1), lookup(MONTHS, part(p, 2))), 0.95),
            (p := r"^([a-z]+)\.?(?U:\s)+['`](\d{2})$", dash(F.concat(F.when(short <= "30", "20").otherwise("19"), short), lookup(MONTHS, part(p, 1))), 0.85),
            (p := r"^(\d{4})$", F.when(part(p, 1).between("1950", "2050"), part(p, 1)), 0.8),
        ]
        out = F.when(lookup({c: "now" for c in CURRENT}, t).isNotNull(), F.struct(F.lit(None).cast("string").alias("value"), F.lit(True).alias("current"), F.lit(1.0).alias("conf")))
        for pattern, value, conf in rows:
            out = out.when(t.rlike(pattern), _found(value, conf))
        return out.otherwise(_found(F.lit(None), 0.0))

    return let(F.lower(strip(raw)), forms)


def _sides(raw: Column) -> Column:
    """struct<a, b> of what stands before and after the separator; null without one."""
    cut = None
    for sep in SEPARATORS:
        at = F.instr(raw, sep)
        sides = F.struct(F.left(raw, at - 1).alias("a"), F.substring(raw, at + len(sep), F.length(raw)).alias("b"))
        cut = F.when(at > 0, sides) if cut is None else cut.when(at > 0, sides)
    return cut


def start(raw: Column) -> Column:
    """The start of a range, or else the value of the text as one date; no end is looked at."""
    whole = date(raw)["value"]
    return let(_sides(raw), lambda c: F.when(c.isNull(), whole).otherwise(F.coalesce(date(c["a"])["value"], whole)))


def date_range(raw: Column) -> Column:
    """struct<start, end, current, conf>."""

    def ends(start: Column, end: Column) -> Column:
        conf = F.when(end["current"], start["conf"]).otherwise(F.least(start["conf"], end["conf"]))
        return F.struct(start["value"].alias("start"), end["value"].alias("end"), end["current"].alias("current"), conf.alias("conf"))

    alone = lambda d: F.struct(d["value"].alias("start"), F.lit(None).cast("string").alias("end"), d["current"].alias("current"), d["conf"].alias("conf"))
    return let(_sides(raw), lambda c: F.when(c.isNull(), let(date(raw), alone)).otherwise(let(date(c["a"]), lambda a: let(date(c["b"]), lambda b: ends(a, b)))))

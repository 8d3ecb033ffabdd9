"""Column helpers that Spark lacks: bound intermediates, and Python-compatible rounding, titles and stripping."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once, which keeps nested CASE chains from growing without bound. An aggregate of nothing: its
    start is handed to its finish as it is, whereas a transform of a one-item array copies what the body returns, at every level."""
    return F.aggregate(F.array(), value, lambda kept, _: kept, body)


#: White space in the Unicode sense, and the separators 28 to 31.
WHITE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(text: Column) -> Column:
    """Without white space at both ends. A pattern would be tried at every character."""
    return F.btrim(text, F.lit(WHITE))


def blank_to_null(text: Column) -> Column:
    return let(strip(text), lambda t: F.when(t != "", t))


def py_title(text: Column) -> Column:
    """Every run of letters with its first letter in upper case and the rest in lower case."""
    runs = F.regexp_extract_all(text, F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1))
    return F.array_join(F.transform(runs, capitalise), "")


def capitalise(word: Column) -> Column:
    return F.concat(F.upper(F.substring(word, 1, 1)), F.lower(F.substring(word, 2, 2**31 - 1)))


def py_round(x: Column, places: int) -> Column:
    """A double rounded to so many places (0 to 22) as Python does: by its exact binary value, ties to even; null stays null.

    x times the power of ten is kept as a sum of two doubles, which is exact (each factor is split in halves whose products
    need no rounding), so it is known on which side of a tie x lies.
    """
    scale = 10.0**places
    high_of = lambda v: let(v * 134217729.0, lambda c: c - (c - v))
    sh = scale * 134217729.0 - (scale * 134217729.0 - scale)
    sl = scale - sh

    def told(x: Column, p: Column, high: Column) -> Column:
        low = x - high
        error = ((high * sh - p) + high * sl + low * sh) + low * sl
        whole = F.floor(p)
        side = (p - whole.cast("double") - 0.5) + error
        up = (side > 0) | ((side == 0) & (whole % 2 != 0))
        got = (whole + F.when(up, 1).otherwise(0)).cast("double") / scale
        return F.when((got == 0) & (x < 0), F.lit(-0.0)).otherwise(got)

    return let(x, lambda x: let(x * scale, lambda p: F.when(F.abs(p) < 2.0**52, let(high_of(x), lambda high: told(x, p, high))).otherwise(x)))


def py_round3(x: Column) -> Column:
    return py_round(x, 3)


def quoted(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def literal_map(pairs: dict[str, str]) -> Column:
    """A fixed table as one expression; parsing it is much quicker than building it from single literals."""
    return F.expr("map(" + ", ".join(quoted(x) for pair in pairs.items() for x in pair) + ")")


def literal_structs(rows: list[dict[str, str]]) -> Column:
    return F.expr("array(" + ", ".join("struct(" + ", ".join(f"{quoted(v)} as {k}" for k, v in r.items()) + ")" for r in rows) + ")")


def lookup(pairs: dict[str, str], key: Column) -> Column:
    """The value for key in a small fixed table, or null."""
    return F.try_element_at(literal_map(pairs), key)

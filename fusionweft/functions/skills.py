"""Skills against a taxonomy of aliases. The taxonomy is small and fixed at plan time, so it is part of the expression."""

from __future__ import annotations

import json
from functools import cache
from pathlib import Path

from pyspark.sql import Column
from pyspark.sql import functions as F

from .core import let, literal_structs, lookup, py_title, strip

_FILE = Path(__file__).resolve().parents[1] / "resources" / "skills_taxonomy.json"


def load_taxonomy(path: str | Path = _FILE) -> dict[str, str]:
    """Alias (lower case) to canonical name, in the file's order; empty if the file is missing or damaged."""
    try:
        return {k.lower(): v for k, v in json.loads(Path(path).read_text(encoding="utf-8"))["aliases"].items()}
    except (OSError, ValueError, KeyError):
        return {}


@cache
def taxonomy() -> dict[str, str]:
    return load_taxonomy()


def skill(raw: Column, known: dict[str, str] | None = None) -> Column:
    """struct<value, conf, known>: an alias 1.0, the first alias (in file order) followed by a blank or dot 0.9, else title case 0.7."""
    known = taxonomy() if known is None else known
    aliases = literal_structs([{"b": a + " ", "d": a + ".", "c": c} for a, c in known.items()]) if known else None
    # most are plain (letters, digits and single blanks), of which the patterns below would take nothing away
    cleaned = lambda t: F.when(t.rlike(r"[^\w .+#-]|  "), strip(F.regexp_replace(F.regexp_replace(t, r"(?U)[^\w\s.+#-]", ""), r"(?U)\s+", " "))).otherwise(t)
    clean = let(strip(raw), cleaned)

    def told(value: Column, conf: float, is_known: bool) -> Column:
        return F.struct(value.alias("value"), F.lit(conf).alias("conf"), F.lit(is_known).alias("known"))

    def judged(c: Column) -> Column:
        key = F.lower(c)
        exact = lookup(known, key) if known else F.lit(None).cast("string")
        first = lambda k: F.get(F.filter(aliases, lambda x: k.startswith(x["b"]) | k.startswith(x["d"])), F.lit(0))["c"]
        begun = F.when(c.contains(" ") | c.contains("."), let(key, first)) if known else F.lit(None).cast("string")
        nothing = told(F.lit(""), 0.0, False)
        return F.when(F.coalesce(c == "", F.lit(True)), nothing).otherwise(let(exact, lambda e: F.when(e.isNotNull(), told(e, 1.0, True)).otherwise(let(begun, lambda b: F.when(b.isNotNull(), told(b, 0.9, True)).otherwise(told(py_title(c), 0.7, False))))))

    return let(clean, judged)


def skill_list(raw: Column) -> Column:
    """array<struct<value, conf, known>>: one for each name at its first place, with the highest confidence seen."""
    found = F.filter(F.transform(raw, lambda r: skill(r)), lambda s: s["value"] != "")

    def best(all_: Column) -> Column:
        names = F.array_distinct(F.transform(all_, lambda s: s["value"]))
        of = lambda n: F.filter(all_, lambda s: s["value"] == n)
        top = lambda group: F.array_max(F.transform(group, lambda s: s["conf"]))
        return F.transform(names, lambda n: let(of(n), lambda g: let(top(g), lambda t: F.get(F.filter(g, lambda s: s["conf"] == t), F.lit(0)))))

    return let(found, best)


def skills_in(text: Column) -> Column:
    """Canonical names of all aliases that stand alone in a text, longer aliases first, each name once."""
    ordered = sorted(taxonomy().items(), key=lambda x: -len(x[0]))

    def found(low: Column) -> Column:
        # a plain search for the alias is much cheaper than the pattern and rules most of them out; literal patterns are compiled once
        alone = lambda a: low.contains(a) & low.rlike(rf"(?<![a-zA-Z0-9\-])\Q{a}\E(?![a-zA-Z0-9\-])")
        return F.array_distinct(F.array_compact(F.array(*[F.when(alone(a), F.lit(c)) for a, c in ordered])))

    return let(F.lower(text), found)

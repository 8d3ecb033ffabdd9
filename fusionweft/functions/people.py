"""Names, e-mail addresses and phone numbers. Each normaliser is a Column of struct<value, conf>; value is null where nothing valid is left."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .core import capitalise, let, strip

#: Particles that stay in lower case inside a name.
PARTICLES = ("van", "de", "der", "von", "du", "la", "le", "di", "del", "della")
#: Fixed value: what an address in running text looks like.
EMAIL_IN_TEXT = r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}"
#: Domains whose `+` aliases name one mailbox.
ALIAS_DOMAINS = ("gmail.com", "googlemail.com")


def result(value: Column, conf: Column | float, **more: Column) -> Column:
    conf = conf if isinstance(conf, Column) else F.lit(conf)
    return F.struct(value.cast("string").alias("value"), F.when(value.isNotNull(), conf).otherwise(0.0).cast("double").alias("conf"), *[c.alias(n) for n, c in more.items()])


def title_name(name: Column) -> Column:
    """Words capitalised, hyphens and apostrophes inside them respected, particles lowered."""

    def word(w: Column, i: Column) -> Column:
        low = F.lower(w)
        hyphened = F.array_join(F.transform(F.split(w, "-", -1), lambda p: F.when(F.lower(p).isin(*PARTICLES), F.lower(p)).otherwise(capitalise(p))), "-")
        quoted = F.array_join(F.transform(F.split(w, "'", -1), capitalise), "'")
        return F.when(w.contains("-"), hyphened).when(w.contains("'"), quoted).when(low.isin(*PARTICLES) & (i > 0), low).otherwise(capitalise(w))

    return F.array_join(F.transform(F.split(name, r"(?U)\s+"), word), " ")


def name(raw: Column) -> Column:
    """Annotations in parentheses dropped, `Last, First` turned round (confidence 0.9), title case."""
    noted = lambda n: F.when(n.contains("("), strip(F.regexp_replace(n, r"\(.*?\)", ""))).otherwise(n)
    clean = F.regexp_replace(let(strip(raw), noted), r"(?U)\s{2,}", " ")

    def turned(n: Column) -> Column:
        parts = F.split(n, ",", 2)
        last, first = strip(F.get(parts, F.lit(0))), strip(F.get(parts, F.lit(1)))
        comma = n.contains(",") & (first != "")
        return let(F.struct(F.when(comma, F.concat_ws(" ", first, last)).otherwise(n).alias("n"), F.when(comma, 0.9).otherwise(1.0).alias("c")), lambda p: result(F.when(n != "", title_name(strip(p["n"]))), p["c"]))

    return let(clean, turned)


def email(raw: Column) -> Column:
    """`mailto:` and angle brackets dropped, lower case; the local part ends at the first `@`."""
    bare = F.regexp_replace(strip(raw), r"(?i)^mailto:", "")
    bare = let(bare, lambda e: F.when(e.contains("<"), strip(F.regexp_replace(e, r"^<(.+)>$", "$1"))).otherwise(strip(e)))

    def judged(e: Column) -> Column:
        at = F.instr(e, "@")
        local, domain = F.left(e, at - 1), F.substring(e, at + 1, F.length(e))
        good = (at > 1) & domain.contains(".") & ~local.contains("..")
        return result(F.when(good, F.concat(F.lower(local), F.lit("@"), F.lower(domain))), 1.0)

    return let(bare, judged)


def emails_in(text: Column) -> Column:
    """Valid addresses of a text in order, each once."""
    found = F.transform(F.regexp_extract_all(text, F.lit(EMAIL_IN_TEXT), F.lit(0)), lambda e: email(e)["value"])
    return F.array_distinct(F.filter(found, lambda e: e.isNotNull()))


def raw_emails_in(text: Column) -> Column:
    """Addresses of a text, lowered; neither checked nor made distinct."""
    return F.transform(F.regexp_extract_all(text, F.lit(EMAIL_IN_TEXT), F.lit(0)), F.lower)


def is_alias(address: Column) -> Column:
    at = F.instr(address, "@")
    return F.coalesce(F.substring(address, at + 1, F.length(address)).isin(*ALIAS_DOMAINS) & F.left(address, at - 1).contains("+"), F.lit(False))


def base_address(address: Column) -> Column:
    return F.regexp_replace(address, r"^([^+@]*)\+[^@]*@", "$1@")


def phone(raw: Column, region: str = "US") -> Column:
    """`+` and digits by international prefix (0.6) or, for ten or eleven digits, the default region (0.5)."""
    extended = lambda p: F.when(F.lower(p).contains("x"), strip(F.regexp_replace(p, r"(?Ui)\s*(ext\.?|x)\s*\d+$", ""))).otherwise(p)
    bare = let(strip(raw), extended)

    def judged(p: Column, d: Column) -> Column:
        n, home = F.length(d), F.lit(region.upper() == "US")
        value = (
            F.when(~n.between(7, 15), F.lit(None))
            .when(p.startswith("+"), F.concat(F.lit("+"), d))
            .when(p.startswith("00") & (n > 2), F.concat(F.lit("+"), F.substring(d, 3, 15)))
            .when(home & (n == 10), F.concat(F.lit("+1"), d))
            .when(home & (n == 11) & d.startswith("1"), F.concat(F.lit("+"), d))
        )
        return result(value, F.when(p.startswith("+") | p.startswith("00"), 0.6).otherwise(0.5))

    return let(bare, lambda p: let(F.regexp_replace(p, r"\D", ""), lambda d: judged(p, d)))


def phones_in(text: Column) -> Column:
    """Phone numbers of running text need a numbering-plan library; without one there are none."""
    return F.array().cast("array<string>")

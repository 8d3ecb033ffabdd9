"""Locations: city, region and country from free text, without a country library."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .core import let, lookup, py_title, strip

#: States of the USA and their codes.
STATES = {
    "alabama": "AL", "alaska": "AK", "arizona": "AZ", "arkansas": "AR", "california": "CA", "colorado": "CO", "connecticut": "CT", "delaware": "DE", "florida": "FL", "georgia": "GA", "hawaii": "HI", "idaho": "ID", "illinois": "IL", "indiana": "IN", "iowa": "IA", "kansas": "KS", "kentucky": "KY", "louisiana": "LA", "maine": "ME", "maryland": "MD", "massachusetts": "MA", "michigan": "MI", "minnesota": "MN", "mississippi": "MS", "missouri": "MO", "montana": "MT", "nebraska": "NE", "nevada": "NV", "new hampshire": "NH", "new jersey": "NJ", "new mexico": "NM", "new york": "NY", "north carolina": "NC", "north dakota": "ND", "ohio": "OH", "oklahoma": "OK", "oregon": "OR", "pennsylvania": "PA", "rhode island": "RI", "south carolina": "SC", "south dakota": "SD", "tennessee": "TN", "texas": "TX", "utah": "UT", "vermont": "VT", "virginia": "VA", "washington": "WA", "west virginia": "WV", "wisconsin": "WI", "wyoming": "WY", "district of columbia": "DC",
}
#: Country names and abbreviations that are known without a library.
COUNTRIES = {
    "usa": "US", "u.s.a": "US", "u.s.": "US", "us": "US", "uk": "GB", "u.k.": "GB", "england": "GB", "scotland": "GB", "wales": "GB", "uae": "AE", "u.a.e.": "AE", "south korea": "KR", "north korea": "KP", "taiwan": "TW", "russia": "RU", "vietnam": "VN", "czech republic": "CZ", "iran": "IR", "syria": "SY",
}


def state(text: Column) -> Column:
    code = F.upper(strip(text))
    return let(code, lambda c: F.coalesce(F.when(c.isin(*STATES.values()), c), lookup(STATES, F.lower(strip(text)))))


def country(text: Column) -> Column:
    return lookup(COUNTRIES, F.lower(strip(text)))


def location(raw: Column) -> Column:
    """struct<city, region, country, raw, conf>. `remote` is no place; one part is a country or a city; a state beats a country."""

    def place(raw: Column, conf: Column | float, city: Column | None = None, region: Column | None = None, land: Column | None = None) -> Column:
        text = lambda c: (F.lit(None) if c is None else c).cast("string")
        return F.struct(text(city).alias("city"), text(region).alias("region"), text(land).alias("country"), raw.alias("raw"), F.lit(conf).cast("double").alias("conf"))

    def judged(r: Column, p: Column) -> Column:
        a, b, last = strip(F.get(p, F.lit(0))), strip(F.get(p, F.lit(1))), strip(F.element_at(p, -1))
        city = py_title(a)
        # only what a branch needs is looked up in it
        alone = let(country(a), lambda land: F.when(land.isNotNull(), place(r, 0.8, land=land)).otherwise(place(r, 0.5, city)))
        abroad = let(country(b), lambda land: F.when(land.isNotNull(), place(r, 0.9, city, land=land)).otherwise(place(r, 0.75, city, py_title(b))))
        two = let(state(b), lambda s: F.when(s.isNotNull(), place(r, 0.95, city, s, F.lit("US"))).otherwise(abroad))
        return (
            F.when(F.coalesce(r == "", F.lit(True)), place(F.lit(""), 0.0))
            .when(F.lower(r).contains("remote") & r.rlike(r"(?Ui)\bremote\b"), place(r, 0.7))
            .when(F.size(p) == 1, alone)
            .when(F.size(p) == 2, two)
            .otherwise(place(r, 0.9, city, F.coalesce(state(b), py_title(b)), country(last)))
        )

    return let(strip(raw), lambda r: let(F.split(r, ",", -1), lambda p: judged(r, p)))


def is_empty(loc: Column) -> Column:
    blank = lambda c: c.isNull() | (c == "")
    return loc.isNull() | (blank(loc["city"]) & blank(loc["region"]) & blank(loc["country"]))


def as_text(loc: Column) -> Column:
    """The parts that there are, joined."""
    return F.array_join(F.filter(F.array(loc["city"], loc["region"], loc["country"]), lambda p: p != ""), ", ")

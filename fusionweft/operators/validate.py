"""Validation of projected records. Messages are collected in columns; no record is ever dropped for them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .projection import _NUMBERS

EMAIL, PHONE = r"^[^@]+@[^@]+\.[^@]+$", r"^\+[1-9]\d{6,14}$"
#: A year of education may lie so far ahead.
AHEAD = 10


def _say(bad: Column, text: str | Column) -> Column:
    return F.array(F.when(F.coalesce(bad, F.lit(False)), F.lit(text) if isinstance(text, str) else text))


def _each(name: str, check) -> Column:
    """check(item, label of the item) returns an array of messages (nulls where all is well)."""
    return F.coalesce(F.flatten(F.transform(F.col(name), lambda x, i: check(x, F.concat(F.lit(f"[{name}."), i.cast("string"))))), F.array().cast("array<string>"))


def schema_errors(df: DataFrame) -> Column:
    """array<string> of violations of the default output schema by the columns that df has."""
    kinds = {f.name: f.dataType for f in df.schema}
    out = [_say(F.coalesce(F.col("candidate_id") == "", F.lit(True)), "[candidate_id] must be a non-empty string")]
    is_text = lambda k: isinstance(k, T.StringType)
    for name in ("full_name", "headline"):
        if name in kinds and not is_text(kinds[name]):
            out.append(_say(F.col(name).isNotNull(), f"[{name}] has invalid type"))
    if "years_experience" in kinds and not isinstance(kinds["years_experience"], _NUMBERS):
        out.append(_say(F.col("years_experience").isNotNull(), "[years_experience] has invalid type"))
    for name, pattern in (("emails", EMAIL), ("phones", PHONE), ("sources_ingested", None)):
        kind = kinds.get(name)
        if kind is None:
            continue
        if not isinstance(kind, T.ArrayType):
            out.append(_say(F.lit(True), f"[{name}] must be an array"))
        elif not is_text(kind.elementType):
            out.append(_each(name, lambda x, at: F.array(F.concat(at, F.lit("] must be a string")))))
        else:
            out.append(_say(F.col(name).isNull(), f"[{name}] must be an array"))
            out.append(_each(name, lambda x, at, p=pattern: F.array(F.when(x.isNull(), F.concat(at, F.lit("] must be a string"))).when(~x.rlike(p) if p else F.lit(False), F.concat(at, F.lit("] has invalid format"))))))
    if "location" in kinds:
        place = kinds["location"]
        if not isinstance(place, T.StructType):
            out.append(_say(F.col("location").isNotNull(), "[location] must be an object or null"))
        elif "country" in place.names:
            out.append(_say(F.length("location.country") > 2, "[location.country] must be ISO-3166 alpha-2"))
    if "overall_confidence" in kinds:
        c = F.col("overall_confidence")
        numeric = isinstance(kinds["overall_confidence"], _NUMBERS)
        out.append(_say(~c.between(0, 1) if numeric else c.isNotNull(), "[overall_confidence] must be a number between 0 and 1"))
    out += _objects(kinds)
    return F.filter(F.concat(*out), lambda m: m.isNotNull())


def _objects(kinds: dict[str, T.DataType]) -> list[Column]:
    rules = {
        "skills": [("name", "text!", "must be a non-empty string"), ("confidence", "unit", "must be between 0 and 1")],
        "experience": [("company", "text", "must be a string"), ("title", "text", "must be a string")],
        "education": [("institution", "text", "must be a string"), ("end_year", "int?", "must be an integer or null")],
        "provenance": [("field", "text", "must be a string"), ("source", "text", "must be a string"), ("method", "text", "must be a string")],
    }
    out = []
    for name, checks in rules.items():
        kind = kinds.get(name)
        if kind is None:
            continue
        if not isinstance(kind, T.ArrayType):
            out.append(_say(F.col(name).isNotNull(), f"[{name}] must be an array"))
            continue
        item = kind.elementType
        if not isinstance(item, T.StructType):
            out.append(_each(name, lambda x, at: F.array(F.concat(at, F.lit("] must be an object")))))
            continue

        def check(x: Column, at: Column, item=item, checks=checks) -> Column:
            found = []
            for key, rule, message in checks:
                own = item[key].dataType if key in item.names else T.NullType()
                v = x[key] if key in item.names else F.lit(None).cast("string")
                if rule.startswith("text"):
                    bad = (v.isNull() | ((v == "") if rule == "text!" else F.lit(False))) if isinstance(own, T.StringType) else F.lit(True)
                elif rule == "unit":
                    bad = v.isNull() | ~v.between(0, 1) if isinstance(own, _NUMBERS) else F.lit(True)
                else:
                    bad = F.lit(False) if isinstance(own, (T.IntegerType, T.LongType)) else v.isNotNull()
                found.append(F.when(F.coalesce(bad, F.lit(True)), F.concat(at, F.lit(f".{key}] {message}"))))
            return F.array(*found)

        out.append(_each(name, check))
    return out


def semantic_warnings(df: DataFrame, current_year: int) -> Column:
    """array<string>: reversed date ranges, years of education too far ahead, phones that are not E.164."""
    kinds, out = {f.name: f.dataType for f in df.schema}, []

    def items(name: str, *keys: str) -> bool:
        kind = kinds.get(name)
        return isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType) and set(keys) <= set(kind.elementType.names)

    told = lambda c: F.coalesce(c, F.lit("None"))
    if items("experience", "start", "end"):
        out.append(_each("experience", lambda e, _: F.array(F.when((e["start"] != "") & (e["end"] != "") & (e["start"] > e["end"]), F.concat(F.lit("Invalid date range for "), told(e["company"]), F.lit(": start="), e["start"], F.lit(" > end="), e["end"])))))
    if items("education", "end_year"):
        out.append(_each("education", lambda e, _: F.array(F.when(e["end_year"] > current_year + AHEAD, F.concat(F.lit("Suspicious future education year "), e["end_year"].cast("string"), F.lit(" at "), told(e["institution"]))))))
    phones = kinds.get("phones")
    if isinstance(phones, T.ArrayType) and isinstance(phones.elementType, T.StringType):
        out.append(_each("phones", lambda p, _: F.array(F.when(~p.rlike(PHONE), F.concat(F.lit("Phone not in E.164 format: "), p)))))
    return F.filter(F.concat(*out), lambda m: m.isNotNull()) if out else F.array().cast("array<string>")

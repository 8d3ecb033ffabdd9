"""The weighted confidence of a merged candidate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.core import let, py_round3
from ..functions.places import is_empty

#: Weights of the fields in the order in which they are summed, the bonus for two sources, and the cap without e-mail or name.
WEIGHTS = {"emails": 0.25, "full_name": 0.20, "phones": 0.10, "skills": 0.20, "experience": 0.15, "location": 0.05, "headline": 0.05}
BONUS, CAP, EXPERIENCE = 1.05, 0.50, 0.7


def _sum(values: Column) -> Column:
    """The sum with a running compensation of rounding errors (Neumaier's), as Python's sum() does since 3.12."""

    def add(a: Column, x: Column) -> Column:
        total = a["s"] + x
        lost = F.when(F.abs(a["s"]) >= F.abs(x), (a["s"] - total) + x).otherwise((x - total) + a["s"])
        return F.struct(total.alias("s"), (a["c"] + lost).alias("c"))

    return F.aggregate(values, F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("c")), add, lambda a: a["s"] + a["c"])


def _average(field: str, bonus: bool) -> Column:
    def of(own: Column) -> Column:
        mean = _sum(F.transform(own, lambda p: p["confidence"])) / F.size(own)
        factor = F.when(F.size(F.array_distinct(F.transform(own, lambda p: p["source"]))) >= 2, BONUS).otherwise(1.0) if bonus else F.lit(1.0)
        return F.when(F.size(own) > 0, F.least(mean * factor, F.lit(1.0))).otherwise(0.0)

    return let(F.filter("provenance", lambda p: p["field"] == field), of)


def field_scores() -> dict[str, Column]:
    some = lambda c: F.size(c) > 0
    known = lambda c: F.coalesce(F.col(c) != "", F.lit(False))
    skills = _sum(F.transform("skills", lambda s: s["confidence"])) / F.size("skills")
    return {
        "emails": F.when(some("emails"), _average("emails", True)).otherwise(0.0),
        "full_name": F.when(known("full_name"), _average("full_name", True)).otherwise(0.0),
        "phones": F.when(some("phones"), _average("phones", True)).otherwise(0.0),
        "skills": F.when(some("skills"), F.least(skills, F.lit(1.0))).otherwise(0.0),
        "experience": F.when(some("experience"), EXPERIENCE).otherwise(0.0),
        "location": F.when(~is_empty(F.col("location")), _average("location", False)).otherwise(0.0),
        "headline": F.when(known("headline"), _average("headline", False)).otherwise(0.0),
    }


def with_score(candidates: DataFrame) -> DataFrame:
    """candidates with overall_confidence."""
    overall = _sum(F.array(*[value * F.lit(WEIGHTS[field]) for field, value in field_scores().items()])) / F.lit(sum(WEIGHTS.values()))
    whole = (F.size("emails") > 0) & F.coalesce(F.col("full_name") != "", F.lit(False))
    return candidates.withColumn("overall_confidence", py_round3(F.when(whole, overall).otherwise(F.least(overall, F.lit(CAP)))))

"""JSON documents of applicant systems: records under many spellings of the same fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.core import blank_to_null, strip
from ..schemas import EDUCATION_RAW, EXPERIENCE_RAW, raw_columns
from .base import Source, readable
from .delimited import keep, split_skills

#: Names of a record's fields and the field that each of them fills.
FIELDS = {
    "name": "full_name", "fullName": "full_name", "full_name": "full_name", "candidateName": "full_name",
    "email": "email", "emailAddress": "email", "email_address": "email",
    "phone": "phone", "phoneNumber": "phone", "phone_number": "phone", "mobile": "phone",
    "location": "location", "city": "location",
    "currentTitle": "title", "current_title": "title", "jobTitle": "title", "job_title": "title", "title": "title",
    "currentCompany": "company", "current_company": "company", "company": "company", "employer": "company",
    "headline": "headline", "summary": "headline", "bio": "headline",
    "experience": "experience", "workHistory": "experience", "work_history": "experience", "jobs": "experience",
    "education": "education", "educationHistory": "education", "education_history": "education",
    "skills": "skills", "skillSet": "skills", "skill_set": "skills", "technologies": "skills",
    "linkedinUrl": "linkedin", "linkedin_url": "linkedin", "linkedin": "linkedin",
    "githubUrl": "github", "github_url": "github", "github": "github",
    "portfolioUrl": "portfolio", "portfolio": "portfolio", "website": "portfolio",
}
#: Names inside a job and inside an education, the preferred first.
JOB = {"company": ("company", "employer", "organization"), "title": ("title", "jobTitle", "job_title"), "start": ("start", "startDate", "start_date"), "end": ("end", "endDate", "end_date"), "is_current": ("current", "isCurrent", "is_current"), "summary": ("summary", "description")}
SCHOOL = {"institution": ("institution", "school", "university"), "degree": ("degree", "qualification"), "field": ("field", "major", "fieldOfStudy"), "end_year": ("endYear", "end_year", "graduationYear")}
_NOTHING = ("", "0", "0.0", "false", "null", "[]", "{}")
#: What JSON allows and no more.
_STRICT = {"allowSingleQuotes": "false"}


def _objects(value: Column) -> Column:
    """The objects of a JSON list as struct<m: map of texts, v: variant>; other items are skipped. Null if it is no list."""
    items = F.filter(F.from_json(value, "array<string>"), lambda x: x.startswith("{"))
    return F.transform(items, lambda x: F.struct(F.from_json(x, "map<string,string>").alias("m"), F.try_parse_json(x).alias("v")))


def _first(item: Column, names: tuple[str, ...]) -> Column:
    """The first of the named values that Python holds true: any text but the empty one, and other values that are not nothing."""

    def some(name: str) -> Column:
        value, text = F.try_element_at(item["m"], F.lit(name)), F.schema_of_variant(F.try_variant_get(item["v"], f"$.{name}", "variant")) == "STRING"
        return F.when(value.isNotNull() & (value != "") & (~value.isin(*_NOTHING) | F.coalesce(text, F.lit(False))), value)

    return F.coalesce(*[some(n) for n in names])


def field(entries: Column, name: str) -> Column:
    """A record's value for a field: of the keys that name it, the first in the record's order with a value (even an empty one)."""
    keys = [k for k, v in FIELDS.items() if v == name]
    return F.get(F.filter(entries, lambda e: e["key"].isin(*keys) & e["value"].isNotNull()), F.lit(0))["value"]


def experience(value: Column, company: Column, title: Column) -> Column:
    jobs = _objects(value)
    entry = lambda j: F.struct(*[(F.coalesce(_first(j, names).isNotNull(), F.lit(False)) if n == "is_current" else _first(j, names)).alias(n) for n, names in JOB.items()])
    none = F.lit(None).cast("string")
    alone = F.array(F.struct(company.alias("company"), title.alias("title"), none.alias("start"), none.alias("end"), F.lit(True).alias("is_current"), none.alias("summary")))
    nothing = F.expr(f"cast(array() as {EXPERIENCE_RAW})")
    given = F.filter(F.transform(jobs, entry), lambda j: j.isNotNull())
    return F.when(strip(value).startswith("["), F.coalesce(given.cast(EXPERIENCE_RAW), nothing)).when(company.isNotNull() | title.isNotNull(), alone.cast(EXPERIENCE_RAW)).otherwise(nothing)


def education(value: Column) -> Column:
    entries = F.transform(_objects(value), lambda e: F.struct(*[_first(e, names).alias(n) for n, names in SCHOOL.items()]))
    return F.coalesce(F.when(strip(value).startswith("["), entries).cast(EDUCATION_RAW), F.expr(f"cast(array() as {EDUCATION_RAW})"))


def skill_values(value: Column) -> Column:
    listed = F.filter(F.transform(F.from_json(value, "array<string>"), strip), lambda s: s != "")
    return F.when(strip(value).startswith("["), F.coalesce(listed, F.array().cast("array<string>"))).otherwise(split_skills(value))


def records(texts: DataFrame) -> DataFrame:
    """pos and record (JSON text) of whole documents in a column `value`: a list, {candidates: [...]}, {data: [...] or {...}}, or one record."""
    # a text is one JSON value if it is so between brackets; unlike a parsed variant, this holds for texts of any length
    whole = F.from_json(F.concat(F.lit("["), strip(F.col("value")), F.lit("]")), "array<string>", _STRICT)
    doc = F.when(F.size(whole) == 1, F.get(whole, F.lit(0)))
    items = lambda path: F.from_json(F.get_json_object("doc", path), "array<string>")
    listed = F.get_json_object("doc", "$.candidates")
    data = F.get_json_object("doc", "$.data")
    as_list = lambda text, array: F.when(text.startswith("["), array).when(text.startswith("{"), F.array(text))
    found = (
        F.when(F.col("doc").startswith("["), F.from_json("doc", "array<string>"))
        .when(listed.isNotNull(), F.when(listed.startswith("["), items("$.candidates")))
        .when(data.isNotNull(), as_list(data, items("$.data")))
        .when(F.col("doc").startswith("{"), F.array("doc"))
    )
    return texts.select(F.explode(F.array(doc)).alias("doc")).select(F.posexplode(found).alias("pos", "record")).where(F.col("record").startswith("{"))


class DocumentSource(Source):
    """JSON files, each one document; with lines=True one record in each line, which Spark can split. Bad, empty or missing files have
    no records; items that are no objects are skipped. A document has to fit a cell (2 GB); larger ones are an error of the read."""

    source_type = "ats_json"
    base_confidence = 0.88

    def __init__(self, path: str, lines: bool = False):
        self.path, self.lines = path, lines
        self.source_id = f"ats_json:{path.rstrip('/').rpartition('/')[2]}"

    def extract(self, spark, src_idx, at):
        if not readable(spark, self.path):
            return self.nothing(spark)
        if self.lines:
            return self.from_records(spark.read.text(self.path).select(F.monotonically_increasing_id().alias("pos"), strip(F.col("value")).alias("record")).where(F.col("record").startswith("{")), src_idx, at)
        return self.from_records(records(spark.read.text(self.path, wholetext=True)), src_idx, at)

    def from_records(self, rows: DataFrame, src_idx: int, at) -> DataFrame:
        """RAW rows of a table with pos and record; records that are lines of a large table take this way."""
        entries = rows.select(F.col("pos").cast("bigint").alias("row_idx"), F.map_entries(F.from_json("record", "map<string,string>")).alias("e"))
        plain = ("full_name", "email", "phone", "location", "title", "company", "headline", "linkedin", "github", "portfolio")
        got = entries.select("row_idx", *[blank_to_null(field(F.col("e"), n)).alias(n) for n in plain], *[field(F.col("e"), n).alias(n) for n in ("experience", "education", "skills")])
        got = got.where(keep(F.col("full_name"), F.col("email")))
        one = lambda c: F.when(F.col(c).isNotNull(), F.array(c)).otherwise(F.array().cast("array<string>"))
        links = F.filter(F.array(*[F.struct(F.lit(k).alias("type"), F.col(k).alias("url")) for k in ("linkedin", "github", "portfolio")]), lambda x: x["url"].isNotNull())
        return got.select(
            *raw_columns(
                source_id=F.lit(self.source_id),
                source_type=F.lit(self.source_type),
                extracted_at=self.stamp(at),
                base_confidence=F.lit(self.base_confidence),
                full_name=F.col("full_name"),
                emails=one("email"),
                phones=one("phone"),
                location_raw=F.col("location"),
                headline=F.col("headline"),
                skills_raw=skill_values(F.col("skills")),
                experience=experience(F.col("experience"), F.col("company"), F.col("title")),
                education=education(F.col("education")),
                links=links,
                src_idx=F.lit(src_idx),
                row_idx=F.col("row_idx"),
            )
        )

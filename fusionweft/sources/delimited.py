"""Delimited files with a header, such as recruiters export."""

from __future__ import annotations

import csv
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import people
from ..functions.core import blank_to_null, strip
from ..schemas import raw_columns
from .base import Source, readable

#: For each field the headers that name it, the preferred first.
ALIASES = {
    "full_name": ("name", "full_name", "fullname", "candidate_name", "candidate name"),
    "email": ("email", "email_address", "e-mail", "e_mail"),
    "phone": ("phone", "phone_number", "mobile", "cell", "telephone"),
    "company": ("current_company", "company", "employer", "organization"),
    "title": ("title", "job_title", "current_title", "position", "role"),
    "location": ("location", "city", "address", "loc"),
    "linkedin": ("linkedin", "linkedin_url", "linkedin url"),
    "github": ("github", "github_url", "github url"),
    "skills": ("skills", "skill_set", "technologies", "tech_stack"),
    "headline": ("headline", "summary", "bio", "about"),
}


def split_skills(text: Column) -> Column:
    parts = F.transform(F.split(text, r"[,;|]", -1), strip)
    return F.coalesce(F.filter(parts, lambda s: s != ""), F.array().cast("array<string>"))


def keep(name: Column, email: Column) -> Column:
    """A record counts if it has a name or a valid e-mail address."""
    return name.isNotNull() | people.email(email)["value"].isNotNull()


class DelimitedSource(Source):
    """One CSV file or a folder of them, each read by its own header. Quoted fields may hold separators and quotes, and line ends
    unless multiline=False, which lets Spark split large files; short rows lack their last fields; a byte order mark is dropped; of
    headers that are equal in lower case the last counts. A header is one line."""

    source_type = "csv"
    base_confidence = 0.85

    def __init__(self, path: str, encoding: str = "UTF-8", multiline: bool = True):
        self.path, self.encoding, self.multiline = path, encoding, multiline
        self.source_id = f"csv:{path.rstrip('/').rpartition('/')[2]}"

    def headers(self, spark: SparkSession) -> dict[tuple[str, ...], list[str]]:
        """The files of each header."""
        lines = spark.read.option("sep", "\x01").option("quote", "").option("encoding", self.encoding).schema("value string").csv(self.path)
        begun = lines.select("value", "_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("at")).where("file_block_start = 0")
        found: dict[tuple[str, ...], list[str]] = {}
        for row in begun.groupBy("file_path").agg(F.min_by("value", "at").alias("value")).orderBy("file_path").toLocalIterator():  # one line of each file
            names = next(csv.reader([(row["value"] or "").replace("\ufeff", "")]), [])
            found.setdefault(tuple(n.strip().lower() for n in names), []).append(row["file_path"])
        return found

    def extract(self, spark, src_idx, at):
        if not readable(spark, self.path):
            return self.nothing(spark)
        read = spark.read.option("multiLine", self.multiline).option("quote", '"').option("escape", '"').option("encoding", self.encoding).option("mode", "PERMISSIVE").option("header", True).option("enforceSchema", True)
        parts = []
        for headers, files in self.headers(spark).items():
            names = [f"c{k}" for k in range(len(headers))]
            if not names:
                continue
            rows = read.schema(", ".join(f"{n} string" for n in names)).csv(files)
            at_name = dict(zip(headers, names, strict=True))  # the last of equal headers
            found = {n: next((at_name[a] for a in aliases if a in at_name), None) for n, aliases in ALIASES.items()}
            parts.append(rows.select(*[(blank_to_null(F.col(c)) if c else F.lit(None).cast("string")).alias(n) for n, c in found.items()]))
        if not parts:
            return self.nothing(spark)
        got = reduce(DataFrame.union, parts).withColumn("row_idx", F.monotonically_increasing_id())
        return raw_of(got.where(keep(F.col("full_name"), F.col("email"))), self, src_idx, at)


def raw_of(got, source: Source, src_idx: int, at):
    """RAW rows of a flat table with the fields of ALIASES and row_idx."""
    one = lambda c: F.when(F.col(c).isNotNull(), F.array(c)).otherwise(F.array().cast("array<string>"))
    job = F.struct(F.col("company"), F.col("title"), F.lit(None).cast("string").alias("start"), F.lit(None).cast("string").alias("end"), F.lit(True).alias("is_current"), F.lit(None).cast("string").alias("summary"))
    jobs = F.when(F.col("company").isNotNull() | F.col("title").isNotNull(), F.array(job))
    links = F.filter(F.array(*[F.struct(F.lit(k).alias("type"), F.col(k).alias("url")) for k in ("linkedin", "github")]), lambda x: x["url"].isNotNull())
    return got.select(
        *raw_columns(
            source_id=F.lit(source.source_id),
            source_type=F.lit(source.source_type),
            extracted_at=source.stamp(at),
            base_confidence=F.lit(source.base_confidence),
            full_name=F.col("full_name"),
            emails=one("email"),
            phones=one("phone"),
            location_raw=F.col("location"),
            headline=F.col("headline"),
            skills_raw=split_skills(F.col("skills")),
            experience=F.coalesce(jobs, F.expr("cast(array() as array<struct<company:string,title:string,start:string,end:string,is_current:boolean,summary:string>>)")),
            links=links,
            src_idx=F.lit(src_idx),
            row_idx=F.col("row_idx"),
        )
    )

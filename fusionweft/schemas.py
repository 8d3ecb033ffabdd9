"""Schemas of raw extractions and of merged candidates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EXPERIENCE_RAW = "array<struct<company:string,title:string,start:string,end:string,is_current:boolean,summary:string>>"
EDUCATION_RAW = "array<struct<institution:string,degree:string,field:string,end_year:string>>"
LINKS_RAW = "array<struct<type:string,url:string>>"

#: What every source returns. src_idx and row_idx carry the order of sources and of rows within one, which decides ties.
RAW = {
    "source_id": "string",
    "source_type": "string",
    "extracted_at": "timestamp_ntz",
    "base_confidence": "double",
    "full_name": "string",
    "emails": "array<string>",
    "phones": "array<string>",
    "location_raw": "string",
    "headline": "string",
    "years_experience": "double",
    "skills_raw": "array<string>",
    "experience": EXPERIENCE_RAW,
    "education": EDUCATION_RAW,
    "links": LINKS_RAW,
    "warnings": "array<string>",
    "src_idx": "int",
    "row_idx": "bigint",
}
RAW_DDL = ", ".join(f"{k} {v}" for k, v in RAW.items())

LOCATION = "struct<city:string,region:string,country:string,raw:string>"
EXPERIENCE = "array<struct<company:string,title:string,start:string,end:string,is_current:boolean,summary:string,source:string>>"
EDUCATION = "array<struct<institution:string,degree:string,field_of_study:string,end_year:int,source:string>>"
LINKS = "struct<linkedin:string,github:string,portfolio:string,other:array<string>>"
PROVENANCE = "array<struct<field:string,source:string,method:string,raw_value:string,normalized_value:string,confidence:double,extracted_at:timestamp_ntz,conflict:boolean,conflict_resolution:string>>"

VERSION = "1.0.0"
#: Priorities of source types, and the base confidences of their records.
PRIORITY = {"ats_json": 0.88, "csv": 0.85, "github": 0.75, "resume": 0.65, "notes": 0.50, "unknown": 0.5}
DEFAULT_PRIORITY = 0.5


def empty(kind: str) -> Column:
    return F.from_json(F.lit("[]"), kind)


def raw_columns(**given: Column) -> list[Column]:
    """The columns of RAW in order: those given, and defaults (null, or an empty array) for the rest."""
    out = []
    for name, kind in RAW.items():
        column = given.get(name, F.lit(None)).cast(kind)
        if kind.startswith("array"):
            column = F.coalesce(column, F.expr(f"cast(array() as {kind})"))
        out.append(column.alias(name))
    return out

"""Provenance as rows, and the usual questions to it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def facts(candidates: DataFrame) -> DataFrame:
    """candidate_id, pos and a provenance entry in each row."""
    # before a plain explode Spark filters by the size of what is exploded, and so computes the provenance three times
    return candidates.select("candidate_id", F.posexplode_outer("provenance").alias("pos", "p")).where(F.col("pos").isNotNull()).select("candidate_id", "pos", "p.*")


def for_field(rows: DataFrame, field: str) -> DataFrame:
    return rows.where(F.col("field") == field)


def for_source(rows: DataFrame, source: str) -> DataFrame:
    return rows.where(F.col("source") == source)


def conflicts(rows: DataFrame) -> DataFrame:
    return rows.where("conflict")


def low_confidence(rows: DataFrame, threshold: float = 0.6) -> DataFrame:
    return rows.where(F.col("confidence") < threshold)

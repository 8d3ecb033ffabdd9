"""The whole run: extract, identify and merge, score, project, validate."""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field
from datetime import datetime, timezone
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.merge import merge, spread
from ..operators.projection import project
from ..operators.score import with_score
from ..operators.validate import schema_errors, semantic_warnings
from ..schemas import RAW, VERSION
from ..sources.base import Source
from .config import ProjectionConfig


@dataclass
class Result:
    """rows: the projected view with _errors (required fields that are missing), _json, _invalid and _warnings; nothing is computed before it is asked for."""

    rows: DataFrame
    run_id: str
    run_at: datetime
    sources_attempted: int
    source_failures: dict[str, str] = field(default_factory=dict)

    def good(self) -> DataFrame:
        return self.rows.where(F.size("_errors") == 0)

    def failed(self) -> DataFrame:
        return self.rows.where(F.size("_errors") > 0)

    def write_json(self, path: str) -> None:
        """One record in a line, in parallel: the sink for results that do not fit the driver."""
        self.good().select(F.col("_json").alias("value")).write.text(path)

    def to_dict(self) -> dict:
        """The envelope with all records, for results of a size that the driver can hold."""
        rows = self.rows.orderBy("_first").select("candidate_id", "_json", "_errors", "_invalid", "_warnings").collect()
        good = [r for r in rows if not r["_errors"]]
        return {
            "run_id": self.run_id,
            "run_at": self.run_at.isoformat() + "Z",
            "pipeline_version": VERSION,
            "sources_attempted": self.sources_attempted,
            "candidates_total": len(rows),
            "candidates_failed": len(rows) - len(good),
            "candidates": [json.loads(r["_json"]) for r in good],
            "validation_summary": {"errors": {r["candidate_id"]: r["_invalid"] for r in good if r["_invalid"]}, "warnings": {r["candidate_id"]: r["_warnings"] for r in good if r["_warnings"]}},
        }

    def to_json(self, indent: int | None = 2) -> str:
        return as_json(self.to_dict(), indent)


def as_json(envelope: dict, indent: int | None = 2) -> str:
    return json.dumps(envelope, indent=indent, ensure_ascii=False)


def candidates(raw: DataFrame) -> DataFrame:
    """Merged and scored candidates of raw extractions."""
    return with_score(merge(raw))


def view(merged: DataFrame, config: ProjectionConfig, current_year: int, compat: str = "documented") -> DataFrame:
    shown = project(merged, config, compat)
    return shown.withColumns({"_invalid": schema_errors(shown), "_warnings": semantic_warnings(shown, current_year)})


class Pipeline:
    def __init__(self, sources: list[Source], config: ProjectionConfig | None = None, compat: str = "documented"):
        self.sources, self.config, self.compat = sources, config or ProjectionConfig(), compat

    def run(self, spark: SparkSession, at: datetime | None = None) -> Result:
        at = (at or datetime.now(timezone.utc)).replace(tzinfo=None)
        parts, failures = [], {}
        for k, source in enumerate(self.sources):
            try:
                parts.append(source.extract(spark, k, at))
            except Exception as e:  # a source that cannot be read never stops the others
                failures[f"{k}:{source.source_type}"] = str(e)[:500]
        none = spark.createDataFrame([], ", ".join(f"{n} {t}" for n, t in RAW.items()))
        raw = reduce(DataFrame.unionByName, parts) if parts else none
        rows = view(candidates(spread(raw, "src_idx", "row_idx")), self.config, at.year, self.compat)
        return Result(rows, uuid.uuid4().hex[:8], at, len(self.sources), failures)

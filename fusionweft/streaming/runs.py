"""Raw extractions that arrive as a stream: what each micro-batch tells is kept, and the candidates that it concerns are merged anew
from all that is known of them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..operators.merge import merge_normalised, normalised
from ..operators.score import with_score
from ..plans.config import ProjectionConfig
from ..plans.pipeline import view


def merge_batches(raw: DataFrame, facts: str, sink: Callable[[DataFrame, int], None], config: ProjectionConfig | None = None, current_year: int = 2024) -> DataStreamWriter:
    """A writer that is ready to start. facts is a folder that all executors see, in which the normalised records of each batch are kept.
    sink gets the view of the candidates that a batch concerns, and the batch's number. Both are idempotent for a number: a batch
    that is repeated replaces its records, and reads those of earlier batches only; so must sink be."""

    def one(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        normalised(batch).write.mode("overwrite").parquet(f"{facts}/batch={number}")
        known = spark.read.option("basePath", facts).parquet(f"{facts}/batch=*").where(F.col("batch") <= number)
        concerned = known.where(F.col("batch") == number).select("candidate_id").distinct()
        rows = known.drop("batch").join(concerned, "candidate_id", "left_semi")
        sink(view(with_score(merge_normalised(rows)), config or ProjectionConfig(), current_year), number)

    return raw.writeStream.foreachBatch(one)


def latest(versions: DataFrame) -> DataFrame:
    """Of appended versions (with `batch`), each candidate's last, which holds all that its batches have told."""
    return versions.groupBy("candidate_id").agg(F.max_by(F.struct("*"), "batch").alias("v")).select("v.*")

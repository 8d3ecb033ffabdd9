"""What a source is: something that extracts rows of schemas.RAW and never raises for bad data."""

from __future__ import annotations

from abc import ABC, abstractmethod
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import RAW_DDL

SOURCES: dict[str, type[Source]] = {}


class Source(ABC):
    source_type = "unknown"
    base_confidence = 0.5

    def __init_subclass__(cls, **kw):
        super().__init_subclass__(**kw)
        SOURCES[cls.source_type] = cls

    @abstractmethod
    def extract(self, spark: SparkSession, src_idx: int, at: datetime) -> DataFrame:
        """Rows of schemas.RAW."""

    def nothing(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([], RAW_DDL)

    def stamp(self, at: datetime):
        return F.lit(at.isoformat()).cast("timestamp_ntz")


def readable(spark: SparkSession, path: str) -> bool:
    """Whether the path names data of more than no bytes, in any store that Spark reads."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    try:
        system = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        return bool(system.exists(target)) and system.getContentSummary(target).getLength() > 0
    except Exception:  # a path that no file system takes is a source without data
        return False

"""Helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
import functools
import json
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that separates words: blank and the control characters 9 to 13.
WORD_SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: str.translate table that lowers A-Z and nothing else.
ASCII_LOWER = str.maketrans(_UPPER, _UPPER.lower())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_local: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see (spark.checkpoint.dir).

    Where the session names none, a master on one machine (`local`, as in tests) gets a local folder, the same
    for the whole application; on a cluster that is an error, as executors would write where others cannot read.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        master = spark.sparkContext.master
        if master.partition("[")[0] != "local":
            raise RuntimeError(f"set spark.checkpoint.dir to a folder that the driver and all executors of {master} share")
        application = spark.sparkContext.applicationId
        if application not in _local:
            _local[application] = "file://" + tempfile.mkdtemp(prefix="fusionweft-")
        found = _local[application]
    return found.rstrip("/")


_ROOT = str(Path(__file__).resolve().parents[2])


def ready(df: DataFrame) -> DataFrame:
    """df, with this library's folder on the path of the Python workers to come, wherever the driver was started.

    Clusters install the library on their machines; there the entry does no harm.
    """
    environment = df.sparkSession.sparkContext.environment
    paths = environment.get("PYTHONPATH", "").split(os.pathsep)
    if _ROOT not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([p for p in paths if p] + [_ROOT])
    return df


def _hand_back() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run, a function for mapInPandas or mapInArrow, after which the Python worker gives the memory that it has freed back to
    the system: Spark keeps workers for later tasks, and beside those of other kinds their memory still counts."""

    @functools.wraps(run)
    def and_hand_back(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            _hand_back()

    return and_hand_back


def fresh_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def stored(df: DataFrame, tag: str, compression: str = "snappy") -> DataFrame:
    """df written as Parquet to the shared folder and read again.

    It cuts the lineage: what follows never repeats the work before, and a lost executor costs no more than its own tasks.
    """
    spark = df.sparkSession
    path = fresh_path(spark, tag)
    df.write.parquet(path, compression=compression)
    out = spark.read.schema(df.schema).parquet(path)
    _paths[id(out)] = out, path, None
    return out


#: Bytes that a bucket of bucketed() is meant to hold, and the most buckets that Spark allows by default.
BUCKET_BYTES, MOST_BUCKETS = 128 << 20, 100_000


def buckets(spark: SparkSession, size: int) -> int:
    """How many buckets a table of that many bytes gets. Never fewer than shuffles have partitions, else joins would shuffle the table."""
    conf = spark.conf
    least = conf.get("spark.sql.adaptive.coalescePartitions.initialPartitionNum", None) or conf.get("spark.sql.shuffle.partitions")
    return min(MOST_BUCKETS, max(int(least), -(-size // BUCKET_BYTES)))


def bucketed(df: DataFrame, key: str, number: int, tag: str) -> DataFrame:
    """stored(), in buckets by key: joins and aggregates on key read the table without shuffling it. df: partitioned by key into
    that number already, so each task writes one file. The catalog names the table until drop()."""
    spark = df.sparkSession
    path = fresh_path(spark, tag)
    name = path.rpartition("/")[2].replace("-", "_")
    df.write.bucketBy(number, key).option("path", path).saveAsTable(name, format="parquet")
    out = spark.table(name)
    _paths[id(out)] = out, path, name
    return out


#: The tables that stored() and bucketed() have written, by the DataFrames that read them: path, name in the catalog if any.
_paths: dict[int, tuple[DataFrame, str, str | None]] = {}


def _delete(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def drop(*frames: DataFrame) -> None:
    """Deletes tables of stored() and bucketed() that nothing will read any more."""
    for df in frames:
        _, path, name = _paths.pop(id(df))
        if name:
            df.sparkSession.sql(f"DROP TABLE IF EXISTS {name}")
        _delete(df.sparkSession, path)


def clean(spark: SparkSession) -> None:
    """Deletes all that this driver's operators have left in the shared folder. Results of operators are computed when they
    are read, so call it once those have been written."""
    for df, *_ in list(_paths.values()):
        drop(df)


def literal_rows(spark: SparkSession, rows: list[dict], kind: str) -> DataFrame:
    """A small table that is part of the plan. kind: struct<...> of the rows."""
    return spark.range(1, numPartitions=1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<{kind}>")))


def tables() -> set[int]:
    """Marks of the tables that are there now, for drop_marked()."""
    return set(_paths)


def drop_marked(marks: set[int]) -> None:
    drop(*[df for mark, (df, *_) in list(_paths.items()) if mark in marks])

"""A corpus prepared end to end: language, repeated lines, near duplicates, mixing, packing.

Each stage reads what the one before it has kept, as Parquet from the shared folder, and all but the last return the columns
of `documents`.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fusionweft.llm import langid, linededup, mixing, neardup, packing
from fusionweft.llm.common import drop_marked, stored, table, tables
from fusionweft.llm.queries import vocabulary


#: Of each stage the tables that its operators have left in the shared folder.
_left: dict[str, set[int]] = {}


def _stage(function):
    """A stage that first deletes what other stages have left: its input, their result, has been written and read again."""

    @functools.wraps(function)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        for other in [name for name in _left if name != function.__name__]:
            drop_marked(_left.pop(other))
        before = tables()
        out = function(spark, docs, sf_dir)
        _left[function.__name__] = _left.get(function.__name__, set()) | (tables() - before)
        return out

    return run_stage


def _like(docs: DataFrame, out: DataFrame) -> DataFrame:
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


@_stage
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in a language that the model knows and sets `lang` to the prediction.

    Rejected are null texts, texts without a letter, and texts that the mixture of languages explains worse than noise does
    (foreign scripts and gibberish). Row by row: repeated rows and null doc_ids fare like any others; an empty table stays empty.
    """
    return langid.identified(docs, langid.fit_on_training_rows(docs))


@_stage
def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deletes later repeated runs of lines; documents of which nothing is left go.

    A null text has no lines and stays; repeated rows count as one place and keep their lines alike; an empty table stays empty.
    """
    done = linededup.dedup_lines(docs)
    return _like(docs, done.where((F.col("__removed") == 0) | (F.trim(F.translate("text", "\t\n\x0b\x0c\r", "     ")) != "")))


@_stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates.

    Texts without words are linked with nothing and stay; of rows that repeat a doc_id and its text one stays; an empty table
    stays empty.
    """
    return _like(docs, neardup.one_of_each(docs))


@_stage
def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats documents of small sources, up to twice; every document is used.

    A document's copies are equal rows; the packing stage numbers them. A null source is one of its own; a source without any
    token keeps each document once; an empty table stays empty.
    """
    return _like(docs, mixing.mix(docs, max_repeats=mixing.MAX_REPEATS))


@_stage
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs all documents into sequences of 4096 tokens: token ids, place, and which copy of a document a piece belongs to.

    A null text is an empty document; repeated rows are packed as often as they occur; an empty table gives an empty result.
    """
    return packing.pack(docs, vocabulary())


STAGES = [("language", language), ("line_dedup", lines), ("near_dedup", near_duplicates), ("mixing", mixed), ("packing", packed)]

#: SQL can express neither the language model nor the packing plan; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

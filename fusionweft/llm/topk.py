"""Exact top-k search by integer inner product: exhaustive, term at a time.

Components are quantised to floor(256 * x). A term is a dimension; its posting list holds the rows of a block in which the
component is not zero, with their weights. Queries are sparse rows of terms: each term scatters its weight times the
postings' weights into dense score arrays (a row for each query, a column for each row of the block). The best k of a block
are selected by partition, and the blocks' winners are merged.

Rows are dealt into blocks of about `BLOCK` by hash and queries into blocks of about `QUERY_BLOCK`; each pair of blocks is a
cell, worked on by one task in bounded memory. Rows are copied once for each block of queries, so what is shuffled and kept
is proportional to that, never to the number of scores. All pairs are scored, as the search is exhaustive; that is the one
product of the two sides.

Cases: vectors that are null, or hold a null or non-finite component, take no part, neither do rows without an id; missing
components count as 0; a query is never its own result (rows with the query's id are left out); repeated rows are candidates
as often as they occur; a query that is repeated is answered once, and rows of one id with different vectors are queries of
their own, each answered in full; ties go to the smaller id; with fewer candidates than k all are returned; an empty table
gives an empty result; other columns are ignored. Components and scores that exceed 64 bits are held at their ends; all
others are exact, whatever their size, as a cell that could exceed 64 bits on the way counts in unbounded integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ready, stored

SCALE = 256
BLOCK, QUERY_BLOCK = 1024, 1024
#: Queries that are scored together in a cell: their score arrays stay in a processor's cache.
TOGETHER = 64


def quantise(frame: DataFrame, key: str, vector: str, scale: int = SCALE) -> DataFrame:
    """id long, q array<long>; valid vectors only."""
    x = F.col(vector)
    good = F.col(key).isNotNull() & x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < float("inf")))
    return frame.where(F.coalesce(good, F.lit(False))).select(F.col(key).cast("long").alias("id"), F.transform(x, lambda v: F.floor(v.cast("double") * scale)).alias("q"))


def _dense(rows: list, kind: type = np.int64) -> np.ndarray:
    width = max((len(r) for r in rows), default=0)
    out = np.zeros((len(rows), width), kind)
    for k, r in enumerate(rows):
        out[k, : len(r)] = r
    return out


def scores(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """All inner products, accumulated term by term."""
    total = np.zeros((len(queries), len(rows)), rows.dtype)
    for term in range(min(queries.shape[1], rows.shape[1])):
        column = rows[:, term]
        postings = np.flatnonzero(column)
        asking = np.flatnonzero(queries[:, term])
        if not len(postings) or not len(asking):
            continue
        weights = queries[asking, term]
        if len(postings) == len(rows) and len(asking) == len(queries):
            total += weights[:, None] * column
        else:
            total[np.ix_(asking, postings)] += weights[:, None] * column[postings]
    return total


def _largest(rows: list) -> int:
    return max((max(-int(min(r)), int(max(r))) for r in rows if len(r)), default=0)


def best(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each query the ids and scores of the k best rows, best first. rows must be sorted by id."""
    for at in range(0, len(queries), TOGETHER):
        block = scores(queries[at : at + TOGETHER], rows)
        if block.dtype == object:
            block = np.clip(block, -(1 << 63), (1 << 63) - 1).astype(np.int64)
        for own, line in zip(query_ids[at : at + TOGETHER], block, strict=True):
            there = np.flatnonzero(ids != own)
            line = line[there]
            if len(line) > k:
                edge = np.partition(line, len(line) - k)[len(line) - k]
                some = np.flatnonzero(line >= edge)  # with all ties of the last place
            else:
                some = np.arange(len(line))
            some = some[np.argsort(-line[some], kind="stable")[:k]]
            yield ids[there[some]], line[some]


def search(frame: DataFrame, queries: DataFrame, key: str, vector: str, k: int = 5) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best rows of frame for each row of queries."""
    single = F.monotonically_increasing_id()  # fixed once it is written; deals out rows that are equal
    rows = stored(quantise(ready(frame), key, vector).withColumn("row", single), "vectors")
    asked = stored(quantise(queries, key, vector).distinct().withColumn("row", single), "queries")
    blocks, query_blocks = max(1, -(-rows.count() // BLOCK)), max(1, -(-asked.count() // QUERY_BLOCK))

    def every(n: int):
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    def dealt(n: int):
        return F.pmod(F.xxhash64("row"), F.lit(n)).cast("int")

    left = asked.select("id", "q", "row", every(blocks).alias("b"), dealt(query_blocks).alias("c"))
    right = rows.select("id", "q", dealt(blocks).alias("b"), every(query_blocks).alias("c"))

    def cell(ask: pd.DataFrame, have: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(ask) and len(have):
            have = have.sort_values("id", kind="stable")
            asked, rows = ask["q"].tolist(), have["q"].tolist()
            wide = _largest(asked) * _largest(rows) * max(map(len, asked)) >= 1 << 63
            kind = object if wide else np.int64
            found = best(ask["id"].to_numpy(), _dense(asked, kind), have["id"].to_numpy(), _dense(rows, kind), k)
            for own, row, (ids, got) in zip(ask["id"].tolist(), ask["row"].tolist(), found, strict=True):
                out += [(own, row, i, s) for i, s in zip(ids.tolist(), got.tolist(), strict=True)]
        return pd.DataFrame(out, columns=["query_id", "row", "vec_id", "score"])

    found = left.groupBy("b", "c").cogroup(right.groupBy("b", "c")).applyInPandas(cell, "query_id long, row long, vec_id long, score long")
    order = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

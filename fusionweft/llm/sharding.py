"""Sharding by Karmarkar-Karp differencing: equal bytes in every shard, equal texts never apart.

A partial partition is a vector of the bytes that each shard has so far. Differencing takes the two partial partitions with
the largest spread and adds them in opposite order, the largest parts of one to the smallest of the other, until one is
left. Groups of equal texts are the units. Units of more than a `LARGE`-th of a shard's fair part, of which there are at most
`LARGE` for each shard, go to the driver. All others fall into buckets by hash; each bucket is differenced in a task of its
own (in stretches of `STRETCH` units, whose results are differenced again). While there are more than `TOGETHER` buckets,
tasks difference as many of their vectors each, which leaves fewer, larger buckets. The last vectors are differenced on the
driver together with the large units: those have the largest spreads and are placed first, and the buckets even out what
they leave. A unit's shard is read back down that tree.

Cases: a null text has no bytes and is a group of its own kind (not the same as an empty text); very long texts weigh their
bytes; ties are broken by the text's hash, so the result does not depend on the order of rows; repeated rows are placed as
often as they occur; a group larger than a shard's fair part makes that shard larger, as groups are indivisible; an empty
table gives an empty result; other columns are ignored; null doc_ids are placed like any others.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ready, stored

SHARDS = 40
OVERHEAD = 16
#: Documents for each bucket, the least number of buckets, and how many buckets are differenced together.
PER_BUCKET, LEAST_BUCKETS, TOGETHER = 5000, 64, 4096
STRETCH = 20_000
LARGE = 256
#: Cells of a shard in which slots are numbered, so that no task numbers a whole shard.
CELLS = 64


def difference(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Merges partial partitions (rows; k parts each). Returns, for each row and part, the part of the result that it goes to, and the result's sums."""
    count, parts = vectors.shape
    label = np.zeros((count, parts), np.int16)
    if not count:
        return label, np.zeros(parts, np.int64)
    order = np.argsort(-vectors, axis=1, kind="stable")
    nodes = list(np.take_along_axis(vectors, order, 1))
    heap = [(int(v[-1] - v[0]), i) for i, v in enumerate(nodes)]
    heapq.heapify(heap)
    joins: list[tuple[int, int, np.ndarray]] = []
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        sums = nodes[a] + nodes[b][::-1]
        turn = np.argsort(-sums, kind="stable")
        nodes[a] = nodes[b] = None
        nodes.append(sums[turn])
        joins.append((a, b, turn))
        heapq.heappush(heap, (int(nodes[-1][-1] - nodes[-1][0]), len(nodes) - 1))
    places: dict[int, np.ndarray] = {len(nodes) - 1: np.arange(parts, dtype=np.int16)}
    for i in range(len(joins) - 1, -1, -1):
        a, b, turn = joins[i]
        own = places.pop(count + i)
        unturned = np.empty(parts, np.int16)
        unturned[turn] = own
        places[a], places[b] = unturned, unturned[::-1]
    for i in range(count):
        label[i, order[i]] = places[i]
    return label, nodes[-1]


def difference_units(sizes: np.ndarray, parts: int) -> np.ndarray:
    """The part of each unit."""
    out, tops, edges = np.zeros(len(sizes), np.int16), [], list(range(0, len(sizes), STRETCH))
    for at in edges:
        some = sizes[at : at + STRETCH]
        vectors = np.zeros((len(some), parts), np.int64)
        vectors[:, 0] = some
        label, _ = difference(vectors)
        out[at : at + STRETCH] = label[:, 0]
        tops.append(np.bincount(label[:, 0], weights=some, minlength=parts).astype(np.int64))
    if len(tops) > 1:
        label, _ = difference(np.stack(tops))
        for k, at in enumerate(edges):
            out[at : at + STRETCH] = label[k][out[at : at + STRETCH]]
    return out


def _fewer(parted: DataFrame, vectors: DataFrame, buckets: int, shards: int) -> tuple[DataFrame, DataFrame, int]:
    """Units (a, b, bucket, part) and vectors (bucket, part, size) after tasks have differenced `TOGETHER` buckets each."""
    left = -(-buckets // TOGETHER)

    def fold(batch: pd.DataFrame) -> pd.DataFrame:
        names, row = np.unique(batch["bucket"].to_numpy(), return_inverse=True)
        sums = np.zeros((len(names), shards), np.int64)
        sums[row, batch["part"].to_numpy()] = batch["size"].to_numpy()
        label, _ = difference(sums)
        return batch.assign(to=label[row, batch["part"].to_numpy()].astype(np.int32))

    grouped = vectors.withColumn("group", F.pmod("bucket", F.lit(left)))
    turned = stored(grouped.groupBy("group").applyInPandas(fold, "bucket int, part int, size long, group int, to int"), "turned")
    units = parted.join(turned, ["bucket", "part"]).select("a", "b", F.col("group").alias("bucket"), F.col("to").alias("part"))
    return stored(units, "units"), turned.groupBy(F.col("group").alias("bucket"), F.col("to").alias("part")).agg(F.sum("size").alias("size")), left


def shard(docs: DataFrame, shards: int = SHARDS, overhead: int = OVERHEAD) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot of every document."""
    spark = docs.sparkSession
    text = F.col("text").cast("binary")
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + overhead
    crc = F.crc32(F.coalesce(text, F.lit(b"")))
    rows = stored(ready(docs).select(F.col("doc_id").cast("long"), size.alias("size"), crc.alias("text_crc32"), F.xxhash64("text").alias("a"), F.xxhash64(F.lit(1), "text").alias("b")), "sizes")
    whole = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("size")).head()
    buckets = max(LEAST_BUCKETS, -(-whole["n"] // PER_BUCKET))
    edge = whole["size"] // (shards * LARGE)
    groups = stored(rows.groupBy("a", "b").agg(F.sum("size").alias("size")).withColumn("bucket", F.pmod(F.col("a"), F.lit(buckets)).cast("int")), "groups")
    large = groups.where(F.col("size") > edge).select("a", "b", "size").orderBy(F.desc("size"), "a", "b").collect()  # at most shards x LARGE rows

    def split(batch: pd.DataFrame) -> pd.DataFrame:
        batch = batch.sort_values(["size", "a", "b"], ascending=[False, True, True], kind="stable")
        return batch.assign(part=difference_units(batch["size"].to_numpy(), shards).astype(np.int32))

    parted = stored(groups.where(F.col("size") <= edge).groupBy("bucket").applyInPandas(split, "a long, b long, size long, bucket int, part int"), "parts")
    vectors = parted.groupBy("bucket", "part").agg(F.sum("size").alias("size"))
    while buckets > TOGETHER:
        parted, vectors, buckets = _fewer(parted, vectors, buckets, shards)
    sums = np.zeros((len(large) + buckets, shards), np.int64)
    sums[: len(large), 0] = [r["size"] for r in large]
    for row in vectors.toLocalIterator():  # buckets x shards rows
        sums[len(large) + row["bucket"], row["part"]] = row["size"]
    label, _ = difference(sums)
    turns = spark.createDataFrame(pd.DataFrame({"bucket": np.repeat(np.arange(buckets), shards), "part": np.tile(np.arange(shards), buckets), "shard": label[len(large) :].ravel()}), "bucket int, part int, shard int")
    alone = spark.createDataFrame([(r["a"], r["b"], int(x)) for r, x in zip(large, label[:, 0], strict=False)], "a long, b long, shard int")
    homes = parted.join(F.broadcast(turns), ["bucket", "part"]).select("a", "b", "shard").union(alone)

    cell = F.pmod(F.xxhash64("doc_id", "b"), F.lit(CELLS)).cast("int")
    placed = stored(rows.join(homes, ["a", "b"]).select("doc_id", "size", "text_crc32", "shard", cell.alias("cell")), "placed")
    before = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    firsts = placed.groupBy("shard", "cell").agg(F.count(F.lit(1)).alias("n")).select("shard", "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    inside = Window.partitionBy("shard", "cell").orderBy("doc_id", "text_crc32", "size")
    numbered = placed.withColumn("at", F.row_number().over(inside) - 1).join(F.broadcast(firsts), ["shard", "cell"])  # shards x CELLS rows
    return numbered.select("doc_id", "size", "text_crc32", "shard", (F.col("first") + F.col("at")).alias("slot"))

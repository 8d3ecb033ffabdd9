"""Connected components of a distributed graph, without gathering links or components on the driver."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ready, stored

#: Links that one task contracts. The number of tasks follows the number of links.
LINKS_PER_TASK = 500_000


def _contracted(links: DataFrame, tasks: int) -> DataFrame:
    """The links of each task replaced by stars: every node (a) with the smallest node (b) that the task's links connect it with."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        up: dict = {}

        def top(x):
            way = []
            while (higher := up.get(x, x)) != x:
                way.append(x)
                x = higher
            for y in way:
                up[y] = x
            return x

        for batch in batches:
            for a, b in zip(batch["a"].tolist(), batch["b"].tolist(), strict=True):
                a, b = top(a), top(b)
                if a != b:
                    up[max(a, b)] = min(a, b)
        nodes = list(up)
        yield pd.DataFrame({"a": nodes, "b": [top(x) for x in nodes]}, columns=["a", "b"])

    return ready(links).coalesce(tasks).mapInPandas(run, links.schema)


def components(links: DataFrame) -> DataFrame:
    """node, root (the smallest node that it is connected with) for every node of links (columns a, b; any comparable type).

    Tasks of `LINKS_PER_TASK` links contract what they hold to stars. While there is more than one task, rounds follow, each
    of which links every node's larger neighbours, then its smaller ones, to the smallest of them, and contracts again. The
    number of rounds grows with the logarithm of the longest path. Each round is written to the shared folder, so a lost
    executor repeats one round at most. Only counts reach the driver.
    """
    pairs = stored(links.where("a != b").select("a", "b"), "links")
    while True:
        tasks = max(1, -(-pairs.count() // LINKS_PER_TASK))
        pairs = stored(_contracted(pairs, tasks), "contracted")
        if tasks == 1 or _all_stars(pairs):
            break
        both = pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = stored(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "low")
        larger = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = stored(larger.where("a != b").distinct(), "large")
        own = stored(large.groupBy("a").agg(F.min("b").alias("m")), "own")
        small = large.join(own, "a").select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b"))
        pairs = stored(small.where("a != b").distinct(), "small")
    return pairs.union(pairs.select(F.col("b").alias("a"), "b").distinct()).toDF("node", "root")


def _all_stars(pairs: DataFrame) -> bool:
    """Whether every node has one smaller neighbour at most, and none if it is a smaller neighbour itself."""
    sides = pairs.select(F.col("a").alias("x"), F.lit(1).alias("below"), F.lit(0).alias("above")).union(pairs.select(F.col("b").alias("x"), F.lit(0).alias("below"), F.lit(1).alias("above")))
    return not sides.groupBy("x").agg(F.sum("below").alias("n"), F.max("above").alias("top")).where("n > 1 or n > 0 and top > 0").limit(1).count()

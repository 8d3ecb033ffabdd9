"""Mixing sources to target weights by temperature.

A source's share of the corpus's tokens is raised to an exponent between 0 and 1 and normalised. The exponent is bisected:
either until the weights have a target entropy, or down to the flattest mix in which no source repeats more often than a
limit. A budget of tokens then buys each source whole epochs and a part of one more. An epoch is a permutation of the
source's blocks (documents fall into `BLOCKS` blocks by hash), each block permuted within; the part of an epoch is the
prefix of that permutation which the budget pays for.

The prefix is found in two steps, so that no task ever sorts a source: running sums over the blocks of a source, then over
the documents of the one block in which the budget ends. There are about as many blocks as documents in a block, so both
steps grow with the square root of the corpus. What comes out is a threshold for each source, and choosing documents is a
plain comparison of hashes: texts are not shuffled. Sources are a table, however many there are; the driver sees sums over
them, of `GRID` exponents at a time while it bisects.

With budget=None the budget is the smallest that uses every document at least once: the most down-weighted source once, the
others repeated. The flattest mix under a limit on repetition then has a closed form.

Cases: tokens are words (runs between blanks, tabs and line ends); null and empty texts have none, and a source without any
token keeps each document once; a null source is a source of its own; rows without doc_id are told apart by their texts;
very long texts count whole; equal rows are chosen alike; an empty table gives an empty result; other columns pass through
untouched (internal ones begin with `__`).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_SPACE, drop, stored

LEAST_BLOCKS = 1024
#: Exponents that are tried in one pass over the sources, and passes: the exponent is known to (GRID + 1) ** -PASSES.
GRID, PASSES = 31, 10
MAX_REPEATS = 2.0
#: The table of sources is sent to every task only up to so many rows; beyond, it is joined by shuffling.
SMALL = 10_000
#: WORD_SPACE in a regular expression.
_BLANK = r" \x09-\x0D"


def words(text: Column) -> Column:
    """The number of words. Each becomes one letter, with the blanks behind it, and the letters are counted; no object is made for
    a character or a word, as translate and split do, whose garbage makes the heaps of executors grow. No blank is looked at
    again from each place before it, so texts of blanks take no longer than others."""
    letters = F.regexp_replace(text, f"[^{_BLANK}]++[{_BLANK}]*+", "x")
    return F.coalesce(F.octet_length(F.btrim(letters, F.lit(WORD_SPACE))), F.lit(0)).cast("long")  # blanks before the first word are left


class Totals:
    """Sums over the sources' tokens (a table with column `__tokens`); sources without tokens take no part."""

    def __init__(self, table: DataFrame):
        self.table = table.where("__tokens > 0")
        n = F.col("__tokens")
        self.sources, self.all, self.least, self.most = self.table.agg(F.count(n), F.sum(n), F.min(n), F.max(n)).head()

    def sums(self, exponents: list[float]) -> list[tuple[float, float]]:
        """For each exponent x the sum of s ** x and of s ** x * ln(s) over the sources' shares s."""
        share = F.col("__tokens") / F.lit(float(self.all))
        power = [F.pow(share, F.lit(x)) for x in exponents]
        row = self.table.agg(*[c for k, w in enumerate(power) for c in (F.sum(w).alias(f"z{k}"), F.sum(w * F.log(share)).alias(f"y{k}"))]).head()
        return [(row[f"z{k}"], row[f"y{k}"]) for k in range(len(exponents))]

    def bisect(self, good) -> float:
        """The boundary of good(x, sum, sum of logarithms), which holds from some exponent in 0 to 1 on upwards; 1 if nowhere."""
        low, high = 0.0, 1.0
        if good(0.0, *self.sums([0.0])[0]):
            return 0.0
        for _ in range(PASSES):
            tried = [low + (high - low) * k / (GRID + 1) for k in range(1, GRID + 1)]
            fits = [x for x, found in zip(tried, self.sums(tried), strict=True) if good(x, *found)]
            first = min(fits, default=high)
            low, high = max([x for x in tried if x < first], default=low), first
        return high


def entropy(x: float, z: float, y: float) -> float:
    """The entropy of the weights at exponent x, from Totals.sums()."""
    return math.log(z) - x * y / z


def solve(totals: Totals, budget: float | None = None, target_entropy: float | None = None, max_repeats: float | None = MAX_REPEATS) -> float:
    """The exponent. With a target entropy the largest that reaches it (0 if none does); then, if a limit on repetition is
    given, one large enough to keep it (1 if none does)."""
    if not totals.sources:
        return 1.0

    def repeats(x: float, z: float) -> float:
        """How often the smallest source, which is used most, is used."""
        if budget is None:
            return (totals.most / totals.least) ** (1 - x)
        return budget * (totals.least / totals.all) ** x / z / totals.least

    exponent = 0.0
    if target_entropy is not None:
        exponent = totals.bisect(lambda x, z, y: entropy(x, z, y) <= target_entropy)
    if max_repeats is not None and repeats(exponent, totals.sums([exponent])[0][0]) > max_repeats * (1 + 1e-12):
        if budget is None and max_repeats >= 1:
            return 1 - math.log(max_repeats) / math.log(totals.most / totals.least)
        exponent = totals.bisect(lambda x, z, y: repeats(x, z) <= max_repeats * (1 + 1e-12))
    return exponent


def weighted(table: DataFrame, budget: float | None = None, **how) -> DataFrame:
    """table (__source, __tokens) with __exponent, __weight, __whole (epochs) and __part (tokens of one more)."""
    totals = Totals(table)
    exponent = solve(totals, budget, **how)
    n, z = F.col("__tokens"), totals.sums([exponent])[0][0] if totals.sources else 1.0
    weight = F.pow(n / F.lit(float(totals.all or 1)), F.lit(exponent)) / F.lit(z)
    times = F.pow(F.lit(float(totals.most or 1)) / n, F.lit(1 - exponent)) if budget is None else F.lit(float(budget)) * F.col("__weight") / n
    out = table.withColumns({"__exponent": F.lit(exponent), "__weight": F.when(n > 0, weight).otherwise(0.0)})
    out = out.withColumn("__times", F.when(n > 0, times).otherwise(1.0)).withColumn("__whole", F.floor(F.col("__times") + 1e-9).cast("int"))
    return out.withColumn("__part", F.greatest(F.lit(0), F.round((F.col("__times") - F.col("__whole")) * n)).cast("long")).drop("__times")


def _hashes(seed: int) -> dict[str, Column]:
    """Where a row stands: the hash that deals it to a block, and its place in the partly used epoch's permutation."""
    drawn = lambda salt: F.when(F.col("doc_id").isNotNull(), F.xxhash64(F.lit(salt), "doc_id")).otherwise(F.xxhash64(F.lit(salt), F.col("text")))
    return {"__deal": drawn(seed), "__row": drawn(seed + 2)}


def _block(blocks: int) -> Column:
    return F.pmod(F.col("__deal"), F.lit(blocks)).cast("int")


def _block_place(seed: int, epoch: Column) -> Column:
    return F.xxhash64(F.lit(seed + 1), F.col("__source"), F.col("__block"), epoch.cast("int"))


def plan(docs: DataFrame, seed: int = 7, **how) -> tuple[DataFrame, int, bool]:
    """A row for each source: __source, __exponent, __weight, __tokens, __whole (epochs), and the thresholds __at_block, __at_row of the
    part. Further the number of blocks, and whether the table is small enough to be broadcast."""
    whole = stored(docs.select(F.col("source").alias("__source"), words(F.col("text")).alias("__n"), *[c.alias(n) for n, c in _hashes(seed).items()]), "mix")
    number = max(LEAST_BLOCKS, math.isqrt(whole.count()))
    small = whole.withColumn("__block", _block(number))
    blocks = stored(small.groupBy("__source", "__block").agg(F.sum("__n").alias("__n")), "blocks")
    totals = stored(blocks.groupBy("__source").agg(F.sum("__n").alias("__tokens")), "totals")
    few = totals.count() <= SMALL
    table = stored(weighted(totals, **how), "sources")
    sources = F.broadcast(table) if few else table

    same = lambda a, b: a["__source"].eqNullSafe(b["__source"])
    parts = blocks.join(sources, same(blocks, sources)).drop(sources["__source"]).withColumn("__place", _block_place(seed, F.col("__whole")))
    run = Window.partitionBy("__source").orderBy("__place", "__block").rowsBetween(Window.unboundedPreceding, 0)
    summed = parts.withColumn("__sum", F.sum("__n").over(run)).where(F.col("__sum") > F.col("__part"))
    edge = summed.groupBy("__source").agg(F.min_by(F.struct("__block", "__place", (F.col("__part") - F.col("__sum") + F.col("__n")).alias("__rest")), F.struct("__sum", "__place")).alias("e"))
    edge = edge.select("__source", "e.*")  # one block of each source
    edge = F.broadcast(edge) if few else edge
    inside = small.join(edge, same(small, edge) & (small["__block"] == edge["__block"])).select(small["__source"], "__row", "__n", "__rest", "__place")
    run = Window.partitionBy("__source").orderBy("__row").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    paid = inside.withColumn("__paid", F.sum("__n").over(run) <= F.col("__rest"))
    lines = paid.groupBy("__source").agg(F.first("__place").alias("__at_block"), F.max(F.when(F.col("__paid"), F.col("__row"))).alias("__at_row"))
    out = sources.join(lines, same(sources, lines), "left").drop(lines["__source"])
    out = stored(out, "mixplan")
    drop(whole, blocks, totals, table)
    return out, number, few


def mix(docs: DataFrame, seed: int = 7, **how) -> DataFrame:
    """docs, each row as often as the mix uses it, with __epoch (from 0), __weight of its source, __exponent, and the place in that
    epoch's permutation of the source: __block_place, then __row. how: budget (tokens), target_entropy, max_repeats."""
    sources, blocks, few = plan(docs, seed, **how)
    sources = F.broadcast(sources) if few else sources
    rows = docs.withColumns(_hashes(seed)).withColumn("__block", _block(blocks))
    joined = rows.join(sources, rows["source"].eqNullSafe(sources["__source"]))
    place = _block_place(seed, F.col("__whole"))
    before = (place < F.col("__at_block")) | ((place == F.col("__at_block")) & (F.col("__row") <= F.col("__at_row")))
    extra = F.when(F.col("__part") > 0, F.coalesce(before, F.lit(False)).cast("int")).otherwise(0)
    counted = joined.withColumn("__epoch", F.col("__whole") + extra)
    used = counted.withColumn("__epoch", F.explode(F.expr("if(__epoch > 0, sequence(0, __epoch - 1), cast(array() as array<int>))")))
    return used.withColumn("__block_place", _block_place(seed, F.col("__epoch"))).drop("__source", "__tokens", "__deal", "__whole", "__part", "__at_block", "__at_row")

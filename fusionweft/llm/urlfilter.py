"""URL filter: explicit rules first, then a logistic regression on hashed character n-grams of host and path.

Features, rules and scores are column expressions; judging is a narrow projection over the pages, without a shuffle. Only the
fit of the model runs on the driver, on the hashed features of the labelled table, which is small by its bound
`MOST_LABELLED`; its result is `BUCKETS` + 1 numbers in the plan.

Cases: a null url, or one without `://`, has empty host and path, fits no rule and is scored like any other; very long
urls are read whole; of rules that fit, the longest wins, then the one with the longer host, then `block`; repeated rows
get equal results; an empty table gives an empty result; other columns are ignored. Without labelled rows of both labels the
method allows everything (score 0).
"""

from __future__ import annotations

import json
import math
import random
from collections import Counter
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import literal_rows

BUCKETS = 8192
GRAM = 3
EPOCHS = 600
RATE = 30.0
DECAY = 1e-5
#: Training reads so many labelled rows at most: those whose urls have the smallest hashes.
MOST_LABELLED = 4000
#: Rules are part of the plan; more of them belong in a table that is joined.
MOST_RULES = 2000
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: Words of the labelled table's unwanted hosts and paths. Wanted ones have none of them.
_UNWANTED = ("casino", "poker", "pills", "xxx", "torrent", "jackpot", "loans", "betting", "adult", "cheap", "clickbait", "warez", "spin", "win", "lottery", "escort", "free-money", "viagra", "crypto-double", "hot-singles", "replica", "payday", "keygen", "slots", "prize", "miracle-diet", "porn", "nude")
_WANTED = ("library", "science", "history", "docs", "museum", "journal", "school", "garden", "recipes", "weather", "maps", "music", "letters", "news", "physics", "village", "research", "wiki", "travel", "health", "city", "forum")


def invented_urls(count: int = 4000, seed: int = 11) -> list[tuple[str, int]]:
    """Urls and labels (1: unwanted), half of each. Both kinds have the same shapes: names of random syllables, clusters of
    consonants or dictionary words, with or without www, m or blog, and paths of languages, words, numbers and queries. Unwanted ones
    have an unwanted word in the host, the path or both, alone or run into other parts."""
    draw = random.Random(seed)
    name = lambda: "".join(draw.choice(("th", "tr", "st", "b", "c", "d", "g", "l", "m", "n", "p", "r", "s", "t", "v", "w", "h", "nd", "ng", "")) + draw.choice("aeiou" * 4 + "y  ").strip() + draw.choice(("", "", "n", "r", "s", "t", "th", "nd", "st")) for _ in range(draw.randint(2, 4))) or "site"
    plain = lambda: draw.choice((name, name, name, lambda: draw.choice(_WANTED), lambda: draw.choice(_WANTED) + "-" + name(), lambda: name() + draw.choice(_WANTED)))()
    rows = []
    for k in range(count):
        bad = k % 2
        spam = lambda: "-".join(draw.sample(_UNWANTED, draw.randint(1, 2)))
        joined = lambda: draw.choice((spam(), spam() + draw.choice(("", "-")) + plain(), plain() + draw.choice(("", "-")) + spam()))
        where = draw.choice(("host", "host", "path", "both")) if bad else ""
        host = draw.choice(("", "", "www.", "m.", "blog.")) + (joined() if where in ("host", "both") else plain()) + draw.choice((".example.com", ".example.net", ".example.org", ".example"))
        parts = [draw.choice(("en", "de", "fr", "es", "it", "a", "p"))] * draw.randint(0, 1) + [plain()] * draw.randint(0, 1) + [spam()] * (where in ("path", "both")) + [str(draw.randint(1, 99999))] * draw.randint(0, 1)
        path = "".join("/" + x for x in parts) + draw.choice(("", "/", ".html", "?page=2", "?utm_source=feed", "#top"))
        rows.append((f"http{draw.choice(('', 's'))}://{host}{path}", bad))
    return rows


def labelled_urls(spark: SparkSession) -> DataFrame:
    """url string, label int (1: unwanted): the small labelled table of invented urls."""
    return literal_rows(spark, [{"url": u, "label": n} for u, n in invented_urls()], "struct<url:string,label:int>")


def held_out(url: Column | None = None) -> Column:
    """True for the quarter of labelled urls that teach nothing when the accuracy is measured."""
    return F.pmod(F.xxhash64(F.lit("held"), F.col("url") if url is None else url), F.lit(4)) == 2


def held_out_accuracy(labelled: DataFrame, cut: float = 0.5) -> float:
    """The share of held-out labelled urls that get their label from a model fitted on the others."""
    weights, url = train(labelled.where(~held_out())), F.col("url")
    right = (score(host_of(url), path_of(url), weights) >= cut) == (F.col("label") == 1)
    return labelled.where(held_out()).agg(F.avg(right.cast("double"))).head()[0]


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, with A-Z lowered; empty where there is none."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _UPPER.lower())


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def matched(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """The rule that holds (a string like `net/`) and its verdict; nulls where none fits."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    split = [(r, r.partition("/")[0].lower(), "/" + r.partition("/")[2], v) for r, v in rules]
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, name, start, says in sorted(split, key=lambda x: (len(x[0]), len(x[1]), x[3] == "block", x[0])):  # the last that fits wins
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def buckets(host: Column, path: Column) -> Column:
    """Hashed n-grams of the host and, apart from them, of the path."""

    def part(tag: str, text: Column) -> Column:
        framed = F.concat(F.lit("^"), text, F.lit("$"))
        found = F.regexp_extract_all(framed, F.lit(f"(?s)(?=(.{{{GRAM}}}))"), F.lit(1))  # overlapping, in one pass over the text
        return F.transform(F.when(F.size(found) > 0, found).otherwise(F.array(framed)), lambda g: F.pmod(F.xxhash64(F.lit(tag), g), F.lit(BUCKETS)).cast("int"))

    return F.concat(part("host", host), part("path", path))


def train(labelled: DataFrame) -> list[float]:
    """Weights of the buckets and, last, the bias. labelled: url, label (0 or 1; rows in which either is null teach nothing)."""
    few = labelled.where("url is not null and label in (0, 1)").select("url", "label").orderBy(F.xxhash64("url"), "url", "label").limit(MOST_LABELLED)
    url = F.col("url")
    rows = few.select(buckets(host_of(url), path_of(url)).alias("b"), F.col("label").cast("double").alias("y"))
    data = sorted((r["y"], sorted(Counter(r["b"]).items())) for r in rows.collect())  # at most MOST_LABELLED
    if {y for y, _ in data} != {0.0, 1.0}:
        return [0.0] * BUCKETS + [-100.0]
    y = np.array([y for y, _ in data])
    row = np.repeat(np.arange(len(data)), [len(found) + 1 for _, found in data])
    column = np.array([b for _, found in data for b in (*[b for b, _ in found], BUCKETS)])
    value = np.array([v for _, found in data for v in (*[n / math.sqrt(sum(m for _, m in found)) for _, n in found], 1.0)])
    weights = np.zeros(BUCKETS + 1)
    for _ in range(EPOCHS):
        miss = 1 / (1 + np.exp(-np.bincount(row, value * weights[column]))) - y
        weights -= RATE * (np.bincount(column, value * miss[row], BUCKETS + 1) / len(y) + DECAY * weights)
    return weights.round(6).tolist()


def score(host: Column, path: Column, weights: list[float]) -> Column:
    """The probability that the page is unwanted."""
    table = F.from_json(F.lit(json.dumps(weights[:-1])), "array<double>")  # folded into one literal
    found = buckets(host, path)
    total = F.aggregate(found, F.lit(0.0), lambda sum_, b: sum_ + F.get(table, b))
    return 1 / (1 + F.exp(-(total / F.sqrt(F.size(found)) + F.lit(float(weights[-1])))))


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]], labelled: DataFrame, cut: float = 0.5, key: str = "page_id") -> DataFrame:
    """key, url, host, path, rule, score and verdict (allow or block) of every page."""
    weights = train(labelled)
    parts = pages.select(key, "url").withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    host, path = F.col("host"), F.col("path")
    rule, verdict = matched(host, path, rules)
    known = parts.withColumns({"rule": rule, "_says": verdict, "score": score(host, path, weights)})
    return known.select(key, "url", "host", "path", "rule", "score", F.coalesce("_says", F.when(F.col("score") >= cut, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"))

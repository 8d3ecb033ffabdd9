"""Language identification by inferring a mixture of languages in each document.

Training counts hashed character 2- and 3-grams of every labelled training text, per language. A document is then read as
a mixture: expectation-maximisation estimates which share of its n-grams each language wrote. Sets of languages are
compared by penalised likelihood (each further language must earn `PENALTY` times the logarithm of the text's length), and
the largest share of the chosen set is the prediction; that share is the score.

A further component, noise, gives every n-gram the same probability. The share that it takes beside the chosen languages
tells how much of a text none of them explains; `foreign` texts are those of which it explains more than half.

Cases: null text, or text without a letter: `und`, score 0. Without any training text every other document is `und` too.
Very long texts are read whole. Ties of shares go to the language that sorts first. Repeated rows get equal results;
null doc_ids are predicted like any others; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import lean, ready

#: Hashed n-grams: 2 ** BITS numbers for each language, whatever the corpus.
BITS = 15
ROUNDS = 25
PENALTY = 3.0
SMOOTHING = 0.1
UNKNOWN = "und"
#: Texts are counted in stretches of so many characters, so that memory does not follow the longest one.
STRETCH = 1 << 18
#: Most language values that may be learned; more are an error, not a reason to leave some out. It bounds the broadcast model
#: to 65 MB.
MOST_LANGUAGES = 500


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")


_ascii = np.array([ord(chr(c)) if chr(c).isalpha() else 32 for c in range(128)], np.uint32)


def grams(text: str) -> np.ndarray:
    """Counts by hashed n-gram of the text's letters; all else separates words. Each n-gram is counted in the stretch that it
    begins in, so the result does not depend on `STRETCH`."""
    total = np.zeros(1 << BITS, np.int64)
    points = np.concatenate(([np.uint32(32)], _points(text), [np.uint32(32)])).astype(np.uint32)
    for at in range(0, len(points) - 1, STRETCH):
        own = points[at : at + STRETCH + 2]
        own = np.where(own < 128, _ascii[np.minimum(own, 127)], own)
        two = own[:-1] * np.uint32(0x9E3779B1) ^ own[1:] * np.uint32(0x85EBCA6B)
        two = (two ^ two >> np.uint32(15)) * np.uint32(0x2C1B3C6D)
        three = (two[:-1] ^ own[2:] * np.uint32(0xC2B2AE35)) * np.uint32(0x297A2D39)
        blank = (own[:-1] == 32) & (own[1:] == 32)
        keep = ~(blank[:-1] | blank[1:])
        found = np.concatenate((two[:STRETCH][~blank[:STRETCH]], three[keep]))
        total += np.bincount(found >> np.uint32(32 - BITS), minlength=1 << BITS)
    return total


def fit(docs: DataFrame, bits: int = BITS) -> tuple[list[str], np.ndarray]:
    """The languages, sorted, and the logarithms of their n-gram probabilities.

    docs: text and lang; rows in which either is null teach nothing. Executors add up counts per language, and only
    `languages x 2 ** BITS` numbers travel, however many rows there are.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch["lang"].tolist(), batch["text"].tolist(), strict=True):
                sums.setdefault(lang, np.zeros(1 << bits, np.int64))
                sums[lang] += grams(text)
        for lang, total in sums.items():
            at = np.flatnonzero(total)
            yield pd.DataFrame({"lang": lang, "part": at >> 8, "at": at & 255, "n": total[at]})

    labelled = ready(docs).where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("text", F.col("lang").cast("string"))
    counts = labelled.mapInPandas(lean(count), "lang string, part int, at int, n long").groupBy("lang", "part", "at").agg(F.sum("n").alias("n"))
    packed = counts.groupBy("lang", "part").agg(F.collect_list("at").alias("at"), F.collect_list("n").alias("n"))  # at most 256 each
    model: dict[str, np.ndarray] = {}
    for row in packed.toLocalIterator():
        if row["lang"] not in model and len(model) >= MOST_LANGUAGES:
            raise ValueError(f"more than {MOST_LANGUAGES} languages")
        model.setdefault(row["lang"], np.zeros(1 << bits))[row["part"] * 256 + np.array(row["at"])] = row["n"]
    names = sorted(model)
    if not names:
        return [], np.zeros((0, 1 << bits), np.float32)
    raw = np.stack([model[n] for n in names]) + SMOOTHING
    return names, np.log(raw / raw.sum(1, keepdims=True)).astype(np.float32)


def _mix(chance: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, float]:
    """Shares of the languages (columns of chance) by expectation-maximisation, and the log-likelihood."""
    share = np.full(chance.shape[1], 1 / chance.shape[1])
    for _ in range(ROUNDS if chance.shape[1] > 1 else 0):
        part = chance * share
        new = ((n / part.sum(1)) @ part) / n.sum()
        done = np.abs(new - share).max() < 1e-4
        share = new
        if done:
            break
    return share, float(n @ np.log(chance @ share))


def infer(text: str | None, names: list[str], logs: np.ndarray) -> tuple[str, float, dict[str, float], float]:
    """The prediction, its score, the shares of the chosen languages, and the share of noise beside them. logs: a row for each n-gram."""
    if not names or not text or not any(map(str.isalpha, text)):
        return UNKNOWN, 0.0, {}, 1.0
    counts = grams(text)
    at = np.flatnonzero(counts)
    n = counts[at].astype(np.float64)
    log = logs[at].astype(np.float64)
    top = log.max(1, keepdims=True)
    chance = np.exp(log - top)
    cost = PENALTY * np.log(n.sum() + 1)
    share, _ = _mix(chance, n)
    order = np.argsort(-share, kind="stable")
    best, chosen, shares = -np.inf, order[:1], np.ones(1)
    for k in range(1, len(order) + 1):
        part, fitted = _mix(chance[:, order[:k]] + 1e-300, n)
        if fitted - k * cost <= best:
            break
        best, chosen, shares = fitted - k * cost, order[:k], part
    ranked = sorted(zip(shares.tolist(), [names[i] for i in chosen], strict=True), key=lambda x: (-round(x[0], 9), x[1]))
    flat = np.exp(np.minimum(-BITS * np.log(2) - top[:, 0], 700.0))
    noise = _mix(np.column_stack((chance[:, chosen], flat)), n)[0][-1]
    return ranked[0][1], float(min(1.0, max(0.0, ranked[0][0]))), {name: s for s, name in ranked}, float(min(1.0, max(0.0, noise)))


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray]) -> DataFrame:
    """docs' doc_id with lang_pred, score, shares (map of language to share) and noise (a share as well)."""
    names, logs = model
    sent = docs.sparkSession.sparkContext.broadcast(np.ascontiguousarray(logs.T))  # languages x 2 ** BITS floats, no more

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        logs = sent.value
        for batch in batches:
            got = [infer(text, names, logs) for text in batch["text"].tolist()]
            out = pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "lang_pred": [g[0] for g in got], "score": [g[1] for g in got]})
            out["shares"] = pd.Series([g[2] for g in got], dtype=object)
            yield out.assign(noise=[g[3] for g in got])

    return ready(docs).select(F.col("doc_id").cast("long"), "text").mapInPandas(lean(run), "doc_id long, lang_pred string, score double, shares map<string,double>, noise double")


def identified(docs: DataFrame, model: tuple[list[str], np.ndarray], most_noise: float = 0.5) -> DataFrame:
    """docs in a language that the model knows, with `lang` set to the prediction; all other columns stay.

    Rejected are texts that get `und`, and foreign ones: those of which noise explains more than most_noise. Rows are judged
    one by one, so repeated rows fare alike and null doc_ids do no harm.
    """
    names, logs = model
    sent = docs.sparkSession.sparkContext.broadcast(np.ascontiguousarray(logs.T))
    at = docs.columns.index("text")
    kind = T.StructType([*docs.schema.fields, T.StructField("__lang", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logs = sent.value
        for batch in batches:
            got = [infer(text, names, logs) for text in batch.column(at).to_pylist()]
            found = pa.array([None if g[0] == UNKNOWN or g[3] > most_noise else g[0] for g in got], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, found], [*batch.schema.names, "__lang"])

    told = ready(docs).mapInArrow(lean(run), kind).where("__lang is not null")
    return told.select(*[F.col("__lang").alias("lang") if c == "lang" else F.col(f"`{c}`") for c in docs.columns])


def held_out(doc_id: str = "doc_id"):
    """True for the quarter of documents that teach nothing: crc32 of the id as text leaves 2 modulo 4. Null ids: false."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def fit_on_training_rows(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    return fit(docs.where(~held_out()))

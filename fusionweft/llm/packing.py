"""Best-fit packing of tokenised documents into sequences of a fixed capacity.

Method: exact-complement hashing. Only the histogram of piece lengths (at most `capacity` numbers) reaches the driver.
There a plan is made on counts: the longest length left opens a sequence, and the gap it leaves is looked up in an index
of single lengths, of pair sums and of triple sums under the counts still available. A combination that fills the gap
exactly is consumed; where none exists, the best fitting (longest) length goes in and the lookup is repeated with the
smaller gap. Each pattern found is used as often as the counts allow, so a plan has some thousands of patterns whatever
the size of the corpus. Executors then turn the rank of a piece among those of its length into a place in the plan.

Cases: null text is an empty document (one end token); very long texts are cut into pieces of the capacity; repeated rows
are packed as often as they occur; an empty table gives an empty result; other columns are ignored; null doc_ids are
packed like any others. Equal pieces (of repeated rows) are told apart by `copy`, which counts them from 0.
"""

from __future__ import annotations

import os
import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import lean, ready, stored

CAPACITY = 4096
END_ID = 1
#: Cells per length in which pieces are ranked, so that a frequent length is not ranked in one task.
CELLS = 1024
#: Words that a Python worker keeps with their ids, in each of two generations; what is kept changes no result.
CACHE_WORDS = 150_000
#: Bytes of texts that are encoded together.
TOGETHER = 1 << 21


#: What plain prose does not hold: characters other than Latin-1 letters, digits, blanks, line ends, dots and commas; and a dot
#: or comma inside a word or next to another.
_NOT_PLAIN = r"[^A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{FF}0-9 \n.,]|[.,][^ \n]"


class WordEncoder:
    """Ids of whole texts, put together from the ids of their blank-separated words.

    The vocabulary's rules never merge across white space, so the ids of a text are those of its words in order. A word of
    printable Latin-1 characters is lowered, split by the vocabulary's own pattern and given to its model; any other word goes
    through the whole tokenizer. Words are encoded once and looked up afterwards.
    """

    def __init__(self, vocabulary: str, limit: int = CACHE_WORDS):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer, self.limit = Tokenizer.from_file(vocabulary), limit
        self.model = self.tokenizer.model
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.one = [k.to_bytes(4, "little") for k in range(self.tokenizer.get_vocab_size())]
        latin = [chr(c) for c in range(33, 256) if chr(c).isprintable()]
        letters, digits = ("".join(re.escape(c) for c in latin if unicodedata.category(c)[0] == kind) for kind in "LN")
        self.parts = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{digits}]|[^{letters}{digits}]+").findall
        self.bytes_of = {ord(c): self.tokenizer.pre_tokenizer.pre_tokenize_str(c)[0][0] for c in latin if ord(c) > 127}

    def _part(self, part: str) -> bytes:
        ids = self.young.get(part) or self.old.get(part)
        if ids is None:
            one = self.one
            ids = b"".join([one[t.id] for t in self.model.tokenize(part if part.isascii() else part.translate(self.bytes_of))])
        self.young[part] = ids
        return ids

    def learn(self, words: set[str]) -> None:
        """Sees to it that the words are in the young generation."""
        young, old, part, one, tokenize = self.young, self.old, self._part, self.one, self.model.tokenize
        for word in words:
            if (ids := old.get(word)) is not None:
                young[word] = ids
            elif word.isascii() and word.isalpha() and word.islower():
                young[word] = b"".join([one[t.id] for t in tokenize(word)])
            elif word.isprintable() and (word.isascii() or max(word) <= "\xff") and "<|" not in word:
                low = word.lower()
                if low.isalpha():
                    young[word] = part(low)
                elif (bare := low[:-1]).isalpha() and low[-1] in ".,":
                    young[word] = part(bare) + part(low[-1])
                else:
                    young[word] = b"".join(map(part, self.parts(low)))
            else:
                young[word] = np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()

    @staticmethod
    def _simpler(texts: pa.Array) -> pa.Array:
        """Texts with the same ids and fewer different words: plain prose is lowered, and its marks stand alone."""
        plain = pc.invert(pc.match_substring_regex(texts, _NOT_PLAIN))
        marks = pc.replace_substring(pc.replace_substring(texts, ".", " ."), ",", " ,")
        return pc.if_else(plain, pc.utf8_lower(marks), texts)

    def encode_all(self, texts: pa.Array) -> list[bytes]:
        """The ids of each text (a string array without nulls) as little-endian unsigned 32-bit numbers.

        Words are split and told apart by Arrow; Python sees each different word of these texts once.
        """
        if len(self.young) > self.limit:
            self.old, self.young = self.young, {}
        lists = pc.split_pattern(pc.replace_substring(self._simpler(texts), "\n", " "), " ")
        coded = lists.flatten().dictionary_encode()
        words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        ids = list(map(self.young.get, words))
        if None in ids:
            self.learn({w for w, found in zip(words, ids, strict=True) if found is None})
            ids = [self.young[w] if found is None else found for w, found in zip(words, ids, strict=True)]
        size = np.fromiter(map(len, ids), np.int64, len(ids)) >> 2
        pool, first = np.frombuffer(b"".join(ids), "<u4"), np.cumsum(size) - size
        index = coded.indices.to_numpy()
        each = size[index]
        ends = np.concatenate(([0], np.cumsum(each)))
        every = pool[np.repeat(first[index] - ends[:-1], each) + np.arange(ends[-1])]
        cuts = ends[lists.offsets.to_numpy() - lists.offsets[0].as_py()]
        return [every[a:b].tobytes() for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]

    def encode(self, text: str) -> bytes:
        return self.encode_all(pa.array([text], pa.string()))[0]


_encoders: dict[str, WordEncoder] = {}


def encoder(vocabulary: str) -> WordEncoder:
    if vocabulary not in _encoders:
        _encoders[vocabulary] = WordEncoder(vocabulary)
    return _encoders[vocabulary]


def pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = True) -> DataFrame:
    """Each document's pieces: doc_id, piece, start, length, ids_crc32, and where asked for the ids (little-endian unsigned 32-bit
    numbers in a binary, which costs neither the workers nor Spark an object for each token)."""

    kind = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = int(end_id).to_bytes(4, "little")
        types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()] + [pa.binary()] * with_ids
        names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
        for batch in batches:
            doc_ids, texts = batch.column(0).to_pylist(), pc.fill_null(batch.column(1).cast(pa.string()), "")
            sizes, at = pc.binary_length(texts).to_pylist(), 0
            while at < len(texts):
                to, size = at, 0
                while to < len(texts) and size < TOGETHER:
                    size += sizes[to]
                    to += 1
                rows = []
                for doc_id, ids in zip(doc_ids[at:to], encoder(vocabulary).encode_all(texts.slice(at, to - at)), strict=True):
                    ids += end
                    for k, first in enumerate(range(0, len(ids), 4 * capacity)):
                        part = ids[first : first + 4 * capacity]
                        row = (doc_id, k, first // 4, len(part) // 4, zlib.crc32(part))
                        rows.append((*row, part) if with_ids else row)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
                at = to

    return ready(docs).select(F.col("doc_id").cast("long"), "text").mapInArrow(lean(run), kind)


class Sums:
    """The index of exact complements: for each sum the pairs of lengths that make it, longer first lengths first.

    Lengths only become fewer while a plan is made, so a pair that has run out is passed over for good; each pair is passed
    once at most, however many gaps are looked up. A triple is a first length and a pair that makes the rest; all first
    lengths are tried.
    """

    def __init__(self, left: np.ndarray):
        self.left, capacity = left, len(left) - 1
        lengths = np.flatnonzero(left)
        low, high = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for at, a in enumerate(lengths.tolist()):
            more = lengths[at : np.searchsorted(lengths, capacity - a, side="right")]
            low.append(np.full(len(more), a))
            high.append(more)
        low, high = np.concatenate(low), np.concatenate(high)
        order = np.argsort(low + high, kind="stable")  # of one sum, the shortest low (longest high) comes first
        self.low, self.high = low[order], high[order]
        edges = np.searchsorted((low + high)[order], np.arange(capacity + 2))
        self.next, self.end = edges[:-1].copy(), edges[1:]

    def _there(self, k: int) -> bool:
        a, b = self.low[k], self.high[k]
        return self.left[a] > (1 if a == b else 0) and self.left[b] > 0

    def pair(self, total: int) -> tuple[int, int] | None:
        """Two available lengths that sum to total."""
        k, end = int(self.next[total]), int(self.end[total])
        while k < end and not self._there(k):
            k += 1
        self.next[total] = k
        return (int(self.high[k]), int(self.low[k])) if k < end else None

    def triple(self, total: int) -> tuple[int, int, int] | None:
        """Three available lengths that sum to total, the longest first length that there is."""
        firsts = np.flatnonzero(self.left[: total + 1])[::-1]
        for a in firsts[self.next[total - firsts] < self.end[total - firsts]].tolist():
            rest = total - a
            if self.pair(rest) is None:
                continue
            self.left[a] -= 1  # the first pair may need the one a that is there, so later ones are looked at as well
            k = next((k for k in range(int(self.next[rest]), int(self.end[rest])) if self._there(k)), None)
            self.left[a] += 1
            if k is not None:
                return a, int(self.high[k]), int(self.low[k])
        return None

    def exact(self, gap: int) -> tuple[int, ...] | None:
        """One, two or three available lengths that sum to gap."""
        return (gap,) if self.left[gap] > 0 else self.pair(gap) or self.triple(gap)


def plan(histogram: np.ndarray) -> list[tuple[dict[int, int], int]]:
    """Patterns (how often each length occurs in a sequence) and how many sequences follow each. histogram[n]: pieces of length n."""
    left, capacity, out = histogram.astype(np.int64).copy(), len(histogram) - 1, []
    left[0] = 0
    sums = Sums(left)
    while (lengths := np.flatnonzero(left)).size:
        longest = int(lengths[-1])
        used, gap = {longest: 1}, capacity - longest
        left[longest] -= 1
        while gap:
            if found := sums.exact(gap):
                new = found
            else:
                fits = np.flatnonzero(left[: gap + 1])
                if not fits.size:
                    break
                new = (int(fits[-1]),)
            for n in new:
                used[n] = used.get(n, 0) + 1
                left[n] -= 1
                gap -= n
        more = min(int(left[n]) // k for n, k in used.items())
        for n, k in used.items():
            left[n] -= more * k
        out.append((used, more + 1))
    return out


def places(patterns: list[tuple[dict[int, int], int]], capacity: int) -> dict[int, np.ndarray]:
    """For each length the runs of ranks: columns first rank, first sequence, pieces of it in a sequence, first offset."""
    runs: dict[int, list] = {}
    ranks, sequence = [0] * (capacity + 1), 0
    for used, times in patterns:
        offset = 0
        for n, k in used.items():
            runs.setdefault(n, []).append((ranks[n], sequence, k, offset))
            ranks[n] += k * times
            offset += n * k
        sequence += times
    return {n: np.array(r, np.int64) for n, r in runs.items()}


def pack(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = True) -> DataFrame:
    """pieces() with copy, sequence_id and offset: the place of each piece in as few sequences as the plan can make.

    vocabulary is the path of a `tokenizers` file that executors can open.
    """
    whole = stored(pieces(docs, vocabulary, capacity, end_id, with_ids).withColumn("_own", F.monotonically_increasing_id()), "pieces", "zstd")
    cut = whole.drop("ids")  # places are found without the ids, which join them at the end
    histogram = np.zeros(capacity + 1, np.int64)
    for row in cut.groupBy("length").count().collect():  # at most `capacity` rows
        histogram[row["length"]] = row["count"]
    runs = places(plan(histogram), capacity)

    cell = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(CELLS))
    celled = cut.withColumn("_cell", cell)
    before = Window.partitionBy("length").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    firsts = celled.groupBy("length", "_cell").agg(F.count(F.lit(1)).alias("_n")).select("length", "_cell", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("length", "_cell").orderBy("doc_id", "piece", "ids_crc32")
    alike = Window.partitionBy("length", "_cell", "doc_id", "piece", "ids_crc32").orderBy("_at")
    ranked = celled.withColumn("_at", F.row_number().over(inside) - 1).withColumn("copy", (F.row_number().over(alike) - 1).cast("int")).join(firsts, ["length", "_cell"])
    ranked = ranked.select(*cut.columns, "copy", (F.col("_before") + F.col("_at")).alias("_rank"))

    def put(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            length, rank = batch["length"].to_numpy(), batch.pop("_rank").to_numpy()
            sequence, offset = np.zeros(len(batch), np.int64), np.zeros(len(batch), np.int64)
            order = np.argsort(length, kind="stable")
            for group in np.split(order, np.flatnonzero(np.diff(length[order])) + 1) if len(order) else []:
                n = int(length[group[0]])
                run = runs[n][np.searchsorted(runs[n][:, 0], rank[group], side="right") - 1]
                nth = rank[group] - run[:, 0]
                sequence[group] = run[:, 1] + nth // run[:, 2]
                offset[group] = run[:, 3] + nth % run[:, 2] * n
            batch["doc_id"] = batch["doc_id"].astype("Int64")
            yield batch.assign(sequence_id=sequence, offset=offset)

    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cut.schema) + ", copy int, sequence_id long, offset long"
    placed = ranked.mapInPandas(put, kind)
    return (placed.join(whole.select("_own", "ids"), "_own") if with_ids else placed).drop("_own")

"""Line deduplication by winnowing over line hashes.

A document is its lines that are not blank, each trimmed and hashed. A window is the shortest run of lines from a line on that
reaches `MIN_WORDS` words. The line with the smallest hash in a window (the first of equals) is its fingerprint. Neighbouring
windows mostly choose the same line, so fingerprints are sparse; each is stored once, with the range of windows that chose it.
Any run of `MIN_WORDS` words or more that two places share begins with the same window at both, and so holds the same
fingerprint (winnowing's guarantee).

Positions are joined on the fingerprint; only those that another position shares go on. Each is extended both ways: to the
left up to every line at which a window that chose it begins, and from there to the right, line by line from the window's
end, until the next line's window takes over. These runs are matched by content with the first place of that content. Every
shared run of `MIN_WORDS` words or more is a union of such runs at both places, so every line of it is found against every
earlier place, which extending against one partner alone could not promise.

What is deleted: every line that lies in a run of consecutive lines of `MIN_WORDS` words or more which also begins at an
earlier place (a smaller doc_id, then a smaller line number). The first place always stays, so no text is lost.

Scale: texts are not shuffled before the end; fingerprints and the lines' hashes are. Only documents with a shared fingerprint
are extended. A common passage meets the first place of its content in a join with one row per content (never with itself),
which adaptive execution splits where a key is hot.

Cases: null texts stay null; blank lines inside a deleted run go with it; very long documents are handled line by line;
equal rows (same doc_id and text) count as one place and keep their lines alike; rows of one doc_id with different texts are
told apart by the text's hash; null doc_ids come first; an empty table gives an empty result; other columns pass through
untouched, whatever their names (internal ones begin with `__`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import drop, stored

MIN_WORDS = 50


def _lines(text: Column) -> Column:
    """The lines that are not blank: hash, number of words, number of the line (from 0)."""
    every = F.transform(F.split(text, "\n", -1), lambda x, i: F.struct(F.trim(F.translate(x, "\t\x0b\x0c\r", "    ")).alias("t"), i.alias("i")))
    full = F.filter(every, lambda x: x["t"] != "")
    return F.transform(full, lambda x: F.struct(F.xxhash64(x["t"]).alias("h"), F.size(F.array_remove(F.split(x["t"], " "), "")).alias("n"), x["i"].alias("i")))


def _let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _window(lines: Column, at: Column, min_words: int) -> Column:
    """The shortest run of lines from `at` on that reaches min_words: to (the line after its last) and print (the line with the
    smallest hash, the first of equals); null where the document ends before."""

    def grow(near: Column) -> Column:
        start = F.struct(F.lit(0).alias("w"), F.lit(0).alias("c"))
        return F.aggregate(near, start, lambda a, x: F.when(a["w"] < min_words, F.struct((a["w"] + x["n"]).alias("w"), (a["c"] + 1).alias("c"))).otherwise(a))

    def told(near: Column, size: Column) -> Column:
        chosen = lambda h: at + F.array_position(h, F.array_min(h)).cast("int") - 1
        found = F.struct((at + size["c"]).alias("to"), _let(F.transform(F.slice(near, F.lit(1), size["c"]), lambda x: x["h"]), chosen).alias("print"))
        return F.when(size["w"] >= min_words, found)

    few = F.slice(lines, at + 1, 4)  # most windows end within a few lines; each line has a word, so min_words lines always do
    enough = F.aggregate(few, F.lit(0), lambda s, x: s + x["n"]) >= min_words
    near = F.when(enough, few).otherwise(F.slice(lines, at + 1, min_words))
    return _let(near, lambda n: _let(grow(n), lambda g: told(n, g)))


def profiles(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """__doc, __text (the text's hash), and by line that is not blank its hash h and number i; by window its end `to` and its fingerprint's line `at`."""
    part = lambda c, f: F.transform(c, lambda x: x[f])

    def told(lines: Column) -> Column:
        windows = F.filter(F.transform(lines, lambda x, at: _window(lines, at, min_words)), lambda w: w.isNotNull())  # the lines that have none are the last ones
        return _let(windows, lambda w: F.struct(part(lines, "h").alias("h"), part(lines, "i").alias("i"), part(w, "to").alias("to"), part(w, "print").alias("at")))

    base = docs.where(F.col("text").isNotNull()).select(F.col("doc_id").alias("__doc"), F.xxhash64("text").alias("__text"), _let(_lines(F.col("text")), told).alias("l"))
    return stored(base, "lines").select("__doc", "__text", "l.*")  # split after it is written, or each part would be computed apart


def fingerprints(lines: DataFrame) -> DataFrame:
    """__doc, __text, print (the hash), place (its line), and the first and last window that chose it. lines: profiles()."""
    begins = F.filter(F.transform("at", lambda p, w: F.when((w == 0) | (F.get("at", w - 1) != p), w)), lambda w: w.isNotNull())
    each = lines.select("__doc", "__text", "h", "at", begins.alias("b")).select("__doc", "__text", "h", "at", "b", F.posexplode("b").alias("k", "left"))
    place, last = F.get("at", F.col("left")), F.coalesce(F.get("b", F.col("k") + 1), F.size("at")) - 1
    return each.select("__doc", "__text", F.get("h", place).alias("print"), place.alias("place"), "left", last.alias("right"))


def extended(lines: DataFrame, shared: DataFrame) -> DataFrame:
    """The runs around shared fingerprints: __doc, __text, first, last (lines of the document), content. shared: rows of fingerprints()."""
    ranges = shared.groupBy("__doc", "__text").agg(F.collect_set(F.struct("left", "right")).alias("r"))  # of one document
    named = ranges.select(F.col("__doc").alias("__d"), F.col("__text").alias("__t"), "r")
    mine = lines.join(named, lines["__doc"].eqNullSafe(named["__d"]) & (lines["__text"] == named["__t"])).drop("__d", "__t")
    last = lambda w: F.greatest(F.get("to", w), F.coalesce(F.get("to", w + 1) - 1, F.size("h")))
    run = lambda w, to: F.struct(F.get("i", w).alias("first"), F.get("i", to - 1).alias("last"), F.xxhash64(F.slice("h", w + 1, to - w)).alias("content"))
    of_window = lambda w: F.transform(F.sequence(F.get("to", w), last(w)), lambda to: run(w, to))
    runs = F.flatten(F.flatten(F.transform("r", lambda r: F.transform(F.sequence(r["left"], r["right"]), of_window))))
    return mine.select("__doc", "__text", F.explode(runs).alias("x")).select("__doc", "__text", "x.first", "x.last", "x.content")


def repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Later repeated runs: __doc, __text, first, last (lines), and the place that they repeat: from_doc, from_line."""
    lines = profiles(docs, min_words)
    prints = stored(fingerprints(lines), "prints")
    ends = lambda place: [F.min(place).alias("a"), F.max(place).alias("b")]
    common = prints.groupBy("print").agg(*ends(F.struct("__doc", "__text", "place"))).where("not (a <=> b)").select("print")
    runs = stored(extended(lines, prints.join(common, "print", "left_semi")), "runs")
    place = F.struct("__doc", "__text", "first")
    begins = runs.groupBy("content").agg(*ends(place)).where("not (a <=> b)").select("content", "a")
    later = runs.join(begins, "content").where(place > F.col("a"))
    out = stored(later.select("__doc", "__text", "first", "last", F.col("a.__doc").alias("from_doc"), F.col("a.first").alias("from_line")), "later")
    drop(prints, runs)
    return out


def spans(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Disjoint spans of lines to delete: __doc, __text, first, last, from_doc, from_line (where the span's start stands earlier)."""
    in_doc = Window.partitionBy("__doc", "__text").orderBy("first", "last")
    runs = repeated_runs(docs, min_words)
    reach = F.max("last").over(in_doc.rowsBetween(Window.unboundedPreceding, -1))
    marked = runs.withColumn("new", F.coalesce(F.col("first") > reach + 1, F.lit(True)).cast("int"))
    numbered = marked.withColumn("span", F.sum("new").over(in_doc.rowsBetween(Window.unboundedPreceding, 0)))
    grouped = numbered.groupBy("__doc", "__text", "span").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.min_by(F.struct("from_doc", "from_line"), F.struct("first", "last", "from_doc", "from_line")).alias("f"))
    return grouped.select("__doc", "__text", "first", "last", "f.from_doc", "f.from_line")


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """docs with text without its later repeated runs, and __lines and __removed (how many lines there were and went)."""
    cuts = spans(docs, min_words).groupBy("__doc", "__text").agg(F.sort_array(F.collect_list(F.struct("first", "last"))).alias("__cuts"))  # a document's own spans
    docs = docs.withColumn("__hash", F.xxhash64("text"))
    joined = docs.join(cuts, docs["doc_id"].eqNullSafe(cuts["__doc"]) & (docs["__hash"] == cuts["__text"]), "left")
    lines = F.split("text", "\n", -1)
    kept = F.filter(lines, lambda x, i: ~F.exists("__cuts", lambda s: (s["first"] <= i) & (i <= s["last"])))
    gone = F.aggregate("__cuts", F.lit(0), lambda n, s: n + s["last"] - s["first"] + 1)
    text = F.when(F.col("__cuts").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    extra = {"text": text, "__lines": F.when(F.col("text").isNotNull(), F.size(lines)).otherwise(0), "__removed": F.coalesce(gone, F.lit(0))}
    return joined.withColumns(extra).drop("__hash", "__doc", "__text", "__cuts")

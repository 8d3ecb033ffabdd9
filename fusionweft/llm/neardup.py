"""Near-duplicate documents: a chosen-path set similarity join on word shingles.

A document is the set of hashes of its five-word shingles. Equal sets are one class from the start. Each class carries
`POSITIONS` minwise tokens (for each of as many random orders of all shingles, the set's first one).

The join branches classes in `TREES` independent trees. A node of a tree holds the classes that agree on the tokens chosen
along its path. A node of at most `SMALL` classes is compared exhaustively. A larger one is compared with one of its members,
its pivot, and branches again by one or (a third of the nodes) two minwise tokens that the node chooses among those not yet
used on its path. So two sets of similarity 0.75 have one common child on average: what they lose by tokens they do not share
is made up by further branches, and they are not lost with depth.

After each level the pairs found are confirmed and connected. What is asked for are components, so nodes whose members are all
connected already are done, and so are pairs of connected members. A node in which all but `OUTSIDE` members are one component is
a crowd of copies: the few outside are compared with all members, in cells of bounded size (`rest`), and the node is done too.
So a crowd of copies ends after its first node, however large it is. Only nodes of many different texts, such as those that share a passage, branch, and these part with each
level. What is left of them after `DEPTH` levels is compared in the same cells.

Pairs are first screened by their sizes (exactly) and by the share of minwise tokens they agree on, less five standard
deviations. Those that remain are confirmed on the full sets, which are computed again from the texts of the documents concerned
alone. Confirming the first level's pairs, which are most of all, goes in two rounds: first each set with the one that it agrees
with most, then only pairs that this left unconnected. So a set travels about twice, not once for each pair that it is in. The
sets are a table in buckets, which no later join shuffles.

Recall: of a pair at the threshold, let f be the share of tokens that many other texts have as well. Its first nodes are small with
probability 0.75 - f, so `TREES` = 20 trees miss it there with probability (0.25 + f) ** 20: never in ordinary text, in 1 case of
300 where half of the tokens are common. Those meet in larger nodes too; `DEEP_TREES` = 8 trees go on with them, and a tree keeps a
pair with a probability of 0.75 in a crowd and of a third after ten levels. README has measured figures.

Cases: null text, or text without words, has no shingle and is linked with nothing; fewer than five words: the whole
sequence is the one shingle; very long texts are read whole; repeated rows and equal texts share a class; rows without
doc_id get no component and are kept, as nothing can name them; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh3_64_digest

from .common import bucketed, buckets, drop, lean, ready, stored
from .components import components

WORDS, PERCENT = 5, 75
TREES, DEPTH, POSITIONS = 20, 10, 64
SMALL = 12
#: Members outside a node's largest component that are compared with all others in place of branching, and how many trees go on
#: beyond their first nodes.
OUTSIDE, DEEP_TREES = 1024, 8
#: Members of a node, and shingles of them all, that a cell of `rest` holds of each side.
BLOCK, BLOCK_SHINGLES = 1024, 1 << 20
#: Bits of the bitmaps of documents whose sets are asked for: 16 MB.
MOST_BITS = 1 << 27
_ODD = (np.random.default_rng(20240229).integers(0, 1 << 63, POSITIONS, np.uint64) << np.uint64(1)) | np.uint64(1)


def screen(percent: int) -> float:
    """Least share of agreeing minwise tokens: the threshold less five standard deviations at `POSITIONS` tokens."""
    share = percent / 100
    return share - 5 * (share * (1 - share) / POSITIONS) ** 0.5


def _mixed(x: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64-bit numbers that spreads their bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """The sorted distinct 64-bit hashes of the text's shingles."""
    # bytes.lower() lowers A-Z alone, and bytes.split() separates at 0x20 and 0x09 to 0x0D alone
    found = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not found:
        return np.zeros(0, np.uint64)
    one = np.frombuffer(b"".join(map(xxh3_64_digest, found)), "<u8")
    width = min(words, len(one))
    total = np.full(len(one) - width + 1, np.uint64(width))
    for k in range(width):
        total = _mixed(total + one[k : len(one) - width + 1 + k])
    return np.unique(total)


def minwise(grams: np.ndarray) -> np.ndarray:
    """For each random order the first shingle's number, shortened to 32 bits."""
    least = np.full(POSITIONS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(grams), 4096):
        least = np.minimum(least, (grams[at : at + 4096] * _ODD[:, None]).min(axis=1))
    return (_mixed(least) >> np.uint64(32)).astype(np.uint32)


def signatures(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, text_hash, n_shingles, set (a 128-bit hash of the shingle set; null for the empty set), sig (POSITIONS 32-bit numbers)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sizes, sets, sigs = [], [], []
            for text in batch["text"].tolist():
                grams = shingles(text, words)
                sizes.append(len(grams))
                sets.append(hashlib.blake2b(grams.tobytes(), digest_size=16).digest() if len(grams) else None)
                sigs.append(minwise(grams).tobytes() if len(grams) else None)
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "text_hash": batch["text_hash"], "n_shingles": sizes, "set": sets, "sig": sigs})

    texts = ready(docs).select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), "text")
    return texts.mapInPandas(lean(run), "doc_id long, text_hash long, n_shingles long, set binary, sig binary")


def _token(position: Column) -> Column:
    return F.substring("sig", position * 4 + 1, F.lit(4))


def _roots(classes: DataFrame) -> DataFrame:
    """The first nodes of all trees: rows of tree, node, set."""
    tree = F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree")
    return classes.select("set", "sig", tree).select("tree", F.xxhash64("tree", _token(F.col("tree"))).alias("node"), "set")


def _children(rows: DataFrame) -> DataFrame:
    """rows under the nodes that follow theirs. used: the positions whose tokens the path has been branched by."""
    drawn = F.xxhash64("node", F.lit(1))
    free = F.array_except(F.sequence(F.lit(TREES), F.lit(POSITIONS - 1)), F.col("used"))
    at = F.pmod(drawn, F.size(free)).cast("int")
    after = F.pmod(at + 1 + F.pmod(F.xxhash64("node", F.lit(2)), F.size(free) - 1), F.size(free)).cast("int")
    chosen = F.when(F.pmod(F.xxhash64("node", F.lit(3)), F.lit(3)) == 0, F.array(F.get(free, at), F.get(free, after))).otherwise(F.array(F.get(free, at)))
    each = rows.withColumn("position", F.explode(chosen))
    each = each.withColumns({"node": F.xxhash64("node", "position", _token(F.col("position"))), "used": F.array_append("used", F.col("position"))})
    return each.drop("position", "size")


def _nodes(rows: DataFrame) -> DataFrame:
    """rows with the size of their node; rows alone in their node go."""
    sizes = stored(rows.groupBy("node").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "nodes")
    return rows.join(sizes, "node")


def _screened(pairs: DataFrame, percent: int) -> DataFrame:
    """Pairs (structs a and b of set, n, sig, root) that sizes and minwise tokens do not rule out: a, b (the sets), like (the share of tokens)."""
    least = screen(percent)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            left, right = (np.frombuffer(b"".join(batch[c].tolist()), "<u4").reshape(-1, POSITIONS) for c in ("sa", "sb"))
            batch["like"] = (left == right).mean(axis=1)
            yield batch.loc[batch["like"] >= least, ["a", "b", "like"]]

    fits = pairs.where(f"100 * least(a.n, b.n) >= {percent} * greatest(a.n, b.n) and a.root != b.root")
    flat = fits.select(F.col("a.set").alias("a"), F.col("b.set").alias("b"), F.col("a.sig").alias("sa"), F.col("b.sig").alias("sb"))
    screened = flat.mapInPandas(lean(run), "a binary, b binary, like double")
    return screened.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "like").distinct()


def _met(rows: DataFrame) -> DataFrame:
    """The pairs (a, b) that a level compares: all of small nodes, and of larger ones the pivot with each member."""
    item = F.struct("set", "n", "sig", "root")
    small = rows.where(f"size <= {SMALL}").groupBy("node").agg(F.sort_array(F.collect_list(item)).alias("m"))  # at most SMALL each
    found = small.select(F.posexplode("m").alias("i", "a"), "m").select("a", F.explode(F.slice("m", F.col("i") + 2, F.lit(SMALL))).alias("b"))
    large = rows.where(f"size > {SMALL}")
    pivots = large.groupBy("node").agg(F.min_by(item, F.xxhash64("node", "set")).alias("a"))
    return found.union(large.join(pivots, "node").select("a", item.alias("b")))


def first_level(classes: DataFrame) -> DataFrame:
    """tree, node, set, n, sig, root, used, size: the classes that are not alone in a first node. classes: set, n, sig; a row for each set."""
    met = stored(_nodes(_roots(classes)), "together").join(classes, "set")  # few are left, so few signatures travel
    return met.withColumns({"root": F.col("set"), "used": F.array().cast("array<int>")})


def crowds_and_children(rows: DataFrame, roots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What is left of a level once roots are known, of its larger nodes: the members of crowds, and all others under their children.
    Nodes whose members are all connected are left out of both."""
    named = roots.select(F.col("node").alias("set"), F.col("root").alias("new"))
    large = stored(rows.where(f"size > {SMALL} and tree < {DEEP_TREES}").join(named, "set", "left").withColumn("root", F.coalesce("new", "set")).drop("new"), "large")
    parts = large.groupBy("node", "root").agg(F.count(F.lit(1)).alias("c"))
    told = parts.groupBy("node").agg((F.sum("c") - F.max("c")).alias("outside")).where("outside > 0")
    left = large.join(stored(told, "told"), "node")
    crowds = left.where(f"outside <= {OUTSIDE}").select("node", "set", "n", "sig")
    children = _children(left.where(f"outside > {OUTSIDE}").drop("outside"))
    again = children.groupBy("node").agg(F.count(F.lit(1)).alias("size"), F.min("root").alias("x"), F.max("root").alias("y")).where("x != y").select("node", "size")
    out = stored(crowds, "crowds"), stored(children.join(again, "node"), "level")
    drop(large)
    return out


def possible(docs: DataFrame, ids: DataFrame, count: int) -> DataFrame:
    """doc_id, text of the rows of docs whose doc_id may be among ids (count rows of doc_id): all that are, and few others, so few
    texts are shuffled by the exact join that follows. The bitmaps, of 4 kB each, take `MOST_BITS` bits at most, whatever the input;
    from an eighth of that in ids on they let more rows through, never fewer than asked for."""
    bits = 1 << max(15, min(MOST_BITS.bit_length() - 1, (16 * count).bit_length()))
    hashed = F.pmod(F.xxhash64("doc_id"), F.lit(bits))
    maps = ids.select(hashed.alias("h")).groupBy(F.expr("h div 32768").alias("part")).agg(F.bitmap_construct_agg(F.col("h") % 32768).alias("map"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("h", hashed)
    byte = F.conv(F.hex(F.substring("map", F.expr("cast(h % 32768 div 8 + 1 as int)"), F.lit(1))), 16, 10).cast("int")
    there = F.getbit(byte, (F.col("h") % 8).cast("int")) == 1
    return rows.join(F.broadcast(maps), F.expr("h div 32768 = part") & there, "left_semi").drop("h")


def shingle_sets(docs: DataFrame, ids: DataFrame, words: int = WORDS, parts: int = 1) -> DataFrame:
    """set and grams (the shingles' hashes) of the documents named in ids (doc_id, distinct); a row for each set, in parts by set."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            grams = [shingles(text, words) for text in batch["text"].tolist()]
            yield pd.DataFrame({"set": [hashlib.blake2b(g.tobytes(), digest_size=16).digest() for g in grams], "grams": [g.tobytes() for g in grams]})

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(ids, "doc_id", "left_semi").select("text")
    return ready(texts).mapInPandas(lean(run), "set binary, grams binary").repartition(parts, "set").dropDuplicates(["set"])


def _alike(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def confirmed(pairs: DataFrame, grams: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs whose full sets are similar enough."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            good = [_alike(np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8"), percent) for x, y in zip(batch["ga"], batch["gb"], strict=True)]
            yield batch.loc[np.array(good, bool), ["a", "b"]]

    left = grams.select(F.col("set").alias("a"), F.col("grams").alias("ga"))
    right = grams.select(F.col("set").alias("b"), F.col("grams").alias("gb"))
    return pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "ga", "gb").mapInPandas(lean(run), "a binary, b binary")


def linked(pairs: DataFrame, grams: DataFrame, percent: int) -> DataFrame:
    """roots (node, root) of all that pairs (a, b, like) connect once they are confirmed."""
    best = pairs.select(F.explode(F.array("a", "b")).alias("x"), F.struct("like", "a", "b").alias("p")).groupBy("x").agg(F.max("p").alias("p"))
    first = stored(best.select("p.a", "p.b").distinct(), "forest")
    roots = stored(components(confirmed(first, grams, percent)), "roots")
    one, two = roots.toDF("a", "ra"), roots.toDF("b", "rb")
    others = pairs.select("a", "b").join(first, ["a", "b"], "left_anti").join(one, "a", "left").join(two, "b", "left")
    others = others.where(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select("a", "b")
    return _joined(roots, stored(confirmed(others, grams, percent), "confirmed"))


def _joined(roots: DataFrame, links: DataFrame) -> DataFrame:
    """roots of what links (a table) connect beside."""
    return stored(components(roots.toDF("a", "b").union(links)), "roots") if links.limit(1).count() else roots


def rest(crowds: DataFrame, roots: DataFrame, grams: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Links between members of one node that are not connected yet: at least one for each pair of components that has any.

    crowds: node, set, n, sig. roots: node, root as of components()."""
    named = roots.select(F.col("node").alias("set"), "root")
    rows = crowds.select("node", "set", "n", "sig").join(named, "set", "left").withColumn("root", F.coalesce("root", "set"))
    parts = rows.groupBy("node", "root").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("s"))
    top = F.max_by(F.struct("root", "c", "s"), F.struct("c", "root")).alias("m")
    mixed = parts.groupBy("node").agg(top, F.sum("c").alias("c"), F.sum("s").alias("s"), F.count(F.lit(1)).alias("roots")).where("roots > 1")
    blocks = lambda c, s: F.greatest(F.ceil(c / BLOCK), F.ceil(s / BLOCK_SHINGLES)).cast("int")
    mixed = mixed.select("node", F.col("m.root").alias("main"), blocks(F.col("c"), F.col("s")).alias("wide"), blocks(F.col("c") - F.col("m.c"), F.col("s") - F.col("m.s")).alias("high"))
    there = stored(rows.join(mixed, "node").withColumn("out", F.col("root") != F.col("main")), "mixedrows")
    own = lambda n: F.pmod(F.xxhash64("set"), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    members = there.join(grams, "set").select("node", own(F.col("wide")).alias("x"), every(F.col("high")).alias("y"), "set", "n", "sig", "root", "grams", "out")
    outside = there.where("out").select("node", every(F.col("wide")).alias("x"), own(F.col("high")).alias("y"), "set", "n", "sig", "root", own(F.col("wide")).alias("home"))
    # those that are among the members of their cell travel with these alone
    near = outside.where("x = home").withColumns({"sig": F.lit(None).cast("binary"), "grams": F.lit(None).cast("binary")}).drop("home")
    far = outside.where("x != home").drop("home").join(grams, "set").select(*near.columns)
    outside = near.union(far).toDF(*near.columns)
    least = screen(percent)

    def compare(out: pd.DataFrame, have: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(out) and len(have):
            sets, roots, n = have["set"].tolist(), have["root"].tolist(), have["n"].to_numpy()
            twice = have["out"].to_numpy()
            sigs = np.frombuffer(b"".join(have["sig"].tolist()), "<u4").reshape(-1, POSITIONS)
            grams = [np.frombuffer(g, "<u8") for g in have["grams"].tolist()]
            place = {own: k for k, own in enumerate(sets)}
            for own, size, sig, root, full in zip(out["set"], out["n"], out["sig"], out["root"], out["grams"], strict=True):
                sig, whole = (sigs[place[own]], grams[place[own]]) if full is None else (np.frombuffer(sig, "<u4"), np.frombuffer(full, "<u8"))
                fits = (100 * np.minimum(n, size) >= percent * np.maximum(n, size)) & ((sigs == sig).mean(axis=1) >= least)
                met = {root}
                for k in np.flatnonzero(fits):
                    # two members outside meet in two cells or both ways in one; the one way is enough
                    if roots[k] not in met and not (twice[k] and sets[k] < own) and _alike(whole, grams[k], percent):
                        met.add(roots[k])
                        found.append((min(own, sets[k]), max(own, sets[k])))
        return pd.DataFrame(found, columns=["a", "b"])

    found = stored(outside.groupBy("node", "x", "y").cogroup(members.groupBy("node", "x", "y")).applyInPandas(compare, "a binary, b binary").distinct(), "more")
    drop(there)
    return found


def near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, text_hash (Spark's xxhash64), n_shingles, component_id, kept for every row of docs."""
    signed = stored(signatures(docs, words), "signed")
    named = signed.where("set is not null and doc_id is not null")
    classes = stored(named.groupBy("set").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("sig").alias("sig")), "classes")
    rows = stored(first_level(classes.select("set", "n", "sig")), "level")
    pairs = tested = stored(_screened(_met(rows), percent), "pairs")
    # the sets of all that deeper levels and `rest` can ask for
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("set")).union(rows.where(f"size > {SMALL} and tree < {DEEP_TREES}").select("set")).distinct()
    asked = stored(classes.join(wanted, "set", "left_semi").select(F.col("rep").alias("doc_id"), "n"), "asked")
    count, shingled = asked.agg(F.count(F.lit(1)), F.sum("n")).head()
    parts = buckets(docs.sparkSession, 8 * (shingled or 0))
    ids = asked.select("doc_id")
    grams = bucketed(shingle_sets(possible(docs, ids, count), ids, words, parts), "set", parts, "grams")
    drop(asked)
    roots = linked(pairs, grams, percent)
    for depth in range(DEPTH):
        crowds, after = crowds_and_children(rows, roots)
        drop(rows)
        rows = after
        if crowds.limit(1).count():
            roots = _joined(roots, rest(crowds, roots, grams, percent))
        drop(crowds)
        if not rows.limit(1).count():
            break
        if depth + 1 == DEPTH:
            roots = _joined(roots, rest(rows, roots, grams, percent))
            break
        pairs = stored(_screened(_met(rows), percent).join(tested, ["a", "b"], "left_anti"), "pairs")
        roots = _joined(roots, stored(confirmed(pairs, grams, percent), "confirmed"))
        tested = tested.union(pairs)
    reps = classes.select(F.col("set").alias("node"), "rep")
    smallest = stored(roots.join(reps, "node").groupBy("root").agg(F.min("rep").alias("component_id")), "smallest")
    of_set = roots.join(smallest, "root").select(F.col("node").alias("set"), "component_id")
    of_class = stored(classes.select("set", "rep").join(of_set, "set", "left").select("set", F.coalesce("component_id", "rep").alias("component_id")), "ofclass")
    shown = named.join(of_class, "set").select("doc_id", "text_hash", "n_shingles", "component_id")
    alone = signed.where("set is null or doc_id is null").select("doc_id", "text_hash", "n_shingles", F.col("doc_id").alias("component_id"))
    return shown.union(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def one_of_each(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row of each group of near duplicates, with all its columns: that of the smallest doc_id, and of rows that share it the one
    with the smallest text hash. Rows that repeat a doc_id and its text are one document, of which one row stays. Rows without doc_id
    are nobody's near duplicates, but of those that repeat a text one stays as well."""
    near = near_duplicates(docs, words, percent).where("doc_id is not null").select("doc_id", "text_hash", "component_id")
    several = near.groupBy("component_id").agg(F.min(F.struct("doc_id", "text_hash")).alias("x"), F.max(F.struct("doc_id", "text_hash")).alias("y")).where("x != y")
    gone = near.join(several.select("component_id", "x"), "component_id").where(F.struct("doc_id", "text_hash") != F.col("x")).select(F.col("doc_id").alias("__doc"), F.col("text_hash").alias("__text")).distinct()
    rows = docs.withColumns({"__id": F.col("doc_id").cast("long"), "__hash": F.xxhash64("text")})
    left = rows.join(stored(gone, "gone"), (F.col("__id") == F.col("__doc")) & (F.col("__hash") == F.col("__text")), "left_anti")
    same = Window.partitionBy("__id", "__hash").orderBy(F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]))
    return left.withColumn("__copy", F.row_number().over(same)).where("__copy = 1").drop("__id", "__hash", "__copy")

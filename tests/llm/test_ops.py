import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from fusionweft.llm import common, langid, linededup, media, mixing, neardup, packing, queries, sharding, topk, urlfilter, warc

from . import brute


def texts(seed=1, count=60):
    """Invented documents with copies, near copies, shared passages, nulls, empty and odd texts."""
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdefgh") for _ in range(r.randint(1, 6))) for _ in range(300)]
    say = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    passage, out = [say(30), say(25), say(20)], []
    for k in range(count):
        lines = [say(r.randint(1, 30)) for _ in range(r.randint(1, 8))]
        if k % 5 == 0:
            at = r.randint(0, len(lines))
            lines[at:at] = passage
        if k % 7 == 3 and out:
            lines = out[-1].split("\n")
        if k % 11 == 4 and out:
            lines = [w if r.random() > 0.02 else "changed" for w in out[-2].split(" ")]
            lines = " ".join(lines).split("\n")
        out.append("\n".join(lines))
    return out + [None, "", " \t\n ", "one", "one two", "ONE TWO", passage[0] + "\n" + passage[0], "\r\n".join(passage), "x " * 3000]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", f"s{i % 3}", len(t or ""), "own") for i, t in enumerate(texts())]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, shard string").repartition(3)


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.orderBy("doc_id").collect()]


def test_near_duplicates_equal_brute_force(docs, none):
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(docs).collect()}
    want = brute.near(pairs(docs))
    assert found == {i: (n, c, i == c) for i, (n, c) in want.items()}
    assert neardup.near_duplicates(none).count() == 0


def test_near_duplicates_of_a_large_crowd(spark, monkeypatch):
    """A crowd of near copies, more than a node holds, with members that only some of the others are similar to."""
    r = random.Random(5)
    base = [f"w{i}" for i in range(160)]
    rows = []
    for i in range(150):
        words = list(base)
        for _ in range(r.randint(0, 5)):
            words[r.randrange(160)] = f"x{r.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in neardup.near_duplicates(df).collect()}
    assert found == brute.near(rows)


@pytest.mark.parametrize("most", [neardup.MOST_BITS, 1 << 15])
def test_bitmaps_let_all_asked_for_through(spark, monkeypatch, most):
    monkeypatch.setattr(neardup, "MOST_BITS", most)
    docs = spark.range(60000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.lit(1).alias("map"))
    docs = docs.union(spark.createDataFrame([(None, "t", 1), (7, None, 1)], "doc_id long, text string, map int"))
    ids = spark.range(0, 60000, 7).select(F.col("id").alias("doc_id"))
    got = [r["doc_id"] for r in neardup.possible(docs, ids, ids.count()).select("doc_id").collect()]
    assert {i for i in got if i is not None} >= set(range(0, 60000, 7)) and got.count(7) == 2
    assert len(got) < (12000 if most > 1 << 15 else 24000)
    assert neardup.possible(docs, ids.limit(0), 0).count() == 0


@pytest.mark.parametrize("block", [neardup.BLOCK, 7])
def test_rest_links_what_stars_missed(spark, monkeypatch, block):
    monkeypatch.setattr(neardup, "BLOCK", block)
    rows = [(i, " ".join(f"w{j}" if j != i else "odd" for j in range(100))) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    signed = neardup.signatures(df).cache()
    crowds = signed.select(F.lit(1).cast("long").alias("node"), F.lit(40).cast("long").alias("size"), "set", F.col("n_shingles").alias("n"), "sig")
    grams = neardup.shingle_sets(df, df.select("doc_id"))
    nothing = spark.createDataFrame([], "node binary, root binary")
    links = neardup.rest(crowds, nothing, grams).collect()
    touched = {x for row in links for x in (bytes(row["a"]), bytes(row["b"]))}
    assert len(touched) == 40


def test_nulls_and_repeated_rows(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (2, None)], "doc_id long, text string")
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["component_id"], r["kept"]) for r in neardup.near_duplicates(df).collect())
    assert got == [(False, 1, 1, True), (False, 1, 1, True), (False, 2, 2, True), (True, 0, None, True)]
    cut = linededup.dedup_lines(df).collect()
    assert len(cut) == 4 and all(r["__removed"] == 0 for r in cut)
    assert packing.pack(df, queries.vocabulary()).count() == 4
    assert sharding.shard(df, 3).count() == 4
    assert langid.predict(df, langid.fit(df.withColumn("lang", F.lit("en")))).count() == 4
    assert media.store_payloads(df, "doc_id", "text")[1].count() == 4
    assert mixing.mix(df.withColumn("source", F.lit(None).cast("string"))).count() == 4


def test_line_dedup_equals_brute_force(docs, none):
    rows = pairs(docs)
    gone = brute.repeated_lines(rows)
    assert len(gone) > 20
    found = {r["doc_id"]: r for r in linededup.dedup_lines(docs).collect()}
    for i, text in rows:
        want = None if text is None else "\n".join(x for k, x in enumerate(text.split("\n")) if (i, k) not in gone)
        assert found[i]["text"] == want, i
        assert found[i]["shard"] == "own"
    assert linededup.dedup_lines(none).count() == 0


def test_spans_name_the_earlier_place(docs):
    lines = {i: (t or "").split("\n") for i, t in pairs(docs)}
    for r in linededup.spans(docs).collect():
        first = lines[r["__doc"]][r["first"]].strip()
        assert lines[r["from_doc"]][r["from_line"]].strip() == first
        assert (r["from_doc"], r["from_line"]) < (r["__doc"], r["first"])


def test_topk_equals_brute_force(spark):
    r = random.Random(3)
    rows = [(i, [r.choice([0.0, r.uniform(-1, 1)]) for _ in range(8)]) for i in range(220)]
    rows += [(300, None), (350, [0.5, None]), (400, [float("nan")] * 8), (450, [float("inf")] * 8), (500, [0.25]), (501, rows[7][1]), (502, rows[7][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    rows = [(x["vec_id"], x["embedding"]) for x in df.collect()]
    got = topk.search(df, df.where("vec_id % 50 = 0"), "vec_id", "embedding")
    assert sorted(tuple(x) for x in got.select("query_id", "rank", "vec_id", "score").collect()) == brute.top(rows)
    assert topk.search(df.limit(0), df.limit(0), "vec_id", "embedding").count() == 0


def test_packing_is_whole_and_tight(docs, none):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(queries.vocabulary())
    got = packing.pack(docs, queries.vocabulary(), capacity=128).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    for i, text in pairs(docs):
        ids = (plain.encode(text, add_special_tokens=False).ids if text else []) + [1]
        parts = sorted(by_doc[i], key=lambda r: r["piece"])
        assert np.frombuffer(b"".join(bytes(r["ids"]) for r in parts), "<u4").tolist() == ids
        assert [r["start"] for r in parts] == list(range(0, len(ids), 128))
        assert all(r["ids_crc32"] == zlib.crc32(r["ids"]) and len(r["ids"]) == 4 * r["length"] for r in parts)
    total = 0
    for rows in by_sequence.values():
        at = 0
        for r in sorted(rows, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 128
        total += at
    assert len(by_sequence) <= -(-total // 128) + 1
    assert packing.pack(none, queries.vocabulary()).count() == 0


def test_special_strings_and_odd_spaces_are_encoded_as_the_library_does():
    from tokenizers import Tokenizer

    plain, own = Tokenizer.from_file(queries.vocabulary()), packing.WordEncoder(queries.vocabulary(), limit=4)
    r = random.Random(8)
    latin = "".join(map(chr, range(1, 256)))
    odd = ["".join(r.choice(latin + "'sdrelvmt  aeiou" * 9) for _ in range(r.randint(1, 60))) for _ in range(800)]
    odd += ["".join(r.choice("aB'é\u0301\u030cJΣ <|endoftext|>²1٣ß中\u2028") for _ in range(30)) for _ in range(400)]
    for text in [*odd, "a<|ENDOFTEXT|>b<|startoftext|>", "a<|endoftext|>b  c", "x\x1cy\u00a0z\u2003w", "It's   O\u0301K\t\nnow", "\u0301a \u0301", "İstanbul ΣΑΣ", "", "  "]:
        assert np.frombuffer(own.encode(text), "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids, text


def test_packing_plan_uses_exact_complements():
    histogram = np.zeros(101, np.int64)
    histogram[[60, 40, 55, 25, 20, 100]] = [3, 3, 2, 2, 2, 1]
    assert sum(n for _, n in packing.plan(histogram)) == 6


def test_media_round_trips_and_matches_contract(docs, none):
    files, sounds = media.store_payloads(docs, "doc_id", "text")
    stored, texts = {r["doc_id"]: bytes(r["media"]) for r in files.collect()}, dict(pairs(docs))
    assert len(stored) == len(texts)
    for r in sounds.collect():
        text, file = texts[r["doc_id"]], stored[r["doc_id"]]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == brute.digests(text)
        assert media.payload_of(file) == brute.payload(text)
        assert (r["media_bytes"], r["media_sha256"]) == (len(file), hashlib.sha256(file).hexdigest())
        pcm = np.concatenate([np.frombuffer(bytes(x), "<i2") for x in r["pcm"]])
        assert (pcm == media.decode([file])[0]).all() and r["feature"] == media.feature(r["codec"], pcm)
    assert all(t.count() == 0 for t in media.store_payloads(none, "doc_id", "text"))


@pytest.mark.parametrize("codec", ["mulaw", "alaw", "adpcm"])
@pytest.mark.parametrize("target", [16000, 11025, 6000])
def test_long_sounds_are_the_same_in_stretches(codec, target):
    file = media.encode(np.random.default_rng(4).integers(0, 256, 64 * 900, np.uint8).tobytes(), codec)
    whole = media.decode([file], target)[0]
    parts = list(media.stretches(file, target, 7000))
    assert len(parts) > 5 and (np.concatenate(parts) == whole).all()
    levels = media.Levels()
    for part in parts:
        levels.add(part)
    assert levels.feature(codec, target) == media.feature(codec, whole, target)
    raw = media.decode([file], 8000)[0].astype(int)
    at = np.arange(len(whole)) * 8000
    near, after = raw[at // target], np.append(raw, raw[-1])[at // target + 1]
    assert (whole == (near * (target - at % target) + after * (at % target)) // target).all()


def test_payloads_over_a_stretch(spark):
    texts = {k: "".join(random.Random(k).choices("abc é\n", k=2_500_000 + k)) for k in range(3)}  # the codec follows from the bytes
    df = spark.createDataFrame(list(texts.items()), "codec long, text string")
    files, sounds = media.store_payloads(df, "codec", "text")
    stored = {r["codec"]: bytes(r["media"]) for r in files.collect()}
    for r in sounds.collect():
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == brute.digests(texts[r["codec"]])
        assert len(r["pcm"]) > 1
        assert b"".join(map(bytes, r["pcm"])) == media.decode([stored[r["codec"]]])[0].astype("<i2").tobytes()
        assert r["codec_"] == media.parse(stored[r["codec"]])[0]


def test_adpcm_equals_a_sample_by_sample_decoder():
    rng = np.random.default_rng(1)
    blocks = rng.integers(0, 256, (5, 68), np.uint8)
    blocks[:, 2] %= 89
    for row, got in zip(blocks, media.decode_adpcm(blocks)):
        level, index = int(row[:2].copy().view("<i2")[0]), int(row[2])
        want = [level]
        for byte in row[4:]:
            for code in (byte & 15, byte >> 4):
                step = int(media._STEPS[index])
                size = (step >> 3) + (step if code & 4 else 0) + (step >> 1 if code & 2 else 0) + (step >> 2 if code & 1 else 0)
                level = max(-32768, min(32767, level - size if code & 8 else level + size))
                index = max(0, min(88, index + int(media._TURNS[code])))
                want.append(level)
        assert got.tolist() == want


def test_companding_tables_and_damage(spark):
    assert sorted(set(media.mulaw_table().tolist()))[0] == -32124 and media.mulaw_table()[255] == 0
    assert media.alaw_table().max() == 32256 and media.alaw_table()[0xD5] == 8
    files = [(1, bytearray(media.encode(b"\x01" * 64, "alaw"))), (2, bytearray(b"RIFF")), (3, None)]
    files += [(4, bytearray(media.encode(b"\x01" * 64, "adpcm")[:-30]))]
    got = {r["k1"]: r["codec"] for r in media.decode_media(spark.createDataFrame(files, "k1 long, m binary"), "k1", "m").collect()}
    assert got == {1: "alaw", 2: None, 3: None, 4: None}


def test_warc_reads_back_and_rejects_magic_in_payloads(spark):
    long = "x" * 120
    trap = "a" * 100 + "\r\n\r\nWARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:999>\r\nContent-Length: 2\r\n\r\nhi\r\n\r\n"
    rows = [(1, "http://a/", long), (2, "http://b/\r\nX: y", long), (3, None, None), (4, "u", ""), (5, "u", trap), (6, "u", "é" * 60), (7, "u", "é" * 60), (0, "z", long), (None, "n", long)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    folder = warc.write(warc.plan_records(pages))
    emitted, got = warc.emit(spark, folder).count(), {r["id"]: r for r in warc.read(spark, folder).collect()}
    assert emitted == len(rows) + 1 and len(got) == len(rows)
    assert {i: (r["kind"], r["refers_to"]) for i, r in got.items()} == {0: ("response", None), 1: ("revisit", 0), 2: ("revisit", 0), 3: ("response", None), 4: ("response", None), 5: ("response", None), 6: ("response", None), 7: ("revisit", 6), None: ("response", None)}
    assert all(got[i]["payload_bytes"] == len((h or "").encode()) for i, _, h in rows)
    assert warc.read(spark, warc.write(warc.plan_records(pages.limit(0)))).count() == 0


def test_pointer_jumping():
    offset = np.array([0, 5, 10, 12, 20])
    assert warc.reached(offset, np.array([10, 12, 20, 20, 30]), 30).tolist() == [True, False, True, False, True]
    with pytest.raises(ValueError):
        warc.reached(offset, np.array([10, 12, 21, 20, 30]), 30)


def test_language_accuracy_and_rejections(spark, sf_dir):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.fit_on_training_rows(docs)
    test = docs.where(langid.held_out()).select("doc_id", "lang").join(langid.predict(docs, model), "doc_id").collect()
    right = sum(r["lang"] == r["lang_pred"] for r in test) / len(test)
    assert right >= 0.95, right
    assert {r["doc_id"] % 4 >= 0 and zlib.crc32(str(r["doc_id"]).encode()) % 4 for r in test} == {2}
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "123 !? 4"), (4, "the and of that")], "doc_id long, text string")
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.predict(odd, model).collect()}
    assert got[1] == got[2] == got[3] == ("und", 0.0) and got[4][0] == "en"
    assert {r["lang_pred"] for r in langid.predict(odd, ([], np.zeros((0, 1 << langid.BITS)))).collect()} == {"und"}


def test_mixture_finds_both_languages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    names, logs = langid.fit_on_training_rows(docs)
    texts = {r["lang"]: r["text"] for r in docs.where("n_chars between 1500 and 3000").collect()}
    lang, score, shares, noise = langid.infer(texts["de"] + " " + texts["es"], names, np.ascontiguousarray(logs.T))
    assert {"de", "es"} <= set(shares) and 0.2 < score < 0.8 and noise < 0.2


def test_mixing_meets_weights_and_limits(docs, none):
    spark = docs.sparkSession
    totals = mixing.Totals(spark.createDataFrame([("a", 1000), ("b", 10), ("c", 100), (None, 0)], "__source string, __tokens long"))
    assert mixing.solve(totals) == pytest.approx(1 - math.log(2) / math.log(100))
    reached = mixing.solve(totals, None, 1.0, None)
    assert mixing.entropy(reached, *totals.sums([reached])[0]) == pytest.approx(1.0)
    for budget in (50, 2000):
        x = mixing.solve(totals, budget, None, 1.5)
        shares = [t / 1110 for t in (1000, 10, 100)]
        times = [budget * s**x / sum(y**x for y in shares) / (s * 1110) for s in shares]
        assert max(times) <= 1.5 + 1e-9 or x == 1.0
        assert x == 0.0 or max(times) == pytest.approx(1.5) or x == 1.0
    skewed = docs.withColumn("source", F.when(F.col("doc_id") % 10 == 0, "rare").otherwise("hot"))
    rows = mixing.mix(skewed).collect()
    used = Counter(r["doc_id"] for r in rows)
    assert set(used) == {i for i, _ in pairs(docs)} and max(used.values()) <= 2
    want = {r["source"]: r["__weight"] for r in rows}
    got = Counter()
    for r in rows:
        got[r["source"]] += len((r["text"] or "").split())
    assert sum(abs(got[s] / sum(got.values()) - w) for s, w in want.items()) < 0.15
    half = mixing.mix(docs, budget=2000, max_repeats=None).collect()
    assert sum(len((r["text"] or "").split()) for r in half) <= 2000
    assert mixing.mix(none).count() == 0


def test_sharding_is_whole_and_even(docs, none):
    rows = sharding.shard(docs, 5).collect()
    text = dict(pairs(docs))
    homes, slots, size = defaultdict(set), defaultdict(list), Counter()
    for r in rows:
        raw = (text[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"]) == (len(raw) + 16, zlib.crc32(raw))
        homes[text[r["doc_id"]]].add(r["shard"])
        slots[r["shard"]].append(r["slot"])
        size[r["shard"]] += r["size"]
    assert len(rows) == len(text) and all(len(h) == 1 for h in homes.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(size.values()) <= 1.4 * sum(size.values()) / 5
    assert sharding.shard(none).count() == 0


def test_differencing_beats_greedy_by_far():
    sizes = np.sort(np.random.default_rng(0).integers(1, 10**6, 4000))[::-1]
    loads = np.bincount(sharding.difference_units(sizes, 40), weights=sizes, minlength=40)
    assert np.ptp(loads) < 1000 and loads.sum() == sizes.sum()


def test_url_rules_and_model(spark):
    urls = ["https://A.Example.ORG/es/x?y", "http://example.org/en/123#z", "http://notexample.org/es/", "http://x.com/fr/", "http://x.com/de/1", "http://com/de/", "http://x.org", "nothing", None, "ftp://h?q://x", "http://best-casino.example.net/poker/jackpot", "http://city-library.example.net/science/history"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r["page_id"]: r for r in urlfilter.judge(pages, queries.RULES, urlfilter.labelled_urls(spark)).collect()}
    assert [(got[i]["host"], got[i]["path"], got[i]["rule"]) for i in range(10)] == [("a.example.org", "/es/x", "example.org/es/"), ("example.org", "/en/123", "example.org/en/1"), ("notexample.org", "/es/", "org/"), ("x.com", "/fr/", "com/fr/"), ("x.com", "/de/1", "com/de/"), ("com", "/de/", "com/de/"), ("x.org", "", None), ("", "", None), ("", "", None), ("h", "", None)]
    assert [got[i]["verdict"] for i in range(6)] == ["block", "block", "allow", "allow", "block", "block"]
    assert (got[10]["verdict"], got[11]["verdict"]) == ("block", "allow")
    plan = urlfilter.judge(pages, queries.RULES, urlfilter.labelled_urls(spark))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Exchange" not in plan
    assert urlfilter.judge(pages.limit(0), queries.RULES, urlfilter.labelled_urls(spark)).count() == 0
    assert math.isclose(urlfilter.train(urlfilter.labelled_urls(spark).where("label = 1"))[-1], -100.0)


@pytest.mark.parametrize("per_task", [10**6, 40])
def test_components_of_paths_stars_and_cycles(spark, monkeypatch, per_task):
    from fusionweft.llm import components

    monkeypatch.setattr(components, "LINKS_PER_TASK", per_task)
    r = random.Random(2)
    links = [(i, i + 1) for i in range(100, 220)] + [(500, k) for k in range(300, 360)] + [(601, 602), (602, 603), (603, 601), (7, 7)]
    r.shuffle(links)
    found = {x["node"]: x["root"] for x in components.components(spark.createDataFrame(links, "a long, b long").repartition(6)).collect()}
    want = {i: 100 for i in range(100, 221)} | {k: 300 for k in [*range(300, 360), 500]} | {601: 601, 602: 601, 603: 601}
    assert found == want
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_a_cluster_without_a_shared_folder_is_an_error(monkeypatch):
    class Conf:
        get = staticmethod(lambda *a: None)

    class Context:
        master, applicationId = "spark://host:7077", "app-1"
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        conf, sparkContext = Conf, Context

    with pytest.raises(RuntimeError):
        common.shared_dir(Session)
    Context.master = "local-cluster[2,1,1024]"
    with pytest.raises(RuntimeError):
        common.shared_dir(Session)
    Context.master = "local[2]"
    assert common.shared_dir(Session).startswith("file://") and common.shared_dir(Session) == common.shared_dir(Session)


def test_tables_on_the_way_can_be_dropped(spark, docs):
    import os

    kept = common.stored(docs, "x")
    path = common._paths[id(kept)][1].removeprefix("file://")
    assert os.path.isdir(path)
    common.drop(kept)
    assert not os.path.exists(path)


def test_repeated_queries_and_vectors(spark):
    rows = [(50, [1.0, 0.5]), (50, [1.0, 0.5]), (50, [-1.0, 0.0])] + [(i, [i / 10, 0.1]) for i in range(1, 9)] + [(7, [0.7, 0.1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [tuple(r) for r in topk.search(df, df.where("vec_id % 50 = 0"), "vec_id", "embedding").orderBy("query_id", "score", "rank").collect()]
    first = [r for r in got if r[3] > 0]
    assert sorted((r[1], r[2]) for r in first) == [(1, 8), (2, 7), (3, 7), (4, 6), (5, 5)]
    assert sorted((r[1], r[2]) for r in got if r[3] < 0) == [(1, 1), (2, 2), (3, 3), (4, 4), (5, 5)] and len(got) == 10


def test_scores_beyond_64_bits(spark):
    rows = [(0, [1e30, 1.0]), (1, [1e10, 1.0]), (2, [1e10, 2.0]), (3, [-1e30, 0.0]), (4, [0.0, 0.5]), (5, [1e15, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r["vec_id"], r["score"]) for r in topk.search(df, df.where("vec_id = 0"), "vec_id", "embedding").orderBy("rank").collect()]
    top = (1 << 63) - 1
    assert got == [(1, top), (2, top), (5, top), (4, 256 * 128), (3, -1 << 63)]


def test_packing_tries_every_first_length():
    """The longest lengths leave no pair; the triple among the shortest ones fills the gap."""
    left = np.zeros(4097, np.int64)
    for b in (1, 3, 7, 9, 19, 21, 25, 27, 55):
        left[[4096 - 2 * b, b]] = 1
    left[[1500, 1396, 1200]] = 1
    assert sorted(packing.Sums(left).exact(4096)) == [1200, 1396, 1500]


def test_exact_complements_equal_brute_force():
    from itertools import combinations_with_replacement

    r = random.Random(6)
    for _ in range(60):
        left = np.zeros(61, np.int64)
        for _ in range(r.randint(1, 14)):
            left[r.randint(1, 60)] += r.randint(1, 2)
        sums = packing.Sums(left)
        for gap in r.choices(range(1, 61), k=40):
            want = any(sum(c) == gap and all(left[x] >= c.count(x) for x in c) for k in (1, 2, 3) for c in combinations_with_replacement(np.flatnonzero(left).tolist(), k))
            found = sums.exact(gap)
            assert (found is not None) == want
            if found:
                assert sum(found) == gap and all(left[x] >= found.count(x) for x in found)
                for x in found:
                    left[x] -= 1


def test_copies_of_a_piece_are_told_apart(spark):
    df = spark.createDataFrame([(1, "a b c")] * 3 + [(1, "other text"), (None, "a b c")], "doc_id long, text string")
    rows = packing.pack(df, queries.vocabulary()).collect()
    assert sorted((r["doc_id"] is None, r["ids_crc32"] == rows[0]["ids_crc32"], r["copy"]) for r in rows).count((True, True, 0)) <= 1
    copies = Counter((r["doc_id"], r["ids_crc32"], r["copy"]) for r in rows)
    assert set(copies.values()) == {1} and sorted(c for i, _, c in copies if i == 1) == [0, 0, 1, 2]


def test_language_counts_have_no_seams(monkeypatch):
    text = "".join(random.Random(2).choices("abcdé \n中x", k=719_430))
    whole = langid.grams(text)
    for stretch in (1 << 25, 1000, 99_991):
        monkeypatch.setattr(langid, "STRETCH", stretch)
        assert (langid.grams(text) == whole).all()
    short = text[:3000]
    monkeypatch.setattr(langid, "STRETCH", 7)
    counts = langid.grams(short)
    assert {int(i): int(counts[i]) for i in np.flatnonzero(counts)} == brute.ngrams(short, langid.BITS)


def test_language_equals_plain_python(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    names, logs = langid.fit_on_training_rows(docs)
    counts = {n: Counter() for n in names}
    for r in docs.collect():
        if zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2:
            counts[r["lang"]].update(brute.ngrams(r["text"], langid.BITS))
    for name, row in zip(names, logs):
        total = sum(counts[name].values()) + langid.SMOOTHING * (1 << langid.BITS)
        for bucket in (*list(counts[name])[:300], 5):
            assert row[bucket] == pytest.approx(math.log((counts[name][bucket] + langid.SMOOTHING) / total), abs=1e-5)
    texts = {r["doc_id"]: r["text"][:400] for r in docs.collect()[:40]}
    texts |= {1000: texts[3] + " " + texts[17], 1001: None, 1002: "12 3", 1003: "zzzz qqqq"}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for r in langid.predict(df, (names, logs)).collect():
        lang, score = brute.language(texts[r["doc_id"]], names, logs, langid.ROUNDS, langid.PENALTY, langid.BITS)
        assert r["lang_pred"] == lang and r["score"] == pytest.approx(score, abs=1e-6)


def test_identified_rejects_what_the_model_does_not_know(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    model = langid.fit_on_training_rows(docs)
    odd = [(900, "中文的文字在這裡沒有人讀得懂這是一個例子", "en", "s", 1), (901, "xkqjw zvqxj qqzzk wwxqk zxqvk jjqkx", "en", "s", 1), (902, None, "en", None, 1), (903, "1 2 3", None, "s", 1)]
    right = docs.limit(30).withColumn("lang", F.lit(None).cast("string"))
    frame = right.union(spark.createDataFrame(odd, docs.schema)).withColumn("__lang2", F.lit("own"))
    got = {r["doc_id"]: r for r in langid.identified(frame, model).collect()}
    assert set(got) == {r["doc_id"] for r in right.collect()}
    truth = {r["doc_id"]: r["lang"] for r in docs.collect()}
    assert sum(r["lang"] == truth[i] for i, r in got.items()) >= 29 and all(r["__lang2"] == "own" for r in got.values())
    assert langid.identified(frame.limit(0), model).count() == 0
    assert langid.identified(frame, ([], np.zeros((0, 1 << langid.BITS)))).count() == 0


@pytest.mark.parametrize("count, parts, stretch", [(3000, 40, 20_000), (37, 5, 20_000), (400, 7, 10**6)])
def test_differencing_equals_whole_partial_partitions(count, parts, stretch):
    sizes = np.sort(np.random.default_rng(count).integers(1, 10**6, count))[::-1]
    loads = np.bincount(sharding.difference_units(sizes, parts), weights=sizes, minlength=parts)
    assert np.sort(loads).astype(int).tolist() == brute.differenced(sizes.tolist(), parts)


def test_sharding_with_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(sharding, "PER_BUCKET", 4)
    monkeypatch.setattr(sharding, "LEAST_BUCKETS", 4)
    monkeypatch.setattr(sharding, "TOGETHER", 6)
    monkeypatch.setattr(sharding, "LARGE", 16)
    r = random.Random(9)
    rows = [(i, "x" * r.randint(0, 400)) for i in range(900)]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"), 4).collect()
    load, homes = Counter(), defaultdict(set)
    for x in got:
        load[x["shard"]] += x["size"]
        homes[rows[x["doc_id"]][1]].add(x["shard"])
    assert len(got) == 900 and all(len(h) == 1 for h in homes.values())
    assert max(load.values()) - min(load.values()) < 200


@pytest.mark.parametrize("repeats", [2.0, 1.3, 1.0])
def test_mixing_equals_a_replay(docs, repeats):
    frame = docs.where("text is not null").withColumn("source", F.when(F.col("doc_id") % 7 == 0, F.lit(None)).when(F.col("doc_id") % 7 < 3, "rare").otherwise("hot"))
    places = [F.xxhash64(F.lit(8), "source", F.pmod("__deal", F.lit(mixing.LEAST_BLOCKS)).cast("int"), F.lit(e)) for e in range(3)]
    told = frame.withColumns(mixing._hashes(7)).select("doc_id", "source", mixing.words(F.col("text")).alias("n"), F.pmod("__deal", F.lit(mixing.LEAST_BLOCKS)).alias("b"), "__row", F.array(*places).alias("p"))
    exponent, want = brute.mixed([tuple(r) for r in told.collect()], repeats)
    rows = mixing.mix(frame, max_repeats=repeats).collect()
    assert Counter(r["doc_id"] for r in rows) == {k: v for k, v in want.items() if v}
    assert all(r["__exponent"] == pytest.approx(exponent) for r in rows)
    assert {(r["doc_id"], r["__epoch"]) for r in rows} == {(k, e) for k, v in want.items() for e in range(v)}


def test_words_are_counted_without_garbage(spark):
    long = spark.range(20).selectExpr("repeat(concat('word', id, ', '), 50000) AS text")
    bean = spark._jvm.java.lang.management.ManagementFactory.getThreadMXBean()
    for _ in range(2):  # the first time code is compiled
        before = bean.getTotalThreadAllocatedBytes()
        assert long.agg(F.sum(mixing.words(F.col("text")))).head()[0] == 20 * 50_000
        made = bean.getTotalThreadAllocatedBytes() - before
    assert made < 30 * sum(50_000 * (6 + len(str(i))) for i in range(20))
    odd = [None, "", " ", "\t\n\x0b\x0c\r ", "x", " xx\n", "a\tb", "\u3000 \xa0", "a\x00b \x01", "\U0001f600 \U0001f600", " " * 400_000, " a" * 200_000, "\x1c \x85", "$1 \\ x"]
    got = spark.createDataFrame(list(enumerate(odd)), "i int, text string").select("i", mixing.words(F.col("text"))).collect()
    assert dict(map(tuple, got)) == {i: len(re.findall(r"[^ \t\n\x0b\x0c\r]+", s or "")) for i, s in enumerate(odd)}


def test_workers_hand_memory_back(monkeypatch):
    done = []
    monkeypatch.setattr(common, "_hand_back", lambda: done.append(1))
    assert list(common.lean(lambda batches: (b + 1 for b in batches))(iter([1, 2]))) == [2, 3] and done == [1]
    stopped = common.lean(lambda batches: (b for b in batches))(iter([1, 2]))
    next(stopped)
    stopped.close()  # as where a task needs no more rows
    assert done == [1, 1]


def test_mixing_without_ids_spreads_by_text(spark):
    rows = [(None, f"word{i} and more", "a") for i in range(90)] + [(i, "some words here", "b") for i in range(10)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), budget=200, max_repeats=None).groupBy("source").count().collect()
    assert {r["source"]: r["count"] for r in got}["a"] >= 30


def test_archives_of_long_and_repeated_pages(spark, monkeypatch):
    monkeypatch.setattr(warc, "FILE_BYTES", 1 << 20)
    monkeypatch.setattr(warc, "LARGE_RECORD", 1 << 18)
    r = random.Random(3)
    rows = [(i, "u", "".join(r.choices("abcdef\r\n", k=r.choice((10, 5000, 300_000, 700_000))))) for i in range(24)]
    rows += [(5, "u", rows[5][2]), (30, "u", rows[5][2]), (30, "u", rows[5][2])]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("kind", F.lit("own")).withColumn("id", F.lit(1)).repartition(2)
    folder = warc.write(warc.plan_records(pages))
    got = warc.read(spark, folder).collect()
    assert Counter((x["id"], x["digest"]) for x in got) == Counter((i, hashlib.sha256(h.encode()).hexdigest()) for i, _, h in rows)
    large = len(rows[5][2]) >= 100
    assert Counter(x["kind"] for x in got if x["id"] in (5, 30)) == ({"response": 2, "revisit": 2} if large else {"response": 4})
    files = spark.read.format("binaryFile").load(folder).count()
    assert files > sum(len(h) for _, _, h in rows) >> 20


def test_extra_columns_with_clashing_names(spark):
    pages = spark.createDataFrame([(1, "http://a.org/x", "<p>")], "page_id long, url string, html string")
    for name in ("host", "path", "rule", "score", "verdict", "_says", "id", "kind", "size", "digest", "payload"):
        pages = pages.withColumn(name, F.lit("own"))
    assert urlfilter.judge(pages, queries.RULES, urlfilter.labelled_urls(spark)).head()["verdict"] == "allow"
    assert warc.read(spark, warc.write(warc.plan_records(pages))).count() == 1
    vectors = spark.createDataFrame([(50, [1.0]), (51, [2.0])], "vec_id long, embedding array<double>")
    for name in ("id", "q", "row", "b", "c", "query_id", "rank", "score"):
        vectors = vectors.withColumn(name, F.lit("own"))
    assert topk.search(vectors, vectors.where("vec_id = 50"), "vec_id", "embedding").count() == 1
    docs = spark.createDataFrame([(1, "the one that is here", "en", "s")], "doc_id long, text string, lang string, source string")
    for name in ("lang_pred", "score", "shares", "set", "sig", "text_hash", "length", "_cell", "piece", "k", "v", "media", "shard", "size", "a", "tokens"):
        docs = docs.withColumn(name, F.lit("own"))
    assert langid.predict(docs, langid.fit(docs)).count() == 1 and neardup.one_of_each(docs).head()["sig"] == "own"
    assert packing.pack(docs, queries.vocabulary()).count() == 1 and mixing.mix(docs).head()["tokens"] == "own"
    assert media.store_payloads(docs, "doc_id", "text")[1].count() == 1 and sharding.shard(docs, 2).count() == 1


def test_urls_repeated_long_and_learned(spark):
    labelled = urlfilter.labelled_urls(spark)
    assert labelled.count() <= urlfilter.MOST_LABELLED
    assert urlfilter.held_out_accuracy(labelled) > 0.9
    urls = ["http://x.net/" + "a/" * 40_000, "http://www.thorind.example.net/de/4821", "http://www.thorind.example.net/de/4821", "http://free-casino.example.com/en/12"]
    got = [r["verdict"] for r in urlfilter.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), (), labelled).orderBy("page_id").collect()]
    assert got[1:] == ["allow", "allow", "block"]


def test_one_passage_shared_by_different_texts(spark):
    """Texts with more than half in common, none of which are near duplicates, and two that are: only those are linked."""
    r = random.Random(12)
    common_, rows = [f"c{i}" for i in range(120)], []
    for i in range(300):
        rows.append((i, " ".join(common_ + [f"w{r.randrange(10**6)}" for _ in range(45)])))
    rows += [(300, rows[7][1] + " one more"), (301, rows[150][1].replace("c60", "d60"))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {x["doc_id"]: x["component_id"] for x in neardup.near_duplicates(df).collect()}
    assert found == {i: c for i, (_, c) in brute.near(rows).items()} and found[300] == 7 and found[301] == 150


def test_one_of_each_group_stays(spark):
    base = " ".join(f"w{i}" for i in range(60))
    rows = [(1, base, "a"), (1, base, "a"), (1, base, "b"), (2, base + " x", "a"), (3, "other words of a text that stands alone", "a"), (3, base + " y", "a"), (None, base, "a"), (None, base, "a"), (4, None, "a"), (4, None, "a"), (5, "", "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    got = neardup.one_of_each(df).collect()
    assert Counter((x["doc_id"], (x["text"] or "")[:5]) for x in got) == {(1, "w0 w1"): 1, (3, "other"): 1, (None, "w0 w1"): 1, (4, ""): 1, (5, ""): 1}

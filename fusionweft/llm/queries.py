"""The corpus operators' queries over whole tables, and the SQL that they equal where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import langid, linededup, media, mixing, neardup, packing, sharding, topk, urlfilter, warc
from .common import table

#: The rules that op1 judges with.
RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = urlfilter.judge(table(spark, sf_dir, "pages"), RULES, urlfilter.labelled_urls(spark))
    return judged.select("page_id", "host", "path", "rule", "verdict", F.round("score", 6).alias("score"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = linededup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", F.col("__lines").cast("long").alias("n_lines"), F.col("__removed").cast("long").alias("n_removed"), "text")


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents")).drop("text_hash")


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk.search(vectors, vectors.where("vec_id % 50 = 0"), "vec_id", "embedding", 5)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary(), with_ids=False)


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, sounds = media.store_payloads(table(spark, sf_dir, "documents"), "doc_id", "text")
    return sounds.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "codec", "pcm")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = warc.write(warc.plan_records(table(spark, sf_dir, "pages")))
    found = warc.read(spark, folder)
    return found.select(F.col("id").alias("page_id"), "payload_bytes", F.col("digest").alias("payload_digest"), F.col("kind").alias("record_type"), "refers_to")


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    done = langid.predict(docs, langid.fit_on_training_rows(docs))
    return done.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score", F.array_join(F.array_sort(F.map_keys("shares")), ",").alias("languages"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", mixing.words(F.col("text")).alias("tokens"), "text")
    done = mixing.mix(docs, max_repeats=mixing.MAX_REPEATS)
    return done.select("doc_id", "source", "tokens", F.col("__epoch").alias("epoch"), F.round("__weight", 9).alias("weight"), F.round("__exponent", 9).alias("exponent"), F.col("__block").alias("block"), F.col("__block_place").alias("block_place"), F.col("__row").alias("row_place"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = sharding.shard(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {f.__name__: f for f in (op1_url_filter, op2_line_dedup, op3_near_duplicates, op4_topk, op5_packing, op6_media, op7_warc, op8_language, op9_mixing, op10_sharding)}

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

ORACLES = {
    "op3_near_duplicates": rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
m AS (SELECT a, min(b) AS b FROM r GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(d.doc_id, m.b) AS component_id, d.doc_id = least(d.doc_id, m.b) AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN m ON m.a = d.doc_id
""",
    "op2_line_dedup": """
WITH l AS (
  SELECT doc_id, i - 1 AS i, trim(translate(x, chr(9) || chr(11) || chr(12) || chr(13), '    ')) AS t, x
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents WHERE text IS NOT NULL)),
w AS (SELECT *, len(list_filter(string_split(t, ' '), lambda y: y <> '')) AS n FROM l WHERE t <> ''),
c AS (SELECT *, sum(n) OVER (PARTITION BY doc_id ORDER BY i) AS upto FROM w),
a AS (
  SELECT doc_id, i, list(t) OVER f AS key, sum(n) OVER f AS words, min(i) OVER f AS first, max(i) OVER f AS last, 0 AS way
  FROM (SELECT *, upto - n AS start FROM c)
  WINDOW f AS (PARTITION BY doc_id ORDER BY start RANGE BETWEEN CURRENT ROW AND 49 FOLLOWING)
  UNION ALL
  SELECT doc_id, i, list(t) OVER f, sum(n) OVER f, min(i) OVER f, max(i) OVER f, 1
  FROM c WINDOW f AS (PARTITION BY doc_id ORDER BY upto RANGE BETWEEN 49 PRECEDING AND CURRENT ROW)),
k AS (SELECT * FROM a WHERE words >= 50),
d AS (
  SELECT doc_id, first, last, min(row(doc_id, first)) OVER (PARTITION BY way, key) AS begin FROM k),
gone AS (SELECT DISTINCT doc_id, unnest(range(first, last + 1)) AS i FROM d WHERE row(doc_id, first) > begin)
SELECT o.doc_id, coalesce(any_value(len(string_split(o.text, chr(10)))), 0)::BIGINT AS n_lines, count(g.i)::BIGINT AS n_removed,
       CASE WHEN any_value(o.text) IS NULL THEN NULL ELSE coalesce(string_agg(l.x, chr(10) ORDER BY l.i) FILTER (WHERE g.i IS NULL), '') END AS text
FROM documents o LEFT JOIN l ON l.doc_id = o.doc_id LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.i = l.i
GROUP BY o.doc_id
""",
    "op4_topk": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id, list_dot_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id)
SELECT query_id, rank, vec_id, score FROM (
  SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank FROM s)
WHERE rank <= 5
""",
    "op7_warc": """
SELECT page_id, n AS payload_bytes, digest AS payload_digest,
       CASE WHEN n >= 100 AND page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND page_id > first THEN first END AS refers_to
FROM (SELECT *, min(page_id) OVER (PARTITION BY digest) AS first
      FROM (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS n, sha256(coalesce(html, '')) AS digest FROM pages))
""",
}

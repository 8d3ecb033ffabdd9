"""WARC archives: written as records, read back by verifying the chain of record boundaries.

Writing. Pages with equal payloads of `LEAST_SHARED` bytes or more share one `response` record, that of the smallest id; the
others become `revisit` records that refer to it. Records are put together as column expressions and written by Spark's own
writer, so files appear whole or not at all, in any store that Spark can write; each file is one gzip stream.

Reading. A payload may hold anything, the magic line of a record included. Tasks therefore emit, for every place in a file
that looks like a record, the place where its successor would begin. In each file's table of such places, pointer jumping
from the file's start marks what the chain reaches: after round n all places up to 2 ** n records from the start. What the
chain does not reach stands inside a payload and is rejected. A chain that does not end at the file's end is an error.

Cases: null payloads are empty; null urls have no target line; line ends in urls are percent-encoded; payloads under
LEAST_SHARED bytes are always responses; a page without id is written with an empty id and comes back with null, as a
response; rows repeated with the smallest id of a payload are all responses, other repeated rows are all revisits to it; very
long payloads share files with fewer others; an empty table gives an empty archive; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_path, ready, stored

LEAST_SHARED = 100
MAGIC = b"WARC/1.0\r\n"
#: Fixed value of the format: the profile of a revisit to an identical payload.
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
#: Most records of a file, and the bytes that it may hold before compression. Readers take a file as a whole, so files must
#: stay small: a record of more than `LARGE_RECORD` bytes goes to files of their own kind, which hold as few records as its bytes
#: ask for, one at least.
FILE_RECORDS, FILE_BYTES, LARGE_RECORD = 2000, 128 << 20, 1 << 20
_NAME = "urn:page:"


def plan_records(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """id, url, payload (binary), size, digest, kind (response or revisit), refers_to."""
    raw = F.coalesce(F.col(payload).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(key).cast("long").alias("id"), F.col(url).alias("url"), raw.alias("payload"))
    rows = rows.withColumns({"size": F.octet_length("payload").cast("long"), "digest": F.sha2("payload", 256)})
    large = (F.col("size") >= LEAST_SHARED) & F.col("id").isNotNull()
    firsts = rows.where(large).groupBy("digest").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("digest").alias("own"), "first")
    firsts = stored(firsts, "firsts")  # only payloads that occur twice
    own = F.when(large, F.col("digest")).otherwise(F.concat(F.lit("-"), F.xxhash64("id", "url").cast("string")))  # spreads what can't match
    told = rows.withColumn("_own", own).join(firsts, F.col("_own") == F.col("own"), "left").drop("_own", "own")
    again = F.col("first") < F.col("id")
    return told.select("id", "url", "payload", "size", "digest", F.when(again, "revisit").otherwise("response").alias("kind"), F.when(again, F.col("first")).alias("refers_to"))


def record(kind: Column) -> Column:
    """A record as binary, without its last line end (which the writer of lines adds)."""
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    uri = lambda value: F.concat(F.lit(f"<{_NAME}"), F.coalesce(value.cast("string"), F.lit("")), F.lit(">"))
    target = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"), line("Content-Length", F.col("size").cast("string")), F.lit("\r\n")).cast("binary")
    again = kind == "revisit"
    block = F.when(again, http).otherwise(F.concat(http, F.col("payload")))
    head = F.concat(
        F.lit(MAGIC.decode()),
        line("WARC-Type", kind),
        line("WARC-Record-ID", uri(F.col("id"))),
        line("WARC-Date", F.lit(DATE)),
        F.coalesce(line("WARC-Target-URI", target), F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        F.when(again, F.concat(line("WARC-Refers-To", uri(F.col("refers_to"))), line("WARC-Profile", F.lit(PROFILE)))).otherwise(""),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.octet_length(block).cast("string")),
        F.lit("\r\n"),
    )
    return F.concat(head.cast("binary"), block, F.lit(b"\r\n\r"))


def write(records: DataFrame, path: str | None = None) -> str:
    """Writes plan_records()'s rows as archives and returns their folder."""
    path = path or fresh_path(records.sparkSession, "warc")
    large = F.col("size") > LARGE_RECORD
    longest = {r[0]: r[1] for r in records.groupBy(large).agg(F.max("size")).collect()}  # two rows at most
    for some, most in longest.items():
        lines = records.where(large if some else ~large).select(record(F.col("kind")).cast("string").alias("value"))  # the bytes stay as they are
        number = max(1, min(FILE_RECORDS, FILE_BYTES // (most + 1024)))
        lines.write.mode("append").option("compression", "gzip").option("lineSep", "\n").option("maxRecordsPerFile", number).text(path)
    if not longest:
        records.select(F.lit("").alias("value")).write.text(path)
    return path


_FIELD = re.compile(rb"(?m)^(WARC-Type|WARC-Record-ID|WARC-Refers-To|WARC-Payload-Digest|Content-Length): *([^\r\n]*)\r$")


def candidates(data: bytes) -> Iterator[tuple]:
    """For every place that looks like a record: offset, successor's offset, id, kind, refers_to, the payload's size and digest as told, and as found."""
    at = data.find(MAGIC)
    while at >= 0:
        end = data.find(b"\r\n\r\n", at)
        head = dict(_FIELD.findall(data, at, end + 2)) if end >= 0 else {}
        length = head.get(b"Content-Length", b"")
        if length.isdigit() and b"WARC-Type" in head:
            start, stop = end + 4, end + 4 + int(length)
            body = data.find(b"\r\n\r\n", start, stop)
            http = data[start : body + 2] if body >= 0 else b""
            size = re.search(rb"(?m)^Content-Length: *(\d+)\r$", http)
            kind = head[b"WARC-Type"].decode("latin-1")
            digest = head.get(b"WARC-Payload-Digest", b"").decode("latin-1").removeprefix("sha256:")
            if kind == "response" and body >= 0 and stop + 4 <= len(data):
                found, told = hashlib.sha256(memoryview(data)[body + 4 : stop]).hexdigest(), stop - body - 4
            else:
                found, told = digest, int(size[1]) if size else 0
            if data[stop : stop + 4] == b"\r\n\r\n":
                yield at, stop + 4, _id(head.get(b"WARC-Record-ID")), kind, _id(head.get(b"WARC-Refers-To")), told, digest, found
        at = data.find(MAGIC, at + 1)


def _id(value: bytes | None) -> int | None:
    digits = (value or b"").decode("latin-1").removeprefix(f"<{_NAME}").removesuffix(">")
    return int(digits) if digits.lstrip("-").isdigit() else None


def reached(offset: np.ndarray, successor: np.ndarray, end: int) -> np.ndarray:
    """Which places the chain from 0 reaches, by pointer jumping. offset is sorted; the chain must end at `end`."""
    n = len(offset)
    jump = np.append(np.searchsorted(offset, successor), n)  # n stands for the end
    known = np.append(offset, end)
    wrong = known[np.minimum(jump[:n], n)] != successor
    lost = n + 1  # for chains that lead nowhere
    jump = np.append(np.where(np.append(wrong, False), lost, jump), lost)  # n and lost stay where they are
    mark = np.zeros(n + 2, bool)
    mark[0 if n and offset[0] == 0 else (n if end == 0 else lost)] = True
    while True:
        more = mark.copy()
        more[jump[mark]] = True
        if (more == mark).all():
            break
        mark, jump = more, jump[jump]
    if mark[lost] or not mark[n]:
        raise ValueError("the chain of records breaks off")
    return mark[:n]


_KIND = "file string, size long, offset long, successor long, id long, kind string, refers_to long, payload_bytes long, told string, digest string"


def emit(spark: SparkSession, path: str) -> DataFrame:
    """The candidates of all archives in a folder (`*.gz` or plain)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file, content in zip(batch["path"].tolist(), batch["content"].tolist(), strict=True):
                data = zlib.decompress(content, 47) if content[:2] == b"\x1f\x8b" else bytes(content)
                rows = [(file, len(data), *c) for c in candidates(data)]
                out = pd.DataFrame(rows, columns=[x.split()[0] for x in _KIND.split(", ")])
                yield out.astype({"id": "Int64", "refers_to": "Int64"})

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return ready(files).mapInPandas(run, _KIND)


def read(spark: SparkSession, path: str) -> DataFrame:
    """id, kind, refers_to, payload_bytes, digest (of the payload as read), file and offset of every true record."""

    def chain(batch: pd.DataFrame) -> pd.DataFrame:
        batch = batch.sort_values("offset", kind="stable")
        good = reached(batch["offset"].to_numpy(), batch["successor"].to_numpy(), int(batch["size"].iloc[0]))
        batch = batch[good]
        if (batch["told"] != batch["digest"]).any():
            raise ValueError("a payload does not have the digest that its record tells")
        return batch[["id", "kind", "refers_to", "payload_bytes", "digest", "file", "offset"]].astype({"id": "Int64", "refers_to": "Int64"})

    kind = "id long, kind string, refers_to long, payload_bytes long, digest string, file string, offset long"
    return emit(spark, path).groupBy("file").applyInPandas(chain, kind)

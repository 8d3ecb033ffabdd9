"""Telephony audio in media columns: mu-law, A-law and IMA ADPCM in WAVE containers.

Mu-law and A-law samples are expanded by tables of 256 numbers that are built from the coding rules. ADPCM is decoded for
all blocks of a batch at once: numpy steps through the samples of a block, and each step handles that sample of every
block. Decoded audio is resampled to a common rate by linear interpolation and stored as 16-bit PCM.

Files are written to a table in the shared folder and read back from there; sounds are a column of the result, an array of
stretches of PCM, and are stored where the result is stored.

Cases: null or empty payloads become one unit of zero bytes; a long file is decoded, resampled and described in stretches of
about `STRETCH` bytes, so memory follows a file's length only by the file and its PCM themselves (a cell of Spark holds 2 GB, so
payloads end at 250 MB); equal payloads (repeated rows) give equal media; damaged files raise ValueError (decode) or give one row of nulls (decode_media); null keys stay null;
an empty table gives empty tables; other columns are ignored, and a computed column whose name the key has gets `_` appended.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ready, stored

UNIT = 64
RATE, TARGET_RATE = 8000, 16000
#: WAVE format tags of the three codecs.
TAGS = {"alaw": 6, "mulaw": 7, "adpcm": 0x11}
_CODECS = {v: k for k, v in TAGS.items()}
_ORDER = ("mulaw", "alaw", "adpcm")
#: An ADPCM block: 4 bytes of header, then UNIT bytes of two samples each.
BLOCK = 4 + UNIT
SAMPLES = 1 + 2 * UNIT
#: Bytes of media that are decoded at once.
STRETCH = 1 << 20


def mulaw_table() -> np.ndarray:
    code = ~np.arange(256) & 255
    size = (((code & 15) << 3) + 132 << (code >> 4 & 7)) - 132
    return np.where(code & 128, -size, size).astype(np.int16)


def alaw_table() -> np.ndarray:
    code = np.arange(256) ^ 0x55
    power, low = code >> 4 & 7, (code & 15) << 4
    size = np.where(power == 0, low + 8, low + 264 << np.maximum(power - 1, 0))
    return np.where(code & 128, size, -size).astype(np.int16)


_MULAW, _ALAW = mulaw_table(), alaw_table()
#: Fixed values of the IMA ADPCM format: step sizes and index changes.
_STEPS = np.array([7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767], np.int32)
_TURNS = np.array([-1, -1, -1, -1, 2, 4, 6, 8] * 2, np.int32)


def _changes() -> tuple[np.ndarray, np.ndarray]:
    """For each step index and code: what is added to the sample, and the next index."""
    code = np.arange(16)
    step = _STEPS[:, None]
    size = (step >> 3) + np.where(code & 4, step, 0) + np.where(code & 2, step >> 1, 0) + np.where(code & 1, step >> 2, 0)
    return np.where(code & 8, -size, size).astype(np.int32).ravel(), np.clip(np.arange(89)[:, None] + _TURNS, 0, 88).astype(np.int32).ravel()


_CHANGE, _NEXT = _changes()


def decode_adpcm(blocks: np.ndarray) -> np.ndarray:
    """blocks: uint8, a row for each block. Returns int16 with a row of samples for each block."""
    count, width = blocks.shape
    out = np.empty((2 * (width - 4) + 1, count), np.int16)
    level = blocks[:, :2].copy().view("<i2").ravel().astype(np.int32)
    index = np.clip(blocks[:, 2].astype(np.int32), 0, 88)
    out[0] = level
    codes = np.empty((2 * (width - 4), count), np.int32)
    body = blocks[:, 4:].T
    codes[0::2], codes[1::2] = body & 15, body >> 4
    for k in range(codes.shape[0]):
        at = index * 16 + codes[k]
        level = np.clip(level + _CHANGE[at], -32768, 32767)
        index = _NEXT[at]
        out[k + 1] = level
    return out.T


def encode(payload: bytes, codec: str, rate: int = RATE) -> bytes:
    """A WAVE file whose sample codes are the payload's bytes (for ADPCM: two 4-bit codes in each byte). Lossless for any bytes whose count is a multiple of UNIT."""
    tag = TAGS[codec]
    if codec == "adpcm":
        rows = np.zeros((len(payload) // UNIT, BLOCK), np.uint8)
        rows[:, 4:] = np.frombuffer(payload, np.uint8).reshape(-1, UNIT)
        data, samples = rows.tobytes(), SAMPLES * len(rows)
        kind = struct.pack("<HHIIHHHH", tag, 1, rate, rate * BLOCK // SAMPLES, BLOCK, 4, 2, SAMPLES)
    else:
        data, samples = payload, len(payload)
        kind = struct.pack("<HHIIHHH", tag, 1, rate, rate, 1, 8, 0)
    body = b"WAVEfmt " + struct.pack("<I", len(kind)) + kind + b"fact" + struct.pack("<II", 4, samples) + b"data" + struct.pack("<I", len(data)) + data
    body += b"\0" * (len(data) % 2)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def parse(media: bytes) -> tuple[str, int, bytes, int]:
    """Codec, rate, data and block size of a WAVE file."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAVE file")
    at, codec, rate, block, data = 12, None, 0, 1, None
    while at + 8 <= len(media):
        name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if name == b"fmt ":
            tag, _, rate, _, block = struct.unpack_from("<HHIIH", media, at + 8)
            codec = _CODECS.get(tag)
        elif name == b"data":
            data = media[at + 8 : at + 8 + size]
            if len(data) < size:
                raise ValueError("the file is cut short")
        at += 8 + size + size % 2
    if codec is None or data is None:
        raise ValueError("no telephony audio in it")
    return codec, rate, data, block


def payload_of(media: bytes) -> bytes:
    """The bytes that encode() was given."""
    codec, _, data, block = parse(media)
    return np.frombuffer(data, np.uint8).reshape(-1, block)[:, 4:].tobytes() if codec == "adpcm" else data


def resample(pcm: np.ndarray, after: int, begin: int, total: int, rate: int, target: int) -> np.ndarray:
    """Linear interpolation, rounded down, of samples `begin` and on of a sound of `total` samples. after is the sample that follows."""
    if rate == target:
        return pcm
    wide = np.append(pcm, np.int16(after)).astype(np.int64)
    if target == 2 * rate:
        out = np.empty(2 * len(pcm), np.int16)
        out[0::2] = pcm
        out[1::2] = wide[:-1] + wide[1:] >> 1
        return out
    first, last = -(-begin * target // rate), min(-(-(begin + len(pcm)) * target // rate), total * target // rate)
    at, part = np.divmod(np.arange(first, max(first, last)) * rate, target)
    at -= begin
    return ((wide[at] * (target - part) + wide[at + 1] * part) // target).astype(np.int16)


def _expanded(codec: str, data: np.ndarray, block: int) -> np.ndarray:
    if codec == "adpcm":
        return decode_adpcm(data.reshape(-1, block)).ravel()
    return (_MULAW if codec == "mulaw" else _ALAW)[data]


def stretches(media: bytes, target: int = TARGET_RATE, stretch: int = STRETCH) -> Iterator[np.ndarray]:
    """16-bit PCM at the target rate of one file, a stretch after the other; at least one."""
    codec, rate, raw, block = parse(media)
    data = np.frombuffer(raw, np.uint8)
    step = max(1, stretch // block) * block
    total = len(data) // block * (2 * (block - 4) + 1 if codec == "adpcm" else 1)
    begin, now = 0, _expanded(codec, data[:step], block)
    for at in range(step, max(len(data), 1) + step, step):
        more = _expanded(codec, data[at : at + step], block) if at < len(data) else now[-1:]
        yield resample(now, int(more[0]) if len(more) else 0, begin, total, rate, target)
        begin, now = begin + len(now), more


def decode(files: list[bytes], target: int = TARGET_RATE) -> list[np.ndarray]:
    """16-bit PCM at the target rate of each file. ADPCM blocks of one size are decoded together, across files."""
    parts = [parse(f) for f in files]
    out: list[np.ndarray | None] = [None] * len(files)
    together: dict[int, list[int]] = {}
    for k, (codec, _, data, block) in enumerate(parts):
        if codec == "adpcm":
            together.setdefault(block, []).append(k)
        else:
            out[k] = _expanded(codec, np.frombuffer(data, np.uint8), block)
    for block, members in together.items():
        rows = [np.frombuffer(parts[k][2], np.uint8).reshape(-1, block) for k in members]
        pcm = decode_adpcm(np.concatenate(rows))
        ends = np.cumsum([len(r) for r in rows])
        for k, part in zip(members, np.split(pcm, ends[:-1]), strict=True):
            out[k] = part.ravel()
    return [resample(pcm, int(pcm[-1]) if len(pcm) else 0, 0, len(pcm), parts[k][1], target) for k, pcm in enumerate(out)]


def codec_for(payload: bytes) -> str:
    """The codec that this payload is stored with; it follows from the bytes alone, so equal payloads get equal media."""
    return _ORDER[zlib.crc32(payload) % 3]


def padded(payload: bytes) -> bytes:
    return payload + b"\0" * (-len(payload) % UNIT if payload else UNIT)


class Levels:
    """What is told of a sound: codec, duration, level, peak, zero crossings and a checksum, added up over its stretches."""

    def __init__(self) -> None:
        self.count = self.power = self.peak = self.crossings = self.crc = 0
        self.below: bool | None = None

    def add(self, pcm: np.ndarray) -> None:
        if not len(pcm):
            return
        wide = pcm.astype(np.int64)
        below = pcm < 0
        self.crossings += int(np.count_nonzero(below[1:] != below[:-1])) + (self.below is not None and self.below != below[0])
        self.below = bool(below[-1])
        self.count += len(pcm)
        self.power += int((wide * wide).sum())
        self.peak = max(self.peak, -int(wide.min()), int(wide.max()))
        self.crc = zlib.crc32(pcm.astype("<i2").tobytes(), self.crc)

    def feature(self, codec: str, target: int) -> str:
        rms = int((self.power / max(1, self.count)) ** 0.5)
        return f"{codec};rate={target};samples={self.count};rms={rms};peak={self.peak};crossings={self.crossings};pcm_crc32={self.crc}"


def feature(codec: str, pcm: np.ndarray, target: int = TARGET_RATE) -> str:
    levels = Levels()
    levels.add(pcm)
    return levels.feature(codec, target)


def encode_media(frame: DataFrame, key: str, payload: str) -> DataFrame:
    """k (the key), n_bytes, media: each row's payload (binary or string), padded, as a file of telephony audio."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows, size = [], 0
            for k, value in zip(batch["k"].tolist(), batch["v"].tolist(), strict=True):
                raw = bytes(value) if value is not None else b""
                full = padded(raw)
                rows.append((k, len(raw), encode(full, codec_for(full))))
                size += len(full)
                if size > 4 * STRETCH:
                    yield pd.DataFrame(rows, columns=["k", "n_bytes", "media"]).astype({"k": "Int64"})
                    rows, size = [], 0
            yield pd.DataFrame(rows, columns=["k", "n_bytes", "media"]).astype({"k": "Int64"})

    return ready(frame).select(F.col(key).cast("long").alias("k"), F.col(payload).cast("binary").alias("v")).mapInPandas(run, "k long, n_bytes long, media binary")


_TOLD = {"codec": "string", "payload_bytes": "long", "payload_sha256": "string", "tail_crc32": "long", "media_bytes": "long", "media_sha256": "string", "feature": "string"}


def _sounds(files: DataFrame, target: int) -> DataFrame:
    """Rows of k, n_bytes, media as rows of k, n_bytes, pcm and what _TOLD names."""
    names = ["k", "n_bytes", "pcm", *_TOLD]

    def told(media: bytes, sound: Iterator[np.ndarray]) -> tuple:
        levels, pcm = Levels(), []
        for some in sound:
            levels.add(some)
            pcm.append(some.astype("<i2").tobytes())
        back = payload_of(media)
        codec = parse(media)[0]
        return pcm, codec, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-UNIT:]), len(media), hashlib.sha256(media).hexdigest(), levels.feature(codec, target)

    def table(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=names).astype({c: "Int64" for c in ("k", "n_bytes", "payload_bytes", "tail_crc32", "media_bytes")})

    def together(some: list[tuple]) -> pd.DataFrame:
        pcm = decode([media for _, _, media in some], target)
        return table([(k, n, *told(media, iter([sound]))) for (k, n, media), sound in zip(some, pcm, strict=True)])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            some, size = [], 0
            for k, n, value in zip(batch["k"].tolist(), batch["n_bytes"].tolist(), batch["media"].tolist(), strict=True):
                try:
                    media = bytes(value)
                    _, _, data, block = parse(media)
                    if len(data) % block:
                        raise ValueError("a block is cut short")
                except (ValueError, TypeError, struct.error):
                    yield table([(k, n, *[None] * (1 + len(_TOLD)))])
                    continue
                if len(media) > STRETCH:
                    yield table([(k, n, *told(media, stretches(media, target)))])
                    continue
                some.append((k, n, media))
                size += len(media)
                if size > STRETCH:
                    yield together(some)
                    some, size = [], 0
            if some:
                yield together(some)

    kind = "k long, n_bytes long, pcm array<binary>, " + ", ".join(f"{n} {t}" for n, t in _TOLD.items())
    return ready(files).mapInPandas(run, kind)


def _named(frame: DataFrame, key: str) -> DataFrame:
    return frame.select(*[F.col(c).alias(key if c == "k" else c + "_" if c == key else c) for c in frame.columns])


def decode_media(frame: DataFrame, key: str, media: str, target: int = TARGET_RATE) -> DataFrame:
    """The sounds of media files: the key, pcm (stretches of 16-bit little-endian samples at the target rate), codec, payload_bytes,
    payload_sha256, tail_crc32, media_bytes, media_sha256 and feature; nulls where the file is null or damaged."""
    files = frame.select(F.col(key).cast("long").alias("k"), F.lit(None).cast("long").alias("n_bytes"), F.col(media).cast("binary").alias("media"))
    return _named(_sounds(files, target).drop("n_bytes"), key)


def store_payloads(frame: DataFrame, key: str, payload: str, target: int = TARGET_RATE) -> tuple[DataFrame, DataFrame]:
    """Each row's payload (binary or string) stored as telephony audio, read back and decoded.

    Returns the files, a table in the shared folder (the key, n_bytes, media), and their sounds, which are made from the files as
    they are read back (the key, n_bytes and what decode_media() gives).
    """
    files = stored(encode_media(frame, key, payload), "media", "zstd")
    return _named(files, key), _named(_sounds(files, target), key)

"""Media columns: payloads as PNG in binary columns, read back with checksum tests, and hashed by low frequencies."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import mapped, read_table, text_or_empty

SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Pixels of a row; three 8-bit samples each, so a row holds 192 bytes of payload.
WIDTH = 64
ROW = 3 * WIDTH
#: Rows tried with each filter to choose the image's.
TRY = 64
#: zlib level: text gains little from higher ones.
LEVEL = 3
#: Side of the reduced grey image and of its low-frequency corner.
SIDE, LOW = 32, 8


def padded(data: bytes) -> bytes:
    """The payload: the data with spaces up to a positive multiple of a row."""
    return data + b" " * (-len(data) % ROW or (0 if data else ROW))


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def _filtered(a: np.ndarray, kind: int) -> np.ndarray:
    """Rows of bytes after filter 0 (none), 1 (sub) or 2 (up)."""
    if kind == 1:
        return np.concatenate([a[:, :3], a[:, 3:] - a[:, :-3]], 1)
    if kind == 2:
        return np.concatenate([a[:1], a[1:] - a[:-1]])
    return a


def encode_png(payload: bytes) -> bytes:
    """An 8-bit RGB image of the payload; of the filters none, sub and up, the one whose first rows compress best."""
    a = np.frombuffer(payload, np.uint8).reshape(-1, ROW)
    sizes = [len(zlib.compress(_filtered(a[:TRY], k).tobytes(), 1)) for k in (0, 1, 2)] if len(a) >= TRY else [0, 1, 1]
    kind = int(np.argmin(sizes))
    lines = np.empty((len(a), ROW + 1), np.uint8)
    lines[:, 0] = kind
    lines[:, 1:] = _filtered(a, kind)
    head = struct.pack(">IIBBBBB", WIDTH, len(a), 8, 2, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines, LEVEL)) + _chunk(b"IEND", b"")


def _unfilter(lines: np.ndarray, channels: int) -> np.ndarray:
    """Bytes of the rows from filtered lines. Runs of one filter are undone together: none and sub need no other row,
    up is a running sum over its run; average and Paeth go byte by byte of a pixel, as they need each other."""
    kinds, out = lines[:, 0], lines[:, 1:].copy()
    n, width = out.shape
    if n and kinds.max() > 4:
        raise ValueError("unknown filter")
    starts = np.flatnonzero(np.diff(kinds, prepend=255 if n else [])) if n else []
    for a, b in zip(starts, [*starts[1:], n], strict=True):
        kind = kinds[a]
        if kind == 1:
            out[a:b] = np.cumsum(out[a:b].reshape(b - a, -1, channels), 1, dtype=np.uint8).reshape(b - a, width)
        elif kind == 2:
            first = out[a - 1] if a else np.zeros(width, np.uint8)
            out[a:b] = np.cumsum(out[a:b], 0, dtype=np.uint8) + first
        elif kind >= 3:
            for r in range(a, b):
                up = (out[r - 1] if r else np.zeros(width, np.uint8)).astype(int).tolist()
                line = out[r].tolist()
                for i in range(width):
                    left, corner = (line[i - channels], up[i - channels]) if i >= channels else (0, 0)
                    if kind == 3:
                        guess = (left + up[i]) // 2
                    else:
                        p = left + up[i] - corner
                        near = (abs(p - left), abs(p - up[i]), abs(p - corner))
                        guess = (left, up[i], corner)[near.index(min(near))]
                    line[i] = (line[i] + guess) & 255
                out[r] = line
    return out


def decode_png(png: bytes) -> tuple[bytes, int, int]:
    """Samples, width and channels of an 8-bit PNG without interlace; every chunk's checksum is tested."""
    if png[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at, data, head = 8, [], None
    while True:
        if at + 12 > len(png):
            raise ValueError("the file ends before IEND")
        n, kind = struct.unpack_from(">I4s", png, at)
        body = png[at + 8 : at + 8 + n]
        if len(body) < n or zlib.crc32(png[at + 4 : at + 8 + n]) != struct.unpack_from(">I", png, at + 8 + n)[0]:
            raise ValueError(f"checksum of {kind!r} fails")
        at += 12 + n
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            data.append(body)
        elif kind == b"IEND":
            break
    if head is None or head[2] != 8 or head[6]:
        raise ValueError("only 8-bit images without interlace are read")
    width, height = head[:2]
    channels = {0: 1, 2: 3, 4: 2, 6: 4}[head[3]]
    raw = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8)
    if len(raw) != height * (width * channels + 1):
        raise ValueError("the image data have another size than the header says")
    return _unfilter(raw.reshape(height, -1), channels).tobytes(), width, channels


@cache
def _cosines() -> np.ndarray:
    i = np.arange(SIDE)
    return np.cos(np.pi * (2 * i[None, :] + 1) * np.arange(LOW)[:, None] / (2 * SIDE))


def low_frequency_hash(samples: bytes, width: int, channels: int) -> str:
    """16 hex digits: which of the 8 by 8 lowest cosine coefficients of the 32 by 32 grey image exceed their median.

    Rows and columns are averaged in 32 even parts (repeated, where there are fewer)."""
    a = np.frombuffer(samples, np.uint8).reshape(-1, width, channels)
    grey = a.sum(2, dtype=np.int64)

    def even(x: np.ndarray) -> np.ndarray:
        n = len(x)
        if n < SIDE:
            return x[np.arange(SIDE) * n // SIDE].astype(float)
        cuts = np.arange(SIDE) * n // SIDE
        return np.add.reduceat(x, cuts, 0) / np.diff(cuts, append=n)[:, None]

    small = even(even(grey).T).T / channels
    c = _cosines()
    low = np.round(c @ small @ c.T, 6).ravel()
    return f"{int.from_bytes(np.packbits(low > np.median(low)).tobytes(), 'big'):016x}"


def add_media(df: DataFrame, text: str = "text", out: str = "media") -> DataFrame:
    """Adds the PNG of each row's text (UTF-8, padded; null counts as empty) as a binary column, which replaces one of
    that name. Rows are not moved; repeated ones get equal images; an empty table stays empty."""
    df = df.drop(out)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            made = [encode_png(padded((t or "").encode())) for t in b.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(made, pa.binary())], [*b.schema.names, out])

    return mapped(df, batches, T.StructType([*df.schema.fields, T.StructField(out, T.BinaryType())]))


def read_media(df: DataFrame, media: str = "media", out: tuple[str, str] = ("payload", "feature")) -> DataFrame:
    """Adds what the stored bytes hold, payload and low-frequency hash; null media give nulls. A broken image fails."""
    df = df.drop(*out)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            got = [(None, None) if x is None else (p := decode_png(x), low_frequency_hash(*p)) for x in b.column(media).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([p and p[0] for p, _ in got], pa.binary()), pa.array([f for _, f in got], pa.string())], [*b.schema.names, *out])

    return mapped(df, batches, T.StructType([*df.schema.fields, T.StructField(out[0], T.BinaryType()), T.StructField(out[1], T.StringType())]))


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text as a stored image, read back: sizes, digests and the low-frequency hash."""
    docs = read_table(spark, sf_dir, "documents")
    d = add_media(docs.select("doc_id", text_or_empty(docs).alias("text"))).select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "media")
    d = read_media(d)
    return d.select(
        "doc_id", "n_bytes", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -16, 16)).alias("tail_crc32"), F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "feature",
    )


QUERIES = {"op8_media": op8_media}
ORACLES: dict[str, str] = {}

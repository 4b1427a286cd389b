from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gridlark.llm import media as M

SMALL = "/root/testdata/sf0.001"


@settings(max_examples=80, deadline=None)
@given(st.binary(max_size=2000) | st.binary(max_size=60).map(lambda b: b * 400))
def test_round_trip(data):
    p = M.padded(data)
    assert len(p) % 192 == 0 and len(p) >= 192 and p.startswith(data) and not p[len(data) :].strip(b" ")
    png = M.encode_png(p)
    got, width, channels = M.decode_png(png)
    assert (got, width, channels) == (p, 64, 3) and len(M.low_frequency_hash(got, width, channels)) == 16


def other_encoder(a: np.ndarray, kinds: list[int], channels: int) -> bytes:
    """Filters byte by byte, each row with its own filter."""
    h, w = a.shape
    lines = bytearray()
    for r in range(h):
        lines.append(kinds[r])
        for i in range(w):
            left = int(a[r, i - channels]) if i >= channels else 0
            up = int(a[r - 1, i]) if r else 0
            corner = int(a[r - 1, i - channels]) if r and i >= channels else 0
            p = left + up - corner
            paeth = min((abs(p - left), 0, left), (abs(p - up), 1, up), (abs(p - corner), 2, corner))[2]
            lines.append((int(a[r, i]) - (0, left, up, (left + up) // 2, paeth)[kinds[r]]) % 256)
    kind = {1: 0, 2: 4, 3: 2, 4: 6}[channels]
    z = zlib.compress(bytes(lines))
    return M.SIGNATURE + M._chunk(b"IHDR", struct.pack(">IIBBBBB", w // channels, h, 8, kind, 0, 0, 0)) + M._chunk(b"tEXt", b"a\0b") + M._chunk(b"IDAT", z[:20]) + M._chunk(b"IDAT", z[20:]) + M._chunk(b"IEND", b"")


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 4), st.lists(st.integers(0, 4), min_size=1, max_size=9), st.integers(0, 2**31))
def test_all_filters_are_read(channels, kinds, seed):
    a = np.random.default_rng(seed).integers(0, 256, (len(kinds), 5 * channels), dtype=np.uint8)
    assert M.decode_png(other_encoder(a, kinds, channels)) == (a.tobytes(), 5, channels)


def test_broken_files_fail():
    png = bytearray(M.encode_png(M.padded(b"some text")))
    for at in (0, 20, len(png) // 2, len(png) - 2):
        bad = bytearray(png)
        bad[at] ^= 1
        with pytest.raises(ValueError):
            M.decode_png(bytes(bad))
    with pytest.raises(ValueError):
        M.decode_png(bytes(png[:-12]))


def test_near_images_have_near_hashes():
    rng = np.random.default_rng(0)
    y, x = np.mgrid[:64, :64]
    base = np.clip(128 + 60 * np.sin(x / 9) + 50 * np.cos(y / 13) + 20 * np.sin(x * y / 400), 0, 255)
    h = [int(M.low_frequency_hash(np.repeat(np.clip(base + rng.normal(0, s, base.shape), 0, 255).astype(np.uint8)[..., None], 3, 2).tobytes(), 64, 3), 16) for s in (0, 3)]
    other = int(M.low_frequency_hash(rng.integers(0, 256, (64, 64, 3), dtype=np.uint8).tobytes(), 64, 3), 16)
    assert (h[0] ^ h[1]).bit_count() <= 6 < (h[0] ^ other).bit_count()


def test_hash_equals_direct_transform():
    a = np.random.default_rng(2).integers(0, 256, (32, 32, 1), dtype=np.uint8)
    low = np.array([[sum(float(a[r, c, 0]) * np.cos(np.pi * (2 * r + 1) * u / 64) * np.cos(np.pi * (2 * c + 1) * v / 64) for r in range(32) for c in range(32)) for v in range(8)] for u in range(8)]).ravel()
    want = int("".join("01"[int(x > np.median(low))] for x in low), 2)
    assert int(M.low_frequency_hash(a.tobytes(), 32, 1), 16) == want


def test_query(spark, duck):
    got = {r["doc_id"]: r for r in M.op8_media(spark, SMALL).collect()}
    docs = duck.sql("SELECT doc_id, text FROM documents").fetchall()
    assert len(got) == len(docs)
    for k, t in docs:
        r, p = got[k], M.padded((t or "").encode())
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len((t or "").encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]))
        png = M.encode_png(p)
        assert (r["media_bytes"], r["media_sha256"], r["feature"]) == (len(png), hashlib.sha256(png).hexdigest(), M.low_frequency_hash(p, 64, 3))


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (2, "", "x"), (None, "é" * 500_000, None)], "doc_id long, text string, media string")
    out = M.read_media(M.add_media(df))
    got = [(r["doc_id"], bytes(r["payload"]), r["feature"]) for r in out.collect()]
    assert got[0][1] == got[1][1] == got[2][1] == b" " * 192 and got[0][2] == got[1][2]
    assert got[3][1].decode().rstrip() == "é" * 500_000
    assert M.read_media(M.add_media(df.limit(0))).count() == 0
    assert M.read_media(spark.createDataFrame([(1, None)], "doc_id long, media binary")).first()["payload"] is None

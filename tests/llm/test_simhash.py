from __future__ import annotations

import random

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from gridlark.llm import simhash as S
from gridlark.llm.bktree import build, components, pairs_within

SMALL = "/root/testdata/sf0.001"


def brute_fingerprint(text: str) -> int:
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    words, w = [], ""
    for c in low + " ":
        if c in " \t\n\x0b\x0c\r":
            words += [w] if w else []
            w = ""
        else:
            w += c
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(rows: list[tuple], radius: int = 2) -> dict:
    fp = {}
    for k, f in rows:
        fp.setdefault(f, []).append(k)
    names, root = list(fp), {f: f for f in fp}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for i, a in enumerate(names):
        for b in names[:i]:
            if (a ^ b).bit_count() <= radius:
                root[find(a)] = find(b)
    least = {}
    for f, ks in fp.items():
        r = find(f)
        own = [k for k in ks if k is not None]
        least[r] = min([*own, *([least[r]] if least.get(r) is not None else [])], default=None)
    return {f: least[find(f)] for f in fp}


@given(st.lists(st.sampled_from(["A", "b", "É", "word", " ", "  ", "\n", "\t", " ", "x y z", "\x1c"]), max_size=20).map("".join))
def test_fingerprints_equal_brute_force(text):
    assert S.fingerprint(text) == brute_fingerprint(text)


def test_spark_hash_is_the_same(spark):
    got = spark.createDataFrame([("a b c",), ("é ü ß",)], "s string").selectExpr("s", "xxhash64(s) as h").collect()
    assert all(r["h"] % 2**64 == xxhash.xxh64_intdigest(r["s"].encode(), seed=42) for r in got)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 2**64 - 1) | st.integers(0, 255)), max_size=60, unique=True), st.integers(0, 4))
def test_trees_find_all_pairs(points, radius):
    points.sort()
    tree, p = np.array([x[0] for x in points], np.int64), np.array([x[1] for x in points], np.uint64)
    got = {(int(i), int(j)) for a, b in pairs_within(p, tree, radius, block=7) for i, j in zip(a, b, strict=True)}
    assert got == {(i, j) for j in range(len(p)) for i in range(j) if tree[i] == tree[j] and (int(p[i]) ^ int(p[j])).bit_count() <= radius}


def test_children_are_keyed_by_distance():
    p = np.random.default_rng(1).integers(0, 2**63, 200, dtype=np.uint64)
    parent, key, level = build(p, np.zeros(200, int))
    kids = [(a, k) for a, k in zip(parent.tolist(), key.tolist(), strict=True) if a >= 0]
    assert len(kids) == len(set(kids)) == 199 and level.max() < 40
    assert all((int(p[i]) ^ int(p[a])).bit_count() == key[i] for i, a in enumerate(parent.tolist()) if a >= 0)


def test_components_are_least_indices():
    assert components(5, [(np.array([3, 1]), np.array([4, 3]))]).tolist() == [0, 1, 2, 1, 1]


def linked(spark, fps: list[int]) -> dict[int, int]:
    signed = [f - 2**64 if f >> 63 else f for f in fps]
    sets = S.linked_sets(S.links(spark.createDataFrame([(f,) for f in signed], "fp long")))
    return {r["fp"] % 2**64: r["root"] % 2**64 for r in sets.collect()}


def test_links_hold_sets_together(spark, monkeypatch):
    """Chains, dense clusters and noise, with shards so small a limit that they are split again."""
    rng = random.Random(3)
    fps = {rng.getrandbits(64) for _ in range(300)}
    for _ in range(6):
        f = rng.getrandbits(64)
        for _ in range(40):
            f ^= 1 << rng.randrange(64) | 1 << rng.randrange(64)
            fps.add(f)
    centre = rng.getrandbits(64)
    fps |= {centre ^ 1 << i for i in range(64)} | {centre ^ 1 << i ^ 1 << j for i in range(0, 64, 3) for j in range(i)}
    fps = sorted(fps)
    want = brute_components([(f, f) for f in fps])
    for limit in (2000, 20):
        monkeypatch.setattr(S, "LARGE_SHARD", limit)
        root = linked(spark, fps)
        groups: dict = {}
        for f in fps:
            groups.setdefault(root.get(f, f), set()).add(want[f])
        assert all(len(g) == 1 for g in groups.values())
        assert len(groups) == len(set(want.values()))


def test_query(spark, duck):
    docs = duck.sql("SELECT doc_id, text FROM documents").fetchall()
    fp = {k: brute_fingerprint(t or "") for k, t in docs}
    want = brute_components(list(fp.items()))
    got = S.op7_simhash(spark, SMALL).collect()
    assert len(got) == len(docs)
    for r in got:
        assert r["fingerprint"] == f"{fp[r['doc_id']]:016x}" and r["component_id"] == want[fp[r["doc_id"]]]


ODD = [(5, None), (7, ""), (7, ""), (9, " \n"), (None, "a b c d"), (3, "a b c d"), (4, "A B C D"), (8, "q " * 60_000), (None, "alone here"), (12, "one")]


def test_odd_rows(spark):
    df = spark.createDataFrame([(k, t, "x", 1) for k, t in ODD], "doc_id long, text string, fp string, component_id int")
    got = sorted(((r["doc_id"], r["component_id"]) for r in S.near_duplicates(df).collect()), key=str)
    assert got == sorted([(5, 5), (7, 5), (7, 5), (9, 5), (None, 3), (3, 3), (4, 3), (8, 8), (None, None), (12, 12)], key=str)
    assert S.near_duplicates(df.limit(0)).count() == 0


def test_large_shards_are_split_until_small(spark, monkeypatch):
    """Fingerprints that agree on most bits: no shard stays over the limit, and no pair within the radius is parted."""
    monkeypatch.setattr(S, "LARGE_SHARD", 16)
    rng = random.Random(8)
    fps = sorted({rng.getrandbits(9) << 3 | 0x5A5A000000000000 >> 1 for _ in range(200)})
    rows = S.shards(spark.createDataFrame([(f,) for f in fps], "fp long")).collect()
    by: dict = {}
    for r in rows:
        by.setdefault(r["shard"], set()).add(r["fp"])
    assert max(map(len, by.values())) <= 16
    together = {(a, b) for own in by.values() for a in own for b in own if a < b}
    assert {(a, b) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 2} <= together


def test_sets_that_are_not_settled_are_an_error(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(30)], "fp long, to long")
    assert {r["root"] for r in S.linked_sets(chain).collect()} == {0}
    with pytest.raises(RuntimeError):
        S.linked_sets(chain, rounds=1)

from __future__ import annotations

import random
import struct
import zlib
from itertools import combinations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gridlark.llm import packing as P
from gridlark.llm.tokens import encoder, tokenizer

SMALL = "/root/testdata/sf0.001"


def true_ids(text: str) -> list[int]:
    return tokenizer(P.vocabulary()).encode(text, add_special_tokens=False).ids


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["a", "B", "é", " ", "  ", "\n", "\n\n", "\t", "1", "²", "_", "'s", "!", "...", "ß", "<|endoftext|>", "😀", " ", "\x1c", "word", " the", "ª", " ", "—", "’", "\r\n"]), max_size=14).map("".join))
def test_ids_equal_the_tokenizer(text):
    assert encoder(P.vocabulary())(text) == struct.pack(f"<{len(true_ids(text))}I", *true_ids(text))


def exact_bins(items: list[int], capacity: int) -> int:
    """The least number of bins, by search."""
    items = sorted(items, reverse=True)
    best = len(items)

    def go(i: int, bins: list[int]) -> None:
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(items):
            best = len(bins)
            return
        seen = set()
        for k, b in enumerate(bins):
            if b + items[i] <= capacity and b not in seen:
                seen.add(b)
                bins[k] += items[i]
                go(i + 1, bins)
                bins[k] -= items[i]
        bins.append(items[i])
        go(i + 1, bins)
        bins.pop()

    go(0, [])
    return best


def counted(items: list[int]) -> dict[int, int]:
    return {s: items.count(s) for s in set(items)}


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=9))
def test_dominance_keeps_an_optimum(items):
    """Fixed sets plus an optimal packing of the rest is an optimal packing of all."""
    fixed, rest = P.reduce_instance(counted(items), 20)
    left = [s for s, n in rest.items() for _ in range(n)]
    assert sum(p.many for p in fixed) + (exact_bins(left, 20) if left else 0) == exact_bins(items, 20)


@given(st.dictionaries(st.integers(1, 50), st.integers(1, 400), max_size=12))
def test_patterns_hold_all_pieces(counts):
    patterns = P.solve(counts, 50)
    used: dict[int, int] = {}
    for p in patterns:
        assert p.many > 0 and sum(s * n for s, n in p.items) <= 50
        for s, n in p.items:
            used[s] = used.get(s, 0) + n * p.many
    assert used == counts
    bins, floor = sum(p.many for p in patterns), -(-sum(s * n for s, n in counts.items()) // 50)
    assert bins <= 2 * floor + 1  # best fit never leaves two sequences half empty


def check(rows: list, texts: list[tuple], capacity: int) -> None:
    """Brute force: pieces and their checksums from the tokenizer, sequences gapless and within the capacity."""
    want = []
    for doc_id, text in texts:
        ids = true_ids(text or "") + [P.END]
        n = len(ids)
        cuts = [0, n] if n <= capacity else [0, *range(n % capacity or capacity, n + 1, capacity)]
        for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            want.append((doc_id, i, a, b - a, zlib.crc32(struct.pack(f"<{b - a}I", *ids[a:b]))))
    key = lambda x: tuple((v is None, v) for v in x)
    assert sorted((tuple(r)[:5] for r in rows), key=key) == sorted(want, key=key)
    by: dict[int, list] = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for spans in by.values():
        at = 0
        for o, n in sorted(spans):
            assert o == at
            at += n
        assert at <= capacity


def test_query(spark, duck):
    rows = P.op10_packing(spark, SMALL).collect()
    check(rows, duck.sql("SELECT doc_id, text FROM documents").fetchall(), P.CAPACITY)
    assert len({r["sequence_id"] for r in rows}) <= 1.01 * sum(r["length"] for r in rows) / P.CAPACITY + 1


@pytest.mark.parametrize("capacity", [8, 64])
def test_odd_rows(spark, capacity):
    rng = random.Random(capacity)
    rows = [(1, None, 0), (1, None, 0), (2, "", 1), (None, "word " * 40, 2), (3, "a b c " * 3000, 3), (4, "x", 4), (4, "x", 4)]
    rows += [(i, "word " * rng.randint(0, 20), i) for i in range(10, 150)]
    df = spark.createDataFrame(rows, "doc_id long, text string, length long")
    check(P.pack(df, P.vocabulary(), capacity=capacity).collect(), [(r[0], r[1]) for r in rows], capacity)
    assert P.pack(df.limit(0), P.vocabulary()).count() == 0


def test_hot_length_has_no_gap(spark):
    df = spark.createDataFrame([(i, "same text") for i in range(5000)], "doc_id long, text string")
    check(P.pack(df, P.vocabulary(), capacity=16).collect(), [(i, "same text") for i in range(5000)], 16)


def test_pairs_that_fill_are_fixed():
    fixed, rest = P.reduce_instance({70: 3, 30: 5, 10: 1}, 100)
    assert [(p.many, p.items) for p in fixed][0] == (3, [(70, 1), (30, 1)])
    assert sum(p.many for p in fixed) + sum(p.many for p in P.best_fit(rest, 100)) == 4
    assert all(a != b for a, b in combinations(range(3), 2))

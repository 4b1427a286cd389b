from __future__ import annotations

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gridlark.llm import topk as K

SMALL = "/root/testdata/sf0.001"


def test_query_equals_sql(same):
    same(K.op4_topk, K.ORACLES["op4_topk"])


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 300), st.integers(1, 6), st.integers(1, 4), st.integers(0, 2**31))
def test_search_equals_brute_force(n, dims, spread, seed):
    """Small values make many ties; the first round takes few entries, so the bound decides."""
    rng = np.random.default_rng(seed)
    m = rng.integers(-spread, spread + 1, (n, dims)).astype(float)
    keys = rng.permutation(n)
    q, own = m[: min(n, 5)], np.arange(min(n, 5))
    half = n // 2
    for cuts in ([(0, n)], [(0, half), (half, n)]):
        found = None
        for a, b in cuts:  # over several blocks each query takes its best along
            if b > a:
                here = np.where((own >= a) & (own < b), own - a, -1)
                found = K.threshold_search(q, here, K.Lists(a, keys[a:b], m[a:b]), 3, found)
        for i, (best, scores) in enumerate(found):
            want = sorted(((-int(m[r] @ q[i]), int(keys[r])) for r in range(n) if r != i))[:3]
            assert [(-int(s), int(x)) for x, s in zip(best, scores, strict=True)] == want


def test_search_stops_early(monkeypatch):
    monkeypatch.setattr(K, "FIRST", 4)
    m = np.zeros((5000, 3))
    m[:10] = 100
    m[:, 0] += np.arange(5000) % 7
    lists = K.Lists(0, np.arange(5000), m)
    ((best, scores),) = K.threshold_search(np.array([[1.0, 1.0, 1.0]]), np.array([-1]), lists, 5)
    assert len(best) == 5 and scores.min() >= 300
    asked = []

    class Order(np.ndarray):
        def __getitem__(self, k):
            asked.append(k[1].stop)
            return np.asarray(self)[k]

    lists.order = lists.order.view(Order)
    K.threshold_search(np.array([[1.0, 1.0, 1.0]]), np.array([-1]), lists, 5)
    assert max(n for n in asked if n is not None) <= 5000 and len(asked) < 12


def brute(rows, every=50, k=5):
    ok = [(key, [math.floor(256 * x) for x in v]) for key, v in rows if key is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, (key, v) in enumerate(ok):
        if key % every == 0:
            found = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), other) for j, (other, w) in enumerate(ok) if j != i)
            out += [(key, r + 1, other, -s) for r, (s, other) in enumerate(found[:k])]
    return sorted(out)


def test_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(K, "BLOCK", 7)
    monkeypatch.setattr(K, "QUERIES_A_BLOCK", 2)
    monkeypatch.setattr(K, "BLOCKS_A_GROUP", 3)
    rng = np.random.default_rng(5)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=3)]) for i in range(160)]
    rows += [(200, None), (250, [1.0, None, 2.0]), (300, [1.0, math.nan, 0.0]), (350, [math.inf, 0.0, 0.0]), (None, [1.0, 1.0, 1.0]), (400, [0.5]), (450, []), (0, rows[0][1]), (50, rows[50][1]), (51, rows[51][1])]
    df = spark.createDataFrame([(k, v, "x", 1) for k, v in rows], "vec_id long, embedding array<float>, score string, rank int").repartition(5)
    assert sorted(map(tuple, K.top_k(df).collect())) == brute(rows)
    assert K.top_k(df.limit(0)).count() == 0
    assert sorted(map(tuple, K.top_k(df.filter("vec_id in (0, 1)").dropDuplicates(["vec_id"])).collect())) == brute(rows[:2])


def test_large_components_stay_exact(spark):
    rows = [(0, [90000.5, -3.25, 1.0]), (1, [70001.25, 5.5, 2.0]), (2, [-80000.0, 1.0, 0.0]), (3, [90000.5, -3.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(map(tuple, K.top_k(df).collect())) == brute(rows)


def test_any_finite_component_takes_part(spark):
    """Components far beyond 2 ** 53, zeros and small ones in one table: exact scores, ties by key."""
    rows = [(0, [3.0e5, -(2.0**28), 1.0]), (50, [0.25, 0.0, -1.0]), (100, [0.0, 0.0, 0.0])]
    rows += [(i, [float(2**20 + i), float(-(2**10) * i), 0.5]) for i in range(1, 30)] + [(i, [i / 64, -i / 32, 1.0]) for i in range(31, 45)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    assert sorted(map(tuple, K.top_k(df).collect())) == brute(rows)


def test_a_score_beyond_a_long_is_an_error(spark):
    df = spark.createDataFrame([(0, [2.0**40]), (1, [2.0**30])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="score of 0 and 1 does not fit a long"):
        K.top_k(df).collect()


def test_blocks_of_queries_are_full_and_candidates_are_sent_once(spark, monkeypatch):
    monkeypatch.setattr(K, "BLOCK", 100)
    monkeypatch.setattr(K, "QUERIES_A_BLOCK", 16)
    seen = []
    own = K.units
    monkeypatch.setattr(K, "units", lambda q, b: seen.append((q.count(), b.count(), own(q, b))) or seen[-1][2])
    rng = np.random.default_rng(2)
    df = spark.createDataFrame([(i, [float(x) for x in rng.normal(size=4)]) for i in range(2000)], "vec_id long, embedding array<double>").repartition(2)
    assert K.top_k(df).count() == 40 * 5
    (queries, candidates, sent), groups = seen[0], -(-seen[0][1] // K.BLOCKS_A_GROUP)
    assert queries <= 6 and 20 <= candidates <= 22
    assert sent.filter("q_rows IS NULL").count() == candidates and sent.filter("q_rows IS NOT NULL").count() == groups * queries

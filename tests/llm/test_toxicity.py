from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from gridlark.llm import toxicity as X
from gridlark.llm.boosting import Boosted

MIDDLE = "/root/testdata/sf0.01"


def test_trees_learn_and_calibrate():
    rng = np.random.default_rng(0)
    x = rng.random((4000, 5)) * (rng.random((4000, 5)) < 0.6)
    y = ((x[:, 0] > 0.4) & (x[:, 1] < 0.3) | (x[:, 2] > 0.9)).astype(float)
    m = Boosted().fit(x[:2000], y[:2000]).calibrate(x[2000:3000], y[2000:3000])
    s = m.score(x[3000:])
    assert ((s >= 0.5) == (y[3000:] > 0)).mean() > 0.95
    assert (np.diff(m.steps_y) >= 0).all() and s.min() >= 0 and s.max() <= 1


def test_one_class_or_none():
    x = np.zeros((10, 3))
    assert np.allclose(Boosted().fit(x, np.ones(10)).score(x), 0.999)
    assert len(Boosted().fit(np.zeros((0, 3)), np.zeros(0)).score(np.zeros((2, 3)))) == 2


def test_features_see_the_signs():
    f = X.Features({"=grumpf": 3.0, "4badl": 2.0})
    row = dict(zip(X.NAMES, f.row("You GRUMPF, badly 1d1ot!! you stuuupid"), strict=True))
    assert row["learned"] == 2 and row["learned_max"] == 3 and row["near_you"] >= 2 and row["obfuscated_insults"] == 2 and row["exclaims"] > 0 and row["shouted"] > 0
    assert np.allclose(f.row(""), 0)


def test_held_out_accuracy(spark, tmp_path):
    docs = spark.read.parquet(f"{MIDDLE}/documents.parquet")
    got = {r["doc_id"]: r for r in X.op9_toxicity(spark, MIDDLE).collect()}
    assert len(got) == docs.count()
    assert all(r["held_out"] == (zlib.crc32(str(k).encode()) % 4 == 2) and r["predicted"] == int(r["score"] >= 0.3) and 0 <= r["score"] <= 1 for k, r in got.items())
    labels = [(got[r["doc_id"]], r["toxic"]) for r in spark.read.parquet(f"{MIDDLE}/labels.parquet").collect() if r["doc_id"] in got]
    clean = [r for r, y in labels if y == 0]
    toxic = [r for r, y in labels if y == 1]
    assert sum(r["predicted"] for r in clean) <= 0.02 * len(clean)
    assert sum(r["predicted"] for r in toxic) >= 0.6 * len(toxic)


def test_held_out_labels_are_not_learned(spark):
    ids = [i for i in range(4000) if zlib.crc32(str(i).encode()) % 4 == 2][:200]
    docs = spark.createDataFrame([(i, "zorgle text here") for i in ids], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i in ids], "doc_id long, toxic int")
    assert not X.fit(docs, labels).lexicon


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, "s"), (2, "", "s"), (2, "", "s"), (None, "you idiot " * 3, "s"), (3, "word " * 100_000, "s")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (2, None, 1), (None, 1, 1), (9, 1, 1)], "doc_id long, toxic int, quality int")
    m = X.fit(docs, labels)
    out = X.score(docs, m)
    assert sorted(out.columns) == ["doc_id", "score", "text"] and out.count() == 5
    assert all(0 <= r["score"] <= 1 for r in out.collect())
    assert X.score(docs.limit(0), m).count() == 0
    assert X.fit(docs.limit(0), labels.limit(0)).lexicon == {}


def brute_tree(x, g, h, depth, least, ridge, edges):
    """One tree by trying every feature and edge in plain Python: a function from a row to its value, and whether two
    different splits were as good as each other anywhere, so that the tree is not unique."""
    rows, ties = list(range(len(x))), []

    def grow(own, level):
        gs, hs = sum(g[i] for i in own), sum(h[i] for i in own)
        leaf = gs / (hs + ridge)
        if level == depth:
            return lambda r: leaf
        best, parted = (1e-9, None, None), None
        for f in range(len(x[0])):
            for e in edges[f]:
                left = [i for i in own if x[i][f] < e]
                if len(left) < least or len(own) - len(left) < least:
                    continue
                gl, hl = sum(g[i] for i in left), sum(h[i] for i in left)
                gain = gl**2 / (hl + ridge) + (gs - gl) ** 2 / (hs - hl + ridge) - gs**2 / (hs + ridge)
                if best[1] is not None and abs(gain - best[0]) < 1e-9 and left != parted:
                    ties.append(e)
                if gain > best[0] + 1e-12:
                    best, parted = (gain, f, e), left
        if best[1] is None:
            return lambda r: leaf
        _, f, e = best
        a, b = grow([i for i in own if x[i][f] < e], level + 1), grow([i for i in own if x[i][f] >= e], level + 1)
        return lambda r: a(r) if r[f] < e else b(r)

    return grow(rows, 0), bool(ties)


@settings(max_examples=15, deadline=None)
@given(st.integers(0, 2**31))
def test_boosting_equals_brute_force(seed):
    rng = np.random.default_rng(seed)
    x = np.round(rng.random((60, 3)) * (rng.random((60, 3)) < 0.7), 3)
    y = (x[:, 0] + 0.3 * rng.random(60) > 0.5).astype(float)
    if len(set(y)) < 2:
        return
    m = Boosted(trees=4, depth=2).fit(x, y)
    f = np.full(60, np.log(y.mean() / (1 - y.mean())))
    assert np.allclose(m.base, f[0])
    for _ in range(4):
        p = 1 / (1 + np.exp(-f))
        tree, ties = brute_tree(x.tolist(), (y - p).tolist(), np.maximum(p * (1 - p), 1e-6).tolist(), 2, m.least, m.ridge, [e.tolist() for e in m.edges])
        if ties:
            return
        f = f + m.rate * np.array([tree(r) for r in x.tolist()])
    assert np.allclose(m.raw(x), f, atol=1e-6)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 6), st.integers(0, 1)), min_size=1, max_size=25))
def test_calibration_equals_brute_force(rows):
    """Isotonic regression as the largest least mean: max over starts of min over ends of the mean of y, on the sums per
    score; then each pool's mean with the pseudo-count."""
    m = Boosted()
    m.raw = lambda x: x[:, 0].astype(float)
    x, y = np.array([[a] for a, _ in rows], float), np.array([b for _, b in rows], float)
    m.calibrate(x, y)
    values = sorted({a for a, _ in rows})
    total = [sum(b for a, b in rows if a == v) for v in values]
    many = [sum(1 for a, _ in rows if a == v) for v in values]
    fit = [max(min(sum(total[a : b + 1]) / sum(many[a : b + 1]) for b in range(i, len(values))) for a in range(i + 1)) for i in range(len(values))]
    for v, z in zip(values, fit, strict=True):
        pool = [i for i, w in enumerate(fit) if abs(w - z) < 1e-12]
        want = (sum(total[i] for i in pool) + y.mean()) / (sum(many[i] for i in pool) + 1)
        got = float(np.interp(v, m.steps_x, m.steps_y))
        # Equal neighbouring means may be pooled or not; the steps never fall and stay between the neighbours.
        assert abs(got - want) < 0.35 and 0 <= got <= 1
    assert (np.diff(m.steps_y) >= -1e-12).all()
    if len(set(fit)) == len(fit):
        assert np.allclose([np.interp(v, m.steps_x, m.steps_y) for v in values], np.maximum.accumulate([(t + y.mean()) / (n + 1) for t, n in zip(total, many, strict=True)]))


def test_lexicon_equals_brute_force(spark):
    """Counted by hand over the labelled rows, with the statistic written out."""
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{MIDDLE}/documents.parquet").collect()}
    rows = [(docs[r["doc_id"]], r["toxic"]) for r in spark.read.parquet(f"{MIDDLE}/labels.parquet").collect() if r["doc_id"] in docs and r["toxic"] is not None]
    got = X.learn_lexicon(spark.createDataFrame(rows, "text string, toxic int").repartition(3))
    nt = sum(y for _, y in rows)
    nc = len(rows) - nt
    a, b = Counter(), Counter()
    for t, y in rows:
        found = set()
        for w in t.lower().split():
            w = w.strip(X.EDGE)
            if len(w) > 2:
                found |= {"=" + w} | {f"{n}{w[:n]}" for n in (4, 5, 6, 7, 8) if len(w) >= n}
        (a if y else b).update(found)
    often = [e for e in a.keys() | b.keys() if a[e] + b[e] >= 4]
    want = {}
    for e in often:
        n, share = a[e] + b[e], nt / (nt + nc)
        g2 = 2 * sum(o * math.log(o / w) for o, w in ((a[e], n * share), (b[e], n * (1 - share))) if o)
        odds = ((a[e] + 0.5) / (nt + 1)) / ((b[e] + 0.5) / (nc + 1))
        if a[e] >= 4 and g2 >= 2 * math.log(len(often)) and odds >= 8:
            want[e] = math.log(odds)
    assert got.keys() == want.keys() and all(abs(got[e] - w) < 1e-9 for e, w in want.items()) and len(want) > 10
    assert len(X.learn_lexicon(spark.createDataFrame(rows, "text string, toxic int"), 5)) == 5

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from gridlark.llm import neardup as N

SMALL = "/root/testdata/sf0.001"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def words_of(text: str) -> list[str]:
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    for c in "\t\n\x0b\x0c\r":
        low = low.replace(c, " ")
    return [w for w in low.split(" ") if w]


def shingles(text: str) -> frozenset:
    w = words_of(text)
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def alike(a: frozenset, b: frozenset) -> bool:
    return 5 * len(a & b) >= 4 * len(a | b)


def brute_groups(texts: list[str]) -> list[int]:
    """The number of each text's group: over all pairs of texts that can be alike by their sizes."""
    sets = [shingles(t) for t in texts]
    order, root = sorted(range(len(sets)), key=lambda i: len(sets[i])), list(range(len(sets)))

    def find(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    for x, i in enumerate(order):
        for j in order[x + 1 :]:
            if 4 * len(sets[j]) > 5 * len(sets[i]):
                break
            if find(i) != find(j) and alike(sets[i], sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(sets))]


def edited(rng: random.Random, n: int = 60, dense: int = 60, vocabulary: int = 5000) -> list[str]:
    """Texts, chains of edited copies, and one dense group of copies with few and many edits."""
    word = lambda: f"w{rng.randrange(vocabulary)}"
    texts = []
    for _ in range(n):
        words = [word() for _ in range(rng.randrange(60, 300))]
        texts.append(" ".join(words))
        for _ in range(rng.randrange(4)):
            words = list(words)
            for _ in range(rng.randrange(1, 7)):
                words[rng.randrange(len(words))] = word()
            texts.append(" ".join(words))
    base = [word() for _ in range(200)]
    for _ in range(dense):
        copy = list(base)
        for _ in range(rng.choice((1, 1, 2, 4, 6))):
            copy[rng.randrange(200)] = word()
        texts.append(" ".join(copy))
    rng.shuffle(texts)
    return texts


def frame(spark, rows: list[tuple]):
    return spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in rows], COLUMNS)


def kept(spark, rows: list[tuple]) -> list:
    return sorted((tuple(r)[:2] for r in N.one_of_each(spark, frame(spark, rows), SMALL).collect()), key=str)


def test_edited_copies_go(spark):
    """Those of 0.8 and more go, those below stay: against brute force over all pairs."""
    texts = edited(random.Random(5))
    group = brute_groups(texts)
    want = [i for i in range(len(texts)) if group[i] == i]
    assert len(want) < len(texts) - 60
    assert [k for k, _ in sorted(kept(spark, list(enumerate(texts))))] == want


def test_shards_cut_in_parts_lose_no_link(spark, monkeypatch):
    """A limit so small that shards are cut, with roots that fill parts of their own; and many tasks for one set."""
    monkeypatch.setattr(N, "PART", 6000)
    monkeypatch.setattr(N, "TOGETHER", 7)
    texts = edited(random.Random(6), 10, 150)
    group = brute_groups(texts)
    assert [k for k, _ in sorted(kept(spark, list(enumerate(texts))))] == [i for i in range(len(texts)) if group[i] == i]


def test_shared_doc_ids_are_documents_of_their_own(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    assert kept(spark, [(3, a), (5, a), (5, b)]) == [(3, a), (5, b)]
    assert kept(spark, [(5, a), (5, b), (5, c), (5, c)]) == [(5, a), (5, b), (5, c)]


def test_rows_without_doc_id_are_documents(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(30)) for x in "ab")
    assert kept(spark, [(None, a), (7, a), (None, b), (None, b)]) == [(7, a), (None, b)]


def test_odd_rows(spark):
    rows = [(5, None), (7, ""), (7, ""), (9, " \n"), (None, "a b c d"), (3, "a b c d"), (4, "A B C D"), (8, "q " * 60_000), (None, "alone here"), (12, "one")]
    out = kept(spark, rows)
    assert sorted((k for k, _ in out), key=str) == sorted([5, 3, 8, None, 12], key=str)
    d = frame(spark, rows)
    assert N.one_of_each(spark, d, SMALL).columns == d.columns and N.one_of_each(spark, d.limit(0), SMALL).count() == 0


def test_small_documents_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").orderBy("doc_id").collect()
    group = brute_groups([r["text"] or "" for r in docs])
    got = {r["doc_id"] for r in N.one_of_each(spark, spark.read.parquet(f"{SMALL}/documents.parquet"), SMALL).collect()}
    assert got == {docs[g]["doc_id"] for g in set(group)}


@given(st.lists(st.sampled_from(["a", "B", "É", "word", " ", "  ", "\n", "\t", "\x0b", "x y z", "\x1c", "\xa0", "ß"]), max_size=40).map("".join))
def test_shingle_sets_are_as_large_as_brute_force(text):
    assert len(N.shingle_set(text, N.Words())) == len(shingles(text))


@settings(max_examples=50, deadline=None)
@given(st.lists(st.lists(st.integers(0, 40), min_size=1, max_size=30, unique=True), min_size=1, max_size=12))
def test_common_members_equal_brute_force(sets):
    got = N.common_members([np.array(sorted(s), np.uint64) for s in sets])
    assert got.tolist() == [[len(set(a) & set(b)) if set(a) & set(b) and (i != j) else got[i][j] for j, b in enumerate(sets)] for i, a in enumerate(sets)]
    assert all(got[i][j] == len(set(a) & set(b)) for i, a in enumerate(sets) for j, b in enumerate(sets) if i != j)


def test_columns_in_parts(monkeypatch):
    rng = random.Random(1)
    sets = [sorted(rng.sample(range(300), 100)) for _ in range(20)]
    monkeypatch.setattr(N, "COLUMNS", 64)
    got = N.common_members([np.array(s, np.uint64) for s in sets])
    assert all(got[i][j] == len(set(a) & set(b)) for i, a in enumerate(sets) for j, b in enumerate(sets) if i != j)


def test_candidates_reach_nearly_all_alike_pairs():
    """Recall of bands and radius together over pairs just above 0.8."""
    rng = np.random.default_rng(4)
    found = total = 0
    for _ in range(2000):
        n = int(rng.integers(10, 400))
        c = -(-8 * n // 9)  # of two sets of n, so many in common make 0.8
        pool = rng.integers(0, 2**64, 2 * n - c, np.uint64)
        a, b = np.sort(pool[:n]), np.sort(np.concatenate([pool[: c], pool[n:]]))
        keys = N.band_keys([a, b])
        near = (N.fingerprint(a) ^ N.fingerprint(b)) & 2**64 - 1
        found += bool((keys[0] == keys[1]).any()) and near.bit_count() <= N.RADIUS
        total += 1
    assert found >= 0.998 * total


def test_shards_are_of_fingerprint_bits():
    """Whether two sets share a shard is decided by their fingerprints alone, the first word of which the trees hold."""
    rng = np.random.default_rng(8)
    sets = [np.sort(rng.integers(0, 2**64, n, np.uint64)) for n in (1, 4, 5, 30, 600, 1300)]
    words = N.fingerprints(sets)
    assert [int(w) for w in words.view("<i8")[:, 0]] == [N.fingerprint(x) for x in sets]
    assert int(words[3, 0]) == sum(1 << p for p in range(64) if sum(int(h) >> p & 1 for h in sets[3]) > 15)
    keys = N.band_keys(sets)
    for t, places in enumerate(N.TABLES.tolist()):
        for i, w in enumerate(words.tolist()):
            assert keys[i, t] == t * 2**N.BITS + sum((w[p // 64] >> p % 64 & 1) << k for k, p in enumerate(places))


def test_candidates_equal_brute_force():
    """The trees find all near pairs of a unit that are of different roots, sides and like sizes."""
    rng = np.random.default_rng(9)
    m = 300
    base = rng.integers(0, 2**63, 20)
    flips = lambda: np.array([sum(1 << int(p) for p in rng.choice(63, rng.integers(0, 14), replace=False)) for _ in range(m)], np.int64)
    which = rng.integers(0, 20, m)
    fp, more = base[which] ^ flips(), base[which] ^ flips()
    unit = np.sort(rng.integers(0, 6, m))
    side = np.where(unit == 2, rng.integers(1, 3, m), 0)
    ids, root, n = rng.permutation(m), rng.integers(0, 9, m), rng.integers(80, 120, m)
    near = lambda i, j: unit[i] == unit[j] and root[i] != root[j] and (side[i] != side[j] or not side[i]) and 5 * min(n[i], n[j]) >= 4 * max(n[i], n[j]) and int(fp[i] ^ fp[j]).bit_count() <= N.RADIUS and int(fp[i] ^ fp[j]).bit_count() + int(more[i] ^ more[j]).bit_count() <= N.RADIUS_2
    first = {int(np.flatnonzero(unit == u)[0]) for u in set(unit.tolist())}
    for stars in (False, True):
        got = N.candidates(unit, side, ids, root, n, fp, more, stars)
        want = {(int(min(ids[i], ids[j])), int(max(ids[i], ids[j]))) for j in range(m) for i in range(j) if near(i, j) and (not stars or i in first)}
        assert len(want) > 5 and set(zip(*(x.tolist() for x in got), strict=True)) == want


def test_alike_pairs_of_many_and_few():
    rng = random.Random(3)
    sets = [np.array(sorted(rng.sample(range(24), 20)), np.uint64) for _ in range(30)]
    i, j = np.triu_indices(30, 1)
    want = [5 * len(set(sets[a].tolist()) & set(sets[b].tolist())) >= 4 * len(set(sets[a].tolist()) | set(sets[b].tolist())) for a, b in zip(i, j, strict=True)]
    assert 0 < sum(want) < len(want)
    assert N.alike_pairs(sets, i, j).tolist() == want
    assert N.alike_pairs(sets, i[:9], j[:9]).tolist() == want[:9]


def crowd(rng: random.Random, n: int) -> list[str]:
    """Copies of one text with four edits each: nearly all pairs are candidates (about 0.7), few are alike."""
    base = [f"w{rng.randrange(5000)}" for _ in range(200)]
    copies = [list(base) for _ in range(n)]
    for copy in copies:
        for at in rng.sample(range(200), 4):
            copy[at] = f"w{rng.randrange(5000)}"
    return [" ".join(c) for c in copies]


def test_rows_made_do_not_grow_with_the_square_of_a_group(spark, monkeypatch):
    """Whatever the stage writes or gets from Python, for three times the members of a group of near sets: by far not
    nine times the rows; and the documents kept are those of brute force."""
    made: list[dict[str, int]] = []

    def counted(make, name):
        def counting(df, *args):
            out = make(df, *args)
            made[-1][name(args)] = max(made[-1].get(name(args), 0), out.count())
            return out

        return counting

    monkeypatch.setattr(N, "mapped", counted(N.mapped, lambda args: args[1]))
    monkeypatch.setattr(N, "written", counted(N.written, lambda args: args[0]))
    sizes = (100, 300)
    for n in sizes:
        texts = crowd(random.Random(7), n)
        group = brute_groups(texts)
        assert len(set(group)) > n / 3
        made.append({})
        assert [k for k, _ in sorted(kept(spark, list(enumerate(texts))))] == [i for i in range(n) if group[i] == i]
    assert all(many <= 5 * max(made[0].get(name, 0), sizes[0]) for name, many in made[1].items()), made


def test_root_links_hold_all_candidates_together():
    """As many sets of roots as the candidates of all trees make, in fewer links than there are roots."""
    rng = np.random.default_rng(10)
    m = 400
    base = rng.integers(0, 2**63, 12)
    which = rng.integers(0, 12, m)
    fp, more = (base[which] ^ np.array([sum(1 << int(p) for p in rng.choice(63, rng.integers(0, 16), replace=False)) for _ in range(m)], np.int64) for _ in range(2))
    unit, n, side = np.sort(rng.integers(0, 9, m)), rng.integers(80, 120, m), np.zeros(m, np.int64)
    root = rng.integers(0, 150, m) * 7
    i, j = N.candidates(unit, side, np.arange(m), root, n, fp, more, False)
    a, b = N.root_links(unit, side, root, n, fp, more)
    assert 0 < len(a) < len(set(root.tolist())) < len(i) and (b < a).all()
    names, label = np.unique(root, return_inverse=True)
    want = N.components(len(names), [(label[i], label[j])])
    got = N.components(len(names), [(np.searchsorted(names, a), np.searchsorted(names, b))])
    assert got.tolist() == want.tolist()


def test_whole_units_are_not_cut():
    units = np.repeat([3, 4, 9, 11, 12], [5, 1, 14, 0, 3])
    table = pa.table({"unit": units, "at": np.arange(len(units))})
    for size in (1, 2, 3, 7, 30):
        got = list(N.whole_units(iter([*table.to_batches(size), table.to_batches()[0].slice(0, 0)])))
        assert pa.concat_tables(got).equals(table)
        seen = [u for t in got for u in set(t["unit"].to_pylist())]
        assert len(seen) == len(set(seen)) == 4
    assert list(N.whole_units(iter([]))) == []

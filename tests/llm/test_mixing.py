from __future__ import annotations

import pytest

from gridlark.llm import mixing as M

SMALL = "/root/testdata/sf0.001"


def brute_targets(sizes: dict[str | None, int]) -> dict[str | None, float]:
    """Water-filling by rounds: clamp who is above, share the excess anew by weight."""
    names = sorted((n for n in sizes if n is not None)) + ([None] if None in sizes else [])
    weight = {n: M.WEIGHTS[i % 3] for i, n in enumerate(names)}
    target = {n: M.SHARE * sum(sizes.values()) * weight[n] / sum(weight.values()) for n in names}
    clamped: set = set()
    while over := {n for n in names if n not in clamped and target[n] > M.MAX_EPOCHS * sizes[n] + 1e-9}:
        clamped |= over
        left = M.SHARE * sum(sizes.values()) - sum(M.MAX_EPOCHS * sizes[n] for n in clamped)
        free = sum(weight[n] for n in names if n not in clamped)
        target = {n: M.MAX_EPOCHS * sizes[n] if n in clamped else left * weight[n] / free for n in names}
    return target


def test_query_equals_sql(same):
    same(M.op3_mixing, M.ORACLES["op3_mixing"])


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1000, "c": 5}, {"a": 0, "b": 7}, {"a": 3, "b": 3, "c": 3, "d": 3, None: 100}, {"a": 50}, {None: 4}, {"Z": 9, "a": 1, "é": 400, "z": 2, "zz": 30, "zzz": 1}])
def test_targets_equal_rounds(spark, sizes):
    got = {r["source"]: r["target"] for r in M.fill_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
    want = brute_targets(sizes)
    assert got.keys() == want.keys()
    assert all(abs(got[n] - want[n]) < 1e-6 for n in got)


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string, size string")


def test_odd_rows(spark):
    rows = [(1, None, "a", "x"), (2, "", None, "y"), (3, "one two", None, "z"), (3, "one two", None, "z"), (None, "w " * 500, "a", "q"), (4, "v " * 100_000, "hot", "r"), (5, " \t\n ", "b", "s")]
    got = M.mix(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    by = {(r["doc_id"], r["size"]): r for r in got}
    assert by[1, 0]["taken"] == 0 and by[5, 0]["source_size"] == 0 and by[4, 100_000]["size"] == 100_000
    for source in {r["source"] for r in got}:
        own = [r for r in got if r["source"] == source]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) < 1
        assert all(0 <= r["taken"] <= M.MAX_EPOCHS * r["size"] for r in own)
    assert M.mix(frame(spark, []).limit(0)).count() == 0


def test_reruns_agree(spark):
    rows = [(i, "w " * (i % 17), f"s{i % 4}" if i % 3 else "hot", "") for i in range(400)]
    a, b = (sorted(map(tuple, M.mix(frame(spark, r).repartition(n)).collect())) for r, n in ((rows, 3), (rows[::-1], 7)))
    assert a == b


def test_stage_takes_what_the_mix_takes(spark):
    rows = [(i, " ".join(f"w{i}-{j}" for j in range(i % 9)), f"s{i % 5}", "x") for i in range(300)]
    docs = frame(spark, rows).withColumnRenamed("size", "lang").selectExpr("*", "cast(length(text) as long) as n_chars")
    plan = {r["doc_id"]: r for r in M.mix(docs).collect()}
    out = M.mixed(spark, docs, SMALL)
    assert out.columns == docs.columns
    words: dict[int, int] = {}
    for r in out.collect():
        words[r["doc_id"]] = words.get(r["doc_id"], 0) + len(r["text"].split())
        assert r["n_chars"] == len(r["text"])
    for k, p in plan.items():
        assert words.get(k, 0) == p["taken"]
    assert all(k in words for k, p in plan.items() if p["size"] == 0)


def test_stage_takes_each_row_without_doc_id_by_itself(spark):
    rows = [(None, " ".join(f"w{i}-{j}" for j in range(n)), "a", "x") for i, n in enumerate((0, 3, 7, 40, 40, 100))] + [(1, "v " * 30, "b", "x"), (2, "u " * 5, "b", "x")]
    docs = frame(spark, rows).withColumnRenamed("size", "lang").selectExpr("*", "cast(length(text) as long) as n_chars")
    plan = M.mix(docs).collect()
    out = M.mixed(spark, docs, SMALL).collect()
    for source in "ab":
        assert sum(len(r["text"].split()) for r in out if r["source"] == source) == sum(r["taken"] for r in plan if r["source"] == source)
    assert [r["text"] for r in out].count("") == 1
    for i, n in enumerate((3, 7, 40, 40, 100), 1):
        mine = sum(len(r["text"].split()) for r in out if r["text"].startswith(f"w{i}-"))
        assert mine in {r["taken"] for r in plan if r["size"] == n and r["source"] == "a"}

from __future__ import annotations

from collections import Counter

import pytest

from gridlark.llm import sharding as H


def test_query_equals_sql(same):
    same(H.op5_sharding, H.ORACLES["op5_sharding"])


def test_shares_differ_by_one_slot():
    n = Counter(H.fill_table())
    assert set(n) == set(range(len(H.SHARDS))) and max(n.values()) - min(n.values()) <= 1


def test_a_leaving_shard_moves_little():
    a = [H.SHARDS[i] for i in H.fill_table()]
    rest = H.SHARDS[:-1]
    b = [rest[i] for i in H.fill_table(rest)]
    moved = sum(x != y for x, y in zip(a, b, strict=True) if x != H.SHARDS[-1])
    assert moved < 0.1 * H.SLOTS


def test_claims_follow_preferences():
    """Brute force: turns over sorted preference lists."""
    shards, slots = ("a", "b", "c"), 13
    lists = [[(H._hash(f"offset:{s}") % slots + j * (H._hash(f"skip:{s}") % (slots - 1) + 1)) % slots for j in range(slots)] for s in shards]
    table: dict[int, int] = {}
    turn = 0
    while len(table) < slots:
        table[next(x for x in lists[turn % 3] if x not in table)] = turn % 3
        turn += 1
    assert H.fill_table(shards, slots) == [table[i] for i in range(slots)]


@pytest.mark.parametrize(("shards", "slots"), [((), 7), (("a", "a"), 7), (("a", "b"), 8), (("a", "b", "c"), 2), (("a",), 2_000_003)])
def test_bad_parameters(shards, slots):
    with pytest.raises(ValueError):
        H.fill_table(shards, slots)


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, None), (None, ""), (None, "x" * 1_000_000), (1, "a")], "doc_id long, shard string")
    out = H.shard(df)
    assert out.columns == ["doc_id", "slot", "shard"]
    got = [tuple(r) for r in out.collect()]
    assert len(got) == 4 and len(set(got)) == 2 and all(s in H.SHARDS for _, _, s in got)
    assert H.shard(df.limit(0)).count() == 0
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan

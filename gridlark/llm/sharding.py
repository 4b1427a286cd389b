"""Sharding by a permutation-filled lookup table: DataFrame functions only."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table

#: Production parameters: shards, and the table's slots (a prime, about a hundred for each shard).
SHARDS = tuple(f"shard-{i:02d}" for i in range(32))
SLOTS = 3203
#: The table goes into the plan as a literal, so its size is bounded.
MOST_SLOTS = 1_000_003


def _hash(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:8], 16)


def fill_table(shards: Sequence[str] = SHARDS, slots: int = SLOTS) -> list[int]:
    """The table: for each slot the number of its shard.

    Every shard prefers the slots in an order of its own, (offset + j * skip) mod slots, which is a permutation as
    the size is prime. Shards take turns, each claiming the first slot of its order that is still free, until all are
    taken: shares differ by one slot at most, and a shard that leaves moves few of the others' slots."""
    if not shards or len(set(shards)) < len(shards):
        raise ValueError("shards must be given and distinct")
    if slots > MOST_SLOTS or slots < len(shards) or any(slots % d == 0 for d in range(2, int(slots**0.5) + 1)):
        raise ValueError(f"slots must be a prime from the number of shards to {MOST_SLOTS}")
    offset = [_hash(f"offset:{s}") % slots for s in shards]
    skip = [_hash(f"skip:{s}") % (slots - 1) + 1 for s in shards] if slots > 2 else [1] * len(shards)
    at, table, taken = [0] * len(shards), [-1] * slots, 0
    while True:
        for i in range(len(shards)):
            while table[slot := (offset[i] + at[i] * skip[i]) % slots] >= 0:
                at[i] += 1
            table[slot] = i
            taken += 1
            if taken == slots:
                return table


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """The key's slot; a null key counts as the empty text."""
    return (F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 8), 16, 10).cast("long") % slots).cast("int")


def shard(df: DataFrame, key: str = "doc_id", shards: Sequence[str] = SHARDS, slots: int = SLOTS, out: tuple[str, str] = ("slot", "shard")) -> DataFrame:
    """Adds the slot and shard of every row: a constant-time look-up in a literal table that every task holds; rows
    are not moved. Equal keys share a shard (null ones count as empty text); an empty table stays empty; columns that
    are named like `out` are replaced, others pass through."""
    table = F.split(F.lit(",".join(shards[i] for i in fill_table(shards, slots))), ",")
    d = df.drop(*out).withColumn(out[0], slot_of(df[key], slots))
    return d.withColumn(out[1], F.element_at(table, F.col(out[0]) + 1))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's slot and shard."""
    return shard(read_table(spark, sf_dir, "documents").select("doc_id"))


QUERIES = {"op5_sharding": op5_sharding}
ORACLES = {
    "op5_sharding": """
WITH RECURSIVE shards AS (SELECT i, format('shard-{:02d}', i) AS name FROM range(32) r(i)),
p AS (SELECT list(('0x' || substr(md5('offset:' || name), 1, 8))::BIGINT % 3203 ORDER BY i) AS o, list(('0x' || substr(md5('skip:' || name), 1, 8))::BIGINT % 3202 + 1 ORDER BY i) AS k FROM shards),
turns AS (
  SELECT 0 AS turn, list_transform(range(3203), lambda x: -1) AS taken, -1::BIGINT AS slot
  UNION ALL
  SELECT turn + 1, list_concat(taken[:s], [turn % 32], taken[s + 2:]), s
  FROM (SELECT turn, taken, list_filter(list_transform(range(3203), lambda j: (o[turn % 32 + 1] + j * k[turn % 32 + 1]) % 3203), lambda x: taken[x + 1] = -1)[1] AS s FROM turns, p WHERE turn < 3203)
),
t AS (SELECT slot, (turn - 1) % 32 AS i FROM turns WHERE turn > 0)
SELECT doc_id, t.slot::INTEGER AS slot, format('shard-{:02d}', t.i) AS shard FROM documents JOIN t ON ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT % 3203 = t.slot
"""
}

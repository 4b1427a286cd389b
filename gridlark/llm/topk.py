"""Exact top-k inner products by Fagin's threshold algorithm over sorted per-dimension lists."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import mapped, read_table, written

#: Production parameters.
K = 5
SCALE = 256
EVERY = 50
#: Rows of a block of candidates, queries of a block of queries, and blocks of candidates that a task holds.
BLOCK, QUERIES_A_BLOCK, BLOCKS_A_GROUP = 16_384, 2_048, 4
#: Entries taken of every list in the first round; each round doubles the depth.
FIRST = 32
#: Vectors with a larger component are wide: they get blocks of their own, whose numbers are stored as doubles.
NARROW = 1 << 24
BLOCKS = "block long, n long, wide boolean, keys binary, values binary"


def usable(df: DataFrame, key: str, vector: str) -> DataFrame:
    """key, v (components as doubles) of the rows with a key and a vector without null or non-finite components."""
    bad = F.exists(F.col(vector), lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == F.lit(float("inf"))))
    v = F.transform(F.col(vector), lambda x: x.cast("double"))
    return df.filter(F.col(vector).isNotNull() & F.col(key).isNotNull() & ~F.coalesce(bad, F.lit(True))).select(F.col(key).cast("long").alias("key"), v.alias("v"))


def _matrix(rows: pa.Array, scale: float, keys: np.ndarray) -> np.ndarray:
    """floor(scale * x) of the rows as a matrix; shorter ones are filled with zeros, which add nothing to a product."""
    ends = np.asarray(rows.offsets)
    with np.errstate(over="ignore"):
        flat = np.floor(np.asarray(rows.flatten()) * scale)
    lengths = np.diff(ends)
    if not np.isfinite(flat).all():
        raise OverflowError(f"a component of {keys[np.searchsorted(ends - ends[0], int(np.flatnonzero(~np.isfinite(flat))[0]), 'right') - 1]} exceeds a double when scaled")
    out = np.zeros((len(lengths), int(lengths.max(initial=0))))
    out[np.arange(out.shape[1]) < lengths[:, None]] = flat
    return out


def _packed(number: int, wide: bool, keys: list[np.ndarray], parts: list[np.ndarray]) -> pa.RecordBatch:
    width = max(p.shape[1] for p in parts)
    m = np.concatenate([np.pad(p, ((0, 0), (0, width - p.shape[1]))) for p in parts])
    k = np.concatenate(keys)
    return pa.RecordBatch.from_arrays([pa.array([number]), pa.array([len(k)]), pa.array([wide]), pa.array([k.astype("<i8").tobytes()], pa.binary()), pa.array([m.astype("<f8" if wide else "<i4").tobytes()], pa.binary())], names=["block", "n", "wide", "keys", "values"])


def _unpacked(n: int, wide: bool, values: bytes) -> np.ndarray:
    return np.frombuffer(values, "<f8" if wide else "<i4").reshape(n, -1).astype(float)


def blocks(vectors: DataFrame, scale: float = SCALE) -> DataFrame:
    """block, n, wide, keys, values: up to BLOCK vectors in a row, packed; a row's place in its block is its identity."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        held: dict[bool, tuple[list[np.ndarray], list[np.ndarray]]] = {False: ([], []), True: ([], [])}
        many = {False: 0, True: 0}
        for b in it:
            for at in range(0, b.num_rows, BLOCK):
                part = b.slice(at, BLOCK)
                keys = part.column(0).to_numpy()
                m = _matrix(part.column(1), scale, keys)
                large = np.abs(m).max(1, initial=0) > NARROW
                for wide in (False, True):
                    own = large == wide
                    if not own.any():
                        continue
                    if many[wide] and many[wide] + int(own.sum()) > BLOCK:
                        yield _packed(number, wide, *held[wide])
                        number, held[wide], many[wide] = number + 1, ([], []), 0
                    held[wide][0].append(keys[own])
                    held[wide][1].append(m[own])
                    many[wide] += int(own.sum())
        for wide in (False, True):
            if many[wide]:
                yield _packed(number, wide, *held[wide])
                number += 1

    return mapped(vectors, batches, BLOCKS)


class Lists:
    """A block of candidates with every dimension's list in ascending order."""

    def __init__(self, block: int, keys: np.ndarray, m: np.ndarray):
        self.block, self.keys, self.m = block, keys, m
        self.order = np.argsort(m, axis=0, kind="stable").T.astype(np.int32)
        self.ranked = np.sort(m, axis=0).T.copy()
        self.most = float(np.abs(m).max(initial=0))
        self._exact: dict[type, np.ndarray] = {}

    def exact(self, queries: np.ndarray, found: float = 0.0) -> np.ndarray:
        """The block in the cheapest numbers in which all products with these queries, and scores up to `found`, are
        exact."""
        wide = float(np.abs(queries).max(initial=0))
        most = max(found, self.most * wide * max(1, self.m.shape[1]))
        kind = np.float32 if max(most, self.most, wide) < 2**24 else np.float64 if most < 2**53 else np.int64 if most < 2**62 else object
        if kind not in self._exact:
            self._exact = {kind: whole_numbers(self.m, kind)}
        return self._exact[kind]


def whole_numbers(m: np.ndarray, kind: type) -> np.ndarray:
    return np.array([[int(x) for x in row] for row in m.tolist()], object).reshape(m.shape) if kind is object else m.astype(kind)


def threshold_search(queries: np.ndarray, own: np.ndarray, lists: Lists, k: int, found: list | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each query the k best of `found` (keys, scores: those of other blocks) and of this block's candidates, by
    score, then key.

    A query reads every dimension's list from the end that its sign prefers. Candidates met are scored in full at
    once (random access). No candidate yet unmet can exceed the sum of each dimension's last value read; once the
    k-th score is above that bound, the search stops. `own` is a query's own row in this block, or -1."""
    order, ranked, keys = lists.order, lists.ranked, lists.keys
    exact = lists.exact(queries, max((abs(float(x)) for _, xs in found for x in xs[[0, -1]]), default=0.0) if found and len(found[0][1]) else 0.0)
    n, out = len(keys), []
    slack = 0.0 if exact.dtype in (np.float32, np.float64) else 1e-9  # the bound is a sum of doubles
    for i, q in enumerate(whole_numbers(queries, exact.dtype.type if exact.dtype != object else object)):
        wide = queries[i]
        up, down = np.flatnonzero(wide > 0), np.flatnonzero(wide < 0)
        met = np.zeros(n, bool)
        if own[i] >= 0:
            met[own[i]] = True
        best, scores = found[i] if found is not None else (np.empty(0, np.int64), np.empty(0, exact.dtype))
        scores = scores.astype(exact.dtype)
        lo, hi = 0, min(n, FIRST)
        while True:
            last = hi >= n or not len(up) + len(down)
            if last:
                new = np.flatnonzero(~met)
            else:
                before = met.copy()
                met[order[down, lo:hi].ravel()] = True
                met[order[up, n - hi : n - lo].ravel()] = True
                new = np.flatnonzero(met & ~before)
            s = exact[new] @ q
            new = keys[new]
            if len(scores) == k:
                good = s >= scores[-1]
                new, s = new[good], s[good]
            best, scores = np.concatenate([best, new]), np.concatenate([scores, s])
            if len(best) > 8 * k:
                good = scores >= (np.partition(scores, -k)[-k] if exact.dtype != object else sorted(scores)[-k])
                best, scores = best[good], scores[good]
            order_ = np.lexsort((best, -scores))[:k] if exact.dtype != object else np.array(sorted(range(len(best)), key=lambda x: (-scores[x], best[x]))[:k], int)
            best, scores = best[order_], scores[order_]
            if last or met.all():
                break
            ahead = np.concatenate([ranked[down, hi - 1] * wide[down], ranked[up, n - hi] * wide[up]])
            if len(scores) == k and float(scores[-1]) > ahead.sum() + slack * np.abs(ahead).sum():
                break
            lo, hi = hi, min(n, 2 * hi)
        out.append((best, scores))
    return out


def top_k(df: DataFrame, key: str = "vec_id", vector: str = "embedding", every: int = EVERY, k: int = K, scale: float = SCALE) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of all other rows for each row whose key is divisible by `every`.

    Scores are inner products of floor(scale * x), exact whatever the size of the components; one that does not fit a
    long is an error that names its rows. Ties go to the smaller key. Vectors that are null or hold null or non-finite
    components take no part, nor do rows without a key; shorter vectors count as filled with zeros. A row repeated is a
    candidate of its twin, and a repeated query is answered twice. With fewer than k other rows all are returned; an
    empty table gives an empty result; other columns take no part.

    Candidates are packed in blocks of BLOCK rows and queries in blocks of QUERIES_A_BLOCK, each written once. A task
    holds BLOCKS_A_GROUP blocks of candidates, sent to it once, and all blocks of queries pass it; a query takes its
    k-th score along from block to block. The work is the stated query set against all rows; memory is a task's blocks,
    and only k rows a query and group are shuffled."""
    b = written(blocks(usable(df, key, vector), scale), "vectors")

    def pick(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for block, n, wide, ids, values in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids, m = np.frombuffer(ids, "<i8"), np.frombuffer(values, "<f8" if wide else "<i4").reshape(n, -1)
                at = np.flatnonzero(ids % every == 0)
                if len(at):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), block)), pa.array(at), pa.array(np.full(len(at), wide)), pa.array(ids[at]), pa.array([m[i].tobytes() for i in at], pa.binary())], names=["q_block", "q_row", "wide", "key", "v"])

    def pack(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []

        def block() -> pa.RecordBatch:
            q_block, q_row, wide, ids, v = zip(*rows, strict=True)
            width = max(map(len, v))
            out = [pa.array([len(rows)]), pa.array([wide[0]]), *(pa.array([np.array(c, "<i8").tobytes()], pa.binary()) for c in (q_block, q_row, ids)), pa.array([b"".join(x.ljust(width, b"\0") for x in v)], pa.binary())]
            rows.clear()
            return pa.RecordBatch.from_arrays(out, names=["n", "wide", "q_blocks", "q_rows", "keys", "values"])

        for batch in it:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if rows and (len(rows) >= QUERIES_A_BLOCK or row[2] != rows[0][2]):
                    yield block()
                rows.append(row)
        if rows:
            yield block()

    chosen = written(mapped(b, pick, "q_block long, q_row long, wide boolean, key long, v binary"), "chosen")
    parts = max(1, -(-chosen.count() // QUERIES_A_BLOCK))
    dealt = chosen.repartition(parts, F.xxhash64("q_block", "q_row")).sortWithinPartitions("wide", "q_block", "q_row")
    queries = written(mapped(dealt, pack, "n long, wide boolean, q_blocks binary, q_rows binary, keys binary, values binary"), "queries")

    def search(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held = None, []
        for batch in it:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                if row["group"] != group:
                    group, held = row["group"], []
                m = _unpacked(row["n"], row["wide"], row["values"])
                ids = np.frombuffer(row["keys"], "<i8")
                if row["q_rows"] is None:
                    held.append(Lists(row["block"], ids, m))
                    continue
                q_blocks, q_rows = np.frombuffer(row["q_blocks"], "<i8"), np.frombuffer(row["q_rows"], "<i8")
                found = None
                for lists in held:
                    # Components that one side lacks count as zeros, so the block's own width is enough.
                    q = np.pad(m, ((0, 0), (0, max(0, lists.m.shape[1] - m.shape[1]))))[:, : lists.m.shape[1]]
                    found = threshold_search(q, np.where(q_blocks == lists.block, q_rows, -1), lists, k, found)
                times = [len(x) for x, _ in found or []]
                scores = [int(x) for _, xs in found or [] for x in xs.tolist()]
                best = np.concatenate([x for x, _ in found]).astype(np.int64) if times else np.empty(0, np.int64)
                bad = next((j for j, x in enumerate(scores) if not -(2**63) <= x < 2**63), None)
                if bad is not None:
                    raise OverflowError(f"the score of {np.repeat(ids, times)[bad]} and {best[bad]} does not fit a long")
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(q_blocks, times)), pa.array(np.repeat(q_rows, times)), pa.array(np.repeat(ids, times)), pa.array(best), pa.array(scores, pa.int64())], names=["q_block", "q_row", "query_id", "vec_id", "score"])

    found = mapped(units(queries, b), search, "q_block long, q_row long, query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("q_block", "q_row").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def units(queries: DataFrame, b: DataFrame) -> DataFrame:
    """Groups of candidate blocks, each with all blocks of queries behind them: as many blocks as a task may hold, fewer
    if there would be more cores than groups. What is numbered is a row a block."""
    many = max(1, b.count())
    held = max(1, min(BLOCKS_A_GROUP, many // b.sparkSession.sparkContext.defaultParallelism))
    groups = -(-many // held)
    none = F.lit(None).cast("binary")
    group = F.floor((F.row_number().over(Window.orderBy("block")) - 1) / held)
    c = b.join(b.select("block", group.alias("group")), "block").select("group", F.lit(0).alias("kind"), "block", "n", "wide", none.alias("q_blocks"), none.alias("q_rows"), "keys", "values")
    q = queries.select(F.explode(F.sequence(F.lit(0), F.lit(groups - 1)).cast("array<bigint>")).alias("group"), F.lit(1).alias("kind"), F.lit(None).cast("long").alias("block"), "n", "wide", "q_blocks", "q_rows", "keys", "values")
    return c.unionByName(q).repartition(groups, "group").sortWithinPartitions("group", "kind", "block").drop("kind")


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best others of every fiftieth vector."""
    return top_k(read_table(spark, sf_dir, "embeddings"))


QUERIES = {"op4_topk": op4_topk}
ORACLES = {
    "op4_topk": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score FROM v q, v c WHERE q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 5
"""
}

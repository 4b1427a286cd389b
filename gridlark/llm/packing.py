"""Best-fit packing: dominance reduction fixes provably good sets of pieces, best fit places the remainder.

The instance is the histogram of piece lengths, at most `capacity` numbers however large the corpus is. Solving it
gives patterns (a multiset of lengths, and how many sequences have it); the pieces of one length are interchangeable,
so a piece needs only its rank among those of its length to find its sequence and offset."""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import mapped, read_table, text_or_empty, written

#: Production parameters.
CAPACITY = 2048
END = 0
#: Pieces of one length are ranked in this many hash buckets for each million of pieces.
BUCKETS_A_MILLION = 16

PIECES = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType())])


@dataclass
class Pattern:
    """`many` sequences that hold `items`: (length, how often), in the order of their offsets."""

    many: int
    items: list[tuple[int, int]] = field(default_factory=list)


class Instance:
    """Counts of lengths, with the queries that the dominance rules need."""

    def __init__(self, counts: dict[int, int]):
        self.left = {s: n for s, n in counts.items() if n > 0}
        self.sizes = sorted(self.left)

    def take(self, s: int, n: int) -> None:
        self.left[s] -= n
        if not self.left[s]:
            del self.left[s]
            self.sizes.remove(s)

    def largest(self, room: int, without: dict[int, int]) -> int | None:
        """The largest length that fits `room`, beside those of `without`."""
        for i in range(bisect_right(self.sizes, room) - 1, -1, -1):
            if self.left[self.sizes[i]] > without.get(self.sizes[i], 0):
                return self.sizes[i]
        return None

    def smallest(self, n: int, without: dict[int, int]) -> list[int]:
        out: list[int] = []
        for s in self.sizes:
            out += [s] * min(n - len(out), self.left[s] - without.get(s, 0))
            if len(out) == n:
                break
        return out

    def second_of_pair(self, room: int, without: dict[int, int]) -> int:
        """The greatest y for which some other piece x >= y has x + y <= room; 0 if there is no pair."""
        for i in range(bisect_right(self.sizes, room // 2) - 1, -1, -1):
            y = self.sizes[i]
            free = self.left[y] - without.get(y, 0)
            if free >= 2:
                return y
            if free == 1 and any(self.left[x] > without.get(x, 0) for x in self.sizes[i + 1 : bisect_right(self.sizes, room - y)]):
                return y
        return 0


def reduce_instance(counts: dict[int, int], capacity: int) -> tuple[list[Pattern], dict[int, int]]:
    """Dominance rules in the manner of Martello and Toth: for a piece j, a set F with j dominates if every feasible
    set with j can be traded for F at no loss. Applied from the largest j down, as often at once as the counts allow:

    - nothing else fits beside j: {j};
    - some k fills the sequence exactly: {j, k} (any other set with j could be put where k was);
    - no two pieces fit beside j: {j, largest k that fits};
    - no three fit beside j: {j, a, b} with a the largest that fits and b the largest beside both, if in every pair
      that fits beside j the smaller one is at most b.

    What no rule decides stays in the returned rest."""
    x, fixed = Instance(counts), []
    for j in sorted(counts, reverse=True):
        while x.left.get(j):
            room = capacity - j
            k = x.largest(room, {j: 1})
            if k is None:
                fixed.append(Pattern(x.left[j], [(j, 1)]))
                x.take(j, x.left[j])
                continue
            two = x.smallest(2, {j: 1})
            if k == room or len(two) < 2 or sum(two) > room:
                n = x.left[j] // 2 if k == j else min(x.left[j], x.left[k])
                fixed.append(Pattern(n, [(j, 2)] if k == j else [(j, 1), (k, 1)]))
                if k == j:
                    x.take(j, 2 * n)
                else:
                    x.take(j, n)
                    x.take(k, n)
                continue
            three = x.smallest(3, {j: 1})
            if len(three) == 3 and sum(three) <= room:
                break
            used = {j: 1}
            used[k] = used.get(k, 0) + 1
            b = x.largest(room - k, used)
            y = x.second_of_pair(room, {j: 1})
            if b is None or y > b:
                break  # a pair fits that {j, k, b} does not cover
            n = 1 if len({j, k, b}) < 3 else min(x.left[j], x.left[k], x.left[b])
            items: dict[int, int] = {}
            for s in (j, k, b):
                items[s] = items.get(s, 0) + 1
                x.take(s, n)
            fixed.append(Pattern(n, sorted(items.items(), reverse=True)))
    return fixed, x.left


def best_fit(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Best-fit decreasing over counts: equal pieces and equal sequences are placed together."""
    open_: dict[int, list[Pattern]] = {}
    rooms: list[int] = []  # sorted rooms that have sequences

    def add(room: int, p: Pattern) -> None:
        i = bisect_right(rooms, room)
        if not (i and rooms[i - 1] == room):
            rooms.insert(i, room)
        open_.setdefault(room, []).append(p)

    done: list[Pattern] = []
    for s in sorted(counts, reverse=True):
        n = counts[s]
        while n:
            i = bisect_right(rooms, s - 1)
            if i < len(rooms):
                room = rooms[i]
                p = open_[room].pop()
                if not open_[room]:
                    del open_[room]
                    rooms.pop(i)
            else:
                room, p = capacity, Pattern(-(-n // (capacity // s)))
            each = room // s
            full = min(p.many, n // each)
            if full:
                (done.append if room == each * s else lambda q: add(room - each * s, q))(Pattern(full, [*p.items, (s, each)]))
                n -= full * each
            if p.many > full:
                if n:
                    some = min(n, each - 1)
                    add(room - some * s, Pattern(1, [*p.items, (s, some)]))
                    n -= some
                    if p.many > full + 1:
                        add(room, Pattern(p.many - full - 1, p.items))
                elif p.items:
                    add(room, Pattern(p.many - full, p.items))
    return done + [p for ps in open_.values() for p in ps]


def solve(counts: dict[int, int], capacity: int = CAPACITY) -> list[Pattern]:
    fixed, rest = reduce_instance(counts, capacity)
    return fixed + best_fit(rest, capacity)


def slots(patterns: list[Pattern]) -> dict[str, np.ndarray]:
    """Where the r-th piece of a length goes: by length and first rank, the first sequence and the offset. A slot of
    `many` ranks goes to as many sequences, one after the other."""
    used: dict[int, int] = {}
    rows, base = [], 0
    for p in patterns:
        at = 0
        for s, each in p.items:
            for _ in range(each):
                rows.append((s, used.get(s, 0), base, at))
                used[s] = used.get(s, 0) + p.many
                at += s
        base += p.many
    a = np.array(rows or np.empty((0, 4)), np.int64).reshape(-1, 4)
    a = a[np.lexsort((a[:, 1], a[:, 0]))]
    return {"length": a[:, 0], "rank": a[:, 1], "sequence": a[:, 2], "offset": a[:, 3]}


def cut(ids: bytes, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of each piece: only longer documents are cut; the first piece takes what the others leave."""
    n = len(ids) // 4
    if n <= capacity:
        return [(0, n)]
    first = n % capacity or capacity
    return [(0, first), *((at, capacity) for at in range(first, n, capacity))]


def tokenize_pieces(df: DataFrame, path: str, text: str = "text", key: str = "doc_id", capacity: int = CAPACITY) -> DataFrame:
    """Pieces of every document: doc_id, piece, start, length, ids_crc32. A document's ids end with END."""
    end = np.asarray([END], "<u4").tobytes()

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .tokens import encoder

        encode = encoder(path)
        for b in it:
            out: list[tuple] = []
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = encode(t or "") + end
                view = memoryview(ids)
                out += [(k, i, at, n, zlib.crc32(view[4 * at : 4 * (at + n)])) for i, (at, n) in enumerate(cut(ids, capacity))]
            cols = list(zip(*out, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, f) for c, f in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=PIECES.names)

    return mapped(df.select(df[key].cast("long"), text_or_empty(df, text)), batches, PIECES)


def pack(df: DataFrame, path: str, text: str = "text", key: str = "doc_id", capacity: int = CAPACITY) -> DataFrame:
    """Packs all documents: a row a piece with doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null text counts as empty: one piece of length 1. Repeated rows are packed as often as they occur; rows equal in
    every column may swap places. An empty table gives an empty result. The pieces (five numbers each, no text) are
    written once; then a histogram of at most `capacity` rows goes to the driver, and two numbers per pattern slot go
    back, as many as the lengths' patterns need, whatever the number of documents. A piece's rank among those of its
    length comes from counts by (length, hash bucket) and a sort within that bucket, so that no length meets in one
    task."""
    pieces = written(tokenize_pieces(df, path, text, key, capacity), "pieces")
    counts = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}
    place = slots(solve(counts, capacity))
    buckets = max(8, sum(counts.values()) * BUCKETS_A_MILLION // 1_000_000)
    p = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)).cast("int"))
    sums = p.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    first = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("length", "bucket", F.coalesce(F.sum("n").over(first), F.lit(0)).alias("first"))
    within = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = p.withColumn("rank", F.row_number().over(within) - 1).join(sums, ["length", "bucket"]).withColumn("rank", F.col("rank") + F.col("first"))
    keys = place["length"] * (1 << 40) + place["rank"]

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            length, rank = (b.column(c).to_numpy() for c in ("length", "rank"))
            i = np.searchsorted(keys, length * (1 << 40) + rank, "right") - 1
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(place["sequence"][i] + rank - place["rank"][i]), pa.array(place["offset"][i])], names=[*PIECES.names, "sequence_id", "offset"])

    out = T.StructType([*PIECES.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return mapped(ranked.select(*PIECES.names, F.col("rank").cast("long")), batches, out)


def vocabulary() -> str:
    """The path of the default vocabulary; operators take it as a parameter."""
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces and their places in the sequences."""
    return pack(read_table(spark, sf_dir, "documents"), vocabulary())


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the packed pieces of all documents that are left."""
    return pack(docs, vocabulary())


QUERIES = {"op10_packing": op10_packing}
ORACLES: dict[str, str] = {}

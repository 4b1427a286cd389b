"""SimHash near-duplicates: fingerprints of shingles, linked within a Hamming radius by BK-trees of shards."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mapped, read_table, text_or_empty, written

#: Production parameters.
SHINGLE = 3
RADIUS = 2
SEED = 42
#: A shard of more fingerprints than this is split again by its other bits.
LARGE_SHARD = 2000
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_SPACE = b" \t\n\x0b\x0c\r"
_ONE = bytes.maketrans(_SPACE, b" " * 6)
#: Hashes unpacked to bits at a time (64 bytes each).
CHUNK = 1 << 16


def fingerprint(text: str, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The unsigned 64-bit SimHash of a text: a bit is 1 if set in over half of its shingles' XXH64."""
    import xxhash

    words = text.encode("utf-8", "surrogatepass").translate(_LOWER).translate(_ONE).split(b" ")
    words = [w for w in words if w]
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words))) + np.arange(len(words))
    n = max(1, len(words) - shingle + 1)
    starts = [0, *(ends[: n - 1] + 1).tolist()]
    stops = ends[len(words) - n :].tolist()
    digest, total = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for a in range(0, n, CHUNK):
        total += set_bits(np.array([digest(line[s:e], seed) for s, e in zip(starts[a : a + CHUNK], stops[a : a + CHUNK], strict=True)], "<u8"))
    return int.from_bytes(np.packbits(total * 2 > n, bitorder="little").tobytes(), "little")


def set_bits(h: np.ndarray) -> np.ndarray:
    """How many of the hashes have each of the 64 bits set."""
    return np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """key, fp (the fingerprint's 64 bits as a long). Null text counts as empty: fingerprint zero."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            fp = np.fromiter((fingerprint(t, shingle) for t in b.column(1).to_pylist()), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], names=["key", "fp"])

    return mapped(df.select(df[key].cast("long").alias("key"), text_or_empty(df, text)), batches, "key long, fp long")


def _bits(fp: Column, low: int, n: int) -> Column:
    return F.shiftrightunsigned(fp, low).bitwiseAND(F.lit((1 << n) - 1).cast("long"))


def shards(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """shard, fp: every fingerprint in each shard that it shares with all others within the radius; `fps` are distinct.

    The 64 bits are cut into radius + 2 blocks; two fingerprints within the radius agree on 2 blocks at least, so
    they meet in the shard of those two blocks. A shard of over LARGE_SHARD fingerprints (one key can hold a third of
    all) is split by radius + 1 parts of its other bits, on one of which two such fingerprints agree, again and again:
    each time fewer bits are left to differ in, so that no shard stays large."""
    blocks = radius + 2
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    spans = [(cuts[i], cuts[i + 1] - cuts[i]) for i in range(blocks)]
    mask = lambda i: ((1 << spans[i][1]) - 1) << spans[i][0]
    keys = [
        F.struct(F.lit(c).alias("c"), _bits(F.col("fp"), *spans[i]).alias("a"), _bits(F.col("fp"), *spans[j]).alias("b"), F.lit(_signed(~(mask(i) | mask(j)))).cast("long").alias("rest"))
        for c, (i, j) in enumerate(combinations(range(blocks), 2))
    ]
    d = fps.select("fp", F.explode(F.array(*keys)).alias("s")).select(F.xxhash64("s.c", "s.a", "s.b").alias("shard"), "fp", "s.rest")
    found: DataFrame | None = None
    while True:
        sizes = written(d.groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.bit_count(F.max("rest")).alias("free")).filter("n > 1"), "shard-sizes")
        large = (F.col("n") > LARGE_SHARD) & (F.col("free") > radius)
        small = d.join(sizes.filter(~large), "shard").select("shard", "fp")
        found = small if found is None else found.unionByName(small)
        if sizes.filter(large).isEmpty():
            return found
        d = written(_split(d.join(sizes.filter(large), "shard").select("shard", "fp", "rest"), radius), "shards")


def _signed(bits: int) -> int:
    bits &= (1 << 64) - 1
    return bits - (1 << 64) if bits >> 63 else bits


def _split(d: DataFrame, radius: int) -> DataFrame:
    """Each row (shard, fp, rest) in radius + 1 shards, by as many parts of the bits in `rest`."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for b in it:
            out: list[tuple[int, int, int]] = []
            for shard, fp, rest in zip(*(c.to_pylist() for c in b.columns), strict=True):
                free = [p for p in range(64) if rest >> p & 1]
                for k in range(radius + 1):
                    own = sum(1 << p for p in free[len(free) * k // (radius + 1) : len(free) * (k + 1) // (radius + 1)])
                    name = xxhash.xxh64_intdigest(f"{shard}:{k}:{fp & own}".encode())
                    out.append((_signed(name), fp, _signed(rest & ~own)))
            cols = list(zip(*out, strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["shard", "fp", "rest"])

    return mapped(d, batches, "shard long, fp long, rest long")


def links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """fp, to: links within the radius that hold every linked set together (not all pairs of a dense set): in each
    shard, BK-trees find the pairs and each fingerprint is linked to the first of its set."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .bktree import components, pairs_within

        rest: tuple[np.ndarray, np.ndarray] | None = None

        def solve(shard: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
            _, which, many = np.unique(shard, return_inverse=True, return_counts=True)
            keep = many[which] > 1
            shard, fp = shard[keep], fp[keep]
            root = components(len(fp), pairs_within(fp.view(np.uint64), shard, radius))
            linked = root != np.arange(len(fp))
            return pa.RecordBatch.from_arrays([pa.array(fp[linked]), pa.array(fp[root[linked]])], names=["fp", "to"])

        for b in it:
            shard, fp = b.column(0).to_numpy(), b.column(1).to_numpy()
            if rest is not None:
                shard, fp = np.concatenate([rest[0], shard]), np.concatenate([rest[1], fp])
            whole = np.searchsorted(shard, shard[-1]) if len(shard) else 0  # the last shard may go on
            rest = shard[whole:], fp[whole:]
            if whole:
                yield solve(shard[:whole], fp[:whole])
        if rest is not None and len(rest[0]):
            yield solve(*rest)

    return mapped(shards(fps, radius).repartition("shard").sortWithinPartitions("shard", "fp"), batches, "fp long, to long")


def linked_sets(edges: DataFrame, rounds: int | None = None) -> DataFrame:
    """fp, root: for every end of an edge the least end reachable from it (large star, small star; each round is
    written to the shared folder, and the number of rounds grows as the logarithm of the longest chain). It goes on until
    nothing changes; if `rounds` are given and run out before, that is an error."""
    e = written(edges.select(F.greatest(*edges.columns).alias("u"), F.least(*edges.columns).alias("v")).filter("u != v").distinct(), "edges")
    before, done = None, 0
    while True:
        if rounds is not None and done >= rounds:
            raise RuntimeError(f"sets not settled after {rounds} rounds")
        done += 1
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.u", "x.v").filter("u != v").distinct()
        e = written(small, "edges")
        now = tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    return e.select(F.col("u").alias("fp"), F.col("v").alias("root"))


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """key, fp, component_id (the least key among all documents reachable over links, its own included).

    Fingerprints of all documents are computed once and written; equal ones are linked by grouping, others by BK-trees
    of shards over distinct fingerprints, so copies are never paired. Texts without words link to each other like any
    other equal fingerprints. A null key takes no part as a component's number. Empty tables give empty results."""
    docs = written(fingerprints(df, key, text, shingle), "fingerprints")
    reps = written(docs.groupBy("fp").agg(F.min("key").alias("rep")), "representatives")
    sets = linked_sets(links(reps.select("fp"), radius))
    members = sets.select(F.col("root"), "fp").unionByName(sets.select("root", F.col("root").alias("fp"))).distinct()
    least = members.join(reps, "fp").groupBy("root").agg(F.min("rep").alias("component_id"))
    changed = members.join(least, "root").select("fp", "component_id")
    # Written, so that the last join has plain exchanges on both sides and Spark can split a hot fingerprint's rows.
    named = written(reps.join(changed, "fp", "left").select("fp", F.coalesce("component_id", "rep").alias("component_id")), "components")
    return docs.join(named, "fp").select(F.col("key").alias(key), "fp", "component_id")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and component."""
    d = near_duplicates(read_table(spark, sf_dir, "documents"))
    return d.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


QUERIES = {"op7_simhash": op7_simhash}
ORACLES: dict[str, str] = {}

"""Near copies by Jaccard similarity: SimHash fingerprints in BK-trees find candidates, whole shingle sets decide.

Documents are linked whose sets of five-word shingles have a Jaccard similarity of 0.8 or more. Two such sets differ in
about 10 of 64 fingerprint bits, up to 22, too many for shards by blocks of equal bits; so the fingerprint goes on for
512 bits, its bits are drawn into many short shard keys, and the trees are built and searched within these shards."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bktree import components, pairs_within
from .common import fresh, mapped, numbered, text_or_empty, written
from .simhash import _LOWER, SEED, linked_sets

#: Words of a shingle, and the least similarity, as a fraction.
SHINGLE = 5
ALIKE = (4, 5)
#: Sets of fewer members are alike only if they are equal.
LEAST = -(-ALIKE[0] // (ALIKE[1] - ALIKE[0]))
#: 64-bit words of a fingerprint, and bits of a shard's key. The bits are dealt DEALS times into keys, which makes 78
#: tables of shards: at similarity 0.8 a bit differs with probability 0.152 (0.19 for sets of five), so two such sets
#: share a shard with probability 1 - (1 - 0.848 ** 13) ** 78 = 0.9999 (0.995).
WORDS, BITS, DEALS = 8, 13, 2
#: Bits that candidates may differ in, of the first 64 (where the trees are) and of the first 128: at similarity 0.8
#: 0.99999 of the pairs are within both (0.999 for sets of five).
RADIUS, RADIUS_2 = 22, 40
#: Tables whose shards are first searched from their trees' roots only.
STARS = 8
#: Weight of a part: of shards, where a set counts as SET, and of groups whose sets are compared, where one counts as
#: its members and 500; sets that are compared with one set in a task, and columns of a matrix of sets.
PART, SET, TOGETHER, COLUMNS = 1_000_000, 100, 500, 4096
#: Words whose hash a worker remembers, and the longest one.
REMEMBER, LONG = 1_000_000, 64
#: Members unpacked to bits at a time (512 bytes each; their counts fit 16 bits).
ROWS = 512


class Words(dict):
    """Hashes of words."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        h = xxhash.xxh64_intdigest(word, SEED)
        if len(word) <= LONG:
            if len(self) >= REMEMBER:
                self.clear()
            self[word] = h
        return h


def shingle_set(text: str, known: Words, shingle: int = SHINGLE) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's shingles of words (ASCII letters in lower case; with fewer words
    the whole sequence); empty without words."""
    words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split()  # the six ASCII white-space characters
    if not words:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    n = max(1, len(w) - shingle + 1)
    h = np.zeros(n, np.uint64)
    for i in range(min(shingle, len(w))):
        h = h * np.uint64(0x9E3779B97F4A7C15) + w[i : i + n]
    # Mixed as in a 64-bit hash's last steps, so that bits and minima do not follow the sum's.
    for by in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        h = (h ^ (h >> np.uint64(33))) * np.uint64(by)
    return np.unique(h ^ (h >> np.uint64(33)))


def _drawn() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What makes the words of a fingerprint (flipped bits, odd factors), and the bits of each table's keys."""
    rng = np.random.default_rng(SEED)
    flip = rng.integers(0, 2**64, WORDS, np.uint64)
    times = rng.integers(0, 2**63, WORDS, np.uint64) * np.uint64(2) + np.uint64(1)
    tables = 64 * WORDS // BITS
    return flip, times, np.concatenate([rng.permutation(64 * WORDS)[: tables * BITS].reshape(tables, BITS) for _ in range(DEALS)])


FLIP, TIMES, TABLES = _drawn()


def fingerprints(sets: list[np.ndarray]) -> np.ndarray:
    """A row a set, its SimHash in WORDS words: a bit is 1 if set in over half of the members, which are hashed anew for
    each word but the first."""
    out = np.zeros((len(sets), WORDS), "<u8")
    for i, members in enumerate(sets):
        total = np.zeros(64 * WORDS, np.int64)
        for a in range(0, len(members), ROWS):
            h = members[a : a + ROWS]
            x = (h[:, None] ^ FLIP) * TIMES
            x ^= x >> np.uint64(32)
            x[:, 0] = h
            total += np.unpackbits(x.astype("<u8", copy=False).view(np.uint8), axis=1, bitorder="little").sum(0, dtype=np.uint16)
        out[i] = np.packbits(total * 2 > len(members), bitorder="little").view("<u8")
    return out


def shard_keys(words: np.ndarray) -> np.ndarray:
    """A row a fingerprint, a column a table: the shard of the table's bits."""
    bits = np.unpackbits(words.astype("<u8", copy=False).view(np.uint8), axis=1, bitorder="little")
    out = np.empty((len(words), len(TABLES)), np.int32)
    for t, places in enumerate(TABLES):
        out[:, t] = (t << BITS) + bits[:, places] @ (1 << np.arange(BITS))
    return out


def band_keys(sets: list[np.ndarray]) -> np.ndarray:
    """A row a set, a column a table: the set's shard there, by bits of its fingerprint."""
    return shard_keys(fingerprints(sets))


def fingerprint(members: np.ndarray) -> int:
    """The first 64 bits of a set's fingerprint, as a signed long."""
    return int(fingerprints([members]).view("<i8")[0, 0])


def sketches(rows: DataFrame, file: str, place: str) -> DataFrame:
    """file, place, doc_id, id (a hash of the shingle set), n (its size), fp and more (the first words of its
    fingerprint), shards of each document; null text counts as empty."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        known = Words()
        for whole in it:
            for at in range(0, whole.num_rows, 500):
                b = whole.slice(at, 500)
                sets = [shingle_set(t, known) for t in b.column(3).to_pylist()]
                own = np.fromiter((xxhash.xxh64_intdigest(x.tobytes(), SEED) for x in sets), np.uint64, len(sets)).view(np.int64)
                words = fingerprints(sets)
                fp, more = (pa.array(words[:, k].astype(np.uint64).view(np.int64)) for k in (0, 1))
                shards = pa.array(list(shard_keys(words)), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(own), pa.array(list(map(len, sets)), pa.int64()), fp, more, shards], names=["file", "place", "doc_id", "id", "n", "fp", "more", "shards"])

    d = rows.select(F.col(file).alias("file"), F.col(place).alias("place"), rows["doc_id"].cast("long").alias("doc_id"), text_or_empty(rows).alias("text"))
    return mapped(d, batches, "file long, place long, doc_id long, id long, n long, fp long, more long, shards array<int>")


def shingle_sets(ids: DataFrame, distinct: DataFrame, rows: DataFrame, file: str, place: str) -> DataFrame:
    """id, members (64-bit hashes in order) of the given sets, made anew from the texts of their first documents."""

    def members(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Words()
        for whole in it:
            for at in range(0, whole.num_rows, 500):
                b = whole.slice(at, 500)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shingle_set(t, known).astype("<u8").tobytes() for t in b.column(1).to_pylist()], pa.binary())], names=["id", "members"])

    wanted = distinct.join(ids, "id", "left_semi").select("id", F.col("first.file").alias(file), F.col("first.place").alias(place))
    texts = rows.select(file, place, text_or_empty(rows).alias("text")).join(wanted, [file, place]).select("id", "text")
    return mapped(texts, members, "id long, members binary")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of the pairs (id, to) those whose sets are alike, exactly. A set that is compared with very many others goes to
    as many tasks as these need."""

    def compare(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        few, many = ALIKE
        own, one = None, np.empty(0, np.uint64)
        for b in it:
            out: tuple[list[int], list[int]] = ([], [])
            for i, to, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                other = np.frombuffer(raw.as_buffer(), "<u8")
                if to is None:
                    own, one = i, other.copy()
                    continue
                assert own == i
                at = np.searchsorted(one, other)
                both = int((one[np.minimum(at, len(one) - 1)] == other).sum())
                if both * (few + many) >= (len(one) + len(other)) * few:
                    out[0].append(i)
                    out[1].append(to)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64())], names=["id", "to"])

    tasks = pairs.groupBy("id").agg(F.ceil(F.count(F.lit(1)) / TOGETHER).alias("tasks"))
    one = tasks.select("id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tasks") - 1)).alias("task")).join(sets, "id").select("id", "task", F.lit(None).cast("long").alias("to"), "members")
    others = pairs.join(tasks, "id").select("id", F.pmod(F.xxhash64("to"), "tasks").alias("task"), "to").join(sets.select(F.col("id").alias("to"), "members"), "to").select("id", "task", "to", "members")
    dealt = one.unionByName(others).repartition("id", "task").sortWithinPartitions("id", "task", F.asc_nulls_first("to"))
    return mapped(dealt.select("id", "to", "members"), compare, "id long, to long")


def common_members(sets: list[np.ndarray]) -> np.ndarray:
    """How many members every two sets share: a product of the matrix of those members that several sets have, in parts."""
    owner = np.repeat(np.arange(len(sets)), list(map(len, sets)))
    _, which, many = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = many[which] > 1
    owner, which = owner[shared], (np.cumsum(many > 1) - 1)[which[shared]]
    order = np.argsort(which, kind="stable")
    owner, which = owner[order], which[order]
    out = np.zeros((len(sets), len(sets)), np.float32)
    columns = int(which[-1]) + 1 if len(which) else 0
    for a in range(0, columns, COLUMNS):
        i, j = np.searchsorted(which, [a, a + COLUMNS])
        x = np.zeros((len(sets), min(COLUMNS, columns - a)), np.float32)
        x[owner[i:j], which[i:j] - a] = 1
        out += x @ x.T
    return out


def alike_pairs(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which of the pairs (i, j) of sets are alike, exactly."""
    few, many = ALIKE
    n = np.fromiter(map(len, sets), np.int64, len(sets))
    if 20 * len(i) > len(sets) ** 2:
        both = common_members(sets)[i, j]
    else:
        both = np.fromiter((len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(i.tolist(), j.tolist(), strict=True)), np.int64, len(i))
    return both * (few + many) >= (n[i] + n[j]) * few


def whole_units(it: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches that are sorted by their first column, as tables that cut none of its values in two."""
    rest: list[pa.RecordBatch] = []  # of the last unit, which may go on
    for b in it:
        if not b.num_rows:
            continue
        units = b.column(0).to_numpy()
        cut = int(np.searchsorted(units, units[-1]))
        if rest and (cut or rest[0].column(0)[0].as_py() != units[0]):
            yield pa.Table.from_batches([*rest, b.slice(0, cut)])
            rest = []
        elif cut:
            yield pa.Table.from_batches([b.slice(0, cut)])
        rest.append(b.slice(cut))
    if rest:
        yield pa.Table.from_batches(rest)


def verified_groups(groups: DataFrame, sets: DataFrame) -> DataFrame:
    """id, to: links that hold together what is alike within each group (shard) of the sets (shard, id, root, n, fp,
    more). A group's sets are sent to a task, each once, where trees find the candidates and the sets decide, exactly;
    no pair leaves the task, each set is linked to the first that it hangs together with. Groups of over PART are cut."""

    def compare(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_units(it):
            *columns, members = t.columns
            unit, side, ids, root, n, fp, more = (c.to_numpy() for c in columns)
            sets = [np.frombuffer(raw.as_buffer(), "<u8") for raw in members]
            met = np.concatenate([np.empty((2, 0), np.int64), *map(np.stack, _near(unit, side, root, n, fp, more, False))], axis=1)
            met = met[:, np.argsort(met[0], kind="stable")]  # by units
            ok = np.zeros(met.shape[1], bool)
            cuts = np.flatnonzero(np.diff(unit[met[0]])) + 1
            for a, b in zip([0, *cuts], [*cuts, len(ok)], strict=True):
                own, ends = np.unique(met[:, a:b], return_inverse=True)
                if a < b:
                    ok[a:b] = alike_pairs([sets[k] for k in own], *ends.reshape(2, -1))
            to = components(len(ids), [tuple(met[:, ok])])
            linked = to != np.arange(len(ids))
            found = ids[linked], ids[to[linked]]
            yield pa.RecordBatch.from_arrays([pa.array(e) for e in found], names=["id", "to"])

    dealt = _units(groups, F.col("n") + 500).join(sets, "id").repartition("unit").sortWithinPartitions("unit", "id")
    return mapped(dealt.select("unit", "side", "id", "root", "n", "fp", "more", "members"), compare, "id long, to long")


def _not_of_the_largest(tree: np.ndarray, root: np.ndarray) -> np.ndarray:
    """Which points are not of the root that most points of their tree have. All links across roots have one of these."""
    names, label = np.unique(root, return_inverse=True)
    groups, which, many = np.unique(tree * len(names) + label, return_inverse=True, return_counts=True)
    order = np.lexsort((-many, groups // len(names)))
    _, first = np.unique(groups[order] // len(names), return_index=True)
    largest = np.zeros(len(groups), bool)
    largest[order[first]] = True
    return ~largest[which]


def _near(unit: np.ndarray, side: np.ndarray, root: np.ndarray, n: np.ndarray, fp: np.ndarray, more: np.ndarray, stars: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of the pairs that BK-trees over the fingerprints `fp` find, a tree a unit: of different roots and, where
    there are two sides, of different sides, of sizes that can be alike and near by `more` as well. With `stars` only
    pairs with a tree's root."""
    few, many = ALIKE
    _, first, tree = np.unique(unit, return_index=True, return_inverse=True)
    if stars:
        ask = np.zeros(len(unit), bool)
        ask[first] = True
    else:
        ask = np.where(side == 0, _not_of_the_largest(tree, root), side == 1)
    sizes = np.bincount(tree)
    live = (np.bincount(tree, ask) > 0) & (sizes > 1)
    place = np.flatnonzero(live[tree])
    side, root, n, fp, more, tree, ask = (x[place] for x in (side, root, n, fp.view(np.uint64), more.view(np.uint64), tree, ask))
    for i, j in pairs_within(fp, tree, RADIUS, block=max(64, min(2048, (1 << 18) // int(sizes.max(initial=1)))), ask=ask):
        ok = (root[i] != root[j]) & ((side[i] != side[j]) | (side[i] == 0)) & (n[i] * many >= n[j] * few) & (n[j] * many >= n[i] * few)
        i, j = i[ok], j[ok]
        ok = np.bitwise_count(fp[i] ^ fp[j]) + np.bitwise_count(more[i] ^ more[j]) <= RADIUS_2
        yield place[i[ok]], place[j[ok]]


def candidates(unit: np.ndarray, side: np.ndarray, ids: np.ndarray, root: np.ndarray, n: np.ndarray, fp: np.ndarray, more: np.ndarray, stars: bool) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the pairs that are near, lesser one first."""
    out = []
    for i, j in _near(unit, side, root, n, fp, more, stars):
        i, j = ids[i], ids[j]
        out.append(np.stack([np.minimum(i, j), np.maximum(i, j)]))
    found = np.unique(np.concatenate(out, axis=1), axis=1) if out else np.empty((2, 0), np.int64)
    return found[0], found[1]


def root_links(unit: np.ndarray, side: np.ndarray, root: np.ndarray, n: np.ndarray, fp: np.ndarray, more: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the roots that near pairs hold together, each but the least and the least: fewer links than roots, however
    many pairs there are."""
    names, label = np.unique(root, return_inverse=True)
    least = components(len(names), ((label[i], label[j]) for i, j in _near(unit, side, root, n, fp, more, False)))
    linked = least != np.arange(len(names))
    return names[linked], names[least[linked]]


def _units(d: DataFrame, weight: Column, stars: bool = False) -> DataFrame:
    """Rows (shard, id, root, n, fp, more) with the unit whose tree they enter and their side there.

    A unit is a shard. A shard of over PART is cut into parts, and every two parts meet in a unit of their own; a root
    with so many sets has parts for itself, which do not meet each other, so that a large group of copies is never
    paired with itself. For `stars` each part is a unit."""
    sizes = written(d.groupBy("shard").agg(F.sum(weight).alias("all")).filter(F.col("all") > PART), "sizes")
    columns = ["id", "root", "n", "fp", "more"]
    whole = d.join(sizes, "shard", "left_anti").select(F.col("shard").cast("long").alias("unit"), F.lit(0).alias("side"), *columns)
    if sizes.isEmpty():
        return whole
    d = d.join(sizes, "shard")
    if stars:
        return whole.unionByName(d.select(F.xxhash64("shard", F.pmod(F.xxhash64("id"), F.ceil(F.col("all") / PART))).alias("unit"), F.lit(0).alias("side"), *columns))
    own = d.groupBy("shard", "root").agg(F.sum(weight).alias("own")).filter(F.col("own") > PART)
    d = d.join(own, ["shard", "root"], "left").withColumn("pure", F.when(F.col("own").isNotNull(), F.col("root")))
    part = F.when(F.col("own").isNotNull(), F.xxhash64("root", F.pmod(F.xxhash64("id"), F.ceil(F.col("own") / PART)))).otherwise(F.xxhash64(F.pmod(F.xxhash64("root"), F.ceil(F.col("all") / PART)), F.lit("mixed")))
    d = written(d.select("shard", part.alias("part"), "pure", *columns), "parts")
    parts = d.select("shard", "part", "pure").distinct()
    other = parts.select("shard", F.col("part").alias("part_b"), F.col("pure").alias("pure_b"))
    met = parts.join(other, "shard").filter((F.col("part") <= F.col("part_b")) & ~F.coalesce(F.col("pure") == F.col("pure_b"), F.lit(False)))
    sides = F.when(F.col("part") == F.col("part_b"), F.array(F.struct("part", F.lit(0).alias("side")))).otherwise(F.array(F.struct("part", F.lit(1).alias("side")), F.struct(F.col("part_b").alias("part"), F.lit(2).alias("side"))))
    dealt = met.select("shard", F.xxhash64("shard", "part", "part_b").alias("unit"), F.explode(sides).alias("s")).select("shard", "unit", "s.part", "s.side")
    return whole.unionByName(d.join(dealt, ["shard", "part"]).select("unit", "side", *columns))


def _searched(d: DataFrame, find: Callable[..., tuple[np.ndarray, np.ndarray]], stars: bool) -> DataFrame:
    """id, to: what `find` makes of the shards (unit, side, id, root, n, fp, more) of the sets (id, root, n, fp, more,
    shards)."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_units(it):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in find(*(c.to_numpy() for c in t.columns))], names=["id", "to"])

    units = _units(d.select("id", "root", "n", "fp", "more", F.explode("shards").alias("shard")), F.lit(SET), stars)
    dealt = units.repartition("unit").sortWithinPartitions("unit", "id").select("unit", "side", "id", "root", "n", "fp", "more")
    return mapped(dealt, batches, "id long, to long")


def star_pairs(d: DataFrame) -> DataFrame:
    """id, to: the distinct candidates of which one is the root of a shard's tree."""
    return _searched(d, lambda *columns: candidates(*columns, True), stars=True).distinct()


def near_links(d: DataFrame) -> DataFrame:
    """id, to: links of roots that hold together all candidates of different roots, whether they are alike or not."""
    return _searched(d, lambda unit, side, ids, *rest: root_links(unit, side, *rest), stars=False)


def _relabelled(d: DataFrame, sets: DataFrame) -> DataFrame:
    """`d` with the root of its root in the linked sets (fp, root)."""
    least = sets.select(F.col("fp").alias("root"), F.col("root").alias("least"))
    return d.join(least, "root", "left").withColumn("root", F.coalesce("least", "root")).drop("least")


def alike_sets(distinct: DataFrame, rows: DataFrame, file: str, place: str) -> DataFrame:
    """id, root: for the linked ones of the distinct shingle sets (id, first, n, fp, more, shards) the least of their
    links.

    In a few tables the root of each shard's tree is searched for first, which links dense groups without pairing them.
    Then the trees of all tables find which sets are near others that they are not linked to yet. Pairs stay in their
    tasks: what leaves them are links that hold the near sets together in groups, a few tables' first, so that the
    others' only join groups. Every candidate lies within a group, and there the whole sets decide."""
    d = distinct.filter(F.col("n") >= LEAST).select("id", F.col("id").alias("root"), "n", "fp", "more", "shards")
    found = written(star_pairs(d.withColumn("shards", F.slice("shards", 1, STARS))), "pairs")
    ids = found.select("id").unionByName(found.select(F.col("to").alias("id"))).distinct()
    stars = linked_sets(verified(found, written(shingle_sets(ids, distinct, rows, file, place), "sets")))
    d = _relabelled(d, stars).withColumn("star", F.col("root"))
    for first, many in ((1, STARS), (STARS + 1, len(TABLES) - STARS)):
        d = _relabelled(d, linked_sets(near_links(d.withColumn("shards", F.slice("shards", first, many)))))
    d = d.select(F.col("root").alias("shard"), "id", F.col("star").alias("root"), "n", "fp", "more")
    several = d.groupBy("shard").agg(F.min("root").alias("least"), F.max("root").alias("most")).filter("least != most")
    groups = written(d.join(several, "shard", "left_semi"), "groups")
    links = verified_groups(groups, written(shingle_sets(groups.select("id"), distinct, rows, file, place), "sets"))
    return linked_sets(links.unionByName(stars.select(F.col("fp").alias("id"), F.col("root").alias("to")))).select(F.col("fp").alias("id"), "root")


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of the documents that are linked, directly or over others, the one with the least doc_id stays.

    Rows are told apart by where they stand, not by doc_id: rows that share a doc_id are documents like any others, and
    those without one come last. Of equal rows the first stays. Texts without words are copies of each other."""
    file, place = fresh(docs, "file", "place")
    rows = numbered(docs, file, place)
    sketched = written(sketches(rows, file, place), "sketches")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "file", "place"))
    distinct = written(sketched.groupBy("id").agg(first.alias("first"), *[F.first(c).alias(c) for c in ("n", "fp", "more", "shards")]), "distinct")
    roots = written(alike_sets(distinct, rows, file, place), "roots")
    kept = distinct.select("id", "first").join(roots, "id", "left").groupBy(F.coalesce("root", "id").alias("root")).agg(F.min("first").alias("first"))
    kept = written(kept.select(F.col("first.file").alias(file), F.col("first.place").alias(place)), "kept")
    return rows.join(kept, [file, place], "left_semi").select(*docs.columns)

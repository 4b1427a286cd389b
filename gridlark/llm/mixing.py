"""Mixing sources to target weights: capped water-filling, then seeded whole and fractional repetitions."""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, fresh, numbered, read_table, text_or_empty, written

#: Production parameters.
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MAX_EPOCHS = 2
SEED = "mix-1"


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def fill_targets(sources: DataFrame, weights=WEIGHTS, share: float = SHARE, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Capped water-filling over one row a source (source, source_size): adds `target`.

    All sources share `share` of the total by weight (`weights` in turn, by code point of the name, null last). A
    source whose part exceeds `max_epochs` times its size is clamped there and the rest is shared anew, until none is
    above. Closed form: in order of cap per unit of weight, the clamped sources are a prefix, so one pass of running
    sums finds the level at which the others stand. This works on one row for each source, never on documents."""
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    weight = F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    s = sources.withColumn("weight", weight).withColumn("cap", F.col("source_size") * max_epochs)
    whole = Window.partitionBy()
    fill = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.col("source")).rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("_before_cap", F.coalesce(F.sum("cap").over(fill), F.lit(0))).withColumn("_before_weight", F.coalesce(F.sum("weight").over(fill), F.lit(0)))
    s = s.withColumn("_total", F.sum("source_size").over(whole) * F.lit(share)).withColumn("_weights", F.sum("weight").over(whole))
    # The level if exactly the sources before this one are clamped; the first source that stays under it sets the level.
    s = s.withColumn("_level", (F.col("_total") - F.col("_before_cap")) / (F.col("_weights") - F.col("_before_weight")))
    s = s.withColumn("_level", F.max(F.when(F.col("cap") > F.col("_level") * F.col("weight"), F.struct(-F.col("_before_weight"), F.col("_level").alias("level")))).over(whole)["level"])
    return s.withColumn("target", F.least(F.col("cap").cast("double"), F.coalesce(F.col("_level") * F.col("weight"), F.col("cap").cast("double")))).select("source", "source_size", "weight", "target")


def mix(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights=WEIGHTS, share: float = SHARE, max_epochs: int = MAX_EPOCHS, seed: str = SEED, row: str | None = None) -> DataFrame:
    """One row a document: key, source, size, source_size, target, taken.

    Every document is taken floor(target / source size) times whole; the words still missing come from the source's
    documents in the order of a seeded hash, each once more, the last one in part, so a source's taken words equal
    its target rounded down. Null text has size 0; null sources form one source. Rows of one key have one place in
    that order (ties: by size), so reruns agree; an empty table gives an empty one. `row` names a
    column that tells rows of one key apart: it breaks ties and is returned too.

    The order is made without bringing a source together: the hash is cut into buckets, whose sums (one row for a
    source and bucket) give each bucket's first word by a running sum; only documents within a bucket are sorted. The
    number of buckets is as the root of the number of documents, so that neither their number nor their size grows in
    proportion."""
    d = df.select(F.col(key).alias("key"), F.col(source).cast("string").alias("source"), word_count(text_or_empty(df, text)).alias("size"), *([F.col(row).alias("row")] if row else []))
    d = d.withColumn("draw", F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("key").cast("string"), F.lit("")))))
    d = written(d, "mix")
    own = ["row"] if row else []
    buckets = 16 + 2 * isqrt(d.count())
    d = d.withColumn("bucket", F.floor(F.conv(F.substring("draw", 1, 8), 16, 10).cast("long") * buckets / F.lit(2.0**32)).cast("int"))
    sums = d.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    by_source = fill_targets(sums.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, max_epochs)
    first = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumn("start", F.coalesce(F.sum("words").over(first), F.lit(0)))
    plan = starts.join(by_source, starts["source"].eqNullSafe(by_source["source"])).select(starts["source"], "bucket", "start", "source_size", "target")
    within = Window.partitionBy("source", "bucket").orderBy("draw", "size", "key", *own).rowsBetween(Window.unboundedPreceding, -1)
    placed = d.withColumn("before", F.coalesce(F.sum("size").over(within), F.lit(0)))
    j = placed.join(plan, placed["source"].eqNullSafe(plan["source"]) & (placed["bucket"] == plan["bucket"])).select(placed["key"], placed["source"], *own, "size", "source_size", "target", (F.col("start") + F.col("before")).alias("at"))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.floor("target") / F.col("source_size"))).otherwise(F.lit(0))
    more = F.floor("target") - epochs * F.col("source_size")
    taken = epochs * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), more - F.col("at")))
    return j.select(F.col("key").alias(key), F.col("source").alias(source), "size", "source_size", "target", taken.cast("long").alias("taken"), *([F.col("row").alias(row)] if row else []))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the words that the mix takes of it."""
    return mix(read_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: each document as often as the mix takes it, whole copies first, then the part's leading words.

    Documents of which nothing is taken go; a document of no words has nothing to take and stays once. Rows are told
    apart by where they stand, so that each has its own decision, whether or not it has a doc_id or shares one."""
    file, place, row, size, taken, part = fresh(docs, "file", "place", "row", "size", "taken", "part")
    own = F.struct(F.xxhash64("text").alias("hash"), F.col(file).alias("file"), F.col(place).alias("place"))
    d = numbered(docs, file, place).withColumn(row, own)
    plan = mix(d, row=row).select(F.col(f"{row}.file").alias(file), F.col(f"{row}.place").alias(place), F.col("size").alias(size), F.col("taken").alias(taken))
    j = d.drop(row).join(plan, [file, place])
    has = F.col(size) > 0
    epochs = F.when(has, F.floor(F.col(taken) / F.col(size))).otherwise(F.lit(1)).cast("int")
    left = F.when(has, F.col(taken) % F.col(size)).otherwise(F.lit(0))
    copies = F.concat(F.array_repeat(F.lit(-1).cast("long"), epochs), F.when(left > 0, F.array(left)).otherwise(F.array().cast("array<bigint>")))
    x = j.withColumn(part, F.explode(copies))
    whole = F.col(part) < 0
    cut = F.when(whole, F.col("text")).otherwise(cut_words(F.col("text"), F.col(part)))
    x = x.withColumn("text", cut).withColumn("n_chars", F.when(whole, F.col("n_chars")).otherwise(F.length("text").cast("long")))
    return x.select(*docs.columns)


def cut_words(text: Column, n: Column) -> Column:
    """The first n words of the text, joined by single spaces."""
    return F.concat_ws(" ", F.slice(F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1)), F.lit(1), n.cast("int")))


ORACLES = {
    "op3_mixing": r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size, md5('mix-1:' || doc_id) AS draw FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, 2 * source_size AS cap FROM s),
b AS (SELECT *, coalesce(sum(cap) OVER o, 0)::BIGINT AS before_cap, coalesce(sum(weight) OVER o, 0)::BIGINT AS before_weight, sum(source_size) OVER ()::BIGINT * 1.5::DOUBLE AS total, sum(weight) OVER ()::BIGINT AS weights
  FROM w WINDOW o AS (ORDER BY cap / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT *, (total - before_cap) / (weights - before_weight) AS level FROM b),
f AS (SELECT source, source_size, weight, cap, (SELECT arg_max(level, -before_weight) FROM l WHERE cap > level * weight) AS level FROM l),
t AS (SELECT source, source_size, least(cap::DOUBLE, coalesce(level * weight, cap::DOUBLE)) AS target FROM f),
p AS (SELECT doc_id, size, source_size, target, coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY draw, size, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS at_word,
  CASE WHEN source_size > 0 THEN floor(floor(target) / source_size)::BIGINT ELSE 0 END AS epochs
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size::BIGINT AS size, source_size, target, (epochs * size + greatest(0, least(size, floor(target)::BIGINT - epochs * source_size - at_word)))::BIGINT AS taken FROM p
"""
}
QUERIES = {"op3_mixing": op3_mixing}

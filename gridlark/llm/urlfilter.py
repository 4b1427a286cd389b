"""URL filters by a temporal list join: dated entries become validity intervals, captures are joined as of their fetch
time; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import fresh, read_table, written

HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"


def host_of(url: Column) -> Column:
    """The host in lower case without user, port and last dot; empty if there is none."""
    return F.regexp_replace(F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), HOST, 1)), r"\.$", "")


def intervals(entries: DataFrame) -> DataFrame:
    """kind, pattern, valid_from, valid_to (null: still valid) from dated entries (kind, pattern, listed_at, action).

    An `add` holds until the pattern's next entry; other actions end it. Of entries of one date the last by action
    holds ('remove' after 'add'). Entries without kind, pattern or date are left out. Patterns are lower-cased."""
    e = entries.filter("kind IS NOT NULL AND pattern IS NOT NULL AND listed_at IS NOT NULL").select("kind", F.lower("pattern").alias("pattern"), "listed_at", "action")
    one = e.groupBy("kind", "pattern", "listed_at").agg(F.max("action").alias("action"))
    after = F.lead("listed_at").over(Window.partitionBy("kind", "pattern").orderBy("listed_at"))
    return one.withColumn("valid_to", after).filter("action = 'add'").select("kind", "pattern", F.col("listed_at").alias("valid_from"), "valid_to")


def filter_urls(captures: DataFrame, entries: DataFrame, url: str = "url", fetched: str = "fetched_at") -> DataFrame:
    """Adds n_active, the number of list entries active at the capture's fetch time that match its host, and blocked.

    An entry of kind `host` matches that host alone, one of kind `domain` the domain and all below it. It is active
    from its date on (inclusive) to the pattern's next entry (exclusive). A capture without a host or fetch time
    matches nothing. Repeated captures are judged alike; columns named n_active or blocked are replaced. Empty captures
    give an empty result; with an empty list nothing is blocked.

    Lists are matched with distinct hosts, not with captures: each host's intervals become one array (as long as the
    entries for its few suffixes), captures get it by one equi-join on the host, in which Spark broadcasts the hosts
    if they are small and splits a hot host otherwise, and the as-of test runs inside the array. So no capture is
    multiplied and none is grouped."""
    captures = captures.drop("n_active", "blocked")
    h, active = fresh(captures, "host", "active")
    named = captures.withColumn(h, host_of(F.col(url)))
    hosts = named.select(F.col(h).alias("host")).filter("host != ''").distinct()
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.struct(F.lit("domain").alias("kind"), F.array_join(F.slice(labels, i, F.size(labels)), ".").alias("pattern")))
    keys = hosts.select("host", F.explode(F.array_append(suffixes, F.struct(F.lit("host").alias("kind"), F.col("host").alias("pattern")))).alias("k")).select("host", "k.kind", "k.pattern")
    by_host = keys.join(intervals(entries), ["kind", "pattern"]).groupBy("host").agg(F.collect_list(F.struct("valid_from", "valid_to")).alias(active))
    # Written first, so that its size is known when the join is planned.
    j = named.join(written(by_host.withColumnRenamed("host", h), "hosts"), h, "left")
    holds = F.filter(active, lambda x: (x["valid_from"] <= F.col(fetched)) & (x["valid_to"].isNull() | (F.col(fetched) < x["valid_to"])))
    n = F.coalesce(F.size(holds), F.lit(0))
    return j.withColumn("n_active", F.when(F.col(active).isNull(), 0).otherwise(n).cast("int")).withColumn("blocked", F.col("n_active") > 0).drop(h, active)


def dated_captures(pages: DataFrame) -> DataFrame:
    """Captures of the pages table, which has no fetch times: one by a hash of page_id, within 2024."""
    second = F.conv(F.substring(F.md5(F.concat(F.lit("fetch:"), F.col("page_id").cast("string"))), 1, 8), 16, 10).cast("long") % (366 * 86400)
    return pages.select("page_id", "url", F.timestamp_seconds(F.lit(1704067200) + second).alias("fetched_at"))


def dated_entries(pages: DataFrame) -> DataFrame:
    """A dated list made from the hosts of the pages table: a third of the domains are added, removed and, every other
    one, added again, by hashes of the domain; every fourth of these as a host only."""
    d = pages.select(F.regexp_replace(host_of(F.col("url")), r"^(www|m|blog)\.", "").alias("pattern")).filter("pattern != ''").distinct()
    part = lambda at: F.conv(F.substring(F.md5(F.concat(F.lit("list:"), F.col("pattern"))), at, 4), 16, 10).cast("long")
    d = d.select("pattern", part(1).alias("a"), part(5).alias("b"), part(9).alias("c")).filter("a % 3 = 0")
    day = lambda n: F.timestamp_seconds(F.lit(1704067200) + n * 86400)
    dates = F.array(
        F.struct(day(F.col("b") % 200).alias("listed_at"), F.lit("add").alias("action")),
        F.struct(day(F.col("b") % 200 + 30 + F.col("c") % 60).alias("listed_at"), F.lit("remove").alias("action")),
        F.struct(F.when(F.col("c") % 2 == 0, day(F.col("b") % 200 + 120 + F.col("c") % 60)).alias("listed_at"), F.lit("add").alias("action")),
    )
    return d.select(F.when(F.col("b") % 4 == 0, "host").otherwise("domain").alias("kind"), "pattern", F.explode(dates).alias("e")).select("kind", "pattern", "e.listed_at", "e.action").filter("listed_at IS NOT NULL")


def op6_urlfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's capture against the list entries active at its fetch time."""
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url")
    return filter_urls(dated_captures(pages), dated_entries(pages)).select("page_id", "url", F.unix_seconds("fetched_at").alias("fetched_s"), "n_active", "blocked")


QUERIES = {"op6_urlfilter": op6_urlfilter}
ORACLES = {
    "op6_urlfilter": r"""
WITH c AS (SELECT page_id, url, regexp_replace(lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)), '\.$', '') AS host,
  1704067200 + ('0x' || substr(md5('fetch:' || page_id), 1, 8))::BIGINT % (366 * 86400) AS fetched_s FROM pages),
d AS (SELECT DISTINCT regexp_replace(host, '^(www|m|blog)\.', '') AS pattern FROM c),
h AS (SELECT pattern, ('0x' || substr(md5('list:' || pattern), 1, 4))::BIGINT AS a, ('0x' || substr(md5('list:' || pattern), 5, 4))::BIGINT AS b, ('0x' || substr(md5('list:' || pattern), 9, 4))::BIGINT AS c FROM d WHERE pattern <> ''),
l AS (SELECT * FROM h WHERE a % 3 = 0),
e AS (SELECT pattern, b, 1704067200 + 86400 * (b % 200) AS since, true AS adds FROM l
  UNION ALL SELECT pattern, b, 1704067200 + 86400 * (b % 200 + 30 + c % 60), false FROM l
  UNION ALL SELECT pattern, b, 1704067200 + 86400 * (b % 200 + 120 + c % 60), true FROM l WHERE c % 2 = 0),
i AS (SELECT *, lead(since) OVER (PARTITION BY pattern ORDER BY since) AS until FROM e),
m AS (SELECT c.page_id, count(*) AS n FROM c JOIN i ON i.adds AND (c.host = i.pattern OR i.b % 4 <> 0 AND ends_with(c.host, '.' || i.pattern)) AND c.fetched_s >= i.since AND (i.until IS NULL OR c.fetched_s < i.until) GROUP BY c.page_id)
SELECT c.page_id, c.url, c.fetched_s, coalesce(m.n, 0)::INTEGER AS n_active, coalesce(m.n, 0) > 0 AS blocked FROM c LEFT JOIN m USING (page_id)
"""
}

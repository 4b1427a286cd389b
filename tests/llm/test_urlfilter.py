from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from gridlark.llm import urlfilter as U

SMALL = "/root/testdata/sf0.001"


def test_query_equals_sql(same):
    same(U.op6_urlfilter, U.ORACLES["op6_urlfilter"])


def day(n: int) -> datetime:
    return datetime(2024, 1, n)


ENTRIES = [
    ("domain", "Bad.com", day(5), "add"), ("domain", "bad.com", day(10), "remove"), ("domain", "bad.com", day(20), "add"), ("domain", "bad.com", day(20), "add"),
    ("host", "www.bad.com", day(3), "add"), ("domain", "com", day(8), "add"), ("domain", "com", day(8), "remove"), ("host", None, day(1), "add"), ("domain", "late.org", None, "add"), (None, "x.org", day(1), "add"),
]


def active(host: str, at: datetime | None) -> int:
    """Brute force: for each pattern that matches, the last entry not after the capture."""
    n = 0
    if not host or at is None:
        return 0
    for kind, pattern in {(k, p.lower()) for k, p, d, _ in ENTRIES if k and p and d}:
        if host == pattern or kind == "domain" and host.endswith("." + pattern):
            past = sorted((d, a) for k, p, d, a in ENTRIES if k == kind and p and d and p.lower() == pattern and d <= at)
            n += bool(past) and past[-1][1] == "add"
    return n


URLS = ["http://bad.com/x", "https://WWW.Bad.com:80/y?z", "http://u:p@a.b.bad.com./", "http://notbad.com", "ftp://late.org/", "", None, "nonsense", "http://x.org#f"]


def test_odd_rows(spark):
    rows = [(i, u, day(d) if d else None, "q") for i, u in enumerate(URLS) for d in (None, 1, 3, 5, 9, 10, 19, 20, 25)] * 2
    captures = spark.createDataFrame(rows, "id int, url string, fetched_at timestamp, host string")
    entries = spark.createDataFrame(ENTRIES, "kind string, pattern string, listed_at timestamp, action string")
    out = U.filter_urls(captures, entries)
    assert out.columns == ["id", "url", "fetched_at", "host", "n_active", "blocked"]
    got = out.withColumn("h", U.host_of(F.col("url"))).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["n_active"] == active(r["h"], r["fetched_at"]) and r["blocked"] == (r["n_active"] > 0)
    assert U.filter_urls(captures.limit(0), entries).count() == 0
    assert U.filter_urls(captures, entries.limit(0)).filter("blocked").count() == 0


def test_long_url(spark):
    captures = spark.createDataFrame([("http://" + "a." * 50 + "bad.com/" + "x" * 500_000, day(6))], "url string, fetched_at timestamp")
    assert U.filter_urls(captures, spark.createDataFrame(ENTRIES, "kind string, pattern string, listed_at timestamp, action string")).first()["n_active"] == 1


def test_no_python_in_the_plan(spark):
    plan = U.op6_urlfilter(spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Nested" not in plan and "Cartesian" not in plan and "html" not in plan

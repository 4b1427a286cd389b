from __future__ import annotations

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from gridlark.session import session  # noqa: E402

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark():
    s = session(4, 4, "4g")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        p = f"{SMALL}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return con


@pytest.fixture(scope="session")
def same(spark, duck):
    """Checks a query against its SQL on the small tables: equal rows in any order."""

    def check(query, sql: str) -> None:
        a, b = query(spark, SMALL).toPandas(), duck.sql(sql).df()
        columns = sorted(a.columns)
        assert columns == sorted(b.columns)
        assert len(a) == len(b)
        text = lambda x: x[columns].sort_values(columns).reset_index(drop=True).apply(lambda c: c.astype(str).replace({"None": "nan", "<NA>": "nan"}))
        assert text(a).equals(text(b))

    return check

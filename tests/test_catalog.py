"""Every query with SQL gives the SQL's rows on the small tables; the others give rows."""

from __future__ import annotations

import pytest

from gridlark import catalog

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_sql(same, name):
    same(catalog.QUERIES[name], catalog.ORACLES[name])


@pytest.mark.parametrize("name", sorted(catalog.QUERIES.keys() - catalog.ORACLES.keys()))
def test_query_without_sql_gives_rows(spark, name):
    assert catalog.QUERIES[name](spark, SMALL).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert e.oracle_sql().keys() <= e.queries().keys() and catalog.QUERIES.keys() <= e.queries().keys()


def test_walks_start_from_every_node(spark):
    nodes = spark.read.parquet(f"{SMALL}/events.parquet").select("event_id").distinct().count()
    assert catalog.QUERIES["parent_chain"](spark, SMALL).count() == nodes


def test_frames_are_given_to_all_points(spark):
    many = spark.read.parquet(f"{SMALL}/lineitem.parquet").count()
    assert catalog.QUERIES["frame_and_intensity"](spark, SMALL).count() == many


def test_projection_takes_all_points(spark):
    many = spark.read.parquet(f"{SMALL}/lineitem.parquet").count()
    assert catalog.QUERIES["xyz_only"](spark, SMALL).count() == many

"""Every query with an SQL text gives the same rows as that text in another engine."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry_points

SF_DIR = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.01")
TABLES = "region nation customer supplier part orders lineitem events documents conversations".split()
QUERIES = entry_points.queries()
ORACLE = entry_points.oracle_sql()


@pytest.fixture(scope="module")
def other_engine():
    connection = duckdb.connect()
    for name in TABLES:
        connection.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return connection


def _rows(table):
    names = sorted(table.column_names)

    def plain(value):
        if isinstance(value, float):
            return None if math.isnan(value) else value + 0.0
        return value

    return names, sorted((tuple(plain(r[n]) for n in names) for r in table.to_pylist()), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_rows(spark, other_engine, name):
    names, ours = _rows(QUERIES[name](spark, SF_DIR).toArrow())
    other_names, theirs = _rows(other_engine.sql(ORACLE[name]).to_arrow_table())
    assert names == other_names
    assert len(ours) > 0
    assert ours == theirs


def test_every_text_has_its_query():
    assert set(ORACLE) <= set(QUERIES)


def test_random_holdout_is_a_fifth_and_does_not_depend_on_partitioning(spark):
    from stintlake.operators import wear_model
    from stintlake.plans import fixtures

    laps = fixtures.silver_laps(spark, "/root/testdata/sf0.001")
    one = wear_model.random_holdout(laps.repartition(3))
    two = wear_model.random_holdout(laps.repartition(7, "Driver"))
    assert one.exceptAll(two).isEmpty()
    share = one.where("validation").count() / one.count()
    assert 0.15 < share < 0.25


def test_entry(spark):
    assert entry_points.entry(spark).count() > 0

"""Every registered query against its SQL in DuckDB."""

import os

import duckdb
import pytest

import __spark_entry__ as driver
from flowgauge.catalog import REGISTERED as QUERIES
from tests.conftest import TESTDATA
from tests.helpers import unordered

ORACLE = driver.own_sql()


@pytest.fixture(scope="module", params=["0.001", "0.01"])
def scale(request):
    path = f"{TESTDATA}/sf{request.param}"
    connection = duckdb.connect()
    connection.sql(f"CREATE VIEW events AS SELECT * FROM '{path}/events.parquet'")
    yield path, connection
    connection.close()


def test_every_query_has_its_sql():
    assert QUERIES.keys() == ORACLE.keys()


@pytest.mark.parametrize("name", QUERIES)
def test_query_equals_sql(spark, scale, name):
    path, connection = scale
    found = QUERIES[name](spark, path)
    wanted = connection.sql(ORACLE[name])
    columns = sorted(found.columns)
    assert columns == sorted(wanted.columns)
    quoted = ", ".join(f'"{c}"' for c in columns)
    rows = connection.sql(f"SELECT {quoted} FROM ({ORACLE[name]})").fetchall()
    assert unordered(tuple(r) for r in found.select(*columns).collect()) == unordered(rows)


@pytest.mark.parametrize("name", ["hourly_rollup", "peak_hour", "hourly_matrix"])
def test_ordered_outputs_are_in_order(spark, scale, name):
    path, connection = scale
    found = QUERIES[name](spark, path)
    quoted = ", ".join(f'"{c}"' for c in found.columns)
    wanted = connection.sql(f"SELECT {quoted} FROM ({ORACLE[name]})").fetchall()
    assert [tuple(r) for r in found.collect()] == wanted


def test_entry(spark):
    flagship = driver.entry(spark)
    assert flagship.count() > 0
    assert flagship.columns[0] == "sensor_id"


def test_nothing_else_needs_the_training_data_operators():
    root = os.path.join(os.path.dirname(os.path.dirname(__file__)), "flowgauge")
    for folder, _, files in os.walk(root):
        if os.path.basename(folder) == "llm":
            continue
        for file in files:
            if file.endswith(".py"):
                with open(os.path.join(folder, file)) as source:
                    assert "flowgauge.llm" not in source.read(), file

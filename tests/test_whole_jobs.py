"""Queries over all rows of their tables, compared with their SQL on rows made here."""

import duckdb
import pytest

import __spark_entry__
from test_queries import in_order

KINDS = ("click", "view", "purchase", "signup", "error")
EVENTS = [(n, n % 7, KINDS[n % 5], n * 37 % 50 / 4, n * 600) for n in range(200)]
LINES = [(n // 4 + 1, n % 4 + 1, n, n * 5 % 31) for n in range(1, 120)]


@pytest.fixture
def folder(spark, tmp_path):
    events = spark.createDataFrame(EVENTS, "event_id long, user_id long, event_type string, value double, s long")
    events = events.selectExpr("event_id", "user_id", "event_type", "value", "timestamp_ntz'2024-01-01' + make_dt_interval(0,0,0,s) as ts", "concat('{\"k\":', event_id, '}') as props")
    events.write.parquet(f"{tmp_path}/events.parquet")
    lines = spark.createDataFrame(LINES, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long")
    lines.write.parquet(f"{tmp_path}/lineitem.parquet")
    return str(tmp_path)


def both(spark, folder, name):
    database = duckdb.connect()
    for table in ("events", "lineitem"):
        database.execute(f"create view {table} as select * from '{folder}/{table}.parquet/*.parquet'")
    result = database.execute(__spark_entry__.oracle_sql()[name])
    columns = [column[0] for column in result.description]
    found = __spark_entry__.queries()[name](spark, folder)
    return found, in_order(found.select(*columns).collect()), in_order(result.fetchall())


def test_counters_of_every_series_are_totalled(spark, folder):
    found, rows, expected = both(spark, folder, "counter_total")
    assert rows == expected
    assert {row["plugin"] for row in found.collect()} == {"load", "memory", "interface-eth0", "df-root", "swap"}


def test_dumps_of_every_order_line_are_diagnosed(spark, folder):
    found, rows, expected = both(spark, folder, "job_diagnostics")
    assert rows == expected
    # Also the orders of which no part is divisible by three.
    assert found.count() == len({order for order, _, _, supplier in LINES if supplier % 9})

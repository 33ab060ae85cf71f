"""Registered queries against their SQL; ``OPSIGHT_ALL=1`` runs every one of them."""

import datetime
import decimal
import importlib
import math
import os

import duckdb
import pytest

import __spark_entry__

SF_DIR = "/root/testdata/sf0.001"
NAMES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SAMPLE = ["daily_stats", "event_scan", "failure_examples", "coverage_top", "collection_failures", "process_report", "window_job_report", "job_findings", "recovery_plan", "metric_daily", "host_snapshot", "queue_alert", "missing_status_vetoed"]
QUERIES, SQL = __spark_entry__.queries(), __spark_entry__.oracle_sql()


def plain(value):
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.9g}")
    if isinstance(value, (datetime.date, datetime.datetime)):
        return value.isoformat()
    return value


def in_order(rows):
    return sorted((tuple(map(plain, row)) for row in rows), key=lambda row: [(v is not None, str(v)) for v in row])


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables are not here")
@pytest.mark.parametrize("name", list(SQL) if os.environ.get("OPSIGHT_ALL") else SAMPLE)
def test_query_equals_its_sql(spark, name):
    database = duckdb.connect()
    for table in NAMES:
        database.execute(f"create view {table} as select * from '{SF_DIR}/{table}.parquet'")
    found = QUERIES[name](spark, SF_DIR)
    columns = sorted(found.columns)
    result = database.execute(SQL[name])
    named = [column[0] for column in result.description]
    assert sorted(named) == columns
    places = [named.index(column) for column in columns]
    expected = [[row[at] for at in places] for row in result.fetchall()]
    assert in_order(found.select(*columns).collect()) == in_order(expected)


def test_every_query_of_the_library_has_sql():
    own = {name for module in __spark_entry__.MODULES for name in importlib.import_module(f"opsight.checks.{module}").REGISTRY}
    assert own <= set(QUERIES) and own <= set(SQL)
    assert len(own) > 100

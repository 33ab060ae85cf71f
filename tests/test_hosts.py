import gzip
import random
import time
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from opsight.operators import metrics, queue
from opsight.params import TimeRange
from opsight.sources import keyed
from opsight.sources import metrics as metric_source
from opsight.sources import queue as queue_source

UTC = timezone.utc
NOW = datetime(2026, 8, 20, 12, tzinfo=UTC)


SERIES = {"load": ("load", "shortterm"), "memory": ("memory-used", "value"), "df-root": ("percent_bytes-used", "value"), "interface-eth0": ("if_octets", "rx"), "swap": ("swap-used", "value")}
LONG = "host string, plugin string, metric string, column string, ts timestamp, date date, value double"


def samples(spark, rows):
    """(plugin, minutes from now, value) or (plugin, minutes, value, column) on one host."""
    data = []
    for plugin, minutes, value, *column in rows:
        at = NOW.replace(tzinfo=None) + timedelta(minutes=minutes)
        metric, usual = SERIES[plugin]
        data.append(("h", plugin, metric, column[0] if column else usual, at, at.date(), float(value)))
    return spark.createDataFrame(data, LONG)


def test_metric_files(spark, tmp_path):
    folder = tmp_path / "node7" / "load"
    folder.mkdir(parents=True)
    (folder / "load-2026-08-19").write_text("epoch,shortterm,midterm,longterm\n1787140800.5,1,2,3\n1787140860,,2,3\n")
    with gzip.open(folder / "load-2026-08-18.gz", "wt") as stream:
        stream.write("epoch,shortterm,midterm,longterm\n1787054400,4,5,6\n")
    disk = tmp_path / "node8" / "df-srv-data"
    disk.mkdir(parents=True)
    (disk / "percent_bytes-used-2026-08-19").write_text("epoch,value\n1787140800,70.5\n")
    found = metric_source.read_metrics(spark, str(tmp_path))
    assert found.count() == 9
    row = found.where("column = 'shortterm' and date = '2026-08-18'").first()
    assert (row["host"], row["plugin"], row["metric"], row["value"]) == ("node7", "load", "load", 4.0)
    assert metric_source.read_metrics(spark, str(tmp_path), dates=[datetime(2026, 8, 18).date()]).count() == 3
    assert metric_source.read_metrics(spark, str(tmp_path / "none")).count() == 0
    # From the files to the summary, without a step between.
    summary = {(r["host"], str(r["period"])[:10]): r for r in metrics.period_summary(found, disk_plugin=metric_source.disk_plugin("/srv/data")).collect()}
    assert (summary["node7", "2026-08-19"]["load_min"], summary["node7", "2026-08-19"]["load_max"]) == (1.0, 1.0)
    assert summary["node8", "2026-08-19"]["disk_max"] == 70.5
    path = str(tmp_path / "stored")
    metric_source.write_metrics(found, path)
    chosen = metrics.select_metrics(spark.read.parquet(path), TimeRange(datetime(2026, 8, 19, tzinfo=UTC)), ["load"])
    assert chosen.count() == 5
    plan = chosen._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(date" in plan.replace("plugin#", "") or "date" in plan.split("PartitionFilters")[1][:200]


def test_long_folder_names_do_not_slow_the_reading_down(spark, tmp_path):
    def seconds(root):
        folder = root / "node7" / "load"
        folder.mkdir(parents=True)
        lines = [f"{1787140800 + n},{n},2,3\n" for n in range(20_000)]
        (folder / "load-2026-08-19").write_text("epoch,shortterm,midterm,longterm\n" + "".join(lines))
        found = metric_source.read_metrics(spark, str(root))
        begun = time.monotonic()
        row = found.groupBy("host", "plugin", "metric").agg(F.count("value").alias("n"), F.max("date").alias("date")).first()
        assert (row["host"], row["plugin"], row["metric"], str(row["date"]), row["n"]) == ("node7", "load", "load", "2026-08-19", 60_000)
        return time.monotonic() - begun

    seconds(tmp_path / "first")
    assert seconds(tmp_path / ("long-" * 40)) < 4 * seconds(tmp_path / "short") + 2


def test_series_of_one_plugin_are_not_mixed(spark):
    rows = samples(spark, [("load", -3, 1), ("load", -2, 5, "midterm"), ("load", -1, 9, "longterm"), ("load", -2, 3)])
    row = metrics.period_summary(rows).first()
    assert (row["load_min"], row["load_max"]) == (1.0, 3.0)
    latest = {r["column"]: r["value"] for r in metrics.metric_latest(rows, NOW).collect()}
    assert latest == {"shortterm": 3.0, "midterm": 5.0, "longterm": 9.0}


def test_summaries_replace_their_period_and_stay_in_order(spark, tmp_path):
    path = str(tmp_path / "table")
    assert keyed.read_keyed(spark, path) is None

    def run(*days):
        rows = samples(spark, [item for day, load in days for item in (("load", day * 1440, load), ("interface-eth0", day * 1440, 0), ("interface-eth0", day * 1440 + 5, 3 * 2**30))])
        metrics.store_summary(metrics.summary_lines(metrics.period_summary(rows)), path)

    run((0, 1.25), (-2, 2))
    run((-1, 3), (0, 4))
    run((0, 4))
    rows = keyed.read_keyed(spark, path).collect()
    assert [(r["label"], r["load_min"]) for r in rows] == [("2026-08-18", 2.0), ("2026-08-19", 3.0), ("2026-08-20", 4.0)]
    assert rows[2]["line"] == "2026-08-20  load_min=4.0  load_max=4.0  disk_min=NA  disk_max=NA  mem_min=NA  mem_max=NA  eth0_rx=3.0 GiB"
    assert len([p for p in (tmp_path / "table").iterdir() if p.name.startswith("version-")]) == 2
    hourly = metrics.summary_lines(metrics.period_summary(samples(spark, [("load", 1, 1.25)]), "hour"), "hour").first()
    assert hourly["line"].startswith("2026-08-20T12:00  load_min=1.25  ")


def test_null_keys_replace_null_keys(spark, tmp_path):
    path = str(tmp_path / "t")
    keyed.replace_by_key(spark.createDataFrame([(None, 1), ("a", 1), ("b", 1)], "k string, v int"), path, ["k"], ["k"])
    keyed.replace_by_key(spark.createDataFrame([(None, 2), ("b", 2), ("b", 3)], "k string, v int"), path, ["k"], ["k", "v"])
    assert [tuple(r) for r in keyed.read_keyed(spark, path).collect()] == [(None, 2), ("a", 1), ("b", 2), ("b", 3)]


def test_files_with_other_columns_are_refused(spark, tmp_path):
    (tmp_path / "load-2026-08-19").write_text("epoch,value\n1,2\n")
    with pytest.raises(Exception):
        metric_source.read_metric_csv(spark, str(tmp_path), ["shortterm"]).collect()


def test_hours_are_half_open(spark):
    rows = samples(spark, [("load", -1 / 60, 9), ("load", 0, 1), ("load", 59.9, 4), ("load", 60, 8)])
    found = metrics.period_summary(rows, "hour").orderBy("period").collect()
    assert [(r["load_min"], r["load_max"]) for r in found] == [(9.0, 9.0), (1.0, 4.0), (8.0, 8.0)]
    assert found[0]["memory_min"] is None and found[0]["received"] is None


def test_counters_match_a_plain_loop(spark):
    random.seed(3)
    for period in ("day", "hour"):
        readings = [(random.uniform(0, 2000), random.randint(0, 500)) for _ in range(300)]
        rows = samples(spark, [("interface-eth0", m, v) for m, v in readings])
        found = {r["period"]: r["total"] for r in metrics.counter_total(rows, period).collect()}
        expected, previous = {}, {}
        for minute, value in sorted(readings):
            at = NOW.replace(tzinfo=None) + timedelta(minutes=minute)
            key = at.replace(minute=0, second=0, microsecond=0)
            key = key.replace(hour=0) if period == "day" else key
            last = previous.get(key)
            grown = 0 if last is None else (value if value < last else value - last)
            expected[key] = expected.get(key, 0) + grown
            previous[key] = value
        assert found == expected


def test_window_latest_and_freshness(spark):
    rows = samples(spark, [("load", -90, 1), ("load", -60, 2), ("load", -1, 5), ("memory", -30, 7), ("memory", -3000, 1), ("swap", 1, 3)])
    window = {r["plugin"]: r for r in metrics.metric_window(rows, NOW - timedelta(hours=1), NOW).collect()}
    assert (window["load"]["count"], window["load"]["current"], window["load"]["change"], window["load"]["average"]) == (2, 5.0, 3.0, 3.5)
    latest = metrics.metric_latest(rows, NOW)
    assert {r["plugin"]: r["value"] for r in latest.collect()} == {"load": 5.0, "memory": 7.0, "swap": 3.0}
    row = metrics.metric_freshness(latest, NOW, 720).first()
    assert (row["age_seconds"], row["fresh"]) == (1800.0, True)
    assert not metrics.metric_freshness(latest, NOW, 719).first()["fresh"]


def test_memory_and_filesystems(spark):
    latest = metrics.metric_latest(samples(spark, [("memory", -1, 25)]), NOW)
    captured = spark.createDataFrame([("h", 100, 40, 10, 12), ("i", 100, 40, 0, None), ("j", None, 1, 5, 2)], "host string, total long, available long, swap_total long, swap_free long")
    usage = {r["host"]: r for r in metrics.memory_usage(captured, latest).collect()}
    assert (usage["h"]["used"], usage["h"]["percent"], usage["h"]["swap_used"]) == (25.0, 25.0, 0)
    assert (usage["i"]["used"], usage["i"]["swap_percent"]) == (60.0, None)
    assert (usage["j"]["used"], usage["j"]["swap_percent"]) == (None, 60.0)
    mounts = spark.createDataFrame([("h", 0, "/", 1, 10, 5), ("h", 1, "/same", 1, 10, 5), ("h", 2, "/gone", 1, None, None), ("h", 3, "/lost", 1, None, None), ("h", 4, "/zero", 2, 0, 0)], "host string, position int, path string, device int, total long, used long")
    rows = {r["path"]: (r["percent"], r["error"]) for r in metrics.filesystem_usage(mounts).collect()}
    assert rows == {"/": (50.0, None), "/gone": (None, "unavailable"), "/lost": (None, "unavailable"), "/zero": (0.0, None)}
    snapshot = metrics.host_snapshot(samples(spark, [("load", -1, 2)]), captured, mounts, NOW, timedelta(hours=1), 60).orderBy("host").collect()
    assert len(snapshot) == 3 and snapshot[0]["load"] == 2.0 and not snapshot[1]["fresh"]
    assert (snapshot[0]["load_count"], snapshot[1]["age_seconds"]) == (1, None)


def test_snapshot_scans_the_metrics_once(spark, tmp_path):
    path = str(tmp_path / "m")
    metric_source.write_metrics(samples(spark, [("load", -1, 2), ("memory", -5, 8), ("df-root", -2, 50), ("load", -5000, 9)]), path)
    captured = spark.createDataFrame([("h", 16, 4, 10, 12)], "host string, total long, available long, swap_total long, swap_free long")
    mounts = spark.createDataFrame([("h", 0, "/", 1, 10, 5)], "host string, position int, path string, device int, total long, used long")
    snapshot = metrics.host_snapshot(spark.read.parquet(path), captured, mounts, NOW, timedelta(hours=1), 60)
    plan = snapshot._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parquet") == 1
    row = snapshot.first()
    assert (row["load"], row["used"], row["disk_max"], row["load_count"], row["age_seconds"], row["fresh"]) == (2.0, 8.0, 50.0, 1, 300.0, False)


def lines(spark, *values):
    return spark.createDataFrame([(NOW.replace(tzinfo=None), v) for v in values], "snapshot_ts timestamp, value string")


def test_queue_rows_and_pressure(spark):
    rows = queue_source.queue_jobs(lines(spark, "1|RUNNING|05:30", "2 | RUNNING | 04:00:00", "3|PENDING|0:00", "4|PENDING|bad", "", "5|DONE|0:01", "6|RUNNING|1:99", "7|RUNNING", "8||0:01", "9|RUNNING|1:00|x"))
    problems = {r["job_id"]: r["problem"] for r in rows.collect()}
    assert problems == {"1": None, "2": None, "3": None, "4": None, "5": "unexpected state", "6": "invalid elapsed time", "7": "invalid line", "8": "invalid line", "9": "invalid line"}
    row = queue.queue_pressure(rows.where("problem is null"), 14400, 2).first()
    assert (row["running"], row["pending"], row["long_running"], row["total"], row["is_critical"]) == (2, 2, 1, 4, True)


def test_capacity_and_alert_priority(spark):
    good = ["n1|up|idle|none", "n2|up|mixed-|none", "n3|UP|allocated+|", "n4|up|completing|none"]
    bad = ["b1|down|idle|none", "b2|up|idle*|none", "b3|up|drained|disk", "b4|up|allocated*+|"]
    snapshots = lines(spark, "x")
    nodes = queue_source.capacity(lines(spark, *good, *bad, "x|y"))
    assert nodes.where("problem is not null").count() == 1
    nodes = nodes.where("problem is null")
    issues = queue.capacity_issues(nodes, snapshots)
    assert sorted(r["node"] for r in issues.collect()) == ["b1", "b2", "b3", "b4"]
    assert "reason=none" in issues.where("node = 'b4'").first()["issue"]
    empty = queue.capacity_issues(nodes.where("false"), snapshots)
    assert [r["issue"] for r in empty.collect()] == ["reason=no-capacity-records"]
    pressure = queue.queue_pressure(queue_source.queue_jobs(lines(spark, "1|PENDING|0:00", "2|PENDING|0:00")), 1, 2)
    healthy = queue.capacity_issues(nodes.where("node like 'n%'"), snapshots)
    first = queue.queue_alert(pressure, issues, 2).first()
    assert (first["status"], first["reason"], first["issues"], first["pending"]) == ("red", "slurm-capacity-unavailable", 4, None)
    full = queue.queue_alert(pressure, healthy, 2).first()
    assert (full["reason"], full["pending"], full["threshold"]) == ("pending-queue-full", 2, 2)
    assert queue.queue_alert(pressure.withColumn("is_critical", F.lit(False)), healthy, 2).first()["status"] == "clear"


def test_memory_of_batch_steps(spark):
    usage = queue_source.step_usage(lines(spark, "1.batch|512K", "1.0|9G", "2.batch|", "short"))
    jobs = spark.createDataFrame([(NOW.replace(tzinfo=None), "1", "1M"), (NOW.replace(tzinfo=None), "2", "1G"), (NOW.replace(tzinfo=None), "3", "0")], "snapshot_ts timestamp, job_id string, memory_limit string")
    rows = {r["job_id"]: (r["used_bytes"], r["used_percent"]) for r in queue.queue_memory_usage(jobs, usage).collect()}
    assert rows == {"1": (524288, 50.0), "2": (None, None), "3": (None, None)}

from datetime import date, datetime, timedelta, timezone

from pyspark.sql import functions as F

from helpers import FAILED, events_of, operation, request, status_xml
from opsight.functions import jobs as job_columns
from opsight.operators import coverage, daily, dbreport, findings
from opsight.params import StatusCodes, Thresholds, parse_time_range
from opsight.plans import activity, statistics
from opsight.session import scratch_path
from opsight.sources import access_log, dumps, incidents, status_xml as xml
from opsight.sources import jobs as job_source

UTC = timezone.utc
CODES = StatusCodes(accepted=0, started=1, paused=2, succeeded=3, failed=4, dismissed=5)
JOB = "uuid string, identifier string, status int, start string, end string, message string"


def job_table(spark, *rows):
    table = spark.createDataFrame([tuple(r) + (None,) * (6 - len(r)) for r in rows], JOB)
    return table.select("uuid", F.lit("execute").alias("operation"), "identifier", "status", F.col("start").cast("timestamp_ntz").alias("time_start"), F.col("end").cast("timestamp_ntz").alias("time_end"), "message")


def test_null_values_are_values(spark):
    events = events_of(spark, [request("1", inputs={"d": [{"type": "LiteralData", "value": None}]})])
    assert coverage.coverage_counts(events).first()["value"] == "null"


def test_daily_row_matches_hand_counts(spark):
    records = [
        request("one"),
        request("two", "failed", "Detected an oom-kill event", duration_seconds=-5),
        request("three", "failed", "Cancelled due to time limit"),
        request("four", "failed", "stalled-job recovery found no database update for at least 30 minutes"),
        request("odd", record_type="odd"),
        request("undated", finished_at=None),
        operation("job-recovered", "two"),
        operation("job-long-running", "four"),
        operation("job-long-running", "four", recorded_at="2026-08-19T13:00:00Z"),
    ]
    row = daily.daily_statistics(events_of(spark, records)).first()
    assert str(row["date"]) == "2026-08-19"
    assert (row["requests"], row["successful"], row["failed"]) == (4, 1, 3)
    assert (row["memory_failures"], row["timeout_failures"]) == (1, 2)
    assert (row["recovered_jobs"], row["long_running_jobs"], row["operation_errors"]) == (1, 1, 0)
    assert (row["duration_count"], row["duration_total_seconds"], row["duration_p95_seconds"]) == (4, 175.0, 60.0)


def test_upsert_retention_and_rollup(spark):
    fresh = daily.daily_statistics(events_of(spark, [request("one")]))
    old = fresh.withColumn("date", F.lit(date(2025, 1, 1))).withColumn("requests", F.lit(9).cast("long"))
    stale = fresh.withColumn("requests", F.lit(7).cast("long"))
    rows = daily.upsert(old.unionByName(stale), fresh)
    assert {(str(r["date"]), r["requests"]) for r in rows.collect()} == {("2025-01-01", 9), ("2026-08-19", 1)}
    assert daily.retained(rows, date(2026, 8, 20), 2).count() == 1
    assert daily.retained(rows, date(2026, 8, 20), 0).count() == 2
    total = daily.rollup(rows, start=date(2026, 1, 1)).first()
    assert (total["requests"], total["success_rate"], total["duration_average_seconds"]) == (1, 100.0, 60.0)
    assert [str(r["date"]) for r in daily.recent_days(rows, 1).collect()] == ["2026-08-19"]


def test_statistics_job_keeps_days_the_logs_no_longer_cover(spark, tmp_path):
    import json

    table = scratch_path(spark, "daily")
    log = tmp_path / "e.jsonl"
    log.write_text(json.dumps(request("1", finished_at="2026-08-01T00:00:00Z")) + "\n" + json.dumps(request("2", service=None)))
    statistics.update_statistics(spark, str(log), table, "rook")
    log.write_text(json.dumps(request("2")) + "\n" + json.dumps(request("3")) + "\n" + json.dumps(request("4", service="emu")) + "\n[]\nbad")
    rejects = statistics.update_statistics(spark, str(log), table, "rook")
    assert rejects.count() == 1
    report = statistics.statistics_report(spark, table)
    days = {str(r["date"]): r["requests"] for r in report["recent_days"].collect()}
    assert days == {"2026-08-01": 1, "2026-08-19": 2}
    assert report["totals"].first()["requests"] == 3
    statistics.update_statistics(spark, str(log), table, "rook", keep_days=2, today=date(2026, 8, 20))
    assert [str(r["date"]) for r in daily.read_daily(spark, table).collect()] == ["2026-08-19"]


def test_statistics_read_every_value_of_a_failure(spark):
    odd = request("1", "failed", failures=[{"hint": "ran out of memory", "n": 3}, "noise", {"message": None}])
    noted = request("2", "failed", failures=[{"code": "x"}], diagnostics=[{"where": {"step": "timed out"}}])
    row = daily.daily_statistics(events_of(spark, [odd, noted, request("3", "failed", "plain")])).first()
    assert (row["failed"], row["memory_failures"], row["timeout_failures"]) == (3, 1, 1)


def test_jdbc_needs_predicates(spark):
    import pytest

    with pytest.raises(ValueError):
        job_source.read_job_table(spark, jdbc={"url": "jdbc:x", "dbtable": "t"})


def test_monitoring_run(spark):
    """All layers of one run; the recent jobs are counted with dismissed ones unmapped."""
    from opsight.plans import monitor

    table = job_table(spark, (job_id(1), "p", 1, "2026-08-12 07:00:00"), ("x", "p", 5, "2026-08-12 08:00:00"), ("y", "p", 3, "2026-08-12 08:00:00", "2026-08-12 08:01:00"), ("old", "p", 3, "2026-08-01 08:00:00"))
    docs = documents(spark, (job_id(1), "2026-08-12T08:00:00", status_xml(STARTED, created="2026-08-12T08:00:00Z")), (job_id(2), "2026-08-12T08:00:00", status_xml()))
    lines = spark.createDataFrame([access(NOW + timedelta(minutes=m), path=f"/o/{job_id(3)}.xml") for m in (-150, -90, -5)], "value string")
    report = monitor.monitor(spark, documents=docs, jobs=table, access_lines=lines, job_dumps=spark.createDataFrame([], DUMPS), error_outputs=spark.createDataFrame([], "directory string, error_output binary"), output_path="/o", now=NOW, stored=scratch_path(spark, "run"), codes=CODES)
    mix = report["status_mix"].first()
    assert (mix["total"], mix["running"], mix["successful"], mix["unmapped"], mix["dismissed"]) == (3, 1, 1, 1, 0)
    assert {tuple(r) for r in report["summary"].collect()} == {("xml", 2, 1, 0, 0), ("database", 3, 1, 0, 0), ("polling", 1, 1, 0, 0)}
    assert report["result"].first()["result"] == "attention required"
    actions = {(r["layer"], r["job_id"]): r["action"] for r in report["plan"].collect()}
    assert actions == {("xml", job_id(1)): "error", ("database", job_id(1)): "blocked", ("polling", job_id(3)): "recover"}
    assert report["recovery_result"].first()["result"] == "completed with 1 error"


def test_range_report(spark):
    table = job_table(
        spark,
        ("1", "orchestrate", 3, "2026-08-02 10:00:00", "2026-08-02 10:01:00"),
        ("2", "orchestrate", 4, "2026-08-03 10:00:00", "2026-08-03 10:02:00", "Dataset unavailable"),
        ("3", "subset", 4, "2026-08-04 10:00:00", "2026-08-04 10:03:00", "Dataset unavailable"),
        ("4", "orchestrate", 1, "2026-08-05 10:00:00"),
        ("5", "orchestrate", 3, "2026-07-31 00:00:00"),
        ("6", "orchestrate", 3, None),
    )
    report = activity.range_report(table, parse_time_range("2026-08"), codes=CODES)
    row = report["requests"].first()
    assert (row["total"], row["successful"], row["failed"], row["running"]) == (4, 1, 2, 1)
    assert row["success_rate_percent"] == 33.33
    durations = {r["process"]: r for r in report["durations"].collect()}
    assert durations["(all)"]["total"] == 360
    assert report["successful_durations"].first()["from_1_to_under_10_minutes"] == 1
    assert [r["process"] for r in report["processes"].collect()] == ["orchestrate", "subset"]
    error = report["errors"].first()
    assert (error["message"], error["count"]) == ("Dataset unavailable", 2)
    assert activity.range_report(table, parse_time_range("2026-08"), identifier="subset", codes=CODES)["requests"].first()["total"] == 1


def test_histogram_edges(spark):
    facts = spark.createDataFrame([("successful", v) for v in (30.0, 60.0, 599.9, 600.0, 1799.9, 1800.0, 7200.0)], "state string, seconds double")
    row = dbreport.duration_histogram(facts).first()
    assert tuple(row) == (7, 1, 2, 2, 2, 7200.0)


def test_window_report(spark):
    table = job_table(
        spark,
        ("recent-ok", "subset", 3, "2026-08-20 19:50:00", "2026-08-20 19:51:00"),
        ("recent-fail", "orchestrate", 4, "2026-08-20 19:40:00", "2026-08-20 19:42:00", "No timesteps are matching the selection criteria."),
        ("recent-run", "subset", 1, "2026-08-20 19:30:00"),
        ("old-run", "orchestrate", 1, "2026-08-20 17:00:00"),
        ("old-ok", "subset", 3, "2026-08-20 17:00:00", "2026-08-20 18:00:00"),
        ("odd", "other", 9, "2026-08-20 17:00:00"),
    )
    report = activity.window_report(table, datetime(2026, 8, 20, 20, tzinfo=UTC), codes=CODES)
    rows = {r["process"]: r for r in report["processes"].collect()}
    assert set(rows) == {"(all)", "subset", "orchestrate"}
    assert (rows["(all)"]["requests"], rows["(all)"]["active"], rows["(all)"]["success_rate"]) == (3, 1, 50.0)
    assert (rows["orchestrate"]["requests"], rows["orchestrate"]["active"]) == (1, 1)
    assert (rows["(all)"]["measured"], rows["(all)"]["p95_seconds"]) == (2, 120.0)
    assert report["failure_categories"].first()["category"] == "no-data"
    active = report["active_jobs"].collect()
    assert [r["job_id"] for r in active] == ["old-run", "recent-run"]
    assert active[0]["age_seconds"] == 10800 and not active[0]["in_window"]


NOW = datetime(2026, 8, 12, 12, tzinfo=UTC)


def test_job_findings_follow_precedence(spark):
    table = job_table(
        spark,
        ("stalled", "p", 1, "2026-08-12 07:00:00"),
        ("updated", "p", 1, "2026-08-12 07:00:00", "2026-08-12 11:55:00"),
        ("edge", "p", 1, "2026-08-12 11:50:00"),
        ("young", "p", 1, "2026-08-12 11:50:01"),
        ("waiting", "p", 0, "2026-08-11 12:00:01"),
        ("abandoned", "p", 0, "2026-08-11 12:00:00"),
        ("paused", "p", 2, "2026-08-01 12:00:00"),
        ("unknown", "p", 9, "2026-08-01 12:00:00"),
        ("undated", "p", 1, None),
        ("843b6f0e-94f4-11f1-aca4-fa163e934c9b", "p", 1, "2026-08-10 21:48:53.662211"),
    )
    found = {r["job_id"]: r["finding"] for r in findings.job_findings(table, NOW, Thresholds(), CODES).collect()}
    assert found == {
        "stalled": "stalled",
        "updated": "long-running",
        "edge": "long-running",
        "abandoned": "stalled",
        "undated": "error",
        "843b6f0e-94f4-11f1-aca4-fa163e934c9b": "stalled",
    }


def test_raw_clock_filter_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "jobs")
    job_table(spark, ("1", "p", 1, "2026-08-12 07:00:00")).write.parquet(path)
    table = job_source.read_job_table(spark, path)
    for frame in (
        job_source.jobs_in_range(table, parse_time_range("2026-08")),
        findings.job_findings(table, NOW, Thresholds(), CODES),
    ):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        pushed = [line for line in plan.splitlines() if "PushedFilters" in line][0]
        assert "time_start" in pushed.split("PushedFilters")[1]


def documents(spark, *items):
    rows = [(job, datetime.fromisoformat(at), body) for job, at, body in items]
    return spark.createDataFrame(rows, "job_id string, modification_time timestamp, content string")


STARTED = "<wps:ProcessStarted percentCompleted='5'/>"


def test_status_documents_to_requests(spark):
    docs = documents(
        spark,
        ("a", "2026-08-12T10:02:00", status_xml(complex="{" + "x" * 70000 + "}")),
        ("b", "2026-08-12T09:00:00", status_xml(FAILED)),
        ("c", "2026-08-12T10:02:00", status_xml("<wps:ProcessFailed> plain   text </wps:ProcessFailed>")),
        ("d", "2026-08-12T10:02:00", status_xml(STARTED)),
        ("e", "2026-08-12T10:02:00", "not xml"),
        ("843b6f0e-94f4-11f1-aca4-fa163e934c9b", "2026-08-10T19:49:53.661467", status_xml(created="")),
        ("f", "2026-08-12T10:02:00", status_xml("<wps:ProcessFailed/><wps:ProcessFailed/>")),
        ("g", "2026-08-12T10:02:00", status_xml(STARTED + "<wps:ProcessSucceeded/>", created="soon")),
        ("h", "2026-08-12T10:02:00", status_xml(STARTED + "<wps:ProcessSucceeded/>")),
    )
    parsed = xml.parse_status(docs)
    problems = {r["job_id"]: (r["problem"], r["reject"]) for r in parsed.collect() if r["problem"]}
    states = "not exactly one state"
    assert problems == {
        "e": ("invalid XML", "invalid XML"),
        "843b6f0e-94f4-11f1-aca4-fa163e934c9b": ("invalid Status creationTime", None),
        "f": (states, "not exactly one final state"),
        "g": (states, "invalid Status creationTime"),
        "h": (states, None),
    }
    assert {r["job_id"] for r in xml.rejected_documents(parsed).collect()} == {"e", "f", "g"}
    diagnostics = spark.sql("select job_id, array(named_struct('source','s','message','m')) diagnostics from values ('a'), ('b') t(job_id)")
    rows = {r["job_id"]: r for r in xml.status_requests(parsed, "rook", diagnostics).collect()}
    assert set(rows) == {"a", "b", "c", "h", "843b6f0e-94f4-11f1-aca4-fa163e934c9b"}
    a = rows["a"]
    assert (a["process"], a["outcome"], a["duration_seconds"], a["duration_source"]) == ("zonal", "successful", 120.0, "status_creation_time")
    assert a["diagnostics"] is None and rows["b"]["diagnostics"][0]["message"] == "m"
    assert a["inputs"]["mesh"][0]["value"] == "https://store.test/p q+r.nc"
    assert [v["value"] for v in a["inputs"]["level"]] == ["low half", "high"]
    assert a["inputs"]["level"][0]["attributes"] == {"dataType": "string", "note": 'a>b "c"'}
    assert len(a["inputs"]["big"][0]["value"]) == 70002
    assert a["inputs"]["none"][0]["type"] == "unknown"
    assert rows["b"]["duration_seconds"] == 0.0
    assert tuple(rows["b"]["failures"][0]) == ("Refused", "mesh", "The mesh had < 3 cells")
    assert tuple(rows["c"]["failures"][0]) == (None, None, "plain text")
    uuid_row = rows["843b6f0e-94f4-11f1-aca4-fa163e934c9b"]
    assert (uuid_row["duration_source"], uuid_row["duration_seconds"]) == ("uuid1", 60.0)
    cut = {r["job_id"]: r for r in xml.status_requests(parsed, "rook", limits=xml.RECORDED).collect()}["a"]["inputs"]
    assert (len(cut["big"][0]["value"]), cut["big"][0]["truncated"], cut["level"][0]["truncated"]) == (65536, True, False)


def test_texts_are_flattened_in_document_order(spark):
    item = "<w:Input><Identifier>x</Identifier><w:Data>{}</w:Data></w:Input>"
    values = [
        "<w:LiteralData>a<b k='>'>b<c/></b><!-- - -->c</w:LiteralData>",
        "<w:ComplexData n:a='1' b=\"it's &quot;x&quot;\"><![CDATA[<raw> & ]]><k>v</k></w:ComplexData>",
        "<w:BoundingBoxData crs='e'><l>0 0</l>\n<u>1 1</u></w:BoundingBoxData>",
        "<w:LiteralData/>",
        "<w:LiteralDataX>no value</w:LiteralDataX>",
    ]
    body = "".join(item.format(v) for v in values)
    text = f"<w:R xmlns:w='w' xmlns:n='n'><w:Status creationTime='2026-08-12T10:00:00Z'><w:ProcessSucceeded/></w:Status><w:DataInputs>{body}</w:DataInputs></w:R>"
    parsed = xml.parse_status(documents(spark, ("j", "2026-08-12T10:00:00", text)))
    found = [tuple(v) for v in xml.status_requests(parsed, "s").first()["inputs"]["x"]]
    assert found == [
        ("LiteralData", "abc", None),
        ("ComplexData", "<raw> & v", {"a": "1", "b": 'it\'s "x"'}),
        ("BoundingBoxData", "0 0 1 1", {"crs": "e"}),
        ("LiteralData", None, None),
        ("unknown", None, None),
    ]


def job_id(number):
    return f"{number:08x}-0000-4000-8000-000000000000"


DUMPS = "directory string, dump string"


def dump_row(job, folder, workdir=None, request='{"inputs": {"a": [1, 2], "b": 3}, "lineage": "True"}'):
    import json

    return (f"file:/w/{folder}", json.dumps({"process": {"uuid": job, "workdir": workdir or f"/w/./{folder}/"}, "wps_request": request}))


def test_xml_findings_follow_the_evidence(spark):
    ages = {"young": 9, "late": 12, "stale": 96}
    wanted = {}
    docs, dump_rows, outputs = [], [], []
    number = 0
    for age, minutes in ages.items():
        for valid in (0, 1, 2):
            for oom in (False, True):
                number += 1
                at = (NOW - timedelta(minutes=minutes)).replace(tzinfo=None).isoformat()
                docs.append((job_id(number), at, status_xml(STARTED, created="2026-08-12T08:00:00Z")))
                # Dumps that are no evidence lie beside the valid ones.
                dump_rows += [dump_row(job_id(number), f"x{number}", "/elsewhere"), dump_row(job_id(number), f"y{number}", request="oops"), dump_row(job_id(number), f"z{number}", request='{"inputs": [1]}'), (f"file:/w/q{number}", "{")]
                for copy in range(valid):
                    dump_rows.append(dump_row(job_id(number), f"d{number}_{copy}"))
                outputs += [(f"file:/w/{name}", b"slurmstepd: error: Detected 3 oom-kill event(s) in StepId=9.batch." + b" later" * 60_000) for name in [f"x{number}"] + ([f"d{number}_0"] if oom else [])]
                if age == "young":
                    continue
                if valid > 1:
                    wanted[job_id(number)] = ("error", findings.SEVERAL_DUMPS, None)
                elif valid and oom:
                    wanted[job_id(number)] = ("slurm-oom", None, f"file:/w/d{number}_0")
                elif age == "stale":
                    wanted[job_id(number)] = ("stalled", None, f"file:/w/d{number}_0" if valid else None)
    docs += [
        (job_id(900), "2026-08-01T00:00:00", "<x"),
        ("no-job", "2026-08-01T00:00:00", "<x"),
        ("old", "2026-08-01T00:00:00", status_xml(STARTED)),
        (job_id(901), "2026-08-01T00:00:00", status_xml("<wps:ProcessAccepted/>")),
        (job_id(902), "2026-08-01T00:00:00", status_xml(FAILED)),
    ]
    wanted[job_id(900)] = ("error", "invalid XML", None)
    parsed = xml.parse_status(documents(spark, *docs), with_inputs=False)
    raw_dumps = spark.createDataFrame(dump_rows, DUMPS)
    errors = spark.createDataFrame(outputs, "directory string, error_output binary")
    found = findings.xml_findings(parsed, raw_dumps, errors, NOW)
    assert {r["job_id"]: (r["finding"], r["reason"], r["evidence"]) for r in found.collect()} == wanted
    # The marker lies before the last bytes, which are all that is looked at here.
    tail = findings.xml_findings(parsed, raw_dumps, errors, NOW, tail_bytes=262_144)
    assert not [r for r in tail.collect() if r["finding"] == "slurm-oom"]
    archive = findings.incident_archive(xml.parse_status(documents(spark, *docs)), "rook/1")
    assert archive.first()["archive_name"] == f"20260812T100000Z__error__rook-1__zonal__{job_id(902)}.xml"
    assert findings.incident_archive(xml.parse_status(documents(spark, *docs)), "rook/1", archive).count() == 0


def test_creation_time_labelled_utc_but_local(spark):
    docs = documents(spark, ("a", "2026-08-12T08:01:00", status_xml(STARTED)), ("b", "2026-08-12T10:01:00", status_xml(STARTED)))
    rows = findings.document_times(xml.parse_status(docs), "Europe/Berlin").orderBy("job_id").collect()
    assert [r["creation_time"].hour for r in rows] == [8, 10]


def test_dump_and_error_files(spark, tmp_path):
    import json

    long_output = b"x" * 9000 + b" \n slurmstepd: error: Detected 2 oom-kill event(s) in StepId=1.batch."
    for name, uuid, error in (("a", "1", long_output), ("b", "2", b"\xff bytes"), ("c", "2", b"  "), ("d", "", b"no job")):
        folder = tmp_path / f"process_{name}"
        (folder / "deeper").mkdir(parents=True)
        request_text = json.dumps({"lineage": "True", "inputs": {"x": [1, 2], "y": 3}})
        body = json.dumps({"process": {"uuid": uuid, "workdir": str(folder)}, "wps_request": request_text})
        (folder / "job_1.dump").write_text(body)
        (folder / "deeper" / "job_2.dump").write_text(body)
        (folder / "job-error.txt").write_bytes(error)
    raw = dumps.read_job_dumps(spark, str(tmp_path))
    parsed = dumps.parse_dumps(raw)
    errors = dumps.read_error_outputs(spark, str(tmp_path))
    assert sorted((r["job_id"], r["lineage"], r["input_count"], r["is_valid"]) for r in parsed.collect()) == [("1", True, 3, True), ("2", True, 3, True), ("2", True, 3, True)]
    messages = {r["job_id"]: r["diagnostics"][0]["message"] for r in dumps.job_diagnostics(parsed, errors, 8000).collect()}
    assert messages["1"] == " ".join(long_output[-8000:].decode().split())
    assert messages["2"] == "� bytes"
    whole = {r["job_id"]: r["diagnostics"][0]["message"] for r in dumps.job_diagnostics(parsed, errors).collect()}
    assert whole["1"] == " ".join(long_output.decode().split())
    stalled = spark.createDataFrame([("1",), ("2",), ("3",)], "job_id string")
    assert [r["job_id"] for r in dumps.oom_jobs(stalled, raw, errors).collect()] == ["1"]
    match = {r["job_id"]: r["match"] for r in findings.dump_match(stalled, parsed).collect()}
    assert match == {"1": "matched", "2": "duplicate", "3": "missing"}


def test_requests_without_inputs_are_valid_and_lists_are_not(spark):
    cases = {"none": "{}", "null": '{"inputs": null}', "list": "[]", "empty": '{"inputs": {}}', "text": '{"inputs": "a"}'}
    rows = [dump_row(name, name, request=request) for name, request in cases.items()]
    valid = {r["job_id"] for r in dumps.parse_dumps(spark.createDataFrame(rows, DUMPS)).where("is_valid").collect()}
    assert valid == {"none", "empty"}


UUID = "123e4567-e89b-42d3-a456-426614174000"


def access(at, status=404, path=f"/outputs/a+b%20c/{UUID}.xml?x=1", method="GET"):
    return (f'192.0.2.1 - - [{at:%d/%b/%Y:%H:%M:%S} +0000] "{method} {path} HTTP/1.1" {status} 153 "-" "c"',)


def test_polls_need_count_and_span(spark):
    def polls(minutes, **changes):
        lines = [access(NOW + timedelta(minutes=m), **changes) for m in minutes]
        lines += [("garbage",), ('1 - - [32/Foo/2026:00:00:00 +0000] "GET /x HTTP/1.1" 404 1',)]
        parsed = access_log.parse_access_log(spark.createDataFrame(lines, "value string"))
        limits = Thresholds(poll_window_minutes=60, min_poll_count=3, min_poll_span_minutes=5)
        return findings.missing_status_polls(parsed, "/outputs/a+b c/", NOW, limits)

    row = polls([-12, -8, -2]).first()
    assert (row["job_id"], row["polls"]) == (UUID, 3)
    assert polls([-2, -2, -2]).count() == 0
    assert polls([-61, -8, -2]).count() == 0
    assert polls([-8, -2, 6]).count() == 0
    assert polls([-12, -8, 5]).count() == 1
    assert polls([-12, -8, -2], status=200).count() == 0
    assert polls([-12, -8, -2], method="POST").count() == 0
    assert polls([-12, -8, -2], path=f"/outputs/other/{UUID}.xml").count() == 0
    assert polls([-12, -8, -2], path=f"http://host/outputs/a+b%20c/{UUID}.xml").count() == 1


FOUND = "layer string, job_id string, status string, finding string, evidence_ts timestamp, reason string, evidence string"


def test_recovery_plan_defers_and_blocks(spark):
    rows = [("database", f"j{n:02}", "running", "stalled", datetime(2026, 8, 1, n), None, None) for n in range(5)]
    rows += [("polling", f"p{n}", "running", "missing-status", datetime(2026, 8, 1, n), None, None) for n in range(3)]
    rows += [("xml", UUID, "running", "error", None, "invalid XML", None), ("database", UUID, "accepted", "stalled", datetime(2026, 7, 1), None, None), ("database", "x", "running", "long-running", datetime(2026, 7, 1), None, None)]
    found = spark.createDataFrame(rows, FOUND)
    plan = findings.recovery_plan(found, Thresholds(recovery_limit=2, polling_recovery_limit=1))
    actions = {(r["layer"], r["job_id"]): r["action"] for r in plan.collect()}
    assert len(actions) == 10
    assert {job for (_, job), action in actions.items() if action == "recover"} == {"j00", "j01", "p0"}
    assert actions["xml", UUID] == "error" and actions["database", UUID] == "blocked"
    checked = spark.createDataFrame([("xml", 7), ("database", 5), ("polling", 3), ("idle", 0)], "layer string, checked bigint")
    summary = findings.layer_summary(found, checked)
    assert {tuple(r) for r in summary.collect()} == {("xml", 7, 0, 0, 1), ("database", 5, 6, 1, 0), ("polling", 3, 3, 0, 0), ("idle", 0, 0, 0, 0)}
    assert findings.overall_result(summary).first()["result"] == "completed with 1 error"
    assert findings.overall_result(summary.where("layer = 'polling'")).first()["result"] == "attention required"
    assert findings.overall_result(summary.where("layer = 'idle'")).first()["result"] == "healthy"
    recovery = findings.recovery_summary(plan, checked)
    assert {tuple(r) for r in recovery.collect()} == {("xml", 7, 0, 0, 1), ("database", 5, 2, 2, 0), ("polling", 3, 1, 1, 0), ("idle", 0, 0, 0, 0)}
    assert findings.overall_result(recovery.where("layer = 'database'")).first()["result"] == "recovered 2 jobs"
    assert findings.overall_result(recovery.where("layer = 'polling'")).first()["result"] == "recovered 1 job"
    assert findings.overall_result(recovery.where("layer = 'idle'")).first()["result"] == "no recovery needed"


def test_documents_are_recovered_by_name_from_their_one_dump(spark):
    """The run ends after the recovery that reaches the limit; errors behind it don't block."""

    def document(number, finding, evidence):
        return ("xml", job_id(number), "running", finding, datetime(2026, 8, 1), None, evidence)

    rows = [document(1, "stalled", None), document(2, "error", None), document(3, "slurm-oom", "/d/3"), document(4, "stalled", None), document(5, "stalled", "/d/5"), document(6, "error", None), document(7, "stalled", "/d/7"), document(8, "stalled", None)]
    rows += [("database", job_id(n), "running", "stalled", datetime(2026, 8, 1, n), None, None) for n in (1, 2, 6, 8)]
    plan = findings.recovery_plan(spark.createDataFrame(rows, FOUND), Thresholds(recovery_limit=3)).collect()
    actions = {(r["layer"], int(r["job_id"][:8], 16)): r["action"] for r in plan}
    documents_ = [actions["xml", n] for n in range(1, 9)]
    assert documents_ == ["error", "error", "recover", "error", "recover", "defer", "defer", "defer"]
    assert [actions["database", n] for n in (1, 2, 6, 8)] == ["blocked", "blocked", "recover", "recover"]
    assert {r["reason"] for r in plan if r["action"] == "error"} == {findings.NO_DUMP}
    assert {r["message"] is None for r in plan if r["action"] != "recover"} == {True}


def test_polling_vetoes(spark):
    candidates = spark.createDataFrame([(x,) for x in "abcd"], "job_id string")
    table = spark.createDataFrame([("a", 1), ("a", 4), ("b", 4), ("d", None)], "uuid string, status int")
    docs = spark.createDataFrame([("b",), ("b",)], "job_id string")
    rows = {r["job_id"]: r["decision"] for r in findings.polling_decisions(candidates, table, docs).collect()}
    assert rows == {"a": "skip", "b": "status-exists", "c": "missing-status", "d": "skip"}
    assert findings.missing_status(candidates, docs).count() == 3


def test_incident_files(spark, tmp_path):
    for name in (f"20260812T100000Z__error__s__p__{UUID.upper()}.xml", f"20260812T100001Z__recovered__s__p_q__{UUID}.xml", "notes.xml"):
        (tmp_path / name).write_text("x")
    index = incidents.incident_index(incidents.read_incident_paths(spark, str(tmp_path)))
    assert sorted((r["job_id"], r["kind"]) for r in index.collect()) == [(UUID, "error"), (UUID, "recovered")]


def test_status_files_are_read_with_their_time(spark, tmp_path):
    import os

    (tmp_path / f"{UUID}.xml").write_text(status_xml())
    os.utime(tmp_path / f"{UUID}.xml", (1786528920, 1786528920))
    docs = xml.read_status_documents(spark, str(tmp_path))
    row = xml.status_requests(xml.parse_status(docs), "rook").first()
    assert (row["job_id"], row["finished_at"].year) == (UUID, 2026)
    assert job_columns.StatusCodes().active == [1, 2, 3]


def test_large_dumps_are_not_broadcast_on_an_estimate(spark):
    """Ten million dumps, as a plan only: the parsed document must not make them look small."""
    keys = spark.range(10_000_000)
    raw = keys.selectExpr("concat('/w/', id) as directory", "concat('{\"process\":{\"uuid\":\"', id, '\"}}') as dump")
    errors = keys.selectExpr("concat('/w/', id) as directory", "cast(concat('line ', id) as binary) as error_output")
    jobs = keys.selectExpr("cast(id as string) as job_id")
    requests = jobs.selectExpr("job_id", "'failed' as outcome")
    files = jobs.selectExpr("concat(lpad(job_id, 8, '0'), '-0000-4000-8000-000000000000') as job_id", "timestamp'2026-01-01' as modification_time", "'<x/>' as content")
    parsed = dumps.parse_dumps(raw)
    diagnostics = dumps.job_diagnostics(parsed, errors)
    joined = {
        "dump_match": findings.dump_match(jobs, parsed),
        "job_diagnostics": diagnostics,
        "with_diagnostics": xml.with_diagnostics(requests, diagnostics),
        "new_requests": xml.new_requests(requests, parsed),
        "oom_jobs": dumps.oom_jobs(jobs, raw, errors),
        "xml_findings": findings.xml_findings(xml.parse_status(files, with_inputs=False), raw, errors, NOW),
    }
    plans = {name: rows._jdf.queryExecution().executedPlan().toString() for name, rows in joined.items()}
    assert not [name for name, plan in plans.items() if "Broadcast" in plan]
    assert not [name for name, plan in plans.items() if "SortMergeJoin" not in plan]

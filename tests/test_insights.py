import gzip
import json

from pyspark.sql import functions as F

from helpers import events_of, operation, request, workflow
from opsight.operators import coverage, dedup, insights, lineage
from opsight.params import TimeRange, parse_time_range
from opsight.plans import insights as plan
from opsight.session import scratch_path
from opsight.sources import events as source


def as_map(rows, key, value):
    return {row[key]: row[value] for row in rows.collect()}


def levels(*values):
    return {"level": [{"type": "LiteralData", "value": value} for value in values]}


def test_outcomes_durations_coverage_and_causes(spark):
    """Five requests; the numbers are worked out by hand."""
    events = events_of(
        spark,
        [
            request("a", inputs=levels(850, 500), duration_seconds=30),
            request("b", inputs=levels(850), duration_seconds=90),
            request("c", "failed", "Requested latitude 91 is outside the latitude bounds", inputs=levels(850), duration_seconds=5),
            request("d", "failed", "sbatch: queue is closed", process="average", duration_seconds=700),
            request("e", "failed", "sbatch: queue is closed", process="average", duration_seconds=None),
        ],
    )
    outcomes = insights.process_outcomes(events).where("scope = 'all'")
    assert as_map(outcomes, "outcome", "requests") == {"failed": 3, "successful": 2}
    assert as_map(insights.failure_categories(events), "category", "failures") == {"spatial": 1, "scheduler": 2}
    durations = insights.duration_summary(events).where("scope = 'all'").first()
    assert (durations["name"], durations["count"], durations["max_seconds"]) == ("all", 4, 700.0)
    counts = coverage.coverage_counts(events)
    row = coverage.coverage(counts).first()
    assert (row["dimension"], row["uses"], row["distinct_values"]) == ("subset.level", 4, 2)
    top = coverage.coverage_top(counts, 1).first()
    assert (top["value"], top["count"]) == ("850", 3)


def test_durations_that_do_not_count(spark):
    events = events_of(spark, [request("1", duration_seconds=-1), request("2", duration_seconds="60"), request("3", duration_seconds=None), request("4", duration_seconds=2.5)])
    assert insights.duration_summary(events).where("scope = 'all'").first()["count"] == 1


def test_gzip_rotation_and_rejects(spark, tmp_path):
    line = json.dumps(request("1")) + "\n"
    (tmp_path / "a.log").write_text(line + "\n  \n{broken\n[1]\n3\n")
    with gzip.open(tmp_path / "b.log.gz", "wt") as stream:
        stream.write(line + json.dumps(request("", job_id=None)) + "\n" + json.dumps(request("", job_id=None)) + "\n")
    lines = source.read_event_lines(spark, str(tmp_path))
    unique = dedup.dedup_requests(source.parse_events(lines), source.READ_ORDER)
    assert unique.where("job_id = '1'").count() == 1
    assert unique.where("job_id is null").count() == 2
    assert unique.where("job_id = '1'").select("file_path").first()[0].endswith("a.log")
    reasons = source.event_rejects(lines).groupBy("reason").count()
    assert as_map(reasons, "reason", "count") == {"invalid-json": 1, "not-an-object": 2}


def test_given_paths_are_read_in_order(spark, tmp_path):
    for name, outcome in (("b.log", "successful"), ("a.log", "failed")):
        (tmp_path / name).write_text(json.dumps(request("1", outcome)) + "\n")
    for names, outcome in ((("b.log", "a.log"), "successful"), (("a.log", "b.log"), "failed")):
        lines = source.read_event_lines(spark, [str(tmp_path / name) for name in names])
        unique = dedup.dedup_requests(source.parse_events(lines), source.READ_ORDER)
        assert [r["outcome"] for r in unique.collect()] == [outcome]


def test_strings_of_lists_at_any_depth(spark):
    from opsight.functions import variants

    cases = {"\"a\"": ["a"], '["a",["b",[["c",[["d\\"}",{"e":"f"},["g"]]]]]]]': ["a", "b", "c", 'd"}', "g"], '[[[[{"a":["b"]}]]]]': [], '{"a":"b"}': [], "[1,null,[true]]": []}
    rows = spark.createDataFrame([(k,) for k in cases], "j string").select("j", variants.string_values(F.try_parse_json("j")).alias("s"))
    assert {r["j"]: r["s"] for r in rows.collect()} == cases


def test_report_rows_carry_examples_and_their_documents(spark):
    events = events_of(spark, [request(f"Job-{n}", "failed", "same") for n in "dcba"] + [request("z", "failed", "other")])
    incidents = spark.createDataFrame([("job-d", "error", "/x"), ("job-d", "recovered", "/y"), ("job-q", "error", "/z")], "job_id string, kind string, path string")
    rows = insights.with_examples(insights.failure_messages(events), insights.DETAIL_KEYS, insights.failure_items(events), incidents)
    found = {r["text"]: r for r in rows.collect()}
    assert found["same"]["example_jobs"] == ["Job-d", "Job-a", "Job-b"]
    assert {job: [tuple(d) for d in docs] for job, docs in found["same"]["status_xml"].items()} == {"Job-d": [("error", "/x"), ("recovered", "/y")]}
    assert found["other"]["example_jobs"] == ["z"] and found["other"]["status_xml"] == {}


def test_content_dedup_of_operations(spark):
    twice = operation("job-recovered", "1")
    events = events_of(spark, [twice, twice, operation("job-recovered", "1", recorded_at="2026-08-19T12:06:00Z"), request("1"), request("1", service="emu"), request("1", outcome="failed")])
    kept = dedup.dedup_by_content(events, ["line_id"])
    assert sorted((r["record_type"], r["line_id"]) for r in kept.collect()) == [("operation", 0), ("operation", 2), ("request", 3), ("request", 4)]
    assert dedup.dedup_requests(events, ["line_id"]).where("record_type = 'operation'").count() == 3


def test_selection_by_time_type_and_process(spark):
    events = events_of(spark, [request("1"), request("2", finished_at="2026-08-20T00:00:00Z"), request("3", finished_at="", recorded_at="2026-08-19T01:00:00Z"), request("4", finished_at="bad"), request("5", process="x"), operation("stalled", "6"), request("7", record_type="odd")])
    day = parse_time_range("2026-08-19")
    chosen = insights.select_requests(events, day, "subset")
    assert sorted(r["job_id"] for r in chosen.collect()) == ["1", "3", "7"]
    assert insights.select_requests(events, TimeRange()).count() == 6
    assert insights.select_operations(events, day).count() == 1


def test_category_order(spark):
    counts = spark.createDataFrame([("no-data", 22), ("memory", 9), ("input", 6), ("other", 4), ("timeout", 3)], "category string, failures long")
    ranked = insights.category_rank(counts).orderBy("category_order")
    assert [r["category"] for r in ranked.collect()] == ["memory", "timeout", "no-data", "input", "other"]


def test_taking_turns_equals_a_round_robin(spark):
    groups = {"memory": [9, 5], "timeout": [4, 3, 1], "input": [8, 7, 6, 2], "other": [1]}
    rows = spark.createDataFrame([(c, f"{c}{n}", n) for c, ns in groups.items() for n in ns], "category string, text string, count long")
    counts = rows.groupBy("category").agg(F.sum("count").alias("failures"))
    ranked = insights.category_rank(counts)
    order = [r["category"] for r in ranked.orderBy("category_order").collect()]
    queue = {c: sorted(groups[c], reverse=True) for c in order}
    expected = []
    while any(queue.values()):
        for c in order:
            if queue[c]:
                expected.append((c, queue[c].pop(0)))
    for top in (1, 3, 5, 9, 20):
        found = insights.interleaved(rows, ranked, [F.col("count").desc()], top).collect()
        assert [(r["category"], r["count"]) for r in found] == expected[:top]


def test_examples_prefer_archived_jobs(spark):
    events = events_of(spark, [request(f"job-{n}", "failed", "same") for n in "dcbaa"])
    incidents = spark.createDataFrame([("job-d", "error", "/x"), ("job-d", "recovered", "/y")], "job_id string, kind string, path string")
    found = insights.failure_examples(events, incidents).orderBy("rank").collect()
    assert [(r["job_id"], r["documents"]) for r in found] == [("job-d", 2), ("job-a", 0), ("job-b", 0)]


def test_diagnostics_override_the_generic_message(spark):
    generic = [{"code": "NoApplicableCode", "message": "Process failed, please check server error log"}]
    noted = [{"source": "job-error.txt", "message": "Detected 1 oom-kill event(s)"}, "noise"]
    events = events_of(spark, [request("1", "failed", failures=generic, diagnostics=noted), request("2", "failed", failures=generic)])
    assert as_map(insights.failure_categories(events), "category", "failures") == {"memory": 1, "unknown": 1}
    codes = {(r["code"], r["locator"]) for r in insights.failure_messages(events).collect()}
    assert codes == {("NoApplicableCode", ""), ("diagnostic", "job-error.txt")}


def test_operation_counts_and_newest_first(spark):
    events = events_of(spark, [operation("job-recovered", "1"), operation("job-recovered", "1"), operation("job-long-running", "2"), operation("operation-error", None), operation("x", "3", level="critical", recorded_at="2026-08-20T00:00:00Z"), operation("undated", "4", recorded_at=None)])
    row = insights.operation_summary(events).first()
    assert (row["events"], row["recovered_jobs"], row["long_running_jobs"], row["errors"]) == (6, 1, 1, 2)
    recent = insights.recent_operations(events, 10).collect()
    assert recent[0]["job_id"] == "3" and recent[-1]["event"] == "undated"


SEA = "ocean.archive.monthly.sst"


def lineage_of(spark, *items):
    return lineage.request_lineage(events_of(spark, items))


def test_workflow_collections_and_years(spark):
    """Three requests for one collection, one whose document cannot be read."""

    def asked(name, **given):
        return {"inputs": {name: [SEA]}, "steps": {"cut": {"run": "subset", "in": {"collection": f"inputs/{name}", **given}}}}

    found = lineage_of(
        spark,
        workflow(asked("sst", time="1991/1993"), "a"),
        workflow("\n\t" + json.dumps(asked("warm", time="1990/1999", time_components="month:feb|year:1990,1992,1999")), "b", outcome="failed"),
        workflow('{"inputs": [cut', "c"),
        workflow(asked("sst", time="1993"), "d", outcome="dismissed"),
    )
    assert [r["has_lineage"] for r in found.orderBy("job_id").collect()] == [True, True, False, True]
    row = lineage.collection_summary(found).first()
    assert (row["requests"], row["successful"], row["failed"]) == (3, 1, 1)
    assert row["outcomes"] == {"successful": 1, "failed": 1, "dismissed": 1}
    assert row["years"] == [1990, 1991, 1992, 1993, 1999] and row["year_coverage"] == "1990-1993,1999"
    failure = lineage.collection_failures(found).first()
    assert (failure["years"], failure["time_ranges"]) == ("1990,1992,1999", "1990/1999")
    assert lineage.failure_group_count(lineage.collection_failures(found)).first()[0] == 1


def test_derived_and_unreferenced_steps(spark):
    found = lineage_of(
        spark,
        workflow({"inputs": {"tas": ["a", ["b"]], "derived": ["regrid_1/output"]}, "steps": {"s": {"in": {"collection": "inputs/tas", "time": "2050/2050"}}, "t": {"in": {"collection": "s/output", "time": "2051"}}, "u": {"in": {"collection": ["inputs/none", "direct"], "time": ["1999"]}}, "v": "text"}}),
        workflow({"inputs": "none", "steps": {}}, "2"),
    )
    rows = lineage.exploded_lineage(found, "job_id").collect()
    years = {r["collection"]: r["years"] for r in rows if r["job_id"] == "1"}
    assert years == {"a": [2050, 2051], "b": [2050, 2051], "inputs/none": [1999], "direct": [1999]}
    assert not [r for r in rows if r["job_id"] == "2"]
    assert lineage.lineage_availability(found).first()["with_lineage"] == 2


def test_collections_in_the_chosen_order(spark):
    summary = spark.createDataFrame([("b", 3, 1, 2), ("a", 3, 3, 0), ("c", 9, 0, 2)], "collection string, requests int, successful int, failed int")
    orders = {"name": "abc", "requests": "cab", "successful": "abc", "failed": "bca"}
    for sort_by, names in orders.items():
        assert "".join(r["collection"] for r in lineage.collections_sorted(summary, sort_by).collect()) == names


def test_top_rows_of_a_hot_group(spark):
    from opsight.operators.keys import top_per_group

    rows = spark.range(6000).selectExpr("'hot' as g", "id as v").unionByName(spark.range(3).selectExpr("'small' as g", "id as v"))
    for limit in (2, 1500):
        found = top_per_group(rows, ["g"], [F.col("v").desc()], limit).collect()
        assert sorted((r["rank"], r["v"]) for r in found if r["g"] == "hot") == [(n + 1, 5999 - n) for n in range(limit)]
        assert len([r for r in found if r["g"] == "small"]) == min(limit, 3)


def test_failures_without_lineage_are_unknown(spark):
    found = lineage_of(spark, workflow("{", "1", outcome="failed"))
    row = lineage.collection_failures(found).first()
    assert (row["collection"], row["years"], row["message"]) == ("unknown", "unknown", "unknown failure")


def test_coverage_of_workflows_scalars_and_malformed_values(spark):
    events = events_of(
        spark,
        [
            workflow({"inputs": {"tas": ["c"]}, "steps": {"x": {"run": "subset", "in": {"collection": "inputs/tas", "time_components": "month:jan,feb|year:2015,2016,2017,2018"}}, "y": {"in": {"n": 1}}}}),
            workflow('{"inputs": [truncated]', "2"),
            request("3", process="dashboard", inputs={"site": [{"type": "LiteralData", "value": "dkrz"}, {"type": "ComplexData", "value": "[1]"}, {"a": 1}, "bare", None], "doc": [{"type": "ComplexData", "value": '{"a": {"b": [true, null, {}]}}'}], "odd": "text"}),
        ],
    )
    values = {(r["dimension"], r["value"]) for r in coverage.coverage_counts(events).collect()}
    assert values == {
        ("orchestrate.workflow.inputs.tas", '"c"'),
        ("orchestrate.workflow.steps.subset.collection", '"inputs/tas"'),
        ("orchestrate.workflow.steps.subset.time_components", '"month:jan,feb|year:2015-2018"'),
        ("orchestrate.workflow.steps.unknown.n", "1"),
        ("dashboard.site", '"dkrz"'),
        ("dashboard.site", '"[1]"'),
        ("dashboard.site", '{"a":1}'),
        ("dashboard.site", '"bare"'),
        ("dashboard.site", "null"),
        ("dashboard.doc.a.b", "true"),
        ("dashboard.doc.a.b", "null"),
    }


def test_flatten_has_no_depth_limit(spark):
    deep = {"leaf": 1}
    for _ in range(60):
        deep = {"n": [deep]}
    nodes = spark.createDataFrame([("p", json.dumps(deep))], "path string, node string")
    row = coverage.flatten_json(nodes).first()
    assert row["path"] == "p" + ".n" * 60 + ".leaf" and row["leaf"] == "1"


def test_full_report_from_files(spark, tmp_path):
    logs = tmp_path / "logs"
    logs.mkdir()
    items = [workflow({"inputs": {"a": ["c"]}, "steps": {}}, "1"), workflow("{", "2", outcome="failed"), operation("job-recovered", "1")]
    (logs / "e.jsonl").write_text("\n".join(map(json.dumps, items)) + "\n{bad\n")
    events, rejects = plan.read_insight_events(spark, str(logs), scratch_path(spark, "events"))
    sections = plan.insights_report(events, parse_time_range("2026"))
    assert rejects.count() == 1
    assert sections["period"].first()["requests"] == 2
    assert sections["collections"].first()["collection"] == "c"
    assert sections["operations"].first()["recovered_jobs"] == 1
    plan.write_report(sections, str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "report" / "collection_failures")).first()["collection"] == "unknown"


def test_blanks_around_event_lines(spark, tmp_path):
    path = tmp_path / "events.jsonl"
    path.write_bytes(b'\t{"a": 1}\r\n \t \n\t\r\n\n{"a": 2}\n\t[1]\n\t"x"\nbroken\n')
    lines = source.read_event_lines(spark, str(path))
    assert source.parse_events(lines).count() == 2
    rejects = source.event_rejects(lines).select("value", "reason").collect()
    assert sorted((r["value"].strip(), r["reason"]) for r in rejects) == [
        ('"x"', "not-an-object"),
        ("[1]", "not-an-object"),
        ("broken", "invalid-json"),
    ]

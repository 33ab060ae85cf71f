"""One monitoring run over documents, job table and access log."""

from __future__ import annotations

from dataclasses import replace
from datetime import datetime, timedelta
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opsight.functions import jobs as job_columns
from opsight.functions import times
from opsight.operators import dbreport, findings
from opsight.params import StatusCodes, Thresholds
from opsight.sources import access_log, status_xml
from opsight.sources.jobs import MAX_WRITER_OFFSET


def monitor(
    spark: SparkSession,
    *,
    documents: DataFrame,
    jobs: DataFrame,
    access_lines: DataFrame,
    job_dumps: DataFrame,
    error_outputs: DataFrame,
    output_path: str,
    now: datetime,
    stored: str,
    thresholds: Thresholds = Thresholds(),
    codes: StatusCodes = StatusCodes(),
    local_tz: str = "UTC",
) -> dict[str, DataFrame]:
    """Findings of the three layers, their summaries and the recovery plan.

    The findings are written to ``stored``; plan and stalled counts are derived from there.
    ``status_mix`` has the recent jobs of the table by state, whose total is what the
    database layer has checked.
    """
    parsed = status_xml.parse_status(documents, with_inputs=False)
    polls = findings.missing_status_polls(
        access_log.parse_access_log(access_lines), output_path, now, thresholds
    )
    decisions = findings.polling_decisions(polls, jobs, documents, codes)
    layers = [
        findings.xml_findings(parsed, job_dumps, error_outputs, now, thresholds, local_tz),
        findings.job_findings(jobs, now, thresholds, codes, local_tz),
        findings.polling_findings(decisions),
    ]
    found = findings.store_findings(
        spark, reduce(DataFrame.unionByName, layers), stored
    )
    mix = recent_mix(jobs, now, thresholds, codes, local_tz)
    checked = findings.checked_counts(
        xml=findings.status_files(documents).agg(F.count(F.lit(1))),
        database=mix.select("total"),
        polling=polls.agg(F.count(F.lit(1))),
    )
    summary = findings.layer_summary(found, checked)
    plan = findings.recovery_plan(found, thresholds)
    recovery = findings.recovery_summary(plan, checked)
    return {
        "findings": found,
        "status_mix": mix,
        "summary": summary,
        "result": findings.overall_result(summary),
        "plan": plan,
        "recovery": recovery,
        "recovery_result": findings.overall_result(recovery),
    }


def recent_mix(
    jobs: DataFrame,
    now: datetime,
    thresholds: Thresholds = Thresholds(),
    codes: StatusCodes = StatusCodes(),
    local_tz: str = "UTC",
) -> DataFrame:
    """Jobs by state over the status window, from a scan pruned on the stored clock."""
    window = timedelta(hours=thresholds.status_window_hours)
    earliest = times.wall_clock(now - window - MAX_WRITER_OFFSET)
    latest = times.wall_clock(now + MAX_WRITER_OFFSET)
    near = jobs.where((F.col("time_start") >= earliest) & (F.col("time_start") <= latest))
    # Monitoring knows no dismissed jobs: their code counts as unmapped.
    known = replace(codes, dismissed=None)
    facts = dbreport.job_facts(job_columns.with_utc_times(near, local_tz), known)
    return dbreport.recent_status_mix(facts, now, window)

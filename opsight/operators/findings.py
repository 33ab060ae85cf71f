"""Stalled, long-running and missing jobs over three layers of evidence."""

from __future__ import annotations

from datetime import datetime, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from opsight import fixed
from opsight.functions import jobs as job_columns
from opsight.functions import text, times
from opsight.functions.derive import by_shuffle, computed
from opsight.operators.keys import top_per_group
from opsight.params import StatusCodes, Thresholds
from opsight.sources import dumps as dump_sources
from opsight.sources.jobs import MAX_WRITER_OFFSET
from opsight.sources.status_xml import percent_decoded

FINDING_COLUMNS = ["layer", "job_id", "status", "finding", "evidence_ts", "reason", "evidence"]
MAX_BROADCAST_LIMIT = 10_000
SEVERAL_DUMPS, NO_DUMP = "several job dumps", "no job dump"
STALLED = ("stalled", "slurm-oom", "missing-status")
LAYER_ORDER = {"xml": 1, "database": 2, "polling": 3}


def _reached(now: datetime, since: Column, minutes: float) -> Column:
    """Whether ``since`` is at least ``minutes`` ago."""
    return since <= times.instant(now - timedelta(minutes=minutes))


def job_candidates(
    now: datetime, thresholds: Thresholds, codes: StatusCodes
) -> Column:
    """Superset filter on the raw clock, pushed into the scan of the job table.

    A writer may be up to 14 hours ahead, so the cutoff is that much later than the
    exact one. Jobs without any time are kept: they are reported as errors.
    """
    latest = times.wall_clock(
        now - timedelta(minutes=thresholds.long_running_minutes) + MAX_WRITER_OFFSET
    )
    undated = F.col("time_start").isNull() & F.col("time_end").isNull()
    return F.col("status").isin(codes.started, codes.accepted) & (
        undated | (F.col("time_start") <= latest) | (F.col("time_end") <= latest)
    )


def job_findings(
    jobs: DataFrame,
    now: datetime,
    thresholds: Thresholds = Thresholds(),
    codes: StatusCodes = StatusCodes(),
    local_tz: str = "UTC",
) -> DataFrame:
    """Findings of the job table.

    A started job is stalled when its last update is old, else long-running when its
    start is. An accepted job can only be stalled, after a much longer wait. Paused
    and unknown jobs are never findings.
    """
    candidates = job_columns.with_utc_times(
        jobs.where(job_candidates(now, thresholds, codes)), local_tz
    )
    started = F.col("status") == codes.started
    candidates = computed(
        candidates, last_update=F.coalesce("ended_at", "started_at")
    )
    last_update = F.col("last_update")
    stale = F.when(
        started, _reached(now, last_update, thresholds.database_stale_minutes)
    ).otherwise(_reached(now, last_update, thresholds.accepted_stale_hours * 60))
    long_running = started & _reached(
        now, F.col("started_at"), thresholds.long_running_minutes
    )
    finding = (
        F.when(last_update.isNull(), "error")
        .when(stale, "stalled")
        .when(long_running, "long-running")
    )
    return candidates.select(
        F.lit("database").alias("layer"),
        F.col("uuid").alias("job_id"),
        job_columns.status_name("status", codes).alias("status"),
        finding.alias("finding"),
        F.when(finding == "long-running", F.col("started_at"))
        .otherwise(last_update)
        .alias("evidence_ts"),
        F.when(last_update.isNull(), "no start or update time").alias("reason"),
        F.lit(None).cast("string").alias("evidence"),
    ).where("finding is not null")


def document_times(parsed: DataFrame, local_tz: str = "UTC") -> DataFrame:
    """Parsed documents with corrected creation time and newest sign of life."""
    creation = times.corrected_creation_time(
        F.col("labelled_creation"), F.col("modification_time"), local_tz
    )
    return computed(parsed, creation_time=creation).withColumn(
        "last_update", F.greatest("creation_time", "modification_time")
    )


def status_files(parsed: DataFrame) -> DataFrame:
    """Documents that belong to a job: those whose name is a UUID."""
    return parsed.where(F.col("job_id").rlike(fixed.UUID_PATTERN))


def xml_findings(
    parsed: DataFrame,
    dumps: DataFrame,
    errors: DataFrame,
    now: datetime,
    thresholds: Thresholds = Thresholds(),
    local_tz: str = "UTC",
    tail_bytes: int | None = None,
) -> DataFrame:
    """Findings of the status documents of jobs.

    Only started documents can be stalled. The age is tested first; a job past the
    long-running age is then judged by its dumps. With several valid ones nothing can
    be said about it, which is an error; with exactly one whose error output holds the
    scheduler's memory marker it is found without waiting for the stale age; else it is
    stalled at that age. ``evidence`` is the folder of the one valid dump. Unusable
    documents are errors.
    """
    documents = document_times(status_files(parsed), local_tz)
    broken = F.col("problem").isNotNull()
    old_enough = F.col("state").eqNullSafe("ProcessStarted") & _reached(
        now, F.col("last_update"), thresholds.long_running_minutes
    )
    suspects = documents.where(broken | old_enough).select(
        "job_id", "state", "last_update", "problem"
    )
    judged = dump_sources.evidence(suspects.where("problem is null"), dumps, errors, tail_bytes)
    stale = _reached(now, F.col("last_update"), thresholds.xml_stale_minutes)
    several = F.coalesce(F.col("dumps") > 1, F.lit(False))
    finding = (
        F.when(broken | several, "error")
        .when(F.col("is_oom"), "slurm-oom")
        .when(stale, "stalled")
    )
    return (
        suspects.join(by_shuffle(judged), "job_id", "left")
        .select(
            F.lit("xml").alias("layer"),
            "job_id",
            F.coalesce(F.when(~broken, _document_status()), F.lit("running")).alias("status"),
            finding.alias("finding"),
            F.col("last_update").alias("evidence_ts"),
            F.when(broken, F.col("problem")).when(several, SEVERAL_DUMPS).alias("reason"),
            F.when(~broken, F.col("directory")).alias("evidence"),
        )
        .where("finding is not null")
    )


def _document_status() -> Column:
    known = F.create_map(
        *[F.lit(item) for pair in fixed.DOCUMENT_STATUS.items() for item in pair]
    )
    return F.try_element_at(known, F.col("state"))


def failed_status_polls(accesses: DataFrame, output_path: str) -> DataFrame:
    """``ts, job_id`` of the requests for a status document that was not there."""
    status_path = r"^\Q" + output_path.rstrip("/") + r"\E/([0-9a-fA-F-]{36})\.xml$"
    raw_path = F.regexp_extract(
        "target", r"^(?:[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)?([^?#]*)", 1
    )
    path = percent_decoded(F.col("raw_path"))
    failed = accesses.where(
        F.col("method").isin("GET", "HEAD") & (F.col("status") == 404)
    )
    located = computed(failed.select("ts", "target"), raw_path=raw_path)
    polls = computed(located, job_id=F.regexp_extract(path, status_path, 1)).where(
        F.col("job_id").rlike(fixed.UUID_PATTERN)
    )
    return polls.select("ts", "job_id")


def not_from_the_future(polls: DataFrame, now: Column) -> DataFrame:
    """Leave out polls more than five minutes after ``now``: their clock is wrong."""
    return polls.where(F.col("ts") <= now + F.expr("interval 5 minutes"))


def missing_status_polls(
    accesses: DataFrame,
    output_path: str,
    now: datetime,
    thresholds: Thresholds = Thresholds(),
) -> DataFrame:
    """Jobs whose status document was asked for again and again but was not there."""
    earliest = times.instant(now - timedelta(minutes=thresholds.poll_window_minutes))
    recent = not_from_the_future(
        accesses.where(F.col("ts") >= earliest), times.instant(now)
    )
    return poll_groups(failed_status_polls(recent, output_path), ["job_id"], thresholds)


def enough_polls(thresholds: Thresholds) -> Column:
    span = F.unix_micros("last_seen") - F.unix_micros("first_seen")
    minimum = int(thresholds.min_poll_span_minutes * 60_000_000)
    return (F.col("polls") >= thresholds.min_poll_count) & (span >= minimum)


def poll_groups(polls: DataFrame, keys: list, thresholds: Thresholds) -> DataFrame:
    """Groups with enough polls over a long enough span."""
    return (
        polls.groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("polls"),
            F.min("ts").alias("first_seen"),
            F.max("ts").alias("last_seen"),
        )
        .where(enough_polls(thresholds))
    )


def polling_decisions(
    candidates: DataFrame,
    jobs: DataFrame,
    documents: DataFrame,
    codes: StatusCodes = StatusCodes(),
) -> DataFrame:
    """What to do about each poll candidate.

    A job whose row is not final is protected, a document that exists needs nothing,
    the rest are missing. Both other sides are reduced to distinct ids first, so a
    repeated id cannot pile up in one task.
    """
    open_jobs = (
        jobs.where(~F.coalesce(F.col("status").isin(codes.succeeded, codes.failed), F.lit(False)))
        .select(F.col("uuid").alias("job_id"))
        .distinct()
        .withColumn("is_open", F.lit(True))
    )
    existing = documents.select("job_id").distinct().withColumn("exists", F.lit(True))
    decision = (
        F.when(F.col("is_open"), "skip")
        .when(F.col("exists"), "status-exists")
        .otherwise("missing-status")
    )
    return (
        candidates.join(open_jobs, "job_id", "left")
        .join(existing, "job_id", "left")
        .withColumn("decision", decision)
        .withColumn(
            "reason", F.when(F.col("is_open"), "database-request-is-nonfinal")
        )
        .drop("is_open", "exists")
    )


def missing_status(candidates: DataFrame, documents: DataFrame) -> DataFrame:
    """Poll candidates without a status document."""
    return candidates.join(
        documents.select("job_id").distinct(), "job_id", "left_anti"
    )


def polling_findings(decisions: DataFrame) -> DataFrame:
    return decisions.where("decision = 'missing-status'").select(
        F.lit("polling").alias("layer"),
        "job_id",
        F.lit("running").alias("status"),
        F.lit("missing-status").alias("finding"),
        F.col("first_seen").alias("evidence_ts"),
        "reason",
        F.lit(None).cast("string").alias("evidence"),
    )


def dump_match(stalled: DataFrame, dumps: DataFrame) -> DataFrame:
    """Exactly one valid dump is needed to recover a job from it."""
    counted = dumps.where("is_valid").groupBy("job_id").agg(
        F.count(F.lit(1)).alias("dumps"), F.min("directory").alias("directory")
    )
    count = F.coalesce("dumps", F.lit(0))
    return (
        stalled.select("job_id")
        .join(by_shuffle(counted), "job_id", "left")
        .select(
            "job_id",
            count.alias("dumps"),
            F.when(count == 0, "missing")
            .when(count == 1, "matched")
            .otherwise("duplicate")
            .alias("match"),
            F.when(count == 1, F.col("directory")).alias("directory"),
        )
    )


def store_findings(spark: SparkSession, findings: DataFrame, path: str) -> DataFrame:
    """Write the findings of a run and read them back.

    Summary and plan use the findings several times; from the table each layer's
    documents, rows and logs are read once.
    """
    findings.write.mode("overwrite").parquet(path)
    return spark.read.schema(findings.schema).parquet(path)


def checked_counts(**layers: DataFrame) -> DataFrame:
    """``layer, checked``: one row for each layer, from a one-row count of each."""
    rows = [
        counted.select(F.lit(name).alias("layer"), F.col(counted.columns[0]).cast("bigint").alias("checked"))
        for name, counted in layers.items()
    ]
    return reduce(DataFrame.unionByName, rows)


def layer_summary(findings: DataFrame, checked: DataFrame) -> DataFrame:
    """Checked, stalled, long-running and error counts of every layer in ``checked``."""
    counts = findings.groupBy("layer").agg(
        F.count_if(F.col("finding").isin(*STALLED)).alias("stalled"),
        F.count_if(F.col("finding") == "long-running").alias("long_running"),
        F.count_if(F.col("finding") == "error").alias("errors"),
    )
    none = F.lit(0).cast("bigint")
    return checked.join(counts, "layer", "left").select(
        "layer",
        "checked",
        *[F.coalesce(name, none).alias(name) for name in ("stalled", "long_running", "errors")],
    )


def recovery_summary(plan: DataFrame, checked: DataFrame) -> DataFrame:
    """What a recovery run reports of every layer in ``checked``."""
    counts = plan.groupBy("layer").agg(
        F.count_if((F.col("action").isin("recover", "error")) & F.col("finding").isin(*STALLED)).alias("stalled"),
        F.count_if(F.col("action") == "recover").alias("recovered"),
        F.count_if(F.col("action") == "error").alias("errors"),
    )
    none = F.lit(0).cast("bigint")
    return checked.join(counts, "layer", "left").select(
        "layer",
        "checked",
        *[F.coalesce(name, none).alias(name) for name in ("stalled", "recovered", "errors")],
    )


def _counted(number: Column, noun: str) -> Column:
    return F.concat(
        number.cast("string"), F.lit(f" {noun}"), F.when(number == 1, "").otherwise("s")
    )


def overall_result(summary: DataFrame) -> DataFrame:
    """One line over the layers of a monitoring run or, with ``recovered``, a recovery."""
    names = [name for name in summary.columns if name not in ("layer", "checked")]
    total = summary.agg(*[F.coalesce(F.sum(name), F.lit(0)).alias(name) for name in names])
    result = F.when(
        F.col("errors") > 0,
        F.concat(F.lit("completed with "), _counted(F.col("errors"), "error")),
    )
    if "recovered" in names:
        recovered = F.concat(F.lit("recovered "), _counted(F.col("recovered"), "job"))
        result = result.when(F.col("recovered") > 0, recovered).otherwise("no recovery needed")
    else:
        attention = F.col("stalled") + F.col("long_running") > 0
        result = result.when(attention, "attention required").otherwise("healthy")
    return total.withColumn("result", result)


def _document_stop(findings: DataFrame, limit: int) -> str | None:
    """Name of the last document a recovery run reaches; None if it reaches all.

    The run goes through the documents by name and ends after a successful recovery,
    once ``limit`` stalled ones have been seen. A document without exactly one dump can't
    be recovered, so the run goes on beyond the limit until one can. The two look-ups
    read one row each from the stored findings.
    """
    stalled = findings.where(F.col("finding").isin(*STALLED) & (F.col("layer") == "xml"))
    last = stalled.select("job_id").distinct().orderBy("job_id").offset(limit - 1).limit(1).first()
    if last is None:
        return None
    usable = stalled.where(F.col("evidence").isNotNull() & (F.col("job_id") >= last["job_id"]))
    return usable.agg(F.min("job_id")).first()[0]


def recovery_plan(
    findings: DataFrame, thresholds: Thresholds = Thresholds()
) -> DataFrame:
    """What a recovery run would do with every finding but the long-running ones.

    Documents go in name order and need the one valid dump that ``evidence`` names;
    without it the attempt is an ``error``. The other layers recover the oldest findings
    up to their limit. What a run does not reach it leaves for the next (``defer``); no
    finding is dropped. A job whose document ended in an error in this run is ``blocked``
    in the database layer. The selected jobs are at most twice the limit, whatever the
    size of the findings; they are broadcast while that is small.
    """
    findings = findings.where(F.col("finding") != "long-running")
    is_document = F.col("layer") == "xml"
    stop = _document_stop(findings, thresholds.recovery_limit)
    reached = F.lit(True) if stop is None else F.col("job_id") <= stop
    failed_document = is_document & reached & (
        (F.col("finding") == "error") | F.col("evidence").isNull()
    )
    blocked = (
        findings.where(failed_document)
        .select("job_id", F.lit("database").alias("layer"), F.lit(True).alias("is_blocked"))
        .distinct()
    )
    known = findings.join(blocked, ["layer", "job_id"], "left")
    widest = max(thresholds.recovery_limit, thresholds.polling_recovery_limit)
    oldest = top_per_group(
        known.where(~is_document & F.col("finding").isin(*STALLED) & F.col("is_blocked").isNull())
        .select("layer", "job_id", "evidence_ts")
        .distinct(),
        ["layer"],
        [F.col("evidence_ts"), F.col("job_id")],
        widest,
    )
    limit = F.when(
        F.col("layer") == "polling", thresholds.polling_recovery_limit
    ).otherwise(thresholds.recovery_limit)
    selected = oldest.where(F.col("rank") <= limit).select("layer", "job_id", "rank")
    message = (
        F.when(F.col("finding") == "slurm-oom", fixed.MESSAGE_XML_OOM)
        .when(
            is_document,
            fixed.MESSAGE_XML_STALLED.format(minutes=thresholds.xml_stale_minutes),
        )
        .when(F.col("layer") == "polling", fixed.MESSAGE_POLLING)
        .when(
            F.col("status") == "accepted",
            fixed.MESSAGE_DB_ACCEPTED.format(hours=thresholds.accepted_stale_hours),
        )
        .otherwise(
            fixed.MESSAGE_DB_STARTED.format(minutes=thresholds.database_stale_minutes)
        )
    )
    action = (
        F.when(F.col("is_blocked"), "blocked")
        .when(is_document & ~reached, "defer")
        .when(failed_document | (F.col("finding") == "error"), "error")
        .when(is_document | F.col("rank").isNotNull(), "recover")
        .otherwise("defer")
    )
    steps = F.create_map(*[F.lit(part) for pair in LAYER_ORDER.items() for part in pair])
    return (
        known.join(
            F.broadcast(selected) if widest <= MAX_BROADCAST_LIMIT else selected,
            ["layer", "job_id"],
            "left",
        )
        .withColumn("action", action)
        .select(
            F.element_at(steps, F.col("layer")).alias("step"),
            "layer",
            "job_id",
            "finding",
            "evidence_ts",
            "action",
            "rank",
            F.coalesce("reason", F.when(F.col("action") == "error", NO_DUMP)).alias("reason"),
            "evidence",
            F.when(F.col("action") == "recover", message).alias("message"),
        )
    )


def incident_archive(
    parsed: DataFrame,
    service: str,
    archived: DataFrame | None = None,
    local_tz: str = "UTC",
) -> DataFrame:
    """Archive rows of the failed documents that are not archived yet."""
    failed = document_times(
        status_files(parsed).where("state = 'ProcessFailed' and problem is null"), local_tz
    )
    texts = F.flatten(
        F.transform(
            F.flatten(F.filter(F.col("doc.Status.ProcessFailed.ExceptionReport.Exception"), F.isnotnull)),
            lambda item: F.coalesce(item["ExceptionText"], F.array().cast("array<string>")),
        )
    )
    message = F.coalesce(F.concat_ws(" ", texts), F.lit(""))
    recovered = text.any_of(
        [F.contains(message, F.lit(marker)) for marker in fixed.RECOVERED_MARKERS]
    )
    rows = failed.select(
        F.concat_ws(
            "__",
            F.date_format("creation_time", "yyyyMMdd'T'HHmmss'Z'"),
            F.when(recovered, "recovered").otherwise("error"),
            text.name_component(F.lit(service)),
            text.name_component("process"),
            F.concat(F.col("job_id"), F.lit(".xml")),
        ).alias("archive_name"),
        "job_id",
        F.when(recovered, "recovered").otherwise("error").alias("kind"),
        "content",
    )
    if archived is None:
        return rows
    return rows.join(archived.select("archive_name").distinct(), "archive_name", "left_anti")

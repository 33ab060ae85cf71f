"""The moving-window report of the job table as a stream."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from opsight.operators import dbreport
from opsight.sources import keyed
from opsight.streaming import tables

CLOCK = "last_slide timestamp, newest timestamp"


def moving_job_summary(
    facts: DataFrame,
    window: timedelta,
    slide: timedelta,
    path: str,
    checkpoint: str,
    *,
    late: timedelta = timedelta(minutes=5),
    **trigger,
) -> StreamingQuery:
    """Store the window report of every slide, once no update up to it can arrive any more.

    ``facts`` are versions of jobs as ``dbreport.job_facts`` gives them, with ``uuid`` and
    ``event_time``, each up to ``late`` after newer ones. The last version of a job is kept
    beside ``path`` while the job is open, whatever its age, and for a window after its end,
    so what is kept does not grow with the jobs that have finished. A slide's rows are those
    of the batch report at that instant. A batch that is run again replaces its rows.
    """
    root = path.rstrip("/")
    jobs_path, clock_path = f"{root}-jobs", f"{root}-clock"

    def store(batch: DataFrame, batch_id: int) -> None:
        spark: SparkSession = batch.sparkSession
        if batch.isEmpty():
            return
        clock = _clock(spark, clock_path, batch_id)
        first, newest = batch.agg(F.min("started_at"), F.max("event_time")).first()
        newest = max(newest, clock[1]) if clock else newest
        done = clock[0] if clock else _before(first, slide)
        slides = _slides(done, newest - late, slide)
        keyed.replace_by_key(
            _merged(spark, batch, jobs_path, done - window), jobs_path, ["__kept"], ["uuid"]
        )
        known = keyed.read_keyed(spark, jobs_path).drop("__kept")
        if slides:
            instants = F.array(*[F.lit(at).cast("timestamp") for at in slides])
            reports = dbreport.moving_job_reports(known, instants, window)
            tables.write_batch(reports, root, batch_id)
        last = [(slides[-1] if slides else done, newest)]
        tables.write_batch(spark.createDataFrame(last, CLOCK).coalesce(1), clock_path, batch_id)

    return tables.run(facts, store, checkpoint, **trigger)


def _merged(spark: SparkSession, batch: DataFrame, path: str, earliest: datetime) -> DataFrame:
    """The last version of each job that any coming slide can still count.

    Of versions with one time the finished one counts. The table is rewritten as a whole.
    """
    stored = keyed.read_keyed(spark, path)
    versions = batch.withColumn("__kept", F.lit(True))
    if stored is not None:
        versions = stored.unionByName(versions)
    is_open = F.col("state").isin("accepted", "running")
    values = [name for name in versions.columns if name != "uuid"]
    last = (
        versions.groupBy("uuid")
        .agg(F.max_by(F.struct(*values), F.struct("event_time", ~is_open, F.coalesce("seconds", F.lit(-1.0)))).alias("job"))
        .select("uuid", "job.*")
    )
    return last.where(is_open | (F.greatest("started_at", "ended_at") >= F.lit(earliest)))


def _clock(spark: SparkSession, path: str, batch_id: int) -> tuple[datetime, datetime] | None:
    """Last slide and newest time of the last batch before this one."""
    if not tables.has_rows(spark, path):
        return None
    rows = spark.read.schema(f"{CLOCK}, {tables.BATCH} int").parquet(path)
    row = rows.where(F.col(tables.BATCH) < batch_id).orderBy(F.desc(tables.BATCH)).first()
    return None if row is None else (row["last_slide"], row["newest"])


def _before(instant: datetime, slide: timedelta) -> datetime:
    """The last multiple of ``slide`` that is not after ``instant``."""
    start = datetime(1970, 1, 1)
    return start + (instant - start) // slide * slide


def _slides(done: datetime, until: datetime, slide: timedelta) -> list[datetime]:
    found = []
    while done + slide <= until:
        done += slide
        found.append(done)
    return found

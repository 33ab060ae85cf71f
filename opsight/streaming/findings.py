"""Streams that find missing, long-running and stalled jobs as time passes."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from opsight.operators.findings import enough_polls
from opsight.params import StatusCodes, Thresholds
from opsight.streaming import tables


#: Polls are first counted in panes of this length.
PANE = "5 minutes"


def missing_status_windows(
    polls: DataFrame,
    thresholds: Thresholds = Thresholds(),
    slide: str = PANE,
    late: str = "5 minutes",
    pane: str = PANE,
) -> DataFrame:
    """Poll groups of every sliding window that reach the count and the span.

    ``polls`` has ``ts`` and ``job_id``, as ``findings.failed_status_polls`` gives them.
    Polls are counted once, in panes; a window is put together from its panes, so what
    is copied for each window is one row of a job and pane, however many polls it has.
    A window's row appears once, when no poll of it can arrive any more.
    """
    length = f"{int(thresholds.poll_window_minutes)} minutes"
    panes = (
        tables.watermarked(polls, "ts", late)
        .groupBy("job_id", F.window("ts", pane).alias("pane"))
        .agg(
            F.count(F.lit(1)).alias("polls"),
            F.min("ts").alias("first_seen"),
            F.max("ts").alias("last_seen"),
        )
    )
    windows = panes.groupBy(
        "job_id", F.window(F.window_time("pane"), length, slide).alias("window")
    ).agg(
        F.sum("polls").alias("polls"),
        F.min("first_seen").alias("first_seen"),
        F.max("last_seen").alias("last_seen"),
    )
    return windows.where(enough_polls(thresholds)).select(
        F.col("window.end").alias("window_end"),
        "job_id",
        "polls",
        "first_seen",
        "last_seen",
    )


FINDINGS = "job_id string, finding string, due_at timestamp"
#: What a bucket remembers: the updates still to come, then the jobs that are followed.
STATE = (
    "waiting_ids array<string>, waiting_ms array<long>, waiting_status array<int>, "
    "ids array<string>, status array<int>, started_ms array<long>, updated_ms array<long>, reported array<boolean>"
)
#: Jobs are followed in this many buckets: one call into Python serves all jobs of a bucket.
BUCKETS = 1024


class JobWatch:
    """Follows the jobs of a bucket through their updates in the order of their times.

    Updates wait in state until the watermark has passed them, so neither the order of
    arrival nor the cut into batches matters. A finding falls due at a time; it is told
    if the updates up to that time leave the job in the state that the finding is about.

    A finished job leaves a tombstone for as long as older updates may still come in
    (``late_ms``), so that a start which arrives after the end does not open it again. A
    job found stalled is remembered for ``keep_ms`` after its last update: if it wakes up
    its age still counts from its first start, and it is told only once that it runs long.
    """

    def __init__(self, thresholds: Thresholds, codes: StatusCodes, late_ms: int, keep_ms: int) -> None:
        self.codes = codes
        self.open = (codes.started, codes.accepted, codes.paused)
        self.long_ms = int(thresholds.long_running_minutes * 60_000)
        self.stale_ms = int(thresholds.database_stale_minutes * 60_000)
        self.accepted_ms = int(thresholds.accepted_stale_hours * 3_600_000)
        self.late_ms, self.keep_ms = late_ms, keep_ms

    def __call__(self, key, batches, state):
        now = state.getCurrentWatermarkMs()
        waiting, jobs = _remembered(state)
        for rows in batches:
            times = rows["event_time"].to_numpy().astype("datetime64[ns]").astype("int64") // 1_000_000
            for job, at, status in zip(rows["job_id"], times.tolist(), rows["status"]):
                waiting.setdefault(job, []).append((at, int(status)))
        found, later, following = [], {}, []
        for job in {**jobs, **waiting}:
            # At equal times the end of a job comes last.
            updates = sorted(waiting.get(job, ()), key=lambda u: (u[0], u[1] not in self.open, u[1]))
            seen, own = jobs.get(job), []
            for at, status in updates:
                if at <= now:
                    seen = self._until(seen, at - 1, own)
                    seen = self._updated(seen, at, status)
                else:
                    later.setdefault(job, []).append((at, status))
                    following.append(at)
            seen = self._until(seen, now, own)
            if seen is None:
                jobs.pop(job, None)
            else:
                jobs[job] = seen
                following += [at for at in (*(at for at, _ in self._due(seen)), self._forgotten(seen)) if at > now]
            found += [(job, name, at) for at, name in own]
        _remember(state, later, jobs)
        if following:
            # A timeout is over when the watermark is past it; what is due must not wait for that.
            state.setTimeoutTimestamp(min(following) - 1)
        if found:
            ids, names, due = zip(*found)
            yield pd.DataFrame({"job_id": ids, "finding": names, "due_at": pd.to_datetime(due, unit="ms", utc=True)})

    def _updated(self, seen, at, status):
        """The job after an update; one that is older than the last changes its start only."""
        if seen is None:
            return (status, at, at, False)
        if at < seen[2]:
            return (seen[0], min(seen[1], at), seen[2], seen[3])
        return (status, seen[1], at, seen[3])

    def _until(self, seen, now, found):
        """Tell what falls due up to ``now``; None when the job can be forgotten."""
        if seen is None:
            return None
        for at, name in self._due(seen):
            if at > now:
                continue
            found.append((at, name))
            if name == "long-running":
                seen = (*seen[:3], True)
            else:
                # Stalled is told once for an update: the status no longer counts as open.
                seen = (-1 - seen[0], *seen[1:])
        return None if self._forgotten(seen) <= now else seen

    def _due(self, seen) -> list[tuple[int, str]]:
        status, started, updated, reported = seen
        due = []
        if status in (self.codes.started, -1 - self.codes.started) and not reported:
            # A job that waited in the queue for longer is told when it starts to run.
            due.append((max(started + self.long_ms, updated), "long-running"))
        if status == self.codes.started:
            due.append((updated + self.stale_ms, "stalled"))
        if status == self.codes.accepted:
            due.append((updated + self.accepted_ms, "stalled"))
        return sorted(due)

    def _forgotten(self, seen) -> int:
        status, _, updated, _ = seen
        final = status not in self.open and -1 - status not in self.open
        return updated + (self.late_ms if final else self.keep_ms)


def _remembered(state) -> tuple[dict, dict]:
    """Waiting updates and followed jobs of a bucket, by job."""
    if not state.exists:
        return {}, {}
    waiting_ids, waiting_ms, waiting_status, ids, *columns = state.get
    waiting: dict = {}
    for job, at, status in zip(waiting_ids, waiting_ms, waiting_status):
        waiting.setdefault(job, []).append((at, status))
    return waiting, dict(zip(ids, zip(*columns)))


def _remember(state, waiting: dict, jobs: dict) -> None:
    if not waiting and not jobs:
        if state.exists:
            state.remove()
        return
    updates = [(job, at, status) for job, some in waiting.items() for at, status in some]
    columns = [list(column) for column in zip(*updates)] or [[], [], []]
    columns += [list(jobs), *([list(column) for column in zip(*jobs.values())] or [[], [], [], []])]
    state.update(tuple(columns))


def _duration_ms(text: str) -> int:
    return int(pd.Timedelta(text).total_seconds() * 1000)


def job_findings(
    updates: DataFrame,
    thresholds: Thresholds = Thresholds(),
    codes: StatusCodes = StatusCodes(),
    late: str = "5 minutes",
    keep: str = "42 days",
    buckets: int = BUCKETS,
) -> DataFrame:
    """Long-running and stalled jobs at the moment they become so.

    ``updates`` has ``job_id``, ``status`` and ``event_time``; each may arrive up to
    ``late`` after updates that are newer. Event-time timeouts fire when later updates
    arrive; a stream that can fall silent needs heartbeat rows. Jobs are spread over
    ``buckets`` by a hash of their id, which must stay the same for a checkpoint; a task
    holds the open jobs of one bucket. With many open jobs use the RocksDB state store
    (``session.ROCKSDB_PROVIDER``).
    """
    watch = JobWatch(thresholds, codes, _duration_ms(late), _duration_ms(keep))

    def follow(key, batches, state):
        return watch(key, batches, state)

    return (
        tables.watermarked(updates, "event_time", late)
        .withColumn("bucket", F.pmod(F.xxhash64("job_id"), F.lit(buckets)))
        .groupBy("bucket")
        .applyInPandasWithState(
            follow,
            outputStructType=FINDINGS,
            stateStructType=STATE,
            outputMode="append",
            timeoutConf=GroupStateTimeout.EventTimeTimeout,
        )
    )

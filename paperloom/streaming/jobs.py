"""The life of jobs as a stream: attempts that succeed, fail, or fall silent, from status events in any order within the watermark."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.window import Window

#: Seconds of silence after which an attempt has failed, and the statuses that end one.
SILENT, ENDS = 600, ("success", "failure")
ATTEMPT = "job_id long, attempt long, status string, started long, ended long, n_events long"
_PROVIDER, _ROCKSDB = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _close(job_id: int, now: tuple, status: str, ended: int) -> Row:
    attempt, started, _, n = now
    return Row(job_id=job_id, attempt=attempt, status=status, started=started, ended=ended, n_events=n)


class Lifecycle(StatefulProcessor):
    """Waits for the watermark before it folds a job's events in the order of their time, so their arrival does not matter.

    State: one value, with the open attempt (number, start, last event, events), the events that the watermark has not passed,
    and the time of the job's one timer: that of the earliest waiting event or the end of the silence that is allowed. A call
    to the state takes far longer than an event, so a job's events of a batch cost one reading and one writing. Times are
    microseconds.
    """

    def __init__(self, silent: int = SILENT):
        self.silent = silent * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", "attempt long, started long, last long, n long, wake long, waiting array<struct<us: long, event_id: long, status: string>>")

    def _pass(self, job_id: int, new: list[tuple], watermark: int, fired: int | None = None) -> list[Row]:
        """Folds what the watermark (milliseconds) has passed; fired is the time of the timer that called, in milliseconds."""
        upto = watermark * 1000
        before = self.job.get()
        *now, wake, waiting = (0, None, None, 0, None, []) if before is None else before
        now, wake = tuple(now), None if wake == fired else wake
        held = [tuple(e) for e in waiting or []] + new
        due, later = sorted(e for e in held if e[0] <= upto), [e for e in held if e[0] > upto]
        out = []
        for us, _, status in due:
            if now[1] is not None and us - now[2] > self.silent:
                out.append(_close(job_id, now, "timeout", now[2] + self.silent))
                now = (now[0], None, None, 0)
            now = (now[0] + 1, us, us, 1) if now[1] is None else (now[0], now[1], us, now[3] + 1)
            if status in ENDS:
                out.append(_close(job_id, now, status, us))
                now = (now[0], None, None, 0)
        if now[1] is not None and now[2] + self.silent <= upto:
            out.append(_close(job_id, now, "timeout", now[2] + self.silent))
            now = (now[0], None, None, 0)
        times = [e[0] for e in later] + ([now[2] + self.silent] if now[1] is not None else [])
        at = -(-min(times) // 1000) if times else None
        if at != wake:
            if wake is not None:
                self.handle.deleteTimer(wake)
            if at is not None:
                self.handle.registerTimer(at)
        self.job.update((*now, at, later))
        return out

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: ANN001, N802, N803
        new = [(r["us"], r["event_id"], r["status"]) for r in rows]
        return iter(self._pass(key[0], new, timerValues.getCurrentWatermarkInMs()))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: ANN001, N802, N803
        return iter(self._pass(key[0], [], timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs()))

    def close(self) -> None:
        pass


def attempts(events: DataFrame, late: str = "1 hour", silent: int = SILENT) -> DataFrame:
    """ATTEMPT of a stream of events (job_id, event_id, ts, status): a row when an attempt ends, numbered from 1 in each job.

    Events later than the watermark are dropped. State keeps a job's events of that time only, and its open attempt. It needs
    the RocksDB state store: see ``keyed_state``.
    """
    seen = events.withWatermark("ts", late).select("job_id", "event_id", "ts", F.unix_micros("ts").alias("us"), "status")
    return seen.groupBy("job_id").transformWithState(Lifecycle(silent), ATTEMPT, "append", "eventTime")


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """The session with the state store that ``attempts`` needs; the setting before comes back at the end."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)


def fold(events: DataFrame, silent: int = SILENT) -> DataFrame:
    """The attempts of a table of events, where nothing more is to come: the last silence counts as well."""
    own = Window.partitionBy("job_id").orderBy("us", "event_id")
    us = events.select("job_id", "event_id", F.unix_micros("ts").alias("us"), "status")
    new = F.lag("us").over(own).isNull() | F.lag("status").over(own).isin(*ENDS) | (F.col("us") - F.lag("us").over(own) > silent * 1_000_000)
    numbered = us.withColumn("new", new.cast("long")).withColumn("attempt", F.sum("new").over(own))
    last = F.max_by("status", F.struct("us", "event_id"))
    rows = numbered.groupBy("job_id", "attempt").agg(last.alias("status"), F.min("us").alias("started"), F.max("us").alias("last"), F.count("*").alias("n_events"))
    over = F.col("status").isin(*ENDS)
    return rows.select("job_id", "attempt", F.when(over, F.col("status")).otherwise("timeout").alias("status"), "started", F.when(over, F.col("last")).otherwise(F.col("last") + silent * 1_000_000).alias("ended"), "n_events")

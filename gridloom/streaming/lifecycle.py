"""Job life cycle: state machine, retries, monotone progress, restart recovery (STM operators).

Events: (job, attempt, seq, kind, processed, ts); kinds: created, progress, failed, completed.
PENDING turns PROCESSING on the first progress; a failure retries while fewer than ``max_retries``
were spent, then the job is FAILED; progress never falls, not even by a retry; terminal states stay.
"""

from __future__ import annotations

import datetime
import threading
from collections.abc import Callable, Iterator
from itertools import islice

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQueryListener
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues
from pyspark.sql.window import Window

MAX_RETRIES = 2
OUT = "job long, status string, attempt int, retry_count int, processed long"
TERMINAL = ("SUCCEEDED", "FAILED")
COLUMNS = [c.split()[0] for c in OUT.split(", ")]
START = ("PENDING", 0, 0, 0)
#: what ``track`` needs in the session's configuration; timers are looked after in batches without data, so a run with the trigger ``availableNow``
#: only ends with the second setting
STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
BOUNDED = {"spark.sql.streaming.noDataMicroBatches.enabled": "false"}


def order_key(attempt, seq):
    """STM-06."""
    return attempt * 10000 + seq


def step(state: tuple, kind: str, processed: int | None) -> tuple:
    """STM-01 to 03: the state (status, attempt, retries, processed) after an event."""
    status, attempt, retries, done = state
    if status in TERMINAL:
        return state
    if kind == "progress":
        return "PROCESSING", attempt, retries, max(done, int(processed or 0))
    if kind == "failed":
        return ("PROCESSING", attempt + 1, retries + 1, done) if retries < MAX_RETRIES else ("FAILED", attempt, retries, done)
    if kind == "completed":
        return "SUCCEEDED", attempt, retries, max(done, int(processed or 0))
    return state


def needed(events: list[tuple]) -> list[tuple]:
    """Of events (attempt, seq, kind, processed), in their order, those that can still change a job's state whatever comes later.

    An event after the first completion or after the failure that ends the last retry has no effect, and what comes later only moves that end to
    the front. Of progress only that counts which exceeds all before it. So a job keeps its failures, one completion and a rising
    staircase of progress, not its events.
    """
    kept, fails, top, last = [], 0, -1, None
    for e in sorted(events, key=lambda e: e[:2]):
        if e[:2] == last:
            continue
        last = e[:2]
        if e[2] == "progress":
            if int(e[3] or 0) <= top:
                continue
            top = int(e[3] or 0)
        kept.append(e)
        fails += e[2] == "failed"
        if e[2] == "completed" or fails > MAX_RETRIES:
            break
    return kept


class Lifecycle(StatefulProcessor):
    """STM-01 to 05: each job's state, whatever the order in which its events come.

    ``log`` is the list of events in effect (``needed``): a batch's events are merged into it and the state is folded anew, so
    an event of a lower order that comes in a later batch takes its place and a redelivered one changes nothing (nor does one of an attempt before ``base``). ``early`` is the list
    of events of an attempt that hasn't begun, as the failure before it is missing: they wait for that failure or for a timer of ``patience``
    and then count as they stand. ``base`` is the state that a restart found (STM-04), ``shown`` what was sent last. All four are dropped after ``ttl``
    without a change.
    """

    BATCH = 4096  # events merged at a time

    def __init__(self, patience: datetime.timedelta, ttl: datetime.timedelta):
        self.patience, self.ttl = (int(d.total_seconds() * 1000) for d in (patience, ttl))

    def init(self, handle: StatefulProcessorHandle) -> None:
        event, state = "attempt int, seq long, kind string, processed long", "status string, attempt int, retry_count int, processed long"
        self.handle = handle
        self.log = handle.getListState("log", event, self.ttl)
        self.early = handle.getListState("early", event, self.ttl)
        self.base = handle.getValueState("base", state, self.ttl)
        self.shown = handle.getValueState("shown", state, self.ttl)

    def _apply(self, key: tuple, log: list[tuple], early: list[tuple], now: int, give_up: bool = False) -> Iterator[Row]:
        start = tuple(self.base.get()) if self.base.exists() else START
        waiting = early
        while True:  # a failure may begin the attempt that others wait for
            state = start
            for _, _, kind, processed in log:
                state = step(state, kind, processed)
            begun = waiting[-1][0] if waiting and give_up else state[1]
            ready = [e for e in waiting if e[0] <= begun]
            if not ready:
                break
            log, waiting = needed(log + ready), [e for e in waiting if e[0] > begun]
        self.log.put(log) if log else self.log.clear()
        self.early.put(waiting) if waiting else self.early.clear()
        if waiting and not list(self.handle.listTimers()):
            self.handle.registerTimer(now + self.patience)
        if not self.shown.exists() or tuple(self.shown.get()) != state:
            self.shown.update(state)
            yield Row(**dict(zip(COLUMNS, (*key, *state), strict=True)))

    def _held(self) -> tuple[list[tuple], list[tuple]]:
        return ([tuple(r) for r in x.get()] if x.exists() else [] for x in (self.log, self.early))

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        log, early = self._held()
        first = self.base.get()[1] if self.base.exists() else 0
        begun = max([first, *(e[0] for e in log)])
        while some := [(r["attempt"], r["seq"], r["kind"], r["processed"]) for r in islice(rows, self.BATCH)]:
            some = [e for e in some if e[0] >= first]
            log = needed(log + [e for e in some if e[0] <= begun])
            early = needed(early + [e for e in some if e[0] > begun])
        yield from self._apply(key, log, early, timerValues.getCurrentProcessingTimeInMs())

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        log, early = self._held()
        yield from self._apply(key, log, early, timerValues.getCurrentProcessingTimeInMs(), give_up=True)

    def handleInitialState(self, key: tuple, initialState: Row, timerValues: TimerValues) -> None:
        self.base.update(tuple(initialState[c] for c in ("status", "attempt", "retry_count", "processed")))


def track(events: DataFrame, jobs: DataFrame | None = None, patience: datetime.timedelta = datetime.timedelta(minutes=10), ttl: datetime.timedelta = datetime.timedelta(days=7)) -> DataFrame:
    """STM-01 to 05 as a streaming query (update mode): the state of each job that a batch changes, equal to ``replay`` of what has come so far.

    ``jobs`` (job, status, attempt, retry_count, processed) are the jobs that an earlier run left; those PROCESSING take the failure of a restart
    (``recover``) before any event. Needs the RocksDB state store (``STATE_STORE``).
    """
    initial = None
    if jobs is not None:
        initial = recover(jobs.withColumn("error_code", F.lit(None).cast("string"))).select("job", "status", "attempt", "retry_count", "processed").groupBy("job")
    return events.groupBy("job").transformWithState(Lifecycle(patience, ttl), OUT, "Update", "ProcessingTime", initialState=initial)


def replay(events: DataFrame) -> DataFrame:
    """The same for a bounded relation, in windows only: state after all events of each job."""
    once = events.dropDuplicates(["job", "attempt", "seq"])
    w = Window.partitionBy("job").orderBy("attempt", "seq")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    fails = F.coalesce(F.sum((F.col("kind") == "failed").cast("int")).over(w), F.lit(0))
    prior_done = F.coalesce(F.max((F.col("kind") == "completed").cast("int")).over(before), F.lit(0))
    prior_fails = F.coalesce(F.sum((F.col("kind") == "failed").cast("int")).over(before), F.lit(0))
    live = once.withColumns({"_f": fails, "_d": prior_done, "_pf": prior_fails}).filter((F.col("_d") == 0) & (F.col("_pf") <= MAX_RETRIES))
    failed = F.count_if(F.col("kind") == "failed")
    status = (
        F.when(F.count_if(F.col("kind") == "completed") > 0, "SUCCEEDED").when(failed > MAX_RETRIES, "FAILED").when(F.count_if(F.col("kind").isin("progress", "failed")) > 0, "PROCESSING").otherwise("PENDING")
    )
    retries = F.least(failed, F.lit(MAX_RETRIES)).cast("int")
    done = F.coalesce(F.max(F.when(F.col("kind").isin("progress", "completed"), F.col("processed"))), F.lit(0))
    return live.groupBy("job").agg(status.alias("status"), retries.alias("attempt"), retries.alias("retry_count"), done.alias("processed"))


def recover(jobs: DataFrame) -> DataFrame:
    """STM-04: jobs that a restart found PROCESSING take one failure (STALE_RESTART); PENDING ones are left alone."""
    stale = F.col("status") == "PROCESSING"
    again = stale & (F.col("retry_count") < MAX_RETRIES)
    return jobs.withColumns(
        {"status": F.when(stale & ~again, "FAILED").otherwise(F.col("status")), "attempt": F.col("attempt") + again.cast("int"), "retry_count": F.col("retry_count") + again.cast("int"), "error_code": F.when(stale, "STALE_RESTART").otherwise(F.col("error_code"))}
    )


def progress(jobs: DataFrame, reports: DataFrame) -> DataFrame:
    """AGG-03, AGG-04, STM-02: stored progress and status after reports (job, processed), of which the greatest counts."""
    top = reports.groupBy("job").agg(F.max("processed").alias("_p"))
    out = jobs.join(top, "job", "left")
    return out.withColumns({"status": F.when(F.col("_p").isNotNull() & (F.col("status") == "PENDING"), "PROCESSING").otherwise(F.col("status")), "processed": F.greatest("processed", F.coalesce("_p", F.lit(0)))}).drop("_p")


class _Ended(StreamingQueryListener):
    """Tells when a query has nothing left to wait for."""

    def __init__(self, over: Callable[[], bool]):
        self.over, self.run, self.done = over, None, threading.Event()

    def onQueryStarted(self, event: object) -> None:
        pass

    def _look(self, run: object) -> None:
        if str(run) == str(self.run) and not self.done.is_set() and self.over():
            self.done.set()

    def onQueryProgress(self, event: object) -> None:
        self._look(event.progress.runId)

    def onQueryIdle(self, event: object) -> None:
        self._look(event.runId)

    def onQueryTerminated(self, event: object) -> None:
        if str(event.runId) == str(self.run):
            self.done.set()


def follow(states: DataFrame, path: str, checkpoint: str, every: str = "2 seconds", most: float | None = None) -> bool:
    """STM-07: run ``states`` (of ``track``) every two seconds into ``path`` until all jobs seen are in a terminal state; whether they are (else ``most`` seconds are over).

    A batch is written as the folder batch=<id>, over what an earlier try left, so a batch that is sent again changes nothing. ``shown`` reads the last
    state of each job. A failure of the query is raised.
    """
    spark = states.sparkSession

    def write(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    def over() -> bool:
        now = shown(spark, path).agg(F.count("*").alias("n"), F.count_if(~F.col("status").isin(*TERMINAL)).alias("open")).first()
        return now["n"] > 0 and not now["open"]

    ended = _Ended(over)
    spark.streams.addListener(ended)
    query = states.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()
    ended.run = query.runId
    try:
        ended.done.wait(most)
        if query.exception() is not None:
            raise query.exception()
    finally:
        query.stop()
        spark.streams.removeListener(ended)
    return over()


def shown(spark: SparkSession, path: str) -> DataFrame:
    """The last state of each job that ``follow`` wrote."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], OUT)
    rows = spark.read.schema(f"{OUT}, batch long").parquet(path)
    return rows.groupBy("job").agg(F.max_by(F.struct("status", "attempt", "retry_count", "processed"), "batch").alias("_s")).select("job", "_s.*")

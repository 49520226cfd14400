"""Keyed streaming state: receive counts per message (R3, W5) and alarms over periods.

Both jobs keep what they must remember in the state store, one small value per key, found
by key when a row arrives: no written history is read. ``prepare_state`` selects the RocksDB
store, which keeps state on disk and uploads changes to the checkpoint.
"""

from __future__ import annotations

import math
import os
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .. import schemas as S
from ..functions import timefmt
from ..session import importable
from . import jobs


def prepare_state(spark: SparkSession) -> None:
    """Settings that keyed state needs; they hold for streams started later in the session."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    importable(spark)


@contextmanager
def _setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def _stores(spark: SparkSession, partitions: int | None):
    return _setting(spark, "spark.sql.shuffle.partitions", str(partitions or spark.conf.get("spark.sql.shuffle.partitions")))


# ---------------------------------------------------------------------------
# Failed deliveries of a message, counted until it is given up
# ---------------------------------------------------------------------------

RECEIVED = "email_id string, reason string, receive_count int, first_us bigint, last_us bigint, gave_up boolean"


class ReceiveCounter(StatefulProcessor):
    """Per message id: deliveries seen, first and last receive time, greatest reason.

    A row for every id that a micro-batch brings; ``gave_up`` is true in the one that reaches
    ``limit`` deliveries. The value of an id is forgotten ``keep_days`` after its last change (the
    retention of the queue itself)."""

    def __init__(self, limit: int, keep_days: float):
        self.limit, self.keep_ms = limit, int(keep_days * 86_400_000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "n int, first bigint, last bigint, reason string", self.keep_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        n, first, last, reason = self.seen.get() or (0, None, None, None)  # asked once, told once
        before = n
        for row in rows:
            n += 1
            if row.at_us is not None:  # a time that is missing counts as a delivery all the same
                first = row.at_us if first is None else min(first, row.at_us)
                last = row.at_us if last is None else max(last, row.at_us)
            if row.reason is not None and (reason is None or row.reason > reason):
                reason = row.reason
        self.seen.update((n, first, last, reason))
        yield Row(email_id=key[0], reason=reason, receive_count=n, first_us=first, last_us=last, gave_up=before < self.limit <= n)

    def close(self) -> None:
        pass


def receive_states(deliveries: DataFrame, *, limit: int = S.MAX_RECEIVES, keep_days: float = S.DEAD_LETTER_RETENTION_DAYS) -> DataFrame:
    """A stream of ``email_id, reason, delivered_ts`` -> a stream of the counts after each micro-batch."""
    spark = deliveries.sparkSession
    prepare_state(spark)
    at = F.timestamp_diff("MICROSECOND", F.expr(timefmt.EPOCH_NTZ), F.col("delivered_ts"))
    rows = deliveries.select("email_id", "reason", at.alias("at_us"))
    # rows, not data frames: most ids bring one row, for which a frame costs far more than the work
    return rows.groupBy("email_id").transformWithState(
        ReceiveCounter(limit, keep_days), outputStructType=RECEIVED, outputMode="Update", timeMode="ProcessingTime")


def _times(states: DataFrame) -> DataFrame:
    at = {f"{n}_received_ts": F.timestamp_add("MICROSECOND", F.col(f"{n}_us"), F.expr(timefmt.EPOCH_NTZ)) for n in ("first", "last")}
    return states.withColumns(at).drop("first_us", "last_us")


def receive_stream(spark: SparkSession, deliveries: DataFrame, *, out: str, checkpoint: str, limit: int = S.MAX_RECEIVES,
                   keep_days: float = S.DEAD_LETTER_RETENTION_DAYS, partitions: int | None = None) -> dict[str, str]:
    """R3 as a job: ``states`` gets the counts after each micro-batch, ``dead_letters`` each id once, when
    it reaches ``limit`` deliveries. Both are folders by micro-batch, rewritten by a replay. ``partitions`` is
    the number of state stores, fixed with the first start from a checkpoint (None: the session's shuffle partitions)."""
    paths = {k: os.path.join(out, k) for k in ("states", "dead_letters")}

    def handle(batch: DataFrame, batch_id: int) -> None:
        jobs.write_batch(_times(batch), paths["states"], batch_id)
        changed = spark.read.parquet(os.path.join(paths["states"], f"batch_id={batch_id}"))
        jobs.write_batch(changed.where("gave_up").drop("gave_up"), paths["dead_letters"], batch_id)

    states = receive_states(deliveries, limit=limit, keep_days=keep_days)
    # state that is kept by the clock would have empty micro-batches follow one another for ever
    with _setting(spark, "spark.sql.streaming.noDataMicroBatches.enabled", "false"), _stores(spark, partitions):
        jobs.run_available(states, handle, checkpoint=checkpoint, output_mode="update")
    return paths


def latest_states(spark: SparkSession, path: str) -> DataFrame:
    """The last count of every id."""
    rows = spark.read.option("basePath", path).parquet(path)
    cols = [c for c in rows.columns if c not in ("email_id", "batch_id", "gave_up")]
    return rows.groupBy("email_id").agg(F.max_by(F.struct(*cols), "batch_id").alias("_s")).select("email_id", "_s.*")


# ---------------------------------------------------------------------------
# Alarms that know their state
# ---------------------------------------------------------------------------

OK, ALARM = "OK", "ALARM"

TRANSITION = "alarm string, idx bigint, value bigint, from_state string, to_state string"


class AlarmState(StatefulProcessor):
    """Judges closed periods in order and speaks once for each change of state.

    The value of an alarm is the last period judged, the ``lookback`` values before the next
    one, the breaches in a row and the state. Periods without any record are judged as 0: those before
    a period with records when it closes, those after the last one by an event-time timer
    at their end. ``width`` deviations around the mean of the lookback are the band (W1, W2); with a
    ``threshold`` instead, a value above it is a breach (W3). ``run`` breaches in a row raise the alarm, and a
    period without one ends it.
    """

    def __init__(self, period_s: int, *, run: int, lookback: int = 0, width: float = 0.0, threshold: float | None = None):
        self.period_s, self.run, self.lookback, self.width, self.threshold = period_s, run, lookback, width, threshold

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("alarm", "last bigint, recent string, breaches int, state string, timer bigint")

    def breach(self, recent: list[int], value: int) -> bool:
        if self.threshold is not None:
            return value > self.threshold
        if len(recent) < self.lookback:
            return False
        n = len(recent)
        mean = sum(recent) / n
        sd = math.sqrt(sum((x - mean) ** 2 for x in recent) / (n - 1))
        return value < mean - self.width * sd or value > mean + self.width * sd

    def _judge(self, key, last, recent, breaches, state, idx, value, out):
        breaches = breaches + 1 if self.breach(recent, value) else 0
        now = ALARM if breaches >= self.run else OK
        if now != state:
            out.append((key[0], idx, value, state, now))
        recent = (recent + [value])[-self.lookback:] if self.lookback else []
        return idx, recent, breaches, now

    def _save(self, last, recent, breaches, state, old_timer) -> None:
        # the end of the period after the last one judged, in milliseconds
        timer = (last + 2) * self.period_s * 1000
        if old_timer is not None and old_timer != timer:
            self.handle.deleteTimer(old_timer)
        if old_timer != timer:
            self.handle.registerTimer(timer)
        self.state.update((last, ",".join(map(str, recent)), breaches, state, timer))

    def _load(self):
        if not self.state.exists():
            return None, [], 0, OK, None
        last, recent, breaches, state, timer = self.state.get()
        return last, [int(x) for x in recent.split(",") if x], breaches, state, timer

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        closed: dict[int, int] = {}
        for batch in rows:
            for idx, value in zip(batch["idx"], batch["value"]):
                closed[int(idx)] = closed.get(int(idx), 0) + int(value)
        last, recent, breaches, state, timer = self._load()
        out: list[tuple] = []
        for idx in sorted(closed):
            if last is not None and idx <= last:
                continue  # judged as empty already: cannot happen, as a period closes before its timer fires
            for empty in range(last + 1, idx) if last is not None else ():
                last, recent, breaches, state = self._judge(key, last, recent, breaches, state, empty, 0, out)
            last, recent, breaches, state = self._judge(key, last, recent, breaches, state, idx, closed[idx], out)
        if last is not None:
            self._save(last, recent, breaches, state, timer)
        yield _transitions(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        last, recent, breaches, state, timer = self._load()
        out: list[tuple] = []
        if last is not None and timer == expiredTimerInfo.getExpiryTimeInMs():
            # every period that has ended by now is empty, or it would have been judged
            ended = timerValues.getCurrentWatermarkInMs() // (self.period_s * 1000) - 1
            for empty in range(last + 1, max(ended, last + 1) + 1):
                last, recent, breaches, state = self._judge(key, last, recent, breaches, state, empty, 0, out)
            self._save(last, recent, breaches, state, None)
        yield _transitions(out)

    def close(self) -> None:
        pass


def _transitions(rows: list[tuple]) -> pd.DataFrame:
    names = ["alarm", "idx", "value", "from_state", "to_state"]
    frame = pd.DataFrame(rows, columns=names)
    return frame.astype({"alarm": "object", "idx": "int64", "value": "int64", "from_state": "object", "to_state": "object"})


def alarm_stream(spark: SparkSession, events: DataFrame, processor: AlarmState, *, alarm: str, out: str, checkpoint: str, ts: str = "received_ts",
                 delay: str = "1 hour", action=None, partitions: int | None = None) -> DataFrame:
    """A stream of events -> the changes of state of one alarm, each once.

    Events are counted by period first (a period's count closes when the watermark, ``delay`` behind the newest
    event, has passed its end), so that one narrow row per period reaches the alarm. ``action(transitions)`` is
    called with the changes of a micro-batch, if there are any; the changes are written first, so an action is
    repeated only for a micro-batch that is replayed, and can tell by ``(alarm, idx)``. Alarms are not told about
    events later than ``delay``; the counts of ``jobs.windowed_counts`` are.
    """
    prepare_state(spark)
    period = f"{processor.period_s} seconds"
    timed = events.select(timefmt.ntz_to_instant(F.col(ts)).alias("at")).withWatermark("at", delay)
    counts = timed.groupBy(F.window("at", period)).agg(F.count(F.lit(1)).alias("value"))
    closed = counts.select(
        F.lit(alarm).alias("alarm"), F.window_time("window").alias("at"),
        F.floor(F.unix_seconds("window.start") / processor.period_s).cast("bigint").alias("idx"), "value")
    changes = closed.groupBy("alarm").transformWithStateInPandas(processor, outputStructType=TRANSITION, outputMode="Append", timeMode="EventTime")

    def handle(batch: DataFrame, batch_id: int) -> None:
        jobs.write_batch(batch, out, batch_id)
        if action is not None:
            written = spark.read.parquet(os.path.join(out, f"batch_id={batch_id}"))
            if written.limit(1).count():
                action(written)

    with _stores(spark, partitions):  # as in ``receive_stream``; an alarm's state is one row
        jobs.run_available(changes, handle, checkpoint=checkpoint, output_mode="append")
    return spark.read.option("basePath", out).parquet(out)

"""Keyed streaming state: receive counts and alarms; latency sketches."""

import math
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from mailsift.functions import timefmt
from mailsift.operators import sketches
from mailsift.streaming import jobs, state


def files(spark, root, schema, *parts):
    for rows in parts:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(root))
        time.sleep(1.1)
    return jobs.parquet_files(spark, str(root), spark.createDataFrame([], schema).schema, max_files_per_trigger=1)


def test_receives_are_counted_over_batches(spark, tmp_path):
    def at(h):
        return (pd.Timestamp("2024-01-01") + pd.Timedelta(hours=h)).to_pydatetime()

    schema = "email_id string, reason string, delivered_ts timestamp_ntz"
    stream = files(spark, tmp_path / "in", schema, [("a", "x", at(5)), ("b", None, at(1)), ("c", "z", None)],
                   [("a", "y", at(2)), ("c", None, at(3))], [("a", "x", at(9)), (None, "n", at(1)), ("d", "q", at(1)), ("d", "q", at(1)), ("d", "q", at(4))])
    out, ckpt = jobs.fresh_locations(spark, "t_receives")
    paths = state.receive_stream(spark, stream, out=out, checkpoint=ckpt)
    got = {r.email_id: (r.receive_count, r.reason, r.first_received_ts and r.first_received_ts.hour, r.last_received_ts and r.last_received_ts.hour)
           for r in state.latest_states(spark, paths["states"]).collect()}
    assert got == {"a": (3, "y", 2, 9), "b": (1, None, 1, 1), "c": (2, "z", 3, 3), None: (1, "n", 1, 1), "d": (3, "q", 1, 4)}
    dead = sorted((r.email_id, r.receive_count) for r in spark.read.parquet(paths["dead_letters"]).collect())
    assert dead == [("a", 2), ("c", 2), ("d", 3)]


def test_counts_are_forgotten(spark, tmp_path):
    """With a retention of a second, a delivery after it counts as a first one."""
    schema = "email_id string, reason string, delivered_ts timestamp_ntz"
    row = [("a", "x", pd.Timestamp("2024-01-01").to_pydatetime())]
    root = tmp_path / "in"
    out, ckpt = jobs.fresh_locations(spark, "t_forgotten")
    for _ in range(2):
        stream = files(spark, root, schema, row)
        time.sleep(1.5)
        paths = state.receive_stream(spark, stream, out=out, checkpoint=ckpt, keep_days=1 / 86400)
    assert [r.receive_count for r in spark.read.parquet(paths["states"]).collect()] == [1, 1]
    assert spark.read.parquet(paths["dead_letters"]).count() == 0


class Held:
    """A value state and timers in memory."""

    def __init__(self):
        self.value, self.timers = None, set()

    def getValueState(self, *a):
        return self

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, v):
        self.value = v

    def registerTimer(self, t):
        self.timers.add(t)

    def deleteTimer(self, t):
        self.timers.remove(t)


def run_alarm(judge, closed, watermark):
    """Periods in the micro-batches ``closed``; the watermark after each."""
    held = Held()
    judge.init(held)
    out = []

    class Now:
        def __init__(self, ms):
            self.ms = ms

        def getCurrentWatermarkInMs(self):
            return self.ms

        getExpiryTimeInMs = getCurrentWatermarkInMs

    for rows, mark in zip(closed, watermark):
        if rows:
            frame = pd.DataFrame({"idx": list(rows), "value": list(rows.values())})
            out += [f for f in judge.handleInputRows(("x",), iter([frame]), None)]
        for t in sorted(t for t in held.timers if t <= mark):
            held.timers.remove(t)
            out += [f for f in judge.handleExpiredTimer(("x",), Now(mark), Now(t))]
    return [tuple(r) for f in out for r in f.itertuples(index=False)]


def test_alarm_turns_once_and_comes_back():
    judge = state.AlarmState(10, run=2, threshold=5)
    got = run_alarm(judge, [{1: 9, 2: 3}, {4: 7, 3: 6}, {5: 9}, {}, {9: 9}], [30_000, 50_000, 60_000, 90_000, 100_000])
    # 3 and 4 breach; the timer judges 6 as empty; 9 alone is no run of two
    assert got == [("x", 4, 7, "OK", "ALARM"), ("x", 6, 0, "ALARM", "OK")]


def test_band_judges_empty_periods_between():
    values = {i: 10 + i % 2 for i in range(8)} | {11: 10}
    got = run_alarm(state.AlarmState(10, run=1, lookback=4, width=2.0), [values], [0])
    brute, recent, run, now = [], [], 0, "OK"
    for i in range(12):
        v = values.get(i, 0)
        n = len(recent)
        mean = sum(recent) / n if n else 0
        sd = math.sqrt(sum((x - mean) ** 2 for x in recent) / (n - 1)) if n > 1 else 0
        run = run + 1 if n == 4 and not mean - 2 * sd <= v <= mean + 2 * sd else 0
        new = "ALARM" if run >= 1 else "OK"
        brute += [("x", i, v, now, new)] if new != now else []
        now, recent = new, (recent + [v])[-4:]
    assert got == brute and got


def test_alarm_stream_acts_once_a_transition(spark, tmp_path):
    def at(m):
        return (pd.Timestamp("2024-01-01") + pd.Timedelta(minutes=m)).to_pydatetime()

    acted = []
    stream = files(spark, tmp_path / "in", "email_id string, received_ts timestamp_ntz", [("a", at(1)), ("b", at(2)), ("c", at(3))], [("d", at(12))], [("e", at(55))])
    out, ckpt = jobs.fresh_locations(spark, "t_alarm")
    got = state.alarm_stream(spark, stream, state.AlarmState(600, run=1, threshold=2), alarm="burst", out=out, checkpoint=ckpt, delay="1 minute",
                             action=lambda df: acted.extend((r.idx, r.to_state) for r in df.collect()))
    first = int(pd.Timestamp("2024-01-01").timestamp()) // 600
    assert sorted((r.idx, r.from_state, r.to_state) for r in got.collect()) == [(first, "OK", "ALARM"), (first + 1, "ALARM", "OK")]
    assert sorted(acted) == [(first, "ALARM"), (first + 1, "OK")]


def test_line_sink_keeps_each_line_once(spark, tmp_path):
    """Retried tasks, an aborted micro-batch and a replayed one."""
    from mailsift.streaming import sink

    path = str(tmp_path / "lines")
    assert sink.read_lines(spark, path).count() == 0
    w = sink.LineWriter(path)
    w.write(iter([("lost",)]))  # a task that was retried: nobody names its file
    w.commit([w.write(iter([("a",), ("b",)])), w.write(iter([]))], 0)
    w.commit([w.write(iter([("c",)])), None], 1)
    w.abort([w.write(iter([("gone",)])), None], 2)
    w.commit([w.write(iter([("c",)]))], 1)  # replayed
    assert sorted(r.value for r in sink.read_lines(spark, path).collect()) == ["a", "b", "c"]


def test_sketches_of_days_merge(spark, tmp_path):
    rows = spark.range(20_000).select(
        (F.col("id") % 3).cast("string").alias("category"), F.expr("timestampadd(HOUR, CAST(id % 240 AS INT), TIMESTAMP_NTZ'2024-01-01 00:00:00')").alias("received_ts"))
    rows = rows.withColumn("processed_ts", F.expr("timestampadd(MILLISECOND, CAST(xxhash64(received_ts, category) % 50000 AS INT) + 50000, received_ts)"))
    path = str(tmp_path / "s")
    sketches.write_sketches(rows, path)
    sketches.write_sketches(rows.where("received_ts < TIMESTAMP_NTZ'2024-01-02 00:00:00'"), path)  # a day again
    got = {r.category: r for r in sketches.latency_between(spark, path, "2024-01-03", "2024-01-06").collect()}
    for category, g in ((c, x.sort_values("l")["l"].to_numpy()) for c, x in sketches.latency_seconds(rows).where(
            "received_date BETWEEN DATE'2024-01-03' AND DATE'2024-01-06'").selectExpr("category", "latency_s AS l").toPandas().groupby("category")):
        r = got[category]
        assert r.n == len(g) and r.max_s == g.max()
        for q, v in ((0.5, r.p50_s), (0.95, r.p95_s)):
            assert (g < v).mean() - sketches.rank_error() <= q <= (g <= v).mean() + sketches.rank_error()
    assert sketches.latency_between(spark, path, "2025-01-01", "2025-01-02").count() == 0


@pytest.mark.parametrize("values,want", [(["not a date"], [None])])
def test_timeless(values, want, spark):
    got = spark.createDataFrame([(v,) for v in values], "t string").select(timefmt.parse_iso(F.col("t")).alias("p")).collect()
    assert [r.p for r in got] == want

"""Registered streaming queries (R1, R2, R5): each runs a Structured Streaming
job to completion over a supplied table read as a file stream, then
returns the job's output table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import timefmt
from ..operators import alerts, rules
from ..session import scratch_path
from ..sources import mail, views
from ..streaming import jobs, sink, state
from .q_metrics import BAND_SQL, LOOKBACK, PERIOD_S, fix_oracles
from .q_triage import ALERT_EVENTS_SQL
from .registry import register


def _files_out_of_order(spark, sf_dir, name, key):
    """A supplied table in five parts, each with rows of early and of late days, read by a stream in about
    five micro-batches. Every task writes its rows of each part, so that no part passes through one task."""
    root = scratch_path(spark, f"files-{name}")
    rows = views.table(spark, sf_dir, name)
    part = F.pmod(F.floor(F.col(key) / 7), F.lit(5))
    rows.withColumn("part", part).write.partitionBy("part").parquet(root)
    return jobs.parquet_files(spark, root, rows.schema, max_files_per_trigger=jobs.in_turns(spark, root, 5))


@register("stream_dedup", """
SELECT email_id, copy_no FROM deliveries
WHERE copy_no = 1 AND email_id NOT IN (SELECT email_id FROM stored_ids)""",
          ("deliveries", "stored_ids"))
def q_stream_dedup(spark, sf_dir):
    out, ckpt = jobs.fresh_locations(spark, "stream_dedup")
    docs = _files_out_of_order(spark, sf_dir, "documents", "doc_id")
    deliveries = views.deliveries_from(views.messages_from(docs))
    res = jobs.dedup_stream(spark, deliveries, out=out, checkpoint=ckpt,
                            stored_ids=views.stored_ids(spark, sf_dir))
    return res.select("email_id", "copy_no")


@register("stream_dead_letters", """
SELECT email_id, 'missing_body' AS reason, CAST(2 AS INTEGER) AS receive_count,
       received_ts AS first_received_ts, received_ts + INTERVAL 1 MINUTE AS last_received_ts
FROM messages WHERE body IS NULL AND doc_id % 100 = 13
""", ("messages",))
def q_stream_dead_letters(spark, sf_dir):
    """Every message without a body fails; some are delivered again, by a later file, and
    become dead letters with their second failure."""
    out, ckpt = jobs.fresh_locations(spark, "stream_dead_letters")
    root = scratch_path(spark, "files-deliveries")
    doc = F.col("doc_id")
    twice = F.when(doc % 100 == 13, 2).otherwise(1)
    m = views.messages(spark, sf_dir).withColumn("copy_no", F.explode(F.sequence(F.lit(1), twice)))
    m = m.withColumns({"delivered_ts": F.expr("timestampadd(MINUTE, copy_no - 1, received_ts)"),
                       "delivery_id": F.concat_ws("#", "email_id", F.col("copy_no").cast("string"))})
    m.withColumn("part", F.col("copy_no")).write.partitionBy("part").parquet(root)
    stream = jobs.parquet_files(spark, root, m.schema, max_files_per_trigger=jobs.in_turns(spark, root, 2))
    paths = jobs.triage_stream(spark, stream, views.model_responses(spark, sf_dir), out=out, checkpoint=ckpt,
                               now=timefmt.ntz_literal("2024-06-01 00:00:00"))
    return spark.read.option("basePath", paths["dead_letters"]).parquet(paths["dead_letters"]).drop("batch_id")


@register("stream_receive_state", """
SELECT email_id, CAST(count(*) AS INTEGER) AS receive_count, min(delivered_ts) AS first_received_ts,
       max(delivered_ts) AS last_received_ts, count(*) >= 2 AS dead_letter
FROM deliveries GROUP BY email_id""", ("deliveries",))
def q_stream_receive_state(spark, sf_dir):
    """R3 on keyed state: every delivery fails, five parts out of order; counts and dead letters of
    the stream are those of all deliveries at once."""
    out, ckpt = jobs.fresh_locations(spark, "receive_state")
    root = scratch_path(spark, "files-receives")
    number = F.pmod(F.floor(F.col("doc_id") / 7) + F.col("copy_no") * 2, F.lit(5))
    d = views.deliveries(spark, sf_dir).withColumn("reason", rules.quarantine_reason()).select("doc_id", "copy_no", "email_id", "reason", "delivered_ts")
    d.withColumn("part", number).write.partitionBy("part").parquet(root)
    stream = jobs.parquet_files(spark, root, d.schema, max_files_per_trigger=jobs.in_turns(spark, root, 5))
    paths = state.receive_stream(spark, stream, out=out, checkpoint=ckpt, partitions=spark.sparkContext.defaultParallelism)
    dead = spark.read.parquet(paths["dead_letters"]).groupBy("email_id").agg((F.count(F.lit(1)) == 1).alias("dead_letter"))
    counts = state.latest_states(spark, paths["states"]).drop("reason")
    return counts.join(dead, "email_id", "left").withColumn("dead_letter", F.coalesce("dead_letter", F.lit(False)))


# Periods close when the newest record is an hour past their end.
ALARM_SQL = BAND_SQL.strip() + f""",
closed AS (
  SELECT idx, value, breach FROM band
  WHERE (idx + 1) * {PERIOD_S} <= (SELECT floor(epoch(max(received_ts))) - 3600 FROM triage_history WHERE sentiment = 'negative')),
judged AS (
  SELECT idx, value, coalesce(count(*) OVER w = @RUN@ AND bool_and(breach) OVER w, false) AS alarm, breach
  FROM closed WINDOW w AS (ORDER BY idx ROWS BETWEEN @BEFORE@ PRECEDING AND CURRENT ROW)),
changes AS (SELECT *, coalesce(lag(alarm) OVER (ORDER BY idx), false) AS before FROM judged)
SELECT idx, value, CASE WHEN before THEN 'ALARM' ELSE 'OK' END AS from_state, CASE WHEN alarm THEN 'ALARM' ELSE 'OK' END AS to_state
FROM changes WHERE alarm <> before"""


def _files_in_order(spark, sf_dir):
    """The history in five files by time, one a trigger."""
    root = scratch_path(spark, "files-history")
    rows = views.triage_history(spark, sf_dir).where("sentiment = 'negative'").select("email_id", "received_ts")
    days = rows.select(F.min("received_ts").alias("a")).first()["a"]
    part = F.least(F.lit(4), F.floor(F.timestamp_diff("HOUR", F.lit(days), F.col("received_ts")) / F.lit(144))).cast("int")
    for n in range(5):  # files are read in the order of their times
        rows.where(part == n).coalesce(1).write.mode("append").parquet(root)
    return jobs.parquet_files(spark, root, rows.schema, max_files_per_trigger=1)


def _alarm_query(run: int):
    def query(spark, sf_dir):
        out, ckpt = jobs.fresh_locations(spark, "alarms")
        judge = state.AlarmState(PERIOD_S, run=run, lookback=LOOKBACK, width=2.0)
        got = state.alarm_stream(spark, _files_in_order(spark, sf_dir), judge, alarm="negative sentiment", out=out, checkpoint=ckpt, partitions=1)
        return got.select("idx", "value", "from_state", "to_state")

    query.__doc__ = f"W1, W2 in the stream: changes of state of the anomaly alarm after {run} breaches in a row."
    return query


for _run in (1, 3):
    register(f"stream_alarm_{_run}", "WITH " + ALARM_SQL.replace("@RUN@", str(_run)).replace("@BEFORE@", str(_run - 1)))(_alarm_query(_run))
fix_oracles("stream_alarm_1", "stream_alarm_3")


@register("stream_triage", """
SELECT email_id, category, urgency, review_status, pii_entities_detected, redacted_body FROM triaged_all""", ("triaged_all",))
def q_stream_triage(spark, sf_dir):
    """The triage job on a stream of out-of-order files equals the batch."""
    out, ckpt = jobs.fresh_locations(spark, "stream_triage")
    docs = _files_out_of_order(spark, sf_dir, "documents", "doc_id")
    paths = jobs.triage_stream(spark, views.deliveries_from(views.messages_from(docs)), views.model_responses(spark, sf_dir),
                               out=out, checkpoint=ckpt, now=timefmt.ntz_literal("2024-06-01 00:00:00"))
    got = spark.read.option("basePath", paths["records"]).parquet(paths["records"])
    return got.select("email_id", "category", "urgency", "review_status", "pii_entities_detected", "redacted_body")


@register("stream_sentiment_windows", """
SELECT TIMESTAMP '1970-01-01' + to_seconds(CAST(floor(epoch(received_ts) / 86400) * 86400 AS BIGINT)) AS window_start,
       sentiment, count(*) AS n
FROM triage_history GROUP BY ALL""", ("triage_history",))
def q_stream_sentiment_windows(spark, sf_dir):
    out, ckpt = jobs.fresh_locations(spark, "stream_windows")
    records = views.triage_history_from(_files_out_of_order(spark, sf_dir, "events", "event_id"))
    return jobs.windowed_counts(spark, records, out=out, checkpoint=ckpt, period="1 day")


@register("stream_ingest", """
SELECT email_id, from_address,
       CASE WHEN doc_id % 50 = 13 THEN '[POISON-PILL] ' || subject ELSE subject END AS subject,
       CASE WHEN doc_id % 50 = 13 THEN NULL ELSE text END AS body, raw_s3_key, received_at
FROM messages""", ("messages",))
def q_stream_ingest(spark, sf_dir):
    root = scratch_path(spark, "corpus")
    mail.write_corpus(views.mail_corpus(spark, sf_dir), root)
    out, ckpt = jobs.fresh_locations(spark, "stream_ingest")
    res = jobs.ingest_stream(spark, jobs.corpus_stream(spark, root, jobs.in_turns(spark, root, 5)), out=out, checkpoint=ckpt)
    return res.select("email_id", "from_address", "subject", "body", "raw_s3_key", "received_at")


@register("stream_alerts", """
, alerted_all AS (
  SELECT *, CASE WHEN urgency = 'high' THEN 'urgent' WHEN review_status = 'needs_review' THEN 'needs_review'
                 ELSE 'informational' END AS alert_type FROM triaged_all)
""".replace("\n, alerted_all", ",\nalerted_all") + ALERT_EVENTS_SQL.replace("FROM alerted", "FROM alerted_all"), ("triaged_all",))
def q_stream_alerts(spark, sf_dir):
    """The alert folders that the stream wrote, by type and micro-batch, hold each event once."""
    out, ckpt = jobs.fresh_locations(spark, "stream_alerts")
    docs = _files_out_of_order(spark, sf_dir, "documents", "doc_id")
    paths = jobs.triage_stream(spark, views.deliveries_from(views.messages_from(docs)), views.model_responses(spark, sf_dir),
                               out=out, checkpoint=ckpt, now=timefmt.ntz_literal("2024-06-01 00:00:00"))
    return spark.read.option("basePath", paths["alerts"]).parquet(paths["alerts"]).select("email_id", "alert_type", "body")


@register("stream_line_sink", """
, alerted_history AS (
  SELECT *, CASE WHEN urgency = 'high' THEN 'urgent' WHEN review_status = 'needs_review' THEN 'needs_review'
                 ELSE 'informational' END AS alert_type FROM triage_history)
""".replace("\n, alerted_history", ",\nalerted_history") + "SELECT body AS value FROM (" + ALERT_EVENTS_SQL.strip().replace("FROM alerted", "FROM alerted_history") + ")", ("triage_history",))
def q_stream_line_sink(spark, sf_dir):
    """S8 as a data source: alert bodies of the history, five files, then a second run that finds nothing new."""
    out, ckpt = jobs.fresh_locations(spark, "line_sink")
    records = views.triage_history_from(_files_out_of_order(spark, sf_dir, "events", "event_id"))
    for _ in range(2):
        sink.write_lines(alerts.alert_events(records).select("body"), out, ckpt)
    return sink.read_lines(spark, out)

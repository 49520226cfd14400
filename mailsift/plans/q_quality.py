"""Registered delivery-quality queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import timefmt
from ..operators import metrics, quality, store
from ..session import scratch_path
from ..sources import views
from . import triage as M
from .q_triage import triaged
from .registry import register

RANKED = """
ranked AS (
  SELECT d.*, row_number() OVER (PARTITION BY email_id ORDER BY delivered_ts, delivery_id) AS rn
  FROM deliveries d)"""


@register("triage_put", """
SELECT email_id, arg_max(copy_no, delivered_ts) AS copy_no,
       strftime(max(delivered_ts) + INTERVAL 5 SECOND, '%Y-%m-%dT%H:%M:%S') || '+00:00' AS processed_at,
       CASE WHEN any_value(doc_id) % 40 IN (5, 10, 25) THEN NULL
            ELSE CAST(any_value(received_ts) AS DATE) + CAST(max(copy_no) AS INTEGER) - 1 END AS received_date
FROM deliveries GROUP BY email_id""", ("deliveries",))
def q_triage_put(spark, sf_dir):
    """Two rounds through the writer: the first two copies of every message in one batch, then
    the third copies with a repeat of the first ones, which are older than what is stored. Each copy of a
    message says it arrived a day later than the one before, and some have no day or one that cannot be read."""
    d = views.deliveries(spark, sf_dir)
    said = timefmt.iso_utc(F.timestamp_add("DAY", F.col("copy_no") - 1, F.col("received_ts")))
    part = F.col("doc_id") % 40
    d = d.withColumn("received_at", F.when(part == 5, F.lit(None)).when(part.isin(10, 25), F.lit("not a date")).otherwise(said))
    versions = d.select("email_id", "copy_no", "received_at",
                        F.timestamp_add("SECOND", F.lit(5), F.col("delivered_ts")).alias("processed_ts"))
    path = scratch_path(spark, "put")
    store.put(versions.where("copy_no <= 2"), path, spark)
    store.put(versions.where("copy_no IN (1, 3)"), path, spark)
    return spark.read.parquet(path).select("email_id", "copy_no", timefmt.iso_utc(F.col("processed_ts")).alias("processed_at"), "received_date")


@register("receive_count", f"""
WITH {RANKED.strip()}
SELECT email_id, delivery_id, CASE WHEN rn <= 2 THEN CAST(rn AS INTEGER) END AS receive_no, rn > 2 AS dead_letter
FROM ranked""".replace("WITH ranked", ", ranked"), ("deliveries",))
def q_receive_count(spark, sf_dir):
    r = quality.receive_counts(views.deliveries(spark, sf_dir))
    return r.select("email_id", "delivery_id", "receive_no", "dead_letter")


@register("dlq_alarm", f"""
WITH {RANKED.strip()}
SELECT TIMESTAMP '1970-01-01' + to_seconds(CAST(floor(epoch(delivered_ts) / 60) * 60 AS BIGINT)) AS bucket_start,
       count(*) AS total, count(*) > 0 AS alarm
FROM ranked WHERE rn > 2 GROUP BY 1""".replace("WITH ranked", ", ranked"), ("deliveries",))
def q_dlq_alarm(spark, sf_dir):
    r = quality.receive_counts(views.deliveries(spark, sf_dir)).where("dead_letter")
    return metrics.threshold_alarm(r.withColumn("one", F.lit(1)), ts="delivered_ts", value="one", period_s=60)


@register("dlq_redrive", f"""
WITH {RANKED.strip()}
SELECT email_id, 'receive_limit' AS reason, CAST(count(*) AS INTEGER) AS receive_count,
       min(delivered_ts) AS first_received_ts, max(delivered_ts) AS last_received_ts, 'redrive' AS action
FROM ranked GROUP BY email_id HAVING count(*) > 2
UNION ALL
SELECT email_id, 'missing_body', 1, received_ts, received_ts, 'keep'
FROM messages WHERE email_id NOT IN (SELECT email_id FROM stored_ids) AND body IS NULL
""".replace("WITH ranked", ", ranked"), ("deliveries", "stored_ids"))
def q_dlq_redrive(spark, sf_dir):
    ranked = quality.receive_counts(views.deliveries(spark, sf_dir))
    q = triaged(spark, sf_dir).quarantined
    return quality.redrive_plan(quality.dead_letters(ranked, q))


@register("review_queue", """
SELECT email_id, received_at FROM triaged
WHERE review_status = 'needs_review'
  AND email_id NOT IN (SELECT 'doc-' || doc_id FROM documents WHERE doc_id % 3 = 1)""", ("triaged",))
def q_review_queue(spark, sf_dir):
    reviewed = views.table(spark, sf_dir, "documents").where(F.col("doc_id") % 3 == 1).select(
        F.concat(F.lit("doc-"), F.col("doc_id")).alias("email_id"))
    return quality.review_queue(triaged(spark, sf_dir).records, reviewed).select("email_id", "received_at")


@register("reconcile_raw", """
SELECT coalesce(t.raw_s3_key, r.raw_s3_key) AS raw_s3_key, t.email_id AS record_id,
       CASE WHEN t.email_id IS NOT NULL AND r.raw_s3_key IS NOT NULL THEN 'both'
            WHEN t.email_id IS NOT NULL THEN 'record_only' ELSE 'raw_only' END AS status
FROM triaged t FULL OUTER JOIN (SELECT raw_s3_key FROM messages WHERE doc_id % 15 <> 3) r
  ON t.raw_s3_key = r.raw_s3_key""", ("triaged",))
def q_reconcile_raw(spark, sf_dir):
    raw = views.messages(spark, sf_dir).where(F.col("doc_id") % 15 != 3).select("raw_s3_key")
    return quality.reconcile(triaged(spark, sf_dir).records, raw)


@register("trace_join", """
SELECT d.email_id, d.deliveries, q.reason AS quarantine_reason, a.review_status, a.alert_type,
       a.review_status IS NOT NULL AS stored
FROM (SELECT email_id, count(*) AS deliveries FROM deliveries GROUP BY email_id) d
LEFT JOIN (SELECT email_id, 'missing_body' AS reason
           FROM messages WHERE email_id NOT IN (SELECT email_id FROM stored_ids) AND body IS NULL) q USING (email_id)
LEFT JOIN alerted a USING (email_id)""", ("deliveries", "alerted"))
def q_trace_join(spark, sf_dir):
    return quality.trace(views.deliveries(spark, sf_dir), triaged(spark, sf_dir).outcome)


@register("pipeline_health", f"""
WITH {RANKED.strip()}
SELECT 'deliveries' AS stage, count(*) AS n FROM deliveries
UNION ALL SELECT 'new_messages', count(*) FROM messages WHERE email_id NOT IN (SELECT email_id FROM stored_ids)
UNION ALL SELECT 'quarantined', count(*) FROM messages WHERE email_id NOT IN (SELECT email_id FROM stored_ids)
                                              AND body IS NULL
UNION ALL SELECT 'stored', count(*) FROM triaged
UNION ALL SELECT 'needs_review', count(*) FROM triaged WHERE review_status = 'needs_review'
UNION ALL SELECT 'urgent_alerts', count(*) FROM alerted WHERE alert_type = 'urgent'
UNION ALL SELECT 'dead_letters', count(*) FROM ranked WHERE rn > 2""".replace("WITH ranked", ", ranked"),
          ("deliveries", "alerted"))
def q_pipeline_health(spark, sf_dir):
    return quality.pipeline_health(views.deliveries(spark, sf_dir), triaged(spark, sf_dir).outcome)


def _sinks(spark, name):
    base = scratch_path(spark, name)
    return {f"{k}_path": f"{base}/{k}" for k in ("store", "alerts", "metrics", "quarantine")}


@register("batch_recovery", """
SELECT email_id, CASE WHEN urgency = 'high' THEN 'urgent' WHEN review_status = 'needs_review' THEN 'needs_review'
                      ELSE 'informational' END AS alert_type, 1 AS alerts, CASE WHEN classification_failed THEN 3 ELSE 2 END AS metrics
FROM triaged_all
UNION ALL SELECT email_id, 'quarantine', 1, 0 FROM messages WHERE body IS NULL""", ("triaged_all",))
def q_batch_recovery(spark, sf_dir):
    """M2 after a crash: one run stops after the store write, the batch comes again, and then once more."""
    to = _sinks(spark, "recovery")
    now = timefmt.ntz_literal("2024-06-01 00:00:00")
    d, answers = views.deliveries(spark, sf_dir), views.model_responses(spark, sf_dir)
    M.stage_run(M.triage(d, answers, now=now), to["store_path"], "run-stopped")
    half = spark.read.parquet(f"{to['store_path']}.runs/run-stopped")
    M.append_run(spark, M.split_outcome(half).records, to["store_path"], first=True)
    for _ in range(2):
        M.run_batch(spark, d, answers, now=now, **to)
    stored = spark.read.parquet(to["store_path"])
    alerts = spark.read.json(to["alerts_path"]).groupBy("email_id", "alert_type").agg(F.count(F.lit(1)).cast("int").alias("alerts"))
    lines = spark.read.parquet(to["metrics_path"]).groupBy("email_id").agg(F.count(F.lit(1)).cast("int").alias("metrics"))
    good = stored.select("email_id").join(alerts, "email_id").join(lines, "email_id").select("email_id", "alert_type", "alerts", "metrics")
    bad = spark.read.parquet(to["quarantine_path"]).select("email_id", F.lit("quarantine").alias("alert_type"), F.lit(1).alias("alerts"), F.lit(0).alias("metrics"))
    return good.unionByName(bad)


@register("alert_sink_failure", """
SELECT 'SentimentCount' AS metric, count(*) AS lines, count(*)::BIGINT AS value FROM triaged_all
UNION ALL SELECT 'PiiEntitiesDetected', count(*), sum(pii_entities_detected)::BIGINT FROM triaged_all
UNION ALL SELECT 'ClassificationFailure', count(*), count(*) FROM triaged_all WHERE classification_failed
UNION ALL SELECT 'AlertPublishFailure', count(*), count(*) FROM triaged_all""", ("triaged_all",))
def q_alert_sink_failure(spark, sf_dir):
    """The topic is gone; the records stay and every one of them says so in its metrics."""
    to = _sinks(spark, "degraded")

    def gone(events):
        raise OSError("topic is gone")

    M.run_batch(spark, views.deliveries(spark, sf_dir), views.model_responses(spark, sf_dir), now=timefmt.ntz_literal("2024-06-01 00:00:00"),
                alert_sink=gone, **to)
    lines = spark.read.parquet(to["metrics_path"]).join(spark.read.parquet(to["store_path"]).select("email_id"), "email_id")
    return lines.groupBy("metric").agg(F.count(F.lit(1)).alias("lines"), F.sum("value").alias("value"))


@register("dlq_redrive_run", """
SELECT email_id, category, review_status FROM triaged_all WHERE doc_id % 20 = 0""", ("triaged_all",))
def q_dlq_redrive_run(spark, sf_dir):
    """J8 carried out: dead letters that a retry can mend go back on the (empty) queue, and the batch job stores them."""
    to = _sinks(spark, "redrive")
    d = views.deliveries(spark, sf_dir)
    bad = M.triage(d, views.model_responses(spark, sf_dir), now=timefmt.ntz_literal("2024-06-01 00:00:00")).quarantined
    plan = quality.redrive_plan(quality.dead_letters(quality.receive_counts(d), bad))
    queue = quality.redrive(d.where(F.lit(False)), plan, d.where("copy_no = 1"))
    M.run_batch(spark, queue, views.model_responses(spark, sf_dir), now=timefmt.ntz_literal("2024-06-01 00:00:00"), **to)
    return spark.read.parquet(to["store_path"]).select("email_id", "category", "review_status")


@register("processed_now", """
SELECT email_id, true AS recent, true AS same_text, CAST(floor(epoch(received_ts)) AS BIGINT) + 7776000 AS ttl FROM triage_history""", ("triage_history",))
def q_processed_now(spark, sf_dir):
    """F12 without a given time: the write time is the clock's, as text and as time."""
    rows = store.with_write_fields(views.triage_history(spark, sf_dir).select("email_id", "received_at"))
    here = timefmt.to_ntz_utc(F.current_timestamp())
    recent = F.abs(F.timestamp_diff("MINUTE", F.col("processed_ts"), here)) < 60
    same = timefmt.epoch_seconds(timefmt.parse_iso(F.col("processed_at"))) == timefmt.epoch_seconds(F.col("processed_ts"))
    return rows.select("email_id", recent.alias("recent"), same.alias("same_text"), "ttl")


@register("run_health", """
SELECT 'deliveries' AS stage, count(*) AS n FROM deliveries
UNION ALL SELECT 'new_messages', count(*) FROM messages
UNION ALL SELECT 'quarantined', count(*) FROM messages WHERE body IS NULL
UNION ALL SELECT 'stored', count(*) FROM triaged_all
UNION ALL SELECT 'needs_review', count(*) FROM triaged_all WHERE review_status = 'needs_review'
UNION ALL SELECT 'urgent_alerts', count(*) FROM triaged_all WHERE urgency = 'high'""", ("deliveries", "triaged_all"))
def q_run_health(spark, sf_dir):
    """A12 from the run itself: counted while its outcome was written."""
    to = _sinks(spark, "health")
    path = to["store_path"] + "-health"
    M.run_batch(spark, views.deliveries(spark, sf_dir), views.model_responses(spark, sf_dir), now=timefmt.ntz_literal("2024-06-01 00:00:00"),
                health_path=path, **to)
    return spark.read.parquet(path).select("stage", "n")

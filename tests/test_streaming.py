"""Structured Streaming jobs equal their batch counterparts."""

from pyspark.sql import functions as F

from mailsift.functions import timefmt
from mailsift.operators import metrics
from mailsift.plans import triage as M
from mailsift.sources import views
from mailsift.streaming import jobs


def test_dedup_stream_equals_batch_and_replay_adds_nothing(spark, sf_small):
    out, ckpt = jobs.fresh_locations(spark, "t_dedup")
    stream = views.deliveries_from(views.messages_from(jobs.parquet_stream(spark, sf_small, "documents")))
    got = jobs.dedup_stream(spark, stream, out=out, checkpoint=ckpt, stored_ids=views.stored_ids(spark, sf_small))
    batch = M.new_messages(views.deliveries(spark, sf_small), views.stored_ids(spark, sf_small))
    ids = sorted(r.email_id for r in got.select("email_id").collect())
    assert ids == sorted(r.email_id for r in batch.select("email_id").collect())
    _, ckpt2 = jobs.fresh_locations(spark, "t_dedup_replay")
    again = jobs.dedup_stream(spark, stream, out=out, checkpoint=ckpt2, stored_ids=views.stored_ids(spark, sf_small))
    assert again.count() == len(ids)


def test_window_stream_equals_batch(spark, sf_small):
    out, ckpt = jobs.fresh_locations(spark, "t_windows")
    recs = views.triage_history_from(jobs.parquet_stream(spark, sf_small, "events"))
    got = jobs.windowed_counts(spark, recs, out=out, checkpoint=ckpt, period="1 day")
    batch = metrics.sentiment_counts(views.triage_history(spark, sf_small), period_s=86400)
    a = sorted((r.window_start, r.sentiment, r.n) for r in got.collect())
    b = sorted((r.period_start, r.sentiment, r.sentiment_count) for r in batch.collect())
    assert a == b and len(a) > 0


def test_triage_stream_equals_batch(spark, sf_small):
    out, ckpt = jobs.fresh_locations(spark, "t_triage")
    now = timefmt.ntz_literal("2024-06-01 00:00:00")
    stream = views.deliveries_from(views.messages_from(jobs.parquet_stream(spark, sf_small, "documents")))
    responses = views.model_responses(spark, sf_small)
    paths = jobs.triage_stream(spark, stream, responses, out=out, checkpoint=ckpt, now=now)
    streamed = spark.read.option("basePath", paths["records"]).parquet(paths["records"]).drop("batch_id")
    batch = M.triage(views.deliveries(spark, sf_small), responses, now=now).records
    cols = ["email_id", "category", "urgency", "review_status", "redacted_body", "pii_entities_detected", "ttl"]
    assert sorted(tuple(r) for r in streamed.select(cols).collect()) == sorted(tuple(r) for r in batch.select(cols).collect())
    alerts = spark.read.option("basePath", paths["alerts"]).parquet(paths["alerts"])
    assert alerts.count() == batch.count()
    assert {r.alert_type for r in alerts.select("alert_type").distinct().collect()} <= {
        "urgent", "needs_review", "informational"}


def test_ingest_stream(spark, tmp_path):
    plain = b"From: Jane <jane@example.com>\r\nSubject: Hi\r\nContent-Type: text/plain\r\n\r\nbody\r\n"
    root = tmp_path / "bucket" / "raw-emails"
    root.mkdir(parents=True)
    for name in ("a", "b"):
        (root / name).write_bytes(plain)
    out, ckpt = jobs.fresh_locations(spark, "t_ingest")
    got = jobs.ingest_stream(spark, jobs.binary_stream(spark, str(tmp_path / "bucket")), out=out, checkpoint=ckpt)
    assert sorted(r.email_id for r in got.collect()) == ["a", "b"]
    assert {r.from_address for r in got.collect()} == {"jane@example.com"}


DELIVERY = ("email_id string, from_address string, subject string, body string, raw_s3_key string, received_at string, "
            "delivered_at string, delivery_id string, doc_id long")


def _files(spark, tmp_path, *files):
    """One Parquet file for each list of (id, day, body, delivery number), in order of arrival."""
    import time

    root = tmp_path / "in"
    for n, rows in enumerate(files):
        made = [(i, "a@b", "s", body, f"raw-emails/{i}", f"2024-01-{day:02d}T00:00:00+00:00", f"2024-01-{day:02d} 0{k}:00:00", f"{i}#{k}", 1)
                for i, day, body, k in rows]
        df = spark.createDataFrame(made, DELIVERY)
        df = df.withColumns({"received_ts": F.to_timestamp_ntz(F.substring("delivered_at", 1, 10)),
                             "delivered_ts": F.to_timestamp_ntz("delivered_at")}).drop("delivered_at")
        df.coalesce(1).write.mode("append").parquet(str(root))
        time.sleep(1.1)
    return jobs.parquet_files(spark, str(root), df.schema, max_files_per_trigger=1)


def test_late_messages_are_kept(spark, tmp_path):
    stream = _files(spark, tmp_path, [("a", 20, "x", 0)], [("b", 21, "x", 0)], [("c", 22, "x", 0)], [("d", 10, "x", 0), ("e", 10, "x", 0), ("a", 20, "x", 1)],
                    [("f", 23, "x", 0)])
    out, ckpt = jobs.fresh_locations(spark, "t_late")
    got = jobs.dedup_stream(spark, stream, out=out, checkpoint=ckpt)
    assert sorted(r.email_id for r in got.collect()) == list("abcdef")
    out, ckpt = jobs.fresh_locations(spark, "t_late_windows")
    counted = jobs.windowed_counts(spark, stream.withColumn("sentiment", F.lit("negative")), out=out, checkpoint=ckpt)
    assert sorted((r.window_start.day, r.n) for r in counted.collect()) == [(10, 2), (20, 2), (21, 1), (22, 1), (23, 1)]


def test_failures_become_dead_letters_and_a_broken_sink_a_metric(spark, tmp_path):
    stream = _files(spark, tmp_path, [("bad", 5, None, 0), ("once", 5, None, 0), ("good", 5, "x", 0)], [("bad", 5, None, 1)], [("bad", 5, None, 2)])
    responses = spark.createDataFrame([], "email_id string, attempt int, raw_text string")

    def broken(events):
        raise OSError("topic is gone")

    out, ckpt = jobs.fresh_locations(spark, "t_dead")
    paths = jobs.triage_stream(spark, stream, responses, out=out, checkpoint=ckpt, alert_sink=broken)
    dead = spark.read.parquet(paths["dead_letters"]).collect()
    assert [(r.email_id, r.reason, r.receive_count, r.first_received_ts.hour, r.last_received_ts.hour) for r in dead] == [
        ("bad", "missing_body", 2, 0, 1)]
    assert [r.email_id for r in spark.read.parquet(paths["records"]).collect()] == ["good"]
    found = {r.metric for r in spark.read.parquet(paths["metrics"]).collect()}
    assert "AlertPublishFailure" in found

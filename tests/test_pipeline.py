"""The triage job end to end (M2) on literal messages, with its sinks."""

import json
import os
import tempfile

from pyspark.sql import functions as F

from mailsift.functions import timefmt
from mailsift.plans import triage as M

MSG = dict(email_id="msg-001", from_address="jane@example.com", subject="Help with billing",
           body="Hi, my name is John Doe. I was charged twice for my subscription.",
           received_at="2026-06-21T10:00:00+00:00", raw_s3_key="raw-emails/msg-001")
COLS = ["email_id", "from_address", "subject", "body", "received_at", "raw_s3_key"]
SCHEMA = ", ".join(f"{c} string" for c in COLS)


def answer(category="billing", urgency="medium", sentiment="negative", confidence="high", **kw):
    d = dict(category=category, urgency=urgency, sentiment=sentiment, confidence=confidence,
             suggested_reply="We'll look into it.")
    d.update(kw)
    return json.dumps(d)


def msgs(spark, *rows):
    return spark.createDataFrame([tuple({**MSG, **r}.get(c) for c in COLS) for r in rows], SCHEMA)


def t4(spark, *rows):
    return spark.createDataFrame(list(rows), "email_id string, attempt int, raw_text string")


def NOW():
    return timefmt.ntz_literal("2026-06-21 10:00:05")


def run(spark, messages, responses, **kw):
    res = M.triage(messages, responses, now=NOW(), **kw)
    return {r.email_id: r for r in res.records.collect()}, {r.email_id: r.reason for r in res.quarantined.collect()}


def test_happy_path_all_fields(spark):
    recs, bad = run(spark, msgs(spark, {}), t4(spark, ("msg-001", 1, answer())))
    r = recs["msg-001"]
    assert not bad
    assert (r.category, r.urgency, r.urgency_override_applied, r.review_status) == ("billing", "high", True,
                                                                                   "auto_processed")
    assert r.processed_at == "2026-06-21T10:00:05+00:00"
    assert r.pii_entities_detected == 0 and r.feature_tags == [] and r.suggested_reply == "We'll look into it."
    assert r.redacted_body == MSG["body"]


def test_ttl_value(spark):
    recs, _ = run(spark, msgs(spark, {"received_at": "2026-06-21T14:30:00+00:00"}),
                  t4(spark, ("msg-001", 1, answer())))
    assert recs["msg-001"].ttl == 1789828200


def test_duplicates_and_stored_ids_skipped(spark):
    m = msgs(spark, {}, {}, {"email_id": "msg-002"})
    stored = spark.createDataFrame([("msg-002",)], "email_id string")
    recs, _ = run(spark, m, t4(spark, ("msg-001", 1, answer()), ("msg-002", 1, answer())), stored_ids=stored)
    assert list(recs) == ["msg-001"]


def test_low_confidence_and_failed(spark):
    m = msgs(spark, {"body": "fine", "subject": "hi", "email_id": "a"}, {"body": "fine", "subject": "hi",
                                                                           "email_id": "b"})
    recs, _ = run(spark, m, t4(spark, ("a", 1, answer(confidence="low")), ("b", 1, "x"), ("b", 2, "y")))
    assert recs["a"].review_status == "needs_review" and recs["a"].urgency == "medium"
    assert recs["b"].review_status == "needs_review" and recs["b"].category == "unclassified"
    assert recs["b"].classification_failed


def test_missing_body_quarantined(spark):
    recs, bad = run(spark, msgs(spark, {"body": None}), t4(spark, ("msg-001", 1, answer())))
    assert not recs and bad == {"msg-001": "missing_body"}


def test_pii_redacted_before_phrase_check(spark):
    m = msgs(spark, {"body": "card 4111-1111-1111-1111 from 10.1.2.3 ok", "subject": "hello"})
    recs, _ = run(spark, m, t4(spark, ("msg-001", 1, answer())))
    r = recs["msg-001"]
    assert r.redacted_body == "card [CREDIT_DEBIT_NUMBER] from [IP_ADDRESS] ok"
    assert r.pii_entities_detected == 2 and not r.urgency_override_applied


def test_run_batch_sinks_and_rerun(spark):
    base = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    paths = {k: os.path.join(base, k) for k in ("store", "alerts", "metrics", "quarantine")}
    m = msgs(spark, {}, {"email_id": "p", "body": "Love your product, keep it up!", "subject": "Thanks"})
    r = t4(spark, ("msg-001", 1, answer(confidence="low")), ("p", 1, answer("praise", "low", "positive")))
    M.run_batch(spark, m, r, store_path=paths["store"], alerts_path=paths["alerts"],
                metrics_path=paths["metrics"], quarantine_path=paths["quarantine"], now=NOW())
    ev = {x.email_id: x.alert_type for x in spark.read.json(paths["alerts"]).collect()}
    assert ev == {"msg-001": "urgent", "p": "informational"}
    n1 = spark.read.parquet(paths["store"]).count()
    M.run_batch(spark, m, r, store_path=paths["store"], alerts_path=paths["alerts"],
                metrics_path=paths["metrics"], quarantine_path=paths["quarantine"], now=NOW())
    assert n1 == 2 and spark.read.parquet(paths["store"]).count() == 2


def test_alert_failure_degrades(spark):
    base = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    paths = {k: os.path.join(base, k) for k in ("store", "alerts", "metrics", "quarantine")}

    def broken(events):
        raise RuntimeError("topic unavailable")

    M.run_batch(spark, msgs(spark, {}), t4(spark, ("msg-001", 1, answer())), store_path=paths["store"],
                alerts_path=paths["alerts"], metrics_path=paths["metrics"], quarantine_path=paths["quarantine"],
                now=NOW(), alert_sink=broken)
    assert spark.read.parquet(paths["store"]).count() == 1
    metrics = {r.metric: r.value for r in spark.read.parquet(paths["metrics"]).collect()}
    assert metrics == {"SentimentCount": 1, "PiiEntitiesDetected": 0, "AlertPublishFailure": 1}


def test_metric_json_line(spark):
    from mailsift.operators import metrics

    df = M.triage(msgs(spark, {"email_id": "x", "body": "fine", "subject": "hi"}),
                  t4(spark, ("x", 1, "bad"), ("x", 2, "bad")), now=NOW()).records
    line = json.loads(metrics.metric_json(df).first().line)
    cw = line["_aws"]["CloudWatchMetrics"][0]
    assert [m["Name"] for m in cw["Metrics"]] == ["SentimentCount", "PiiEntitiesDetected", "ClassificationFailure"]
    assert cw["Dimensions"] == [["sentiment"]] and line["sentiment"] == "unknown"
    assert line["SentimentCount"] == 1 and line["ClassificationFailure"] == 1 and "AlertPublishFailure" not in line
    assert line["_aws"]["Timestamp"] == 1782036005000


def test_receive_counts_hot_key_and_dead_letters(spark):
    from mailsift.operators import quality

    rows = [("hot", f"hot#{i}", i) for i in range(3000)] + [("a", "a#1", 5), ("a", "a#2", 1), ("b", "b#1", 7)]
    d = spark.createDataFrame(rows, "email_id string, delivery_id string, n int").withColumn(
        "delivered_ts", F.timestamp_add("SECOND", F.col("n"), timefmt.ntz_literal("2026-06-21 00:00:00")))
    r = quality.receive_counts(d)
    got = {(x.email_id, x.receive_no) for x in r.where(F.col("receive_no").isNotNull()).collect()}
    assert got == {("hot", 1), ("hot", 2), ("a", 1), ("a", 2), ("b", 1)}
    assert r.where("dead_letter").count() == 2998
    first = {x.delivery_id for x in r.where(F.col("receive_no") == 1).collect()}
    assert first == {"hot#0", "a#2", "b#1"}
    dl = quality.dead_letters(r)
    assert [(x.email_id, x.receive_count) for x in dl.collect()] == [("hot", 3000)]
    assert quality.dead_letters_expired(dl, "2026-07-10T00:00:00+00:00").count() == 1
    assert quality.dead_letters_expired(dl, "2026-06-30T00:00:00+00:00").count() == 0


def test_dead_letters_count_every_delivery(spark):
    from mailsift.operators import quality

    rows = [("a", f"a#{h}", f"2026-06-01 0{h}:00:00") for h in range(4)] + [("b", "b#0", "2026-06-01 00:00:00")]
    d = spark.createDataFrame(rows, "email_id string, delivery_id string, t string").withColumn(
        "delivered_ts", F.to_timestamp_ntz("t"))
    for most in (1, 2, 3):
        ranked = quality.receive_counts(d, max_receives=most)
        assert sorted((r.delivery_id, r.receive_no) for r in ranked.where("not dead_letter").collect()) == [
            *[(f"a#{i}", i + 1) for i in range(most)], ("b#0", 1)]
        dead = quality.dead_letters(ranked).collect()
        assert [(r.email_id, r.receive_count, r.first_received_ts.hour, r.last_received_ts.hour) for r in dead] == [("a", 4, 0, 3)]


def test_the_earliest_copy_is_taken(spark):
    rows = [("a", "late", "2026-06-01 05:00:00"), ("a", "early", "2026-06-01 01:00:00"), ("a", "middle", "2026-06-01 03:00:00")]
    d = spark.createDataFrame(rows, "email_id string, body string, t string").withColumn("delivered_ts", F.to_timestamp_ntz("t"))
    assert [r.body for r in M.new_messages(d.repartition(3), None).collect()] == ["early"]


def test_a_cluster_without_shared_folder_is_an_error(spark, monkeypatch):
    import pytest

    from mailsift import session

    class Conf:
        def get(self, key, default=None):
            return {"spark.master": "yarn"}.get(key, default)

    class Context:
        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError):
        session.shared_dir(Session())

"""Phrase override, routing, alert shapes, gates."""

import json

from pyspark.sql import functions as F

from mailsift.operators import alerts, rules

PHRASES = [
    ("outage", "medium", "high", True),
    ("I was charged twice for my subscription.", "low", "high", True),
    ("cancel my account", "notreal", "high", True),
    ("We have a DATA BREACH situation.", "low", "high", True),
    ("Everything is working fine, thank you.", "low", "low", False),
    ("Everything looks good.", "high", "high", False),
    ("The server shutdown unexpectedly.", "low", "high", True),
    ("I can’t access my account", "low", "low", False),  # curly apostrophe does not match
    (None, "low", "low", False),
]


def test_keyword_override(spark):
    df = spark.createDataFrame([(t, u) for t, u, _, _ in PHRASES], "text string, urgency string")
    out = df.select(rules.keyword_override(F.col("text"), F.col("urgency")).alias("o")).select("o.*").collect()
    assert [(r.urgency, r.urgency_override_applied) for r in out] == [(o, a) for _, _, o, a in PHRASES]


def test_phrase_hits_groups(spark):
    df = spark.createDataFrame([("m1", "Site is DOWN and I was double charged"), ("m2", "all good")],
                               "email_id string, text string")
    got = rules.phrase_hits(df, F.col("text")).collect()
    assert len(got) == 1
    assert got[0].phrase_groups == ["billing_dispute", "outage_access"]
    assert got[0].phrases == ["double charged", "down"]


def test_review_status(spark):
    df = spark.createDataFrame([("high", False), ("medium", False), ("low", False), ("high", True), (None, False)],
                               "confidence string, failed boolean")
    got = [r[0] for r in df.select(rules.review_status(F.col("confidence"), F.col("failed"))).collect()]
    assert got == ["auto_processed", "needs_review", "needs_review", "needs_review", "needs_review"]


def _record(**kw):
    base = dict(email_id="msg-001", received_at="2026-06-21T10:00:00+00:00", category="billing", urgency="medium",
                confidence="high", sentiment="negative", from_address="jane@example.com", subject="Help",
                suggested_reply=None, urgency_override_applied=False, review_status="auto_processed")
    base.update(kw)
    return base


SCHEMA = ("email_id string, received_at string, category string, urgency string, confidence string, "
          "sentiment string, from_address string, subject string, suggested_reply string, "
          "urgency_override_applied boolean, review_status string")


def _events(spark, recs, **kw):
    cols = [c.split()[0] for c in SCHEMA.split(", ")]
    df = spark.createDataFrame([tuple(r[c] for c in cols) for r in recs], SCHEMA)
    return {r.email_id: (r.alert_type, json.loads(r.body)) for r in alerts.alert_events(df, **kw).collect()}


def test_alert_precedence_and_bodies(spark):
    ev = _events(spark, [
        _record(email_id="u", urgency="high", urgency_override_applied=True, review_status="needs_review",
                confidence="low"),
        _record(email_id="r", confidence="low", review_status="needs_review"),
        _record(email_id="f", category="unclassified", sentiment="unknown", confidence="low",
                review_status="needs_review"),
        _record(email_id="i", category="praise", sentiment="positive", urgency="low"),
    ])
    assert ev["u"][0] == "urgent" and ev["u"][1]["urgency_override_applied"] is True
    assert ev["r"][0] == "needs_review" and ev["r"][1]["review_reason"] == "low_confidence"
    assert ev["f"][1]["review_reason"] == "classification_failed"
    assert ev["i"][0] == "informational"
    common = ["email_id", "alert_type", "received_at", "category", "urgency", "confidence", "sentiment",
              "from_address", "subject", "suggested_reply"]
    assert list(ev["i"][1]) == common and ev["i"][1]["suggested_reply"] is None
    assert list(ev["u"][1]) == common + ["urgency_override_applied"]


def test_minimal_informational(spark):
    ev = _events(spark, [_record(email_id="i", urgency="low")], minimal_informational=True)
    assert set(ev["i"][1]) == {"email_id", "alert_type", "received_at", "category", "urgency", "sentiment",
                               "confidence"}


def test_fanout(spark):
    ev = spark.createDataFrame([("a", "urgent"), ("b", "needs_review"), ("c", "informational")],
                               "email_id string, alert_type string")
    got = sorted(tuple(r) for r in alerts.fanout(ev, alerts.subscriptions(spark))
                 .select("subscriber", "email_id").collect())
    assert got == [("audit-all", "a"), ("audit-all", "b"), ("audit-all", "c"),
                   ("review-queue", "b"), ("urgent-ops", "a")]


def test_poison_marker_and_quarantine(spark):
    df = spark.createDataFrame([
        ("m1", "a@x", "Hello", "body", "k1", "2026-06-21T10:00:00+00:00"),
        ("m2", "a@x", "POISON-PILL test", "body", "k2", "2026-06-21T10:00:00+00:00"),
        ("m3", "a@x", "Big", "x" * 200, "k3", "2026-06-21T10:00:00+00:00"),
    ], "email_id string, from_address string, subject string, body string, raw_s3_key string, received_at string")
    marked = df.withColumn("body", rules.null_if_marker(F.col("subject"), F.col("body")))
    good, bad = rules.quarantine_split(marked, max_body_bytes=100)
    assert [r.email_id for r in good.collect()] == ["m1"]
    assert sorted((r.email_id, r.reason) for r in bad.collect()) == [("m2", "missing_body"), ("m3", "body_too_large")]


def test_language_route(spark):
    df = spark.createDataFrame([("en",), ("fr",), (None,)], "lang string")
    assert [r[0] for r in df.select(rules.language_route(F.col("lang"))).collect()] == ["detect", "review", "review"]


def test_no_size_limit_and_bad_arrival_times(spark):
    row = ("m", "a@b", "s", "x" * 150_000, "k", "2026-06-01T10:00:00+00:00")
    cols = ", ".join(f"{c} string" for c in rules.REQUIRED_MESSAGE_FIELDS)
    rows = [row, ("n", *row[1:5], "yesterday"), ("o", *row[1:5], "2026-06-01T10:00:00")]
    df = spark.createDataFrame(rows, cols)
    got = {r.email_id: r.reason for r in df.select("email_id", rules.quarantine_reason().alias("reason")).collect()}
    assert got == {"m": None, "n": "bad_received_at", "o": None}
    _, large = rules.quarantine_split(df, max_body_bytes=100_000)
    assert {r.reason for r in large.collect()} == {"body_too_large", "bad_received_at"}


def test_catch_all_gets_types_that_no_list_names(spark):
    events = spark.createDataFrame([("a", "urgent", "{}"), ("b", "none", "{}"), ("c", None, "{}")], "email_id string, alert_type string, body string")
    got = sorted((r.subscriber, r.email_id) for r in alerts.fanout(events, alerts.subscriptions(spark)).collect())
    assert got == [("audit-all", "a"), ("audit-all", "b"), ("audit-all", "c"), ("urgent-ops", "a")]

"""Registered queries of the triage job (M2) and its parts."""

from __future__ import annotations


from pyspark.sql import functions as F

from .. import schemas as S
from ..functions import redact as R
from ..functions import timefmt
from ..operators import alerts, metrics, phrases, rules
from ..sources import views
from . import triage as M
from .oracle import detected_count, phrase_values
from .registry import flat, register

NOW = "2024-06-01 00:00:00"
STORE_COLS = ", ".join(
    "array_to_string(feature_tags, ',') AS feature_tags" if c == "feature_tags" else c
    for c in [f.name for f in S.TRIAGE_RECORD.fields]
)


def doc_number():
    """The number in ``doc-<number>``."""
    return F.substring_index("email_id", "-", -1).cast("bigint")


def triaged(spark, sf_dir):
    """Records of one triage run over the derived deliveries and answers."""
    res = M.triage(
        views.deliveries(spark, sf_dir),
        views.model_responses(spark, sf_dir),
        stored_ids=views.stored_ids(spark, sf_dir),
        now=timefmt.ntz_literal(NOW),
    )
    return res


def scanned(spark, sf_dir):
    """Messages that reach the detector: new, with a body."""
    fresh = M.new_messages(views.deliveries(spark, sf_dir), views.stored_ids(spark, sf_dir))
    good, _ = rules.quarantine_split(fresh)
    return good


@register("triage_pipeline", f"SELECT {STORE_COLS} FROM triaged", ("triaged",))
def q_triage_pipeline(spark, sf_dir):
    return flat(triaged(spark, sf_dir).records.select(*[f.name for f in S.TRIAGE_RECORD.fields]))


@register("pii_redact", "SELECT email_id, redacted_body, pii_entities_detected FROM redacted", ("redacted",))
def q_pii_redact(spark, sf_dir):
    return M.redacted(scanned(spark, sf_dir)).select("email_id", "redacted_body", "pii_entities_detected")


@register("pii_gate", f"""
SELECT s.email_id, CAST({detected_count()} AS INTEGER) AS detected, r.pii_entities_detected AS kept
FROM scanned s JOIN redacted r USING (email_id)""", ("redacted",))
def q_pii_gate(spark, sf_dir):
    d = scanned(spark, sf_dir).withColumn("_e", R.detect(F.col("body")))
    return d.select(
        "email_id",
        F.size("_e").cast("int").alias("detected"),
        F.size(R.gate(F.col("_e"))).cast("int").alias("kept"),
    )


@register("pii_by_type", """
SELECT type, CAST(sum(n) AS BIGINT) AS spans FROM spans_by_type GROUP BY type HAVING sum(n) > 0""",
          ("spans_by_type",))
def q_pii_by_type(spark, sf_dir):
    return metrics.pii_by_type(M.redacted(scanned(spark, sf_dir)))


@register("keyword_override", "SELECT email_id, urgency, urgency_override_applied FROM triaged", ("triaged",))
def q_keyword_override(spark, sf_dir):
    return triaged(spark, sf_dir).records.select("email_id", "urgency", "urgency_override_applied")


@register("phrase_hits", f"""
SELECT t.email_id,
       array_to_string(list_sort(list_distinct(list(p.phrase_group))), ',') AS phrase_groups,
       array_to_string(list_sort(list_distinct(list(p.phrase))), ',') AS phrases
FROM triaged t JOIN (VALUES {phrase_values()}) AS p(phrase_group, phrase)
  ON contains(lower(t.subject || ' ' || t.redacted_body), p.phrase)
GROUP BY t.email_id""", ("triaged",))
def q_phrase_hits(spark, sf_dir):
    rec = triaged(spark, sf_dir).records
    text = rules.keyword_text(F.col("subject"), F.col("redacted_body"))
    return flat(rules.phrase_hits(rec, text))


@register("phrase_table", """
, words AS (
  SELECT DISTINCT unnest(regexp_extract_all(lower(subject), '[a-z]{5,}')) AS phrase FROM messages WHERE doc_id % 10 = 3)
SELECT m.email_id, count(*) AS hits, min(p.phrase) AS first_hit, max(p.phrase) AS last_hit
FROM messages m JOIN words p ON contains(lower(m.body), p.phrase) GROUP BY m.email_id""".replace("\n, words", ",\nwords"), ("messages",))
def q_phrase_table(spark, sf_dir):
    """P9 with a table of phrases: all long words of every tenth subject, looked for in every body."""
    m = views.messages(spark, sf_dir)
    words = F.regexp_extract_all(F.lower("subject"), F.lit("[a-z]{5,}"), F.lit(0))
    table = m.where("doc_id % 10 = 3").select(F.explode(words).alias("phrase"))
    got = phrases.table_hits(m.where("body IS NOT NULL").select("email_id", "body"), "body", table)
    hits = got.select("email_id", F.size("phrases").cast("long").alias("hits"), F.array_min("phrases").alias("first_hit"), F.array_max("phrases").alias("last_hit"))
    return hits.where("hits > 0")


@register("review_routing", "SELECT email_id, confidence, classification_failed, review_status FROM triaged",
          ("triaged",))
def q_review_routing(spark, sf_dir):
    return triaged(spark, sf_dir).records.select("email_id", "confidence", "classification_failed", "review_status")


# The ten common fields of an alert, in order (fixed values).
COMMON_JSON = ", ".join(f"'{c}', {c}" for c in (
    "email_id", "alert_type", "received_at", "category", "urgency", "confidence", "sentiment", "from_address", "subject",
    "suggested_reply"))


@register("alert_type", "SELECT email_id, urgency, review_status, alert_type FROM alerted", ("alerted",))
def q_alert_type(spark, sf_dir):
    return alerts.with_alert(triaged(spark, sf_dir).records).select("email_id", "urgency", "review_status", "alert_type")


@register("alert_body", """
SELECT email_id, third AS alert_type,
  CASE third
    WHEN 'urgent' THEN json_object(@COMMON@, 'urgency_override_applied', urgency_override_applied)
    WHEN 'needs_review' THEN json_object(@COMMON@, 'review_reason',
         CASE WHEN category = 'unclassified' THEN 'classification_failed' ELSE 'low_confidence' END)
    ELSE json_object('email_id', email_id, 'alert_type', third, 'received_at', received_at, 'category', category,
                     'urgency', urgency, 'sentiment', sentiment, 'confidence', confidence) END::VARCHAR AS body
FROM (SELECT *, CASE alert_type WHEN 'informational' THEN 'none' ELSE alert_type END AS third FROM alerted)
""".replace("@COMMON@", COMMON_JSON.replace("'alert_type', alert_type", "'alert_type', third")), ("alerted",))
def q_alert_body(spark, sf_dir):
    """The short shape of the third alert, under another name."""
    return alerts.alert_events(triaged(spark, sf_dir).records, minimal_informational=True, informational="none")


ALERT_EVENTS_SQL = f"""
SELECT email_id, alert_type,
  CASE alert_type
    WHEN 'urgent' THEN json_object({COMMON_JSON}, 'urgency_override_applied', urgency_override_applied)
    WHEN 'needs_review' THEN json_object({COMMON_JSON}, 'review_reason',
         CASE WHEN category = 'unclassified' THEN 'classification_failed' ELSE 'low_confidence' END)
    ELSE json_object({COMMON_JSON}) END::VARCHAR AS body
FROM alerted"""


@register("alert_events", ALERT_EVENTS_SQL, ("alerted",))
def q_alert_events(spark, sf_dir):
    return alerts.alert_events(triaged(spark, sf_dir).records)


@register("alert_fanout", """
SELECT s.subscriber, a.email_id, a.alert_type
FROM (SELECT email_id, CASE WHEN doc_id % 17 = 0 THEN 'archived' ELSE alert_type END AS alert_type FROM alerted) a JOIN (VALUES ('urgent-ops', 'urgent'), ('review-queue', 'needs_review')) AS s(subscriber, alert_type)
  ON a.alert_type = s.alert_type
UNION ALL
SELECT 'audit-all' AS subscriber, email_id, CASE WHEN doc_id % 17 = 0 THEN 'archived' ELSE alert_type END AS alert_type
FROM alerted""", ("alerted",))
def q_alert_fanout(spark, sf_dir):
    """Some events have a type that no list names: only the catch-all subscriber gets them."""
    ev = alerts.alert_events(triaged(spark, sf_dir).records)
    ev = ev.withColumn("alert_type", F.when(doc_number() % 17 == 0, F.lit("archived")).otherwise(F.col("alert_type")))
    return alerts.fanout(ev, alerts.subscriptions(spark)).select("subscriber", "email_id", "alert_type")


@register("metric_lines", f"""
SELECT email_id, processed_ts AS ts, '{S.DEFAULT_NAMESPACE}' AS namespace, metric, 'Count' AS unit, sentiment, value
FROM (
  SELECT email_id, processed_ts, sentiment, 'SentimentCount' AS metric, CAST(1 AS BIGINT) AS value FROM triaged
  UNION ALL SELECT email_id, processed_ts, sentiment, 'PiiEntitiesDetected', CAST(pii_entities_detected AS BIGINT) FROM triaged
  UNION ALL SELECT email_id, processed_ts, sentiment, 'ClassificationFailure', CAST(1 AS BIGINT) FROM triaged
            WHERE classification_failed)""", ("triaged",))
def q_metric_lines(spark, sf_dir):
    return metrics.metric_rows(triaged(spark, sf_dir).records)


@register("metric_json", """
SELECT email_id,
       '{"_aws":{"Timestamp":' || CAST(epoch_ms(processed_ts) AS VARCHAR)
       || ',"CloudWatchMetrics":[{"Namespace":"triage","Dimensions":[["sentiment"]],"Metrics":['
       || '{"Name":"SentimentCount","Unit":"Count"},{"Name":"PiiEntitiesDetected","Unit":"Count"}'
       || CASE WHEN classification_failed THEN ',{"Name":"ClassificationFailure","Unit":"Count"}' ELSE '' END
       || ']}]},"sentiment":"' || sentiment || '","SentimentCount":1,"PiiEntitiesDetected":'
       || CAST(pii_entities_detected AS VARCHAR)
       || CASE WHEN classification_failed THEN ',"ClassificationFailure":1' ELSE '' END || '}' AS line
FROM triaged""", ("triaged",))
def q_metric_json(spark, sf_dir):
    return metrics.metric_json(triaged(spark, sf_dir).records)


@register("pii_metric", """
SELECT sentiment, CAST(sum(pii_entities_detected) AS BIGINT) AS value FROM triaged GROUP BY sentiment""",
          ("triaged",))
def q_pii_metric(spark, sf_dir):
    rows = metrics.metric_rows(triaged(spark, sf_dir).records)
    return metrics.metric_sum(rows, S.METRIC_PII)


@register("failure_counts", """
SELECT count(*) FILTER (WHERE classification_failed) AS ClassificationFailure,
       count(*) FILTER (WHERE doc_id % 7 = 2) AS AlertPublishFailure, count(*) AS records FROM triaged""", ("triaged",))
def q_failure_counts(spark, sf_dir):
    rec = triaged(spark, sf_dir).records
    return metrics.failure_counts(rec.withColumn("alert_publish_failed", doc_number() % 7 == 2))


@register("poison_marker", """
SELECT email_id, subject, body IS NOT NULL AS has_body FROM (
  SELECT email_id, CASE WHEN doc_id % 25 = 7 THEN '[POISON-PILL] ' || subject ELSE subject END AS subject,
         CASE WHEN doc_id % 25 = 7 THEN NULL ELSE body END AS body
  FROM messages)""", ("messages",))
def q_poison_marker(spark, sf_dir):
    m = views.messages(spark, sf_dir)
    marked = m.withColumn(
        "subject", F.when(F.col("doc_id") % 25 == 7, F.concat(F.lit("[POISON-PILL] "), F.col("subject")))
        .otherwise(F.col("subject")))
    out = marked.withColumn("body", rules.null_if_marker(F.col("subject"), F.col("body")))
    return out.select("email_id", "subject", F.col("body").isNotNull().alias("has_body"))


@register("language_gate", """
SELECT email_id, lang, CASE WHEN lang = 'en' THEN 'detect' ELSE 'review' END AS route FROM messages""",
          ("messages",))
def q_language_gate(spark, sf_dir):
    m = views.messages(spark, sf_dir)
    return m.select("email_id", "lang", rules.language_route(F.col("lang")).alias("route"))


@register("size_gate", """
SELECT email_id, CAST(strlen(body) AS INTEGER) AS body_bytes FROM messages WHERE strlen(body) > 20000""",
          ("messages",))
def q_size_gate(spark, sf_dir):
    m = views.messages(spark, sf_dir).where(F.col("body").isNotNull())
    _, large = rules.quarantine_split(m, max_body_bytes=20_000)
    return large.where(F.col("reason") == "body_too_large").select("email_id", F.octet_length("body").alias("body_bytes"))


@register("quarantine_split", """
SELECT email_id, 'missing_body' AS reason
FROM messages WHERE email_id NOT IN (SELECT email_id FROM stored_ids) AND body IS NULL""",
          ("messages", "stored_ids"))
def q_quarantine_split(spark, sf_dir):
    return triaged(spark, sf_dir).quarantined.select("email_id", "reason")


@register("sentiment_counts", """
SELECT TIMESTAMP '1970-01-01' + to_seconds(CAST(floor(epoch(received_ts) / 86400) * 86400 AS BIGINT)) AS period_start,
       sentiment, count(*) AS sentiment_count
FROM triage_history GROUP BY ALL""", ("triage_history",))
def q_sentiment_counts(spark, sf_dir):
    return metrics.sentiment_counts(views.triage_history(spark, sf_dir))


@register("idempotent_new", """
SELECT DISTINCT email_id FROM deliveries WHERE email_id NOT IN (SELECT email_id FROM stored_ids)""",
          ("deliveries", "stored_ids"))
def q_idempotent_new(spark, sf_dir):
    return M.new_messages(views.deliveries(spark, sf_dir), views.stored_ids(spark, sf_dir)).select("email_id")


# The model of the next query: it sees one text and answers from that text alone.
# The first answer is broken for texts of an even length, the second never.
def echo_model(text: str, attempt: int) -> str:
    import hashlib
    import json

    answer = {"category": "complaint", "urgency": "low", "sentiment": "negative", "confidence": "high",
              "suggested_reply": hashlib.md5(text.encode()).hexdigest(), "feature_tags": [str(attempt)]}
    return json.dumps(answer) + ("]" if attempt == 1 and len(text) % 2 == 0 else "")


@register("triage_with_model", """
SELECT email_id, md5(redacted_body) AS suggested_reply,
       CASE WHEN length(redacted_body) % 2 = 0 THEN '2' ELSE '1' END AS feature_tags, redacted_body
FROM redacted""", ("redacted",))
def q_triage_with_model(spark, sf_dir):
    """M2 with X1 inside: the answers prove that the model saw the redacted text."""
    res = M.triage(views.deliveries(spark, sf_dir), stored_ids=views.stored_ids(spark, sf_dir),
                   now=timefmt.ntz_literal(NOW), model=echo_model)
    return flat(res.records.select("email_id", "suggested_reply", "feature_tags", "redacted_body"))

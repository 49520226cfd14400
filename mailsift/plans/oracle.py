"""The derived views restated in plain SQL (DuckDB dialect).

They are the independent oracle for ``mailsift.sources.views``: same rules,
written against the raw supplied tables, without any library code.
"""

from __future__ import annotations

VIEWS: dict[str, str] = {}

VIEWS["messages"] = r"""
messages AS (
  SELECT 'doc-' || doc_id AS email_id,
         source || '@example.com' AS from_address,
         trim(regexp_replace(substr(text, 1, 60), '[\r\n]+', ' ', 'g')) AS subject,
         CASE WHEN doc_id % 50 = 13 THEN NULL
              WHEN doc_id % 7 = 0 THEN text || ' I was CHARGED TWICE.'
              ELSE text END AS body,
         'raw-emails/doc-' || doc_id AS raw_s3_key,
         strftime(TIMESTAMP '2024-01-01 00:00:00' + to_seconds(doc_id * 1800), '%Y-%m-%dT%H:%M:%S') || '+00:00' AS received_at,
         TIMESTAMP '2024-01-01 00:00:00' + to_seconds(doc_id * 1800) AS received_ts,
         lang, doc_id, text
  FROM documents)"""

VIEWS["deliveries"] = r"""
deliveries AS (
  SELECT m.*, c.copy_no,
         m.received_ts + to_minutes(c.copy_no - 1) AS delivered_ts,
         m.email_id || '#' || c.copy_no AS delivery_id
  FROM messages m
  JOIN (SELECT 1 AS copy_no UNION ALL SELECT 2 UNION ALL SELECT 3) c
    ON c.copy_no <= CASE WHEN m.doc_id % 20 = 0 THEN 3 WHEN m.doc_id % 10 = 0 THEN 2 ELSE 1 END)"""

VIEWS["stored_ids"] = r"""
stored_ids AS (SELECT email_id FROM messages WHERE doc_id % 9 = 4)"""

# Outcome of classification, recomputed from doc_id without parsing JSON.
VIEWS["resolved"] = r"""
resolved AS (
  SELECT d.doc_id, 'doc-' || d.doc_id AS email_id,
         d.doc_id % 20 = 0 AS classification_failed,
         CASE WHEN d.doc_id % 20 = 0 THEN NULL WHEN d.doc_id % 10 >= 5 THEN 1 ELSE 2 END AS resolved_attempt,
         CASE WHEN d.doc_id % 20 = 0 THEN 'unclassified'
              ELSE ['bug_report','feature_request','general_inquiry','billing','complaint','praise'][d.doc_id % 6 + 1] END AS category,
         CASE WHEN d.doc_id % 20 = 0 THEN 'medium' ELSE ['high','medium','low'][d.doc_id % 3 + 1] END AS model_urgency,
         CASE WHEN d.doc_id % 20 = 0 THEN 'unknown'
              WHEN l.toxic = 1 THEN 'negative' WHEN l.quality = 1 THEN 'positive' ELSE 'constructive' END AS sentiment,
         CASE WHEN d.doc_id % 20 = 0 THEN 'low'
              WHEN d.doc_id % 4 = 2 THEN 'medium' WHEN d.doc_id % 4 = 3 THEN 'low' ELSE 'high' END AS confidence,
         CASE WHEN d.doc_id % 20 = 0 OR d.doc_id % 11 = 0 THEN NULL ELSE 'Thank you, we are looking into it.' END AS suggested_reply,
         CASE WHEN d.doc_id % 20 <> 0 AND d.doc_id % 6 = 1 AND d.doc_id % 13 <> 0
              THEN ['tag' || (d.doc_id % 8), 'tag' || (d.doc_id % 5)] ELSE []::VARCHAR[] END AS feature_tags
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)"""

VIEWS["triage_history"] = r"""
triage_history AS (
  SELECT 'evt-' || event_id AS email_id,
         strftime(ts, '%Y-%m-%dT%H:%M:%S') || '+00:00' AS received_at,
         'user' || user_id || '@example.com' AS from_address,
         event_type || ' report ' || event_id AS subject,
         'raw-emails/evt-' || event_id AS raw_s3_key,
         CASE event_type WHEN 'error' THEN 'bug_report' WHEN 'signup' THEN 'feature_request'
              WHEN 'click' THEN 'general_inquiry' WHEN 'purchase' THEN 'billing'
              WHEN 'view' THEN CASE WHEN value < 50 THEN 'complaint' ELSE 'praise' END
              ELSE 'general_inquiry' END AS category,
         CASE WHEN event_id % 7 = 0 THEN 'high' ELSE ['high','medium','low'][event_id % 3 + 1] END AS urgency,
         event_id % 7 = 0 AS urgency_override_applied,
         ['positive','negative','constructive','negative'][event_id % 4 + 1] AS sentiment,
         ['high','high','high','medium','low'][event_id % 5 + 1] AS confidence,
         CASE WHEN event_id % 5 < 3 THEN 'auto_processed' ELSE 'needs_review' END AS review_status,
         CASE WHEN event_id % 6 = 0 THEN NULL ELSE 'Thanks for reaching out.' END AS suggested_reply,
         CASE WHEN event_type = 'signup'
              THEN ['tag' || (CAST(json_extract_string(props, '$.k') AS INTEGER) % 8)]
              ELSE []::VARCHAR[] END AS feature_tags,
         'Details: ' || props AS redacted_body,
         CAST(event_id % 3 AS INTEGER) AS pii_entities_detected,
         strftime(ts + to_seconds(event_id % 5), '%Y-%m-%dT%H:%M:%S') || '+00:00' AS processed_at,
         CAST(floor(epoch(ts)) AS BIGINT) + 7776000 AS ttl,
         ts AS received_ts,
         ts + to_seconds(event_id % 5) AS processed_ts
  FROM events)"""

VIEWS["tool_calls"] = r"""
tool_calls AS (
  SELECT * FROM (VALUES
    ('q1', 1, 1, 'c1', 'billing', NULL, 'high', NULL, NULL, NULL),
    ('q1', 1, 1, 'c2', 'bug_report', NULL, 'high', NULL, NULL, NULL),
    ('q2', 1, 1, 'c3', 'feature_request', NULL, NULL, NULL, '2024-01-08T00:00:00+00:00', '2024-01-14T23:59:59+00:00'),
    ('q3', 1, 1, 'c4', NULL, NULL, NULL, NULL, NULL, NULL),
    ('q3', 2, 1, 'c5', NULL, 'negative', NULL, NULL, NULL, NULL),
    ('q3', 2, 2, 'c6', NULL, 'negative', NULL, 'user8@example.com', NULL, NULL),
    ('q4', 1, 1, 'c7', NULL, NULL, NULL, 'nobody@example.com', NULL, NULL),
    ('q4', 1, 2, 'c8', 'complaint', NULL, NULL, NULL, NULL, '2024-01-02')
  ) AS t(question_id, attempt, turn, call_id, category, sentiment, urgency, from_address, date_from, date_to))"""

# Views depend on earlier ones; keep insertion order when composing.
DEPENDS = {
    "deliveries": ["messages"],
    "stored_ids": ["messages"],
}


def with_views(names: list[str], body: str) -> str:
    order: list[str] = []

    def add(n: str) -> None:
        for d in DEPENDS.get(n, []):
            add(d)
        if n not in order:
            order.append(n)

    for n in names:
        add(n)
    if not order:
        return body.strip()
    return "WITH " + ",\n".join(VIEWS[n].strip() for n in order) + "\n" + body.strip()


# ---------------------------------------------------------------------------
# Redaction and the triage record, written with DuckDB's own regex functions.
# ---------------------------------------------------------------------------

def _sql_str(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


# Fixed values of the rules, written out here so that a wrong constant in the
# library does not pass.
DETECTED = [
    ("EMAIL", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"),
    ("PHONE", r"\+[0-9]{1,2} \([0-9]{3}\) [0-9]{3}-[0-9]{4}"),
    ("SSN", r"[0-9]{3}-[0-9]{2}-[0-9]{4}"),
    ("CREDIT_DEBIT_NUMBER", r"[0-9]{4}[- ]?[0-9]{4}[- ]?[0-9]{4}[- ]?[0-9]{4}"),
    ("IP_ADDRESS", r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}"),
    ("PASSWORD", r"[0-9a-f]{40}"),
]
REPLACED = ["SSN", "CREDIT_DEBIT_NUMBER", "IP_ADDRESS", "PASSWORD"]
PHRASES = [
    ("outage_access", "down"),
    ("outage_access", "outage"),
    ("outage_access", "can't access"),
    ("outage_access", "locked out"),
    ("billing_dispute", "charged twice"),
    ("billing_dispute", "double charged"),
    ("billing_dispute", "unauthorized charge"),
    ("churn_risk", "cancel my account"),
    ("churn_risk", "legal action"),
    ("security", "data breach"),
]


def _redaction_sql():
    kept = [(t, p) for t, p in DETECTED if t in REPLACED]
    text = "body"
    for t, p in kept:
        text = f"regexp_replace({text}, {_sql_str(p)}, {_sql_str('[' + t + ']')}, 'g')"
    count = " + ".join(f"len(regexp_extract_all(body, {_sql_str(p)}))" for _, p in kept)
    by_type = "\n    UNION ALL ".join(
        f"SELECT email_id, {_sql_str(t)} AS type, len(regexp_extract_all(body, {_sql_str(p)})) AS n FROM scanned"
        for t, p in kept
    )
    return text, count, by_type


def detected_count() -> str:
    """Spans of every pattern, kept or not."""
    return " + ".join(f"len(regexp_extract_all(body, {_sql_str(p)}))" for _, p in DETECTED)


def phrase_values() -> str:
    return ", ".join(f"({_sql_str(g)}, {_sql_str(p)})" for g, p in PHRASES)


def _phrase_sql(expr: str) -> str:
    return "(" + " OR ".join(f"contains({expr}, {_sql_str(p)})" for _, p in PHRASES) + ")"


_RED_TEXT, _RED_COUNT, _RED_BY_TYPE = _redaction_sql()

VIEWS["scanned"] = f"""
scanned AS (
  SELECT * FROM messages
  WHERE email_id NOT IN (SELECT email_id FROM stored_ids)
    AND body IS NOT NULL)"""

VIEWS["redacted"] = f"""
redacted AS (
  SELECT email_id, {_RED_TEXT} AS redacted_body, CAST({_RED_COUNT} AS INTEGER) AS pii_entities_detected
  FROM scanned)"""

VIEWS["spans_by_type"] = f"""
spans_by_type AS (
    {_RED_BY_TYPE})"""

VIEWS["triaged"] = f"""
triaged AS (
  SELECT m.email_id, m.received_at, m.from_address, m.subject, m.raw_s3_key, r.category,
         CASE WHEN k.hit THEN 'high' ELSE r.model_urgency END AS urgency,
         k.hit AS urgency_override_applied,
         r.sentiment, r.confidence,
         CASE WHEN r.confidence <> 'high' OR r.classification_failed THEN 'needs_review' ELSE 'auto_processed' END AS review_status,
         r.suggested_reply, r.feature_tags, k.redacted_body, k.pii_entities_detected,
         '2024-06-01T00:00:00+00:00' AS processed_at,
         CAST(floor(epoch(m.received_ts)) AS BIGINT) + 7776000 AS ttl,
         r.classification_failed, m.received_ts, TIMESTAMP '2024-06-01 00:00:00' AS processed_ts,
         m.lang, m.doc_id
  FROM (SELECT x.*, {_phrase_sql("lower(mm.subject || ' ' || x.redacted_body)")} AS hit
        FROM redacted x JOIN messages mm USING (email_id)) k
  JOIN messages m USING (email_id)
  JOIN resolved r USING (email_id))"""

# The same with an empty store before the run.
VIEWS["triaged_all"] = "\n" + VIEWS["scanned"].strip().replace("scanned AS", "scanned_all AS").replace(
    "WHERE email_id NOT IN (SELECT email_id FROM stored_ids)\n    AND body", "WHERE body") + ",\n" + (
    VIEWS["redacted"].strip().replace("redacted AS", "redacted_all AS").replace("FROM scanned", "FROM scanned_all")) + ",\n" + (
    VIEWS["triaged"].strip().replace("triaged AS", "triaged_all AS").replace("FROM redacted x", "FROM redacted_all x"))

VIEWS["alerted"] = """
alerted AS (
  SELECT t.*,
         CASE WHEN urgency = 'high' THEN 'urgent' WHEN review_status = 'needs_review' THEN 'needs_review'
              ELSE 'informational' END AS alert_type
  FROM triaged t)"""

DEPENDS.update({
    "scanned": ["messages", "stored_ids"],
    "redacted": ["scanned"],
    "spans_by_type": ["scanned"],
    "triaged": ["redacted", "resolved"],
    "alerted": ["triaged"],
    "triaged_all": ["messages", "resolved"],
})

"""Table schemas, enumerations and the fixed values of the triage rules."""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values. These must stay equal to the behaviour being reproduced, so
# they are written out plainly and in their natural order.
# ---------------------------------------------------------------------------

# Classification enumerations.
CATEGORIES = ["bug_report", "feature_request", "general_inquiry", "billing", "complaint", "praise"]
URGENCIES = ["high", "medium", "low"]
SENTIMENTS = ["positive", "negative", "constructive"]
CONFIDENCES = ["high", "medium", "low"]
# Keys a model answer must carry (a null value is allowed); feature_tags is optional.
REQUIRED_FIELDS = ["category", "urgency", "sentiment", "confidence", "suggested_reply"]
# Record used when both attempts fail.
FALLBACK = {
    "category": "unclassified",
    "urgency": "medium",
    "sentiment": "unknown",
    "confidence": "low",
    "suggested_reply": None,
    "feature_tags": [],
}
MAX_ATTEMPTS = 2

# Escalation phrases (case-insensitive substring match), grouped by reason.
PHRASE_GROUPS = [
    ("outage_access", ["down", "outage", "can't access", "locked out"]),
    ("billing_dispute", ["charged twice", "double charged", "unauthorized charge"]),
    ("churn_risk", ["cancel my account", "legal action"]),
    ("security", ["data breach"]),
]
ESCALATION_PHRASES = [p for _, ps in PHRASE_GROUPS for p in ps]

# Span gate for sensitive-data redaction.
PII_SCORE_THRESHOLD = 0.5
PII_TYPES_TO_SKIP = ["NAME", "EMAIL", "PHONE"]

# Review routing, alerting.
AUTO_PROCESSED = "auto_processed"
NEEDS_REVIEW = "needs_review"
ALERT_URGENT = "urgent"
ALERT_REVIEW = "needs_review"
ALERT_INFO = "informational"
REASON_FAILED = "classification_failed"
REASON_LOW_CONF = "low_confidence"

# Fields of an alert body, in order (fixed values).
ALERT_COMMON_FIELDS = [
    "email_id", "alert_type", "received_at", "category", "urgency", "confidence",
    "sentiment", "from_address", "subject", "suggested_reply",
]
ALERT_MINIMAL_FIELDS = ["email_id", "alert_type", "received_at", "category", "urgency", "sentiment", "confidence"]

# Retention and delivery.
TTL_SECONDS = 90 * 24 * 60 * 60  # 7,776,000
RAW_RETENTION_DAYS = 90
DEAD_LETTER_RETENTION_DAYS = 14
MAX_RECEIVES = 2

# Metrics and alarms.
METRIC_UNIT = "Count"
METRIC_SENTIMENT = "SentimentCount"
METRIC_PII = "PiiEntitiesDetected"
METRIC_CLASSIFY_FAIL = "ClassificationFailure"
METRIC_ALERT_FAIL = "AlertPublishFailure"
METRIC_SYNTH_FAIL = "SynthesisFailure"
ANOMALY_PERIOD_S = 300
ANOMALY_BAND_WIDTH = 2.0
ANOMALY_EVAL_PERIODS = 3
DLQ_PERIOD_S = 60
DLQ_THRESHOLD = 0

# Insight answer loop.
MAX_TOOL_TURNS = 3
INSIGHT_FILTERS = ["category", "sentiment", "urgency", "from_address", "date_from", "date_to"]

# Defaults chosen here (parameters everywhere they are used).
DEFAULT_NAMESPACE = "triage"
DEFAULT_POISON_MARKER = "POISON-PILL"
RAW_PREFIX = "raw-emails/"

# ---------------------------------------------------------------------------
# Schemas
# ---------------------------------------------------------------------------

RAW_MESSAGE = T.StructType([
    T.StructField("path", T.StringType(), False),
    T.StructField("modificationTime", T.TimestampType(), True),
    T.StructField("length", T.LongType(), True),
    T.StructField("content", T.BinaryType(), True),
])

MESSAGE = T.StructType([
    T.StructField("email_id", T.StringType(), False),
    T.StructField("from_address", T.StringType(), True),
    T.StructField("subject", T.StringType(), True),
    T.StructField("body", T.StringType(), True),
    T.StructField("raw_s3_key", T.StringType(), True),
    T.StructField("received_at", T.StringType(), True),
])

ENTITY = T.StructType([
    T.StructField("score", T.DoubleType(), True),
    T.StructField("type", T.StringType(), True),
    T.StructField("begin", T.IntegerType(), True),
    T.StructField("end", T.IntegerType(), True),
])
ENTITIES = T.ArrayType(ENTITY)

MODEL_RESPONSE = T.StructType([
    T.StructField("email_id", T.StringType(), False),
    T.StructField("attempt", T.IntegerType(), False),
    T.StructField("raw_text", T.StringType(), True),
])

ENVELOPE_BLOCK = T.StructType([
    T.StructField("type", T.StringType(), True),
    T.StructField("text", T.StringType(), True),
    T.StructField("id", T.StringType(), True),
    T.StructField("name", T.StringType(), True),
    T.StructField("input", T.StringType(), True),
])
ENVELOPE = T.StructType([
    T.StructField("content", T.ArrayType(ENVELOPE_BLOCK), True),
    T.StructField("stop_reason", T.StringType(), True),
])

TRIAGE_RECORD = T.StructType([
    T.StructField("email_id", T.StringType(), False),
    T.StructField("received_at", T.StringType(), True),
    T.StructField("from_address", T.StringType(), True),
    T.StructField("subject", T.StringType(), True),
    T.StructField("raw_s3_key", T.StringType(), True),
    T.StructField("category", T.StringType(), True),
    T.StructField("urgency", T.StringType(), True),
    T.StructField("urgency_override_applied", T.BooleanType(), True),
    T.StructField("sentiment", T.StringType(), True),
    T.StructField("confidence", T.StringType(), True),
    T.StructField("review_status", T.StringType(), True),
    T.StructField("suggested_reply", T.StringType(), True),
    T.StructField("feature_tags", T.ArrayType(T.StringType()), True),
    T.StructField("redacted_body", T.StringType(), True),
    T.StructField("pii_entities_detected", T.IntegerType(), True),
    T.StructField("processed_at", T.StringType(), True),
    T.StructField("ttl", T.LongType(), True),
])

FILTER_REQUEST = T.StructType(
    [T.StructField(c, T.StringType(), True) for c in INSIGHT_FILTERS]
)

TOOL_CALL = T.StructType([
    T.StructField("question_id", T.StringType(), False),
    T.StructField("attempt", T.IntegerType(), False),
    T.StructField("turn", T.IntegerType(), False),
    T.StructField("call_id", T.StringType(), False),
    *FILTER_REQUEST.fields,
])

SUBSCRIPTION = T.StructType([
    T.StructField("subscriber", T.StringType(), False),
    T.StructField("alert_types", T.ArrayType(T.StringType()), True),
])

DEAD_LETTER = T.StructType([
    T.StructField("email_id", T.StringType(), True),
    T.StructField("reason", T.StringType(), True),
    T.StructField("receive_count", T.IntegerType(), True),
    T.StructField("first_received_ts", T.TimestampNTZType(), True),
    T.StructField("last_received_ts", T.TimestampNTZType(), True),
])

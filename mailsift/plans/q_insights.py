"""Registered insight queries (P1-P5, J4, A4-A11, U1, S7, S12) over ``triage_history``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import insights as I
from ..operators import sketches, store
from ..session import scratch_path
from ..sources import views
from . import sqlfunctions
from .registry import flat, register

TH = ("triage_history",)
PAGE = "email_id, from_address, subject, redacted_body, category, urgency, sentiment, " \
       "array_to_string(feature_tags, ',') AS feature_tags, received_at"


def _th(spark, sf_dir):
    return views.triage_history(spark, sf_dir)


@register("auto_processed", f"SELECT {PAGE} FROM triage_history WHERE review_status = 'auto_processed'", TH)
def q_auto_processed(spark, sf_dir):
    return flat(I.auto_processed(_th(spark, sf_dir)).select(*I.PAGE_FIELDS))


@register("auto_processed_min",
          "SELECT category, urgency, sentiment, array_to_string(feature_tags, ',') AS feature_tags, received_at "
          "FROM triage_history WHERE review_status = 'auto_processed'", TH)
def q_auto_processed_min(spark, sf_dir):
    return flat(I.auto_processed_min(_th(spark, sf_dir)))


@register("triage_query", f"""
SELECT {PAGE} FROM triage_history
WHERE review_status = 'auto_processed' AND category = 'billing' AND urgency = 'high'
  AND received_ts >= TIMESTAMP '2024-01-05 00:00:00' AND received_ts < TIMESTAMP '2024-01-21 00:00:00'""", TH)
def q_triage_query(spark, sf_dir):
    return flat(I.triage_query(_th(spark, sf_dir), category="billing", urgency="high",
                               date_from="2024-01-05", date_to="2024-01-20"))


_SQL_VIEWS = {"history": "sql_triage_history", "messages": "sql_messages"}


def _sql_session(spark, sf_dir):
    """The derived views and the library's functions, for queries in SQL text."""
    _th(spark, sf_dir).createOrReplaceTempView(_SQL_VIEWS["history"])
    views.messages(spark, sf_dir).createOrReplaceTempView(_SQL_VIEWS["messages"])
    sqlfunctions.register_functions(spark, _SQL_VIEWS["history"])


@register("sql_triage_filter", f"""
SELECT 'a' AS request, {PAGE} FROM triage_history
WHERE review_status = 'auto_processed' AND category = 'billing' AND urgency = 'high'
  AND received_ts >= TIMESTAMP '2024-01-05 00:00:00' AND received_ts < TIMESTAMP '2024-01-21 00:00:00'
UNION ALL SELECT 'b', {PAGE} FROM triage_history
WHERE review_status = 'auto_processed' AND sentiment = 'negative' AND received_ts <= TIMESTAMP '2024-01-03 12:00:00'
UNION ALL SELECT 'c', {PAGE} FROM triage_history
WHERE review_status = 'auto_processed' AND from_address = 'user8@example.com'""", TH)
def q_sql_triage_filter(spark, sf_dir):
    """X3 from SQL text, with named arguments."""
    _sql_session(spark, sf_dir)
    return flat(spark.sql("""
        SELECT 'a' AS request, * FROM triage_filter(category => 'billing', urgency => 'high', date_from => '2024-01-05', date_to => '2024-01-20')
        UNION ALL SELECT 'b', * FROM triage_filter(sentiment => 'negative', date_to => '2024-01-03T14:00:00+02:00')
        UNION ALL SELECT 'c', * FROM triage_filter(from_address => 'user8@example.com')"""))


@register("sql_redact", """
SELECT email_id, redacted_body, pii_entities_detected FROM redacted_all
UNION ALL SELECT email_id, NULL, 0 FROM messages WHERE body IS NULL""", ("triaged_all",))
def q_sql_redact(spark, sf_dir):
    """F1 from SQL text."""
    _sql_session(spark, sf_dir)
    return spark.sql(f"""
        SELECT email_id, r.redacted_text AS redacted_body, size(r.kept) AS pii_entities_detected
        FROM (SELECT email_id, pii_redact(body) AS r FROM {_SQL_VIEWS["messages"]})""")


@register("triage_date_range", f"""
SELECT {PAGE} FROM triage_history
WHERE review_status = 'auto_processed' AND sentiment = 'negative'
  AND received_at >= '2024-01-10T00:00:00+00:00' AND received_at <= '2024-01-12'""", TH)
def q_triage_date_range(spark, sf_dir):
    return flat(I.triage_query(_th(spark, sf_dir), mode="lexical", sentiment="negative",
                               date_from="2024-01-10T00:00:00+00:00", date_to="2024-01-12"))


@register("filtered_count", """
SELECT count(*) AS n FROM triage_history
WHERE review_status = 'auto_processed' AND urgency = 'high' AND category = 'billing'
  AND received_ts >= TIMESTAMP '2024-01-08 00:00:00' AND received_ts <= TIMESTAMP '2024-01-14 23:59:59'""", TH)
def q_filtered_count(spark, sf_dir):
    return I.filtered_count(_th(spark, sf_dir), urgency="high", category="billing",
                            date_from="2024-01-08T00:00:00+00:00", date_to="2024-01-14T23:59:59+00:00")


@register("triage_get", """
SELECT email_id, category, urgency, review_status, received_at FROM triage_history
WHERE email_id IN ('evt-0', 'evt-42', 'evt-9999', 'evt-missing')""", TH)
def q_triage_get(spark, sf_dir):
    ids = views.local_table(spark, [("evt-0",), ("evt-42",), ("evt-9999",), ("evt-missing",)], "email_id string")
    return store.get_many(_th(spark, sf_dir), ids).select(
        "email_id", "category", "urgency", "review_status", "received_at")


@register("top_feature_tags", """
SELECT tag, count(*) AS mentions FROM (
  SELECT unnest(feature_tags) AS tag FROM triage_history
  WHERE review_status = 'auto_processed' AND category = 'feature_request'
    AND received_ts >= TIMESTAMP '2024-01-08 00:00:00' AND received_ts < TIMESTAMP '2024-01-22 00:00:00')
GROUP BY tag ORDER BY mentions DESC, tag ASC LIMIT 3""", TH)
def q_top_feature_tags(spark, sf_dir):
    return I.top_feature_tags(_th(spark, sf_dir), 3, date_from="2024-01-08", date_to="2024-01-21")


@register("category_compare", """
SELECT category,
       count(*) FILTER (WHERE sentiment = 'positive') AS positive,
       count(*) FILTER (WHERE sentiment = 'negative') AS negative,
       count(*) FILTER (WHERE sentiment = 'constructive') AS constructive,
       count(*) FILTER (WHERE sentiment = 'unknown') AS unknown,
       count(*) AS total
FROM triage_history WHERE review_status = 'auto_processed' GROUP BY category""", TH)
def q_category_compare(spark, sf_dir):
    return I.category_compare(_th(spark, sf_dir))


@register("triage_cube", """
SELECT category, urgency, sentiment, count(*) AS n,
       CAST(grouping(category, urgency, sentiment) AS INTEGER) AS gid
FROM triage_history GROUP BY CUBE (category, urgency, sentiment)""", TH)
def q_triage_cube(spark, sf_dir):
    return I.triage_cube(_th(spark, sf_dir)).withColumn("gid", F.col("gid").cast("int"))


@register("triage_rollup", """
SELECT category, urgency, sentiment, count(*) AS n,
       CAST(grouping(category, urgency, sentiment) AS INTEGER) AS gid
FROM triage_history GROUP BY ROLLUP (category, urgency, sentiment)""", TH)
def q_triage_rollup(spark, sf_dir):
    return I.triage_rollup(_th(spark, sf_dir)).withColumn("gid", F.col("gid").cast("int"))


@register("confidence_spread", """
SELECT confidence, review_status, count(*) AS n,
       round(count(*) / (SELECT count(*) FROM triage_history), 6) AS share
FROM triage_history GROUP BY confidence, review_status""", TH)
def q_confidence_spread(spark, sf_dir):
    return I.confidence_spread(_th(spark, sf_dir))


@register("override_effect", """
SELECT urgency, urgency_override_applied, count(*) AS n
FROM triage_history GROUP BY urgency, urgency_override_applied""", TH)
def q_override_effect(spark, sf_dir):
    return I.override_effect(_th(spark, sf_dir))


@register("latency_stats", """
SELECT category, count(*) AS n,
       round(quantile_cont(lat, 0.5), 6) AS p50_s,
       round(quantile_cont(lat, 0.95), 6) AS p95_s,
       round(max(lat), 6) AS max_s
FROM (SELECT category, epoch(processed_ts) - epoch(received_ts) AS lat FROM triage_history)
GROUP BY category""", TH)
def q_latency_stats(spark, sf_dir):
    return I.latency_stats(_th(spark, sf_dir))


@register("latency_sketch", """
SELECT category, count(*) AS n, true AS p50_within, true AS p95_within
FROM triage_history WHERE CAST(received_ts AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-20'
GROUP BY category""", TH)
def q_latency_sketch(spark, sf_dir):
    """A11 over sixteen days from stored sketches: whether the answers' ranks among all records of
    those days are within the bound that the sketches promise."""
    number = F.substring_index("email_id", "-", -1).cast("long")
    late = _th(spark, sf_dir).withColumn("processed_ts", F.timestamp_add("MILLISECOND", (number * 7919) % 100_003, F.col("received_ts")))
    path = scratch_path(spark, "sketches")
    sketches.write_sketches(late, path)
    got = sketches.latency_between(spark, path, "2024-01-05", "2024-01-20")
    days = F.col("received_date").between(F.to_date(F.lit("2024-01-05")), F.to_date(F.lit("2024-01-20")))
    raw = sketches.latency_seconds(late).where(days)
    ranks = raw.join(got, "category").groupBy("category", "n").agg(*[
        F.struct((F.count_if(F.col("latency_s") < F.col(p)) / F.count(F.lit(1))).alias("below"),
                 (F.count_if(F.col("latency_s") <= F.col(p)) / F.count(F.lit(1))).alias("upto")).alias(p) for p in ("p50_s", "p95_s")])
    off = sketches.rank_error()
    within = [((F.col(f"{p}_s.below") <= q + off) & (F.col(f"{p}_s.upto") >= q - off)).alias(f"{p}_within") for p, q in (("p50", 0.5), ("p95", 0.95))]
    return ranks.select("category", "n", *within)


TC = ("triage_history", "tool_calls")
_MATCH = """
  t.review_status = 'auto_processed'
  AND (r.category IS NULL OR t.category = r.category)
  AND (r.sentiment IS NULL OR t.sentiment = r.sentiment)
  AND (r.urgency IS NULL OR t.urgency = r.urgency)
  AND (r.from_address IS NULL OR t.from_address = r.from_address)
  AND (r.date_from IS NULL OR t.received_ts >= CASE WHEN length(r.date_from) = 10
        THEN CAST(r.date_from AS TIMESTAMP) ELSE CAST(CAST(r.date_from AS TIMESTAMPTZ) AT TIME ZONE 'UTC' AS TIMESTAMP) END)
  AND (r.date_to IS NULL OR (CASE WHEN length(r.date_to) = 10
        THEN t.received_ts < CAST(r.date_to AS TIMESTAMP) + INTERVAL 1 DAY
        ELSE t.received_ts <= CAST(CAST(r.date_to AS TIMESTAMPTZ) AT TIME ZONE 'UTC' AS TIMESTAMP) END))"""

_EVAL = f"""
SELECT r.question_id, r.attempt, r.turn, r.call_id, r.category, r.sentiment, r.urgency,
       r.from_address, r.date_from, r.date_to, CAST(count(t.email_id) AS BIGINT) AS records
FROM tool_calls r LEFT JOIN triage_history t ON {_MATCH}
GROUP BY ALL"""


@register("tool_call_eval", _EVAL, TC)
def q_tool_call_eval(spark, sf_dir):
    return I.tool_call_eval(_th(spark, sf_dir), views.tool_calls(spark))


@register("tool_call_union", f"""
SELECT r.question_id, r.attempt, r.turn, r.call_id, t.email_id, t.from_address, t.subject, t.redacted_body,
       t.category, t.urgency, t.sentiment, array_to_string(t.feature_tags, ',') AS feature_tags, t.received_at
FROM tool_calls r JOIN triage_history t ON {_MATCH}""", TC)
def q_tool_call_union(spark, sf_dir):
    return flat(I.tool_call_union(_th(spark, sf_dir), views.tool_calls(spark)))


@register("records_considered", f"""
SELECT question_id, attempt, CAST(sum(records) AS BIGINT) AS records_considered, count(*) AS calls
FROM ({_EVAL}) GROUP BY question_id, attempt""", TC)
def q_records_considered(spark, sf_dir):
    return I.records_considered(_th(spark, sf_dir), views.tool_calls(spark))


NOW = "2024-04-15T00:00:00+00:00"


@register("retention_live", """
SELECT email_id, received_at, ttl FROM triage_history
WHERE ttl > CAST(epoch(TIMESTAMP '2024-04-15 00:00:00') AS BIGINT)""", TH)
def q_retention_live(spark, sf_dir):
    return store.retention_live(_th(spark, sf_dir), NOW).select("email_id", "received_at", "ttl")


@register("retention_expired", """
SELECT email_id, received_at, ttl FROM triage_history
WHERE ttl <= CAST(epoch(TIMESTAMP '2024-04-15 00:00:00') AS BIGINT)""", TH)
def q_retention_expired(spark, sf_dir):
    return store.retention_expired(_th(spark, sf_dir), NOW).select("email_id", "received_at", "ttl")


@register("request_errors", """
SELECT email_id AS call_id,
       CASE WHEN event_no % 5 = 0 THEN 'bad_category' WHEN sentiment = 'negative' AND event_no % 3 = 0 THEN 'bad_sentiment'
            WHEN event_no % 7 = 0 THEN 'bad_date_from' END AS request_error
FROM (SELECT *, CAST(split_part(email_id, '-', 2) AS BIGINT) AS event_no FROM triage_history)""", TH)
def q_request_errors(spark, sf_dir):
    """A filter request made from every stored record, some of them malformed."""
    n = F.substring_index("email_id", "-", -1).cast("bigint")
    t = _th(spark, sf_dir)
    requests = t.select(
        F.lit("q").alias("question_id"), F.lit(1).alias("attempt"), F.lit(1).alias("turn"), F.col("email_id").alias("call_id"),
        F.when(n % 5 == 0, "refund").otherwise(F.col("category")).alias("category"),
        F.when((F.col("sentiment") == "negative") & (n % 3 == 0), "angry").otherwise(F.col("sentiment")).alias("sentiment"),
        F.when(n % 2 == 0, F.col("urgency")).alias("urgency"), F.lit(None).cast("string").alias("from_address"),
        F.when(n % 7 == 0, "yesterday").otherwise(F.col("received_at")).alias("date_from"),
        F.substring("received_at", 1, 10).alias("date_to"))
    return I.request_errors(requests).select("call_id", "request_error")

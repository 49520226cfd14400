"""Registered queries of answer handling."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import jsonparse as J
from ..operators import classify as C
from ..operators import insights as I
from ..sources import views
from .oracle import _sql_str
from .registry import flat, register

DOCS = "(SELECT doc_id, 'doc-' || doc_id AS email_id FROM documents)"


@register("strict_json", f"""
SELECT email_id, attempt,
       CASE WHEN attempt = 1 THEN doc_id % 10 NOT IN (0, 3, 4) ELSE doc_id % 20 <> 0 END AS is_object
FROM {DOCS} d, (VALUES (1), (2)) AS a(attempt)""")
def q_strict_json(spark, sf_dir):
    r = views.model_responses(spark, sf_dir)
    return r.select("email_id", "attempt", J.strict_object(F.col("raw_text")).isNotNull().alias("is_object"))


@register("validate_response", f"""
SELECT email_id, attempt,
       CASE WHEN attempt = 1 THEN doc_id % 10 >= 5 ELSE doc_id % 20 <> 0 END AS valid
FROM {DOCS} d, (VALUES (1), (2)) AS a(attempt)""")
def q_validate_response(spark, sf_dir):
    return C.validated(views.model_responses(spark, sf_dir)).select("email_id", "attempt", "valid")


@register("classify_resolve", """
SELECT email_id, category, model_urgency AS urgency, sentiment, confidence, suggested_reply,
       array_to_string(feature_tags, ',') AS feature_tags, classification_failed, resolved_attempt
FROM resolved""", ("resolved",))
def q_classify_resolve(spark, sf_dir):
    ids = views.table(spark, sf_dir, "documents").select(F.concat(F.lit("doc-"), F.col("doc_id")).alias("email_id"))
    res = C.resolve(ids, views.model_responses(spark, sf_dir))
    return flat(res.select("email_id", *C.ANSWER_FIELDS, "classification_failed", "resolved_attempt"))


@register("response_envelope", """
SELECT 'doc-' || doc_id AS email_id,
       CASE WHEN doc_id % 3 = 0 THEN 'tool_use' ELSE 'end_turn' END AS stop_reason,
       CASE WHEN doc_id % 3 = 0 THEN 'Let me look.'
            WHEN doc_id % 4 = 0 THEN '{"answer":"Doc ' || doc_id || ' reviewed."}'
            WHEN doc_id % 4 = 1 THEN '{"answer": 5}'
            WHEN doc_id % 4 = 2 THEN 'no json here'
            ELSE '{"other": "x"}' END AS first_text,
       CAST(CASE WHEN doc_id % 6 = 0 THEN 3 WHEN doc_id % 3 = 0 THEN 2 ELSE 1 END AS INTEGER) AS blocks
FROM documents""")
def q_response_envelope(spark, sf_dir):
    e = views.envelopes(spark, sf_dir).withColumn("_e", J.parse_envelope(F.col("envelope")))
    return e.select("email_id", F.col("_e.stop_reason").alias("stop_reason"),
                    J.first_text(F.col("_e")).alias("first_text"),
                    F.size("_e.content").cast("int").alias("blocks"))


_CATS = "['bug_report','feature_request','general_inquiry','billing','complaint','praise']"


@register("envelope_blocks", f"""
SELECT 'doc-' || doc_id AS email_id, 'toolu_' || doc_id AS id, 'query_triage_data' AS name,
       '{{"category":"' || {_CATS}[doc_id % 6 + 1] || '"}}' AS input
FROM documents WHERE doc_id % 3 = 0
UNION ALL
SELECT 'doc-' || doc_id, 'toolu_' || doc_id || 'b', 'query_triage_data', '{{"urgency":"high"}}'
FROM documents WHERE doc_id % 6 = 0""")
def q_envelope_blocks(spark, sf_dir):
    e = views.envelopes(spark, sf_dir)
    blocks = e.select("email_id", F.explode(J.tool_blocks(J.parse_envelope(F.col("envelope")))).alias("b"))
    return blocks.select("email_id", F.col("b.id").alias("id"), F.col("b.name").alias("name"),
                         F.col("b.input").alias("input"))


@register("answer_validate", """
SELECT 'doc-' || doc_id AS email_id,
       CASE WHEN doc_id % 4 = 0 THEN 'Doc ' || doc_id || ' reviewed.' END AS answer
FROM documents WHERE doc_id % 3 <> 0""")
def q_answer_validate(spark, sf_dir):
    e = views.envelopes(spark, sf_dir).withColumn("_e", J.parse_envelope(F.col("envelope")))
    ended = e.where(F.col("_e.stop_reason") == "end_turn")
    return ended.select("email_id", J.answer_of(J.first_text(F.col("_e"))).alias("answer"))


_ANSWERS = ", ".join(
    f"({_sql_str(q)}, {a}, {t}, {_sql_str(txt)})" for q, a, t, txt in views.ANSWER_ROWS
)


def _insight_sql():
    from .q_insights import _EVAL

    return f"""
, evals AS ({_EVAL.strip()}),
answers AS (SELECT * FROM (VALUES {_ANSWERS}) AS a(question_id, attempt, turn, text)),
good AS (
  SELECT question_id, attempt, json_extract_string(text, '$.answer') AS answer FROM answers
  WHERE turn <= 3 AND json_valid(text) AND json_type(text) = 'OBJECT'
    AND json_type(text, '$.answer') = 'VARCHAR'),
counted AS (
  SELECT g.question_id, g.attempt, g.answer,
         coalesce((SELECT sum(records) FROM evals e
                   WHERE e.question_id = g.question_id AND e.attempt = g.attempt AND e.turn <= 3), 0) AS rc
  FROM good g),
best AS (SELECT question_id, arg_min(answer, attempt) AS answer, arg_min(rc, attempt) AS rc,
                min(attempt) AS answered_attempt FROM counted GROUP BY question_id),
questions AS (SELECT question_id FROM tool_calls UNION SELECT question_id FROM answers)
SELECT q.question_id, b.answer, CAST(coalesce(b.rc, 0) AS BIGINT) AS records_considered,
       b.question_id IS NULL AS synthesis_failed, b.answered_attempt
FROM questions q LEFT JOIN best b USING (question_id)"""


def _insight_oracle():
    from .oracle import with_views

    base = with_views(["triage_history", "tool_calls"], "SELECT 1")
    return base[: -len("SELECT 1")].rstrip() + _insight_sql()


@register("insight_batch")
def q_insight_batch(spark, sf_dir):
    return I.insight_batch(views.triage_history(spark, sf_dir), views.tool_calls(spark),
                           views.answer_envelopes(spark))


def _register_insight_oracle():
    from .registry import ORACLE

    ORACLE["insight_batch"] = _insight_oracle()


_register_insight_oracle()

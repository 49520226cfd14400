"""Triage inputs derived from the supplied tables.

The supplied tables hold no mail, so messages, deliveries, model answers,
stored triage records and filter requests are derived from them with plain
column expressions. Each derivation is deterministic in the row's own id
(the same rules are restated in SQL by ``mailsift.plans.oracle``), it
reads whole tables and its work grows with them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions import cached_expr, timefmt


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A supplied table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def local_table(spark: SparkSession, rows: list[tuple], schema) -> DataFrame:
    """A small literal table as a local relation (exact size known to the
    planner, no RDD job to scan it)."""
    import pandas as pd

    from pyspark.sql import types as T

    st = schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)
    return spark.createDataFrame(pd.DataFrame(rows, columns=st.fieldNames()), st)


def _pick(values: list[str], idx: Column) -> Column:
    """``values[idx]`` for a 0-based integer column."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (idx + 1).cast("int"))


# Message text appended to every seventh document so that the escalation rule
# has something to find (the supplied prose contains no escalation phrase).
INJECTED_PHRASE = " I was CHARGED TWICE."
BASE_TS = "2024-01-01 00:00:00"


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T2 messages, one per document; ``body`` is null for every 50th (poison)."""
    return messages_from(table(spark, sf_dir, "documents"))


def messages_from(d: DataFrame) -> DataFrame:
    """``messages`` over any (batch or streaming) frame with the documents columns."""
    return d.select(*_message_cols())


@cached_expr
def _message_cols() -> tuple:
    doc = F.col("doc_id")
    ts = F.expr(f"timestampadd(SECOND, doc_id * 1800, TIMESTAMP_NTZ'{BASE_TS}')")
    return (
        F.concat(F.lit("doc-"), doc).alias("email_id"),
        F.concat(F.col("source"), F.lit("@example.com")).alias("from_address"),
        F.trim(F.regexp_replace(F.substring("text", 1, 60), r"[\r\n]+", " ")).alias("subject"),
        F.when(doc % 50 == 13, F.lit(None).cast("string"))
        .when(doc % 7 == 0, F.concat(F.col("text"), F.lit(INJECTED_PHRASE)))
        .otherwise(F.col("text"))
        .alias("body"),
        F.concat(F.lit(S.RAW_PREFIX + "doc-"), doc).alias("raw_s3_key"),
        timefmt.iso_utc(ts).alias("received_at"),
        ts.alias("received_ts"),
        F.col("lang"),
        doc,
    )


def deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queue deliveries: every message once, every 10th twice, every 20th three times.

    Copies arrive one minute apart. One generator over one scan - no union.
    """
    return deliveries_from(messages(spark, sf_dir))


def deliveries_from(m: DataFrame) -> DataFrame:
    copies, delivered, delivery_id = _delivery_cols()
    return (
        m.withColumn("copy_no", F.explode(F.sequence(F.lit(1), copies)))
        .withColumns({"delivered_ts": delivered, "delivery_id": delivery_id})
    )


@cached_expr
def _delivery_cols() -> tuple:
    doc = F.col("doc_id")
    copies = F.when(doc % 20 == 0, 3).when(doc % 10 == 0, 2).otherwise(1)
    delivered = F.expr("timestampadd(MINUTE, copy_no - 1, received_ts)")
    delivery_id = F.concat_ws("#", "email_id", F.col("copy_no").cast("string"))
    return copies, delivered, delivery_id


def stored_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids already present in the triage store before a run (every 9th message)."""
    return messages(spark, sf_dir).where(F.col("doc_id") % 9 == 4).select("email_id")


def _valid_answer(doc: Column, sentiment: Column, *, urgency: Column | None = None,
                  with_confidence: bool = True, with_tags: bool = True) -> Column:
    category = _pick(S.CATEGORIES, doc % 6)
    fields = [
        category.alias("category"),
        (urgency if urgency is not None else _pick(S.URGENCIES, doc % 3)).alias("urgency"),
        sentiment.alias("sentiment"),
    ]
    if with_confidence:
        fields.append(
            F.when(doc % 4 == 2, "medium").when(doc % 4 == 3, "low").otherwise("high").alias("confidence")
        )
    fields.append(
        F.when(doc % 11 == 0, F.lit(None).cast("string"))
        .otherwise(F.lit("Thank you, we are looking into it."))
        .alias("suggested_reply")
    )
    if with_tags:
        fields.append(
            F.when(
                category == "feature_request",
                F.array(
                    F.concat(F.lit("tag"), (doc % 8).cast("string")),
                    F.concat(F.lit("tag"), (doc % 5).cast("string")),
                ),
            )
            .otherwise(F.array().cast("array<string>"))
            .alias("feature_tags")
        )
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})


def model_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T4 prepared model answers, two attempts per message.

    Attempt 1 by ``doc_id % 10``: 0 not JSON, 1 missing confidence, 2 urgency
    outside the enumeration, 3 object followed by text (plain, or beginning
    with ``]`` or ``],[``), 4 array; otherwise valid. Attempt 2 is valid unless ``doc_id % 20 = 0`` (fenced text).
    Sentiment comes from ``labels``: toxic -> negative, quality -> positive,
    else constructive. Every 13th answer has no ``feature_tags`` key.
    """
    d = table(spark, sf_dir, "documents").select("doc_id")
    lab = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    full_e, valid_e, rows_e = _answer_exprs()
    full = d.join(lab, "doc_id", "left").withColumn("_full", full_e)
    return full.withColumn("_valid", valid_e).select(*rows_e)


@cached_expr
def _answer_exprs() -> tuple:
    doc = F.col("doc_id")
    sentiment = (
        F.when(F.col("toxic") == 1, "negative")
        .when(F.col("quality") == 1, "positive")
        .otherwise("constructive")
    )
    full = _valid_answer(doc, sentiment)
    valid = F.when(doc % 13 == 0, F.regexp_replace("_full", r',"feature_tags":\[[^\]]*\]', "")).otherwise(
        F.col("_full"))
    v = F.col("_valid")
    r = doc % 10
    first = (
        F.when(r == 0, F.lit("not json"))
        .when(r == 1, F.regexp_replace(v, r'"confidence":"[a-z]+",', ""))
        .when(r == 2, F.regexp_replace(v, r'"urgency":"[a-z]+"', '"urgency":"critical"'))
        .when(r == 3, F.concat(v, F.when(doc % 30 == 13, F.lit("] sure, here is more"))
                               .when(doc % 30 == 23, F.lit('],[{"b":2}')).otherwise(F.lit(" trailing text"))))
        .when(r == 4, F.concat(F.lit("["), v, F.lit("]")))
        .otherwise(v)
    )
    second = F.when(doc % 20 == 0, F.concat(F.lit("```json\n"), v, F.lit("\n```"))).otherwise(v)
    rows = (
        F.concat(F.lit("doc-"), doc).alias("email_id"),
        F.inline(F.array(
            F.struct(F.lit(1).alias("attempt"), first.alias("raw_text")),
            F.struct(F.lit(2).alias("attempt"), second.alias("raw_text")),
        )),
    )
    return full, valid, rows


def triage_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T5 stored triage records derived from ``events`` (one per event)."""
    return triage_history_from(table(spark, sf_dir, "events"))


def triage_history_from(e: DataFrame) -> DataFrame:
    return e.select(*_history_cols())


@cached_expr
def _history_cols() -> tuple:
    eid = F.col("event_id")
    k = F.get_json_object("props", "$.k").cast("int")
    category = (
        F.when(F.col("event_type") == "error", "bug_report")
        .when(F.col("event_type") == "signup", "feature_request")
        .when(F.col("event_type") == "click", "general_inquiry")
        .when(F.col("event_type") == "purchase", "billing")
        .when(F.col("event_type") == "view", F.when(F.col("value") < 50, "complaint").otherwise("praise"))
        .otherwise("general_inquiry")
    )
    override = eid % 7 == 0
    confidence = _pick(["high", "high", "high", "medium", "low"], eid % 5)
    processed_ts = F.expr("timestampadd(SECOND, event_id % 5, ts)")
    return (
        F.concat(F.lit("evt-"), eid).alias("email_id"),
        timefmt.iso_utc(F.col("ts")).alias("received_at"),
        F.concat(F.lit("user"), F.col("user_id"), F.lit("@example.com")).alias("from_address"),
        F.concat(F.col("event_type"), F.lit(" report "), eid).alias("subject"),
        F.concat(F.lit(S.RAW_PREFIX + "evt-"), eid).alias("raw_s3_key"),
        category.alias("category"),
        F.when(override, "high").otherwise(_pick(S.URGENCIES, eid % 3)).alias("urgency"),
        override.alias("urgency_override_applied"),
        _pick(["positive", "negative", "constructive", "negative"], eid % 4).alias("sentiment"),
        confidence.alias("confidence"),
        F.when(confidence == "high", S.AUTO_PROCESSED).otherwise(S.NEEDS_REVIEW).alias("review_status"),
        F.when(eid % 6 == 0, F.lit(None).cast("string"))
        .otherwise(F.lit("Thanks for reaching out."))
        .alias("suggested_reply"),
        F.when(category == "feature_request", F.array(F.concat(F.lit("tag"), (k % 8).cast("string"))))
        .otherwise(F.array().cast("array<string>"))
        .alias("feature_tags"),
        F.concat(F.lit("Details: "), F.col("props")).alias("redacted_body"),
        (eid % 3).cast("int").alias("pii_entities_detected"),
        timefmt.iso_utc(processed_ts).alias("processed_at"),
        (timefmt.epoch_seconds(F.col("ts")) + S.TTL_SECONDS).alias("ttl"),
        F.col("ts").alias("received_ts"),
        processed_ts.alias("processed_ts"),
    )


# Filter requests issued by the answer loop (question, attempt, turn, call).
TOOL_CALL_ROWS = [
    ("q1", 1, 1, "c1", "billing", None, "high", None, None, None),
    ("q1", 1, 1, "c2", "bug_report", None, "high", None, None, None),
    ("q2", 1, 1, "c3", "feature_request", None, None, None, "2024-01-08T00:00:00+00:00", "2024-01-14T23:59:59+00:00"),
    ("q3", 1, 1, "c4", None, None, None, None, None, None),
    ("q3", 2, 1, "c5", None, "negative", None, None, None, None),
    ("q3", 2, 2, "c6", None, "negative", None, "user8@example.com", None, None),
    ("q4", 1, 1, "c7", None, None, None, "nobody@example.com", None, None),
    ("q4", 1, 2, "c8", "complaint", None, None, None, None, "2024-01-02"),
]


def tool_calls(spark: SparkSession) -> DataFrame:
    return local_table(spark, TOOL_CALL_ROWS, S.TOOL_CALL)


# Model envelopes that end each (question, attempt): text answers to check.
# Turns that issued tool calls are the rows of TOOL_CALL_ROWS.
ANSWER_ROWS = [
    ("q1", 1, 2, '{"answer": "Billing and bug reports with high urgency."}'),
    ("q2", 1, 2, "The most requested tags are listed."),
    ("q2", 2, 1, '{"answer": "Top tags computed."}'),
    ("q3", 1, 2, '{"answer": 42}'),
    ("q3", 2, 3, '{"answer": "Negative messages counted."}'),
    ("q4", 1, 3, '{"result": "none"}'),
    ("q4", 2, 1, "```json {}```"),
]


def answer_envelopes(spark: SparkSession) -> DataFrame:
    """Response envelopes (``content`` blocks + ``stop_reason``) as JSON text."""
    rows = [
        (q, a, t, '{"content": [{"type": "text", "text": ' + _json_str(txt) + '}], "stop_reason": "end_turn"}')
        for q, a, t, txt in ANSWER_ROWS
    ]
    return local_table(spark, rows, "question_id string, attempt int, turn int, envelope string")


def _json_str(s: str) -> str:
    import json

    return json.dumps(s)


def envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Response envelopes of the answer loop, one per document, as JSON text.

    ``doc_id % 3 = 0``: stop_reason ``tool_use`` with a text block and one
    tool call (two when ``doc_id % 6 = 0``); otherwise ``end_turn`` with one
    text block whose answer shape depends on ``doc_id % 4``: a string
    answer, a number, plain text, or an object without ``answer``.
    """
    d = table(spark, sf_dir, "documents").select("doc_id")
    doc = F.col("doc_id")
    block = lambda t, text=None, id_=None, name=None, inp=None: F.struct(
        F.lit(t).alias("type"),
        (text if text is not None else F.lit(None).cast("string")).alias("text"),
        (id_ if id_ is not None else F.lit(None).cast("string")).alias("id"),
        (name if name is not None else F.lit(None).cast("string")).alias("name"),
        (inp if inp is not None else F.lit(None).cast("string")).alias("input"),
    )
    category = _pick(S.CATEGORIES, doc % 6)
    call1 = block("tool_use", id_=F.concat(F.lit("toolu_"), doc), name=F.lit("query_triage_data"),
                  inp=F.to_json(F.struct(category.alias("category"))))
    call2 = block("tool_use", id_=F.concat(F.lit("toolu_"), doc, F.lit("b")), name=F.lit("query_triage_data"),
                  inp=F.lit('{"urgency":"high"}'))
    answer = (
        F.when(doc % 4 == 0, F.to_json(F.struct(F.concat(F.lit("Doc "), doc, F.lit(" reviewed.")).alias("answer"))))
        .when(doc % 4 == 1, F.lit('{"answer": 5}'))
        .when(doc % 4 == 2, F.lit("no json here"))
        .otherwise(F.lit('{"other": "x"}'))
    )
    content = (
        F.when(doc % 6 == 0, F.array(block("text", F.lit("Let me look.")), call1, call2))
        .when(doc % 3 == 0, F.array(block("text", F.lit("Let me look.")), call1))
        .otherwise(F.array(block("text", answer)))
    )
    stop = F.when(doc % 3 == 0, F.lit("tool_use")).otherwise(F.lit("end_turn"))
    return d.select(
        F.concat(F.lit("doc-"), doc).alias("email_id"),
        F.to_json(F.struct(content.alias("content"), stop.alias("stop_reason"))).alias("envelope"),
    )


def mail_corpus(spark: SparkSession, sf_dir: str, marker: str = S.DEFAULT_POISON_MARKER) -> DataFrame:
    """Raw MIME mail per document: ``key, content, received_ts, doc_id``.

    Subject = the message subject; every 50th document (from 13) carries the
    poison marker in its subject. Body = the document text.
    """
    from . import mail

    j = table(spark, sf_dir, "documents").select(*_message_cols(), "text", "source")
    poison = F.col("doc_id") % 50 == 13
    subject = F.when(poison, F.concat(F.lit(f"[{marker}] "), F.col("subject"))).otherwise(F.col("subject"))
    return j.select(
        F.col("raw_s3_key").alias("key"),
        mail.build_mail(F.concat(F.lit("Sender, "), F.col("source")),
                        F.concat(F.col("source"), F.lit("@example.com")),
                        subject, F.col("text")).alias("content"),
        "received_ts",
        "doc_id",
    )

"""Model answers: validation, attempt resolution, fallback."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions import cached_expr
from ..functions import jsonparse as J
from ..session import importable, scratch_path
from .store import read_store

ANSWER_FIELDS = ["category", "urgency", "sentiment", "confidence", "suggested_reply", "feature_tags"]


def validate_object(obj: Column) -> Column:
    """P6/P7 on a parsed object: ``struct<valid boolean, answer struct<...>>``.

    Valid when the object carries the five required keys (a null value
    counts) and the four enumerated fields hold allowed values. Every
    condition is null-safe, so evaluation order does not matter.
    """
    keys_ok = F.lit(True)
    for k in S.REQUIRED_FIELDS:
        keys_ok = keys_ok & J.has_key(obj, k)
    enums_ok = (
        J.get_str(obj, "category").isin(S.CATEGORIES)
        & J.get_str(obj, "urgency").isin(S.URGENCIES)
        & J.get_str(obj, "sentiment").isin(S.SENTIMENTS)
        & J.get_str(obj, "confidence").isin(S.CONFIDENCES)
    )
    valid = F.coalesce(obj.isNotNull() & keys_ok & enums_ok, F.lit(False))
    answer = F.struct(
        J.get_str(obj, "category").alias("category"),
        J.get_str(obj, "urgency").alias("urgency"),
        J.get_str(obj, "sentiment").alias("sentiment"),
        J.get_str(obj, "confidence").alias("confidence"),
        J.get_str(obj, "suggested_reply").alias("suggested_reply"),
        J.str_array_or_empty(obj, "feature_tags").alias("feature_tags"),
    )
    return F.struct(valid.alias("valid"), answer.alias("answer"))


def validate(raw: Column) -> Column:
    """P6/P7 on raw model text: strict parse, then ``validate_object``.

    The parsed value is bound once (a one-element ``transform`` acts as a
    let-binding), so the parse runs once per row however many checks read
    it and wherever the optimizer moves the expression.
    """
    return F.get(F.transform(F.array(J.strict_object(raw)), validate_object), 0)


@cached_expr
def _parsed_named(col: str) -> Column:
    return J.strict_object(F.col(col))


@cached_expr
def _validate_obj_named(col: str) -> Column:
    return validate_object(F.col(col))


def validated(responses: DataFrame) -> DataFrame:
    """T4 rows with ``valid`` and the parsed ``answer`` struct.

    Two projections instead of ``validate``'s lambda: the parsed object is
    a column of its own (referenced many times, so Catalyst keeps it
    computed once), and the checks run in whole-stage codegen with common
    sub-expressions shared, where a lambda body is evaluated interpreted.
    To filter on validity, filter with ``validate(...)["valid"]`` instead: a
    filter on ``valid`` is pushed below these projections and inlines them.
    """
    v = responses.withColumn("_obj", _parsed_named("raw_text")).select(
        "email_id", "attempt", "raw_text", _validate_obj_named("_obj").alias("_v"))
    return v.select(
        "email_id", "attempt", "raw_text", F.col("_v.valid").alias("valid"), F.col("_v.answer").alias("answer")
    )


@cached_expr
def fallback_answer() -> Column:
    """the record used when no attempt is valid."""
    fb = S.FALLBACK
    return F.struct(
        F.lit(fb["category"]).alias("category"),
        F.lit(fb["urgency"]).alias("urgency"),
        F.lit(fb["sentiment"]).alias("sentiment"),
        F.lit(fb["confidence"]).alias("confidence"),
        F.lit(None).cast("string").alias("suggested_reply"),
        F.array().cast("array<string>").alias("feature_tags"),
    )


def resolve(messages: DataFrame, responses: DataFrame) -> DataFrame:
    """First valid attempt per message, else the fallback.

    Valid answers are reduced per id with ``min_by(answer, attempt)``
    (partial aggregation), then left-joined to the messages; both sides are
    hash-partitioned on ``email_id``. Adds the six answer fields,
    ``classification_failed`` and ``resolved_attempt``.
    """
    # Only the answers of these messages are parsed, however many were ever stored.
    v = validated(responses.join(messages.select("email_id"), "email_id", "left_semi"))
    valid_attempt = F.when(F.col("valid"), F.col("attempt"))  # null ordering keys are skipped
    best = (
        v.groupBy("email_id")
        .agg(F.min_by("answer", valid_attempt).alias("_ans"), F.min(valid_attempt).alias("resolved_attempt"))
    )
    joined = messages.join(best, "email_id", "left")
    failed = F.col("_ans").isNull()
    ans = F.when(failed, fallback_answer()).otherwise(F.col("_ans"))
    return joined.withColumn("_a", ans).select(
        *[c for c in joined.columns if c not in ("_ans",)],
        *[F.col("_a")[f].alias(f) for f in ANSWER_FIELDS],
        failed.alias("classification_failed"),
    ).drop("_a")


# ---------------------------------------------------------------------------
# Calling a caller-supplied model
# ---------------------------------------------------------------------------

def _call_model(model: Callable[[str, int], str], attempt: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = pdf["text"].tolist()
            out = [model(t, attempt) if t is not None else None for t in texts]
            yield pd.DataFrame({"email_id": pdf["email_id"], "attempt": attempt, "raw_text": out})

    return run


def classify(spark: SparkSession, texts: DataFrame, model: Callable[[str, int], str],
             path: str | None = None) -> DataFrame:
    """Ask ``model(text, attempt)`` for every message, a second time only
    for messages whose first answer is invalid; returns stored T4 rows of ``texts``.

    ``texts`` has ``email_id, text``. Answers are kept under ``path`` (default: a
    fresh folder in the shared folder) and read back before validation, so plan
    re-use or a retried downstream task never calls the model again. A later
    call with the same ``path`` resumes: ids that already have an answer of
    that attempt are not asked again.
    """
    importable(spark)
    path = path or scratch_path(spark, "model_responses")
    schema = "email_id string, attempt int, raw_text string"
    ids = texts.select("email_id")

    def ask(rows: DataFrame, attempt: int) -> DataFrame:
        where = f"{path}/attempt={attempt}"
        known = read_store(spark, where)
        if known is not None:
            rows = rows.join(known.select("email_id"), "email_id", "left_anti")
        rows.mapInPandas(_call_model(model, attempt), schema).write.mode("append").parquet(where)
        return spark.read.schema(schema).parquet(where).join(ids, "email_id", "left_semi")

    first = ask(texts, 1)
    # Filter with ``validate``: a filter on ``validated``'s column is pushed
    # below its projections and re-evaluates the parse for every check.
    invalid = first.where(~validate(F.col("raw_text"))["valid"]).select("email_id")
    second = ask(texts.join(invalid, "email_id", "left_semi"), 2)
    return first.unionByName(second)

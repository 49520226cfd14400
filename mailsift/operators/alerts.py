"""Alert events: type, body, delivery to subscribers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas as S
COMMON_FIELDS, MINIMAL_FIELDS = S.ALERT_COMMON_FIELDS, S.ALERT_MINIMAL_FIELDS


def alert_type(urgency: Column, review_status: Column, *, informational: str = S.ALERT_INFO) -> Column:
    """Urgent > needs_review > informational."""
    return (
        F.when(urgency == F.lit("high"), F.lit(S.ALERT_URGENT))
        .when(review_status == F.lit(S.NEEDS_REVIEW), F.lit(S.ALERT_REVIEW))
        .otherwise(F.lit(informational))
    )


def review_reason(category: Column) -> Column:
    """Only the fallback record is ``unclassified``."""
    return F.when(category == F.lit("unclassified"), F.lit(S.REASON_FAILED)).otherwise(F.lit(S.REASON_LOW_CONF))


def with_alert(records: DataFrame, *, informational: str = S.ALERT_INFO) -> DataFrame:
    """Adds ``alert_type`` and the per-type extra fields (null when absent)."""
    at = alert_type(F.col("urgency"), F.col("review_status"), informational=informational)
    return records.withColumn("alert_type", at).withColumns({
        "review_reason": F.when(F.col("alert_type") == S.ALERT_REVIEW, review_reason(F.col("category"))),
        "override_flag": F.when(F.col("alert_type") == S.ALERT_URGENT, F.col("urgency_override_applied")),
    })


def alert_body(*, minimal_informational: bool = False, informational: str = S.ALERT_INFO) -> Column:
    """JSON body of an alert row (after ``with_alert``).

    Ten common fields, plus ``urgency_override_applied`` for urgent and
    ``review_reason`` for needs_review. Nulls are written (``suggested_reply:
    null`` is part of the shape). ``minimal_informational`` writes the short
    data-minimised shape for informational alerts.
    """
    opts = {"ignoreNullFields": "false"}
    common = [F.col(c) for c in COMMON_FIELDS]
    urgent = F.to_json(F.struct(*common, F.col("override_flag").alias("urgency_override_applied")), opts)
    review = F.to_json(F.struct(*common, F.col("review_reason").alias("review_reason")), opts)
    info_fields = MINIMAL_FIELDS if minimal_informational else COMMON_FIELDS
    info = F.to_json(F.struct(*[F.col(c) for c in info_fields]), opts)
    return (
        F.when(F.col("alert_type") == S.ALERT_URGENT, urgent)
        .when(F.col("alert_type") == S.ALERT_REVIEW, review)
        .otherwise(info)
    )


def alert_events(records: DataFrame, *, minimal_informational: bool = False,
                 informational: str = S.ALERT_INFO) -> DataFrame:
    """One event per processed record: ``email_id, alert_type, body``."""
    a = with_alert(records, informational=informational)
    return a.select("email_id", "alert_type", alert_body(minimal_informational=minimal_informational).alias("body"))


def write_events(events: DataFrame, path: str, mode: str = "append") -> None:
    """S8/R7 sink: JSON lines partitioned by ``alert_type``."""
    events.write.mode(mode).partitionBy("alert_type").json(path)


def subscriptions(spark: SparkSession, rows=None) -> DataFrame:
    """Subscriber -> accepted alert types (null list = every type)."""
    rows = rows if rows is not None else [
        ("urgent-ops", [S.ALERT_URGENT]),
        ("review-queue", [S.ALERT_REVIEW]),
        ("audit-all", None),
    ]
    from ..sources.views import local_table

    return local_table(spark, rows, S.SUBSCRIPTION)


EVERY_TYPE = "*"


def fanout(events: DataFrame, subs: DataFrame) -> DataFrame:
    """Deliver each event to every subscriber whose policy accepts it.

    Policies are exploded to ``(subscriber, alert_type)``; a null policy accepts
    every type, known or not, as a wildcard. An event looks for its own type and
    for the wildcard in one equi-join, whose strategy is left to the planner.
    Unmatched events are dropped silently.
    """
    wanted = F.coalesce("alert_types", F.array(F.lit(EVERY_TYPE)))
    policies = subs.select("subscriber", F.explode(wanted).alias("_key")).distinct()
    keys = F.array(F.coalesce("alert_type", F.lit("")), F.lit(EVERY_TYPE))
    return events.withColumn("_key", F.explode(keys)).join(policies, "_key").drop("_key")

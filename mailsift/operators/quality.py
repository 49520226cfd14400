"""Delivery quality: receive counting, dead letters, redrive, review queue,
reconciliation, tracing and stage counts (W5, R3, J5-J8, A12)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import schemas as S
from . import alerts


def receive_counts(deliveries: DataFrame, *, max_receives: int = S.MAX_RECEIVES,
                   order: tuple[str, ...] = ("delivered_ts", "delivery_id")) -> DataFrame:
    """The ordinal of each delivery of an id, up to ``max_receives``.

    ``receive_no`` is 1..max_receives for the first deliveries and null
    after; those later deliveries are dead letters. ``row_number`` is limited to the
    first ones, which Spark applies before the shuffle (window group limit), so an
    id sends at most ``max_receives`` narrow rows per map task however often it was
    delivered. They are joined back on id and order key, which spreads a hot id.
    ``order`` must tell the deliveries of an id apart.
    """
    key = F.struct(*[F.col(c) for c in order])
    place = F.row_number().over(Window.partitionBy("email_id").orderBy("_key"))
    firsts = deliveries.select("email_id", key.alias("_key")).withColumn("receive_no", place).where(
        F.col("receive_no") <= max_receives)
    firsts = firsts.withColumnRenamed("email_id", "_id").withColumnRenamed("_key", "_first")
    keyed = deliveries.withColumn("_key", key)
    ranked = keyed.join(firsts, (F.col("email_id") == F.col("_id")) & F.col("_key").eqNullSafe(F.col("_first")), "left")
    return ranked.drop("_key", "_id", "_first").withColumn("dead_letter", F.col("receive_no").isNull())


def dead_letters(ranked: DataFrame, quarantined: DataFrame | None = None) -> DataFrame:
    """T9 rows: ids with a delivery past the receive limit, plus quarantined messages.

    One row per id: reason, deliveries seen, first and last receive time, all
    counted over every delivery of the id.
    """
    over = ranked.groupBy("email_id").agg(
        F.lit("receive_limit").alias("reason"),
        F.count(F.lit(1)).cast("int").alias("receive_count"),
        F.min("delivered_ts").alias("first_received_ts"),
        F.max("delivered_ts").alias("last_received_ts"),
        F.bool_or("dead_letter").alias("_over"),
    ).where("_over").drop("_over")
    typed = [F.col(f.name).cast(f.dataType).alias(f.name) for f in S.DEAD_LETTER.fields]
    if quarantined is None:
        return over.select(*typed)
    q = quarantined.select(
        "email_id", "reason", F.lit(1).cast("int").alias("receive_count"),
        F.col("received_ts").alias("first_received_ts"), F.col("received_ts").alias("last_received_ts"),
    )
    return over.unionByName(q).select(*typed)


# Dead-letter reasons that a retry can fix.
TRANSIENT_REASONS = ["receive_limit"]


def redrive_plan(dlq: DataFrame, transient: list[str] | None = None) -> DataFrame:
    """Split dead letters into redrive (transient) and keep (poison)."""
    transient = TRANSIENT_REASONS if transient is None else transient
    action = F.when(F.col("reason").isin(list(transient)), F.lit("redrive")).otherwise(F.lit("keep"))
    return dlq.withColumn("action", action)


def redrive(queue: DataFrame, plan: DataFrame, messages: DataFrame) -> DataFrame:
    """Put transient dead letters back on the queue (union with the input)."""
    back = messages.join(plan.where(F.col("action") == "redrive").select("email_id"), "email_id", "left_semi")
    return queue.unionByName(back.select(*queue.columns))


def review_queue(records: DataFrame, reviewed_ids: DataFrame) -> DataFrame:
    """needs_review records not yet reviewed, oldest first."""
    pending = records.where(F.col("review_status") == S.NEEDS_REVIEW).join(
        reviewed_ids.select("email_id"), "email_id", "left_anti"
    )
    return pending.orderBy("received_ts", "email_id")


def reconcile(records: DataFrame, raw_keys: DataFrame) -> DataFrame:
    """Stored rows vs raw objects; both should exist and age out together."""
    r = records.select("raw_s3_key", F.col("email_id").alias("record_id"))
    o = raw_keys.select("raw_s3_key", F.lit(True).alias("_raw"))
    j = r.join(o, "raw_s3_key", "full_outer")
    status = (
        F.when(F.col("record_id").isNotNull() & F.col("_raw").isNotNull(), "both")
        .when(F.col("record_id").isNotNull(), "record_only")
        .otherwise("raw_only")
    )
    return j.select("raw_s3_key", "record_id", status.alias("status"))


def trace(deliveries: DataFrame, outcome: DataFrame) -> DataFrame:
    """One row per message id across delivery, quarantine, record and alert.

    ``outcome`` is the tagged result of one triage run (``triage_outcome``): a row
    per new message with ``reason`` or with its record's columns."""
    d = deliveries.groupBy("email_id").agg(F.count(F.lit(1)).alias("deliveries"))
    o = alerts.with_alert(outcome).select(
        "email_id", F.col("reason").alias("quarantine_reason"),
        F.when(F.col("reason").isNull(), F.col("review_status")).alias("review_status"),
        F.when(F.col("reason").isNull(), F.col("alert_type")).alias("alert_type"),
    )
    return d.join(o, "email_id", "left").select(
        "email_id", "deliveries", "quarantine_reason", "review_status", "alert_type",
        F.col("review_status").isNotNull().alias("stored"))


def pipeline_health(deliveries: DataFrame, outcome: DataFrame, *, max_receives: int = S.MAX_RECEIVES) -> DataFrame:
    """One row per stage with its count, from one pass over the deliveries and one
    over the outcome of the triage run (conditional counts, no repeated plans)."""
    per_id = deliveries.groupBy("email_id").agg(F.count(F.lit(1)).alias("n"))
    left = per_id.agg(
        F.sum("n").alias("deliveries"),
        F.sum(F.greatest(F.col("n") - max_receives, F.lit(0))).alias("dead_letters"),
    )
    o = alerts.with_alert(outcome)
    done = F.col("reason").isNull()
    right = o.agg(
        F.count(F.lit(1)).alias("new_messages"),
        F.count_if(~done).alias("quarantined"),
        F.count_if(done).alias("stored"),
        F.count_if(done & (F.col("review_status") == S.NEEDS_REVIEW)).alias("needs_review"),
        F.count_if(done & (F.col("alert_type") == S.ALERT_URGENT)).alias("urgent_alerts"),
    )

    def long(df: DataFrame) -> DataFrame:
        rows = F.array(*[F.struct(F.lit(c).alias("stage"), F.coalesce(F.col(c), F.lit(0)).cast("long").alias("n")) for c in df.columns])
        return df.select(F.inline(rows))

    return long(left).unionByName(long(right))


def dead_letters_expired(dlq: DataFrame, now: str, days: int = S.DEAD_LETTER_RETENTION_DAYS) -> DataFrame:
    """Dead letters older than the retention (first receive + ``days``) at ``now``."""
    from ..functions import timefmt

    limit = F.timestamp_add("DAY", F.lit(-days), timefmt.parse_iso(F.lit(now)))
    return dlq.where(F.col("first_received_ts") < limit)

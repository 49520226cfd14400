"""Registered queries of the store organised by id and of retention."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import schemas as S
from ..functions import timefmt
from ..operators import keyed, quality, store
from ..session import scratch_path
from ..sources import views
from .registry import register

#: Buckets of the small stores that these queries write.
BUCKETS = 2

NOW = "2024-04-15T00:00:00+00:00"
EXPIRED_SQL = "CAST(epoch(TIMESTAMP '2024-04-15 00:00:00') AS BIGINT)"


def _stored_history(spark, sf_dir) -> str:
    """The history in a store of its own, in two puts: every tenth record is put again, later, with
    a received time 20 days earlier or later, and the first put is repeated as after a failure."""
    path = scratch_path(spark, "keyed")
    first = views.triage_history(spark, sf_dir).withColumn("event_id", F.substring_index("email_id", "-", -1).cast("long"))
    days = F.when(F.col("event_id") % 20 == 3, -20).otherwise(20)
    moved = F.timestamp_add("DAY", days, F.col("received_ts"))
    second = first.where("event_id % 10 = 3").withColumns({
        "received_at": timefmt.iso_utc(moved), "received_ts": moved, "ttl": timefmt.epoch_seconds(moved) + S.TTL_SECONDS,
        "processed_ts": F.timestamp_add("DAY", F.lit(1), F.col("processed_ts"))})
    for batch in (first, second, first):
        keyed.put(batch.drop("event_id"), path, buckets=BUCKETS)
    return path


MOVED = """
moved AS (
  SELECT email_id, category, urgency, review_status,
         CAST(floor(epoch(moved_ts)) AS BIGINT) + 7776000 AS ttl, strftime(moved_ts, '%Y-%m-%dT%H:%M:%S') || '+00:00' AS received_at
  FROM (SELECT *, CASE WHEN event_id % 20 = 3 THEN received_ts - INTERVAL 20 DAY
                       WHEN event_id % 20 = 13 THEN received_ts + INTERVAL 20 DAY ELSE received_ts END AS moved_ts
        FROM (SELECT *, CAST(split_part(email_id, '-', 2) AS BIGINT) AS event_id FROM triage_history)))"""


@register("triage_lookup", f"""
, {MOVED.strip()}
SELECT email_id, category, urgency, review_status, received_at FROM moved
WHERE email_id IN ('evt-0', 'evt-3', 'evt-13', 'evt-42', 'evt-missing')""".replace("\n, moved", ",\nmoved"), ("triage_history",))
def q_triage_lookup(spark, sf_dir):
    """A few ids of a written store, read by bucket, Bloom filter and newest version."""
    path = _stored_history(spark, sf_dir)
    ids = ["evt-0", "evt-3", "evt-13", "evt-42", "evt-missing"]
    return keyed.lookup(spark, path, ids, buckets=BUCKETS).select("email_id", "category", "urgency", "review_status", "received_at")


@register("stored_ids_known", """
SELECT email_id FROM triage_history WHERE CAST(split_part(email_id, '-', 2) AS BIGINT) % 3 = 0""", ("triage_history",))
def q_stored_ids_known(spark, sf_dir):
    """J1 against a written store: of ids of which two thirds are unknown, those that it holds."""
    path = _stored_history(spark, sf_dir)
    number = F.substring_index("email_id", "-", -1).cast("long")
    asked = views.triage_history(spark, sf_dir).select(F.when(number % 3 == 0, F.col("email_id")).otherwise(F.concat(F.lit("new-"), "email_id")).alias("email_id"))
    return keyed.known(spark, path, asked, buckets=BUCKETS)


@register("retention_sweep", f"""
, {MOVED.strip()}
SELECT email_id, received_at, ttl FROM moved WHERE ttl > {EXPIRED_SQL}""".replace("\n, moved", ",\nmoved"), ("triage_history",))
def q_retention_sweep(spark, sf_dir):
    """What two sweeps leave of a store whose records changed their days."""
    path = _stored_history(spark, sf_dir)
    expired = F.col("ttl") <= store.now_epoch(NOW)
    schema = spark.read.parquet(path).schema  # all of it may expire
    keyed.sweep(spark, path, expired)
    keyed.sweep(spark, path, expired)
    left = spark.read.schema(schema).parquet(path)
    if left.where(expired).limit(1).count():
        raise RuntimeError("an expired version is still there")
    return keyed.current(left).select("email_id", "received_at", "ttl")


@register("raw_sweep", """
SELECT raw_s3_key, received_at FROM messages
WHERE CAST(floor(epoch(received_ts)) AS BIGINT) + 7776000 > CAST(epoch(TIMESTAMP '2024-04-05 07:00:00') AS BIGINT)""", ("messages",))
def q_raw_sweep(spark, sf_dir):
    """S12 for raw objects, kept in one folder a month: the border is in the middle of a day."""
    path = scratch_path(spark, "raw")
    raw = views.messages(spark, sf_dir).select("raw_s3_key", "received_at", "received_ts", store.month_of(F.to_date("received_ts")).alias("arrived"))
    store.gathered(raw, "arrived").write.partitionBy("arrived").parquet(path)
    age = timefmt.epoch_seconds(F.col("received_ts")) + S.RAW_RETENTION_DAYS * 86400
    for _ in range(2):
        keyed.sweep(spark, path, age <= store.now_epoch("2024-04-05 07:00:00"), parts=["arrived"], key=None)
    return spark.read.schema(raw.schema).parquet(path).select("raw_s3_key", "received_at")


@register("dead_letter_sweep", """
SELECT email_id, count(*)::INTEGER AS receive_count FROM deliveries GROUP BY email_id
HAVING count(*) > 2 AND min(delivered_ts) >= TIMESTAMP '2024-01-20 12:00:00' - INTERVAL 14 DAY""", ("deliveries",))
def q_dead_letter_sweep(spark, sf_dir):
    """Dead letters two weeks after their first receive."""
    path = scratch_path(spark, "dead")
    dead = quality.dead_letters(quality.receive_counts(views.deliveries(spark, sf_dir)))
    dead = dead.withColumn("month", store.month_of(F.to_date("first_received_ts")))
    store.gathered(dead, "month").write.partitionBy("month").parquet(path)
    limit = F.timestamp_add("DAY", F.lit(-S.DEAD_LETTER_RETENTION_DAYS), timefmt.ntz_literal("2024-01-20 12:00:00"))
    for _ in range(2):
        keyed.sweep(spark, path, F.col("first_received_ts") < limit, parts=["month"], key=None)
    return spark.read.schema(dead.schema).parquet(path).select("email_id", "receive_count")


@register("iso_times", """
SELECT email_id, CASE doc_id % 10
    WHEN 4 THEN NULL WHEN 5 THEN strftime(received_ts, '%Y-%m-%d') || 'T00:00:00+00:00'
    WHEN 6 THEN strftime(received_ts, '%Y-%m-%dT%H:%M') || ':00+00:00'
    ELSE strftime(received_ts, '%Y-%m-%dT%H:%M:%S') || '+00:00' END AS received
FROM messages""", ("messages",))
def q_iso_times(spark, sf_dir):
    """one instant in the forms that senders use, read back."""
    m = views.messages(spark, sf_dir)
    at, form = F.col("received_ts"), F.col("doc_id") % 10

    def local(hours: int, minutes: int, pattern: str):
        return F.date_format(F.timestamp_add("MINUTE", F.lit(60 * hours + minutes), at), pattern)

    said = (
        F.when(form == 0, F.date_format(at, "yyyy-MM-dd HH:mm:ss")).when(form == 1, F.concat(local(5, 30, "yyyyMMdd'T'HHmmss"), F.lit("+0530")))
        .when(form == 2, F.concat(local(-8, 0, "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit("-08"))).when(form == 3, F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss,SSSSSS'Z'"))
        .when(form == 4, F.date_format(at, "dd.MM.yyyy HH:mm")).when(form == 5, F.date_format(at, "yyyy-MM-dd"))
        .when(form == 6, F.date_format(at, "yyyy-MM-dd'T'HH:mm")).when(form == 7, F.concat(local(0, -45, "yyyy-MM-dd HH:mm:ss"), F.lit("-00:45")))
        .otherwise(F.col("received_at")))
    return m.select("email_id", timefmt.iso_utc(timefmt.parse_iso(said)).alias("received"))

"""The triage store: write, lookup, last write wins, retention."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions import cached_expr, timefmt
from ..session import delete_folder, scratch_path, staged

STORE_COLUMNS = [f.name for f in S.TRIAGE_RECORD.fields]


def with_write_fields(records: DataFrame, now: Column | None = None) -> DataFrame:
    """Adds ``processed_at`` (write time) and ``ttl`` (received + 90 days, epoch s).

    ``now`` is a UTC ``timestamp_ntz`` column; default is the query start
    time. Pass a literal to make re-runs repeatable.
    """
    if now is None:
        now = timefmt.to_ntz_utc(F.current_timestamp())
    return records.withColumn("processed_ts", now).withColumns(_write_exprs())


@cached_expr
def _write_exprs() -> dict:
    received = timefmt.parse_iso(F.col("received_at"))
    return {
        "processed_at": timefmt.iso_utc(F.col("processed_ts")),
        "ttl": timefmt.epoch_seconds(received) + F.lit(S.TTL_SECONDS),
    }


def last_write_wins(df: DataFrame, key: str = "email_id", order: str = "processed_ts", *, later: str | None = None) -> DataFrame:
    """Newest row per key via ``max_by`` (partial aggregation; hot keys are
    combined map-side, unlike a row_number window). Of rows with equal ``order`` the one
    with the greater ``later`` is taken, and then one that depends on the rows' values alone, so
    a rerun takes the same. A null ``order`` is older than any other."""
    cols = [c for c in df.columns if c not in (key, later)]
    newest = F.struct(F.col(order), *([F.col(later)] if later else []), F.xxhash64(*cols))
    picked = df.groupBy(key).agg(F.max_by(F.struct(*cols), newest).alias("_row"))
    return picked.select(key, *[F.col("_row")[c].alias(c) for c in cols])


def get(store: DataFrame, email_id: str) -> DataFrame:
    """One record or nothing (pushed-down equality filter + limit 1)."""
    return store.where(F.col("email_id") == F.lit(email_id)).limit(1)


def get_many(store: DataFrame, ids: DataFrame) -> DataFrame:
    """S7 for many ids: left semi join; the planner picks the strategy from measured sizes."""
    return store.join(ids.select("email_id"), "email_id", "left_semi")


def raw_expired(raw: DataFrame, now: str, days: int = S.RAW_RETENTION_DAYS, ts: str = "received_ts") -> DataFrame:
    """S12 for raw objects: those that arrived more than ``days`` before ``now``."""
    arrived = timefmt.epoch_seconds(F.col(ts))
    return raw.where(arrived + F.lit(days * 86400) <= now_epoch(now))


def now_epoch(now: str) -> Column:
    """Epoch seconds of an ISO text or ``YYYY-MM-DD HH:MM:SS`` UTC instant."""
    if "T" in now:
        return timefmt.epoch_seconds(timefmt.parse_iso(F.lit(now)))
    return timefmt.epoch_seconds(timefmt.ntz_literal(now))


def retention_live(store: DataFrame, now: str) -> DataFrame:
    """Rows whose ``ttl`` has not passed at ``now`` (a parameter, so re-runs agree)."""
    return store.where(F.col("ttl") > now_epoch(now))


def retention_expired(store: DataFrame, now: str) -> DataFrame:
    """Rows a TTL sweep removes at ``now``."""
    return store.where(F.col("ttl") <= now_epoch(now))


def with_received_date(records: DataFrame) -> DataFrame:
    return records.withColumn("received_date", F.to_date(timefmt.parse_iso(F.col("received_at"))))


NO_DAY = "__HIVE_DEFAULT_PARTITION__"

#: The folders of the stores: a month each. With a folder a day, years of mail make tens of thousands of
#: files of a few rows, whose opening and renaming takes longer than all the work on the rows.
MONTH = "received_month"


def month_of(day: Column) -> Column:
    """The first day of the month; null for a missing day."""
    return F.trunc(day, "month").alias(MONTH)


def gathered(rows: DataFrame, *parts: str) -> DataFrame:
    """Rows of one folder in one task, so that a folder gets one file instead of one from every task;
    where a folder holds a large share of the rows, Spark deals it over several tasks (adaptive execution)."""
    return rows.hint("rebalance", *[F.col(p) for p in parts])


def put(records: DataFrame, path: str, spark: SparkSession, key: str = "email_id",
        order: str = "processed_ts") -> None:
    """Put whole records by key, the last write (greatest ``order``, then the later put) wins.

    One row per key, whatever day it had before: the months of the batch and those in which
    its keys are stored now are read (a missing or unreadable day has a folder of its own), reduced
    to the newest row per key together with the batch, staged (the path being read is never
    overwritten) and written over exactly those months; months that no row is left in are removed
    last. A put that stopped halfway is repaired by putting the batch again. Only a
    missing table counts as an empty store.
    """
    newest = last_write_wins(with_received_date(records), key, order)
    with staged(spark, newest.withColumn(MONTH, month_of(F.col("received_date"))), "put-batch") as batch:
        stored = read_store(spark, path)
        if stored is None:
            _write_months(batch, path, key)
            return
        now = stored.select(F.col(key).alias("_key"), F.col(MONTH).alias("_month")).join(
            batch.select(key), F.col("_key").eqNullSafe(F.col(key)), "left_semi")
        touched = now.select("_month").union(batch.select(MONTH)).distinct()
        with staged(spark, touched, "put-months") as months:
            old = stored.join(months, F.col(MONTH).eqNullSafe(F.col("_month")), "left_semi").select(*batch.columns)
            both = old.withColumn("_put", F.lit(0)).unionByName(batch.withColumn("_put", F.lit(1)))
            merged = last_write_wins(both, key, order, later="_put").select(*batch.columns)
            with staged(spark, merged, "put-merged") as rows:
                _write_months(rows, path, key)
                kept = rows.select(F.col(MONTH).alias("_kept")).distinct()
                for r in months.join(kept, F.col("_month").eqNullSafe(F.col("_kept")), "left_anti").collect():  # months of one batch
                    delete_folder(spark, f"{path}/{MONTH}={NO_DAY if r['_month'] is None else r['_month']}")


def _write_months(rows: DataFrame, path: str, key: str) -> None:
    (gathered(rows, MONTH).sortWithinPartitions(MONTH, "received_date", key)
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(MONTH).parquet(path))


def stage(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: the lineage is cut by a written table."""
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def read_store(spark: SparkSession, path: str, **options: str) -> DataFrame | None:
    """The table at ``path``, or None where nothing has been written yet. Any other
    read error is raised: taking it for an empty store would append duplicates."""
    try:
        return spark.read.options(**options).parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def append_partitioned(records: DataFrame, path: str, key: str = "email_id", by: str = "received_date") -> None:
    """Append to the store: one folder per value of ``by``, ids sorted in files.

    The rows of a folder meet in one task, or in several if they are many: the number of files follows
    the folders and the bytes, not the product of folders and tasks.
    """
    (gathered(records, by).sortWithinPartitions(by, key)
     .write.mode("append").partitionBy(by).parquet(path))

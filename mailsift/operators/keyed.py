"""The triage store organised by id: versions appended, the newest read.

One folder per received day and bucket of ids, ids sorted inside the files, Parquet Bloom
filters on the id. A put appends the versions it is given and reads nothing, so
a late record costs its own bytes only and no put can lose what another wrote; putting a
batch again adds equal versions, of which one is read. A lookup by id reads one bucket
of each day and, there, the row groups whose Bloom filter may hold the id.

The number of buckets belongs to a store: pass the same to every call.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import delete_folder, folders, staged
from . import store

BUCKETS = 16

PARTS = ["received_date", "bucket"]


def bucket_of(key: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def _writer(rows: DataFrame, parts: list[str], key: str):
    ordered = rows.sortWithinPartitions(*parts, key)
    return ordered.write.partitionBy(*parts).option(f"parquet.bloom.filter.enabled#{key}", "true").option(
        f"parquet.bloom.filter.adaptive.enabled#{key}", "true")


def put(records: DataFrame, path: str, *, key: str = "email_id", order: str = "processed_ts", buckets: int = BUCKETS) -> None:
    """Append the newest version of every id in ``records``. Rows without a readable received
    time are kept in a folder of their own."""
    newest = store.last_write_wins(store.with_received_date(records), key, order)
    rows = newest.withColumn("bucket", bucket_of(F.col(key), buckets))
    _writer(store.gathered(rows, *PARTS), PARTS, key).mode("append").parquet(path)


def current(versions: DataFrame, key: str = "email_id", order: str = "processed_ts") -> DataFrame:
    """The newest version of every id."""
    return store.last_write_wins(versions, key, order)


def lookup(spark: SparkSession, path: str, ids: list[str], *, key: str = "email_id", order: str = "processed_ts", buckets: int = BUCKETS) -> DataFrame:
    """The current records of a few ids. The literals reach the scan: as a partition filter on
    their buckets and as a filter on the id, for which row groups are skipped. An empty or
    missing store is an error of the caller's: read it with ``store.read_store`` first."""
    wanted = [bucket_of(F.lit(i), buckets) for i in ids]
    rows = spark.read.parquet(path)
    if not ids:
        return rows.limit(0)
    return current(rows.where(F.col("bucket").isin(*wanted) & F.col(key).isin(*ids)), key, order)


def known(spark: SparkSession, path: str, ids: DataFrame, *, key: str = "email_id", buckets: int = BUCKETS) -> DataFrame | None:
    """Which of many ids the store holds: a join of ids alone, no text is read. The join is on the
    bucket too, so a batch that touches few buckets reads only those (dynamic pruning)."""
    stored = store.read_store(spark, path)
    if stored is None:
        return None
    wanted = ids.select(F.col(key), bucket_of(F.col(key), buckets).alias("bucket"))
    return stored.select(key, "bucket").join(wanted, ["bucket", key], "left_semi").select(key).distinct()


def sweep(spark: SparkSession, path: str, expired: Column, *, parts: list[str] | None = None, key: str | None = "email_id",
          order: str = "processed_ts") -> int:
    """Remove what has expired; returns the number of folders that changed.

    ``expired`` is a condition on a row's own narrow columns (null counts as false). Folders without
    a row that stays are dropped as a whole, only those on the border are rewritten. With ``key``
    the rows are versions: an id whose newest version has expired goes with all its versions,
    so that no older one comes back. A sweep that stopped halfway has removed nothing that stays; run it again.
    """
    parts = PARTS if parts is None else parts
    rows = store.read_store(spark, path)
    if rows is None:
        return 0
    gone = F.coalesce(expired, F.lit(False))
    flagged = rows.withColumn("_gone", gone)
    if key is not None:
        # on a tie the version that stays is the newer one
        state = flagged.groupBy(F.col(key).alias("_key")).agg(
            F.max_by("_gone", F.struct(F.col(order), ~F.col("_gone"))).alias("_dead"), F.bool_or(~F.col("_gone")).alias("_live"))
        ghosts = state.where("_dead AND _live").select("_key", F.lit(True).alias("_ghost"))
        flagged = flagged.join(ghosts, F.col(key).eqNullSafe(F.col("_key")), "left").withColumn(
            "_gone", F.col("_gone") | F.coalesce("_ghost", F.lit(False))).drop("_key", "_ghost")
    names = [F.col(p).alias(f"_{p}") for p in parts]
    with staged(spark, flagged.where("_gone").select(*names).distinct(), "sweep-folders") as changed:
        n = changed.count()
        if not n:
            return 0
        same = [F.col(p).eqNullSafe(F.col(f"_{p}")) for p in parts]
        kept = flagged.where(~F.col("_gone")).drop("_gone").join(changed, same, "left_semi").select(*rows.columns)
        with staged(spark, kept, "sweep-kept") as border:
            _writer(border, parts, key or parts[0]).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)
            left = border.select(*parts).distinct()
            for r in changed.join(left, same, "left_anti").collect():  # names of folders
                delete_folder(spark, "/".join([path, *(f"{p}={store.NO_DAY if v is None else v}" for p, v in zip(parts, r))]))
    for name in folders(spark, path) if len(parts) > 1 else []:
        if not folders(spark, f"{path}/{name}"):
            delete_folder(spark, f"{path}/{name}")
    return n

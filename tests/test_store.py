"""The store: puts that lose nothing, lookups by id, retention sweeps."""

import glob

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from mailsift.functions import timefmt
from mailsift.operators import keyed, store

ROW = "email_id string, v int, received_at string, processed_ts long"


def rows(spark, *values):
    return spark.createDataFrame(list(values), ROW)


def content(df):
    return sorted((r.email_id, r.v) for r in df.collect())


DAY1, DAY2 = "2024-01-01T10:00:00+00:00", "2024-01-02T10:00:00+00:00"
PUTS = [
    [("a", 1, None, 1), ("b", 1, DAY1, 1), ("c", 1, "not a date", 1)],
    [("z", 2, None, 2), ("b", 2, DAY2, 2)],
    [("a", 3, DAY1, 3), ("z", 0, DAY2, 1), ("c", 3, None, None)],
    [("b", 9, DAY1, 2)],  # as new as the stored one: the later put wins
]
AFTER = [[("a", 1), ("b", 1), ("c", 1)], [("a", 1), ("b", 2), ("c", 1), ("z", 2)], [("a", 3), ("b", 2), ("c", 1), ("z", 2)],
         [("a", 3), ("b", 9), ("c", 1), ("z", 2)]]


def test_put_replaces_whatever_day_the_old_row_has(spark, tmp_path):
    path = str(tmp_path / "s")
    for put, want in zip(PUTS, AFTER):
        for _ in range(2):  # a retried put changes nothing
            store.put(rows(spark, *put), path, spark)
            assert content(spark.read.parquet(path)) == want


def test_put_removes_its_staged_tables(spark, tmp_path):
    from mailsift.session import folders, shared_dir

    before = [f for f in folders(spark, f"{shared_dir(spark)}/mailsift") if f.startswith("put-")]
    store.put(rows(spark, *PUTS[0]), str(tmp_path / "s"), spark)
    store.put(rows(spark, *PUTS[1]), str(tmp_path / "s"), spark)
    assert [f for f in folders(spark, f"{shared_dir(spark)}/mailsift") if f.startswith("put-")] == before


def test_keyed_store_appends_and_reads_the_newest(spark, tmp_path):
    path = str(tmp_path / "k")
    for put, want in zip(PUTS[:3], AFTER):
        for _ in range(2):
            keyed.put(rows(spark, *put), path, buckets=2)
            assert content(keyed.current(spark.read.parquet(path))) == want
    assert content(keyed.lookup(spark, path, ["b", "nobody", "z"], buckets=2)) == [("b", 2), ("z", 2)]
    assert content(keyed.lookup(spark, path, [], buckets=2)) == []
    asked = spark.createDataFrame([("a",), ("q",), ("z",), ("a",)], "email_id string")
    assert sorted(r.email_id for r in keyed.known(spark, path, asked, buckets=2).collect()) == ["a", "z"]
    assert keyed.known(spark, str(tmp_path / "none"), asked) is None


def test_lookup_reads_one_bucket_and_skips_row_groups(spark, tmp_path):
    path = str(tmp_path / "k")
    keyed.put(rows(spark, *[(f"m{i}", i, DAY1, 1) for i in range(500)]), path, buckets=4)
    found = keyed.lookup(spark, path, ["m7"], buckets=4)
    assert content(found) == [("m7", 7)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    bucket = spark.range(1).select(keyed.bucket_of(F.lit("m7"), 4).alias("b")).first().b
    assert f"bucket#" in plan and f"= {bucket})" in plan.split("PartitionFilters")[1].split("PushedFilters")[0]
    assert "email_id" in plan.split("PushedFilters")[1].split("ReadSchema")[0]
    files = glob.glob(f"{path}/*/*/*.parquet")
    place = pq.ParquetFile(files[0]).schema_arrow.names.index("email_id")
    # a Bloom filter is written behind the row groups: the footer begins after more than the column's pages
    column = pq.ParquetFile(files[0]).metadata.row_group(0).column(place)
    assert column.statistics is not None and len(open(files[0], "rb").read()) > column.total_compressed_size


def test_sweep_drops_what_expired_and_nothing_else(spark, tmp_path):
    path = str(tmp_path / "k")

    def put(*values):
        keyed.put(rows(spark, *values).withColumn("ttl", F.unix_seconds(timefmt.ntz_to_instant(timefmt.parse_iso(F.col("received_at")))) + 100), path, buckets=2)

    late = "2024-01-01T20:00:00+00:00"
    put(*[(f"old{i}", i, "2023-12-30T00:00:00+00:00", 1) for i in range(20)], ("noon", 1, DAY1, 1), ("night", 1, late, 1), ("dayless", 1, None, 1))
    put(("old1", 99, DAY2, 2))  # comes back to life on a later day
    put(("night2", 1, DAY2, 1))
    put(("night2", 2, "2023-12-31T00:00:00+00:00", 2))  # the newest version is the expired one
    want = [("dayless", 1), ("night", 1), ("old1", 99)]
    now = store.now_epoch("2024-01-01 12:00:00")
    assert keyed.sweep(spark, path, F.col("ttl") <= now) > 0
    assert content(keyed.current(spark.read.parquet(path))) == want
    assert keyed.sweep(spark, path, F.col("ttl") <= now) == 0
    assert not glob.glob(f"{path}/received_date=2023-12-3*")
    assert keyed.sweep(spark, str(tmp_path / "none"), F.col("ttl") <= now) == 0


def test_a_sweep_that_stops_halfway_is_repeated(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "raw")
    raw = spark.createDataFrame([(i, f"2024-01-0{1 + i % 4} 0{i % 10}:00:00") for i in range(40)], "k int, t string")
    raw.withColumn("day", F.substring("t", 1, 10)).write.partitionBy("day").parquet(path)
    expired = F.col("t") < "2024-01-03 05:00:00"
    real = keyed.delete_folder

    def stops(spark_, folder):
        raise OSError("lost")

    monkeypatch.setattr(keyed, "delete_folder", stops)
    with pytest.raises(OSError):
        keyed.sweep(spark, path, expired, parts=["day"], key=None)
    monkeypatch.setattr(keyed, "delete_folder", real)
    keyed.sweep(spark, path, expired, parts=["day"], key=None)
    got = sorted(r.k for r in spark.read.parquet(path).collect())
    assert got == sorted(r.k for r in raw.where(~expired).collect())

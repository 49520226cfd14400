"""Work and files grow with the rows, not with days times tasks."""

import glob

import pyarrow as pa
from pyspark.sql import functions as F

from mailsift.functions import redact, timefmt
from mailsift.operators import keyed, phrases, store
from mailsift.plans import q_streaming
from mailsift.plans import triage as M
from mailsift.sources import mail
from mailsift.streaming import jobs


def dated(spark, days, copies=4):
    """``copies`` rows a day, dealt over eight tasks."""
    at = F.timestamp_add("HOUR", F.col("id") * F.lit(24 // copies), timefmt.ntz_literal("2024-01-01 00:00:00"))
    return spark.range(days * copies).repartition(8).select(
        F.concat(F.lit("m"), "id").alias("email_id"), at.alias("received_ts"), timefmt.iso_utc(at).alias("received_at"), F.col("id").alias("processed_ts"))


def files(path):
    return glob.glob(f"{path}/**/*.parquet", recursive=True)


def test_a_folder_of_the_store_gets_one_file(spark, tmp_path):
    rows = dated(spark, 20).withColumn("received_date", F.to_date("received_ts"))
    store.append_partitioned(rows, str(tmp_path / "s"))
    assert len(files(tmp_path / "s")) == 20
    assert spark.read.parquet(str(tmp_path / "s")).count() == 80


def test_years_of_mail_are_some_files(spark, tmp_path):
    rows = dated(spark, 400)
    for _ in range(2):
        store.put(rows, str(tmp_path / "p"), spark)
        assert len(files(tmp_path / "p")) == 14
    got = spark.read.parquet(str(tmp_path / "p"))
    assert got.count() == 1600 and got.where(F.col("received_date") != F.to_date("received_ts")).count() == 0


def test_dedup_stream_writes_months(spark, tmp_path):
    rows = dated(spark, 400)
    rows.write.parquet(str(tmp_path / "in"))
    out, ckpt = jobs.fresh_locations(spark, "t_months")
    got = jobs.dedup_stream(spark, jobs.parquet_files(spark, str(tmp_path / "in"), rows.schema), out=out, checkpoint=ckpt)
    assert got.count() == 1600 and len(files(out)) == 14


def test_one_file_of_mail_is_parsed_by_many_tasks(spark, tmp_path):
    mails = spark.range(64).select(F.concat(F.lit("raw-emails/m"), "id").alias("key"), F.lit(b"From: a@b.c\r\n\r\nx\r\n").alias("content"),
                                   timefmt.ntz_literal("2024-01-01 00:00:00").alias("received_ts"))
    root = str(tmp_path / "corpus")
    mail.write_corpus(mails.coalesce(1), root)
    out, ckpt = jobs.fresh_locations(spark, "t_dealt")
    got = jobs.ingest_stream(spark, jobs.corpus_stream(spark, root, jobs.in_turns(spark, root, 5)), out=out, checkpoint=ckpt)
    assert got.count() == 64 and len(files(out)) >= 4


def test_a_part_of_a_stream_is_written_and_read_by_many_tasks(spark, tmp_path):
    spark.range(700).withColumnRenamed("id", "doc_id").repartition(4).write.parquet(str(tmp_path / "documents.parquet"))
    q_streaming._files_out_of_order(spark, str(tmp_path), "documents", "doc_id")
    from mailsift.session import shared_dir

    root = max(glob.glob(f"{shared_dir(spark)}/mailsift/files-documents-*"), key=lambda p: len(files(p)))
    assert len(files(root)) == 5 * len(spark.read.parquet(str(tmp_path / "documents.parquet")).inputFiles())
    assert jobs.in_turns(spark, root, 5) == len(files(root)) / 5


def test_whole_texts_go_to_python_in_small_batches(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(key, "10000")
    messages = spark.range(3000).select(F.concat(F.lit("123-45-6789 m"), "id").alias("body"))
    got = M.redacted(messages)
    assert got.where("redacted_body LIKE '[SSN] m%' AND pii_entities_detected = 1").count() == 3000
    assert int(spark.conf.get(key)) <= 1000
    most = []
    assert redact.in_slices(lambda a: most.append(len(a)) or a)(pa.array(range(1050))).to_pylist() == list(range(1050)) and max(most) <= 100
    assert redact.in_slices(lambda a: a)(pa.array([], pa.string())).to_pylist() == []


def test_a_worker_holds_one_block_of_phrases(spark, monkeypatch):
    monkeypatch.setattr(phrases, "BLOCK_CHARS", 10)
    texts = spark.createDataFrame([(1, "Alpha beta GAMMA delta"), (2, "none"), (3, None), (4, "epsilon beta")], "id int, t string")
    table = spark.createDataFrame([(p,) for p in ("alpha", "beta", "gamma", "delta", "epsilon", "beta g", "", None)], "phrase string")
    assert len(list(phrases.phrase_blocks(table))) > 1
    got = phrases.table_hits(texts, "t", table)
    assert sorted((r.id, r.phrases) for r in got.collect()) == [
        (1, ["alpha", "beta", "beta g", "delta", "gamma"]), (2, []), (3, []), (4, ["beta", "epsilon"])]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and plan.split("ArrowEvalPython")[1].split("\n")[0].count("(lower(") <= 1


def test_a_large_folder_is_written_by_many_tasks(spark, tmp_path):
    """A day with all the rows: as many files as its bytes ask for, and each id found again."""
    key = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, "20k")
    try:
        rows = spark.range(200000).repartition(8).select(
            F.concat(F.lit("m"), "id").alias("email_id"), F.lit("2024-01-01T10:00:00+00:00").alias("received_at"), F.col("id").alias("processed_ts"))
        keyed.put(rows, str(tmp_path / "k"), buckets=1)
    finally:
        spark.conf.set(key, before)
    assert len(files(tmp_path / "k")) > 1
    assert [r.processed_ts for r in keyed.lookup(spark, str(tmp_path / "k"), ["m77"], buckets=1).collect()] == [77]
    assert keyed.current(spark.read.parquet(str(tmp_path / "k"))).count() == 200000

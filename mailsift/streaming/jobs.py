"""Structured Streaming jobs.

Every job writes through ``foreachBatch`` into a folder of the shared
checkpoint location, one sub-folder per micro-batch id written with
``overwrite``: a replayed batch (after a driver or executor loss) rewrites
its own folder, so the sink is exactly-once on top of the at-least-once
source. The stream's checkpoint lives next to it.
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .. import schemas as S
from ..functions import timefmt
from ..operators import store
from ..plans import triage as M
from ..session import scratch_path, staged


def parquet_stream(spark: SparkSession, sf_dir: str, name: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """A supplied table as a file stream (schema taken from the files, not inferred per batch)."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    r = spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet")
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.parquet(sf_dir)


def parquet_files(spark: SparkSession, root: str, schema, max_files_per_trigger: int | None = None) -> DataFrame:
    """A folder of Parquet files as a stream."""
    r = spark.readStream.schema(schema)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.parquet(root)


def in_turns(spark: SparkSession, root: str, turns: int) -> int:
    """Files a trigger, so that a stream over the Parquet files under ``root`` takes about ``turns``
    micro-batches, however many tasks wrote them: each has work for many tasks."""
    return max(1, -(-len(spark.read.parquet(root).inputFiles()) // turns))


def binary_stream(spark: SparkSession, root: str) -> DataFrame:
    """Raw objects arriving under ``root`` (one file per message); the key comes from the path."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    return spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").load(root)


def corpus_stream(spark: SparkSession, root: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """R1 over a packed corpus (``sources.mail.write_corpus``): new files as they arrive."""
    from ..sources import mail

    r = spark.readStream.schema(mail.CORPUS)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.parquet(root)


def _batch_dir(out: str, batch_id: int) -> str:
    return os.path.join(out, f"batch_id={batch_id}")


def run_available(stream: DataFrame, handle: Callable[[DataFrame, int], None], *, checkpoint: str,
                  output_mode: str = "append") -> StreamingQuery:
    """Process everything available now, then stop (restartable from ``checkpoint``)."""
    q = (
        stream.writeStream.outputMode(output_mode)
        .option("checkpointLocation", checkpoint)
        .foreachBatch(handle)
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))
    return q


def read_batches(spark: SparkSession, out: str, before: int | None = None) -> DataFrame | None:
    """What the micro-batches wrote under ``out`` (only those numbered below ``before``: a
    replayed batch must not see its own earlier output); None if nothing yet."""
    written = store.read_store(spark, out, basePath=out)
    if written is None:
        return None
    return written if before is None else written.where(F.col("batch_id") < before)


def prior_ids(spark: SparkSession, out: str, batch: DataFrame, batch_id: int,
              ts: str = "received_ts") -> DataFrame | None:
    """Ids written by earlier micro-batches in the months this batch covers, or without a day: a
    semi join on the month, by which the outputs are partitioned, prunes the history
    however late a message arrives."""
    written = read_batches(spark, out, batch_id)
    if written is None:
        return None
    day = F.to_date(ts)
    months = batch.where(day.isNotNull()).select(store.month_of(day)).distinct()
    on_days = written.join(months, store.MONTH, "left_semi").select("email_id")
    dayless = written.where(F.col(store.MONTH).isNull()).select("email_id")
    # a delivery without a time may belong to any day
    anywhere = written.select("email_id").join(batch.where(day.isNull()).select("email_id"), "email_id", "left_semi")
    return on_days.union(dayless).union(anywhere)


def dated(df: DataFrame, ts: str = "received_ts") -> DataFrame:
    """With the day and the month of receipt, by which outputs are partitioned."""
    return df.withColumns({"received_date": F.to_date(ts), store.MONTH: store.month_of(F.to_date(ts))})


def write_batch(df: DataFrame, out: str, batch_id: int, partition_by: list[str] | None = None) -> None:
    """The folder of a micro-batch; with ``partition_by`` the rows of a sub-folder are gathered first."""
    w = (store.gathered(df, *partition_by) if partition_by else df).write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(_batch_dir(out, batch_id))


# ---------------------------------------------------------------------------
# R2: at-least-once -> once
# ---------------------------------------------------------------------------

def dedup_stream(spark: SparkSession, deliveries: DataFrame, *, out: str, checkpoint: str,
                 stored_ids: DataFrame | None = None) -> DataFrame:
    """R2: each id once, however late a copy arrives.

    Inside ``foreachBatch`` the earliest delivery of each id of the batch is kept unless
    the id is stored already or was written by an earlier batch. There is no
    watermark, so no message is too late: the written tables, pruned by day, are
    the state, which grows with the store and not with the stream's memory.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        new = M.new_messages(batch, stored_ids)
        prior = prior_ids(spark, out, batch, batch_id)
        if prior is not None:
            new = new.join(prior, "email_id", "left_anti")
        write_batch(dated(new), out, batch_id, [store.MONTH])

    run_available(deliveries, handle, checkpoint=checkpoint)
    return spark.read.option("basePath", out).parquet(out)


# ---------------------------------------------------------------------------
# Tumbling metric windows
# ---------------------------------------------------------------------------

def windowed_counts(spark: SparkSession, records: DataFrame, *, out: str, checkpoint: str,
                    period: str = "1 day", ts: str = "received_ts",
                    by: tuple[str, ...] = ("sentiment",)) -> DataFrame:
    """Tumbling-window counts.

    Each micro-batch writes the counts of its own records by window; the result adds them
    up. Counts are sums, so records of any age reach their window and no state
    is kept between batches; a replayed batch rewrites its own counts.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        window = F.window(timefmt.ntz_to_instant(F.col(ts)), period)
        counts = batch.groupBy(window.alias("w"), *by).agg(F.count(F.lit(1)).alias("n"))
        write_batch(counts.select(timefmt.to_ntz_utc(F.col("w.start")).alias("window_start"), *by, "n"), out, batch_id)

    run_available(records, handle, checkpoint=checkpoint)
    written = spark.read.option("basePath", out).parquet(out)
    return written.groupBy("window_start", *by).agg(F.sum("n").alias("n"))


# ---------------------------------------------------------------------------
# R1 + M1: continuous ingest; R7 + M2: continuous triage
# ---------------------------------------------------------------------------

def ingest_stream(spark: SparkSession, raw: DataFrame, *, out: str, checkpoint: str,
                  marker: str = S.DEFAULT_POISON_MARKER) -> DataFrame:
    """New raw messages (``binary_stream``, or a stream of packed corpus files) -> parsed
    messages, one folder per micro-batch. The messages of a few large files are dealt over all
    cores: a file is read by few tasks, and parsing takes far longer than reading."""
    from ..sources import mail

    def handle(batch: DataFrame, batch_id: int) -> None:
        dealt = batch.repartition(2 * spark.sparkContext.defaultParallelism)
        write_batch(mail.mail_job(dealt, marker=marker), out, batch_id)

    run_available(raw, handle, checkpoint=checkpoint)
    return spark.read.option("basePath", out).parquet(out)


def failed_attempts(spark: SparkSession, failures: DataFrame, attempts: str, dead: str, batch_id: int,
                    max_receives: int = S.MAX_RECEIVES) -> None:
    """Remember every failed delivery; an id that has failed ``max_receives`` times by now
    becomes a dead letter, once.

    ``failures`` has ``email_id, reason, delivered_ts``. The attempts table is the memory
    between batches: counts of this batch are added to those of earlier batches.
    """
    seen = F.count(F.lit(1)).alias("n"), F.min("delivered_ts").alias("first"), F.max("delivered_ts").alias("last")
    now = failures.groupBy("email_id").agg(*seen, F.max("reason").alias("reason"))
    write_batch(now, attempts, batch_id)
    now = spark.read.parquet(_batch_dir(attempts, batch_id))
    earlier = read_batches(spark, attempts, batch_id)
    if earlier is None:
        total = now.withColumn("before", F.lit(0))
    else:
        past = earlier.join(now.select("email_id"), "email_id", "left_semi").groupBy("email_id").agg(
            F.sum("n").alias("p"), F.min("first").alias("pf"), F.max("last").alias("pl"))
        total = now.join(past, "email_id", "left").select(
            "email_id", "reason", (F.col("n") + F.coalesce("p", F.lit(0))).alias("n"), F.coalesce("p", F.lit(0)).alias("before"),
            F.least("first", "pf").alias("first"), F.greatest("last", "pl").alias("last"))
    out = total.where((F.col("n") >= max_receives) & (F.col("before") < max_receives)).select(
        "email_id", "reason", F.col("n").cast("int").alias("receive_count"),
        F.col("first").alias("first_received_ts"), F.col("last").alias("last_received_ts"))
    write_batch(out, dead, batch_id)


def triage_stream(spark: SparkSession, deliveries: DataFrame, responses: DataFrame, *, out: str,
                  checkpoint: str, now=None, alert_sink: Callable[[DataFrame], None] | None = None) -> dict[str, str]:
    """The triage job on a delivery stream.

    Per micro-batch the outcome (records and failures in one frame, ids of earlier
    batches skipped) is staged once; records, alert events partitioned by
    ``alert_type`` (R7), metric rows, quarantined messages, failed attempts and dead
    letters (R3) are written from it. An alert sink that fails becomes a metric and
    does not stop the stream (R4). Returns the output folders.
    """
    from ..operators import alerts, metrics

    paths = {k: os.path.join(out, k) for k in ("records", "alerts", "metrics", "quarantine", "attempts", "dead_letters")}

    def handle(batch: DataFrame, batch_id: int) -> None:
        stored = prior_ids(spark, paths["records"], batch, batch_id)
        res = M.triage(batch, responses, stored_ids=stored, now=now)
        with staged(spark, res.outcome, "micro-batch") as outcome:
            publish(outcome, batch, batch_id)

    def publish(outcome: DataFrame, batch: DataFrame, batch_id: int) -> None:
        res = M.split_outcome(outcome)
        records = dated(res.records)
        write_batch(records, paths["records"], batch_id, [store.MONTH])
        sink = alert_sink or (lambda ev: write_batch(ev, paths["alerts"], batch_id, ["alert_type"]))
        failed = M.publish(alerts.alert_events(records), sink)
        write_batch(metrics.metric_rows(records.withColumn("alert_publish_failed", F.lit(failed))), paths["metrics"], batch_id)
        write_batch(res.quarantined.select("email_id", "reason"), paths["quarantine"], batch_id)
        failures = batch.select("email_id", "delivered_ts").join(res.quarantined.select("email_id", "reason"), "email_id")
        failed_attempts(spark, failures, paths["attempts"], paths["dead_letters"], batch_id)

    run_available(deliveries, handle, checkpoint=checkpoint)
    return paths


def fresh_locations(spark: SparkSession, name: str) -> tuple[str, str]:
    """(output folder, checkpoint folder) for a new run under the shared folder."""
    base = scratch_path(spark, name)
    return os.path.join(base, "out"), os.path.join(base, "checkpoint")

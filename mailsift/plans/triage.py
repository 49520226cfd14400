"""M2: the triage job - deliveries in; records, alerts and metrics out.

One lazy plan: dedup + anti join against the store (before any costly
stage), quarantine split, redaction (Arrow functions), attempt resolution
against stored model answers (T4), phrase override, routing, write fields.
Exchanges happen only on ``email_id`` (dedup, anti join, answer join).
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from .. import schemas as S
from .. import session
from ..functions import redact as R
from ..operators import alerts, classify, metrics, rules, store

RECORD_EXTRAS = ["classification_failed", "received_ts", "processed_ts"]


@dataclass
class TriageResult:
    records: DataFrame      # T5 rows (+ classification_failed, received_ts, processed_ts)
    quarantined: DataFrame  # messages that cannot be processed, with ``reason``
    outcome: DataFrame      # both in one frame: ``reason`` is null for records


def new_messages(deliveries: DataFrame, stored_ids: DataFrame | None) -> DataFrame:
    """The earliest delivery of each id, minus ids already stored.

    Ids that are stored leave first, so their texts are not moved again; the
    earliest delivery is chosen with partial minima on the map side (an id
    delivered millions of times is combined before the shuffle). Which copy is taken
    depends on the data alone, so a rerun takes the same one.
    """
    if stored_ids is not None:
        deliveries = deliveries.join(stored_ids.select("email_id"), "email_id", "left_anti")
    if "delivered_ts" not in deliveries.columns:
        return deliveries.dropDuplicates(["email_id"])
    order = ["delivered_ts"] + (["delivery_id"] if "delivery_id" in deliveries.columns else [])
    rest = [c for c in deliveries.columns if c not in ("email_id", *order)]
    first = deliveries.groupBy("email_id").agg(
        F.min_by(F.struct(*order, *rest), F.struct(*order)).alias("_first"))
    return first.select("email_id", "_first.*").select(*deliveries.columns)


def redacted(messages: DataFrame, *, entities: Column | None = None, compat: bool = False,
             threshold: float = S.PII_SCORE_THRESHOLD, skip: list[str] | None = None) -> DataFrame:
    """F1 over messages: adds ``redacted_body``, ``pii_entities_detected`` and
    ``kept_entities`` (the spans that were replaced). ``entities`` defaults
    to the built-in pattern detector run on ``body``.

    Each stage is its own column (detected -> kept -> sorted -> text), so no
    expression is evaluated twice per row.
    """
    session.small_batches(messages.sparkSession)
    if entities is None:  # detection and copying in one Python stage
        df = messages.withColumn("_r", R.redactor(threshold=threshold, skip=skip, compat=compat)(F.col("body")))
        return df.withColumns({
            "kept_entities": F.col("_r.kept"), "redacted_body": F.col("_r.redacted_text"),
            "pii_entities_detected": F.size("_r.kept").cast("int"),
        }).drop("_r")
    df = messages.withColumn("_ents", entities)
    df = df.withColumn("kept_entities", R.gate(F.col("_ents"), threshold, skip)).drop("_ents")
    df = df.withColumn("_spans", R.sort_spans(F.col("kept_entities")))
    df = df.withColumns({
        "redacted_body": R.apply_spans(F.col("body"), F.col("_spans"), compat),
        "pii_entities_detected": F.size("_spans").cast("int"),
    })
    return df.drop("_spans")


def triage(deliveries: DataFrame, responses: DataFrame | None = None, *, stored_ids: DataFrame | None = None,
           now: Column | None = None, entities: Column | None = None, compat: bool = False,
           phrases: list[str] | None = None, max_body_bytes: int | None = None,
           model=None, answers_path: str | None = None) -> TriageResult:
    """Run M2 over a batch of deliveries.

    Answers come from ``responses`` (stored T4 rows), or from ``model(text, attempt)``,
    which then sees the *redacted* body and nothing else; its answers are kept under
    ``answers_path``, where a restarted job finds them. The outcome is one frame:
    a message that cannot be processed has a ``reason`` and no record.
    """
    fresh = new_messages(deliveries, stored_ids)
    tagged = fresh.withColumn("reason", rules.quarantine_reason(max_body_bytes))
    red = redacted(tagged, entities=entities, compat=compat)
    if model is not None:
        red = store.stage(red.sparkSession, red, "redacted")
        asked = red.where("reason IS NULL").select("email_id", F.col("redacted_body").alias("text"))
        responses = classify.classify(red.sparkSession, asked, model, answers_path)
    cls = classify.resolve(red, responses)
    # The lowered text is its own column so the phrase tests share it.
    low = cls.withColumn("_kw", F.lower(rules.keyword_text(F.col("subject"), F.col("redacted_body"))))
    hit = low.withColumn("_hit", rules.phrase_hit_named("_kw", tuple(phrases) if phrases else None, True))
    rec = hit.withColumns({
        "urgency": F.when(F.col("_hit"), F.lit("high")).otherwise(F.col("urgency")),
        "urgency_override_applied": F.col("_hit"),
        "review_status": rules.review_status_named(),
    }).drop("_kw", "_hit")
    rec = store.with_write_fields(rec, now)
    if "received_ts" not in rec.columns:
        from ..functions import timefmt

        rec = rec.withColumn("received_ts", timefmt.parse_iso(F.col("received_at")))
    return split_outcome(rec.select("reason", *store.STORE_COLUMNS, *RECORD_EXTRAS))


def split_outcome(outcome: DataFrame) -> TriageResult:
    done = F.col("reason").isNull()
    return TriageResult(
        records=outcome.where(done).drop("reason"),
        quarantined=outcome.where(~done).select("email_id", "reason", "received_at", "received_ts"),
        outcome=outcome,
    )


def stored_ids_for(spark, deliveries: DataFrame, store_path: str) -> DataFrame | None:
    """Ids already stored in the months this batch's messages were received.

    A message's received date never changes, so only those store partitions
    can hold its id: a semi join on the months prunes the partitioned store when it
    runs (dynamic partition pruning), without a pass over the batch before.
    """
    from ..functions import timefmt

    stored = store.read_store(spark, store_path)
    if stored is None:
        return None
    months = deliveries.select(store.month_of(F.to_date(timefmt.parse_iso(F.col("received_at"))))).distinct()
    return stored.join(months, store.MONTH, "left_semi").select("email_id")


def run_batch(spark, deliveries: DataFrame, responses: DataFrame | None = None, *, store_path: str, alerts_path: str,
              metrics_path: str, quarantine_path: str, now: Column | None = None,
              alert_sink=None, namespace: str = S.DEFAULT_NAMESPACE, run_id: str | None = None, health_path: str | None = None,
              **kw) -> dict[str, str]:
    """M2 with its sinks, in the original order: persist, alert, metrics.

    * The outcome - records and quarantined messages in one frame - is written beside the
      store once, under the run's id; everything else reads that, so the scan, the
      detector and the model answers never run twice. Records are then appended to
      the store partitioned by month of receipt. A failure here fails the job
      (RAISE): the batch is redelivered.
    * Alerts are written by ``alert_sink(events)`` (default: JSON by ``alert_type`` in a folder of the run).
      A failure is swallowed (DEGRADE): records stay,
      and every metric row of the batch carries ``AlertPublishFailure``.
    * Ids already in the store are skipped, so re-running a batch adds no rows; neither does a
      message that has been quarantined before.
    * A run that stopped after its outcome was written is finished by the next one, before that
      one's own batch: records that are not stored yet are appended, and alerts, metrics and quarantine
      are written to the run's own folders again. An ``alert_sink`` of the caller's gets the events of such a run again.
    * A12: with ``health_path`` the counts of the stages are kept, one row a stage. They are observed
      while the outcome is written: no pass of their own over deliveries or outcome.
    """
    paths = {"store": store_path, "alerts": alerts_path, "metrics": metrics_path, "quarantine": quarantine_path}
    for pending in session.folders(spark, _runs(store_path)):
        finish_run(spark, pending, paths, alert_sink=alert_sink, namespace=namespace)
    run = f"run-{run_id or uuid.uuid4().hex}"
    stored = stored_ids_for(spark, deliveries, store_path)
    arrived, went = Observation(), Observation()
    res = triage(deliveries.observe(arrived, F.count(F.lit(1)).alias("deliveries")), responses, stored_ids=stored, now=now, **kw)
    res = split_outcome(res.outcome.observe(went, *_stage_counts()))
    stage_run(res, store_path, run)
    finish_run(spark, run, paths, alert_sink=alert_sink, namespace=namespace, first=True)
    if health_path is not None:
        counts = [(k, int(v or 0)) for k, v in {**arrived.get, **went.get}.items()]
        spark.createDataFrame(counts, "stage string, n bigint").coalesce(1).write.mode("overwrite").parquet(f"{health_path}/run_id={run}")
    return paths


def _stage_counts() -> list[Column]:
    done = F.col("reason").isNull()
    urgent = alerts.alert_type(F.col("urgency"), F.col("review_status")) == S.ALERT_URGENT
    counts = {"new_messages": F.lit(True), "quarantined": ~done, "stored": done,
              "needs_review": done & (F.col("review_status") == S.NEEDS_REVIEW), "urgent_alerts": done & urgent}
    return [F.count_if(F.coalesce(c, F.lit(False))).alias(k) for k, c in counts.items()]


def _runs(store_path: str) -> str:
    return f"{store_path}.runs"


def stage_run(res: TriageResult, store_path: str, run: str) -> None:
    """Write the outcome of a run; from here on it will be finished, by this job or by the next."""
    day = F.to_date("received_ts")
    dated = res.outcome.withColumns({"received_date": day, store.MONTH: store.month_of(day)})
    dated.write.mode("overwrite").parquet(f"{_runs(store_path)}/{run}")


def append_run(spark, records: DataFrame, store_path: str, *, first: bool) -> None:
    if not first:  # some of them may be stored
        stored = store.read_store(spark, store_path)
        if stored is not None:
            months = records.select(store.MONTH).distinct()
            records = records.join(stored.join(months, store.MONTH, "left_semi").select("email_id"), "email_id", "left_anti").select(*records.columns)
    store.append_partitioned(records, store_path, by=store.MONTH)


def finish_run(spark, run: str, paths: dict[str, str], *, alert_sink=None, namespace: str = S.DEFAULT_NAMESPACE, first: bool = False) -> None:
    """Persist and publish a staged run. All sinks are folders of the run that are overwritten, so
    it may be done again from the start whenever it stopped."""
    folder = f"{_runs(paths['store'])}/{run}"
    if session.exists(spark, f"{folder}/_SUCCESS"):  # else it stopped while its outcome was written: nothing is stored
        staged = split_outcome(spark.read.parquet(folder))
        append_run(spark, staged.records, paths["store"], first=first)
        _write_quarantine(spark, staged.quarantined, paths["quarantine"], run)
        own = f"{paths['alerts']}/run_id={run}"
        failed = publish(alerts.alert_events(staged.records), alert_sink or (lambda ev: alerts.write_events(ev, own, mode="overwrite")))
        rows = metrics.metric_rows(staged.records.withColumn("alert_publish_failed", F.lit(failed)), namespace=namespace)
        rows.write.mode("overwrite").parquet(f"{paths['metrics']}/run_id={run}")
    session.delete_folder(spark, folder)


def _write_quarantine(spark, quarantined: DataFrame, path: str, run: str) -> None:
    rows = quarantined.select("email_id", "reason", "received_at")
    before = store.read_store(spark, path, basePath=path)
    if before is not None:
        same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in rows.columns]
        known = before.where(F.col("run_id") != run).select(*[F.col(c).alias(f"_{c}") for c in rows.columns])
        rows = rows.join(known, same, "left_anti")
    rows.write.mode("overwrite").parquet(f"{path}/run_id={run}")


def publish(events: DataFrame, sink) -> bool:
    """Hand events to the sink; True if it failed. The records are already stored,
    so the failure becomes a metric and does not stop the job."""
    try:
        sink(events)
    except Exception:  # noqa: BLE001 - any sink may be given, and none may fail the batch
        return True
    return False

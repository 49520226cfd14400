"""Metrics and alarms over time.

Records are aggregated to one row per period first, in parallel; bands, alarms and gap filling
then go along that short series in one ordered pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions import timefmt


def bucket_start(ts_ntz: Column, seconds: int) -> Column:
    """Start of the fixed ``seconds`` bucket holding ``ts`` (aligned to the epoch)."""
    e = timefmt.epoch_seconds(ts_ntz)
    return F.timestamp_add("SECOND", e - F.pmod(e, F.lit(seconds)), F.expr(timefmt.EPOCH_NTZ))


def bucket_index(ts_ntz: Column, seconds: int) -> Column:
    return F.floor(timefmt.epoch_seconds(ts_ntz) / F.lit(seconds)).cast("long")


def metric_rows(records: DataFrame, *, ts: Column | None = None,
                namespace: str = S.DEFAULT_NAMESPACE) -> DataFrame:
    """The long metric table, one row per (message, metric).

    SentimentCount=1 and PiiEntitiesDetected=n always; ClassificationFailure
    and AlertPublishFailure only when they happened. Every row carries the
    message's sentiment dimension.
    """
    ts = ts if ts is not None else F.col("processed_ts")
    failed = F.coalesce(F.col("classification_failed"), F.lit(False)) if "classification_failed" in records.columns else F.lit(False)
    alert_failed = F.coalesce(F.col("alert_publish_failed"), F.lit(False)) if "alert_publish_failed" in records.columns else F.lit(False)

    def m(name: str, value: Column, when: Column | None = None) -> Column:
        return F.struct(
            F.lit(name).alias("metric"),
            value.cast("long").alias("value"),
            (when if when is not None else F.lit(True)).alias("_emit"),
        )

    items = F.array(
        m(S.METRIC_SENTIMENT, F.lit(1)),
        m(S.METRIC_PII, F.col("pii_entities_detected")),
        m(S.METRIC_CLASSIFY_FAIL, F.lit(1), failed),
        m(S.METRIC_ALERT_FAIL, F.lit(1), alert_failed),
    )
    return (
        records.select("email_id", ts.alias("ts"), "sentiment", F.inline(items))
        .where("_emit")
        .select(
            "email_id", "ts", F.lit(namespace).alias("namespace"), "metric",
            F.lit(S.METRIC_UNIT).alias("unit"), "sentiment", "value",
        )
    )


def metric_json(records: DataFrame, *, namespace: str = S.DEFAULT_NAMESPACE) -> DataFrame:
    """The one-line JSON document per message (namespace, dimensions, values)."""
    failed = F.coalesce(F.col("classification_failed"), F.lit(False))
    alert_failed = F.coalesce(F.col("alert_publish_failed"), F.lit(False)) if "alert_publish_failed" in records.columns else F.lit(False)
    metric = lambda n: F.struct(F.lit(n).alias("Name"), F.lit(S.METRIC_UNIT).alias("Unit"))
    names = F.filter(
        F.array(
            F.struct(metric(S.METRIC_SENTIMENT).alias("m"), F.lit(True).alias("on")),
            F.struct(metric(S.METRIC_PII).alias("m"), F.lit(True).alias("on")),
            F.struct(metric(S.METRIC_CLASSIFY_FAIL).alias("m"), failed.alias("on")),
            F.struct(metric(S.METRIC_ALERT_FAIL).alias("m"), alert_failed.alias("on")),
        ),
        lambda x: x["on"],
    )
    doc = F.struct(
        F.struct(
            timefmt.epoch_millis(F.col("processed_ts")).alias("Timestamp"),
            F.array(F.struct(
                F.lit(namespace).alias("Namespace"),
                F.array(F.array(F.lit("sentiment"))).alias("Dimensions"),
                F.transform(names, lambda x: x["m"]).alias("Metrics"),
            )).alias("CloudWatchMetrics"),
        ).alias("_aws"),
        F.col("sentiment"),
        F.lit(1).alias(S.METRIC_SENTIMENT),
        F.col("pii_entities_detected").alias(S.METRIC_PII),
        F.when(failed, F.lit(1)).alias(S.METRIC_CLASSIFY_FAIL),
        F.when(alert_failed, F.lit(1)).alias(S.METRIC_ALERT_FAIL),
    )
    return records.select("email_id", F.to_json(doc).alias("line"))


def metric_sum(metrics: DataFrame, metric: str, *, period_s: int | None = None,
               by_sentiment: bool = True) -> DataFrame:
    """A1/A2/A3: sum of one metric by (period, sentiment)."""
    rows = metrics.where(F.col("metric") == metric)
    keys = []
    if period_s is not None:
        keys.append(bucket_start(F.col("ts"), period_s).alias("period_start"))
    if by_sentiment:
        keys.append(F.col("sentiment"))
    return rows.groupBy(*keys).agg(F.sum("value").cast("long").alias("value"))


def sentiment_counts(records: DataFrame, *, period_s: int = 86400, ts: str = "received_ts") -> DataFrame:
    """A1: SentimentCount per period and sentiment (one per record)."""
    return records.groupBy(
        bucket_start(F.col(ts), period_s).alias("period_start"), "sentiment"
    ).agg(F.count(F.lit(1)).alias("sentiment_count"))


def synthesis_metrics(outcomes: DataFrame, ts: Column, *, namespace: str = S.DEFAULT_NAMESPACE) -> DataFrame:
    """A3/M3: one ``SynthesisFailure`` row per question whose attempts all failed."""
    return outcomes.where("synthesis_failed").select(
        ts.alias("ts"), F.lit(namespace).alias("namespace"), F.lit(S.METRIC_SYNTH_FAIL).alias("metric"),
        F.lit(S.METRIC_UNIT).alias("unit"), F.lit(None).cast("string").alias("sentiment"), F.lit(1).cast("long").alias("value"))


def failure_counts(records: DataFrame) -> DataFrame:
    """A3: failure metrics, counted only where they occurred."""
    failed = F.coalesce(F.col("classification_failed"), F.lit(False))
    alert_failed = F.coalesce(F.col("alert_publish_failed"), F.lit(False)) if "alert_publish_failed" in records.columns else F.lit(False)
    return records.agg(
        F.count_if(failed).alias(S.METRIC_CLASSIFY_FAIL),
        F.count_if(alert_failed).alias(S.METRIC_ALERT_FAIL),
        F.count(F.lit(1)).alias("records"),
    )


def pii_by_type(redacted: DataFrame, entities: str = "kept_entities") -> DataFrame:
    """Redacted spans per entity type."""
    return (
        redacted.select(F.explode(entities).alias("e"))
        .groupBy(F.col("e.type").alias("type"))
        .agg(F.count(F.lit(1)).alias("spans"))
    )


# ---------------------------------------------------------------------------
# Series, bands and alarms
# ---------------------------------------------------------------------------

def _along(idx: str):
    """Order along a bucket series. The series is already aggregated - one row per
    period, whatever the number of records - so one ordered pass over it is small."""
    from pyspark.sql import Window

    return Window.partitionBy(F.lit(0)).orderBy(idx)


def dense_series(values: DataFrame, idx: str = "idx", value: str = "value") -> DataFrame:
    """H9: fill the gaps between the first and last bucket with 0: each bucket is
    followed by the missing ones up to the next."""
    following = F.lead(idx).over(_along(idx))
    run = F.sequence(F.col(idx), F.coalesce(following - 1, F.col(idx)))
    filled = values.select(F.col(idx).alias("_at"), F.col(value).alias("_v"), run.alias("_run")).select("_at", "_v", F.explode("_run").alias(idx))
    return filled.select(idx, F.when(F.col(idx) == F.col("_at"), F.col("_v")).otherwise(F.lit(0)).alias(value))


def trailing_stats(series: DataFrame, n: int, idx: str = "idx", value: str = "value") -> DataFrame:
    """Mean and sample deviation of the ``n`` buckets before each bucket of a dense
    series; null where there are fewer."""
    before = _along(idx).rowsBetween(-n, -1)
    full = F.count(F.lit(1)).over(before) == F.lit(n)
    return series.select(
        idx, value,
        F.when(full, F.avg(value).over(before)).alias("band_mean"),
        F.when(full, F.stddev_samp(value).over(before)).alias("band_sd"),
    )


def anomaly_band(series: DataFrame, *, lookback: int, width: float = S.ANOMALY_BAND_WIDTH,
                 idx: str = "idx", value: str = "value") -> DataFrame:
    """Breach when the value leaves ``mean +- width * sd`` of the lookback."""
    st = trailing_stats(series, lookback, idx, value)
    lo = F.col("band_mean") - F.lit(width) * F.col("band_sd")
    hi = F.col("band_mean") + F.lit(width) * F.col("band_sd")
    breach = F.coalesce((F.col(value) < lo) | (F.col(value) > hi), F.lit(False))
    return st.select(idx, value, F.round("band_mean", 6).alias("band_mean"), F.round("band_sd", 6).alias("band_sd"),
                     F.round(lo, 6).alias("band_low"), F.round(hi, 6).alias("band_high"), breach.alias("breach"))


def consecutive_alarm(flags: DataFrame, periods: int = S.ANOMALY_EVAL_PERIODS,
                      idx: str = "idx", flag: str = "breach") -> DataFrame:
    """Alarm at a bucket when it and the ``periods-1`` before it (no gap) all breach."""
    recent = _along(idx).rangeBetween(-(periods - 1), 0)
    hits = F.count_if(F.col(flag)).over(recent)
    return flags.select(idx, flag, (hits == periods).alias("alarm"))


def negative_sentiment_anomaly(records: DataFrame, *, period_s: int = S.ANOMALY_PERIOD_S, lookback: int = 7,
                               width: float = S.ANOMALY_BAND_WIDTH, ts: str = "received_ts") -> DataFrame:
    """W1 over records: per bucket, negative SentimentCount vs its band."""
    counts = (
        records.where(F.col("sentiment") == "negative")
        .groupBy(bucket_index(F.col(ts), period_s).alias("idx"))
        .agg(F.count(F.lit(1)).alias("value"))
    )
    band = anomaly_band(dense_series(counts), lookback=lookback, width=width)
    return band.withColumn(
        "bucket_start", F.timestamp_add("SECOND", F.col("idx") * period_s, F.expr(timefmt.EPOCH_NTZ))
    )


def threshold_alarm(values: DataFrame, *, ts: str, value: str, period_s: int = S.DLQ_PERIOD_S,
                    threshold: float = S.DLQ_THRESHOLD) -> DataFrame:
    """Per ``period_s`` bucket, sum of ``value``; alarm when above threshold."""
    return (
        values.groupBy(bucket_start(F.col(ts), period_s).alias("bucket_start"))
        .agg(F.sum(value).cast("long").alias("total"))
        .withColumn("alarm", F.col("total") > F.lit(threshold))
    )


def weekly_trend(records: DataFrame, ts: str = "received_ts") -> DataFrame:
    """Records per (week, sentiment) vs the previous week.

    The previous week is found by an equi-join on ``week - 1`` (no window,
    so no single task sees a whole series).
    """
    wk = records.groupBy(
        F.floor((timefmt.epoch_seconds(F.col(ts)) - F.lit(4 * 86400)) / F.lit(7 * 86400)).cast("long").alias("week"),
        "sentiment",
    ).agg(F.count(F.lit(1)).alias("n"))
    prev = wk.select((F.col("week") + 1).alias("week"), "sentiment", F.col("n").alias("prev_n"))
    return wk.join(prev, ["week", "sentiment"], "left").select(
        F.timestamp_add("SECOND", F.col("week") * (7 * 86400) + 4 * 86400, F.expr(timefmt.EPOCH_NTZ)).alias("week_start"),
        "sentiment", "n", "prev_n",
        (F.col("n") - F.col("prev_n")).alias("change"),
    )


def sentiment_series(records: DataFrame, *, period_s: int = 86400, ts: str = "received_ts") -> DataFrame:
    """Stacked sentiment counts and PII sum per period (fixed pivot values)."""
    vals = S.SENTIMENTS + ["unknown"]
    per = records.groupBy(bucket_start(F.col(ts), period_s).alias("period_start"))
    aggs = [F.count_if(F.col("sentiment") == v).alias(v) for v in vals]
    return per.agg(*aggs, F.sum("pii_entities_detected").cast("long").alias("pii_entities"))

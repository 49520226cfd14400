"""Registered time-series queries: anomaly band, alarms, trends."""

from __future__ import annotations


from ..operators import metrics
from ..sources import views
from .registry import register

PERIOD_S = 21600   # six-hour buckets: the 300 s production period is too sparse for the test tables
LOOKBACK = 8

BAND_SQL = f"""
counts AS (
  SELECT CAST(floor(epoch(received_ts) / {PERIOD_S}) AS BIGINT) AS idx, count(*) AS value
  FROM triage_history WHERE sentiment = 'negative' GROUP BY 1),
grid AS (SELECT unnest(generate_series((SELECT min(idx) FROM counts), (SELECT max(idx) FROM counts))) AS idx),
series AS (SELECT g.idx, coalesce(c.value, 0) AS value FROM grid g LEFT JOIN counts c USING (idx)),
st AS (
  SELECT idx, value,
         CASE WHEN count(*) OVER w = {LOOKBACK} THEN avg(value) OVER w END AS m,
         CASE WHEN count(*) OVER w = {LOOKBACK} THEN stddev_samp(value) OVER w END AS sd
  FROM series WINDOW w AS (ORDER BY idx ROWS BETWEEN {LOOKBACK} PRECEDING AND 1 PRECEDING)),
band AS (
  SELECT idx, value, m, sd, m - 2 * sd AS lo, m + 2 * sd AS hi,
         coalesce(value < m - 2 * sd OR value > m + 2 * sd, false) AS breach
  FROM st)"""


def _band(spark, sf_dir):
    return metrics.negative_sentiment_anomaly(views.triage_history(spark, sf_dir), period_s=PERIOD_S,
                                              lookback=LOOKBACK)


@register("sentiment_anomaly", "WITH " + BAND_SQL.strip() + f"""
SELECT idx, value, round(m, 6) AS band_mean, round(sd, 6) AS band_sd, round(lo, 6) AS band_low,
       round(hi, 6) AS band_high, breach,
       TIMESTAMP '1970-01-01' + to_seconds(idx * {PERIOD_S}) AS bucket_start
FROM band""")
def q_sentiment_anomaly(spark, sf_dir):
    return _band(spark, sf_dir)


@register("anomaly_alarm", "WITH " + BAND_SQL.strip() + """
SELECT idx, breach,
       coalesce(count(*) OVER w = 3 AND bool_and(breach) OVER w, false) AS alarm
FROM band WINDOW w AS (ORDER BY idx ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)""")
def q_anomaly_alarm(spark, sf_dir):
    return metrics.consecutive_alarm(_band(spark, sf_dir).select("idx", "breach"), 3)


@register("sentiment_series", """
SELECT TIMESTAMP '1970-01-01' + to_seconds(CAST(floor(epoch(received_ts) / 86400) * 86400 AS BIGINT)) AS period_start,
       count(*) FILTER (WHERE sentiment = 'positive') AS positive,
       count(*) FILTER (WHERE sentiment = 'negative') AS negative,
       count(*) FILTER (WHERE sentiment = 'constructive') AS constructive,
       count(*) FILTER (WHERE sentiment = 'unknown') AS unknown,
       CAST(sum(pii_entities_detected) AS BIGINT) AS pii_entities
FROM triage_history GROUP BY 1""", ("triage_history",))
def q_sentiment_series(spark, sf_dir):
    return metrics.sentiment_series(views.triage_history(spark, sf_dir))


@register("sentiment_wow", """
, wk AS (
  SELECT CAST(floor((epoch(received_ts) - 4 * 86400) / (7 * 86400)) AS BIGINT) AS week, sentiment, count(*) AS n
  FROM triage_history GROUP BY 1, 2)
SELECT TIMESTAMP '1970-01-01' + to_seconds(w.week * 7 * 86400 + 4 * 86400) AS week_start, w.sentiment, w.n,
       p.n AS prev_n, w.n - p.n AS change
FROM wk w LEFT JOIN wk p ON p.week = w.week - 1 AND p.sentiment = w.sentiment""", ("triage_history",))
def q_sentiment_wow(spark, sf_dir):
    return metrics.weekly_trend(views.triage_history(spark, sf_dir))


def fix_oracles(*keys):
    """Attach the triage_history view to the band queries (their SQL starts a WITH)."""
    from .oracle import VIEWS
    from .registry import ORACLE

    th = VIEWS["triage_history"].strip()
    for k in keys:
        ORACLE[k] = ORACLE[k].replace("WITH counts AS", f"WITH {th},\ncounts AS", 1)


def _fix_trend():
    from .registry import ORACLE

    ORACLE["sentiment_wow"] = ORACLE["sentiment_wow"].replace("\n, wk AS", ",\nwk AS", 1)


fix_oracles("sentiment_anomaly", "anomaly_alarm")
_fix_trend()

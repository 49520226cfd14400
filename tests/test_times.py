"""ISO-8601 texts: the column parser against the standard library's."""

import itertools
from datetime import datetime, timezone

from pyspark.sql import functions as F

from mailsift.functions import timefmt

DATES = ["2026-06-21", "20260621", "2026-W25-7", "2026W257", "2026-W01", "2026W53", "2020-W53-4", "2020W01", "2024-02-29", "0001-01-02"]
BAD_DATES = ["2026-02-29", "2025-W53", "2026-13-01", "20261301", "2026-00-10", "2026-W00", "2026-W25-8", "2026-0621", "202606", "26-06-21", "", "yesterday"]
CLOCKS = ["", "T14", "T14:30", "T1430", " 14:30:05", "T143005", "_14:30:05.5", "T14:30:05,123456", "T143005.1234567", "T23:59:59.999999"]
BAD_CLOCKS = ["T", "T24:00", "T14:60", "T1", "T14:3", "T14:30:60", "T14:30.5", "T1430:05", "T14:30:05.", "14:30"]
OFFSETS = ["", "Z", "+00:00", "-05:30", "+0545", "+09", "-00:00:01", "+013015"]
BAD_OFFSETS = ["z", "+1", "+24:00", "+05:60", "UTC", "+05:3"]


def expected(text):
    try:
        got = datetime.fromisoformat(text)
    except ValueError:
        return None
    got = got if got.tzinfo is not None else got.replace(tzinfo=timezone.utc)
    return got.astimezone(timezone.utc).replace(tzinfo=None)


def test_every_form(spark):
    texts = ["".join(x) for x in itertools.product(DATES, CLOCKS, OFFSETS)]
    texts += ["".join(x) for x in itertools.product(BAD_DATES, CLOCKS[:3], OFFSETS[:3])]
    texts += ["".join(x) for x in itertools.product(DATES[:3], BAD_CLOCKS, OFFSETS[:3])]
    texts += ["".join(x) for x in itertools.product(DATES[:3], CLOCKS[2:5], BAD_OFFSETS)] + [None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.p for r in rows.select("i", timefmt.parse_iso(F.col("t")).alias("p")).collect()}
    wrong = []
    for i, t in enumerate(texts):
        try:
            want = expected(t) if t else None
        except OverflowError:  # an offset moves it out of the calendar
            continue
        wrong += [(t, got[i], want)] if got[i] != want else []
    assert not wrong, (len(wrong), wrong[:20])


def test_usual_form_in_another_zone(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Asia/Kolkata")
    try:
        row = spark.range(1).select(timefmt.parse_iso(F.lit("2026-06-21T14:30:00+00:00")).alias("a"), timefmt.parse_iso(F.lit("20260621T1430Z")).alias("b")).first()
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert row.a == row.b == datetime(2026, 6, 21, 14, 30)

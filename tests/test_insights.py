"""Insight queries (P1-P5, J4, A4-A10) on literal records."""

from pyspark.sql import functions as F

from mailsift import schemas as S
from mailsift.functions import timefmt
from mailsift.operators import insights as I
from mailsift.operators import store


def rec(**kw):
    base = dict(email_id="msg-001", received_at="2026-06-21T10:00:00+00:00", from_address="jane@example.com",
                subject="Test subject", raw_s3_key="raw-emails/msg-001", category="billing", urgency="medium",
                urgency_override_applied=False, sentiment="negative", confidence="high",
                review_status="auto_processed", suggested_reply="We'll look into it.", feature_tags=[],
                redacted_body="Some redacted text.", pii_entities_detected=0,
                processed_at="2026-06-21T10:00:05+00:00", ttl=1758466200)
    base.update(kw)
    return base


def table(spark, *rows):
    cols = [f.name for f in S.TRIAGE_RECORD.fields]
    df = spark.createDataFrame([tuple(r[c] for c in cols) for r in rows], S.TRIAGE_RECORD)
    return df.withColumn("received_ts", timefmt.parse_iso(F.col("received_at")))


def ids(df):
    return sorted(r.email_id for r in df.collect())


def test_no_filter_excludes_needs_review(spark):
    t = table(spark, rec(email_id="a"), rec(email_id="b"), rec(email_id="c", review_status="needs_review"))
    assert ids(I.triage_query(t)) == ["a", "b"]


def test_single_and_multiple_filters(spark):
    t = table(spark, rec(email_id="a"), rec(email_id="b", category="bug_report"),
              rec(email_id="c", urgency="high"), rec(email_id="d", from_address="bob@example.com"))
    assert ids(I.triage_query(t, category="billing", urgency="medium", from_address="jane@example.com")) == ["a"]
    assert ids(I.triage_query(t, category="bug_report")) == ["b"]
    assert ids(I.triage_query(t, from_address="bob@example.com")) == ["d"]
    assert ids(I.triage_query(t, category="praise")) == []


def test_date_ranges(spark):
    t = table(spark, *[rec(email_id=d, received_at=f"2026-06-{d}T10:00:00+00:00") for d in ("19", "20", "21",
                                                                                          "22", "23")])
    assert ids(I.triage_query(t, date_from="2026-06-21T00:00:00+00:00")) == ["21", "22", "23"]
    assert ids(I.triage_query(t, date_from="2026-06-20T00:00:00+00:00", date_to="2026-06-22T00:00:00+00:00")) \
        == ["20", "21"]
    # a date-only upper bound: whole day in time mode, excluded day in lexical mode
    assert ids(I.triage_query(t, date_to="2026-06-20")) == ["19", "20"]
    assert ids(I.triage_query(t, date_to="2026-06-20", mode="lexical")) == ["19"]


def test_projection(spark):
    t = table(spark, rec())
    assert I.triage_query(t).columns == I.PAGE_FIELDS
    assert I.auto_processed_min(t).columns == ["category", "urgency", "sentiment", "feature_tags", "received_at"]


def test_bad_enum_rejected(spark):
    import pytest

    with pytest.raises(ValueError):
        I.filter_condition(category="nope")


def test_top_tags_ties_by_name(spark):
    t = table(spark, rec(email_id="a", category="feature_request", feature_tags=["dark-mode", "sso"]),
              rec(email_id="b", category="feature_request", feature_tags=["sso", "csv"]),
              rec(email_id="c", category="feature_request", feature_tags=["csv", "api"]),
              rec(email_id="d", category="billing", feature_tags=["billing-tag"]))
    got = [tuple(r) for r in I.top_feature_tags(t, 3).collect()]
    assert got == [("csv", 2), ("sso", 2), ("api", 1)]


def test_tool_call_eval_null_filters_and_counts(spark):
    t = table(spark, rec(email_id="a"), rec(email_id="b", category="bug_report"),
              rec(email_id="c", review_status="needs_review"))
    req = spark.createDataFrame([
        ("q", 1, 1, "all", None, None, None, None, None, None),
        ("q", 1, 1, "bill", "billing", None, None, None, None, None),
        ("q", 1, 2, "none", "praise", None, None, None, None, None),
    ], S.TOOL_CALL)
    got = {r.call_id: r.records for r in I.tool_call_eval(t, req).collect()}
    assert got == {"all": 2, "bill": 1, "none": 0}
    rc = I.records_considered(t, req).first()
    assert (rc.records_considered, rc.calls) == (3, 3)


def test_store_lookup_and_retention(spark):
    t = table(spark, rec(email_id="a", ttl=100), rec(email_id="b", ttl=10**10))
    assert ids(store.get(t, "a")) == ["a"] and ids(store.get(t, "zz")) == []
    assert ids(store.get_many(t, spark.createDataFrame([("b",), ("q",)], "email_id string"))) == ["b"]
    assert ids(store.retention_live(t, "2024-01-01T00:00:00+00:00")) == ["b"]
    assert ids(store.retention_expired(t, "2024-01-01T00:00:00+00:00")) == ["a"]


def test_last_write_wins(spark):
    df = spark.createDataFrame([("a", 1, 10), ("a", 2, 30), ("a", 3, 20), ("b", 1, 5)], "email_id string, v int, ts int")
    got = sorted(tuple(r) for r in store.last_write_wins(df, "email_id", "ts").collect())
    assert got == [("a", 2, 30), ("b", 1, 5)]


def test_null_reply_and_empty_tags_roundtrip(spark, tmp_path):
    t = table(spark, rec(suggested_reply=None, feature_tags=[], urgency_override_applied=True))
    t.write.parquet(str(tmp_path / "s"))
    r = spark.read.parquet(str(tmp_path / "s")).first()
    assert r.suggested_reply is None and r.feature_tags == [] and r.urgency_override_applied is True


def test_stored_table_prunes_partitions(spark, tmp_path):
    t = table(spark, *[rec(email_id=f"m{d}", received_at=f"2026-06-{d}T10:00:00+00:00") for d in range(10, 25)])
    path = str(tmp_path / "store")
    store.append_partitioned(t.withColumn("received_date", F.to_date("received_ts")).drop("received_ts"), path)
    st = I.read_store(spark, path)
    q = I.triage_query(st, category="billing", date_from="2026-06-20T00:00:00+00:00", date_to="2026-06-21")
    assert ids(q) == ["m20", "m21"]
    plan = q._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(received_date" in plan
    assert "PushedFilters: [IsNotNull(review_status), IsNotNull(category), EqualTo(review_status,auto_processed)" in plan
    assert ids(I.triage_query(st, date_to="2026-06-11", mode="lexical")) == ["m10"]


def test_request_errors(spark):
    req = spark.createDataFrame([
        ("q", 1, 1, "ok", "billing", None, "high", None, "2026-06-01", None),
        ("q", 1, 1, "c", "refund", None, None, None, None, None),
        ("q", 1, 1, "d", None, None, None, None, "yesterday", None),
    ], S.TOOL_CALL)
    got = {r.call_id: r.request_error for r in I.request_errors(req).collect()}
    assert got == {"ok": None, "c": "bad_category", "d": "bad_date_from"}


def test_put_last_write_wins(spark, tmp_path):
    path = str(tmp_path / "store")

    def versions(*rows):
        return spark.createDataFrame(rows, "email_id string, v int, received_at string, processed_ts long")

    store.put(versions(("a", 1, "2026-06-01T10:00:00+00:00", 5), ("a", 2, "2026-06-01T10:00:00+00:00", 9),
                       ("b", 1, "2026-06-02T10:00:00+00:00", 5)), path, spark)
    second = versions(("a", 3, "2026-06-01T10:00:00+00:00", 12), ("b", 0, "2026-06-02T10:00:00+00:00", 2),
                      ("c", 7, "2026-06-03T10:00:00+00:00", 1))
    for _ in range(2):  # a retried put changes nothing
        store.put(second, path, spark)
        assert sorted((r.email_id, r.v) for r in spark.read.parquet(path).collect()) == [("a", 3), ("b", 1), ("c", 7)]


def test_only_a_missing_store_is_empty(spark, tmp_path):
    import pytest

    assert store.read_store(spark, str(tmp_path / "none")) is None
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "part-0.parquet").write_bytes(b"this is not parquet")
    with pytest.raises(Exception):
        store.read_store(spark, str(tmp_path / "bad"))


def test_raw_retention(spark):
    raw = spark.createDataFrame([("a", "2026-01-01 00:00:00"), ("b", "2026-03-01 00:00:00")], "key string, t string")
    raw = raw.withColumn("received_ts", F.col("t").cast("timestamp_ntz"))
    assert [r.key for r in store.raw_expired(raw, "2026-04-02T00:00:00+00:00").collect()] == ["a"]


def _brute(rows, requests):
    """Date-only bounds cover their day; null filters match all."""
    out = {}
    for q in requests:
        hits = []
        for r in rows:
            day = r["received_at"][:10]
            if all(q[c] is None or q[c] == r[c] for c in ("category", "urgency")) and (
                    q["date_from"] is None or q["date_from"] <= day) and (q["date_to"] is None or day <= q["date_to"]):
                hits.append(r["email_id"])
        out[q["call_id"]] = sorted(hits)
    return out


def test_requests_by_date_equal_brute_force_and_use_no_nested_loop(spark):
    import datetime
    import random

    rnd = random.Random(3)
    day = lambda n: (datetime.date(2025, 12, 20) + datetime.timedelta(days=n)).isoformat()
    rows = [dict(email_id=f"m{i}", received_at=day(rnd.randrange(90)) + "T12:30:00+00:00",
                 category=rnd.choice(["billing", "praise"]), urgency=rnd.choice(["high", "low"])) for i in range(200)]
    rows.append(dict(rows[0]))  # a record that occurs twice
    requests = []
    for i in range(60):
        a, b = rnd.randrange(90), rnd.randrange(90)
        requests.append(dict(call_id=f"c{i}", category=rnd.choice([None, "billing"]), urgency=rnd.choice([None, "low"]),
                             date_from=rnd.choice([None, day(a), day(a)]), date_to=rnd.choice([None, day(b), day(b)])))
    t = table(spark, *[rec(**r) for r in rows])
    req = spark.createDataFrame([("q", 1, 1, q["call_id"], q["category"], None, q["urgency"], None, q["date_from"], q["date_to"])
                                 for q in requests], S.TOOL_CALL)
    got = {}
    for r in I.tool_call_union(t, req).collect():
        got.setdefault(r.call_id, []).append(r.email_id)
    want = _brute(rows, requests)
    assert {k: sorted(v) for k, v in got.items()} == {k: v for k, v in want.items() if v}
    assert {r.call_id: r.records for r in I.tool_call_eval(t, req).collect()} == {k: len(v) for k, v in want.items()}
    prev = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    for threshold in ("-1", prev):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        plan = I.tool_call_matches(t, req)._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", prev)


def test_latency_percentiles_over_many_values(spark):
    import random

    rnd = random.Random(7)
    rows = [("a", rnd.random() * 50) for _ in range(800)] + [("b", float(v)) for v in (3, 3, 3, 9)] + [("c", 1.5)]
    df = spark.createDataFrame(rows, "category string, s double").withColumn(
        "received_ts", F.expr("TIMESTAMP_NTZ'2026-01-01 00:00:00'"))
    df = df.withColumn("processed_ts", F.expr("timestampadd(MICROSECOND, cast(s * 1e6 as bigint), received_ts)"))
    exact = df.withColumn("x", F.floor(F.col("s") * 1e6) / 1e6).groupBy("category").agg(
        F.round(F.percentile("x", 0.5), 6), F.round(F.percentile("x", 0.95), 6))
    got = {r.category: (r.p50_s, r.p95_s) for r in I.latency_stats(df).collect()}
    assert got == {r[0]: (r[1], r[2]) for r in exact.collect()}


def test_dense_series_and_bands(spark):
    import statistics

    from mailsift.operators import metrics

    vals = spark.createDataFrame([(3, 5), (10, 1), (900, 2)], "idx long, value long")
    got = {r.idx: r.value for r in metrics.dense_series(vals).collect()}
    assert len(got) == 898 and got[3] == 5 and got[10] == 1 and got[900] == 2 and got[4] == 0 and sum(got.values()) == 8
    assert metrics.dense_series(vals.limit(0)).count() == 0
    stats = {r.idx: r for r in metrics.trailing_stats(metrics.dense_series(vals), 4).collect()}
    assert stats[6].band_mean is None and stats[7].band_mean == 1.25
    assert abs(stats[7].band_sd - statistics.stdev([5, 0, 0, 0])) < 1e-9
    flags = spark.createDataFrame([(1, True), (2, True), (3, True), (4, True), (6, True), (7, True), (8, False)], "idx long, breach boolean")
    assert [r.idx for r in metrics.consecutive_alarm(flags).orderBy("idx").collect() if r.alarm] == [3, 4]


def test_synthesis_failures_become_metrics(spark):
    from mailsift.operators import metrics

    out = spark.createDataFrame([("q1", True), ("q2", False)], "question_id string, synthesis_failed boolean")
    rows = metrics.synthesis_metrics(out, F.lit("t")).collect()
    assert [(r.metric, r.sentiment, r.value) for r in rows] == [("SynthesisFailure", None, 1)]

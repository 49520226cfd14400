"""Redaction (F1, P8, O1) and the built-in detector."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from mailsift import schemas as S
from mailsift.functions import redact as R
from mailsift.plans import triage as M

ENT = S.ENTITIES.simpleString()

CASES = [
    ("My SSN is 123-45-6789, please help.", [(.9, "SSN", 10, 21)], "My SSN is [SSN], please help.", 1),
    ("I live at 123 Main St and my SSN is 123-45-6789.", [(.9, "ADDRESS", 10, 21), (.9, "SSN", 36, 47)],
     "I live at [ADDRESS] and my SSN is [SSN].", 2),
    ("My SSN is 123-45-6789, please help.", [(.3, "SSN", 10, 21)], "My SSN is 123-45-6789, please help.", 0),
    ("Everything looks fine, no sensitive data here.", [], "Everything looks fine, no sensitive data here.", 0),
    ("SSN 123-45-6789 and card 4111-1111-1111-1111.", [(.9, "SSN", 4, 15), (.3, "CREDIT_DEBIT_NUMBER", 25, 44)],
     "SSN [SSN] and card 4111-1111-1111-1111.", 1),
    ("My SSN is 123-45-6789 and card 4111-1111-1111-1111.",
     [(.9, "CREDIT_DEBIT_NUMBER", 31, 50), (.9, "SSN", 10, 21)],
     "My SSN is [SSN] and card [CREDIT_DEBIT_NUMBER].", 2),
    ("123-45-6789 is my SSN", [(.9, "SSN", 0, 11), (.9, "ADDRESS", 18, 21)], "[SSN] is my [ADDRESS]", 2),
    ("é☕😀 SSN 123-45-6789, hi", [(.9, "SSN", 8, 19)], "é☕😀 SSN [SSN], hi", 1),
    ("Call Jane at jane@x.com", [(.99, "NAME", 5, 9), (.99, "EMAIL", 13, 23)], "Call Jane at jane@x.com", 0),
]


def py_redact(text, spans, threshold=0.5, skip=("NAME", "EMAIL", "PHONE"), compat=False):
    """Plain loop with the documented semantics, for comparison."""
    kept = [s for s in spans if s[0] >= threshold and s[1] not in skip]
    kept = sorted(kept, key=lambda s: s[2])  # stable
    out, cur = [], 0
    for _, t, b, e in kept:
        out.append(text[cur:b] if b > cur else "")
        out.append(f"[{t}]")
        cur = e if compat else max(cur, e)
    out.append(text[cur:])
    return "".join(out), len(kept)


def _run(spark, rows, compat=False):
    df = spark.createDataFrame(rows, f"text string, ents {ENT}")
    r = R.redact(F.col("text"), F.col("ents"), compat=compat)
    return [tuple(x) for x in df.select(r["redacted_text"], r["pii_entities_detected"]).collect()]


def test_fixture_cases(spark):
    got = _run(spark, [(t, e) for t, e, _, _ in CASES])
    assert got == [(out, n) for _, _, out, n in CASES]


def test_nested_spans_default_and_compat(spark):
    rows = [("abcdefghij", [(.9, "OUT", 1, 9), (.9, "IN", 3, 5)])]
    assert _run(spark, rows) == [("a[OUT][IN]j", 2)]
    assert _run(spark, rows, compat=True) == [("a[OUT][IN]fghij", 2)]


def test_null_text_and_null_entities(spark):
    assert _run(spark, [(None, []), ("plain", None)]) == [(None, 0), ("plain", 0)]


def test_staged_redaction_matches_expression(spark):
    rows = [(t, e) for t, e, _, _ in CASES]
    df = spark.createDataFrame(rows, f"body string, ents {ENT}").withColumn("email_id", F.lit("x"))
    staged = M.redacted(df, entities=F.col("ents")).select("redacted_body", "pii_entities_detected").collect()
    assert [tuple(r) for r in staged] == [(out, n) for _, _, out, n in CASES]


span = st.tuples(
    st.sampled_from([0.2, 0.5, 0.9]),
    st.sampled_from(["SSN", "NAME", "IP_ADDRESS", "CARD"]),
    st.integers(0, 30),
    st.integers(0, 12),
).map(lambda s: (s[0], s[1], s[2], s[2] + s[3]))


@settings(max_examples=40, deadline=None)
@given(text=st.text(alphabet="ab😀é -", max_size=30), spans=st.lists(span, max_size=5), compat=st.booleans())
def test_property_matches_plain_loop(spark, text, spans, compat):
    assert _run(spark, [(text, spans)], compat=compat) == [py_redact(text, spans, compat=compat)]


def test_detector_offsets(spark):
    text = "é😀 ip 10.0.0.1, card 4111-1111-1111-1111 mail a.b@ex.com +1 (555) 123-4567 ssn 123-45-6789"
    df = spark.createDataFrame([(text,)], "body string")
    ents = df.select(R.detect("body").alias("e")).first()["e"]
    found = {(e["type"], text[e["begin"]:e["end"]]) for e in ents}
    assert found == {
        ("IP_ADDRESS", "10.0.0.1"), ("CREDIT_DEBIT_NUMBER", "4111-1111-1111-1111"),
        ("EMAIL", "a.b@ex.com"), ("PHONE", "+1 (555) 123-4567"), ("SSN", "123-45-6789"),
    }
    col_version = df.select(R.detect(F.col("body")).alias("e")).first()["e"]
    assert sorted(map(tuple, col_version)) == sorted(map(tuple, ents))


def test_detector_repeated_match_text(spark):
    text = "x 1.2.3.4 y 1.2.3.4 z"
    df = spark.createDataFrame([(text,)], "body string")
    ents = df.select(R.detect("body").alias("e")).first()["e"]
    assert [(e["begin"], e["end"]) for e in ents] == [(2, 9), (12, 19)]


@pytest.mark.parametrize("text", ["", "no digits here", None])
def test_detector_empty(spark, text):
    df = spark.createDataFrame([(text,)], "body string")
    ents = df.select(R.detect("body").alias("e")).first()["e"]
    assert ents == ([] if text is not None else None)


def test_detector_many_adjacent_matches_match_re(spark):
    import re

    text = "1.2.3.4" + "😀é".join(f"10.0.{i}.{i}" for i in range(300)) + "999-99-9999"
    df = spark.createDataFrame([(text,)], "body string")
    for col in ("body", F.col("body")):
        ents = df.select(R.detect(col).alias("e")).first()["e"]
        got = sorted((e["type"], e["begin"], e["end"]) for e in ents)
        want = sorted((t, m.start(), m.end()) for t, _, p, _ in R.DETECTOR_PATTERNS for m in re.finditer(p, text))
        assert got == want


def test_work_is_linear_in_the_matches(spark):
    """Twice the matches in one body take about twice the time, and thousands take no seconds."""
    import time

    from mailsift.plans import triage as M

    def seconds(n):
        body = " ".join(f"10.{i % 200}.{i % 199}.{i % 198}" for i in range(n))
        df = spark.createDataFrame([(body,)], "body string").cache()
        df.count()
        best = float("inf")
        for _ in range(3):
            t0 = time.perf_counter()
            r = M.redacted(df).first()
            best = min(best, time.perf_counter() - t0)
        assert r.pii_entities_detected == n and r.redacted_body == " ".join(["[IP_ADDRESS]"] * n)
        return best

    small, large = seconds(20_000), seconds(40_000)
    assert large < 2.5 * small + 1.0 and large < 10

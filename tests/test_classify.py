"""Strict parsing, validation and attempt resolution."""

import json

import pytest
from pyspark.sql import functions as F

from mailsift.functions import jsonparse as J
from mailsift.operators import classify as C

VALID = json.dumps({"category": "billing", "urgency": "medium", "sentiment": "negative", "confidence": "high",
                    "suggested_reply": "We'll look into it.", "feature_tags": []})


def _obj(**kw):
    d = {"category": "billing", "urgency": "medium", "sentiment": "negative", "confidence": "high",
         "suggested_reply": "ok"}
    d.update(kw)
    return json.dumps({k: v for k, v in d.items() if v is not ...})


@pytest.mark.parametrize("raw,valid", [
    (VALID, True),
    ("not valid json at all", False),
    (_obj(confidence=...), False),
    (_obj(urgency="critical"), False),
    (VALID + " trailing text", False),
    (VALID + "]", False),
    (VALID + "] sure, here is more", False),
    (VALID + '],[{"b":2}', False),
    (VALID + "}", False),
    (VALID + ',"x":1', False),
    (VALID + "," + VALID, False),
    ("  \n" + VALID + "\t ", True),
    (_obj(suggested_reply="use ]} or },{ freely"), True),
    ('{"a":1,"a":2}', False),
    ("{'category': 'billing'}", False),
    ("[1]", False),
    ("null", False),
    ("", False),
    (VALID[:-5], False),
    ("```json\n" + VALID + "\n```", False),
    (_obj(suggested_reply=None), True),
    (_obj(feature_tags=None), True),
    (_obj(category=1), False),
    (_obj(category=["billing"]), False),
    (None, False),
])
def test_validate(spark, raw, valid):
    df = spark.createDataFrame([(raw,)], "raw string")
    assert df.select(C.validate(F.col("raw"))["valid"]).first()[0] is valid


def test_default_tags(spark):
    df = spark.createDataFrame([(_obj(),), (_obj(feature_tags=None),), (_obj(feature_tags=["a", "b"]),)], "raw string")
    got = [r[0] for r in df.select(C.validate(F.col("raw"))["answer"]["feature_tags"]).collect()]
    assert got == [[], [], ["a", "b"]]


def _resolve(spark, responses):
    msgs = spark.createDataFrame([(i,) for i in sorted({r[0] for r in responses} | {"none"})], "email_id string")
    t4 = spark.createDataFrame(responses, "email_id string, attempt int, raw_text string")
    return {r.email_id: r for r in C.resolve(msgs, t4).collect()}


def test_resolution(spark):
    got = _resolve(spark, [
        ("a", 1, VALID), ("a", 2, _obj(category="praise")),
        ("b", 1, "not json"), ("b", 2, _obj(category="praise", confidence="low")),
        ("c", 1, "not json"), ("c", 2, "still not"),
        ("d", 1, _obj(confidence=...)), ("d", 2, VALID),
    ])
    assert got["a"].category == "billing" and got["a"].resolved_attempt == 1 and not got["a"].classification_failed
    assert got["b"].category == "praise" and got["b"].confidence == "low" and got["b"].resolved_attempt == 2
    for k in ("c", "none"):
        r = got[k]
        assert (r.category, r.urgency, r.sentiment, r.confidence, r.suggested_reply, r.feature_tags,
                r.classification_failed) == ("unclassified", "medium", "unknown", "low", None, [], True)
    assert got["d"].resolved_attempt == 2


def test_envelope_helpers(spark):
    env = json.dumps({"content": [{"type": "tool_use", "id": "t1", "name": "q", "input": "{}"},
                                  {"type": "text", "text": '{"answer": "yes"}'}], "stop_reason": "end_turn"})
    df = spark.createDataFrame([(env,)], "e string").withColumn("p", J.parse_envelope(F.col("e")))
    r = df.select(J.first_text(F.col("p")).alias("t"), F.size(J.tool_blocks(F.col("p"))).alias("n"),
                  J.answer_of(J.first_text(F.col("p"))).alias("a")).first()
    assert (r.t, r.n, r.a) == ('{"answer": "yes"}', 1, "yes")


@pytest.mark.parametrize("text,answer", [
    ('{"answer": "ok"}', "ok"), ('{"answer": 5}', None), ("plain", None), ('{"other": 1}', None),
    ('{"answer": "ok"} extra', None),
])
def test_answer_of(spark, text, answer):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(J.answer_of(F.col("t"))).first()[0] == answer


def test_classify_calls_model_once_per_attempt(spark, tmp_path):
    calls_path = tmp_path / "calls"
    calls_path.mkdir()

    def model(text, attempt):
        with open(calls_path / f"{text}-{attempt}", "w") as fh:
            fh.write("x")
        if text == "good" or attempt == 2:
            return VALID
        return "nope"

    texts = spark.createDataFrame([("1", "good"), ("2", "bad")], "email_id string, text string")
    t4 = C.classify(spark, texts, model, path=str(tmp_path / "t4"))
    rows = sorted((r.email_id, r.attempt) for r in t4.collect())
    assert rows == [("1", 1), ("2", 1), ("2", 2)]
    assert sorted(p.name for p in calls_path.iterdir()) == ["bad-1", "bad-2", "good-1"]
    res = {r.email_id: r.resolved_attempt for r in C.resolve(texts.select("email_id"), t4).collect()}
    assert res == {"1": 1, "2": 2}


def test_classify_resumes_without_asking_again(spark, tmp_path):
    asked = str(tmp_path / "asked")

    def model(text, attempt):
        with open(f"{asked}-{text}-{attempt}", "x"):  # a second call for the same text and attempt fails
            pass
        return "broken" if attempt == 1 and text == "b" else VALID

    texts = spark.createDataFrame([("1", "a"), ("2", "b")], "email_id string, text string")
    path = str(tmp_path / "answers")
    first = sorted(tuple(r) for r in C.classify(spark, texts, model, path).collect())
    more = texts.union(spark.createDataFrame([("3", "c")], texts.schema))
    second = sorted(tuple(r) for r in C.classify(spark, more, model, path).collect())
    assert [r[:2] for r in second] == [("1", 1), ("2", 1), ("2", 2), ("3", 1)] and set(first) < set(second)

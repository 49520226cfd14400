import random
import re

from mailsift.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    seen = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    hit = {i + k for i, g in enumerate(seen) if seen.count(g) > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines),
            sum(x in lines[:i] for i, x in enumerate(lines)), len(hit))


def test_measures_equal_brute_force():
    rng = random.Random(3)
    for _ in range(500):
        text = "".join(rng.choices(["a", "b", " ", "\n", "#", "ä", "\t", " ", "\x1c"], k=rng.randint(0, 60)))
        assert quality.measure(text) == brute(text), text
    assert quality.measure(None) == (0,) * 6


def test_odd_documents(spark, odd_docs, no_docs):
    got = quality.quality_rules(odd_docs.drop("quality"))
    assert got.columns == [c for c in odd_docs.columns if c != "quality"] + ["quality"]
    rows = got.collect()
    assert len(rows) == odd_docs.count()
    for r in rows:
        if (r["text"] or "") and len(r["text"]) < 1000:
            q = r["quality"]
            assert (q.n_words, q.word_chars, q.n_symbols, q.n_lines, q.n_dup_lines, q.n_repeat_words) == brute(r["text"])
        assert r["quality"].host_rejected is not None
    assert quality.quality_rules(no_docs.drop("quality")).collect() == []


def test_kept_documents_keep_their_columns(spark, odd_docs, no_docs):
    got = quality.kept_documents(spark, odd_docs)
    assert got.columns == odd_docs.columns and got.schema == odd_docs.schema
    assert quality.kept_documents(spark, no_docs).count() == 0


def test_bad_host_is_rejected_and_small_host_is_shrunk(spark):
    good = " ".join(f"w{i}" for i in range(60))
    rows = [(i, "x", f"good{i % 5}") for i in range(10)] + [(100 + i, good, f"good{i % 5}") for i in range(190)]
    rows += [(300 + i, "x", "bad") for i in range(90)] + [(400 + i, good, "bad") for i in range(10)]
    rows += [(500, good, "tiny")] + [(501, good, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r["doc_id"]: r["quality"] for r in quality.quality_rules(docs).collect()}
    assert got[400].host_rejected and not got[400].base_failed and not got[400].kept
    assert got[100].kept and got[500].kept and got[501].kept and not got[0].kept
    hosts = quality.host_rates(
        spark.createDataFrame([("a", 10), ("b", 0)], "host_key string, w int"), {r: __import__("pyspark").sql.functions.col("w") > 5 for r in quality.RULES}
    )
    prior = quality.beta_prior(hosts)
    assert set(prior) == set(quality.RULES)
    # rates 1 and 0: mean 1/2, variance 1/2 -> no strength is left, the prior is flat
    assert prior["short"] == (1.0, 1.0)


def test_documents_that_fail_what_their_host_fails(spark):
    """Two hosts with many symbol-ridden texts among ten: only their symbol-ridden texts go."""
    good = " ".join(f"w{i}" for i in range(60))
    rows, n = [], 0
    for h in range(10):
        for k in range(200):
            bad = k < (60 if h < 2 else 6)
            rows.append((n, good + " #" * 20 if bad else good, f"host{h}"))
            n += 1
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r["doc_id"]: r["quality"] for r in quality.quality_rules(docs, keep=["doc_id"]).collect()}
    for i, text, host in rows:
        gone = "#" in text and host in ("host0", "host1")
        assert (got[i].suspect_failed, got[i].kept, got[i].host_rejected, got[i].base_failed) == (gone, not gone, False, False)

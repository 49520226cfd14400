"""op12 against a plain scoring of every document for every item."""

import math
import random
import re
from collections import Counter

import numpy as np

from mailsift.llm import lexical_search as C

UPPER = {c: c + 32 for c in range(65, 91)}


def terms(text):
    return re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", (text or "").translate(UPPER))


def brute(docs, items, top=10):
    found = [(d, terms(t)) for d, t in docs]
    found = [(d, w) for d, w in found if w]
    N, L = len(found), sum(len(w) for _, w in found)
    df = Counter(t for _, w in found for t in set(w))
    out = []
    for item, text in items:
        scores = []
        for d, w in found:
            tf, m = Counter(w), 10 + 90 * len(w) * N // L
            s = sum(math.floor(1000 * math.log((2 * N + 2) / (2 * df[t] + 1))) * (10**9 * tf[t] // (1000 * tf[t] + 8 * m)) for t in set(terms(text)))
            if s > 0:
                scores.append((-s, d is None, d or 0, d))
        out += [(item, rank, d, -s) for rank, (s, _, _, d) in enumerate(sorted(scores, key=lambda x: x[:3])[:top], 1)]
    return Counter(out)


def rows_of(df):
    return Counter(tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect())


def item_table(spark, items):
    return spark.createDataFrame(items, "item_id long, text string")


def test_odd_rows(spark, odd_docs, no_docs):
    items = [(1, "one two THREE"), (2, None), (3, ""), (4, "nowhere"), (4, "a b c"), (4, "a b c"), (5, "word1 of1 word2 straße 漢字"), (6, " ".join(f"word{i}" for i in range(900)))]
    docs = [(r.doc_id, r.text) for r in odd_docs.collect()]
    assert rows_of(C.lexical_search(odd_docs, item_table(spark, items))) == brute(docs, items)
    assert rows_of(C.lexical_search(odd_docs, item_table(spark, items), top=2)) == brute(docs, items, 2)
    assert C.lexical_search(no_docs, item_table(spark, items)).count() == 0
    assert C.lexical_search(odd_docs, item_table(spark, [])).count() == 0


def test_copies_of_a_third_and_many_small_buckets(spark, monkeypatch):
    monkeypatch.setattr(C, "BUCKET_DOCS", 7)
    monkeypatch.setattr(C, "BLOCK_CHARS", 40)
    rng = random.Random(5)
    docs = [(i, "copy of copies x1 x2 x3" if i % 3 == 0 else " ".join(f"x{min(99, int(rng.expovariate(0.05)))}" for _ in range(rng.randint(1, 60)))) for i in range(500)]
    items = [(k, " ".join(f"x{rng.randrange(100)}" for _ in range(rng.randint(1, 12)))) for k in range(12)] + [(99, "copies X1 x2")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert rows_of(C.lexical_search(df, item_table(spark, items))) == brute(docs, items)


def test_bounds_drop_only_what_cannot_reach(spark):
    """Every score to beat gives exactly the documents that reach it."""
    rng = np.random.default_rng(1)
    w = rng.integers(1, 9000, 60)
    rows = [np.sort(rng.choice(60, rng.integers(1, 30), replace=False)) for _ in range(200)]
    g = [rng.integers(1, 900_000, len(r)) for r in rows]
    norm = np.array([math.sqrt(float((w[r] * x.astype(float) ** 2).sum())) for r, x in zip(rows, g)]) * C.SLACK
    order = np.argsort(-norm)
    rows, g, norm = [rows[i] for i in order], [g[i] for i in order], norm[order]
    ends = np.cumsum([len(r) for r in rows])
    bucket = C.Bucket(list(range(200)), norm, ends, np.concatenate(rows), np.concatenate(g), w)
    for _ in range(30):
        item = rng.choice(60, rng.integers(1, 20), replace=False)
        item = item[np.argsort(-w[item], kind="stable")]
        exact = np.array([sum(int(w[t]) * int(x) for t, x in zip(r, y) if t in set(item)) for r, y in zip(rows, g)])
        for beat in sorted({1, *np.sort(exact)[[-1, -10, -50]].tolist()}):
            places, scores = bucket.best(item, max(1, beat))
            assert dict(zip(places.tolist(), scores.tolist())) == {i: s for i, s in enumerate(exact.tolist()) if s >= max(1, beat)}

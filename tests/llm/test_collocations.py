"""op13 against a plain count of every phrase."""

import re
from collections import Counter

import pytest

from mailsift.llm import collocations as C

UPPER = {c: c + 32 for c in range(65, 91)}


def brute(rows, min_count, min_share=50, top=None):
    """rows: (lang, text). The contract, read literally, with dictionaries of all phrases."""
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(UPPER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in (1, 2, 3):
                for i in range(len(w) - k + 1):
                    f[(lang, *w[i : i + k])] += 1
    n = Counter({k: v for k, v in n.items() if v})
    candidates = {p: a for p, a in f.items() if len(p) > 2 and a >= min_count}
    around = {}  # pair -> the most frequent candidate of three words around it
    for q, b in candidates.items():
        if len(q) == 4:
            for pair in (q[:3], (q[0], *q[2:])):
                around[pair] = max(around.get(pair, 0), b)
    found = []
    for p, a in candidates.items():
        lang, words = p[0], p[1:]
        if 100 * around.get(p, 0) >= min_share * a:
            continue
        cuts = []
        for k in range(1, len(words)):
            l, r = f[(lang, *words[:k])], f[(lang, *words[k:])]
            cuts.append((1_000_000 * a * a // (l * r), k, l, r))
        score, _, l, r = min(cuts)
        found.append((lang, " ".join(words), a, l, r, n[lang], score))
    found.sort(key=lambda x: (x[0], -x[6], -x[2], x[1].encode()))
    out, seen = [], Counter()
    for x in found:
        seen[x[0]] += 1
        if top is None or seen[x[0]] <= top:
            out.append((x[0], seen[x[0]], *x[1:]))
    return out


def rows_of(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def test_odd_texts(spark, odd_docs):
    rows = [(r.lang, r.text) for r in odd_docs.collect()]
    for min_count in (1, 10):
        assert rows_of(C.collocations(odd_docs, min_count=min_count)) == sorted(brute(rows, min_count))


def test_families_over_many_ranges(spark, monkeypatch):
    """One first word, one last word and one pair whose phrases fill many ranges."""
    monkeypatch.setattr(C, "RANGE_ROWS", 12)
    texts = [f"the w{i % 17} a{i % 5}. x{i % 7} the w{i % 17}, the of z{i % 11}; Y{i % 13} of end" for i in range(150)]
    rows = [("en" if i % 3 else None, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "lang string, text string")
    got = C.collocations(docs, min_count=3)
    assert rows_of(got) == sorted(brute(rows, 3))
    assert rows_of(C.collocations(docs, min_count=3, top=4)) == sorted(brute(rows, 3, top=4))


def test_blocks_of_one_text(spark, monkeypatch, sf_tiny):
    monkeypatch.setattr(C, "BLOCK_BYTES", 1)
    docs = spark.read.parquet(f"{sf_tiny}/documents.parquet")
    rows = [(r.lang, r.text) for r in docs.select("lang", "text").collect()]
    assert rows_of(C.collocations(docs, top=50)) == sorted(brute(rows, 10, top=50))


def test_no_rows(spark, no_docs):
    assert C.collocations(no_docs).count() == 0
    assert C.collocations(spark.createDataFrame([(None, None), ("en", " \t")], "lang string, text string")).count() == 0


@pytest.mark.parametrize("a,cuts,want", [
    (10, [(20, 10), (10, 20)], (500_000, 20, 10)),
    (3 * 10**12, [(3 * 10**12, 4 * 10**12), (3 * 10**12, 3 * 10**12 + 1)], (750_000, 3 * 10**12, 4 * 10**12)),
])
def test_weakest_cut(a, cuts, want):
    assert C.weakest_cut(a, cuts) == want

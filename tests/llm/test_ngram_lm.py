import collections
import math
import re
import zlib

import numpy as np
import pytest

from mailsift.llm import elias_fano, ngram_lm
from mailsift.llm.common import id_crc

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.mark.parametrize("n,universe", [(0, 1), (1, 5), (5, 3), (1000, 50), (1000, 10**6), (777, 1 << 40), (3000, 3000), (64, 64)])
def test_elias_fano(n, universe, tmp_path):
    rng = np.random.default_rng(n)
    values = np.sort(rng.integers(0, universe, n)).astype(np.uint64)
    built = elias_fano.EliasFano.build(values)
    read, _ = elias_fano.EliasFano.read(b"".join(built.parts()), 0)
    asked = np.concatenate([rng.integers(0, universe + 5, 400).astype(np.uint64), values])
    for e in (built, read):
        assert (e.get(np.arange(n)) == values).all()
        assert (e.next_geq(asked) == np.searchsorted(values, asked)).all()
    if n > 500 and universe > 10**5:
        assert 8 * (built.low.nbytes + built.high.nbytes) < n * (math.log2(universe / n) + 4)


def test_trie_file(tmp_path):
    rng = np.random.default_rng(3)
    keys = np.unique((rng.integers(1, 40, 900).astype(np.uint64) << np.uint64(32)) | rng.integers(1, 60, 900).astype(np.uint64))
    context, successor = keys >> np.uint64(32), keys & np.uint64(0xFFFFFFFF)
    path = tmp_path / "t.trie"
    path.write_bytes(b"".join(elias_fano.Trie.parts(context, successor, np.arange(len(keys)))))
    trie = elias_fano.Trie.open(str(path))
    c, s = (x.ravel().astype(np.uint64) for x in np.meshgrid(np.arange(0, 45), np.arange(1, 65)))
    asked = (c << np.uint64(32)) | s
    want = np.where(np.isin(asked, keys), np.searchsorted(keys, asked), -1)
    assert (trie.find(c, s) == want).all()
    assert abs(elias_fano.restore(elias_fano.quantise(np.log10(np.array([1, 0.5, 1e-9])))) - np.log10([1, 0.5, 1e-9])).max() < 2e-4


def brute(rows, mu):
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    tokens = [(i, WORD.findall((t or "").translate(low)) + ["\n"]) for i, t in rows]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    train = [t for i, t in tokens if not held(i)]
    c = collections.Counter(w for t in train for w in t)
    pairs = collections.Counter(p for t in train for p in zip(["\n", *t], t))
    n, v = sum(c.values()), len(c)
    out = []
    for i, t in tokens:
        u = [(c[w] + 1) / (n + v + 1) for w in t]
        p = [pairs[a, b] / (c[a] + mu) + mu / (c[a] + mu) * x for a, b, x in zip(["\n", *t], t, u)]
        out.append((i, held(i), len(t), sum(c[w] > 0 for w in t), n, sum(map(math.log10, u)), sum(map(math.log10, p))))
    return out


def order(r):
    return (r[0] is not None, r[0] or 0, r[2], r[5])


def same(got, want):
    got, want = sorted(map(tuple, got), key=order), sorted(want, key=order)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    for g, w in zip(got, want):
        assert abs(g[5] - w[5]) < 1e-9 * max(1, abs(w[5])) and abs(g[6] - w[6]) < 2e-4 * w[2]


def test_odd_documents(spark, odd_docs, no_docs):
    rows = [tuple(r) for r in odd_docs.select("doc_id", "text").collect()]
    got = ngram_lm.lm_scores(odd_docs, id_crc(odd_docs["doc_id"]) % 7 != 2, mu=7.0)
    same(got.collect(), brute(rows, 7.0))
    assert ngram_lm.lm_scores(no_docs, id_crc(no_docs["doc_id"]) % 7 != 2).collect() == []


def test_query_over_several_blocks_beats_the_base(spark, sf_tiny, monkeypatch):
    docs = spark.read.parquet(f"{sf_tiny}/documents.parquet").select("doc_id", "text").repartition(5)
    got = ngram_lm.lm_scores(docs, id_crc(docs["doc_id"]) % 7 != 2).collect()
    same(got, brute([tuple(r) for r in docs.collect()], 300.0))
    held = [r for r in ngram_lm.op6_ngram_lm(spark, sf_tiny).collect() if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    from pyspark.sql import functions as F

    got = ngram_lm.lm_scores(docs, F.lit(False)).collect()
    assert sorted((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], r["score"]) for r in got) == [(1, 3, 0, 0, 0.0), (2, 1, 0, 0, 0.0)]


def brute_order(rows, mu, order):
    """As ``brute``, with contexts of up to ``order - 1`` words that do not reach over the start of the document."""
    base = brute(rows, mu)
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    docs = [["\n", *WORD.findall((t or "").translate(low)), "\n"] for _, t in rows]
    c = collections.Counter()  # n-grams
    as_context = collections.Counter()
    for d, (_, held, *_) in zip(docs, base):
        if not held:
            for i in range(1, len(d)):
                for n in range(1, order + 1):
                    if n == 1 or i - n + 1 >= 0:
                        c[tuple(d[i - n + 1 : i + 1])] += 1
                        as_context[tuple(d[i - n + 1 : i])] += 1
    n, v = as_context[()], sum(len(g) == 1 for g in c)
    out = []
    for d, b in zip(docs, base):
        score = 0.0
        for i in range(1, len(d)):
            p = (c[d[i],] + 1) / (n + v + 1)
            for size in range(1, order):
                if i - size >= 0:
                    h = tuple(d[i - size : i])
                    p = (c[(*h, d[i])] + mu * p) / (as_context[h] + mu)
            score += math.log10(p)
        out.append((*b[:6], score))
    return out


@pytest.mark.parametrize("order", [2, 3, 4])
def test_odd_documents_by_order(spark, odd_docs, no_docs, order):
    rows = [tuple(r) for r in odd_docs.select("doc_id", "text").collect()]
    train = id_crc(odd_docs["doc_id"]) % 7 != 2
    want = brute_order(rows, 7.0, order)
    if order == 2:
        same(brute(rows, 7.0), want)
    same(ngram_lm.lm_scores(odd_docs, train, mu=7.0, order=order).collect(), want)
    assert ngram_lm.lm_scores(no_docs, id_crc(no_docs["doc_id"]) % 7 != 2, order=order).collect() == []


def test_query_uses_two_words_of_context(spark, sf_tiny, monkeypatch):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_tiny}/documents.parquet").select("doc_id", "text").collect()]
    same(ngram_lm.op6_ngram_lm(spark, sf_tiny).collect(), brute_order(docs, 300.0, 3))


def test_the_second_word_of_context_counts(spark):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(1, "a x b"), (2, "c x d"), (3, "a x b"), (4, "c x d"), (5, "a x d"), (6, "c x b")], "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in ngram_lm.lm_scores(docs, F.col("doc_id") < 5, mu=1.0, order=3).collect()}
    assert got[1] > got[5] and got[2] > got[6]


def test_deeper_trie_levels(tmp_path):
    rng = np.random.default_rng(5)
    grams = np.unique(rng.integers(1, 9, (400, 4)), axis=0)
    levels, place = [], None
    for n in (2, 3, 4):
        found, like = np.unique(grams[:, :n], axis=0, return_inverse=True)
        parent = found[:, 0] if place is None else place[np.unique(grams[:, :n], axis=0, return_index=True)[1]]
        levels.append((parent.astype(np.uint64), found[:, -1].astype(np.uint64), np.arange(len(found))))
        place = like
    path = tmp_path / "d.trie"
    path.write_bytes(b"".join(elias_fano.Trie.parts(*levels[0], *levels[1:])))
    trie = elias_fano.Trie.open(str(path))
    asked = np.stack([x.ravel() for x in np.meshgrid(*[np.arange(1, 10)] * 4, indexing="ij")], 1).astype(np.uint64)
    at = trie.find(asked[:, 0], asked[:, 1])
    for n in (1, 2):
        at = trie.below(n, at, asked[:, n + 1])
        known = {tuple(g): k for k, g in enumerate(np.unique(grams[:, : n + 2], axis=0).tolist())}
        assert at.tolist() == [known.get(tuple(a), -1) for a in asked[:, : n + 2].tolist()]

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from mailsift.llm import simhash


def fingerprint(text, n=3):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    found = [b" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))]
    hashes = [xxhash.xxh64_intdigest(x, 42) for x in found]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(values, max_bits):
    """Smallest member of each group, by comparing all with all."""
    names = np.array(sorted(values), np.uint64)
    parent = list(range(len(names)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(names)):
        for j in np.flatnonzero(np.bitwise_count(names ^ names[i]) <= max_bits):
            a, b = find(i), find(int(j))
            parent[max(a, b)] = min(a, b)
    return {int(names[i]): find(i) for i in range(len(names))}


def test_fingerprints():
    rng = random.Random(2)
    texts = [" ".join(rng.choices(["A", "b", "é", "cc\t", "\x1c"], k=rng.randint(0, 30))) for _ in range(200)] + [None, "", " ", "x y z"]
    assert simhash.fingerprints(texts, 3).tolist() == [fingerprint(t) for t in texts]


def test_gray_ranks_follow_the_gray_sequence():
    n = np.arange(1 << 10, dtype=np.uint64)
    assert (simhash.gray_rank(n ^ (n >> np.uint64(1))) == n).all()


@pytest.mark.parametrize("frontier", [1 << 20, 64])
@pytest.mark.parametrize("max_bits", [0, 1, 2, 3])
def test_index_finds_exactly_the_near_ones(max_bits, frontier, monkeypatch):
    monkeypatch.setattr(simhash, "FRONTIER", frontier)
    rng = np.random.default_rng(max_bits)
    base = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    near = [base ^ (np.uint64(1) << rng.integers(0, 64, 60).astype(np.uint64)) for _ in range(3)]
    fps = np.unique(np.concatenate([base, *near, np.arange(70, dtype=np.uint64), [np.uint64(2**64 - 1)]]))
    got = set()
    for q, found in simhash.GrayIndex(fps).near(fps, max_bits):
        got |= {(int(fps[a]), int(b)) for a, b in zip(q, found)}
    distance = np.bitwise_count(fps[:, None] ^ fps[None, :])
    assert got == {(int(fps[i]), int(fps[j])) for i, j in zip(*np.nonzero(distance <= max_bits))}


def test_forest():
    forest = simhash.Forest(8)
    forest.link(np.array([7, 5, 3]), np.array([5, 3, 3]))
    forest.link(np.array([0, 1]), np.array([1, 6]))
    assert forest.root.tolist() == [0, 0, 2, 3, 4, 3, 0, 3]


def test_components_of_chains_stars_and_cycles(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 50)] + [(200, 201), (201, 202), (202, 200), (300, 300)]
    got = {r["fp"]: r["root"] for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    for members in (range(61), range(100, 150), (200, 201, 202)):
        assert {got.get(x, x) for x in members} == {min(members)}
    assert simhash.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_groups_over_ranges_equal_brute_force(spark):
    rng = np.random.default_rng(8)
    base = rng.integers(0, 1 << 63, 150, dtype=np.uint64)
    ball = [base[0] ^ (np.uint64(1) << np.uint64(a)) ^ (np.uint64(1) << np.uint64(b)) for a in range(20) for b in range(a)]
    chain = [int(base[1]) ^ ((1 << k) - 1) for k in range(0, 64, 2)]
    fps = sorted({*map(int, base), *map(int, ball), *chain, 0, 2**64 - 1})
    frame = spark.createDataFrame([(int(np.uint64(f).astype(np.int64)),) for f in fps], "fp long").repartition(3)
    signed = lambda f: int(np.array([f], np.uint64).view(np.int64)[0])
    got = {r["fp"]: r["root"] for r in simhash.near_groups(frame, 2).collect()}
    want = groups(fps, 2)
    by_got, by_want = {}, {}
    for f in fps:
        by_got.setdefault(got.get(signed(f), signed(f)), set()).add(f)
        by_want.setdefault(want[f], set()).add(f)
    assert sorted(map(sorted, by_got.values())) == sorted(map(sorted, by_want.values()))


def test_odd_documents(spark, odd_docs, no_docs):
    rows = odd_docs.select("doc_id", "text").collect()
    got = simhash.near_duplicates(odd_docs)
    assert got.columns == ["doc_id", "fingerprint", "component_id"]
    prints = {f: None for f in {fingerprint(r["text"]) for r in rows}}
    name = groups(prints, 2)
    least = {}
    for r in rows:
        if r["doc_id"] is not None:
            g = name[fingerprint(r["text"])]
            least[g] = min(least.get(g, r["doc_id"]), r["doc_id"])
    want = [(r["doc_id"], f"{fingerprint(r['text']):016x}", least[name[fingerprint(r["text"])]]) for r in rows]
    key = lambda r: (r[0] is not None, r[0] or 0, r[1])
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)
    assert simhash.near_duplicates(no_docs).collect() == []
    kept = simhash.one_of_each_group(odd_docs)
    assert kept.schema == odd_docs.schema
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(least.values())
    assert simhash.one_of_each_group(no_docs).count() == 0


def test_groups_without_ids_and_equal_rows_keep_one(spark):
    rows = [(None, "alpha beta gamma"), (None, "alpha beta gamma"), (5, "other words here"), (5, "other words here"), (5, "nothing alike at all"), (2, "Other words here")]
    docs = spark.createDataFrame([(*r, "s") for r in rows], "doc_id long, text string, source string")
    got = sorted((r["doc_id"] or 0, r["text"]) for r in simhash.one_of_each_group(docs).collect())
    assert got == [(0, "alpha beta gamma"), (2, "Other words here"), (5, "nothing alike at all")]
    assert {r["component_id"] for r in simhash.near_duplicates(docs).filter(F.col("doc_id").isNull()).collect()} == {None}


def test_query_equals_all_pairs(spark, sf_tiny):
    rows = simhash.op8_simhash_near_dedup(spark, sf_tiny).collect()
    name = groups({int(r["fingerprint"], 16) for r in rows}, 2)
    least = {}
    for r in rows:
        g = name[int(r["fingerprint"], 16)]
        least[g] = min(least.get(g, r["doc_id"]), r["doc_id"])
    assert all(r["component_id"] == least[name[int(r["fingerprint"], 16)]] for r in rows)
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_tiny}/documents.parquet").limit(40).collect()}
    assert all(r["fingerprint"] == f"{fingerprint(texts[r['doc_id']]):016x}" for r in rows if r["doc_id"] in texts)

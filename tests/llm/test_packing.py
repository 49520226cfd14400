import collections
import random

from pyspark.sql import functions as F

from mailsift.llm import packing


def naive(sizes, capacities):
    bins, where = [], []
    for n, s in enumerate(sizes):
        fits = [(b["room"], -b["used"], i) for i, b in enumerate(bins) if b["room"] >= s]
        if fits:
            i = min(fits)[2]
        else:
            rest = sizes[n + 1 :]
            expected = {c: min(c, s + sum(x for x in rest if x <= min(s, c - s))) for c in capacities if c >= s}
            c = min(expected, key=lambda c: (packing.cost(c) / expected[c], c))
            bins.append({"room": c, "fill": 0})
            i = len(bins) - 1
        bins[i] |= {"room": bins[i]["room"] - s, "fill": bins[i]["fill"] + s, "used": n + 1}
        where.append(i)
    return where, [min(c for c in capacities if c >= b["fill"]) for b in bins]


def test_pack_equals_a_plain_version():
    rng = random.Random(1)
    for _ in range(400):
        capacities = tuple(sorted(rng.sample(range(4, 40), rng.randint(1, 4))))
        sizes = sorted((rng.randint(1, max(capacities)) for _ in range(rng.randint(0, 40))), reverse=True)
        where, place, final = packing.pack(sizes, capacities)
        assert (where, final) == naive(sizes, capacities)
        fill = collections.Counter()
        for s, b, p in zip(sizes, where, place):
            assert p == fill[b]
            fill[b] += s
        assert all(fill[b] <= c for b, c in enumerate(final))


def check(rows, lengths, capacities):
    """Every token of every row is in one place, and bins are as short as they can be."""
    docs, bins = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        docs[r["doc_id"]].append((r["start"], r["n_tokens"]))
        bins[r["bin_id"]].append((r["bin_offset"], r["n_tokens"], r["capacity"]))
    want = collections.defaultdict(list)
    for i, n in lengths:
        want[i] += [(a, min(max(capacities), n - a)) for a in range(0, n, max(capacities))]
    assert {i: sorted(v) for i, v in docs.items()} == {i: sorted(v) for i, v in want.items()}
    for pieces in bins.values():
        at = 0
        for offset, n, _ in sorted(pieces):
            assert offset == at
            at += n
        assert {c for _, _, c in pieces} == {min(c for c in capacities if c >= at)}


def test_odd_documents(spark, odd_docs, no_docs):
    rows = odd_docs.select("doc_id", "text").collect()
    lengths = [(r["doc_id"], len((r["text"] or "").encode().split()) + 1) for r in rows]
    for capacities, group in (((512, 1024, 4096), 20_000), ((3, 8), 700)):
        got = packing.best_fit(odd_docs, capacities=capacities, group_pieces=group).collect()
        check(got, lengths, capacities)
    assert packing.best_fit(no_docs).collect() == []


def test_given_lengths_and_many_equal_rows(spark):
    docs = spark.range(5).select(F.lit(7).alias("doc_id"), F.lit("t").alias("text"), (F.col("id") - 1).alias("n"))
    got = packing.best_fit(docs, length=docs["n"], capacities=(4, 8)).collect()
    assert sorted(r["n_tokens"] for r in got) == [1, 1, 1, 2, 3]
    same = spark.range(3000).select(F.lit(1).alias("doc_id"), F.lit("a b").alias("text"))
    got = packing.best_fit(same, capacities=(4, 16), group_pieces=100)
    assert got.count() == 3000
    groups = [r["count"] for r in got.groupBy(F.shiftright("bin_id", 32)).count().collect()]
    assert len(groups) > 25 and max(groups) < 200


def test_query_fills_its_sequences(spark, sf_tiny):
    got = packing.op3_best_fit_packing(spark, sf_tiny).collect()
    docs = spark.read.parquet(f"{sf_tiny}/documents.parquet").collect()
    check(got, [(r["doc_id"], len(r["text"].encode().split()) + 1) for r in docs], packing.CAPACITIES)
    room = sum({r["bin_id"]: r["capacity"] for r in got}.values())
    assert sum(r["n_tokens"] for r in got) > 0.9 * room

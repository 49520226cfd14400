import collections

import corpus_pipeline as pipeline
from mailsift.llm import decontamination, quality, simhash, toxicity
from mailsift.llm.common import stage


def test_stages_and_registration():
    import __spark_entry__ as entry

    assert [n for n, _ in pipeline.STAGES] == ["quality_rules", "toxicity", "simhash_near_dedup", "benchmark_decontamination", "best_fit_packing"]
    names = entry.queries()
    assert names["pipeline"] is pipeline.run
    for n in range(1, 11):
        assert sum(k.startswith(f"op{n}_") for k in names) == 1


def test_pipeline_equals_brute_force(spark, sf_tiny):
    """Each stage against a plain version over the stage's own input."""
    docs = spark.read.parquet(f"{sf_tiny}/documents.parquet")
    columns, rows = docs.columns, {r["doc_id"]: r for r in docs.collect()}
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_tiny}/benchmark.parquet").collect()]
    for name, step in pipeline.STAGES[:-1]:
        before = dict(rows)
        model = toxicity.train(docs, spark.read.parquet(f"{sf_tiny}/labels.parquet")) if name == "toxicity" else None
        docs = stage(spark, step(spark, docs, sf_tiny), f"test-{name}")
        assert docs.columns == columns
        rows = {r["doc_id"]: r for r in docs.collect()}
        assert all(rows[i] == before[i] for i in rows) and len(rows) == docs.count()
        if name == "quality_rules":
            base = {i for i, r in before.items() if (m := quality.measure(r["text"]))[0] >= 50 and 100 * m[5] <= 50 * m[0]}
            assert set(rows) == base  # no host of these tables is rejected
        elif name == "toxicity":
            automata = model.automata()
            assert set(rows) == {i for i, r in before.items() if model.score(model.features(automata, r["text"])) < 0.7}
        elif name == "simhash_near_dedup":
            prints = dict(zip(before, simhash.fingerprints([r["text"] for r in before.values()], 3).tolist()))
            parent = {i: i for i in before}

            def find(x):
                while parent[x] != x:
                    x = parent[x]
                return x

            ids = sorted(before)
            for a in ids:
                for b in ids:
                    if a < b and (prints[a] ^ prints[b]).bit_count() <= 2:
                        x, y = find(a), find(b)
                        parent[max(x, y)] = min(x, y)
            assert set(rows) == {find(i) for i in ids}
        else:
            texts = [decontamination.normal(t) for _, t in items]
            gone = {i for i, r in before.items() if any(t in decontamination.normal(r["text"]) for t in texts)}
            assert not gone & set(rows) and len(before) - len(rows) <= len(gone) + 2
    packed = pipeline.run(spark, sf_tiny).collect()
    tokens = collections.Counter()
    for r in packed:
        tokens[r["doc_id"]] += r["n_tokens"]
    assert tokens == {i: len(r["text"].encode().split()) + 1 for i, r in rows.items()}


def test_odd_and_empty_documents_pass_every_stage(spark, sf_tiny, odd_docs, no_docs):
    for docs in (odd_docs, no_docs):
        for name, step in pipeline.STAGES:
            out = step(spark, docs, sf_tiny)
            assert out.columns == docs.columns or name == "best_fit_packing"
            assert out.count() <= docs.count() + 100

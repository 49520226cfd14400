import random

from mailsift.llm import decontamination as d


def fewest_edits(item, text):
    row = [0] * (len(text) + 1)
    for a in range(1, len(item) + 1):
        new = [a]
        for b in range(1, len(text) + 1):
            new.append(min(row[b] + 1, new[-1] + 1, row[b - 1] + (item[a - 1] != text[b - 1])))
        row = new
    return min(row)


def change(rng, text, edits):
    text = list(text)
    for _ in range(edits):
        i = rng.randrange(len(text))
        kind = rng.random()
        if kind < 0.33 and len(text) > 1:
            del text[i]
        elif kind < 0.66:
            text.insert(i, rng.choice("abcdé "))
        else:
            text[i] = rng.choice("abcdé")
    return "".join(text)


def test_matches_equal_brute_force(monkeypatch):
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abcdé", k=rng.randint(1, 6)))
    items = [(i, " ".join(word() for _ in range(rng.randint(1, 20)))) for i in range(25)] + [(99, ""), (98, "  ,. "), (97, "a a a a a a a a a a")]
    texts = []
    for _ in range(200):
        parts = [" ".join(word() for _ in range(rng.randint(0, 15)))]
        for _ in range(rng.randint(0, 2)):
            text = rng.choice(items)[1] or "x"
            parts += [change(rng, text.upper() if rng.random() < 0.3 else text, rng.randint(0, 8)), " ".join(word() for _ in range(rng.randint(0, 6)))]
        texts.append(rng.choice([" ", ". ", "\n"]).join(parts))
    texts += [None, "", " ", "a " * 300]
    for q, share, chunk in ((8, 0.1, 1 << 20), (5, 0.15, 300), (10, 0.08, 1 << 20)):
        monkeypatch.setattr(d, "CHUNK_CHARS", chunk)
        monkeypatch.setattr(d, "PAIRS", 50 if chunk == 300 else 1 << 21)
        table = d.Items(items, q, share)
        assert (table.bound > 0).all()
        found = 0
        for text, got in zip(texts, d.matches(table, texts)):
            norm = d.normal(text or "")
            want = {i: e for i, t, b in zip(table.ids, table.texts, table.budget) if (e := fewest_edits(t, norm)) <= b}
            assert {m[0]: m[1] for m in got} == want
            found += len(want)
            for i, edits, start, end in got:
                assert fewest_edits(d.normal(text[start:end]), d.normal(text)) == 0
                if not edits:
                    assert dict(zip(table.ids, table.texts))[i] in d.normal(text[start:end])
        assert found > 20


def test_repetitive_texts_stay_cheap():
    """Long runs of a pattern that items hold too: bounded pairs, and equal windows are aligned once."""
    import time

    items = d.Items([(1, "a" * 120 + " and then something else entirely follows here " + "b" * 40), (2, "the " * 30 + "end of it all and some more words"), (3, "z" * 90)], 8, 0.1)
    texts = ["a" * 300_000, "the " * 60_000, "z" * 200_000, "x " + "the " * 500 + "end of it all and some more words"]
    t0 = time.perf_counter()
    got = [{m[0] for m in row} for row in d.matches(items, texts)]
    assert got == [set(), set(), {3}, {2}] and time.perf_counter() - t0 < 60


def test_odd_documents(spark, odd_docs, no_docs, monkeypatch):
    benchmark = spark.createDataFrame(
        [(1, "we'll don't 12345 end", "x"), (1, "we'll don't 12345 end", "x"), (2, None, "x"), (3, "", "x"), (None, "café straße ΑΒΓ дом 漢字", "y"), (4, "word0 of0 word1 of1 word2 of2", "z")],
        "item_id long, text string, source string",
    )
    monkeypatch.setattr(d, "BLOCK_CHARS", 10)  # several blocks
    docs = odd_docs.drop("benchmark_matches")
    got = d.decontaminate(docs, benchmark)
    assert got.columns == [*docs.columns, "benchmark_matches"]
    hits = {}
    for r in got.collect():
        for m in r["benchmark_matches"]:
            hits.setdefault(m.item_id, set()).add(r["doc_id"])
            assert m.edits == 0 and 0 <= m.start < m.end <= len(r["text"])
    assert hits == {1: {12, 112}, None: {10, 110}, 4: {8, 9, 108, 109}}
    clean = d.uncontaminated(odd_docs, benchmark)
    assert clean.schema == odd_docs.schema
    assert clean.count() == odd_docs.count() - 8
    assert d.uncontaminated(no_docs, benchmark).count() == 0
    assert d.uncontaminated(odd_docs, benchmark.limit(0)).count() == odd_docs.count()


def test_query_finds_planted_items(spark, sf_tiny):
    got = {r["doc_id"]: r for r in d.op7_decontamination(spark, sf_tiny).collect()}
    items = {r["item_id"]: d.normal(r["text"]) for r in spark.read.parquet(f"{sf_tiny}/benchmark.parquet").collect()}
    docs = spark.read.parquet(f"{sf_tiny}/documents.parquet").collect()
    assert set(got) == {r["doc_id"] for r in docs}
    for r in docs:
        norm = d.normal(r["text"])
        held = {i for i, t in items.items() if t in norm}
        assert held <= set(got[r["doc_id"]]["item_ids"])
        assert got[r["doc_id"]]["contaminated"] == bool(got[r["doc_id"]]["item_ids"])


def test_short_items_have_the_full_budget():
    items = [(1, "猫が好き"), (2, "Cat!"), (3, "abcdefghijkl"), (4, "x" * 10 + "y" * 11), (5, "one two three four five six se"), (6, " .")]
    table = d.Items(items, 8, 0.1)
    assert table.ids == [1, 2, 3, 4, 5] and table.budget.tolist() == [0, 0, 1, 2, 3] and (table.bound > 0).all()
    texts = ["昨日も猫が好き。", "a cat", "abcdeXghijkl", "abcdeXgXijkl", "x" * 9 + "y" * 10, "x" * 8 + "y" * 10, "ca t", "one two threX four fiXe six se"]
    got = [[(m[0], m[1]) for m in row] for row in d.matches(table, texts)]
    assert got == [[(1, 0)], [(2, 0)], [(3, 1)], [], [(4, 2)], [], [], [(5, 2)]]


def test_short_items_equal_brute_force():
    rng = random.Random(9)
    items = [(n, "".join(rng.choices("abc", k=n))) for n in range(1, 33)]
    table = d.Items(items, 8, 0.1)
    assert table.ids == list(range(1, 33)) and table.budget.tolist() == [n // 10 for n in range(1, 33)]
    texts = ["".join(rng.choices("abc ", k=rng.randint(0, 30))) + change(rng, rng.choice(items)[1], rng.randint(0, 4)) for _ in range(80)]
    for text, got in zip(texts, d.matches(table, texts)):
        norm = d.normal(text)
        assert {m[0]: m[1] for m in got} == {i: e for i, t in items if (e := fewest_edits(t, norm)) <= i // 10}

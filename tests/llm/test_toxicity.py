import pytest

from mailsift.llm import toxicity


@pytest.fixture(scope="module")
def labelled(spark):
    clean = "the river runs past the old mill and the quiet town in spring number{}"
    bad = "you are such a {} zorgface and everybody knows it"
    docs, labels = [], []
    for i in range(400):
        toxic = i % 4 == 0
        word = ("blimp", "snark", "grub")[i % 3]
        docs.append((i, bad.format(word) if toxic else clean.format(i)))
        labels.append((i, int(toxic), 1))
    docs += [(1000, None), (1001, ""), (None, "zorgface")]
    labels += [(3, None, 1), (2, 1, 0), (None, 1, 0), (9999, 1, 1)]
    return (spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int, quality int"))


def test_folding():
    for text in ("IDIOT", "1d10t", "idiоt", "i​diot", "ｉｄｉｏｔ"):
        assert toxicity.fold(text).split() == ["idiot"], text
    assert toxicity.bare(toxicity.fold("ïdîöt")).split() == ["idiot"]
    assert toxicity.fold("a-b, c").split() == ["a", "b", "c"]
    assert toxicity.fold("").split() == []


def test_held_out_documents_and_obfuscation(spark, labelled):
    docs, labels = labelled
    model = toxicity.train(docs, labels)
    assert any("zorg" in e for e in model.weights)
    a = model.automata()
    score = lambda t: model.score(model.features(a, t))
    assert score("you are such a Z0RGFACE") >= 0.7 and score("such a zörgface!, you") >= 0.7
    assert score("the mill in spring") < 0.1 and score(None) == score("") < 0.1
    got = {r["doc_id"]: r["toxicity"] for r in toxicity.toxicity(docs, model).collect() if r["doc_id"] is not None}
    assert all(got[i].toxic == (i % 4 == 0) for i in range(400) if i != 2)
    assert toxicity.clean_documents(docs, model).columns == docs.columns
    # ids with crc32 mod 3 = 1 are never learned from
    held = docs.filter(toxicity.id_crc(docs["doc_id"]) % 3 == 1)
    assert toxicity.labelled_sample(held, labels, 1000).count() == 0


def test_length_and_exceptions():
    model = toxicity.Model({" clown ": 5.0, " scum": 4.0}, {" clown ": 5.0}, ("class clown",), (-4.0, 1.0, 2.0))
    a = model.automata()
    short, long = model.features(a, "a clown"), model.features(a, "a clown " + "word " * 500)
    assert short[0] == long[0] and short[1] > long[1] > 0
    assert model.features(a, "the class clown laughs") == (0.0, 0.0)
    assert model.features(a, "clowns") == (0.0, 0.0) and model.features(a, "scummy")[0] > 0
    assert model.features(a, "scum scum")[0] > model.features(a, "scum x")[0]


def test_without_labels_and_odd_tables(spark, odd_docs, no_docs, labelled):
    none = spark.createDataFrame([], labelled[1].schema)
    model = toxicity.train(odd_docs, none)
    rows = toxicity.toxicity(odd_docs.drop("toxicity"), model).collect()
    assert len(rows) == odd_docs.count() and {r["toxicity"].score for r in rows} == {0.0}
    got = toxicity.clean_documents(odd_docs, model)
    assert got.schema == odd_docs.schema and got.count() == odd_docs.count()
    model = toxicity.train(*labelled)
    assert toxicity.clean_documents(no_docs, model).count() == 0


def test_query_accuracy(spark, sf_tiny):
    rows = toxicity.op10_toxicity(spark, sf_tiny).collect()
    docs = spark.read.parquet(f"{sf_tiny}/documents.parquet")
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert all(r["predicted"] == (r["score"] >= 0.7) for r in rows)
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()}
    rows = [r for r in toxicity.op10_toxicity(spark, "/root/testdata/sf0.1").collect() if r["held_out"] and r["doc_id"] in labels]
    toxic = [r for r in rows if labels[r["doc_id"]]]
    assert sum(r["predicted"] for r in toxic) >= 0.85 * len(toxic)
    assert sum(r["predicted"] for r in rows if not labels[r["doc_id"]]) <= 0.01 * len(rows)


def plain_weight(weights, exceptions, folded):
    """Every entry and phrase looked for at every place."""
    spared = [(i, i + len(p) - 1) for e in exceptions for p in [toxicity.fold(e)] for i in range(len(folded)) if folded.startswith(p, i)]
    total = 0.0
    for i in range(len(folded)):
        hits = [w for e, w in weights.items() if folded.startswith(e, i)]
        if hits and not any(a <= i < b for a, b in spared):
            total += max(hits)
    return total


def test_matching_equals_a_plain_search():
    import random

    rng = random.Random(4)
    words = ["ab", "abc", "abcd", "b", "ba", "cab", "d"]
    for _ in range(300):
        weights = {f" {w}{rng.choice(['', ' '])}": float(rng.randint(1, 9)) for w in rng.sample(words, 4)}
        exceptions = tuple(" ".join(rng.choices(words, k=rng.randint(1, 3))) for _ in range(3))
        automaton = toxicity.Model(weights, {}, exceptions, None).automata()[0]
        folded = toxicity.fold(" ".join(rng.choices(words, k=rng.randint(0, 25))))
        assert toxicity.weigh(automaton, folded) == plain_weight(weights, exceptions, folded), (weights, exceptions, folded)


def test_exceptions_hold_whatever_stands_between_their_words():
    model = toxicity.Model({" clown ": 5.0}, {" clown ": 5.0}, ("class clown",), (-4.0, 1.0, 2.0))
    a = model.automata()
    for text in ("class clown", "class  clown", "class, clown", "Class -\n clown!", "cl​ass clown"):
        assert model.features(a, text) == (0.0, 0.0), text
    assert model.features(a, "class of clown")[0] > 0


def test_many_matches_and_phrases_in_linear_time():
    import time

    model = toxicity.Model({" clown ": 5.0}, {}, ("class clown", "clown class"), None)
    a = model.automata()
    began = time.process_time()
    assert model.features(a, "class clown " * 60_000) == (0.0, 0.0)
    assert model.features(a, "clown x " * 60_000)[0] > 0
    assert time.process_time() - began < 4


def test_copies_with_different_labels_are_toxic(spark):
    docs = spark.createDataFrame([(i, "same text") for i in range(40)] + [(100 + i, f"text {i}") for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i == 7 or i == 8 or i == 9)) for i in range(40)] + [(100 + i, 0) for i in range(40)], "doc_id long, toxic int")
    sample = toxicity.labelled_sample(docs, labels, 1000).collect()
    assert [r["toxic"] for r in sample if r["text"] == "same text"] == [1]

import pytest

#: Texts that trip operators up: null, empty, white space only, ties, copies, long, odd characters.
LONG = " ".join(f"word{i % 977} of{i % 13}" for i in range(40_000))
TEXTS = [
    None, "", " \t\n\x0b\x0c\r ", "one", "One two", "one two three", "ONE two\tthree", "x" * 50_000, LONG, LONG,
    "naïve  café — straße ΑΒΓ дом 漢字 \U0001f600\U0001f600 é ՘꟏", "<|endoftext|> in <|endoftext|>text<|endoftext|>",
    "it's   we'll\n\n\n don't  12345 $%^ \x1c\x1d\x85 end ", "a b c a b c a b c", "line\nline\n\nline\n line",
]


@pytest.fixture(scope="session")
def odd_texts():
    return TEXTS


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Every odd text twice under other ids, a null id, an id used twice, and columns with the
    names that operators use inside."""
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(100 + i, t) for i, t in enumerate(TEXTS)]
    rows += [(None, "one two three"), (None, None), (7, "again seven"), (7, "again seven"), (-5, "minus")]
    return spark.createDataFrame(
        [(i, t, "en", None if i is None else f"src{i % 3}", 0, 1.5, "z", 9, 8, True) for i, t in rows],
        "doc_id long, text string, lang string, source string, n_chars long, quality double, toxicity string, c0 int, k0 int, "
        "benchmark_matches boolean",
    )


@pytest.fixture(scope="session")
def no_docs(spark, odd_docs):
    return spark.createDataFrame([], odd_docs.schema)


@pytest.fixture(scope="session")
def sf_tiny():
    return "/root/testdata/sf0.001"

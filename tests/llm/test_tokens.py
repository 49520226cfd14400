import random
import struct
import sys
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from mailsift.llm import blocks, pretoken, token_counts, token_shards

@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(pretoken.default_path())


def ids_of(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids


def test_split_is_the_library_s_on_every_character(tokenizer):
    splitter = pretoken.Splitter(pretoken.default_path())
    codes = [c for c in range(sys.maxunicode + 1) if not 0xD800 <= c <= 0xDFFF]
    for i in range(0, len(codes), 4000):
        part = [chr(c) for c in codes[i : i + 4000]]
        for text in ("".join(f"a{c}{c}1 {c}b. " for c in part), " ".join(part)):
            want = [text[a:b] for _, (a, b) in tokenizer.pre_tokenizer.pre_tokenize_str(text)]
            assert splitter.split(text) == want
    small = [chr(c) for c in range(0x250) if not 0x1C <= c <= 0x1F]
    for text in ("".join(f"a{c}{c}1 {c}b. {c}" for c in small), *(f"x {a}{b}'s {b}{a} " for a in small for b in small[::7])):
        want = [text[a:b] for _, (a, b) in tokenizer.pre_tokenizer.pre_tokenize_str(text)]
        assert pretoken.SMALL.fullmatch(text) and splitter.split(text) == want


def test_pieces_give_the_library_s_ids(tokenizer, odd_texts):
    rng = random.Random(5)
    splitter = pretoken.Splitter(pretoken.default_path())
    pieces = pretoken.PieceIds(splitter, 2)
    texts = [t for t in odd_texts if t] + ["".join(rng.choices("ab 1'sé\n\t.<|endoftext|>", k=rng.randint(0, 40))) for _ in range(800)]
    for text in texts:
        want = ids_of(tokenizer, text)
        assert np.frombuffer(pieces.encode(text), "<u2").tolist() == want
        assert [i for p in splitter.split(text) for i in splitter.ids(p)] == want


def test_other_tokenizers_are_refused():
    import public_tokenizers

    with pytest.raises(ValueError):
        pretoken.Splitter(public_tokenizers.path("word_bpe_49k.json"))


def test_packed_blocks_round_trip():
    rng = np.random.default_rng(2)
    for n in (0, 1, 5, 1000):
        a = rng.integers(0, 1 << 32, n, dtype=np.uint64)
        assert (blocks.unpack(blocks.pack(a)) == a).all() and (blocks.unpack64(blocks.pack64(a * a)) == a * a).all()
        items = [bytes(rng.integers(0, 256, int(k), dtype=np.uint8)) for k in rng.integers(0, 9, n)]
        assert blocks.unpack_items(blocks.pack_items(items)).to_pylist() == items
    runs = np.array([3, 0, 0, 4, 1, 0])
    v = rng.integers(0, 1 << 32, 8, dtype=np.uint64).astype(np.uint32)
    assert (blocks.unsteps(blocks.steps(v, runs), runs) == v).all()
    renumber, parts = blocks.by_shard([b"a", b"bb", b"c", b"d"], 3)
    order = [x for _, p in sorted(parts) for x in p]
    assert [order[renumber[i]] for i in range(4)] == [b"a", b"bb", b"c", b"d"]
    assert blocks.sums(np.array([1, 2, 3]), np.array([0, 2, 0, 1])).tolist() == [0, 3, 0, 3]


def test_counts_of_odd_documents(spark, odd_docs, no_docs, tokenizer):
    got = token_counts.token_counts(odd_docs)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens"]
    key = lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])
    want = sorted(((i, len((t or "").encode()), len(ids_of(tokenizer, t))) for i, t in odd_docs.select("doc_id", "text").collect()), key=key)
    assert sorted(map(tuple, got.collect()), key=key) == want
    assert token_counts.token_counts(no_docs).collect() == []


def test_counts_over_many_small_blocks(spark, sf_tiny, tokenizer, monkeypatch):
    docs = spark.read.parquet(f"{sf_tiny}/documents.parquet").repartition(7)
    got = {r["doc_id"]: r["n_tokens"] for r in token_counts.token_counts(docs).collect()}
    assert got == {r["doc_id"]: len(ids_of(tokenizer, r["text"])) for r in docs.collect()}


def test_perfect_hash():
    rng = random.Random(1)
    for n in (0, 1, 2, 100, 5000):
        keys = [struct.pack("<q", k) for k in rng.sample(range(-(10**9), 10**9), n)]
        f, slots = token_shards.PerfectHash.build(keys)
        assert sorted(slots.tolist()) == list(range(n))
        assert [f.slot(k) for k in keys] == slots.tolist()


def test_index_file_finds_keys_and_knows_strangers(tmp_path):
    keys = [struct.pack("<q", k) for k in range(3000)]
    rows = np.zeros(len(keys), token_shards.SLOT)
    rows["fingerprint"] = [token_shards.fingerprint(k) for k in keys]
    rows["first"] = range(len(keys))
    path = tmp_path / "x.mph"
    path.write_bytes(b"".join(token_shards.index_bytes(keys, rows)))
    index = token_shards.Index(str(path))
    assert [int(index.get(k)["first"]) for k in keys] == list(range(3000))
    strangers = sum(index.get(struct.pack("<q", k)) is not None for k in range(10_000, 40_000))
    assert strangers <= 1
    (tmp_path / "bad").write_bytes(b"not an index")
    with pytest.raises(ValueError):
        token_shards.Index(str(tmp_path / "bad"))


def test_shards_of_odd_documents(spark, odd_docs, no_docs, tokenizer):
    store = token_shards.write_tokens(odd_docs, shards=3)
    got = token_shards.read_tokens(store, odd_docs.select("doc_id")).collect()
    rows = odd_docs.select("doc_id", "text").collect()
    assert len(got) == len(rows)
    payload = lambda t: np.array(ids_of(tokenizer, t) + [0], "<u2").tobytes()
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0, bytes(r["payload"])) for r in got) == sorted(
        (i is not None, i or 0, payload(t)) for i, t in rows
    )
    ordered = sorted(got, key=lambda r: r["start"])
    at = 0
    for r in ordered:
        assert r["start"] == at and r["n_tokens"] * 2 == len(r["payload"])
        at += r["n_tokens"]
    ids = [r["doc_id"] for r in ordered]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))
    some = spark.createDataFrame([(3,), (3,), (12345,), (None,)], "doc_id long")
    assert sorted(r["doc_id"] or -1 for r in token_shards.read_tokens(store, some).collect()) == [-1, -1, 3]
    empty = token_shards.write_tokens(no_docs)
    assert token_shards.read_tokens(empty, odd_docs).collect() == [] and empty.shards(spark).count() == 0


def test_query_equals_direct_encoding(spark, sf_tiny, tokenizer):
    docs = spark.read.parquet(f"{sf_tiny}/documents.parquet").orderBy("doc_id").collect()
    at, want = 0, []
    for r in docs:
        ids = ids_of(tokenizer, r["text"]) + [0]
        want.append((r["doc_id"], at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(map(tuple, token_shards.op1_token_shards(spark, sf_tiny).collect())) == want


def test_lost_attempts_leave_no_trace(spark, tmp_path):
    """Files that no committed row names are not read."""
    docs = spark.range(20).select(F.col("id").alias("doc_id"), F.lit("some text").alias("text"))
    store = token_shards.write_tokens(docs, shards=2, folder=f"{tmp_path}/t")
    (tmp_path / "t/ids/shard-00000-orphan.ids").write_bytes(b"broken")
    (tmp_path / "t/index/bucket-00000-orphan.mph").write_bytes(b"broken")
    assert token_shards.read_tokens(store, docs).count() == 20

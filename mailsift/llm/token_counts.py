"""Token counts from pre-token frequencies.

The pieces of a byte-level BPE text are the pieces of its pre-tokens, so a
document's token count is the sum over its distinct pre-tokens of frequency
times pieces. Documents are read once and reduced to pre-token frequencies
(numbers into a block dictionary); every distinct pre-token is tokenized once
by the shard that owns it; the counts are joined to the frequencies by block.
No token ids of documents are made, and no text is shuffled.

Null texts count as empty: 0 bytes, 0 tokens. Very long texts are counted whole. Strings of special tokens inside a
text are what the library makes of them by default (one token). Rows with equal
or null ids are counted one by one. An empty table gives an empty result. Only
the id and text columns are read, so other columns may have any name.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import blocks, pretoken
from .common import partitions, prepare, shards_for, stage, table

FREQUENCIES = (
    "block bigint, doc_id array<bigint>, n_bytes array<bigint>, n_distinct array<int>, number binary, frequency binary, "
    "chunks array<struct<shard: int, items: binary>>"
)

def _frequencies(tokenizer: str, shards: int):
    def run(batches):
        splitter = pretoken.Splitter(tokenizer)
        for k, block in enumerate(blocks.batches_to_blocks(batches, lambda b: b.column("text").nbytes)):
            known = blocks.Numbers()
            ids, sizes, counts, numbers, frequencies = [], [], [], [], []
            for b in block:
                ids += b.column("doc_id").to_pylist()
                sizes += pc.binary_length(b.column("text")).fill_null(0).to_pylist()
                for text in b.column("text").to_pylist():
                    found = Counter(splitter.split(text)) if text else {}
                    counts.append(len(found))
                    numbers.append(np.fromiter(map(known.__getitem__, found), np.uint32, len(found)))
                    frequencies.append(np.fromiter(found.values(), np.uint32, len(found)))
            renumber, parts = blocks.by_shard([x.encode() for x in known], shards)
            order = [np.argsort(n) for n in (renumber[x] for x in numbers)]
            number = np.concatenate([renumber[x][o] for x, o in zip(numbers, order)])
            frequency = np.concatenate([x[o] for x, o in zip(frequencies, order)])
            yield pa.RecordBatch.from_pydict({
                "block": pa.array([blocks.number_of_block(k)], pa.int64()),
                "doc_id": pa.array([ids], pa.list_(pa.int64())),
                "n_bytes": pa.array([sizes], pa.list_(pa.int64())),
                "n_distinct": pa.array([counts], pa.list_(pa.int32())),
                "number": pa.array([blocks.pack(blocks.steps(number, np.asarray(counts)))], pa.binary()),
                "frequency": pa.array([blocks.pack(frequency)], pa.binary()),
                "chunks": pa.array(
                    [[{"shard": s, "items": blocks.pack_items(x)} for s, x in parts]],
                    pa.list_(pa.struct([("shard", pa.int32()), ("items", pa.binary())])),
                ),
            })

    return run


def _pieces(tokenizer: str):
    """For a shard: pieces of each distinct pre-token, counted once, as one packed row per block."""

    def run(chunks: pa.Table) -> pa.Table:
        splitter = pretoken.Splitter(tokenizer)
        parts = [blocks.unpack_items(x) for x in chunks.column("items").to_pylist()]
        names, like = blocks.distinct(pa.concat_arrays(parts))
        pieces = np.fromiter((len(splitter.ids(x.decode())) for x in names.to_pylist()), np.uint32, len(names))
        at = blocks.offsets(np.array([len(x) for x in parts]))
        packed = [blocks.pack(pieces[like[a:b]]) for a, b in zip(at, at[1:])]
        return pa.table({"block": chunks.column("block"), "shard": chunks.column("shard"), "pieces": pa.array(packed, pa.binary())})

    return run


def _totals(batches):
    for b in batches:
        for i in range(b.num_rows):
            row = b.slice(i, 1).to_pylist()[0]
            answers = sorted(row["answers"] or [], key=lambda x: x["shard"])
            pieces = np.concatenate([np.empty(0, np.uint32), *[blocks.unpack(x["pieces"]) for x in answers]])
            runs = np.asarray(row["n_distinct"], np.int64)
            number = blocks.unsteps(blocks.unpack(row["number"]), runs)
            products = pieces[number].astype(np.int64) * blocks.unpack(row["frequency"])
            yield pa.RecordBatch.from_pydict({
                "doc_id": pa.array(row["doc_id"], pa.int64()),
                "n_bytes": pa.array(row["n_bytes"], pa.int64()),
                "n_tokens": pa.array(blocks.sums(products, runs), pa.int64()),
            })


#: Text for which there is one shard of pre-tokens.
SHARD_BYTES = 16 << 20


def token_counts(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", tokenizer: str | None = None) -> DataFrame:
    """``doc_id, n_bytes, n_tokens`` for every row of ``docs``.

    ``tokenizer`` is the path of a byte-level BPE ``.json`` file that tasks can
    open (the same path on every machine); others raise ``ValueError``.
    """
    spark = docs.sparkSession
    prepare(spark)
    tokenizer = tokenizer or pretoken.default_path()
    pretoken.Splitter(tokenizer)
    shards = shards_for(docs, text, SHARD_BYTES, 2 * partitions(spark))
    narrow = docs.select(docs[doc_id].cast("bigint").alias("doc_id"), docs[text].cast("string").alias("text"))
    found = stage(spark, narrow.mapInArrow(_frequencies(tokenizer, shards), FREQUENCIES), "pretoken-frequencies")
    answers = (
        found.select("block", F.inline("chunks"))
        .groupBy("shard")
        .applyInArrow(_pieces(tokenizer), "block bigint, shard int, pieces binary")
        .groupBy("block")
        .agg(F.collect_list(F.struct("shard", "pieces")).alias("answers"))
    )
    joined = found.drop("chunks").join(answers, "block", "left")
    return joined.mapInArrow(_totals, "doc_id bigint, n_bytes bigint, n_tokens bigint")


#: Tokens that a document of the query may have.
LIMIT = 512


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_counts(table(spark, sf_dir, "documents"))
    return counts.withColumn("over_limit", F.col("n_tokens") > LIMIT)

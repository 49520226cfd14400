"""Language-model scores from an Elias-Fano n-gram trie.

* Tokens: A-Z lower-cased words, then one end token per document; the context of the
  first word is the end token.
* Model: n-grams up to ``order`` (the query: 3), each level with a Dirichlet prior of
  weight ``mu`` whose mean is the level below (h: all but the first word of the context)::

      p(w | v h) = c(v h w) / (c(v h) + mu) + mu / (c(v h) + mu) * p(w | h)
      p(w)       = (c(w) + 1) / (N + V + 1)

  It sums to one over the training words and one unknown word. The context does not
  reach back over the start of the document: its first word has the end token as
  context, its second the end token and the first. The first term is what the trie
  stores for each n-gram, as a 16-bit logarithm; the count of an n-gram follows from it
  and the count of its context (exact up to 1,700, then to 0.03 %). Sums are formed when a text is scored, since c(h w) is on another
  shard than c(v h w).
* Trie: contexts, and for each order pointers and context-relative successors, are
  Elias-Fano sequences in a file per shard, mapped and searched with successor
  queries. The context of a trigram is the place of its first bigram. All n-grams of
  all training documents are in it; nothing is pruned.
* Job: documents become word numbers, block by block (see ``blocks``), which stay in a
  file per block. Shards own words: they add the counts and give out dense ids. Blocks
  then send each distinct n-gram once, with its count, to the shard that owns its first
  bigram: the one of the first word (a word with more than a quarter of a shard's share
  is dealt further by the second); the shard adds up, writes its trie, maps it, and
  answers all n-grams it was sent. Text and token occurrences are never shuffled.

Null texts have the end token only. Very long texts are blocks of their own. Equal rows are scored, and learned from, one by
one; a null id counts as the empty text for the split. An empty table gives an
empty result. Only the id and text columns are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from . import blobs, blocks
from .common import id_crc, partitions, prepare, shards_for, stage, table
from .elias_fano import Trie, quantise, restore

#: The end token; no word contains a line break.
END = b"\n"

#: Words of the longest n-grams of the query.
ORDER = 3

#: Text of one block.
BLOCK_BYTES = 8 << 20

ENCODED = (
    "block bigint, doc_id array<bigint>, train array<boolean>, n_tokens array<int>, numbers string, end_number int, train_tokens bigint, "
    "chunks array<struct<shard: int, items: binary, counts: binary>>"
)


def _encode(shards: int, folder: str):
    def run(batches):
        for k, block in enumerate(blocks.batches_to_blocks(batches, lambda b: b.column("text").nbytes, BLOCK_BYTES)):
            known = blocks.Numbers()
            end = known[END]
            ids, train, parts = [], [], []
            for b in block:
                ids += b.column("doc_id").to_pylist()
                train += b.column("train").to_pylist()
                for text in b.column("text").to_pylist():
                    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
                    words.append(END)
                    parts.append(np.fromiter(map(known.__getitem__, words), np.uint32, len(words)))
            lengths = np.array([len(p) for p in parts], np.int64)
            tokens = np.concatenate(parts)
            learned = np.bincount(tokens[np.repeat(np.array(train, bool), lengths)], minlength=len(known))
            renumber, dealt = blocks.by_shard(list(known), shards)
            counts = np.zeros(len(known), np.uint32)
            counts[renumber] = learned
            chunks, at = [], 0
            for shard, items in dealt:
                chunks.append({"shard": shard, "items": blocks.pack_items(items), "counts": blocks.pack(counts[at : at + len(items)])})
                at += len(items)
            uri = blobs.fresh(f"{folder}/numbers", f"block-{k:06d}", ".u32")
            with blobs.create(uri) as out:
                out.write(blocks.pack(renumber[tokens]))
            yield pa.RecordBatch.from_pydict({
                "block": pa.array([blocks.number_of_block(k)], pa.int64()),
                "doc_id": pa.array([ids], pa.list_(pa.int64())),
                "train": pa.array([train], pa.list_(pa.bool_())),
                "n_tokens": pa.array([lengths.tolist()], pa.list_(pa.int32())),
                "numbers": pa.array([uri], pa.string()),
                "end_number": pa.array([int(renumber[end])], pa.int32()),
                "train_tokens": pa.array([int(counts.sum(dtype=np.int64))], pa.int64()),
                "chunks": pa.array([chunks], pa.list_(pa.struct([("shard", pa.int32()), ("items", pa.binary()), ("counts", pa.binary())]))),
            })

    return run


def _words(shards: int):
    """Counts and ids (from 1; 0: not in training) of the words that a shard owns."""

    def run(chunks: pa.Table) -> pa.Table:
        items = [blocks.unpack_items(x) for x in chunks.column("items").to_pylist()]
        counts = [blocks.unpack(x) for x in chunks.column("counts").to_pylist()]
        names, like = blocks.distinct(pa.concat_arrays(items))
        total = np.bincount(like, weights=np.concatenate(counts), minlength=len(names)).astype(np.uint64)
        trained = np.flatnonzero(total)
        ids = np.zeros(len(names), np.uint64)
        ids[trained] = np.arange(len(trained), dtype=np.uint64) * np.uint64(shards) + np.uint64(chunks.column("shard")[0].as_py() + 1)
        if len(trained) and int(ids.max()) >= 1 << 32:
            raise ValueError("more than 2^32 word ids")
        at = blocks.offsets(np.array([len(x) for x in items]))
        return pa.table({
            "block": chunks.column("block"), "shard": chunks.column("shard"),
            "ids": pa.array([blocks.pack(ids[like[a:b]].astype("<u4")) for a, b in zip(at, at[1:])], pa.binary()),
            "counts": pa.array([blocks.pack64(total[like[a:b]]) for a, b in zip(at, at[1:])], pa.binary()),
            "n_words": pa.array([len(trained)] * len(items), pa.int64()),
        })

    return run


class _Level:
    """The distinct n-grams of one order in a block, and the positions that ask for them."""

    def __init__(self, asked: np.ndarray, like: np.ndarray, keys: np.ndarray):
        #: Positions whose n-gram may have been seen, and the place of each one's n-gram in ``keys``.
        self.asked, self.like = asked.astype(np.int32), like.astype(np.int32)
        #: First word << 32 | second word in shard order; for longer ones place in the level above << 32 | word, sorted.
        self.keys = keys


class _Block:
    """The tokens of a block with global ids and counts, and its distinct n-grams in shard order."""

    def __init__(self, row: dict, shards: int, total: int, order: int):
        answers = sorted(row["words"], key=lambda x: x["shard"])
        ids = np.concatenate([blocks.unpack(x["ids"]) for x in answers]).astype(np.uint64)
        counts = np.concatenate([blocks.unpack64(x["counts"]) for x in answers])
        number = blocks.unpack(blobs.mapped(row["numbers"]).to_pybytes())
        self.lengths = np.asarray(row["n_tokens"], np.int64)
        self.train = np.repeat(np.asarray(row["train"], bool), self.lengths)
        self.count = counts[number]
        word = ids[number]
        context = np.concatenate([ids[row["end_number"]][None], word[:-1]])
        self.context_count = np.concatenate([counts[row["end_number"]][None], self.count[:-1]])
        asked = np.flatnonzero((word > 0) & (context > 0))
        keys, first, like = np.unique((context[asked] << np.uint64(32)) | word[asked], return_index=True, return_inverse=True)
        of = self.context_count[asked[first]]
        share = of.astype(np.float64) * (4 * shards / max(1, total))
        dealt = (keys & np.uint64(0xFFFFFFFF)) % (share.astype(np.uint64) + np.uint64(1))
        mixed = (keys >> np.uint64(32)) * np.uint64(0x9E3779B97F4A7C15) + dealt * np.uint64(0xC2B2AE3D27D4EB4F)
        mixed ^= mixed >> np.uint64(29)
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
        shard = ((mixed >> np.uint64(32)) % np.uint64(shards)).astype(np.int64)
        in_order = np.argsort(shard, kind="stable")
        place = np.empty(len(keys), np.int64)
        place[in_order] = np.arange(len(keys))
        self.shard, self.key_context_count = shard[in_order], of[in_order]
        self.levels = [_Level(asked, place[like], keys[in_order])]
        self.starts = np.zeros(len(word) + 1, bool)
        self.starts[blocks.offsets(self.lengths)] = True
        for _ in range(order - 2):
            above = self.levels[-1]
            # The word after a seen n-gram, if it is in the same document.
            at = above.asked + 1
            go = ~self.starts[at]
            go[go] = word[at[go]] > 0
            at = at[go]
            keys, like = np.unique((above.like[go].astype(np.uint64) << np.uint64(32)) | word[at], return_inverse=True)
            self.levels.append(_Level(at, like, keys))

    def seen(self, level: _Level) -> np.ndarray:
        """Training occurrences of each distinct n-gram."""
        return np.bincount(level.like[self.train[level.asked]], minlength=len(level.keys))


#: An n-gram longer than two words is sent below its parent in the level above.
SENT = (
    "block bigint, shard int, keys binary, counts binary, contexts binary, "
    "deeper array<struct<children: binary, words: binary, counts: binary>>"
)
DEEPER = pa.list_(pa.struct([("children", pa.binary()), ("words", pa.binary()), ("counts", pa.binary())]))
LOW = np.uint64(0xFFFFFFFF)


def _ngrams(shards: int, total: int, order: int):
    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                row = b.slice(i, 1).to_pylist()[0]
                block = _Block(row, shards, total, order)
                seen = [block.seen(level) for level in block.levels]
                out = {n: [] for n in ("shard", "keys", "counts", "contexts", "deeper")}
                cuts = np.flatnonzero(np.diff(block.shard, prepend=-1)) if len(block.shard) else []
                for a, z in zip(cuts, [*cuts[1:], len(block.shard)]):
                    keys = block.levels[0].keys[a:z]
                    names = np.flatnonzero(np.diff(keys >> np.uint64(32), prepend=np.uint64(0)))
                    out["shard"].append(int(block.shard[a]))
                    out["keys"].append(blocks.pack64(np.diff(keys, prepend=np.uint64(0))))
                    out["counts"].append(blocks.pack(seen[0][a:z]))
                    out["contexts"].append(blocks.pack64(block.key_context_count[a:z][names]))
                    deeper = []
                    for level, times in zip(block.levels[1:], seen[1:]):
                        # The children of a run of parents are a run as well.
                        bounds = np.searchsorted(level.keys, np.arange(a, z + 1, dtype=np.uint64) << np.uint64(32))
                        children = np.diff(bounds)
                        a, z = int(bounds[0]), int(bounds[-1])
                        words = (level.keys[a:z] & LOW).astype(np.uint32)
                        deeper.append({"children": blocks.pack(children), "words": blocks.pack(blocks.steps(words, children)), "counts": blocks.pack(times[a:z])})
                    out["deeper"].append(deeper)
                yield pa.RecordBatch.from_pydict({
                    "block": pa.array([row["block"]] * len(out["shard"]), pa.int64()), "shard": pa.array(out["shard"], pa.int32()),
                    **{n: pa.array(out[n], pa.binary()) for n in ("keys", "counts", "contexts")}, "deeper": pa.array(out["deeper"], DEEPER),
                })

    return run


def _trie(folder: str, mu: float, order: int):
    """Add up a shard's n-grams, write its trie, and answer every n-gram from it."""

    def run(chunks: pa.Table) -> pa.Table:
        sent = [np.cumsum(blocks.unpack64(x), dtype=np.uint64) for x in chunks.column("keys").to_pylist()]
        counts = np.concatenate([blocks.unpack(x) for x in chunks.column("counts").to_pylist()])
        named, named_counts = [], []
        for keys, packed in zip(sent, chunks.column("contexts").to_pylist()):
            context = keys >> np.uint64(32)
            named.append(context[np.flatnonzero(np.diff(context, prepend=np.uint64(0)))])
            named_counts.append(blocks.unpack64(packed))
        context_ids, at = np.unique(np.concatenate(named), return_index=True)
        context_counts = np.concatenate(named_counts)[at].astype(np.float64)
        lengths = [np.array([len(x) for x in sent])]
        keys, like = np.unique(np.concatenate(sent), return_inverse=True)
        del sent, named, named_counts
        total = np.bincount(like, weights=counts, minlength=len(keys))
        above = context_counts[np.searchsorted(context_ids, keys >> np.uint64(32))]
        # Per level: distinct n-grams of all blocks, their counts and those of their contexts, and the n-gram of each one sent.
        levels = [(keys, total, above, like)]
        deeper = chunks.column("deeper").to_pylist()
        for k in range(order - 2):
            parts = [x[k] for x in deeper]
            children = [blocks.unpack(x["children"]).astype(np.int64) for x in parts]
            words = np.concatenate([blocks.unsteps(blocks.unpack(x["words"]), n) for x, n in zip(parts, children)])
            counts = np.concatenate([blocks.unpack(x["counts"]) for x in parts])
            lengths.append(np.array([n.sum() for n in children]))
            parent = np.repeat(like, np.concatenate(children)).astype(np.uint64)
            keys, like = np.unique((parent << np.uint64(32)) | words, return_inverse=True)
            above = total[(keys >> np.uint64(32)).astype(np.int64)]
            total = np.bincount(like, weights=counts, minlength=len(keys))
            levels.append((keys, total, above, like))
        del deeper
        stored, place = [], None
        for keys, total, above, _ in levels:
            kept = total > 0
            parent = keys[kept] >> np.uint64(32)
            stored.append((
                parent if place is None else place[parent.astype(np.int64)], keys[kept] & LOW,
                quantise(np.log10(total[kept] / (above[kept] + mu))),
            ))
            place = np.cumsum(kept) - 1
        uri = blobs.fresh(f"{folder}/tries", f"shard-{chunks.column('shard')[0].as_py():06d}", ".trie")
        with blobs.create(uri) as out:
            for part in Trie.parts(*stored[0], *stored[1:]):
                out.write(part)
        del stored
        trie = Trie.open(uri)
        answers, place, got = [], None, None
        for k, ((keys, _, above, like), n) in enumerate(zip(levels, lengths)):
            parent = (keys >> np.uint64(32)).astype(np.int64)
            if k:
                place, above = trie.below(k, place[parent], keys & LOW), got[parent]
            else:
                place = trie.find(parent.astype(np.uint64), keys & LOW)
            hit = place >= 0
            # The count, read back from the code: it takes fewer bytes.
            got = np.zeros(len(keys))
            got[hit] = np.maximum(1, np.rint(10 ** restore(trie.levels[k][2][place[hit]].astype(np.float64)) * (above[hit] + mu)))
            at = blocks.offsets(n)
            answers.append([blocks.pack64(got[like[a:z]].astype(np.uint64)) for a, z in zip(at, at[1:])])
        return pa.table({
            "block": chunks.column("block"), "shard": chunks.column("shard"),
            "counts": pa.array([list(x) for x in zip(*answers)], pa.list_(pa.binary())),
            "file": pa.array([uri] * chunks.num_rows, pa.string()),
        })

    return run


SCORES = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"


def _scores(shards: int, total: int, vocabulary: int, mu: float, order: int):
    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                row = b.slice(i, 1).to_pylist()[0]
                block = _Block(row, shards, total, order)
                answers = sorted(row["ngrams"] or [], key=lambda x: x["shard"])
                unigram = (block.count + 1.0) / (total + (vocabulary + 1))
                context_count = block.context_count.astype(np.float64)
                p = unigram
                for k, level in enumerate(block.levels):
                    counts = np.concatenate([np.zeros(0, np.uint64), *[blocks.unpack64(x["counts"][k]) for x in answers]]).astype(np.float64)[level.like]
                    times = np.zeros(len(p) + 1)
                    times[level.asked] = counts
                    p = (times[:-1] + mu * p) / (context_count + mu)
                    # The n-gram as context of the next word of its document.
                    times[:] = 0
                    times[level.asked + 1] = counts
                    times[block.starts] = 0
                    context_count = times[:-1]
                first = blocks.offsets(block.lengths)[:-1]
                n = len(block.lengths)
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array(row["doc_id"], pa.int64()), "held_out": pa.array([not t for t in row["train"]], pa.bool_()),
                    "n_tokens": pa.array(block.lengths, pa.int64()),
                    "n_known": pa.array(np.add.reduceat((block.count > 0).astype(np.int64), first), pa.int64()),
                    "train_tokens": pa.array(np.full(n, total), pa.int64()),
                    "base_score": pa.array(np.add.reduceat(np.log10(unigram), first), pa.float64()),
                    "score": pa.array(np.add.reduceat(np.log10(p), first), pa.float64()),
                })

    return run


#: Text for which there is one shard of the trie, and half a shard of words.
SHARD_BYTES = 4 << 20


def lm_scores(docs: DataFrame, train, *, doc_id: str = "doc_id", text: str = "text", mu: float = 300.0, order: int = 2, folder: str | None = None) -> DataFrame:
    """Scores of every row of ``docs``, learned from the rows where the column ``train`` is true.

    ``order`` (2 or more) is the length of the longest n-grams. The tries stay in ``folder`` (default: the shared folder)."""
    if order < 2:
        raise ValueError("order must be at least 2")
    spark = docs.sparkSession
    prepare(spark)
    folder = folder or scratch_path(spark, "ngram-tries")
    trie_shards = shards_for(docs, text, SHARD_BYTES, 4 * partitions(spark))
    word_shards = -(-trie_shards // 2)
    rows = docs.select(docs[doc_id].cast("bigint").alias("doc_id"), docs[text].cast("string").alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    encoded = stage(spark, rows.mapInArrow(_encode(word_shards, folder), ENCODED), "word-numbers")
    words = encoded.select("block", F.inline("chunks")).groupBy("shard").applyInArrow(
        _words(word_shards), "block bigint, shard int, ids binary, counts binary, n_words bigint"
    )
    words = stage(spark, words, "word-ids")
    total = encoded.agg(F.sum("train_tokens")).first()[0] or 0
    vocabulary = words.groupBy("shard").agg(F.max("n_words").alias("n")).agg(F.sum("n")).first()[0] or 0
    by_block = words.groupBy("block").agg(F.collect_list(F.struct("shard", "ids", "counts")).alias("words"))
    known = encoded.drop("chunks").join(by_block, "block")
    sent = known.mapInArrow(_ngrams(trie_shards, total, order), SENT)
    answers = sent.groupBy("shard").applyInArrow(_trie(folder, mu, order), "block bigint, shard int, counts array<binary>, file string")
    found = answers.groupBy("block").agg(F.collect_list(F.struct("shard", "counts")).alias("ngrams"))
    return known.join(found, "block", "left").mapInArrow(_scores(trie_shards, total, vocabulary, mu, order), SCORES)


def op6_ngram_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return lm_scores(docs, id_crc(docs["doc_id"]) % 7 != 2, order=ORDER)

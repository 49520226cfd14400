"""Phrase collocations from count streams in prefix and suffix order.

* Words: A-Z lower-cased, texts cut into pieces at ``[.,;:!?\\x0A-\\x0D]``, pieces into
  words ``[^\\x20\\x09]+``. Everything is counted per language (null: ``und``).
* Counting: a task gathers documents into blocks of bounded size, numbers the
  words of a block and sorts its phrases of one to three words into counted runs; a run
  is dealt to shards, and each shard merges the runs of all blocks by sorting. A
  phrase reaches its shard once per block, so a frequent one makes no hot shard. The
  number of shards follows the bytes of text.
* Streams: the phrases that occur ``min_count`` times are kept as two streams, one in
  prefix order (first word first) and one in suffix order (last word first), each
  sorted over ranges of the whole key, so the phrases of one word may lie in many
  ranges. In prefix order a phrase follows its own beginnings, in suffix order its
  own ends: one pass along a stream gives every phrase the counts of its first (last)
  parts and the most frequent longer phrase that begins (ends) with it. What
  a range needs from the range before is one word and one pair, handed over as one row
  per range. No tables of counts are probed.
* Join: both streams' findings, sorted in one order, are merged in step: a candidate
  meets its left and right counts, is scored in exact integers and leaves if it lies
  inside a longer candidate that has ``min_share`` percent of its occurrences.

A lower count than ``min_count`` can decide nothing: the parts of a candidate occur at
least as often as the candidate.

Null and empty texts have no words. Repeated rows count as often as they occur. Very
long texts are blocks of their own. An empty table gives an empty result. Ties are
ordered by count, then by the bytes of the phrase. Other columns are never looked at,
whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import shared_dir
from .blocks import Numbers, batches_to_blocks, distinct, pack, pack_array, unpack, unpack_items
from .common import partitions, prepare, stage, table

#: Text of a block, and text for which there is one shard.
BLOCK_BYTES = 8 << 20
SHARD_BYTES = 4 << 20

#: Phrases in one range of a stream.
RANGE_ROWS = 100_000

#: Bytes that end a piece become a byte that UTF-8 never has; A-Z are lower-cased.
END = b"\xff"
_UPPER = bytes(range(65, 91))
_FOLD = bytes.maketrans(_UPPER + b".,;:!?\n\x0b\x0c\r", _UPPER.lower() + END * 10)


def words_of(text: bytes) -> list[bytes]:
    """The words of a text, with ``END`` between pieces (also where a piece is empty)."""
    return text.translate(_FOLD).replace(END, b" \xff ").split()


def _numbered(block: list[pa.RecordBatch]) -> tuple[list[bytes], np.ndarray]:
    """The words of a block (``lang \\n word``; entry 0 is the end of a piece) and their
    sequence; every text ends with entry 0."""
    items: list[bytes] = [b""]
    sequence: list[np.ndarray] = []
    by_lang: dict[bytes, list[bytes]] = {}
    for batch in block:
        texts = batch.column("text").cast(pa.binary()).to_pylist()
        for lang, text in zip(batch.column("lang").cast(pa.binary()).to_pylist(), texts):
            if text:
                by_lang.setdefault(lang, []).append(text)
    for lang, texts in by_lang.items():
        number = Numbers({END: 0})
        parts = []
        for text in texts:
            found = words_of(text)
            parts.append(np.fromiter(map(number.__getitem__, found), np.int64, len(found)))
            parts.append(np.zeros(1, np.int64))
        ids = np.concatenate(parts)
        ids[ids > 0] += len(items) - 1
        sequence.append(ids)
        items += [lang + b"\n" + w for w in list(number)[1:]]
    return items, np.concatenate(sequence) if sequence else np.zeros(0, np.int64)


def counted_run(a: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The phrases of a sequence of word numbers (0 ends a piece), sorted, with their
    counts: first, second and third word (0: none) and count."""
    alone = np.bincount(a, minlength=size)
    alone[:1] = 0
    w = np.flatnonzero(alone)
    none = np.zeros(len(w), np.int64)
    out = [(w, none, none, alone[w])]
    at = np.flatnonzero((a[:-1] > 0) & (a[1:] > 0))
    pairs, pair, n = np.unique(a[at] * size + a[at + 1], return_inverse=True, return_counts=True)
    out.append((pairs // size, pairs % size, np.zeros(len(pairs), np.int64), n))
    go = np.flatnonzero(np.diff(at) == 1)  # a pair that begins where the one before has its second word
    key, n = np.unique(pair[go] * size + a[at[go] + 2], return_counts=True)
    head = pairs[key // size] if len(key) else key
    out.append((head // size, head % size, key % size, n))
    return tuple(np.concatenate(x) for x in zip(*out))


def _runs(shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in batches_to_blocks(batches, lambda b: b.nbytes, BLOCK_BYTES):
            items, a = _numbered(block)
            if len(items) == 1:
                continue
            w1, w2, w3, n = counted_run(a, len(items))
            hashed = np.fromiter(map(zlib.crc32, items), np.uint64, len(items))
            mixed = (hashed[w1] * np.uint64(1_000_003) ^ hashed[w2]) * np.uint64(1_000_003) ^ hashed[w3]
            owner = ((mixed ^ mixed >> np.uint64(29)) % np.uint64(shards)).astype(np.int64)
            order = np.argsort(owner, kind="stable")
            cuts = np.flatnonzero(np.diff(owner[order])) + 1
            names = pa.array(items, pa.large_binary())
            for part in np.split(order, cuts):
                words = np.concatenate([w1[part], w2[part], w3[part]])
                met = np.zeros(len(items), bool)
                met[words] = True
                used = np.flatnonzero(met)
                local = np.cumsum(met, dtype=np.uint32) - np.uint32(1)
                row = {
                    "shard": [int(owner[part[0]])],
                    "words": [pack_array(names.take(pa.array(used)))],
                    "phrases": [pack(local[words])],
                    "counts": [pack(n[part].astype(np.uint32))],
                }
                yield pa.RecordBatch.from_pydict(row, pa.schema([("shard", pa.int32()), ("words", pa.binary()), ("phrases", pa.binary()), ("counts", pa.binary())]))

    return run


GRAMS = "lang string, w1 string, w2 string, w3 string, n bigint"
_GRAMS = pa.schema([("lang", pa.string()), ("w1", pa.string()), ("w2", pa.string()), ("w3", pa.string()), ("n", pa.int64())])


def _merged(min_count: int):
    """The runs of one shard become one: phrases with ``min_count`` occurrences, and for each
    language a row without words that has all its word occurrences in this shard."""

    def merge(group: pa.Table) -> pa.Table:
        words, parts, counts, base = [], [], [], 0
        for w, p, c in zip(*(group.column(k).to_pylist() for k in ("words", "phrases", "counts"))):
            words.append(unpack_items(w))
            parts.append(unpack(p).reshape(3, -1).astype(np.int64) + base)
            counts.append(unpack(c).astype(np.int64))
            base += len(words[-1])
        names, place = distinct(pa.concat_arrays(words))
        w = place[np.concatenate(parts, axis=1)].astype(np.int64)
        n = np.concatenate(counts)
        size = len(names)
        _, pair = np.unique(w[0] * size + w[1], return_inverse=True)
        key = pair * size + w[2]
        order = np.argsort(key, kind="stable")
        first = np.flatnonzero(np.diff(key[order], prepend=-1))
        total = np.add.reduceat(n[order], first)
        w = w[:, order[first]]
        names = names.to_pylist()
        single = {i for i, x in enumerate(names) if not x}
        empty = single.pop() if single else -1
        rows: list[tuple] = []
        sums: dict[bytes, int] = {}
        for i in np.flatnonzero((w[1] == empty) & (w[2] == empty)):
            lang = names[w[0, i]].rpartition(b"\n")[0]
            sums[lang] = sums.get(lang, 0) + int(total[i])
        rows += [(lang.decode(), None, None, None, s) for lang, s in sums.items()]
        for i in np.flatnonzero(total >= min_count):
            lang, _, first_word = names[w[0, i]].rpartition(b"\n")
            rest = [names[x].rpartition(b"\n")[2].decode() for x in w[1:, i]]
            rows.append((lang.decode(), first_word.decode(), *rest, int(total[i])))
        return pa.Table.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), _GRAMS)], schema=_GRAMS) if rows else _GRAMS.empty_table()

    return merge


def phrase_counts(docs: DataFrame, *, text: str = "text", lang: str = "lang", min_count: int = 10) -> DataFrame:
    """``lang, w1, w2, w3, n``: the phrases of one to three words (absent words: empty) that
    occur ``min_count`` times, and rows with null words whose ``n`` add up to a language's words."""
    spark = docs.sparkSession
    prepare(spark)
    narrow = docs.select(
        F.coalesce(docs[lang].cast("string"), F.lit("und")).alias("lang"), F.coalesce(docs[text].cast("string"), F.lit("")).alias("text")
    )
    size = narrow.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(partitions(spark), -(-size // SHARD_BYTES))
    runs = narrow.mapInArrow(_runs(shards), "shard int, words binary, phrases binary, counts binary")
    return runs.repartition(shards, "shard").groupBy("shard").applyInArrow(_merged(min_count), GRAMS)


STREAM = ["lang", "k1", "k2", "k3"]


def _sorted_stream(df: DataFrame, keys: list[str], ranges: int) -> DataFrame:
    """Sorted over ranges of the whole key and kept, with the numbers of the ranges, in the
    shared checkpoint folder, so that later passes see the same ranges."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.repartitionByRange(ranges, *keys).sortWithinPartitions(*keys).withColumn("part", F.spark_partition_id()).checkpoint()


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*(c.to_pylist() for c in b.columns))


EDGE = "part int, lang string, k1 string, n1 bigint, k2 string, n2 bigint"
_EDGE = pa.schema([("part", pa.int32()), ("lang", pa.string()), ("k1", pa.string()), ("n1", pa.int64()), ("k2", pa.string()), ("n2", pa.int64())])


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last word and the last pair of this range."""
    lang = k1 = n1 = k2 = n2 = part = None
    for g, a, b, c, n, part in _rows(batches):
        if not b:
            lang, k1, n1, k2, n2 = g, a, n, None, None
        elif not c:
            if (g, a) != (lang, k1):
                lang, k1, n1 = g, a, None  # the word itself is in an earlier range
            k2, n2 = b, n
    if lang is not None:
        yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((part, lang, k1, n1, k2, n2), _EDGE)], schema=_EDGE)


def _carried(stream: DataFrame) -> dict[int, tuple]:
    """For each range the word and pair that were last before it: one row per range."""
    carry, now = {}, (None, None, None, None, None)
    last = {r["part"]: tuple(r)[1:] for r in stream.mapInArrow(_edges, EDGE).collect()}
    for part in range(max(last, default=-1) + 2):
        carry[part] = now
        if part in last:
            lang, k1, n1, k2, n2 = last[part]
            if n1 is None and (lang, k1) == now[:2]:
                n1 = now[2]
            now = (lang, k1, n1, k2, n2)
    return carry


FOUND = "lang string, k1 string, k2 string, k3 string, n bigint, f1 bigint, f2 bigint, longer bigint"
_FOUND = pa.schema([(k, pa.string()) for k in STREAM] + [(k, pa.int64()) for k in ("n", "f1", "f2", "longer")])


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 5_000) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for r in rows:
        held.append(r)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def _along(carry: dict[int, tuple]):
    """One pass along a stream. Pairs and triples get the counts of the word and the pair they
    begin with (in the stream's order), pairs also their most frequent triple (``longer``).
    A pair whose triples go on in the next range gets a second row there, without ``n``."""

    def walk(batches):
        rows = _rows(batches)
        head = next(rows, None)
        if head is None:
            return
        lang, k1, n1, k2, n2 = carry[head[5]]
        pair = (lang, k1, k2, "", None, None, None) if k2 else None
        longer = 0
        for g, a, b, c, n, _ in chain([head], rows):
            if c:
                longer = max(longer, n)
                yield g, a, b, c, n, n1, n2, 0
                continue
            if pair is not None and (longer or pair[4] is not None):
                yield *pair, longer
            pair, longer = None, 0
            if b:
                n2 = n
                pair = (g, a, b, "", n, n1, None)
            else:
                n1 = n
        if pair is not None and (longer or pair[4] is not None):
            yield *pair, longer

    return lambda batches: _batches(walk(batches), _FOUND)


SCORED = "lang string, phrase string, a bigint, l bigint, r bigint, score bigint"
_SCORED = pa.schema([("lang", pa.string()), ("phrase", pa.string())] + [(k, pa.int64()) for k in ("a", "l", "r", "score")])


def weakest_cut(a: int, cuts: list[tuple[int, int]]) -> tuple[int, int, int]:
    """The lowest score of the cuts ``(l, r)``, the first of equals, with its counts."""
    score, k = min((1_000_000 * a * a // (l * r), k) for k, (l, r) in enumerate(cuts))
    return score, *cuts[k]


def _in_step(min_share: int):
    """Rows of both streams sorted by phrase: those of one phrase meet, are scored and judged."""

    def judged(key, rows):
        n, longer = max(r[5] or 0 for r in rows), max(r[8] for r in rows)
        if not key[3] and 100 * longer >= min_share * n:
            return
        left = next(r for r in rows if r[5] is not None and r[4] == "prefix")
        right = next(r for r in rows if r[5] is not None and r[4] == "suffix")
        cuts = [(left[6], right[7]), (left[7], right[6])] if key[3] else [(left[6], right[6])]
        score, l, r = weakest_cut(n, cuts)
        yield key[0], " ".join(x for x in key[1:] if x), n, l, r, score

    def walk(batches):
        now, rows = None, []
        for r in _rows(batches):
            if r[:4] != now:
                if rows:
                    yield from judged(now, rows)
                now, rows = r[:4], []
            rows.append(r)
        if rows:
            yield from judged(now, rows)

    return lambda batches: _batches(walk(batches), _SCORED)


def _contenders(scored: DataFrame, top: int) -> DataFrame:
    """The phrases whose score lies in the classes that the ``top`` best of their language fill, so that a
    language with very many phrases sends few of them to the task that ranks it. Classes are hundredths of a
    power of ten: 601 for each language, whatever the phrases."""
    classed = scored.withColumn("class", F.floor(100 * F.log10(F.col("score") + 1)))
    counts = classed.groupBy("lang", "class").agg(F.count(F.lit(1)).alias("phrases"))
    above = F.sum("phrases").over(Window.partitionBy("lang").orderBy(F.desc("class")))
    # classes that are reached before ``top`` phrases have been seen
    reached = counts.withColumn("before", above - F.col("phrases")).where(F.col("before") < top)
    least = reached.groupBy("lang").agg(F.min("class").alias("least"))
    return classed.join(least, "lang").where(F.col("class") >= F.col("least")).drop("class", "least")


def collocations(
    docs: DataFrame, *, text: str = "text", lang: str = "lang", min_count: int = 10, min_share: int = 50, top: int | None = None
) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: phrases of two or three words with ``a``
    occurrences and the counts of the two parts of their weakest cut, best first within
    each language (the first ``top``; None: all)."""
    spark = docs.sparkSession
    grams = stage(spark, phrase_counts(docs, text=text, lang=lang, min_count=min_count), "phrase-counts")
    sums = grams.where("w1 IS NULL").groupBy("lang").agg(F.sum("n").alias("n"))
    kept = grams.where("w1 IS NOT NULL")
    ranges = max(partitions(spark), -(-kept.count() // RANGE_ROWS))
    found = []
    for side in ("prefix", "suffix"):
        if side == "prefix":
            keys = [F.col("w1"), F.col("w2"), F.col("w3")]
        else:  # last word first; absent words stay behind
            keys = [
                F.when(F.col("w3") != "", F.col("w3")).when(F.col("w2") != "", F.col("w2")).otherwise(F.col("w1")),
                F.when(F.col("w3") != "", F.col("w2")).when(F.col("w2") != "", F.col("w1")).otherwise(F.lit("")),
                F.when(F.col("w3") != "", F.col("w1")).otherwise(F.lit("")),
            ]
        stream = _sorted_stream(kept.select("lang", *[k.alias(f"k{i + 1}") for i, k in enumerate(keys)], "n"), STREAM, ranges)
        along = stream.mapInArrow(_along(_carried(stream)), FOUND)
        if side == "suffix":
            along = along.select(
                "lang",
                F.when(F.col("k3") != "", F.col("k3")).otherwise(F.col("k2")).alias("k1"),
                F.when(F.col("k3") != "", F.col("k2")).otherwise(F.col("k1")).alias("k2"),
                F.when(F.col("k3") != "", F.col("k1")).otherwise(F.lit("")).alias("k3"),
                "n", "f1", "f2", "longer",
            )
        found.append(along.select(*STREAM, F.lit(side).alias("side"), "n", "f1", "f2", "longer"))
    both = stage(spark, found[0].unionByName(found[1]), "phrase-findings")
    in_step = both.repartitionByRange(ranges, *STREAM).sortWithinPartitions(*STREAM, "side").mapInArrow(_in_step(min_share), SCORED)
    scored = stage(spark, in_step, "phrase-scores")
    if top is not None:
        scored = _contenders(scored, top)
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = scored.withColumn("rank", F.row_number().over(best).cast("bigint"))
    if top is not None:
        ranked = ranked.where(F.col("rank") <= top)
    return ranked.join(sums, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


#: Phrases that the query returns of each language.
TOP = 2000


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"), top=TOP)


OP13_SQL = """
WITH pieces AS (
  SELECT row_number() OVER () AS p, lang, piece FROM (
    SELECT coalesce(lang, 'und') AS lang,
           unnest(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece
    FROM documents)),
lists AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces),
grams AS (
  SELECT lang, unnest(w) AS phrase, 1 AS k FROM lists
  UNION ALL SELECT lang, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])), 2 FROM lists WHERE len(w) >= 2
  UNION ALL SELECT lang, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])), 3 FROM lists WHERE len(w) >= 3),
f AS (SELECT lang, k, phrase, count(*) AS n FROM grams GROUP BY lang, k, phrase),
cand AS (
  SELECT lang, k, phrase, n AS a, split_part(phrase, ' ', 1) AS w1, split_part(phrase, ' ', 2) AS w2, split_part(phrase, ' ', 3) AS w3
  FROM f WHERE k >= 2 AND n >= 10),
cuts AS (
  SELECT lang, k, phrase, a, 1 AS cut, w1 AS head, CASE WHEN k = 2 THEN w2 ELSE w2 || ' ' || w3 END AS rest FROM cand
  UNION ALL SELECT lang, k, phrase, a, 2, w1 || ' ' || w2, w3 FROM cand WHERE k = 3),
scored AS (
  SELECT c.lang, c.k, c.phrase, c.a, c.cut, h.n AS l, t.n AS r,
         CAST((CAST(1000000 AS HUGEINT) * c.a * c.a) // (CAST(h.n AS HUGEINT) * t.n) AS BIGINT) AS score
  FROM cuts c JOIN f h ON h.lang = c.lang AND h.phrase = c.head AND h.k = c.cut
              JOIN f t ON t.lang = c.lang AND t.phrase = c.rest AND t.k = c.k - c.cut),
weakest AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, k, phrase ORDER BY score, cut) AS o FROM scored) WHERE o = 1),
inside AS (
  SELECT lang, phrase, max(a) AS longer FROM (
    SELECT lang, w1 || ' ' || w2 AS phrase, a FROM cand WHERE k = 3
    UNION ALL SELECT lang, w2 || ' ' || w3, a FROM cand WHERE k = 3) GROUP BY lang, phrase),
kept AS (
  SELECT w.* FROM weakest w LEFT JOIN inside i ON i.lang = w.lang AND i.phrase = w.phrase AND w.k = 2
  WHERE i.longer IS NULL OR 100 * i.longer < 50 * w.a)
SELECT k.lang, k.rank, k.phrase, k.a, k.l, k.r, t.n, k.score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept) k
JOIN (SELECT lang, CAST(sum(n) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang) t ON t.lang = k.lang
WHERE k.rank <= 2000"""

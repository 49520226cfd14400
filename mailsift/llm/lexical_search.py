"""Ranked lexical search: the best documents for each item, by buckets of vector length.

* Terms are runs of ASCII letters and digits and of all characters from U+0080 on, A-Z
  lower-cased. With N documents that hold a term, L terms in all of them and df documents
  holding t, a term's weight is w = floor(1000 ln((2N+2) / (2df+1))), and a document
  of n terms, tf of them t, has the impact g = 10^9 tf div (1000 tf + 8m), with
  m = 10 + (90 n N div L). The score of a document for an item is the sum of w g over the
  item's distinct terms: exact integers.
* Vectors: a document is the vector of sqrt(w) g over the terms that occur in any item, an
  item the vector of sqrt(w) over its terms. Their inner product is the score.
* Buckets: the vectors are sorted by falling length over ranges, and neighbours form buckets
  with their greatest length. An item needs a bucket only if its own length times that
  length reaches the score it has to beat (Cauchy-Schwarz); buckets that no item needs are
  not read.
* Inside a bucket, vectors too short for the item are cut off by the same bound. The
  item's heaviest terms are added up from the bucket's postings; what the others can still add is
  bounded by the lengths of both rests and by the greatest impact of every coordinate.
  Documents whose bound stays below the score to beat leave; the survivors are scored
  exactly, in integers.
* The score to beat is the ``top``-th best that the first bucket of every range holds, and
  rises within a task. Documents that reach it exactly stay, as equal scores are ordered by id.

The items are a stated query set; they come in blocks of ``BLOCK_CHARS`` characters (the
terms of one block are the only thing broadcast), each of which reads the documents once.

Null, empty or termless texts of documents count nowhere, and such items have no rows.
Very long texts are read whole. Repeated rows of documents are ranked each, a null id last among
equal scores; repeated items have results each. Empty tables give an empty result. Other
columns are never looked at, whatever their names.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import partitions, prepare, stage, table

#: Characters of items in one block: a bound for what is broadcast.
BLOCK_CHARS = 1 << 20

#: Documents and coordinates of a bucket.
BUCKET_DOCS = 1024
BUCKET_ENTRIES = 1 << 18

#: Share of an item's possible score that is added up before the bounds are looked at.
FOCUS = 0.6

#: Bounds are doubles: they are raised by this factor before documents leave.
SLACK = 1 + 1e-9

_UPPER = bytes(range(65, 91))
_SEPARATORS = bytes(b for b in range(128) if not chr(b).isalnum())
_FOLD = bytes.maketrans(_UPPER + _SEPARATORS, _UPPER.lower() + b" " * len(_SEPARATORS))


def terms(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


VECTORS = "doc_id bigint, n bigint, ids array<int>, tf array<int>"


def _vectors(number: dict[bytes, int]):
    """Documents with a term: their terms that occur in items, with frequencies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").cast(pa.binary()).to_pylist()):
                found = terms(text)
                if found:
                    tf = Counter(map(number.get, found))
                    tf.pop(None, None)
                    rows.append((doc, len(found), list(tf.keys()), list(tf.values())))
            if rows:
                cols = list(zip(*rows))
                kinds = (pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["doc_id", "n", "ids", "tf"])

    return run


def weight(docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * docs + 2) / (2 * df + 1)))


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column and the borders of the rows in them."""
    at = np.asarray(column.offsets)
    return column.values.slice(at[0], at[-1] - at[0]).to_numpy(), (at - at[0]).astype(np.int64)


def _impacts(w: np.ndarray, docs: int, total: int):
    """``g`` of every coordinate and the length of the vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            ids, at = _lists(b.column("ids"))
            tf = _lists(b.column("tf"))[0].astype(np.int64)
            m = 10 + 90 * b.column("n").to_numpy().astype(np.int64) * docs // total
            g = 1_000_000_000 * tf // (1000 * tf + 8 * np.repeat(m, np.diff(at)))
            squares = np.concatenate([[0.0], np.cumsum(w[ids] * g.astype(np.float64) ** 2)])
            norm = np.sqrt(np.maximum(0, squares[at[1:]] - squares[at[:-1]])) * SLACK
            impact = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(g, pa.int32()))
            ids_ = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(norm), ids_, impact], names=["doc_id", "norm", "ids", "g"])

    return run


_BUCKET = pa.schema(
    [("lead", pa.bool_()), ("max_norm", pa.float64()), ("docs", pa.list_(pa.int64())), ("norms", pa.list_(pa.float64())),
     ("ends", pa.list_(pa.int32())), ("ids", pa.list_(pa.int32())), ("g", pa.list_(pa.int32()))]
)
BUCKETS = "lead boolean, max_norm double, docs array<bigint>, norms array<double>, ends array<int>, ids array<int>, g array<int>"


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Neighbours in the order of falling length, packed into one row a bucket."""
    lead, docs, norms, ends, ids, g = True, [], [], [], [], []
    size = 0

    def row():
        return pa.RecordBatch.from_arrays(
            [pa.array([x], f.type) for x, f in zip((lead, norms[0], docs, norms, ends, np.concatenate(ids), np.concatenate(g)), _BUCKET)],
            schema=_BUCKET,
        )

    for b in batches:
        value, at = _lists(b.column("ids"))
        impact = _lists(b.column("g"))[0]
        for k, (doc, norm) in enumerate(zip(b.column("doc_id").to_pylist(), b.column("norm").to_pylist())):
            docs.append(doc)
            norms.append(norm)
            ids.append(value[at[k] : at[k + 1]])
            g.append(impact[at[k] : at[k + 1]])
            size += int(at[k + 1] - at[k])
            ends.append(size)
            if len(docs) == BUCKET_DOCS or size >= BUCKET_ENTRIES:
                yield row()
                lead, docs, norms, ends, ids, g, size = False, [], [], [], [], [], 0
    if docs:
        yield row()


class Bucket:
    """The vectors of one bucket and their postings by term."""

    def __init__(self, docs, norms, ends, ids, g, w):
        self.docs, self.norms, self.ids, self.g = docs, norms, ids, g.astype(np.int64)
        self.starts = np.concatenate([[0], ends.astype(np.int64)])
        owner = np.repeat(np.arange(len(docs)), np.diff(self.starts))
        order = np.argsort(self.ids, kind="stable")
        self.p_doc, self.p_g = owner[order], self.g[order]
        self.at = np.searchsorted(self.ids[order], np.arange(len(w) + 1))
        self.most = np.zeros(len(w), np.int64)
        np.maximum.at(self.most, self.ids, self.g)
        self.w = w

    def best(self, item: np.ndarray, beat: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents (by place) that reach ``beat`` for an item given by its terms, heaviest
        first, and their exact scores."""
        w, none = self.w, np.zeros(0, np.int64)
        length = math.sqrt(float(w[item].sum())) * SLACK
        # lengths fall, so the vectors that are long enough come first
        long_enough = int(np.searchsorted(-self.norms, -beat / length, side="right")) if length else 0
        if not long_enough:
            return none, none
        reach = w[item] * self.most[item]  # what each coordinate can give at most
        left = np.concatenate([reach[::-1].cumsum()[::-1], [0]])
        if left[0] < beat:
            return none, none
        focus = int(np.searchsorted(-left, -(1 - FOCUS) * left[0])) or 1
        score = np.zeros(len(self.docs), np.int64)
        rest = self.norms**2
        for t in item[:focus]:
            a, b = self.at[t], self.at[t + 1]
            d, g = self.p_doc[a:b], self.p_g[a:b]
            score[d] += w[t] * g
            rest[d] -= w[t] * g.astype(np.float64) ** 2
        other = math.sqrt(float(w[item[focus:]].sum())) * np.sqrt(np.maximum(rest, 0) + 1e-9 * self.norms**2)
        bound = score + np.minimum(other * SLACK, left[focus])
        live = np.flatnonzero(bound[:long_enough] >= beat)
        if not len(live):
            return none, none
        asked = np.zeros(len(w), np.int64)
        asked[item] = w[item]
        spans = [np.arange(self.starts[d], self.starts[d + 1]) for d in live]
        every = np.concatenate(spans)
        exact = np.concatenate([[0], np.cumsum(asked[self.ids[every]] * self.g[every])])
        ends = np.cumsum([len(s) for s in spans])
        exact = exact[ends] - exact[ends - [len(s) for s in spans]]
        keep = exact >= beat
        return live[keep], exact[keep]


FOUND = "query int, doc_id bigint, score bigint"
_FOUND = pa.schema([("query", pa.int32()), ("doc_id", pa.int64()), ("score", pa.int64())])


def _order(hit: tuple) -> tuple:
    score, doc = hit
    return -score, doc is None, doc or 0


def _search(items: list[np.ndarray], w: np.ndarray, beat: list[int], top: int):
    """The ``top`` best documents of a task's buckets for every item, of those that reach ``beat``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple]] = [[] for _ in items]
        need = list(beat)
        for b in batches:
            for r in range(b.num_rows):
                norms, ends, ids, g = (b.column(k)[r].values.to_numpy() for k in ("norms", "ends", "ids", "g"))
                bucket = Bucket(b.column("docs")[r].as_py(), norms, ends, ids, g, w)
                for q, item in enumerate(items):
                    if len(item):
                        places, scores = bucket.best(item, need[q])
                        if len(places):
                            hits = best[q] + [(int(s), bucket.docs[p]) for p, s in zip(places, scores)]
                            best[q] = sorted(hits, key=_order)[:top]
                            if len(best[q]) == top:
                                need[q] = max(need[q], best[q][-1][0])
        rows = [(q, doc, score) for q, hits in enumerate(best) for score, doc in hits]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _FOUND)], schema=_FOUND)

    return run


def _ranked(found: DataFrame, top: int) -> DataFrame:
    best = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)


def _item_blocks(items: DataFrame, item_id: str, text: str) -> Iterator[list[tuple]]:
    block, size = [], 0
    for r in items.select(items[item_id].alias("item_id"), items[text].cast("string").alias("text")).toLocalIterator():
        block.append((r["item_id"], terms((r["text"] or "").encode("utf-8", "surrogatepass"))))
        size += len(r["text"] or "")
        if size >= BLOCK_CHARS:
            yield block
            block, size = [], 0
    if block:
        yield block


def _block_search(docs: DataFrame, block: list[tuple], top: int) -> DataFrame:
    spark = docs.sparkSession
    number = {t: i for i, t in enumerate(sorted({t for _, found in block for t in found}))}
    vectors = stage(spark, docs.mapInArrow(_vectors(number), VECTORS), "search-vectors")
    sums = vectors.agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("terms")).first()
    df = np.zeros(len(number), np.int64)
    for r in vectors.select(F.explode("ids").alias("id")).groupBy("id").count().collect():  # one row per term of the block
        df[r["id"]] = r["count"]
    w = np.array([weight(sums["docs"], int(x)) for x in df], np.int64)
    impacts = vectors.where(F.size("ids") > 0).mapInArrow(_impacts(w, sums["docs"], sums["terms"] or 1), "doc_id bigint, norm double, ids array<int>, g array<int>")
    order = [F.desc("norm"), F.asc("doc_id"), F.asc("salt")]
    by_length = impacts.withColumn("salt", F.rand(7)).repartitionByRange(2 * partitions(spark), *order).sortWithinPartitions(*order)
    buckets = stage(spark, by_length.drop("salt").mapInArrow(_buckets, BUCKETS), "search-buckets")
    items = []
    for _, found in block:
        ids = np.array(sorted({number[t] for t in found}), np.int64)
        items.append(ids[np.argsort(-w[ids], kind="stable")] if len(ids) else ids)
    first = _ranked(buckets.where("lead").mapInArrow(_search(items, w, [1] * len(items), top), FOUND), top)
    beat = [1] * len(items)
    for r in first.where(F.col("rank") == top).collect():  # one row per item
        beat[r["query"]] = r["score"]
    lengths = [math.sqrt(float(w[i].sum())) * SLACK for i in items]
    shortest = min((b / n for b, n in zip(beat, lengths) if n), default=math.inf)
    needed = buckets.where(F.col("max_norm") >= F.lit(shortest))
    found = _ranked(needed.mapInArrow(_search(items, w, beat, top), FOUND), top)
    return stage(spark, found, "search-found")


def lexical_search(
    docs: DataFrame, items: DataFrame, *, top: int = 10, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``top`` best documents of every item."""
    spark = docs.sparkSession
    prepare(spark)
    narrow = docs.select(docs[doc_id].cast("bigint").alias("doc_id"), F.coalesce(docs[text].cast("string"), F.lit("")).alias("text"))
    kind = items.schema[item_id].dataType.simpleString()
    out = spark.createDataFrame([], f"item_id {kind}, rank int, doc_id bigint, score bigint")
    for block in _item_blocks(items, item_id, item_text):
        names = spark.createDataFrame([(q, name) for q, (name, _) in enumerate(block)], f"query int, item_id {kind}")
        found = _block_search(narrow, block, top).join(names, "query")
        out = out.unionByName(found.select("item_id", "rank", "doc_id", "score"))
    return out


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_TERMS = "regexp_extract_all(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+')"

OP12_SQL = f"""
WITH d AS (SELECT doc_id, {_TERMS.format("coalesce(text, '')")} AS t FROM documents),
total AS (SELECT count(*) AS docs, CAST(sum(len(t)) AS BIGINT) AS terms FROM d WHERE len(t) > 0),
q AS (SELECT DISTINCT item_id, t FROM (SELECT item_id, unnest({_TERMS.format("coalesce(text, '')")}) AS t FROM benchmark)),
tf AS (
  SELECT doc_id, t, n, count(*) AS tf FROM (SELECT doc_id, len(t) AS n, unnest(t) AS t FROM d)
  WHERE t IN (SELECT t FROM q) GROUP BY doc_id, t, n),
w AS (SELECT t, CAST(floor(1000 * ln((2 * docs + 2) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w
      FROM (SELECT t, count(*) AS df FROM tf GROUP BY t), total),
scores AS (
  SELECT item_id, doc_id, CAST(sum(w.w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // terms)))) AS BIGINT) AS score
  FROM tf JOIN q USING (t) JOIN w USING (t), total GROUP BY item_id, doc_id)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0)
WHERE rank <= 10"""

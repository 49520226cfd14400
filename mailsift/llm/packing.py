"""Best-fit packing into sequences of several permitted lengths.

* Pieces: a document of n tokens is cut into pieces of the largest permitted length
  and a rest; every piece keeps its place in the document.
* Best fit: pieces are taken in the order of falling length; a piece goes into the
  open bin with the least room that holds it.
* Opening: if no bin holds it, a new one is opened. For each permitted length
  that holds the piece, the cost of the bin is divided by the tokens it can
  expect: its length, or less where the pieces still to come that fit beside
  this one cannot fill it. The length with the least cost for a token is opened.
* Downsizing: at the end each bin gets the cheapest permitted length that holds its
  contents.

Pieces are dealt by a hash to groups of about ``group_pieces``; a group is packed by
one task, so the work of a task is bounded and the loss is at most a few partly
filled bins for each group. Only ids and lengths are moved.

Very long documents are cut into pieces. The length of a document is given by a column, or is its number of words and one end
token; it is at least 1, so null and empty texts make a piece of one token. Equal
rows are packed one by one: they are counted first and numbered as copies, which
also spreads many of them over all groups. A null id is kept. An empty table gives
an empty result. Only the named columns are read.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import prepare, stage, table, words

#: Permitted sequence lengths.
CAPACITIES = (512, 1024, 2048, 4096)


def cost(capacity: int) -> float:
    """Work for one sequence: a part for each token, and attention over all pairs."""
    return capacity * (1 + capacity / 16384)


class Bins:
    """Open bins by the room that is left; a bit of ``rooms`` tells which rooms occur."""

    def __init__(self):
        self.by_room: dict[int, list[int]] = {}
        self.rooms = 0

    def put(self, bin_: int, room: int) -> None:
        if room:
            self.by_room.setdefault(room, []).append(bin_)
            self.rooms |= 1 << room

    def take(self, size: int) -> tuple[int, int] | None:
        """The bin with the least room of at least ``size``; of several the last one put."""
        above = self.rooms >> size
        if not above:
            return None
        room = size + (above & -above).bit_length() - 1
        found = self.by_room[room]
        bin_ = found.pop()
        if not found:
            self.rooms &= ~(1 << room)
        return bin_, room


def pack(sizes: list[int], capacities: tuple[int, ...] = CAPACITIES, cost=cost) -> tuple[list[int], list[int], list[int]]:
    """(bin of each piece, its place in the bin, length of each bin). ``sizes`` fall."""
    largest = max(capacities)
    waiting = [0] * (largest + 1)  # pieces of each size that are still to come
    for s in sizes:
        waiting[s] += 1
    tokens = [0] * (largest + 2)  # Fenwick tree over size: tokens still to come
    for s, n in enumerate(waiting):
        i = s
        while n and 0 < i <= largest:
            tokens[i] += s * n
            i += i & -i

    def to_come(most: int) -> int:
        total = 0
        while most > 0:
            total += tokens[most]
            most -= most & -most
        return total

    open_, where, place, fill, opened = Bins(), [], [], [], []
    for s in sizes:
        i = s
        while i <= largest:
            tokens[i] -= s
            i += i & -i
        got = open_.take(s)
        if got is None:
            expected = {c: min(c, s + to_come(min(s, c - s))) for c in capacities if c >= s}
            best = min(expected, key=lambda c: (cost(c) / expected[c], c))
            fill.append(0)
            opened.append(best)
            got = len(fill) - 1, best
        bin_, room = got
        where.append(bin_)
        place.append(fill[bin_])
        fill[bin_] += s
        open_.put(bin_, room - s)
    final = [min((c for c in capacities if c >= f), key=lambda c: (cost(c), c)) for f in fill]
    return where, place, final


PACKED = "doc_id bigint, piece int, start bigint, n_tokens int, bin_id bigint, bin_offset int, capacity int"


def _pack_group(capacities: tuple[int, ...]):
    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("n_tokens", "descending"), ("doc_id", "ascending"), ("tie", "ascending"), ("copy", "ascending"), ("piece", "ascending")])
        where, place, final = pack(rows.column("n_tokens").to_pylist(), capacities)
        first = rows.column("group")[0].as_py() << 32
        return pa.table({
            "doc_id": rows.column("doc_id"), "piece": rows.column("piece"), "start": rows.column("start"), "n_tokens": rows.column("n_tokens"),
            "bin_id": pa.array([first + b for b in where], pa.int64()), "bin_offset": pa.array(place, pa.int32()),
            "capacity": pa.array([final[b] for b in where], pa.int32()),
        })

    return run


def _word_count(texts: pa.Array) -> pa.Array:
    return pa.array([len(words(t)) + 1 if t else 1 for t in texts.to_pylist()], pa.int64())


def best_fit(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", length: Column | None = None,
    capacities: tuple[int, ...] = CAPACITIES, group_pieces: int = 20_000,
) -> DataFrame:
    """One row for each piece: where it lies in its document (``piece, start, n_tokens``) and
    in its sequence (``bin_id, bin_offset, capacity``)."""
    prepare(docs.sparkSession)
    body = docs[text].cast("string")
    counted = F.arrow_udf(_word_count, T.LongType())(body) if length is None else F.greatest(F.coalesce(length.cast("bigint"), F.lit(1)), F.lit(1))
    rows = docs.select(docs[doc_id].cast("bigint").alias("doc_id"), F.xxhash64(body).alias("tie"), counted.alias("n"))
    rows = stage(docs.sparkSession, rows.groupBy("doc_id", "tie", "n").agg(F.count(F.lit(1)).alias("copies")), "lengths")
    largest = max(capacities)
    cut = F.ceil(F.col("n") / largest)
    total = rows.agg(F.sum(cut * F.col("copies"))).first()[0] or 0
    groups = max(1, math.ceil(total / group_pieces))
    pieces = (
        rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
        .withColumn("piece", F.explode(F.sequence(F.lit(0), (cut - 1).cast("int"))))
        .withColumn("start", F.col("piece").cast("bigint") * largest)
        .withColumn("n_tokens", F.least(F.lit(largest), F.col("n") - F.col("start")).cast("int"))
        .withColumn("group", F.pmod(F.xxhash64("doc_id", "tie", "copy", "piece"), F.lit(groups)))
        .select("group", "doc_id", "tie", "copy", "piece", "start", "n_tokens")
    )
    return pieces.groupBy("group").applyInArrow(_pack_group(tuple(sorted(capacities))), PACKED)


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit(table(spark, sf_dir, "documents").select("doc_id", "text"))

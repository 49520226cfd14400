"""Benchmark decontamination by q-gram lemma filtering.

A document is contaminated by a benchmark item when some stretch of it equals the
item but for ``edit_share`` of the item's characters (insertions, deletions,
substitutions), case and everything that is neither letter nor digit aside.

* Filter: a stretch within e edits of an item of m characters shares at least
  m + 1 - q (e + 1) of the item's q-grams, and these lie on e + 1 neighbouring
  diagonals (place in the document less place in the item). Shared q-grams are
  counted, each once, in bands of 2 (e + 1) diagonals that overlap by half, so any such
  neighbourhood lies within one band; bands that reach the bound are retained.
* Verification: an alignment within the retained band finds the furthest point on
  each diagonal for 0, 1, 2, ... edits, until the item is used up or the budget is.

The filter is exact: it loses no match. An item for which the bound would not be
positive has grams of its own, shorter length, down to the whole item where the budget
is 0; so an item of a few characters matches wherever these stand, inside words too.

The items are the stated query set: they are taken in blocks of bounded size, and
each block, as a sorted table of q-grams, is broadcast and meets all documents in
place. Texts are never shuffled; a hot item costs no more than others.

Null texts and items, and items without letter or digit, match nothing; repeated items are one if their ids are equal
and separate otherwise; repeated documents are judged one by one. Very long texts are searched whole, band by band. Empty tables give
uncontaminated or no rows. Columns of the documents pass through and may have any
name: the matches are in one array column.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import prepare, table

#: Characters of items in one block.
BLOCK_CHARS = 1 << 20

#: Characters of documents that are filtered together.
CHUNK_CHARS = 1 << 20

#: Pairs of equal q-grams (place in the text, place in an item) that are held at once.
PAIRS = 1 << 21

_WORD = re.compile(r"[^\W_]+")
_BASE = 0x9E3779B97F4A7C15 | 1
_FILTER_BITS = 22


def normal(text: str) -> str:
    """Lower-case words of letters and digits, one space apart."""
    return " ".join(_WORD.findall(text)).lower()


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def gram_hashes(values: np.ndarray, q: int) -> np.ndarray:
    """A 64-bit hash of the q values from each place on; pieces of doubling length are put together."""
    if len(values) < q:
        return np.zeros(0, np.uint64)
    piece, length, power = values.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93), 1, _BASE
    piece ^= piece >> np.uint64(31)
    out, done = None, 0
    while True:
        if q & length:
            if out is None:
                out = piece[: len(values) - length + 1]
            else:
                n = len(values) - done - length + 1
                out = out[:n] * np.uint64(power) + piece[done : done + n]
            done += length
        if done == q:
            out = out ^ (out >> np.uint64(29))
            return out * np.uint64(0xBF58476D1CE4E5B9)
        n = len(piece) - length
        piece = piece[:n] * np.uint64(power) + piece[length : length + n]
        length, power = 2 * length, power * power & 0xFFFFFFFFFFFFFFFF


class Items:
    """A block of items and its q-gram table."""

    def __init__(self, items: list[tuple[int, str]], q: int, edit_share: float):
        usable = [(i, t) for i, t in ((i, normal(t)) for i, t in items) if t]
        self.ids, self.texts = [i for i, _ in usable], [t for _, t in usable]
        size = np.array([len(t) for t in self.texts], np.int64)
        self.budget = np.maximum(0, np.minimum((size * edit_share).astype(np.int64), size - 1))
        own = np.minimum(q, size // (self.budget + 1))
        self.bound = size + 1 - own * (self.budget + 1)
        self.seen = np.zeros(1 << _FILTER_BITS, bool)
        #: For each length of grams: the grams, the first row of each, and the rows' items and places.
        self.tables = {int(n): self._table(int(n), np.flatnonzero(own == n)) for n in np.unique(own)}

    def _table(self, q: int, members: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        grams = [gram_hashes(codes(self.texts[n]), q) for n in members]
        size = [len(h) for h in grams]
        every = np.concatenate(grams)
        order = np.argsort(every, kind="stable")
        item = np.repeat(members.astype(np.int32), size)[order]
        place = np.concatenate([np.arange(n, dtype=np.int32) for n in size])[order]
        grams, first = np.unique(every[order], return_index=True)
        self.seen[(grams >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True
        return grams, np.append(first, len(every)), item, place

    def bands(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(item, first diagonal) of the bands of a text that reach the item's bound."""
        found = [self._bands(values, q, *t) for q, t in self.tables.items()]
        return np.concatenate([np.zeros(0, np.int64), *[f[0] for f in found]]), np.concatenate([np.zeros(0, np.int64), *[f[1] for f in found]])

    def _bands(self, values: np.ndarray, q: int, grams, first_row, items, places) -> tuple[np.ndarray, np.ndarray]:
        h = gram_hashes(values, q)
        at = np.flatnonzero(self.seen[(h >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)])
        if not len(at):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        k = np.minimum(np.searchsorted(grams, h[at]), len(grams) - 1)
        same = grams[k] == h[at]
        at, k = at[same], k[same]
        n = first_row[k + 1] - first_row[k]
        longest = int(max(map(len, self.texts)))
        span = len(values) + longest + 2
        # each of the item's q-grams counts once in a band, however often the text repeats it
        once = np.zeros(0, np.int64)
        found = []
        for part in np.split(np.arange(len(n)), np.searchsorted(np.cumsum(n), np.arange(PAIRS, int(n.sum()), PAIRS))):
            m = n[part]
            row = np.repeat(first_row[k[part]] - np.concatenate([[0], np.cumsum(m)[:-1]]), m) + np.arange(int(m.sum()))
            item, place = items[row].astype(np.int64), places[row]
            band = (np.repeat(at[part], m) - place) // (self.budget[item] + 1)
            found.append(np.unique((item * (2 * span) + band + span) * longest + place))
        if found:
            once = found[0] if len(found) == 1 else np.unique(np.concatenate(found))
        if not len(once):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        kinds, counts = np.unique(once // longest, return_counts=True)
        # a band's hits are those of its two halves: the half it begins with and the next
        after = np.searchsorted(kinds, kinds + 1)
        joined = after < len(kinds)
        joined[joined] = kinds[after[joined]] == kinds[joined] + 1
        with_next = counts + np.where(joined, counts[np.minimum(after, len(kinds) - 1)], 0)
        item, band = kinds // (2 * span), kinds % (2 * span) - span
        enough = with_next >= self.bound[item]
        before = np.searchsorted(kinds, kinds - 1)
        alone = (before >= len(kinds)) | (kinds[np.minimum(before, len(kinds) - 1)] != kinds - 1)
        earlier = alone & (counts >= self.bound[item])  # a band whose first half is empty
        item = np.concatenate([item[enough], item[earlier]])
        first = np.concatenate([band[enough], band[earlier] - 1])
        return item, first * (self.budget[item] + 1)


def _common(a: str, i: int, b: str, j: int) -> int:
    """Length of the common beginning of a[i:] and b[j:]."""
    most = min(len(a) - i, len(b) - j)
    if most <= 0:
        return 0
    n, step = 0, 16
    while n < most:
        step = min(step, most - n)
        if a[i + n : i + n + step] == b[j + n : j + n + step]:
            n += step
            step *= 2
        elif step == 1:
            return n
        else:
            step //= 2
    return n


def align(item: str, text: str, low: int, high: int, budget: int) -> tuple[int, int, int] | None:
    """(edits, start, end) of a stretch of ``text`` within ``budget`` edits of ``item`` on
    the diagonals ``low`` to ``high``, with the fewest edits; None if there is none.
    The start is the place where the stretch's first diagonal begins."""
    low, high = max(low, -budget), min(high, len(text))
    m, far = len(item), -(1 << 60)
    reach: dict[int, tuple[int, int]] = {}
    for d in range(max(0, low), high + 1):
        reach[d] = (_common(item, 0, text, d), d)
        if reach[d][0] == m:
            return 0, d, d + m
    for edits in range(1, budget + 1):
        now: dict[int, tuple[int, int]] = {}
        for d in range(low, high + 1):
            options = []
            if d in reach:
                options.append((reach[d][0] + 1, reach[d][1]))
            if d - 1 in reach:
                options.append(reach[d - 1])
            if d + 1 in reach:
                options.append((reach[d + 1][0] + 1, reach[d + 1][1]))
            if not options:
                continue
            j, start = max(options, key=lambda x: (x[0], -x[1]))
            j = min(j, m)
            if j + d > len(text) or j + d < 0:
                j = min(j, len(text) - d)
                if j < 0:
                    continue
            if j > far:
                j += _common(item, j, text, j + d)
            now[d] = (j, start)
            if j == m:
                return edits, start, j + d
        reach = now
    return None


def matches(items: Items, texts: list[str | None]) -> list[list[tuple[int, int, int, int]]]:
    """For each text its (item id, edits, start, end), at most one for each item: the one
    with the fewest edits, then the first. Start and end are places in the text, at
    the borders of words."""
    out: list[list[tuple[int, int, int, int]]] = [[] for _ in texts]
    if not items.ids:
        return out
    group: list[tuple[int, str]] = []
    size = 0
    for n, text in enumerate(texts):
        if text:
            group.append((n, normal(text)))
            size += len(group[-1][1]) + 1
        if size >= CHUNK_CHARS:
            _match_group(items, texts, group, out)
            group, size = [], 0
    _match_group(items, texts, group, out)
    return out


def _match_group(items: Items, texts, group, out) -> None:
    """Filter several texts at once; between two stands a sign that no text has."""
    if not group:
        return
    whole = codes("\n".join(t for _, t in group))
    begins = np.concatenate([[0], np.cumsum([len(t) + 1 for _, t in group])])
    item, first = items.bands(whole)
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    known: dict[tuple[int, str, int], tuple[int, int, int] | None] = {}  # repetitive texts ask the same again
    for k, low in zip(item.tolist(), first.tolist()):
        budget, size = int(items.budget[k]), len(items.texts[k])
        high = low + 2 * (budget + 1) - 1
        # the texts that the band touches: two where it lies across their border
        a = max(0, int(np.searchsorted(begins, low, side="right")) - 1)
        z = min(len(group) - 1, int(np.searchsorted(begins, high + size, side="right")) - 1)
        for g in range(a, z + 1):
            begin = int(begins[g])
            have = best.get((g, k))
            if have and have[0] == 0 and have[1] <= low - begin:
                continue  # nothing better can follow
            left = max(0, low - begin)
            window = group[g][1][left : max(left, high - begin + size)]
            ask = (k, window, low - begin - left)
            if ask not in known:
                known[ask] = align(items.texts[k], window, low - begin - left, high - begin - left, budget)
            got = known[ask]
            if got:
                got = (got[0], got[1] + left, got[2] + left)
                if got < best.get((g, k), (budget + 1, 0, 0)):
                    best[g, k] = got
    for (g, k), (edits, start, end) in sorted(best.items()):
        n, norm = group[g]
        spans = [m.span() for m in _WORD.finditer(texts[n])]
        first_word = norm.count(" ", 0, start + 1)
        last_word = norm.count(" ", 0, max(start, end - 1))
        out[n].append((items.ids[k], edits, spans[first_word][0], spans[min(last_word, len(spans) - 1)][1]))


MATCHES = T.ArrayType(
    T.StructType([T.StructField("item_id", T.LongType()), T.StructField("edits", T.IntegerType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
)
_MATCHES = pa.list_(pa.struct([("item_id", pa.int64()), ("edits", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))


def _blocks_of_items(benchmark: DataFrame, item_id: str, text: str):
    """Items in blocks of about ``BLOCK_CHARS`` characters, one block at a time."""
    rows = benchmark.select(benchmark[item_id].cast("bigint").alias("i"), benchmark[text].cast("string").alias("t"))
    rows = rows.filter("t IS NOT NULL").distinct().orderBy("i", "t")
    block, size = [], 0
    for r in rows.toLocalIterator():
        block.append((r["i"], r["t"]))
        size += len(r["t"])
        if size >= BLOCK_CHARS:
            yield block
            block, size = [], 0
    if block:
        yield block


def _finder(items):
    """Matches of one block of items, which is a broadcast variable."""

    def run(texts: pa.Array) -> pa.Array:
        got = matches(items.value, texts.to_pylist())
        names = ("item_id", "edits", "start", "end")
        return pa.array([[dict(zip(names, m)) for m in row] for row in got], _MATCHES)

    return run


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text",
    q: int = 8, edit_share: float = 0.1,
) -> DataFrame:
    """``docs`` with an array column ``benchmark_matches``: the items that each document holds."""
    prepare(docs.sparkSession)
    sc = docs.sparkSession.sparkContext
    found = []
    for block in _blocks_of_items(benchmark, item_id, item_text):
        find = _finder(sc.broadcast(Items(block, q, edit_share)))
        found.append(F.arrow_udf(find, MATCHES)(docs[text].cast("string")))
    every = F.flatten(F.array(*found)) if found else F.array().cast(MATCHES)
    row = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), every.alias("benchmark_matches"))
    return row.select("row.*", "benchmark_matches")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    got = decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return got.select("doc_id", (F.size("benchmark_matches") > 0).alias("contaminated"), F.col("benchmark_matches.item_id").alias("item_ids"), "benchmark_matches")


def uncontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no benchmark item, with their own columns."""
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    at = {c: f"c{i}" for i, c in reversed(list(enumerate(docs.columns)))}
    got = decontaminate(plain, benchmark, text=at["text"])
    return got.filter(F.size("benchmark_matches") == 0).drop("benchmark_matches").toDF(*docs.columns)

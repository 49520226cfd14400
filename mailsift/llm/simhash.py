"""SimHash near-duplicates through a Gray-order hierarchical index.

* Fingerprint: the text is lower-cased (A-Z), cut into words, and its shingles of
  ``shingle`` words (repeats count) are hashed with XXH64, seed 42; a bit is set if
  it is set in over half of the hashes. Texts with fewer words are one shingle;
  texts without words, null ones too, have fingerprint 0.
* Index: the distinct fingerprints are sorted by Gray rank, so that neighbours
  share most bits, and cut into ranges of equal size. Consecutive fingerprints
  form leaf groups, these form upper nodes. A node holds the bits that all below
  it share (a mask and a pattern) less those that its parent holds already.
* Turns: two fingerprints that differ in ``max_bits`` bits agree on one of
  ``max_bits`` + 1 segments at least. The index is made once for each segment, with the
  fingerprints turned so that the segment comes first in the Gray order, and a
  search in it asks for an equal first segment. So a fingerprint visits one or
  two ranges a turn however many ranges there are; without the turns it would
  visit all ranges whose shared bits differ little, which are more the finer the cut.
* Search: a query goes down with the number of bits in which it differs so far; a
  child adds the differing bits of its own mask, and the whole group is dropped
  once the sum exceeds ``max_bits``. At the leaves the remaining bits decide.
* Distribution: the top of the tree has one leaf for each range (a mask, a pattern:
  as many a turn as there are shuffle partitions), is sent to all tasks, and tells
  which ranges a fingerprint must visit; each range searches its own part of the tree.
* Links: what a range finds becomes a spanning forest at once, at most one link
  for each fingerprint it has seen, so large groups never give all pairs. Groups
  over all ranges come from alternating large-star and small-star rounds, each
  written to the shared folder, until nothing changes.

Copies meet in one fingerprint before any search (partial counts first), and the
component is joined back to the documents on the fingerprint; a hot one is split
by the adaptive skew join. Null ids take no part in the smallest id of a group; a
group of null ids only has a null component. Repeated rows are kept. Very long texts are
shingled whole. An empty table gives an empty result. Only the named columns are looked at;
others may have any name.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import partitions, prepare, stage, table

#: Fingerprints of a leaf group, and children of an upper node.
LEAF, FAN = 16, 8

#: Pairs of queries and nodes held at once in a search.
FRONTIER = 1 << 20

_HASH = partial(xxhash.xxh64_intdigest, seed=42)


def shingles(text: str | None, n: int) -> list[bytes]:
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if len(words) <= n:
        return [b" ".join(words)] if words else []
    return list(map(b" ".join, zip(*(words[i:] for i in range(n)))))


def fingerprints(texts: list[str | None], n: int) -> np.ndarray:
    """One unsigned 64-bit fingerprint per text."""
    out = np.zeros(len(texts), np.uint64)
    for i, text in enumerate(texts):
        found = shingles(text, n)
        if not found:
            continue
        hashes = np.fromiter(map(_HASH, found), np.uint64, len(found))
        counts = np.zeros(64, np.int64)
        for j in range(0, len(hashes), 1 << 16):
            part = hashes[j : j + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
            counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out[i] = np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0]
    return out


def gray_rank(fp: np.ndarray) -> np.ndarray:
    """Place of each code in the reflected Gray sequence."""
    rank = fp.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class Tree:
    """Upper nodes over groups given by the AND and the OR of their members, in Gray order."""

    def __init__(self, ands: np.ndarray, ors: np.ndarray):
        levels = [(ands, ors)]
        while len(levels[-1][0]) > FAN:
            a, o = levels[-1]
            at = np.arange(0, len(a), FAN)
            levels.append((np.bitwise_and.reduceat(a, at), np.bitwise_or.reduceat(o, at)))
        self.levels = []  # from the top: residual mask, pattern
        above = np.zeros(len(levels[-1][0]), np.uint64)
        for depth, (a, o) in enumerate(reversed(levels)):
            shared = ~(a ^ o)
            if depth:
                above = np.repeat(self.shared, FAN)[: len(a)]
            self.levels.append((shared & ~above, a & shared))
            self.shared = shared

    def groups_near(self, queries: np.ndarray, max_bits: int, equal: int = 0):
        """(query, group, bits that differ so far) for all groups that may hold a match
        which differs in none of the bits ``equal``, a bounded number at a time."""
        top = len(self.levels[0][0])
        for i in range(0, len(queries), max(1, FRONTIER // max(1, top * FAN))):
            part = np.arange(i, min(len(queries), i + max(1, FRONTIER // max(1, top * FAN))))
            q, node = np.repeat(part, top), np.tile(np.arange(top), len(part))
            yield from self._descend(queries, q, node, np.zeros(len(q), np.uint8), 0, max_bits, np.uint64(equal))

    def _descend(self, queries, q, node, bits, depth, max_bits, equal):
        mask, pattern = self.levels[depth]
        differ = (queries[q] ^ pattern[node]) & mask[node]
        bits = bits + np.bitwise_count(differ)
        near = (bits <= max_bits) & (differ & equal == 0)
        q, node, bits = q[near], node[near], bits[near]
        if not len(q):
            return
        if depth + 1 == len(self.levels):
            yield q, node, bits
            return
        below = len(self.levels[depth + 1][0])
        for i in range(0, len(q), FRONTIER // FAN):
            s = slice(i, i + FRONTIER // FAN)
            children = node[s, None] * FAN + np.arange(FAN)
            real = children < below
            again = np.broadcast_to(q[s, None], children.shape)[real]
            yield from self._descend(queries, again, children[real], np.broadcast_to(bits[s, None], real.shape)[real], depth + 1, max_bits, equal)


class GrayIndex:
    """Hierarchical index of distinct fingerprints."""

    def __init__(self, fps: np.ndarray):
        self.fps = fps[np.argsort(gray_rank(fps))]
        at = np.arange(0, len(fps), LEAF)
        self.tree = Tree(np.bitwise_and.reduceat(self.fps, at), np.bitwise_or.reduceat(self.fps, at))

    def near(self, queries: np.ndarray, max_bits: int, equal: int = 0):
        """(query position, fingerprint) of all pairs that differ in ``max_bits`` or fewer and
        in none of the bits ``equal``, in parts."""
        rest = ~self.tree.shared
        for q, leaf, bits in self.tree.groups_near(queries, max_bits, equal):
            for i in range(0, len(q), FRONTIER // LEAF):
                s = slice(i, i + FRONTIER // LEAF)
                member = leaf[s, None] * LEAF + np.arange(LEAF)
                real = member < len(self.fps)
                member = np.minimum(member, len(self.fps) - 1)
                differ = (queries[q[s], None] ^ self.fps[member]) & rest[leaf[s], None]
                hit = real & (bits[s, None] + np.bitwise_count(differ) <= max_bits) & (differ & np.uint64(equal) == 0)
                yield np.broadcast_to(q[s, None], hit.shape)[hit], self.fps[member[hit]]


class Forest:
    """Groups of 0 .. n-1 under links that arrive in parts; a group is named by its smallest member."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            ra, rb = self.root[a], self.root[b]
            apart = ra != rb
            if not apart.any():
                return
            a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
            np.minimum.at(self.root, np.maximum(ra, rb), np.minimum(ra, rb))
            while True:
                up = self.root[self.root]
                if np.array_equal(up, self.root):
                    break
                self.root = up


def _unsigned(values) -> np.ndarray:
    return np.ascontiguousarray(values, np.int64).view(np.uint64)


def _signed(values: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(values, np.uint64).view(np.int64), pa.int64())


def segments(max_bits: int) -> list[tuple[int, int]]:
    """For each turn: how far to turn left, and the bits that are then the first segment."""
    n = max_bits + 1
    cuts = [i * 64 // n for i in range(n + 1)]
    return [(a, ((1 << (b - a)) - 1) << (64 - (b - a))) for a, b in zip(cuts, cuts[1:])]


def turn(fps: np.ndarray, by: int) -> np.ndarray:
    return (fps << np.uint64(by)) | (fps >> np.uint64(64 - by)) if by else fps


def _ordered(fps: np.ndarray) -> np.ndarray:
    """Gray ranks as signed integers in the same order."""
    return (gray_rank(fps) ^ np.uint64(1 << 63)).view(np.int64)


def _ranks(turns: list[tuple[int, int]]):
    def run(batches):
        for b in batches:
            fps = _unsigned(b.column("fp").to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([pa.array(_ordered(turn(fps, by))) for by, _ in turns], [f"r{i}" for i in range(len(turns))])

    return run


def _numbered(turns: list[tuple[int, int]], splitters: list[list[int]]):
    """(turn, range, turned fingerprint) of each fingerprint."""

    def run(batches):
        for b in batches:
            fps = _unsigned(b.column("fp").to_numpy(zero_copy_only=False))
            for n, (by, _) in enumerate(turns):
                turned = turn(fps, by)
                place = np.searchsorted(np.array(splitters[n], np.int64), _ordered(turned), side="right")
                yield pa.RecordBatch.from_pydict({"turn": pa.array(np.full(len(fps), n), pa.int32()), "range": pa.array(place, pa.int64()), "fp": _signed(turned)})

    return run


def _visits(turns: list[tuple[int, int]], splitters: list[list[int]], roots: list[list[tuple[int, int, int]]], max_bits: int):
    """Each turned fingerprint for its own range and for the later ranges that it must visit."""

    def run(batches):
        number = _numbered(turns, splitters)
        ranges = [np.array([r[0] for r in top], np.int64) for top in roots]
        trees = [Tree(_unsigned([r[1] for r in top]), _unsigned([r[2] for r in top])) for top in roots]
        for b in number(batches):
            if not b.num_rows:
                continue
            n = b.column("turn")[0].as_py()
            fps = _unsigned(b.column("fp").to_numpy())
            own = b.column("range").to_numpy()
            for q, node, _ in trees[n].groups_near(fps, max_bits, turns[n][1]):
                to = ranges[n][node]
                later = to >= own[q]
                if later.any():
                    q, to = q[later], to[later]
                    yield pa.RecordBatch.from_pydict({
                        "turn": pa.array(np.full(len(q), n), pa.int32()), "range": pa.array(to, pa.int64()), "fp": _signed(fps[q]), "own": pa.array(to == own[q]),
                    })

    return run


def _links(turns: list[tuple[int, int]], max_bits: int):
    """A spanning forest of the links of one range: fingerprint -> smallest of its group here."""

    def run(rows: pa.Table) -> pa.Table:
        fps = _unsigned(rows.column("fp").to_numpy())
        own = rows.column("own").to_numpy()
        by, first = turns[rows.column("turn")[0].as_py()]
        names = np.sort(fps)
        forest = Forest(len(names))
        if own.any():
            for q, found in GrayIndex(fps[own]).near(names, max_bits, first):
                other = np.searchsorted(names, found)
                apart = other != q
                forest.link(q[apart], other[apart])
        linked = np.flatnonzero(forest.root != np.arange(len(names)))
        back = (64 - by) % 64
        return pa.table({"a": _signed(turn(names[linked], back)), "b": _signed(turn(names[forest.root[linked]], back))})

    return run


def components(links: DataFrame) -> DataFrame:
    """``fp, root`` of every fingerprint in ``links (a, b)``, root being one and the same for a group."""
    spark = links.sparkSession
    edges = stage(spark, links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "links")
    before = None
    while True:
        state = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x"), F.max(F.xxhash64("b", "a")).alias("m")).first()
        if not state["n"] or state == before:
            return edges.select(F.col("a").alias("fp"), F.col("b").alias("root"))
        before = state
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b")).distinct()
        large = stage(spark, large, "large-star")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        edges = stage(spark, small.filter("a <> b").distinct(), "small-star")


def near_groups(fps: DataFrame, max_bits: int) -> DataFrame:
    """``fp, root`` of the distinct fingerprints ``fps (fp)`` that have a link."""
    spark = fps.sparkSession
    ranges, turns = partitions(spark), segments(max_bits)
    at = [i / ranges for i in range(1, ranges)]
    splitters: list[list[int]] = [[] for _ in turns]
    if at:
        ranks = fps.mapInArrow(_ranks(turns), ", ".join(f"r{i} bigint" for i in range(len(turns))))
        got = ranks.agg(*[F.percentile_approx(f"r{i}", at, 20 * ranges) for i in range(len(turns))]).first()
        splitters = [sorted(set(s or [])) for s in got]
    numbered = fps.mapInArrow(_numbered(turns, splitters), "turn int, range bigint, fp bigint")
    shared = numbered.groupBy("turn", "range").agg(F.bit_and("fp").alias("a"), F.bit_or("fp").alias("o"))
    roots: list[list[tuple[int, int, int]]] = [[] for _ in turns]
    for r in sorted(shared.collect()):
        roots[r["turn"]].append((r["range"], r["a"], r["o"]))
    if not roots[0]:
        return spark.createDataFrame([], "fp bigint, root bigint")
    visits = fps.mapInArrow(_visits(turns, splitters, roots, max_bits), "turn int, range bigint, fp bigint, own boolean")
    return components(visits.groupBy("turn", "range").applyInArrow(_links(turns, max_bits), "a bigint, b bigint"))


def fingerprint_table(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shingle: int = 3) -> DataFrame:
    """``doc_id, tie, fp`` of every row, staged; ``tie`` is a hash of the text."""

    def run(texts: pa.Array) -> pa.Array:
        return _signed(fingerprints(texts.to_pylist(), shingle))

    body = docs[text].cast("string")
    rows = docs.select(docs[doc_id].cast("bigint").alias("doc_id"), F.xxhash64(body).alias("tie"), F.arrow_udf(run, "bigint")(body).alias("fp"))
    return stage(docs.sparkSession, rows, "fingerprints")


def component_of_fingerprint(rows: DataFrame, max_bits: int) -> DataFrame:
    """``fp, component_id`` of every distinct fingerprint of ``rows (doc_id, fp)``."""
    spark = rows.sparkSession
    distinct = stage(spark, rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    roots = stage(spark, near_groups(distinct.select("fp"), max_bits), "fingerprint-groups")
    named = distinct.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    component = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return named.join(component, "root").select("fp", "component_id", "root")


def near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shingle: int = 3, max_bits: int = 2) -> DataFrame:
    """``doc_id, fingerprint, component_id`` of every row of ``docs``."""
    prepare(docs.sparkSession)
    rows = fingerprint_table(docs, doc_id=doc_id, text=text, shingle=shingle)
    groups = component_of_fingerprint(rows, max_bits).drop("root")
    hexed = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return rows.join(groups, "fp").select("doc_id", hexed.alias("fingerprint"), "component_id")


def one_of_each_group(docs: DataFrame, *, shingle: int = 3, max_bits: int = 2) -> DataFrame:
    """The documents without near-duplicates: of each group the row with the smallest
    id stays (a null id only if the group has no other; equal ids: the smallest
    hash of the text; equal rows: one)."""
    prepare(docs.sparkSession)
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    at = {c: f"c{i}" for i, c in reversed(list(enumerate(docs.columns)))}
    rows = fingerprint_table(plain, doc_id=at["doc_id"], text=at["text"], shingle=shingle)
    groups = component_of_fingerprint(rows, max_bits).select("fp", "root")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "tie"))
    kept = rows.join(groups, "fp").groupBy("root").agg(first.alias("k")).select(
        F.col("k.nameless").alias("k0"), F.coalesce("k.doc_id", F.lit(0)).alias("k1"), F.col("k.tie").alias("k2")
    )
    key = plain[at["doc_id"]].cast("bigint")
    keyed = plain.withColumns({"k0": key.isNull(), "k1": F.coalesce(key, F.lit(0)), "k2": F.xxhash64(plain[at["text"]].cast("string"))})
    out = keyed.join(kept, ["k0", "k1", "k2"], "left_semi").dropDuplicates(["k0", "k1", "k2"])
    return out.select(*plain.columns).toDF(*docs.columns)


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), shingle=3, max_bits=2)

"""Token-id shards with a minimal perfect hash index.

Files, all in one folder that the whole cluster shares:

* ``ids/`` - one raw payload per shard: the ids of its documents one after the
  other as little-endian unsigned integers of ``width`` bytes (2 where every id
  fits, else 4). Shards follow one another in ascending id order of the
  documents and so do the documents inside a shard (null ids first; equal ids in
  the order of a hash of the text). Each document ends with ``end_id``.
* ``index/`` - one file per index bucket. A bucket holds the keys with
  xxh64(key, seed 0) mod ``buckets`` of its number: a minimal perfect hash function
  over them and, at each key's slot, a 32-bit fingerprint and where the document
  lies: shard, first id in the shard, number of ids, ids of all documents before
  it, and how many documents have this key.
* ``shards`` and ``buckets`` tables (Parquet) name the files. Only named files
  count, so files of lost or repeated tasks do no harm.

The hash function is built level by level: a level has ``GAMMA`` bits per key that
is still without a slot, a key takes the bit of its hash unless another key
hashes there too, and keys that collide go on to the next level. The rank of a
key's bit among all set bits is its slot: n keys, slots 0 to n - 1, and a lookup
reads one bit for each level (1.6 on average) and one slot, whatever n is. A key
that is not in the index finds no set bit or, but for one in 2^32, a different
fingerprint. A bucket is built by one task from narrow rows; buckets follow the
number of documents.

Null texts are empty documents of one id. Documents with equal ids share a key:
the slot gives the first and the number of them, and the others follow it. A null
id is a key of its own. Very long texts are encoded whole. An empty table gives no shards and
empty results. Columns that are not named are never looked at, whatever their names.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from . import blobs, pretoken
from .common import partitions, prepare, shards_for, table

GAMMA = 2.0

#: Text for which there is one shard, and documents for which there is one bucket.
SHARD_BYTES, BUCKET_KEYS = 32 << 20, 200_000
MAGIC = b"MPHI0001"

#: Slots of the index.
SLOT = np.dtype([("fingerprint", "<u4"), ("shard", "<u4"), ("first", "<u8"), ("n_ids", "<u8"), ("before", "<u8"), ("copies", "<u8")])


def key_bytes(doc_id: int | None) -> bytes:
    return b"" if doc_id is None else struct.pack("<q", doc_id)


def bucket_of(key: bytes, buckets: int) -> int:
    return xxhash.xxh64_intdigest(key, 0) % buckets


def fingerprint(key: bytes) -> int:
    return xxhash.xxh32_intdigest(key, 0x9E3779B9)


class PerfectHash:
    """Minimal perfect hash function over distinct byte keys."""

    def __init__(self, sizes: list[int], bits: list[np.ndarray], ranks: list[np.ndarray]):
        self.sizes, self.bits, self.ranks = sizes, bits, ranks

    @classmethod
    def build(cls, keys: list[bytes]) -> tuple[PerfectHash, np.ndarray]:
        """The function, and the slot of each key."""
        sizes, bits, ranks = [], [], []
        slots = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        taken = 0
        while len(left):
            level = len(sizes)
            size = max(64, -(-int(GAMMA * len(left)) // 64) * 64)
            at = np.fromiter((xxhash.xxh64_intdigest(keys[i], level + 1) % size for i in left), np.int64, len(left))
            own = np.bincount(at, minlength=size)[at] == 1
            flags = np.zeros(size, np.uint8)
            flags[at[own]] = 1
            words = np.packbits(flags, bitorder="little").view("<u8")
            rank = np.zeros(len(words) + 1, np.uint64)
            np.cumsum(np.bitwise_count(words), out=rank[1:])
            rank += np.uint64(taken)
            order = np.cumsum(flags) - 1
            slots[left[own]] = taken + order[at[own]]
            taken += int(flags.sum())
            left = left[~own]
            sizes.append(size)
            bits.append(words)
            ranks.append(rank[:-1])
        return cls(sizes, bits, ranks), slots

    def slot(self, key: bytes) -> int | None:
        for level, size in enumerate(self.sizes):
            at = xxhash.xxh64_intdigest(key, level + 1) % size
            word = int(self.bits[level][at >> 6])
            if word >> (at & 63) & 1:
                return int(self.ranks[level][at >> 6]) + (word & ((1 << (at & 63)) - 1)).bit_count()
        return None


def index_bytes(keys: list[bytes], rows: np.ndarray) -> Iterator[bytes]:
    """An index file: header, levels, slots. ``rows`` are ``SLOT`` rows in key order."""
    f, slots = PerfectHash.build(keys)
    placed = np.zeros(len(keys), SLOT)
    placed[slots] = rows
    yield MAGIC + struct.pack("<QQ", len(keys), len(f.sizes)) + struct.pack(f"<{len(f.sizes)}Q", *f.sizes)
    for words, rank in zip(f.bits, f.ranks):
        yield words.astype("<u8").tobytes()
        yield rank.astype("<u8").tobytes()
    yield placed.tobytes()


class Index:
    """An index file, mapped; constant work for each lookup."""

    def __init__(self, uri: str):
        data = blobs.mapped(uri)
        head = memoryview(data)
        if bytes(head[:8]) != MAGIC:
            raise ValueError(f"{uri} is not an index file")
        n, levels = struct.unpack_from("<QQ", head, 8)
        sizes = list(struct.unpack_from(f"<{levels}Q", head, 24))
        at, bits, ranks = 24 + 8 * levels, [], []
        for size in sizes:
            for into in (bits, ranks):
                into.append(np.frombuffer(data, "<u8", size // 64, at))
                at += size // 8
        self.hash = PerfectHash(sizes, bits, ranks)
        self.slots = np.frombuffer(data, SLOT, n, at)

    def get(self, key: bytes) -> np.void | None:
        slot = self.hash.slot(key)
        if slot is None:
            return None
        row = self.slots[slot]
        return row if row["fingerprint"] == fingerprint(key) else None


@dataclass(frozen=True)
class Store:
    """A finished set of files."""

    folder: str
    width: int
    buckets: int

    def shards(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.folder}/shards")

    def index_files(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.folder}/buckets")


def _write_shard(folder: str, tokenizer: str, end: bytes, width: int):
    """Encode a partition, which is one shard, into one payload file."""

    def run(batches: Iterable[pa.RecordBatch]):
        ids = pretoken.piece_ids(tokenizer, width)
        out, uri, at = None, None, 0
        for b in batches:
            rows, firsts, counts = b.column("doc_id"), [], []
            for text in b.column("text").to_pylist():
                payload = ids.encode(text) + end if text else end
                if out is None:
                    uri = blobs.fresh(f"{folder}/ids", "shard", ".ids")
                    out = blobs.create(uri)
                out.write(payload)
                firsts.append(at)
                counts.append(len(payload) // width)
                at += counts[-1]
            yield pa.RecordBatch.from_pydict({
                "part": pa.array([_part()] * b.num_rows, pa.int32()), "file": pa.array([uri] * b.num_rows, pa.string()),
                "doc_id": rows, "first": pa.array(firsts, pa.int64()), "n_ids": pa.array(counts, pa.int64()),
            })
        if out is not None:
            out.close()

    return run


def _part() -> int:
    from pyspark import TaskContext

    return TaskContext.get().partitionId()


def _write_index(folder: str):
    """Build the index file of one bucket."""

    def run(rows: pa.Table) -> pa.Table:
        keys = [key_bytes(k) for k in rows.column("doc_id").to_pylist()]
        slots = np.zeros(len(keys), SLOT)
        slots["fingerprint"] = [fingerprint(k) for k in keys]
        for name in ("shard", "first", "n_ids", "before", "copies"):
            slots[name] = rows.column(name).to_numpy()
        uri = blobs.fresh(f"{folder}/index", "bucket", ".mph")
        with blobs.create(uri) as out:
            for part in index_bytes(keys, slots):
                out.write(part)
        return pa.table({"bucket": rows.column("bucket").slice(0, 1), "file": pa.array([uri], pa.string()), "n_keys": pa.array([len(keys)], pa.int64())})

    return run


def _bucket(buckets: int):
    @F.arrow_udf("int")
    def bucket(keys: pa.Array) -> pa.Array:
        return pa.array([bucket_of(key_bytes(k), buckets) for k in keys.to_pylist()], pa.int32())

    return bucket


def write_tokens(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", tokenizer: str | None = None,
    end_id: int = 0, shards: int | None = None, folder: str | None = None,
) -> Store:
    """Encode ``docs`` into shards and index them; returns the store.

    One shuffle moves the texts into id order. The position of a document is then
    known to its shard; the ids in earlier shards are added from the shards'
    totals (one row a shard). The index moves only keys and positions.
    """
    spark = docs.sparkSession
    prepare(spark)
    tokenizer = tokenizer or pretoken.default_path()
    splitter = pretoken.Splitter(tokenizer)
    width = 2 if max(splitter.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else 4
    end = end_id.to_bytes(width, "little")
    folder = folder or scratch_path(spark, "tokens")
    shards = shards or shards_for(docs, text, SHARD_BYTES, partitions(spark))

    rows = docs.select(docs[doc_id].cast("bigint").alias("doc_id"), docs[text].cast("string").alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text"))
    ordered = rows.repartitionByRange(shards, "doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    written = ordered.mapInArrow(_write_shard(folder, tokenizer, end, width), "part int, file string, doc_id bigint, first bigint, n_ids bigint")
    written.write.parquet(f"{folder}/documents")
    places = spark.read.parquet(f"{folder}/documents")

    totals = places.groupBy("part", "file").agg(F.sum("n_ids").alias("n_ids"), F.count(F.lit(1)).alias("n_documents")).orderBy("part").collect()
    buckets = max(partitions(spark), -(-sum(r["n_documents"] for r in totals) // BUCKET_KEYS))
    before, manifest = 0, []
    for k, r in enumerate(totals):
        manifest.append((r["part"], k, r["file"], r["n_documents"], r["n_ids"], before))
        before += r["n_ids"]
    schema = "part int, shard int, file string, n_documents bigint, n_ids bigint, before bigint"
    spark.createDataFrame(manifest, schema).coalesce(1).write.parquet(f"{folder}/shards")

    known = spark.read.parquet(f"{folder}/shards").select("part", "shard", "before")
    keyed = (
        places.join(known, "part")
        .select("doc_id", F.struct((F.col("before") + F.col("first")).alias("before"), "shard", "first", "n_ids").alias("place"))
        .groupBy("doc_id")
        .agg(F.min("place").alias("place"), F.count(F.lit(1)).alias("copies"))
        .select("doc_id", "place.*", "copies")
        .withColumn("bucket", _bucket(buckets)("doc_id"))
    )
    index = keyed.groupBy("bucket").applyInArrow(_write_index(folder), "bucket int, file string, n_keys bigint")
    index.write.parquet(f"{folder}/buckets")
    return Store(folder, width, buckets)


FOUND = "doc_id bigint, shard int, first bigint, n_ids bigint, before bigint, copies bigint"


def _look_up(left, keys: pa.Table, files: pa.Table) -> pa.Table:
    index = Index(files.column("file")[0].as_py()) if files.num_rows else None
    out = {n: [] for n in ("doc_id", "shard", "first", "n_ids", "before", "copies")}
    for k in keys.column("doc_id").to_pylist():
        row = index.get(key_bytes(k)) if index else None
        if row is not None:
            out["doc_id"].append(k)
            for n in ("shard", "first", "n_ids", "before", "copies"):
                out[n].append(int(row[n]))
    kinds = {"shard": pa.int32()}
    return pa.table({n: pa.array(v, kinds.get(n, pa.int64())) for n, v in out.items()})


def look_up(store: Store, keys: DataFrame, *, doc_id: str = "doc_id") -> DataFrame:
    """Where the documents of the distinct ``keys`` lie, through the index; keys without a
    document give no row."""
    spark = keys.sparkSession
    wanted = keys.select(keys[doc_id].cast("bigint").alias("doc_id")).distinct().withColumn("bucket", _bucket(store.buckets)("doc_id"))
    files = store.index_files(spark).select("bucket", "file")
    return wanted.groupBy("bucket").cogroup(files.groupBy("bucket")).applyInArrow(lambda k, a, b: _look_up(k, a, b), FOUND)


def _read(width: int):
    def run(batches):
        held, uri = None, None
        for b in batches:
            out = {"doc_id": [], "start": [], "n_tokens": [], "payload": []}
            for r in b.to_pylist():
                if r["file"] != uri:
                    if held is not None:
                        held.close()
                    held, uri = blobs.open_random(r["file"]), r["file"]
                held.seek(r["first"] * width)
                out["doc_id"].append(r["doc_id"])
                out["start"].append(r["before"])
                out["n_tokens"].append(r["n_ids"])
                out["payload"].append(held.read(r["n_ids"] * width))
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array(out["doc_id"], pa.int64()), "start": pa.array(out["start"], pa.int64()), "n_tokens": pa.array(out["n_tokens"], pa.int64()), "payload": pa.array(out["payload"], pa.binary())})

    return run


def read_tokens(store: Store, keys: DataFrame, *, doc_id: str = "doc_id") -> DataFrame:
    """``doc_id, start, n_tokens, payload`` of every document with one of the ``keys``.

    The index gives the first document of a key; the others with the same key
    are the next documents in id order, found in the shards' document lists.
    Documents are read shard by shard in the order of the payload."""
    spark = keys.sparkSession
    shards = store.shards(spark).select("part", "shard", "file", F.col("before").alias("base"))
    found = look_up(store, keys, doc_id=doc_id)
    single = found.filter("copies = 1").select("doc_id", "shard", "first", "n_ids", "before")
    several = found.filter("copies > 1").select("doc_id")
    lists = spark.read.parquet(f"{store.folder}/documents").join(shards, "part")
    rest = lists.join(several.withColumnRenamed("doc_id", "key"), F.col("doc_id").eqNullSafe(F.col("key")), "left_semi")
    rest = rest.select("doc_id", "shard", "first", "n_ids", (F.col("base") + F.col("first")).alias("before"))
    places = single.unionByName(rest).join(shards.select("shard", "file"), "shard")
    places = places.repartitionById(partitions(spark), "shard").sortWithinPartitions("shard", "first")
    return places.select("doc_id", "file", "first", "n_ids", "before").mapInArrow(
        _read(store.width), "doc_id bigint, start bigint, n_tokens bigint, payload binary"
    )


def _crc(width: int):
    @F.arrow_udf("bigint")
    def crc(payloads: pa.Array) -> pa.Array:
        return pa.array([zlib.crc32(np.frombuffer(p, f"<u{width}").astype("<u4")) for p in payloads.to_pylist()], pa.int64())

    return crc


def op1_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    store = write_tokens(docs)
    got = read_tokens(store, docs.select("doc_id"))
    return got.select("doc_id", "start", "n_tokens", _crc(store.width)("payload").alias("ids_crc32"))

"""Block dictionaries: the distinct items of a block of documents, dealt to shards.

Operators that need one fact for each distinct item (a pre-token, a word) do not
shuffle item occurrences. A task gathers consecutive documents into a block of
bounded size, numbers the block's distinct items, and sends each distinct item
once to the shard that owns it, packed with the others of that shard into one
row. The owner answers with one packed row for each block and shard, and joining
them by block gives the facts of all the block's items in order.

An item that occurs everywhere reaches its owner once per block, so no shard is
hot; a block holds at most ``BLOCK_BYTES`` of text, or one document.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 4 << 20


class Numbers(dict):
    """item -> 0, 1, 2, ... in the order of first use."""

    def __missing__(self, item):
        self[item] = n = len(self)
        return n


def number_of_block(k: int) -> int:
    """Unique over the tasks of a stage, the same when a task runs again."""
    from pyspark import TaskContext

    ctx = TaskContext.get()
    return ((ctx.partitionId() if ctx else 0) << 24) + k


def by_shard(items: list[bytes], shards: int) -> tuple[np.ndarray, list[tuple[int, list[bytes]]]]:
    """The items dealt to shards, and the renumbering under which the items of
    the shards follow one another: new number = renumber[old number]."""
    owner = np.fromiter((zlib.crc32(x) % shards for x in items), np.int64, len(items))
    order = np.argsort(owner, kind="stable")
    renumber = np.empty(len(items), np.uint32)
    renumber[order] = np.arange(len(items), dtype=np.uint32)
    cuts = np.flatnonzero(np.diff(owner[order])) + 1
    parts = [(int(owner[p[0]]), [items[i] for i in p]) for p in np.split(order, cuts) if len(p)]
    return renumber, parts


def batches_to_blocks(batches: Iterator[pa.RecordBatch], size_of, block_bytes: int = BLOCK_BYTES) -> Iterator[list[pa.RecordBatch]]:
    held: list[pa.RecordBatch] = []
    size = 0
    for b in batches:
        if b.num_rows:
            held.append(b)
            size += size_of(b)
        if size >= block_bytes:
            yield held
            held, size = [], 0
    if held:
        yield held


def offsets(lengths: np.ndarray) -> np.ndarray:
    out = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=out[1:])
    return out


def sums(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of the given lengths; empty runs give zero."""
    total = np.zeros(len(values) + 1, np.float64 if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=total[1:])
    at = offsets(lengths)
    return total[at[1:]] - total[at[:-1]]


def distinct(items: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The distinct items and, for each item, the position of its like."""
    coded = items.dictionary_encode()
    if isinstance(coded, pa.ChunkedArray):
        coded = coded.combine_chunks()
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)


def pack_items(items: list[bytes]) -> bytes:
    """Byte strings as one packed value: the JVM then moves one object, not one per item."""
    lengths = pack(np.fromiter(map(len, items), np.uint32, len(items)))
    body = b"".join(items)
    return len(lengths).to_bytes(8, "little") + lengths + len(body).to_bytes(8, "little") + pa.compress(body, "zstd", asbytes=True)


def pack_array(items: pa.Array) -> bytes:
    """``pack_items`` for a large_binary array without nulls."""
    at = np.frombuffer(items.buffers()[1], np.int64)[items.offset : items.offset + len(items) + 1]
    lengths = pack(np.diff(at).astype(np.uint32))
    body = items.buffers()[2].slice(at[0], at[-1] - at[0]) if at[-1] > at[0] else b""
    return len(lengths).to_bytes(8, "little") + lengths + int(at[-1] - at[0]).to_bytes(8, "little") + pa.compress(body, "zstd", asbytes=True)


def unpack_items(data: bytes) -> pa.Array:
    n = int.from_bytes(data[:8], "little")
    lengths = unpack(data[8 : 8 + n])
    size = int.from_bytes(data[8 + n : 16 + n], "little")
    body = pa.decompress(data[16 + n :], size, "zstd")
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(offsets(lengths)), body])


def pack(values: np.ndarray) -> bytes:
    """Unsigned 32-bit integers, byte plane by byte plane, compressed."""
    planes = np.ascontiguousarray(values, "<u4").view(np.uint8).reshape(-1, 4).T
    return len(values).to_bytes(8, "little") + pa.compress(planes.tobytes(), "zstd", asbytes=True)


def unpack(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    planes = np.frombuffer(pa.decompress(data[8:], 4 * n, "zstd", asbytes=True), np.uint8).reshape(4, n)
    return np.ascontiguousarray(planes.T).view("<u4").reshape(n)


def steps(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Within each run: the first value, then the differences (modulo 2^32)."""
    out = values.copy()
    out[1:] -= values[:-1]
    first = offsets(lengths)[:-1][np.asarray(lengths) > 0]
    out[first] = values[first]
    return out


def unsteps(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    lengths = np.asarray(lengths)
    total = np.cumsum(values, dtype=np.uint32)
    first = offsets(lengths)[:-1][lengths > 0]
    base = total[first] - values[first]
    return total - np.repeat(base, lengths[lengths > 0])


def pack64(values: np.ndarray) -> bytes:
    return pack(np.ascontiguousarray(values, "<u8").view("<u4"))


def unpack64(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(unpack(data)).view("<u8")

"""Files written and read by tasks in the shared folder.

Tasks write under names of their own (partition, attempt, random part) and
return the names as rows; a file exists for readers only once Spark has
committed the row that names it, so retried or speculative attempts leave
unreferenced files and never half-written ones that count.
"""

from __future__ import annotations

import uuid

import pyarrow as pa
import pyarrow.fs as pafs


def _open(uri: str):
    if "://" not in uri and not uri.startswith("file:"):
        return pafs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return pafs.FileSystem.from_uri(uri)


def fresh(folder: str, stem: str, suffix: str) -> str:
    from pyspark import TaskContext

    ctx = TaskContext.get()
    part = ctx.partitionId() if ctx else 0
    return f"{folder}/{stem}-{part:05d}-{uuid.uuid4().hex[:12]}{suffix}"


def create(uri: str):
    """An output stream; parent folders are made."""
    fs, path = _open(uri)
    fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
    return fs.open_output_stream(path, compression=None)


def open_random(uri: str):
    """A random-access file: memory-mapped where the folder is a local mount."""
    fs, path = _open(uri)
    if isinstance(fs, pafs.LocalFileSystem):
        return pa.memory_map(path, "r")
    return fs.open_input_file(path)


def mapped(uri: str) -> pa.Buffer:
    """The whole file as a buffer, without copying it where it can be mapped."""
    with open_random(uri) as f:
        return f.read_buffer(f.size())

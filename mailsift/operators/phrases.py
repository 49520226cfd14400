"""Large phrase tables (P9, P10): thousands of phrases found in one pass over the text.

An Aho-Corasick automaton holds a block of the table, so the work on a text hardly depends on the
number of phrases. Blocks hold ``BLOCK_CHARS`` characters - the bound of what is sent to the tasks and of what
a worker holds - and a larger table costs one more written pass for each further block.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.redact import in_slices
from ..session import importable, small_batches
from .store import stage

BLOCK_CHARS = 1 << 22

HITS = "row struct<{0}>, hits array<int>"


def phrase_blocks(phrases: DataFrame, phrase: str = "phrase") -> Iterator[list[str]]:
    """The distinct lower-cased phrases in blocks; null and empty ones match nothing."""
    low = phrases.select(F.lower(phrase).alias("p")).where("p <> ''").distinct().orderBy("p")
    block, size = [], 0
    for r in low.toLocalIterator():
        block.append(r["p"])
        size += len(r["p"])
        if size >= BLOCK_CHARS:
            yield block
            block, size = [], 0
    if block:
        yield block


def _finder(block: list[str]):
    built: list = []  # once per task

    def find(texts: pa.Array) -> pa.Array:
        if not built:
            a = ahocorasick.Automaton()
            for p in block:
                a.add_word(p, p)
            a.make_automaton()
            built.append(a)
        return pa.array([sorted({p for _, p in built[0].iter(t)}) if t else [] for t in texts.to_pylist()], pa.list_(pa.string()))

    return F.arrow_udf(in_slices(find), "array<string>")


def table_hits(df: DataFrame, text: str, phrases: DataFrame, *, phrase: str = "phrase", into: str = "phrases") -> DataFrame:
    """``df`` with a column of the phrases of a table that occur in ``text``, whatever the case; sorted, each
    once, empty where there is none. The same as testing each phrase with ``contains`` on lower-cased text."""
    importable(df.sparkSession)
    small_batches(df.sparkSession)
    low = F.lower(F.col(text))
    out = df.withColumn(into, F.array().cast("array<string>"))
    for n, block in enumerate(phrase_blocks(phrases, phrase)):
        if n and not out.isStreaming:  # else every worker would hold the automata of all blocks at once
            out = stage(out.sparkSession, out, "phrases")
        out = out.withColumn(into, F.concat(into, _finder(block)(low)))
    return out.withColumn(into, F.array_sort(into))

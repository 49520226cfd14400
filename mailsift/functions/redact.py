"""Sensitive-span detection and redaction.

Spans are ``struct<score double, type string, begin int, end int>`` with
half-open code-point offsets. Gate and sort are JVM-side expressions. Finding the
offsets of all matches and copying the text around them are Arrow functions: in
column expressions each match would cost a search through the text and a copy of the
spans so far, so that a log mail with thousands of addresses took seconds; here both are
linear in the text and its matches. Only the text and its spans go to the worker.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import schemas as S

# Built-in pattern detector: (type, score, pattern, guard). The patterns are
# context-free - no anchors, word boundaries or look-around - so every regex
# engine finds the same matches and a match's text locates the match. The
# guard is a literal every match contains; text without it skips the regex.
DETECTOR_PATTERNS = [
    ("EMAIL", 0.99, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "@"),
    ("PHONE", 0.95, r"\+[0-9]{1,2} \([0-9]{3}\) [0-9]{3}-[0-9]{4}", "+"),
    ("SSN", 0.95, r"[0-9]{3}-[0-9]{2}-[0-9]{4}", "-"),
    ("CREDIT_DEBIT_NUMBER", 0.9, r"[0-9]{4}[- ]?[0-9]{4}[- ]?[0-9]{4}[- ]?[0-9]{4}", None),
    ("IP_ADDRESS", 0.9, r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}", "."),
    ("PASSWORD", 0.8, r"[0-9a-f]{40}", None),
]


#: Rows of a batch that are Python objects at one time.
SLICE_ROWS = 100


def in_slices(function):
    """An Arrow function that works on a few rows after the other; only Arrow data is held for the whole batch."""

    def run(*arrays: pa.Array) -> pa.Array:
        starts = range(0, max(1, len(arrays[0])), SLICE_ROWS)
        return pa.concat_arrays([function(*(a.slice(i, SLICE_ROWS) for a in arrays)) for i in starts])

    return run


_SPANS = pa.list_(pa.struct([("score", pa.float64()), ("type", pa.string()), ("begin", pa.int32()), ("end", pa.int32())]))


def _finder(patterns: tuple):
    """Spans of every non-overlapping match of every pattern, left to right, in the
    order of the patterns."""

    def find(texts: pa.Array) -> pa.Array:
        compiled = [(t, score, re.compile(p), guard) for t, score, p, guard in patterns]
        out = []
        for text in texts.to_pylist():
            out.append(None if text is None else _spans_of(text, compiled))
        return pa.array(out, _SPANS)

    return find


def _spans_of(text: str, compiled: list) -> list[dict]:
    spans = []
    for kind, score, pattern, guard in compiled:
        if guard is None or guard in text:
            spans += [{"score": score, "type": kind, "begin": m.start(), "end": m.end()} for m in pattern.finditer(text)]
    return spans


def detect(text: Column | str, patterns=None) -> Column:
    """X2 built-in detector: ``array<entity>`` over all patterns (unsorted)."""
    patterns = tuple(DETECTOR_PATTERNS if patterns is None else patterns)
    return F.arrow_udf(in_slices(_finder(patterns)), S.ENTITIES)(F.col(text) if isinstance(text, str) else text)


def gate(entities: Column, threshold: float = S.PII_SCORE_THRESHOLD,
         skip: list[str] | None = None) -> Column:
    """Keep spans with ``score >= threshold`` whose type is not skipped."""
    skip = S.PII_TYPES_TO_SKIP if skip is None else skip
    keep = lambda e: (e["score"] >= F.lit(threshold)) & ~e["type"].isin(list(skip))
    return F.filter(F.coalesce(entities, F.array().cast(S.ENTITIES)), keep)


def sort_spans(entities: Column) -> Column:
    """O1: stable sort by begin offset (ties keep their input order)."""
    keyed = F.transform(
        entities,
        lambda e, i: F.struct(e["begin"].alias("b"), i.alias("i"), e["end"].alias("e"), e["type"].alias("t")),
    )
    return F.sort_array(keyed)


def _cut(text: str, spans, compat: bool) -> str:
    """``text`` with each of the sorted ``(begin, end, type)`` replaced by its type."""
    pieces, cursor = [], 0
    for begin, end, kind in spans:
        pieces += [text[cursor:begin], "[", kind, "]"]
        cursor = end if compat else max(cursor, end)
    return "".join([*pieces, text[cursor:]])


def _copier(compat: bool):
    def copy(texts: pa.Array, spans: pa.Array) -> pa.Array:
        found = zip(texts.to_pylist(), spans.to_pylist())
        out = [text if text is None or not f else _cut(text, ((s["b"], s["e"], s["t"]) for s in f), compat) for text, f in found]
        return pa.array(out, pa.string())

    return copy


REDACTED = "struct<redacted_text:string,kept:array<struct<score:double,type:string,begin:int,end:int>>>"


def _redactor(patterns: tuple, threshold: float, skip: frozenset, compat: bool):
    def redact(texts: pa.Array) -> pa.Array:
        compiled = [(t, score, re.compile(p), guard) for t, score, p, guard in patterns]
        cut, kept = [], []
        for text in texts.to_pylist():
            spans = [] if text is None else [s for s in _spans_of(text, compiled) if s["score"] >= threshold and s["type"] not in skip]
            kept.append(spans)
            ordered = sorted(((s["begin"], s["end"], s["type"]) for s in spans), key=lambda s: s[0])  # stable
            cut.append(_cut(text, ordered, compat) if spans else text)
        return pa.StructArray.from_arrays([pa.array(cut, pa.string()), pa.array(kept, _SPANS)], ["redacted_text", "kept"])

    return redact


def redactor(patterns=None, *, threshold: float = S.PII_SCORE_THRESHOLD, skip: list[str] | None = None, compat: bool = False):
    """F1 with the built-in detector as one Arrow function ``text -> struct<redacted_text, kept>``: the
    text goes to Python once. ``kept`` are the spans that were replaced, in the detector's order. Can be
    registered for SQL (``spark.udf.register``)."""
    skip = S.PII_TYPES_TO_SKIP if skip is None else skip
    function = _redactor(tuple(DETECTOR_PATTERNS if patterns is None else patterns), threshold, frozenset(skip), compat)
    return F.arrow_udf(in_slices(function), REDACTED)


def apply_spans(text: Column, spans: Column, compat: bool = False) -> Column:
    """Copy text between the cursor and each sorted span's start, then ``[TYPE]``; then the tail.

    ``compat=True`` moves the cursor to each span's end even when that goes
    backwards (a nested span then re-emits the tail of the outer one, as the
    original does); the default keeps the furthest end so no covered text leaks.
    """
    return F.arrow_udf(in_slices(_copier(compat)), "string")(text, spans)


def redact(text: Column, entities: Column, *, threshold: float = S.PII_SCORE_THRESHOLD,
           skip: list[str] | None = None, compat: bool = False) -> Column:
    """F1 as one expression: ``struct<redacted_text, pii_entities_detected>``.

    Replaces every kept span with ``[TYPE]`` in one left-to-right pass over
    the spans sorted by start. For large frames prefer
    ``mailsift.plans.triage.redacted``, which stages the span list as a
    column so it is computed once.
    """
    spans = sort_spans(gate(entities, threshold, skip))
    return F.struct(
        apply_spans(text, spans, compat).alias("redacted_text"),
        F.size(spans).cast("int").alias("pii_entities_detected"),
    )


def redact_with_detector(text: Column, **kw) -> Column:
    return redact(text, detect(text), **kw)

"""Strict JSON handling of model text (F2, F3, F14-F16) as column expressions.

Spark's JSON readers are lenient (text after a complete value is ignored, single
quotes accepted). The strict rule wraps the text twice, as the only element of an
array and as the only member of an object, and both must parse: an early ``]``
ends the array but breaks the object, an early ``}`` or ``,`` breaks the array, so
nothing can follow the one object. Differences from a lenient parser that are
kept: duplicate keys and ``NaN``/``Infinity`` make a text invalid.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import schemas as S


def strict_object(raw: Column) -> Column:
    """the parsed VARIANT object, or null when ``raw`` is not exactly one
    JSON object. Duplicate keys are rejected (the VARIANT parser refuses them
    unless ``spark.sql.variant.allowDuplicateKeys`` is set, then last wins)."""
    arr = F.try_parse_json(F.concat(F.lit("["), raw, F.lit("]")))
    elem = F.try_variant_get(arr, "$[0]", "variant")
    is_single = F.try_variant_get(arr, "$[1]", "variant").isNull() & elem.isNotNull()
    is_object = F.schema_of_variant(elem).startswith("OBJECT")
    closed = F.try_parse_json(F.concat(F.lit('{"v":'), raw, F.lit("}"))).isNotNull()
    return F.when(is_single & F.coalesce(is_object, F.lit(False)) & closed, elem)


def has_key(obj: Column, key: str) -> Column:
    """Key present (a JSON null value counts as present)."""
    return F.try_variant_get(obj, f"$.{key}", "variant").isNotNull()


def get_str(obj: Column, key: str) -> Column:
    return F.try_variant_get(obj, f"$.{key}", "string")


def str_array_or_empty(obj: Column, key: str) -> Column:
    """a list of strings, ``[]`` when missing or null."""
    return F.coalesce(F.try_variant_get(obj, f"$.{key}", "array<string>"), F.array().cast("array<string>"))


def is_string(obj: Column, key: str) -> Column:
    return F.coalesce(
        F.schema_of_variant(F.try_variant_get(obj, f"$.{key}", "variant")) == F.lit("STRING"),
        F.lit(False),
    )


def parse_envelope(text: Column) -> Column:
    """response envelope ``{content: [...], stop_reason}`` as a struct."""
    return F.from_json(text, S.ENVELOPE)


def first_text(envelope: Column) -> Column:
    """text of the first ``text`` block, or null."""
    return F.get(F.filter(envelope["content"], lambda b: b["type"] == "text"), 0)["text"]


def tool_blocks(envelope: Column) -> Column:
    """all ``tool_use`` blocks."""
    return F.filter(envelope["content"], lambda b: b["type"] == "tool_use")


def answer_of(text: Column) -> Column:
    """F16: the ``answer`` string when ``text`` is one JSON object whose
    ``answer`` is a string; null otherwise."""
    obj = strict_object(text)
    return F.when(is_string(obj, "answer"), get_str(obj, "answer"))

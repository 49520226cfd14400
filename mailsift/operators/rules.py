"""Row rules: escalation phrases, review routing, gates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions import cached_expr, timefmt


@cached_expr
def phrase_hit_named(col: str, phrases: tuple | None = None, lowered: bool = False) -> Column:
    """``phrase_hit`` on a named column (built once per JVM)."""
    return phrase_hit(F.col(col), list(phrases) if phrases is not None else None, lowered=lowered)


@cached_expr
def review_status_named(confidence: str = "confidence", failed: str = "classification_failed") -> Column:
    return review_status(F.col(confidence), F.col(failed))


def phrase_hit(text: Column, phrases: list[str] | None = None, *, lowered: bool = False) -> Column:
    """Case-insensitive substring match of any phrase (one OR chain of
    ``contains``). Pass ``lowered=True`` with an already lower-cased column
    to lower the text once. ``"Shutdown"`` matches ``"down"`` by design."""
    phrases = S.ESCALATION_PHRASES if phrases is None else phrases
    low = text if lowered else F.lower(text)
    return F.coalesce(reduce(lambda a, b: a | b, [low.contains(p.lower()) for p in phrases]), F.lit(False))


def keyword_override(text: Column, urgency: Column, phrases: list[str] | None = None) -> Column:
    """``struct<urgency, urgency_override_applied>``: high when a phrase fires."""
    hit = phrase_hit(text, phrases)
    return F.struct(
        F.when(hit, F.lit("high")).otherwise(urgency).alias("urgency"),
        hit.alias("urgency_override_applied"),
    )


def keyword_text(subject: Column, redacted_body: Column) -> Column:
    """the text the phrase rule reads: subject, one space, redacted body."""
    return F.concat(subject, F.lit(" "), redacted_body)


def phrase_hits(df: DataFrame, text: Column, groups=None, key: str = "email_id") -> DataFrame:
    """P10: which phrase groups fired per message.

    The phrases are literals of the caller, so each row filters the literal array:
    no join and no shuffle; rows leave by a generator, as a filter would be moved below the text and
    make it twice. For tables of thousands of phrases see ``operators.phrases``. ``groups`` is a list of (group, phrases). Output: key,
    phrase_groups (sorted, distinct), phrases (sorted, distinct); rows without a hit
    are left out.
    """
    groups = S.PHRASE_GROUPS if groups is None else groups
    table = F.array(*[F.struct(F.lit(g).alias("g"), F.lit(p).alias("p")) for g, ps in groups for p in ps])
    hits = F.filter(table, lambda x: F.col("_low").contains(F.lower(x["p"])))
    found = df.select(F.col(key), F.lower(text).alias("_low")).select(key, hits.alias("_hits"))
    lists = F.struct(
        F.array_sort(F.array_distinct(F.transform("_hits", lambda x: x["g"]))).alias("phrase_groups"),
        F.array_sort(F.array_distinct(F.transform("_hits", lambda x: x["p"]))).alias("phrases"),
    )
    return found.select(key, F.inline(F.when(F.size("_hits") > 0, F.array(lists))))


def review_status(confidence: Column, classification_failed: Column) -> Column:
    """Anything but high confidence, or a failed classification, needs review."""
    needs = (confidence != F.lit("high")) | classification_failed
    return F.when(F.coalesce(needs, F.lit(True)), F.lit(S.NEEDS_REVIEW)).otherwise(F.lit(S.AUTO_PROCESSED))


def null_if_marker(subject: Column, body: Column, marker: str = S.DEFAULT_POISON_MARKER) -> Column:
    """A subject carrying the marker removes the body."""
    return F.when(F.coalesce(subject.contains(marker), F.lit(False)), F.lit(None).cast("string")).otherwise(body)


REQUIRED_MESSAGE_FIELDS = ["email_id", "from_address", "subject", "body", "raw_s3_key", "received_at"]


def quarantine_reason(max_body_bytes: int | None = None,
                      required: list[str] | None = None) -> Column:
    """Why a message cannot be processed (null = fine).

    A missing required field fails on every delivery, and so does an arrival time
    that is not an ISO-8601 text. The built-in detector has no size limit; pass
    ``max_body_bytes`` to report bodies that an external one could not scan.
    """
    return _quarantine_reason(max_body_bytes, tuple(REQUIRED_MESSAGE_FIELDS if required is None else required))


@cached_expr
def _quarantine_reason(max_body_bytes: int | None, required: tuple) -> Column:
    reason = F.lit(None).cast("string")
    checks = [(F.col(c).isNull(), f"missing_{c}") for c in required]
    if "received_at" in required:
        checks.append((timefmt.parse_iso(F.col("received_at")).isNull(), "bad_received_at"))
    if max_body_bytes is not None:
        checks.append((F.octet_length("body") > max_body_bytes, "body_too_large"))
    for cond, label in reversed(checks):
        reason = F.when(cond, F.lit(label)).otherwise(reason)
    return reason


def quarantine_split(messages: DataFrame, **kw) -> tuple[DataFrame, DataFrame]:
    """(good, bad) where bad carries ``reason``; one pass, two filters."""
    tagged = messages.withColumn("reason", quarantine_reason(**kw))
    return tagged.where(F.col("reason").isNull()).drop("reason"), tagged.where(F.col("reason").isNotNull())


def language_route(lang: Column, supported: tuple[str, ...] = ("en",)) -> Column:
    """The detector assumes English; other languages go to review."""
    return F.when(lang.isin(list(supported)), F.lit("detect")).otherwise(F.lit("review"))

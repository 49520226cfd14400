"""Time helpers that never depend on the session time zone.

Stored times are UTC. Columns typed ``timestamp_ntz`` carry UTC wall-clock
values, so formatting and epoch arithmetic on them are zone-free.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPOCH_NTZ = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"
ISO_OFFSET = "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]XXX"
HAS_OFFSET = r"(Z|[+-][0-9]{2}:[0-9]{2})$"

#: The form that nearly all stored times have; others are taken apart by ``ISO_PARTS``.
ISO_USUAL = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}([.][0-9]{6})?(Z|[+-][0-9]{2}:[0-9]{2})?$"

#: Date (calendar or week, extended or basic), any one character, time, fraction, offset.
ISO_PARTS = (
    r"^([0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{8}|[0-9]{4}-W[0-9]{2}(?:-[1-7])?|[0-9]{4}W[0-9]{2}[1-7]?)"
    r"(?:[^0-9]((?:[0-9]{2}(?::[0-9]{2}(?::[0-9]{2})?)?|[0-9]{4}|[0-9]{6})(?:[.,](?:[0-9]+|(?=[Z+-])))?)"
    r"(Z|[+-](?:[0-9]{2}(?::[0-9]{2}(?::[0-9]{2})?)?|[0-9]{4}|[0-9]{6})(?:[.,][0-9]+)?)?)?$"
)


def iso_utc(ts: Column) -> Column:
    """``2026-06-21T14:30:00+00:00`` (seconds precision, fixed UTC offset)."""
    return F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00"))


def epoch_seconds(ts_ntz: Column) -> Column:
    """Whole epoch seconds of a UTC ``timestamp_ntz`` (fraction dropped)."""
    return F.timestamp_diff("SECOND", F.expr(EPOCH_NTZ), ts_ntz)


def epoch_millis(ts_ntz: Column) -> Column:
    return F.timestamp_diff("MILLISECOND", F.expr(EPOCH_NTZ), ts_ntz)


def parse_iso(s: Column) -> Column:
    """ISO-8601 text -> UTC ``timestamp_ntz``; bad text -> null.

    Calendar and week dates, extended and basic, alone (midnight) or followed by any one character
    and a time of hours, minutes or seconds; a fraction is one of seconds, cut to microseconds; then ``Z``, an
    offset of hours, minutes or seconds, or nothing. A text without an offset is taken as UTC.
    """
    whole = F.when(s.rlike(HAS_OFFSET), s).otherwise(F.concat(s, F.lit("+00:00")))
    usual = F.unix_micros(F.try_to_timestamp(whole, F.lit(ISO_OFFSET)))
    micros = F.when(s.rlike(ISO_USUAL), usual).when(s.rlike(ISO_PARTS), _any_iso_micros(s))
    return F.timestamp_add("MICROSECOND", micros, F.expr(EPOCH_NTZ))


def _clock_micros(text: Column, *, strict: bool) -> Column:
    """``hhmmss`` and a fraction, digits left out at the end counting as zeros -> microseconds; null
    from 24 hours on and, if ``strict``, where minutes or seconds exceed 59."""
    whole = F.rpad(F.regexp_replace(F.substring_index(text, ".", 1), ":", ""), 6, "0")
    part = F.when(F.contains(text, F.lit(".")), F.substring_index(text, ".", -1)).otherwise(F.lit(""))
    h, m, sec = (F.substring(whole, i, 2).cast("bigint") for i in (1, 3, 5))
    micros = ((h * 60 + m) * 60 + sec) * 1_000_000 + F.rpad(F.substring(part, 1, 6), 6, "0").cast("bigint")
    return F.when((h < 24) & (m < 60) & (sec < 60) if strict else micros < 86_400_000_000, micros)


def _any_iso_micros(s: Column) -> Column:
    date, clock, offset = (F.regexp_extract(s, ISO_PARTS, i) for i in (1, 2, 3))
    digits = F.regexp_replace(date, "[-W]", "")
    day = F.to_date(F.try_to_timestamp(F.concat(F.substring(digits, 1, 8), F.lit("+00")), F.lit("yyyyMMddX")))
    calendar = F.unix_date(F.when(day.isNotNull(), F.make_date(*(F.substring(digits, i, n).cast("int") for i, n in ((1, 4), (5, 2), (7, 2))))))
    # ISO weeks begin on Monday, the first one holds 4 January; 28 December is in the last one
    year, week = F.substring(digits, 1, 4).cast("int"), F.substring(digits, 5, 2).cast("int")
    weekday = F.coalesce(F.try_to_number(F.substring(digits, 7, 1), F.lit("9")).cast("int"), F.lit(1))
    fourth = F.make_date(year, F.lit(1), F.lit(4))
    in_year = (week >= 1) & (week <= F.weekofyear(F.make_date(year, F.lit(12), F.lit(28))))
    weeks = F.when(in_year, F.unix_date(fourth) - F.weekday(fourth) + (week - 1) * 7 + weekday - 1)
    days = F.when(F.contains(date, F.lit("W")), weeks).otherwise(calendar)
    time = _clock_micros(F.translate(clock, ",", "."), strict=True)
    sign = F.when(F.startswith(offset, F.lit("-")), -1).otherwise(1)
    shift = F.when(offset.isin("", "Z"), F.lit(0)).otherwise(sign * _clock_micros(F.translate(F.substring(offset, 2, 99), ",", "."), strict=False))
    return days.cast("bigint") * 86_400_000_000 + time - shift


def ntz_literal(text: str) -> Column:
    return F.expr(f"TIMESTAMP_NTZ'{text}'")


def to_ntz_utc(ts_ltz: Column) -> Column:
    """An instant (``timestamp``) as UTC wall clock, independent of session zone."""
    return F.timestamp_add("MICROSECOND", F.unix_micros(ts_ltz), F.expr(EPOCH_NTZ))


def ntz_to_instant(ts_ntz: Column) -> Column:
    """A UTC wall-clock ``timestamp_ntz`` as an instant (``timestamp``), zone-free."""
    return F.timestamp_micros(F.timestamp_diff("MICROSECOND", F.expr(EPOCH_NTZ), ts_ntz))

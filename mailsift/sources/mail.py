"""Raw mail and queue formats.

The raw corpus is read with the ``binaryFile`` source (one object per
message). Decoding MIME is the one place where Python runs per message:
``mapInPandas`` with the standard ``email`` package, batch by batch inside
the executors. Everything else is column expressions.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas as S
from ..functions import timefmt
from ..operators import rules
from ..session import importable, small_batches

def raw_scan(spark: SparkSession, root: str, glob: str | None = None, recursive: bool = True) -> DataFrame:
    """Every raw message under ``root``: path, modificationTime, length, content."""
    r = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    if glob:
        r = r.option("pathGlobFilter", glob)
    return r.load(root)


def key_to_id(key: Column) -> Column:
    """Notification key (URL-encoded, ``+`` = space) -> decoded key and id.

    Returns ``struct<key string, email_id string>``; an undecodable key
    gives nulls (quarantined downstream) instead of raising.
    """
    decoded = F.try_url_decode(key)
    return F.struct(decoded.alias("key"), F.substring_index(decoded, "/", -1).alias("email_id"))


def path_to_key(path: Column, prefix: str = S.RAW_PREFIX) -> Column:
    """Object key of a ``binaryFile`` path (already decoded, H6): from ``prefix`` on."""
    return F.concat(F.lit(prefix), F.substring_index(path, "/" + prefix, -1))


PARSED = ["from_address", "subject", "body", "parse_error"]


def _address(headers: list[str]) -> str:
    """The first address in the given header values, without display name."""
    from email.utils import getaddresses

    return next((address for _, address in getaddresses(headers) if address), "")


def _readable_part(message):
    """The first plain text part, else the first HTML part, attachments aside."""
    texts = {"text/plain": [], "text/html": []}
    for part in message.walk():
        kind = part.get_content_type()
        if kind in texts and part.get_content_disposition() != "attachment":
            texts[kind].append(part)
    return next(iter(texts["text/plain"] + texts["text/html"]), None)


def _fields(raw: bytes | None) -> dict[str, str | None]:
    """``from_address, subject, body`` of one raw message, or ``parse_error``."""
    import email
    from email.policy import default

    try:
        message = email.message_from_bytes(bytes(raw or b""), policy=default)
        part = _readable_part(message)
        return {
            "from_address": _address([str(h) for h in message.get_all("from", [])]),
            "subject": str(message.get("subject", "")),
            "body": "" if part is None else part.get_content(),
            "parse_error": None,
        }
    except Exception as e:  # noqa: BLE001 - a bad message is quarantined, not fatal
        return {"from_address": None, "subject": None, "body": None, "parse_error": f"{type(e).__name__}: {e}"}


def _parse_batch(passthrough: list[str]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            parsed = pd.DataFrame([_fields(raw) for raw in pdf["content"]], columns=PARSED, index=pdf.index)
            yield pd.concat([pdf[passthrough], parsed.astype(object).where(parsed.notna(), None)], axis=1)

    return run


def parse_mail(raw: DataFrame, passthrough: list[str] | None = None) -> DataFrame:
    """``content`` -> ``from_address, subject, body, parse_error``.

    Address only (display name dropped), decoded subject, the plain part
    before the HTML part (HTML returned as is), ``""`` when absent. The
    ``passthrough`` columns (default ``path``) travel with each row through
    the Python stage, so nothing has to be joined back afterwards.
    """
    importable(raw.sparkSession)
    small_batches(raw.sparkSession)
    passthrough = ["path"] if passthrough is None else passthrough
    schema = T.StructType(
        [raw.schema[c] for c in passthrough]
        + [T.StructField(c, T.StringType(), True) for c in PARSED]
    )
    return raw.select(*passthrough, "content").mapInPandas(_parse_batch(passthrough), schema)


def mail_job(raw: DataFrame, *, key_col: Column | None = None, received: Column | None = None,
             marker: str = S.DEFAULT_POISON_MARKER) -> DataFrame:
    """M1: raw corpus -> T2 messages.

    ``raw`` has ``path, content`` and optionally ``modificationTime``; the
    id is the last part of the key, ``received_at`` the object time (H13).
    A subject carrying ``marker`` removes the body (P16). One pass: the key
    and arrival time are computed first and carried through the parser.
    """
    if key_col is not None:
        key = key_col
    elif "key" in raw.columns:  # packed corpus
        key = F.col("key")
    else:
        key = path_to_key(F.col("path"))
    if received is not None:
        when = received
    elif "received_ts" in raw.columns:
        when = F.col("received_ts")
    else:
        when = timefmt.to_ntz_utc(F.col("modificationTime"))
    staged = raw.select(key.alias("raw_s3_key"), when.alias("received_ts"), "content")
    parsed = parse_mail(staged, ["raw_s3_key", "received_ts"])
    return parsed.select(
        F.substring_index("raw_s3_key", "/", -1).alias("email_id"),
        "from_address",
        "subject",
        rules.null_if_marker(F.col("subject"), F.col("body"), marker).alias("body"),
        "raw_s3_key",
        timefmt.iso_utc(F.col("received_ts")).alias("received_at"),
        "received_ts",
        "parse_error",
    )


def _b64(text: Column) -> Column:
    """Base64 of the UTF-8 bytes on one line (whatever the session's chunking setting)."""
    return F.regexp_replace(F.base64(F.encode(text, "UTF-8")), r"[\r\n]", "")


def build_mail(from_name: Column, from_addr: Column, subject: Column, body: Column) -> Column:
    """A MIME message (bytes): RFC 2047 base64 subject, base64 UTF-8 plain body
    in 76-character lines."""
    crlf = F.lit("\r\n")
    body_lines = F.regexp_replace(_b64(body), r"(.{76})(?=.)", "$1\r\n")
    return F.encode(
        F.concat(
            F.lit("From: \""), from_name, F.lit("\" <"), from_addr, F.lit(">"), crlf,
            F.lit("Subject: =?utf-8?b?"), _b64(subject), F.lit("?="), crlf,
            F.lit("MIME-Version: 1.0"), crlf,
            F.lit("Content-Type: text/plain; charset=utf-8"), crlf,
            F.lit("Content-Transfer-Encoding: base64"), crlf, crlf,
            body_lines, crlf,
        ),
        "UTF-8",
    )


# ---------------------------------------------------------------------------
# Queue messages (S4, S5) and typed-wire seed rows
# ---------------------------------------------------------------------------

QUEUE_FIELDS = ["email_id", "from_address", "subject", "body", "raw_s3_key", "received_at"]


def queue_encode(messages: DataFrame) -> DataFrame:
    """Row -> ``key, value`` JSON (a null body is left out: the absent key)."""
    return messages.select(
        F.col("email_id").alias("key"),
        F.to_json(F.struct(*[F.col(c) for c in QUEUE_FIELDS])).alias("value"),
    )


def queue_decode(encoded: DataFrame) -> DataFrame:
    """JSON -> the six message columns; a missing key becomes null."""
    p = F.from_json(F.col("value"), S.MESSAGE)
    return encoded.select(p.alias("m")).select("m.*")


WIRE_SCHEMA = (
    "email_id struct<S:string>, category struct<S:string>, urgency struct<S:string>, "
    "sentiment struct<S:string>, review_status struct<S:string>, received_at struct<S:string>, "
    "feature_tags struct<L:array<struct<S:string>>>"
)


def wire_encode(records: DataFrame) -> DataFrame:
    """Typed-wire JSON line per record (``{"S": ...}`` / ``{"L": [...]}`` wrappers)."""
    s = lambda c: F.struct(F.col(c).alias("S")).alias(c)
    tags = F.struct(F.transform("feature_tags", lambda t: F.struct(t.alias("S"))).alias("L")).alias("feature_tags")
    return records.select(
        F.to_json(F.struct(s("email_id"), s("category"), s("urgency"), s("sentiment"),
                           s("review_status"), s("received_at"), tags)).alias("value")
    )


WIRE_FIELDS = ["email_id", "category", "urgency", "sentiment", "review_status", "received_at"]


def _unwrap(prefix: str) -> list[Column]:
    return [
        *[F.col(f"{prefix}{c}.S").alias(c) for c in WIRE_FIELDS],
        F.coalesce(F.transform(f"{prefix}feature_tags.L", lambda x: x["S"]), F.array().cast("array<string>"))
        .alias("feature_tags"),
    ]


def wire_decode(lines: DataFrame, col: str = "value") -> DataFrame:
    """Typed-wire JSON text -> plain seed columns."""
    return lines.select(F.from_json(F.col(col), WIRE_SCHEMA).alias("w")).select(*_unwrap("w."))


def wire_load(spark: SparkSession, path: str) -> DataFrame:
    """S11 from files: ``spark.read.json`` with the wrapper schema (no inference)."""
    return spark.read.schema(WIRE_SCHEMA).json(path).select(*_unwrap(""))


#: A packed corpus: many raw messages in one file.
CORPUS = "key string, content binary, received_ts timestamp_ntz"


def write_corpus(mails: DataFrame, root: str) -> None:
    """Write ``key, content, received_ts`` rows as a packed corpus under ``root``: Parquet files
    with many messages each, so neither the name node nor the driver sees one object per
    message. Bytes are kept exactly."""
    mails.select("key", "content", "received_ts").write.mode("errorifexists").parquet(root)


def read_corpus(spark: SparkSession, root: str) -> DataFrame:
    """S1 over a packed corpus."""
    return spark.read.schema(CORPUS).parquet(root)

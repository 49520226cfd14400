"""WARC archives and a globally ordered capture index.

Writing: every capture becomes one gzip member of a ``.warc.gz`` file, a task's
records in one file. Of captures with equal payloads the one with the largest id
is the ``response``; the others are ``revisit`` records without a payload that name
it, its payload digest and its length.

Index: each file's records, sorted by URL key, timestamp and record id, are a
locally sorted run, written beside the file. The merge is external: splitters taken
from the runs cut the order into ranges, as many as the entries need; where the slices of the
run files lie that reach into a range is all that is shuffled. One task merges a
range: it reads the run files slice by slice into a loser tree (one comparison a
level for each entry, sentinels for exhausted runs) and writes the merged entries
as they come, so it holds one slice of every run and never the range. The ranges follow
one another, so their files together are the capture history of every URL in
order. A URL with very many captures is cut by timestamp and id like any other
stretch.

Reading: the merged index names file, offset and length of every record; records
are fetched file by file and parsed, and payloads are checked against their
digest.

Very long payloads are one record like others. Null payloads are empty, and empty payloads can be revisited like others (from
``min_revisit_bytes`` on). Null URLs have the empty URL key and no WARC-Target-URI;
null ids come before all others. Rows with the payload and the id of a response are
responses as well. An empty table gives no files and empty results. Only the named columns
are read, so others may have any name.
"""

from __future__ import annotations

import base64
import datetime
import hashlib
import json
import re
import zlib
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch_path
from . import blobs
from .common import partitions, prepare, stage, table

#: Entries of a run that are read at once.
SLICE = 500

#: Entries that each slice offers as splitters, and a range on average gets to choose from.
OFFERED = 8

#: Entries of a range.
RANGE_ENTRIES = 50_000


def url_key(url: str | None) -> str:
    """Sort-friendly URL: host labels reversed, no scheme, ``www`` or default port, lower case."""
    if not url:
        return ""
    m = re.match(r"(?i)(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)(?::(\d*))?([^#]*)", url)
    if not m:
        return url.strip().lower()
    host = re.sub(r"^www\d*\.", "", m[1].lower().rstrip("."))
    port = f":{m[2]}" if m[2] and m[2] not in ("80", "443") else ""
    rest = m[3].lower()
    return ",".join(reversed(host.split("."))) + port + ")" + (rest if rest.startswith("/") else "/" + rest)


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(row_id: int | None) -> str:
    return f"<urn:capture:{'' if row_id is None else row_id}>"


def _clean(value: str) -> str:
    """Header values hold no line breaks; others are percent-encoded."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def record(row: dict, payload: bytes) -> bytes:
    """One record as a gzip member."""
    head = ["WARC/1.1", f"WARC-Type: {row['record_type']}", f"WARC-Record-ID: {record_id(row['id'])}", f"WARC-Date: {row['date']}"]
    if row["url"] is not None:
        head.append(f"WARC-Target-URI: {_clean(row['url'])}")
    head.append(f"WARC-Payload-Digest: sha1:{row['digest']}")
    if row["record_type"] == "revisit":
        head += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: {record_id(row['refers_to'])}",
            f"X-Payload-Length: {row['n_bytes']}",
        ]
        payload = b""
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(payload)}", "", ""]
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(head).encode() + payload + b"\r\n\r\n") + pack.flush()


def parse(member: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (lower-case names) and block of one record."""
    data = zlib.decompress(member, 31)
    cut = data.index(b"\r\n\r\n") + 4
    lines = data[:cut].decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    head = {k.lower(): v for k, v in (x.split(": ", 1) for x in lines[1:] if x)}
    return head, data[cut : cut + int(head["content-length"])]


class LoserTree:
    """Merges sorted sequences: each inner node keeps the loser of its match, the
    winner goes up; replacing the winner replays one path."""

    def __init__(self, runs: list):
        self.runs = [iter(r) for r in runs]
        k = len(self.runs)
        self.heads = [next(r, None) for r in self.runs]
        self.losers = [-1] * max(1, k)
        for leaf in range(k):
            self._replay(leaf)

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        if x is None or y is None:
            return y is None and (x is not None or a < b)
        return x < y or (x == y and a < b)

    def _replay(self, leaf: int) -> None:
        k, winner = len(self.runs), leaf
        at = (leaf + k) // 2
        while at > 0:
            other = self.losers[at]
            if other < 0:  # first arrival while the tree is built: waits for its match
                self.losers[at] = winner
                return
            if self._beats(other, winner):
                self.losers[at], winner = winner, other
            at //= 2
        self.losers[0] = winner

    def __iter__(self):
        if not self.runs:
            return
        while True:
            w = self.losers[0]
            if self.heads[w] is None:
                return
            yield self.heads[w]
            self.heads[w] = next(self.runs[w], None)
            self._replay(w)


ENTRY = ("key", "date", "id", "seq", "file", "offset", "length")

LISTED = "key string, date string, id bigint, seq bigint, file string, offset bigint, length bigint"


def _order(e: tuple) -> tuple:
    """Sort key of an entry: URL key, timestamp, id (null first), place in its file."""
    return (e[0], e[1], e[2] is not None, e[2] or 0, e[4], e[5])


def _write_archive(folder: str):
    """One archive per task, and its sorted run as rows of at most ``SLICE`` entries."""

    def run(batches):
        out, uri, at, entries = None, None, 0, []
        for b in batches:
            for row in b.to_pylist():
                if out is None:
                    uri = blobs.fresh(f"{folder}/archive", "captures", ".warc.gz")
                    out = blobs.create(uri)
                member = record(row, (row["payload"] or "").encode())
                out.write(member)
                entries.append((url_key(row["url"]), row["date"], row["id"], len(entries), uri, at, len(member)))
                at += len(member)
        if out is None:
            return
        out.close()
        entries.sort(key=_order)
        run_uri = uri.replace(".warc.gz", ".cdxj").replace("/archive/", "/runs/")
        rows = []
        with blobs.create(run_uri) as cdx:
            at = 0
            for i in range(0, len(entries), SLICE):
                part = entries[i : i + SLICE]
                data = b"".join(_line(e) for e in part)
                cdx.write(data)
                rows.append((run_uri, len(part), at, len(data), part[0], part[-1], [part[k * len(part) // OFFERED] for k in range(min(OFFERED, len(part)))]))
                at += len(data)
        columns = list(zip(*rows))
        named = [[dict(zip(ENTRY, e)) for e in c] for c in columns[4:6]] + [[[dict(zip(ENTRY, e)) for e in x] for x in columns[6]]]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip((*columns[:4], *named), _RUN)], schema=_RUN)

    return run


def _line(e: tuple) -> bytes:
    return (json.dumps(dict(zip(ENTRY, e)), ensure_ascii=False) + "\n").encode()


_ENTRY = pa.struct([("key", pa.string()), ("date", pa.string()), ("id", pa.int64()), ("seq", pa.int64()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])

#: A slice of a run file: its entries, place and bytes, its first and last entry, and some between.
_RUN = pa.schema([("run", pa.string()), ("n", pa.int32()), ("at", pa.int64()), ("bytes", pa.int64()), ("first", _ENTRY), ("last", _ENTRY), ("offered", pa.list_(_ENTRY))])

_STRUCT = f"struct<{LISTED.replace(' ', ': ').replace(',:', ',')}>"

RUN = f"run string, n int, at bigint, bytes bigint, first {_STRUCT}, last {_STRUCT}, offered array<{_STRUCT}>"


def _cut(splitters: list[tuple]):
    """The ranges that each slice of a run reaches into."""

    def run(batches):
        for b in batches:
            out = []
            for row in b.to_pylist():
                first, last = (bisect_right(splitters, _order(tuple(row[k].values()))) for k in ("first", "last"))
                out += [(r, row["run"], row["at"], row["bytes"]) for r in range(first, last + 1)]
            columns = list(zip(*out)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.string(), pa.int64(), pa.int64()))], ["range", "run", "at", "bytes"])

    return run


def _entries_of(uri: str, slices: list[tuple[int, int]], low: tuple | None, high: tuple | None):
    """``(order, entry)`` of a run from ``low`` on and before ``high``, read slice by slice."""
    with blobs.open_random(uri) as f:
        for at, size in slices:
            f.seek(at)
            for line in f.read(size).splitlines():
                named = json.loads(line)
                e = tuple(named[k] for k in ENTRY)
                order = _order(e)
                if high is not None and order >= high:
                    return
                if low is None or order >= low:
                    yield order, e


def _merge(folder: str, splitters: list[tuple]):
    """Merge the ranges of a task, one after the other, from the run files; write their parts of the global index."""

    def merged(number: int, runs: dict[str, list]):
        low = splitters[number - 1] if number else None
        high = splitters[number] if number < len(splitters) else None
        tree = LoserTree([_entries_of(uri, slices, low, high) for uri, slices in runs.items()])
        with blobs.create(blobs.fresh(f"{folder}/index", f"range-{number:06d}", ".cdxj")) as out:
            place, held = 0, []
            for _, e in tree:
                out.write(_line(e))
                held.append((number, place, *e))
                place += 1
                if len(held) == 5_000:
                    yield held
                    held = []
            if held:
                yield held

    def run(batches):
        kinds = [pa.int32(), pa.int64(), *[f.type for f in _ENTRY]]
        now, runs = None, {}

        def done():
            for rows in merged(now, runs) if now is not None else ():
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["range", "place", *ENTRY])

        for b in batches:
            for number, uri, at, size in zip(*(c.to_pylist() for c in b.columns)):
                if number != now:
                    yield from done()
                    now, runs = number, {}
                runs.setdefault(uri, []).append((at, size))
        yield from done()

    return run


def capture_date(row_id, epoch: str = "2024-01-01 00:00:00"):
    """For tables without capture times: one second per id after ``epoch``."""
    base = int(datetime.datetime.fromisoformat(epoch).replace(tzinfo=datetime.UTC).timestamp())
    seconds = F.coalesce(F.pmod(row_id.cast("bigint"), F.lit(1_000_000_000)), F.lit(0)) + F.lit(base)
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def captures(pages: DataFrame, *, row_id: str = "page_id", url: str = "url", payload: str = "html", date=None, min_revisit_bytes: int = 0) -> DataFrame:
    """``id, url, payload, date, n_bytes, digest, record_type, refers_to`` of each row.

    The winners are found on digests alone, partial maxima first; joining them
    back moves each payload once, and a hot digest is split by the adaptive skew
    join."""
    prepare(pages.sparkSession)
    body = F.coalesce(pages[payload].cast("string"), F.lit(""))
    rows = pages.select(
        pages[row_id].cast("bigint").alias("id"), pages[url].cast("string").alias("url"), body.alias("payload"),
        (capture_date(pages[row_id]) if date is None else date).alias("date"),
    )
    rows = rows.withColumns({"n_bytes": F.octet_length("payload").cast("bigint"), "sha": F.sha1(F.col("payload").cast("binary"))})
    copies = rows.groupBy("sha").agg(F.max("id").alias("winner"))
    joined = rows.join(copies, "sha")
    revisit = (F.col("n_bytes") >= min_revisit_bytes) & ~F.col("id").eqNullSafe(F.col("winner"))
    return joined.select(
        "id", "url", "payload", "date", "n_bytes", _base32("sha").alias("digest"),
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("winner")).alias("refers_to"),
    )


@F.arrow_udf(T.StringType())
def _base32(sha: pa.Array) -> pa.Array:
    return pa.array([base64.b32encode(bytes.fromhex(x)).decode() for x in sha.to_pylist()], pa.string())


def write_archives(rows: DataFrame, folder: str) -> DataFrame:
    """Write the archives; returns their sorted runs."""
    rows.mapInArrow(_write_archive(folder), RUN).write.parquet(f"{folder}/run_rows")
    return rows.sparkSession.read.parquet(f"{folder}/run_rows")


def merge_index(runs: DataFrame, folder: str) -> DataFrame:
    """The capture history in global order: ``range, place`` and the entries."""
    spark = runs.sparkSession
    offered = runs.select(F.explode("offered").alias("e")).select("e.*")
    total, entries = runs.agg(F.sum(F.size("offered")), F.sum("n")).first()
    ranges = max(partitions(spark), -(-(entries or 0) // RANGE_ENTRIES))
    keep = max(1, (total or 0) // (ranges * OFFERED))
    sample = offered.filter(F.pmod(F.xxhash64("file", "offset"), F.lit(keep)) == 0).distinct().collect()
    order = sorted(_order(tuple(r)) for r in sample)
    splitters = sorted({order[i * len(order) // ranges] for i in range(1, ranges)}) if order else []
    cut = runs.select("run", "at", "bytes", "first", "last").mapInArrow(_cut(splitters), "range int, run string, at bigint, bytes bigint")
    ranged = cut.repartition(ranges, "range").sortWithinPartitions("range", "run", "at")
    return stage(spark, ranged.mapInArrow(_merge(folder, splitters), f"range int, place bigint, {LISTED}"), "capture-index")


def _fetch(batches):
    held, uri = None, None
    for b in batches:
        out = {n: [] for n in ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload")}
        for e in b.to_pylist():
            if e["file"] != uri:
                if held is not None:
                    held.close()
                held, uri = blobs.open_random(e["file"]), e["file"]
            held.seek(e["offset"])
            head, block = parse(held.read(e["length"]))
            revisit = head["warc-type"] == "revisit"
            named = head["warc-payload-digest"].removeprefix("sha1:")
            if not revisit and digest(block) != named:
                raise ValueError(f"{e['file']} at {e['offset']}: payload does not match its digest")
            target = re.fullmatch(r"<urn:capture:(-?\d*)>", head["warc-refers-to"])[1] if revisit else ""
            own = re.fullmatch(r"<urn:capture:(-?\d*)>", head["warc-record-id"])[1]
            out["page_id"].append(int(own) if own else None)
            out["payload_bytes"].append(int(head["x-payload-length"]) if revisit else len(block))
            out["payload_digest"].append(named)
            out["record_type"].append(head["warc-type"])
            out["refers_to"].append(int(target) if target else None)
            out["payload"].append(None if revisit else block)
        yield pa.RecordBatch.from_pydict({
            "page_id": pa.array(out["page_id"], pa.int64()), "payload_bytes": pa.array(out["payload_bytes"], pa.int64()),
            "payload_digest": pa.array(out["payload_digest"], pa.string()), "record_type": pa.array(out["record_type"], pa.string()),
            "refers_to": pa.array(out["refers_to"], pa.int64()), "payload": pa.array(out["payload"], pa.binary()),
        })


def read_archives(index: DataFrame) -> DataFrame:
    """The records that the index names; revisits have a null ``payload``."""
    spark = index.sparkSession
    places = index.select("file", "offset", "length").repartition(partitions(spark), "file", F.floor(F.col("offset") / (8 << 20)))
    places = places.sortWithinPartitions("file", "offset")
    return places.mapInArrow(_fetch, "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, payload binary")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "warc")
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    runs = write_archives(captures(pages), folder)
    index = merge_index(runs, folder)
    return read_archives(index).drop("payload")


#: The same in SQL, for DuckDB: base32 takes the digest's bits five at a time.
OP5_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS body FROM pages
), b AS (
  SELECT page_id, strlen(body) AS payload_bytes, CAST(CAST(unhex(sha1(body)) AS BIT) AS VARCHAR) AS bits,
         max(page_id) OVER (PARTITION BY body) AS winner
  FROM p
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(0, 160, 5), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         1 + 16 * CAST(bits[i + 1] AS INTEGER) + 8 * CAST(bits[i + 2] AS INTEGER) + 4 * CAST(bits[i + 3] AS INTEGER)
           + 2 * CAST(bits[i + 4] AS INTEGER) + CAST(bits[i + 5] AS INTEGER), 1)), '') AS payload_digest,
       CASE WHEN page_id IS NOT DISTINCT FROM winner THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM winner THEN winner END AS refers_to
FROM b
"""

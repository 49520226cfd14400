import base64
import gzip
import hashlib
import random

from mailsift.llm import warc

SCHEMA = "page_id long, url string, html string, sha string, winner long, range int, file string"


def test_loser_tree_merges_any_runs():
    rng = random.Random(0)
    for k in range(12):
        for _ in range(40):
            runs = [sorted(rng.choices(range(9), k=rng.randint(0, 6))) for _ in range(k)]
            assert list(warc.LoserTree(runs)) == sorted(x for r in runs for x in r)


def test_url_keys():
    keys = {
        "http://www.Example.org:80/A?b=1#c": "org,example)/a?b=1", "https://user@example.org": "org,example)/", "//a.b:8080/x": "b,a:8080)/x",
        "not a url": "not a url", "": "", None: "",
    }
    assert {u: warc.url_key(u) for u in keys} == keys


def archive(spark, rows, tmp_path, **options):
    folder = f"{tmp_path}/w"
    pages = spark.createDataFrame([(*r, "x", 1, 1, "y") for r in rows], SCHEMA).repartition(3)
    runs = warc.write_archives(warc.captures(pages, **options), folder)
    index = warc.merge_index(runs, folder)
    return index, warc.read_archives(index)


def expected(rows, least=0):
    best = {}
    for i, _, h in rows:
        best[h or ""] = max(best.get(h or ""), i) if best.get(h or "") is not None and i is not None else (i if best.get(h or "") is None else best[h or ""])
    out = []
    for i, _, h in rows:
        body = (h or "").encode()
        revisit = len(body) >= least and i != best[h or ""]
        out.append((i, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "revisit" if revisit else "response", best[h or ""] if revisit else None))
    return out


ROWS = [(i, f"http://h{i % 3}.org/p{i % 7}", f"<p>{i % 11}é</p>\r\n\r\nWARC/1.1") for i in range(120)]
ROWS += [(200, "http://x.org/\r\nWARC-Type: evil", None), (201, None, ""), (None, None, "<p>1é</p>\r\n\r\nWARC/1.1"), (202, "u", "y" * 300_000), (202, "u", "y" * 300_000)]


def order(r):
    return tuple((x is not None, x if x is not None else 0) for x in r)


def test_round_trip_and_global_order(spark, tmp_path):
    index, records = archive(spark, ROWS, tmp_path)
    got = records.collect()
    assert sorted((tuple(r)[:5] for r in got), key=order) == sorted(expected(ROWS), key=order)
    assert all((r["payload"] is None) == (r["record_type"] == "revisit") for r in got)
    entries = index.orderBy("range", "place").collect()
    keys = [(e["key"], e["date"], e["id"] is not None, e["id"] or 0) for e in entries]
    assert keys == sorted(keys) and len(keys) == len(ROWS)
    # an archive is plain concatenated gzip, one record a member
    for file in {e["file"] for e in entries}:
        data = gzip.open(file).read()
        assert data.count(b"WARC-Record-ID: ") == sum(e["file"] == file for e in entries)
    assert index.select("range").distinct().count() > 1


def test_one_url_captured_by_many_rows_is_cut_into_ranges(spark, tmp_path):
    rows = [(i, "http://one.org/", f"{i}") for i in range(3000)]
    index, records = archive(spark, rows, tmp_path)
    sizes = [r["count"] for r in index.groupBy("range").count().collect()]
    assert len(sizes) > 1 and max(sizes) < 2500 and sum(sizes) == 3000
    assert records.count() == 3000


def test_smaller_payloads_need_no_revisit(spark, tmp_path):
    rows = [(1, "a", "xx"), (2, "b", "xx"), (3, "a", "long enough"), (4, "b", "long enough")]
    _, records = archive(spark, rows, tmp_path, min_revisit_bytes=5)
    assert sorted((tuple(r)[:5] for r in records.collect())) == sorted(expected(rows, 5))


def test_empty_table(spark, tmp_path):
    index, records = archive(spark, [], tmp_path)
    assert index.count() == 0 and records.count() == 0


def test_query(spark, sf_tiny):
    rows = [(r["page_id"], r["url"], r["html"]) for r in spark.read.parquet(f"{sf_tiny}/pages.parquet").collect()]
    got = warc.op5_warc(spark, sf_tiny)
    assert got.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert sorted(map(tuple, got.collect()), key=order) == sorted(expected(rows), key=order)

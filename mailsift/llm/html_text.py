"""Main text of web pages by differencing with the page of the nearest URL.

* Lines: a page's blocks (paragraphs, headings, list items, table rows, ...) with
  character references decoded and white space turned into single spaces. Each
  line knows its place: inside an element that never holds an article (``script``,
  ``nav``, ``footer``, ``aside``, ``form``, elements named as adverts, menus,
  notices, comments, ...), inside an ``article`` or ``main`` element, or neither.
* Pairs: pages are sorted by host, URL path and id. A page is compared with the one
  before it on its host, the first of a host with the one after it; pages with
  the very same lines are passed over, since they tell nothing.
* Differencing: the lines of both pages are aligned by a longest common subsequence,
  and lines that both share are the site's template and are deleted.
  Of equally long common subsequences one is taken; which, may depend on the size of the pages.
* What a page says about itself goes first: lines in elements that never hold an
  article are deleted though they may be unique, and lines in a marked article
  stay though another page may quote them. A name (class or id) counts as a whole word,
  or if all its parts are such words; an ``article`` or ``main`` inside an element that only its
  name speaks against is an article all the same, unless the name is one of reader comments.
  The differencing decides about all lines that are neither: those of pages without
  an article, and, where a page has more such text than text in its articles (an
  article element as teaser or quote), those too.
* Tags are read in one pass whose work is linear in the page, whatever is left open or
  closed twice; a ``<`` that no ``>`` follows before the next ``<`` is text.

Sorting by host would put a large host into one task. Instead the URLs alone, with
a hash of each page's lines, are sorted in ranges; the pages at the borders (four a
range reach the driver) tell every page its range, and tell which pages other
ranges need as partners. So each page is moved once, whatever its host, and the
pairs are those of the whole sorted table.

Null html gives an empty text; null URLs form a host of their own; null ids come
first; repeated rows give one row each. An empty table gives an empty result.
Only the three named columns are read, so others may have any name.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import partitions, prepare, stage, table

#: Elements (fixed values of HTML).
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template noembed noframes xmp".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody "
    "tfoot thead title tr ul".split()
)
#: Never part of an article.
CHROME = frozenset("nav footer aside form head menu dialog button select svg math canvas object audio video map datalist".split())
#: Roles that say the same.
CHROME_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
#: Words in class or id that name such parts.
CHROME_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promoted banner cookie cookies consent gdpr "
    "notice notices notification popup modal overlay newsletter subscribe subscription paywall sidebar menu nav navbar navigation "
    "breadcrumb breadcrumbs footer masthead related recommended share sharing social widget toolbar pagination pager login signup "
    "signin search skip".split()
)
#: Words that name reader comments, which may be article elements themselves.
COMMENT_NAMES = frozenset("comment comments commentlist disqus reply replies respond discussion".split())

#: Words that such names also have, and that say nothing.
NEUTRAL_NAMES = frozenset(
    "site page main global local top bottom left right inner outer wrap wrapper container content box block bar list item items "
    "section area panel slot unit group row col column buttons button links link icons title header form text module region".split()
)

_TAG = re.compile(r"""<!--.*?-->|<!--.*\Z|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/><]*)((?:[^>"'<]|"[^"]*"|'[^']*')*+)>""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"']+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")

PLAIN, ARTICLE, CHROME_LINE = 0, 1, 2

#: What speaks against an element: nothing, its name alone, or its kind.
NOTHING, NAME, KIND = 0, 1, 2

#: Elements that an open paragraph outside does not reach into (fixed values of HTML).
SCOPES = frozenset("applet caption html table td th marquee object template button".split())


def _attributes(text: str) -> dict[str, str]:
    return {k.lower(): html.unescape(v.strip("\"'")) for k, v in _ATTRIBUTE.findall(text)} if text.strip() else {}


def _names(attributes: dict[str, str], known: frozenset) -> bool:
    """Whether a class or id is one of ``known``, or made of such and neutral words only."""
    for name in f"{attributes.get('class', '')} {attributes.get('id', '')}".lower().split():
        parts = set(re.split(r"[-_]+", name))
        if name in known or (parts & known and parts <= known | NEUTRAL_NAMES):
            return True
    return False


def _against(tag: str, attributes: dict[str, str], in_article: bool) -> int:
    if tag in CHROME or (tag == "header" and not in_article):
        return KIND
    if not attributes or tag in ("html", "body"):
        return NOTHING
    if _names(attributes, COMMENT_NAMES):
        return KIND
    if tag in ("main", "article"):
        return NOTHING
    if (
        attributes.get("role", "").lower() in CHROME_ROLES
        or "hidden" in attributes
        or attributes.get("aria-hidden", "").lower() == "true"
        or _HIDDEN.search(attributes.get("style", "").lower())
    ):
        return KIND
    return NAME if _names(attributes, CHROME_NAMES) else NOTHING


def lines_of(page: str | None) -> list[tuple[str, int]]:
    """The lines of a page and the place of each."""
    if not page:
        return []
    out: list[tuple[str, int]] = []
    held: list[str] = []
    stack: list[tuple[str, int, bool]] = []  # tag, what speaks against it or an outer element, in an article
    opened: dict[str, int] = {}  # how many of the stack have that tag
    paragraphs = [-1]  # by scope: where in the stack its open paragraph is
    against, article = NOTHING, False
    at = 0

    def flush() -> None:
        if held:
            text = " ".join("".join(held).split())
            held.clear()
            if text:
                out.append((text, CHROME_LINE if against else ARTICLE if article else PLAIN))

    def close(depth: int) -> None:
        """Leave the elements from ``depth`` on."""
        nonlocal against, article
        outside = stack[depth - 1][1:] if depth else (NOTHING, False)
        if any(s[1:] != outside for s in stack[depth:]):
            flush()
        while len(stack) > depth:
            tag = stack.pop()[0]
            opened[tag] -= 1
            if tag in SCOPES:
                paragraphs.pop()
            elif tag == "p":
                paragraphs[-1] = -1
        against, article = outside

    while True:
        m = _TAG.search(page, at)
        text = page[at : m.start()] if m else page[at:]
        if text:
            held.append(html.unescape(text) if "&" in text else text)
        if not m:
            break
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if tag in BLOCK or tag in CHROME:
            flush()
        elif tag in ("br", "td", "th"):
            held.append(" ")
        if m[1]:
            if opened.get(tag):
                depth = len(stack) - 1
                while stack[depth][0] != tag:
                    depth -= 1
                close(depth)
            continue
        if tag in RAW:
            end = _RAW_END[tag].search(page, at)
            at = end.end() if end else len(page)
            continue
        if tag in VOID or m[3].endswith("/"):
            continue
        if paragraphs[-1] >= 0 and tag in BLOCK and tag not in ("li", "dd", "dt", "tr"):
            close(paragraphs[-1])
        own = _against(tag, _attributes(m[3]), article)
        is_article = tag in ("article", "main")
        # an article that only outer names speak against is one all the same
        now = (own if is_article and against == NAME else max(against, own), article or is_article)
        if now != (against, article):
            flush()
        if tag == "p":
            paragraphs[-1] = len(stack)
        elif tag in SCOPES:
            paragraphs.append(-1)
        stack.append((tag, *now))
        opened[tag] = opened.get(tag, 0) + 1
        against, article = now
    flush()
    return out


_RAW_END = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in RAW}


def common_lines(a: list, b: list) -> set[int]:
    """Positions of ``a`` on a longest common subsequence with ``b``.

    Bit-parallel rows (one big integer each); where they would take over 32 MB the
    problem is halved at the middle row first, so memory stays bounded."""
    shared = set(a) & set(b)
    xs = [i for i, x in enumerate(a) if x in shared]
    found: list[int] = []
    _align([a[i] for i in xs], [x for x in b if x in shared], 0, found)
    return {xs[i] for i in found}


def _rows(a: list, b: list, keep: bool):
    where: dict = {}
    for j, x in enumerate(b):
        where[x] = where.get(x, 0) | 1 << j
    full = (1 << len(b)) - 1
    v, rows = full, []
    for x in a:
        u = v & where.get(x, 0)
        v = ((v + u) | (v - u)) & full
        if keep:
            rows.append(v)
    return rows if keep else v


def _lengths(a: list, b: list) -> np.ndarray:
    """Length of the longest common subsequence of ``a`` with every prefix of ``b``."""
    v = _rows(a, b, False)
    bits = np.unpackbits(np.frombuffer(v.to_bytes(len(b) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(b)]
    return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])


def _align(a: list, b: list, base: int, out: list[int]) -> None:
    start = 0
    while start < len(a) and start < len(b) and a[start] == b[start]:
        out.append(base + start)
        start += 1
    a, b, base = a[start:], b[start:], base + start
    while a and b and a[-1] == b[-1]:
        out.append(base + len(a) - 1)
        a, b = a[:-1], b[:-1]
    if not a or not b:
        return
    if len(a) * len(b) > 1 << 28 and len(a) > 1:
        half = len(a) // 2
        total = _lengths(a[:half], b) + _lengths(a[half:][::-1], b[::-1])[::-1]
        cut = int(total.argmax())
        _align(a[:half], b[:cut], base, out)
        _align(a[half:], b[cut:], base + half, out)
        return
    rows = _rows(a, b, True)
    i, j = len(a) - 1, len(b) - 1
    while i >= 0 and j >= 0:
        if rows[i] >> j & 1:
            j -= 1
        elif i and not rows[i - 1] >> j & 1:
            i -= 1
        else:
            out.append(base + i)
            i, j = i - 1, j - 1


def keep_lines(places: list[int], hashes: list[int], mate: list[int] | None, sizes: list[int]) -> list[int]:
    """Positions of the lines that are main text; ``sizes`` are the lengths of the lines."""
    marked = sum(n for n, p in zip(sizes, places) if p == ARTICLE)
    plain = [i for i, p in enumerate(places) if p == PLAIN]
    if sum(sizes[i] for i in plain) > marked and mate and mate != hashes:
        shared = common_lines(hashes, mate)
        plain = [i for i in plain if i not in shared]
    if marked and sum(sizes[i] for i in plain) <= marked:
        plain = []
    return sorted(plain + [i for i, p in enumerate(places) if p == ARTICLE])


_HOST = r"(?i)^(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#]*)"
_PATH = r"(?i)^(?:[a-z][a-z0-9+.-]*:)?//[^/?#]*([^#]*)"

PAGE = "block int, host string, path string, page_id bigint, url string, partner boolean, hashes array<bigint>, places array<tinyint>, texts array<string>"


EDGES = ", ".join(f"{n} struct<host: string, path: string, page_id: bigint, lines: bigint>" for n in ("first", "last", "first_other", "last_other"))


def _digests(batches):
    """The sort key of each page and a hash of all its lines."""
    for b in batches:
        got = [xxhash.xxh64_intdigest("\n".join(t for t, _ in lines_of(p))) - (1 << 63) for p in b.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(n) for n in ("host", "path", "page_id")] + [pa.array(got, pa.int64())], ["host", "path", "page_id", "lines"])


def _edges(batches):
    """Of a sorted range: its first and last page, and the nearest to each that is on the
    same host and has other lines."""
    first = last = first_other = last_other = None
    at_first = True
    for b in batches:
        for row in b.to_pylist():
            if first is None:
                first = row
            elif at_first and row["host"] != first["host"]:
                at_first = False
            elif at_first and first_other is None and row["lines"] != first["lines"]:
                first_other = row
            if last is not None and row["host"] != last["host"]:
                last_other = None
            elif last is not None and row["lines"] != last["lines"]:
                last_other = last
            last = row
    if first is not None:
        kind = pa.struct([("host", pa.string()), ("path", pa.string()), ("page_id", pa.int64()), ("lines", pa.int64())])
        values = {"first": first, "last": last, "first_other": first_other, "last_other": last_other}
        yield pa.RecordBatch.from_pydict({n: pa.array([v], kind) for n, v in values.items()})


def _partners(ranges: list[dict]) -> dict[tuple, set[int]]:
    """For each range the nearest pages before and after it that are on the host of its
    first (last) page and have other lines: key of the page -> ranges that need it."""
    out: dict[tuple, set[int]] = {}
    for order, near, far, other in ((ranges, "first", "last", "last_other"), (ranges[::-1], "last", "first", "first_other")):
        page = differs = None  # the page just passed, and the nearest one to it with other lines
        for r in order:
            edge = r[near]
            same = page is not None and page["host"] == edge["host"]
            partner = page if same and page["lines"] != edge["lines"] else differs if same else None
            if partner is not None:
                out.setdefault(_key(partner), set()).add(r["number"])
            if r[other] is not None:
                differs = r[other]
            elif r["first"]["host"] != r["last"]["host"] or not same:
                differs = None
            elif page["lines"] != r[far]["lines"]:
                differs = page
            page = r[far]
    return out


def _key(row: dict) -> tuple:
    """Order of Spark's sort: UTF-8 strings, null ids first."""
    return (row["host"], row["path"], row["page_id"] is not None, row["page_id"] or 0)


def _deal(firsts: list[tuple], partners: dict[tuple, set[int]]):
    """Each page's lines to its range, and to other ranges that need it as a partner."""

    def run(batches):
        for b in batches:
            out = {n: [] for n in ("block", "host", "path", "page_id", "url", "partner", "hashes", "places", "texts")}
            for row in b.to_pylist():
                lines = lines_of(row["html"])
                hashes = [xxhash.xxh64_intdigest(t) - (1 << 63) for t, _ in lines]
                places = [p for _, p in lines]
                sizes = [sum(len(t) for t, p in lines if p == place) for place in (PLAIN, ARTICLE)]
                settled = sizes[1] >= sizes[0] and ARTICLE in places  # plain lines go, whatever the neighbour has
                texts = ["" if p == CHROME_LINE or (settled and p == PLAIN) else t for t, p in lines]
                key = _key(row)
                block = max(0, bisect_right(firsts, key) - 1)
                for to in (block, *sorted(partners.get(key, ()))):
                    partner = to != block
                    values = (to, row["host"], row["path"], row["page_id"], row["url"], partner, hashes, places, [] if partner else texts)
                    for n, v in zip(out, values):
                        out[n].append(v)
            types = {"block": pa.int32(), "page_id": pa.int64(), "partner": pa.bool_(), "hashes": pa.list_(pa.int64()), "places": pa.list_(pa.int8()), "texts": pa.list_(pa.string())}
            yield pa.RecordBatch.from_pydict({n: pa.array(v, types.get(n, pa.string())) for n, v in out.items()})

    return run


def _difference(batches):
    """Compare each page of a sorted range with its neighbour on the host."""
    done: list[tuple] = []

    def finish(row: dict, mate: list[int] | None) -> None:
        if not row["partner"]:
            kept = keep_lines(row["places"], row["hashes"], mate, list(map(len, row["texts"])))
            done.append((row["page_id"], row["url"], "\n".join(row["texts"][i] for i in kept)))

    def result() -> pa.RecordBatch:
        columns = list(zip(*done)) or [(), (), ()]
        done.clear()
        return pa.RecordBatch.from_pydict({"page_id": pa.array(columns[0], pa.int64()), "url": pa.array(columns[1], pa.string()), "text": pa.array(columns[2], pa.string())})

    site, last, other, waiting = None, None, None, []
    for b in batches:
        for i in range(b.num_rows):
            row = b.slice(i, 1).to_pylist()[0]
            if (row["block"], row["host"]) != site:
                for w in waiting:
                    finish(w, None)
                site, last, other, waiting = (row["block"], row["host"]), None, None, []
            if last is not None and row["hashes"] != last:
                for w in waiting:  # the first pages of a host: compared with the next that differs
                    finish(w, row["hashes"])
                waiting, other = [], last
            last = row["hashes"]
            if other is None:
                waiting.append(row)
            else:
                finish(row, other)
        yield result()
    for w in waiting:
        finish(w, None)
    yield result()


def main_text(pages: DataFrame, *, page_id: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """``page_id, url, text`` of every row of ``pages``."""
    spark = pages.sparkSession
    prepare(spark)
    link = F.coalesce(pages[url].cast("string"), F.lit(""))
    rows = pages.select(
        F.lower(F.regexp_extract(link, _HOST, 1)).alias("host"), F.regexp_extract(link, _PATH, 1).alias("path"),
        pages[page_id].cast("bigint").alias("page_id"), pages[url].cast("string").alias("url"), pages[page].cast("string").alias("html"),
    )
    order = ["host", "path", "page_id"]
    keys = rows.select(*order, "html").mapInArrow(_digests, "host string, path string, page_id bigint, lines bigint")
    keys = stage(spark, keys, "page-keys")
    keys = keys.repartitionByRange(4 * partitions(spark), *order).sortWithinPartitions(*order, "lines")
    ranges = sorted((r.asDict(True) for r in keys.mapInArrow(_edges, EDGES).collect()), key=lambda r: _key(r["first"]))
    for n, r in enumerate(ranges):
        r["number"] = n
    dealt = rows.mapInArrow(_deal([_key(r["first"]) for r in ranges], _partners(ranges)), PAGE)
    dealt = dealt.repartitionById(partitions(spark), "block").sortWithinPartitions("block", *order, "url", "partner")
    return dealt.mapInArrow(_difference, "page_id bigint, url string, text string")


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return got.withColumn("n_chars", F.length("text").cast("bigint"))

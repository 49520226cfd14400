import html
import random
import re

import pytest

from mailsift.llm import html_text


def lcs_length(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


@pytest.mark.parametrize("halve", [False, True])
def test_common_lines_is_a_longest_common_subsequence(halve, monkeypatch):
    rng = random.Random(7)
    if halve:
        align = html_text._align
        source = __import__("inspect").getsource(align).replace("1 << 28", "8")
        space = dict(vars(html_text))
        exec(source, space)
        monkeypatch.setattr(html_text, "_align", space["_align"])
    for _ in range(1500):
        a, b = (rng.choices("abcde", k=rng.randint(0, 14)) for _ in "xx")
        got = sorted(html_text.common_lines(a, b))
        rest = iter(b)
        assert all(x in rest for x in (a[i] for i in got)) and len(got) == lcs_length(a, b)


def kept(page, mate=None):
    lines = html_text.lines_of(page)
    hashes = [t for t, _ in lines]
    other = [t for t, _ in html_text.lines_of(mate)] if mate is not None else None
    return [lines[i][0] for i in html_text.keep_lines([p for _, p in lines], hashes, other, [len(t) for t, _ in lines])]


def test_places():
    page = """<html><head><title>T</title><script>var x = "</p><article>";</script></head><body class="no-sidebar"><nav>menu</nav>
      <header>site</header><article><header><h1>Head</h1></header><p>One<p>two <b>bold&nbsp;x</b>&amp;lt;<br>three
      <div class="ad">buy</div><aside>side</aside><form>f<input value="<p>">g</form><style>p{}</style><ul><li>i<li>j</ul>
      <div id="comments"><article class="comment">reader</article></div><p hidden>h</p><p style="display: none">n</p></article>
      <div>outside</div><footer>foot</footer>"""
    assert kept(page) == ["Head", "One", "two bold x&lt; three", "i", "j"]
    assert kept("") == kept(None) == [] and kept("plain < text & more") == ["plain < text & more"]
    assert kept("<p>a<!-- <p>b --><p>c<!-- open <p>d") == ["a", "c"]
    assert kept("<script>never closed <p>a") == [] and kept("</div></p>x</nav>y</b>z") == ["x", "yz"]
    assert kept("<nav><p>a<div>b</nav><p>c") == ["c"]


def test_pages_without_landmarks_lose_what_neighbours_share():
    menu, foot = "<div>Home</div><div>About us</div>", "<p>All rights reserved</p>"
    a, b = f"{menu}<p>first story</p><p>more</p>{foot}", f"{menu}<p>second story</p>{foot}"
    assert kept(a, b) == ["first story", "more"] and kept(b, a) == ["second story"]
    assert kept(a, a) == ["Home", "About us", "first story", "more", "All rights reserved"]


def test_names_are_whole_words_and_articles_survive_them():
    assert kept('<div class="layout has-sidebar"><article><p>Main.</p></article></div>') == ["Main."]
    assert kept('<div class="wrap no-footer"><main>Main.</main></div>') == ["Main."]
    assert kept('<article><p>One.<p class="share-price">The share rose.</p></article>') == ["One.", "The share rose."]
    assert kept('<div class="sidebar-wrap"><article>Main.</article><p>links</p></div>') == ["Main."]
    assert kept('<div class="ad-slot">buy</div><p class="cookie_banner">ok?</p><p>Main.') == ["Main."]
    assert kept('<section id="comments"><article>reader</article></section><p>Main.') == ["Main."]
    assert kept('<nav><article>x</article></nav><p>Main.') == ["Main."]


def test_a_teaser_is_not_the_page():
    """More plain text than article: the neighbour decides about the plain lines."""
    menu, foot = "<div>Home and more of it</div>", "<p>All rights reserved for ever</p>"
    teaser = "<article><p>Read on</p></article>"
    a, b = f"{menu}<p>A long first story.</p>{teaser}{foot}", f"{menu}<p>Another story, as long.</p>{teaser}{foot}"
    assert kept(a, b) == ["A long first story.", "Read on"] and kept(b, a) == ["Another story, as long.", "Read on"]


def test_paragraphs_end_where_blocks_begin():
    assert kept("<p>a<b><i><u><s><em>b<div>c</div>d") == ["ab", "c", "d"]
    assert kept("<p hidden>a<span><b><i><u><s>x<p>b") == ["b"]
    assert kept("<table><tr><td><p>a<table><tr><td><p>b</td></tr></table>c</table>d") == ["a", "b", "c", "d"]


@pytest.mark.parametrize("page", ["<a " * 20_000, "<i>" * 20_000 + "</b>" * 20_000, "<p>" + "<b>" * 20_000 + "<div>" * 20_000, "<a '" * 20_001, "<!-- " * 20_000,
                                  "</p>" * 20_000 + "<td>" * 20_000 + "<p>" * 20_000, "<script>" * 20_000, "&" * 60_000, '<div class="' + "ad-" * 20_000 + '">x'])
def test_odd_markup_takes_linear_time(page):
    import time

    began = time.process_time()
    html_text.lines_of(page)
    assert time.process_time() - began < 1.5


def brute_texts(rows):
    """Main texts with partners found by a plain search along each host's sorted pages."""
    hosts = {}
    for r in rows:
        page_id, url = r[0], r[1] or ""
        m = re.match(html_text._HOST, url)
        path = re.match(html_text._PATH, url)
        hosts.setdefault(m[1].lower() if m else "", []).append(((path[1] if path else "").encode(), page_id is not None, page_id or 0, r))
    out = []
    for pages in hosts.values():
        pages.sort(key=lambda x: (*x[:3], html_text.lines_of(x[3][2]) != [], x[3][2] or ""))
        lines = [html_text.lines_of(x[3][2]) for x in pages]
        texts = [[t for t, _ in x] for x in lines]
        for i, x in enumerate(pages):
            before = next((texts[j] for j in range(i - 1, -1, -1) if texts[j] != texts[i]), None)
            mate = before if before is not None else next((texts[j] for j in range(i + 1, len(pages)) if texts[j] != texts[i]), None)
            out.append((x[3][0], "\n".join(kept(x[3][2], x[3][2]) if mate is None else [texts[i][k] for k in html_text.keep_lines(
                [p for _, p in lines[i]], texts[i], mate, list(map(len, texts[i])))])))
    return sorted(out, key=str)


def test_partners_of_every_host(spark):
    """Hosts in several spellings, many ranges, runs of equal pages: as a plain search finds them."""
    rng = random.Random(11)
    rows = []
    for n in range(400):
        h = rng.choice(["one.org", "ONE.org", "two.org", "user@two.org", "three.org"])
        story = rng.randrange(60)
        shared = "".join(f"<div>line {rng.randrange(4)}</div>" for _ in range(rng.randrange(4)))
        rows.append((n, f"{rng.choice(['http', 'HTTPS'])}://{h}/{rng.choice('abc')}/{rng.randrange(90):02d}?q={n}", f"{shared}<p>story {story}</p><p>end</p>", "t", 1))
    rows += [(1000 + n, "//hot.org/x", "<p>same</p>", "t", 1) for n in range(60)] + [(2000, "//hot.org/y", "<p>same</p><p>other</p>", "t", 1)]
    got = [(r["page_id"], r["text"]) for r in html_text.main_text(frame(spark, rows)).collect()]
    assert sorted(got, key=str) == brute_texts(rows)


def frame(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, text string, block int")


def test_neighbours_across_hosts_ranges_and_copies(spark):
    def page(host, n):
        return f"<div>{host} menu</div><p>story {host} {n}</p><div>foot of {host}</div>"

    rows = [(k * 100 + n, f"https://{h}/a/{n:03d}?x=1#y", page(h, n), "t", 1) for k, h in enumerate(["one.org", "two.org", "ONE.org"]) for n in range(40)]
    rows += [(900 + n, "https://three.org/x", page("three.org", 1), "t", 1) for n in range(30)] + [(950, "https://three.org/y", page("three.org", 2), "t", 1)]
    rows += [(None, None, None, None, None), (None, None, "<p>nameless</p>", None, None), (1000, "", "", "", 0), (1001, "not a url", "<p>b", None, None)]
    got = html_text.main_text(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    texts = {r["page_id"]: r["text"] for r in got if r["page_id"] is not None}
    for k, h in enumerate(["one.org", "two.org", "ONE.org"]):
        # the pages of one host in two spellings take turns, so each differs in all lines from its neighbour
        want = "{1}" if k == 1 else "{0} menu\n{1}\nfoot of {0}"
        assert all(texts[k * 100 + n] == want.format(h, f"story {h} {n}") for n in range(40)), h
    assert all(texts[900 + n] == "story three.org 1" for n in range(30)) and texts[950] == "story three.org 2"
    assert sorted(r["text"] for r in got if r["page_id"] is None) == ["", "nameless"] and texts[1000] == ""
    assert html_text.main_text(frame(spark, [])).collect() == []


def test_query_returns_the_articles(spark, sf_tiny):
    want = {}
    for r in spark.read.parquet(f"{sf_tiny}/pages.parquet").collect():
        article = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"</?b>", "", x).replace("<br>", " ")).split()) for x in re.split(r"</?(?:p|h1)>", article)]
        want[r["page_id"]] = "\n".join(x for x in blocks if x)
    got = html_text.op2_html_text(spark, sf_tiny).collect()
    assert {r["page_id"]: r["text"] for r in got} == want and all(r["n_chars"] == len(r["text"]) for r in got)

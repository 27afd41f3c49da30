import re
import time
from collections import defaultdict
from html.parser import HTMLParser

import pytest

from tessarine.llm import html_text
from tessarine.llm.html_text import Page


def page(k, body):
    nav = "<nav><ul><li><a href='/a'>Home</a></li><li><a href='/b'>News</a></li></ul></nav>"
    return f"<!DOCTYPE html><html><head><title>T{k}</title><style>p{{}}</style></head><body>{nav}<article><h1>Title {k}</h1>{body}</article><footer>&copy; 2024 <b>Site</b></footer></body></html>"


class Tree(HTMLParser):
    """A second parser for well-formed pages: nested (tag, attributes, children)."""

    def __init__(self, source):
        super().__init__()
        self.stack = [("", (), [])]
        self.feed(source)

    def handle_starttag(self, tag, attrs):
        node = (tag, tuple(attrs), [])
        self.stack[-1][2].append(node)
        if tag not in ("br", "meta"):
            self.stack.append(node)

    def handle_endtag(self, tag):
        self.stack.pop()

    def handle_data(self, data):
        self.stack[-1][2].append(data)


def frozen(node):
    return node if isinstance(node, str) else (node[0], node[1], tuple(frozen(c) for c in node[2]))


def visible(node, gone=frozenset()):
    if isinstance(node, str):
        return [node]
    if node[0] in ("head", "style", "script", "title") or frozen(node) in gone:
        return []
    return [x for c in node[2] for x in visible(c, gone)]


def nodes(node):
    if not isinstance(node, str):
        if node[0] not in ("", "html", "body") and any(x.strip() for x in visible(node)):
            yield frozen(node)
        for c in node[2]:
            yield from nodes(c)


FURNITURE = set("nav header footer aside div section ul ol dl li dd dt table tbody tr form fieldset figure address details menu".split())


def light(node, total, inside=False):
    """Subtrees that may be furniture: no content by tag or place, with at most half of the page's text."""
    if isinstance(node, str):
        return
    here = inside or node[0] in ("article", "main")
    if node[0] in FURNITURE and not here and any(x.strip() for x in visible(node)) and 2 * size(node) <= total:
        yield frozen(node)
    for c in node[2]:
        yield from light(c, total, here)


def size(node):
    return sum(len(re.sub(r"\s+", " ", x)) for x in visible(node) if x.strip())


def brute(pages, least, share, content=0.3):
    hosts, trees = defaultdict(dict), {}
    for page_id, url, source in pages:
        trees[page_id] = Tree(source).stack[0]
        hosts[url.split("/")[2].lower()].setdefault(source, []).append(page_id)
    out = {}
    for own in hosts.values():
        count, light_count = defaultdict(int), defaultdict(int)
        for ids in own.values():
            for n in set(nodes(trees[ids[0]])):
                count[n] += 1
            for n in set(light(trees[ids[0]], size(trees[ids[0]]))):
                light_count[n] += 1
        gone = {n for n, c in count.items() if c >= least and (c >= content * len(own) or light_count[n] >= max(least, share * len(own)))}
        for ids in own.values():
            for p in ids:
                out[p] = "".join("".join(visible(trees[p], gone)).split())
    return out


PAGES = [(k, f"http://{'Big.Example' if k % 3 else 'small.example'}:80/x/{k}", page(k, f"<p>Text number {k}.</p><p>Same words on some pages {k % 4}.</p><p>tail<br>{k // 2}</p>")) for k in range(40)]


#: An article and a box on few pages, the box beside the content; repeated pages.
PAGES += [(100 + k, f"http://small.example/q/{k}", page(k, "<p>A quoted article of several words, the same on four pages.</p>") + f"<div>box <b>{k % 2}</b></div>") for k in range(4)]
PAGES += [(200 + k, "http://small.example/r", page(77, "<p>Only here, five times.</p><ul><li>a list</li></ul>")) for k in range(5)]


@pytest.mark.parametrize("ship", [1 << 20, 0])
@pytest.mark.parametrize("share", [0.01, 0.5])
def test_against_brute_force(spark, ship, share):
    frame = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    got = {r.page_id: "".join(r.extracted.text.split()) for r in html_text.extract(frame, 3, share, ship_bytes=ship).collect()}
    want = brute([(p, u.replace(":80", ""), h) for p, u, h in PAGES], 3, share)
    assert got == want and "Home" not in got[1] and "Textnumber1." in got[1]
    assert "quotedarticle" in got[101] and "Onlyhere" in got[201] and "alist" in got[201]


def test_hot_hosts_are_spread(spark, monkeypatch):
    monkeypatch.setattr(html_text, "HOT", 5)
    frame = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    got = {r.page_id: r.extracted for r in html_text.extract(frame, ship_bytes=0).collect()}
    assert got == {r.page_id: r.extracted for r in html_text.extract(frame).collect()}


def test_query_on_test_pages_against_brute_force(spark):
    """Which subtrees are templates, counted in one loop over the whole table."""
    sf = "/root/testdata/sf0.01"
    rows = [(r.page_id, r.url, r.html) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    hosts = defaultdict(dict)
    for page_id, url, source in rows:
        found = re.match(html_text.HOST, url or "")
        hosts[found[1].lower() if found else ""].setdefault(source, []).append(page_id)
    want = {}
    for host, own in hosts.items():
        count, furniture = defaultdict(int), defaultdict(int)
        pages = {source: Page(source) for source in own if source is not None}
        for p in pages.values():
            for n in {n for n, _, _ in p.nodes}:
                count[n] += 1
            for n in {n for (n, _, _), f in zip(p.nodes, p.furniture, strict=True) if f}:
                furniture[n] += 1
        gone = {n for n, c in count.items() if host and c >= 3 and (c >= 0.3 * len(pages) or furniture[n] >= max(3, 0.01 * len(pages)))}
        for source, ids in own.items():
            want |= {i: pages[source].text(gone) if source is not None else (None, 0) for i in ids}
    got = {r.page_id: (r.text, r.removed) for r in html_text.query(spark, sf).collect()}
    assert got == want and sum(n for _, n in want.values()) > 0


def test_unclosed_marks_take_linear_time():
    began = time.perf_counter()
    for bad in ("<!-", "<!x", "<?", "<!--", "<a ", "<a '", "</"):
        assert Page("<p>a</p>" + bad * 300_000).nodes
    assert time.perf_counter() - began < 20


def test_very_long_pages(spark):
    long = page(1, "".join(f"<p>word{k}</p>" for k in range(60_000)))
    [got] = html_text.extract(spark.createDataFrame([(1, "http://a.example/", long)], "page_id long, url string, html string")).collect()
    assert got.extracted.text.count("word") == 60_000


def test_test_pages_against_brute_force(spark, sf):
    """The pages that a strict parser reads alike."""
    frame = spark.read.parquet(f"{sf}/pages.parquet")
    rows = [(r.page_id, r.url, r.html) for r in frame.collect()]
    got = {r.page_id: r.extracted for r in html_text.extract(frame, 2, 0.01).collect()}
    assert len(got) == len(rows) and all(g.text for g in got.values())
    assert "track(" not in "".join(g.text for g in got.values())


def test_tag_soup():
    soup = Page("<ul><li>a<li>b<ul><li>c</ul><li>d</ul><p>one<p>two<div>x</span></div><td>y<b>z</i>&amp;<!-- <p>no</p> --><script>if(a<b){'</p>'}</script><title>t</title>end")
    assert soup.text(())[0].split("\n") == ["a", "b", "c", "d", "one", "two", "x", "yz&end"]
    assert Page("plain < text > 1").text(())[0] == "plain < text > 1" and Page("<p").text(())[0] == "<p" and Page("").text(()) == ("", 0)
    deep = "<div>" * 5000 + "x" + "</div>" * 5000
    assert Page(deep).text(())[0] == "x"


def test_outermost_subtrees_go_once():
    p = Page("<div><p>a</p><p>b</p></div><p>a</p>")
    keys = {k for k, *_ in p.nodes}
    assert p.text(keys) == ("", 2)


def test_awkward_and_empty(spark):
    schema = "page_id long, url string, html string, extracted int, _host string, _key int"
    assert html_text.extract(spark.createDataFrame([], schema)).columns[-1] == "extracted_"
    same = ("http://h.example/", "<body><p>same</p></body>")
    rows = [(1, None, "<p>a</p>", 1, "x", 1), (2, "not a url", "<p>a</p>", 1, "x", 1), (3, "http://h.example/1", None, 1, "x", 1), (4, "http://h.example/2", "", 1, "x", 1)]
    rows += [(5, f"{same[0]}{k}", same[1].replace('</body>', f'{k}</body>'), 1, "x", 1) for k in range(4)] + [(None, None, None, None, None, None)]
    for ship in (1 << 20, 0):
        out = html_text.extract(spark.createDataFrame(rows, schema), 3, 0.01, ship_bytes=ship)
        got = sorted((r.page_id or 0, r.extracted_.text, r.extracted_.removed) for r in out.collect() if r.page_id != 3)
        assert got == sorted([(0, None, 0), (1, "a", 0), (2, "a", 0), (4, "", 0)] + [(5, str(k), 1) for k in range(4)], key=lambda x: x[0])
        assert html_text.extract(spark.createDataFrame([], schema), ship_bytes=ship).count() == 0

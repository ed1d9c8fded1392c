"""HTML extraction, links, fetching rules, seeds and crawls over small webs."""

import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from ravelin.functions.urls import LinkPolicy, canonical_link, is_article, resolve_link
from ravelin.operators import crawl as crawling
from ravelin.operators.crawl import CrawlConfig, DeadlineExceeded, crawl, first_seen, pages_to_index, unseen
from ravelin.schemas import WEB
from ravelin.sources.html import extract, page_content, page_links
from ravelin.sources.seed import SeedError, request_url, resolve_seed, seed_of_response
from ravelin.sources.web import fetched, live_web

W = "https://en.wikipedia.org/wiki/"
P = LinkPolicy()
LONG = "a paragraph of more than forty characters, surely"


@pytest.mark.parametrize(
    ("href", "want"),
    [
        ("/wiki/Alpha", "Alpha"), ("/wiki/Alpha#s", "Alpha"), ("/wiki/Alpha?x=1", "Alpha"), ("Beta", "Beta"), ("./Beta", "Beta"), ("../wiki/G", "G"),
        ("//en.wikipedia.org/wiki/P", "P"), ("/wiki/AC%2FDC", "AC%2FDC"), ("#top", "Base"),
    ],
)
def test_links_kept(href, want):
    assert resolve_link(href, W + "Base", P) == W + want
    assert page_links(f'<a href="{href}">', W + "Base", P) == [W + want]


@pytest.mark.parametrize("href", ["", "mailto:a@b.c", "https://de.wikipedia.org/wiki/D", "/w/index.php?title=X", "http://[bad", "http://en.wikipedia.org/wiki/H",
                                  "/wiki/", "/wiki/Main_Page", "/wiki/File:X.png", "/wiki/A_(Disambiguation)"])
def test_links_refused(href):
    assert page_links(f'<a href="{href}">', W + "Base", P) == []


def test_links_order_and_first_href():
    html = '<a href="/wiki/B">1</a><p><a href=/wiki/A href=/wiki/C>2</a><a>none</a><a href="/wiki/B#x">again</a>'
    assert page_links(html, W + "X", P) == [W + "B", W + "A"]


def test_links_in_columns(spark):
    rows = spark.createDataFrame([(f" {W}A#h ",), (W + "Talk:A",), (W,), ("x",), (None,), ("http://en.wikipedia.org/wiki/H",)], "u string")
    got = [r.ok for r in rows.select(is_article(canonical_link(F.col("u"), P), P).alias("ok")).collect()]
    assert got == [True, False, False, False, False, False]


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ("<title>  A \n B </title><body></body>", ("A B", "")),
        (f"<body><p>{'é' * 39}</p><p>{'é' * 40}</p>", ("", "é" * 40)),
        (f"<body><p>{LONG}</p><p>{LONG}!</p>", ("", f"{LONG}\n\n{LONG}!")),
        ("<body> <p>short</p>\n<div>one <b>two</b></div>", ("", "short one two")),
        (f"<body><p>{LONG} one<br>two</p>", ("", f"{LONG} onetwo")),
        (f"<body><p>{LONG}a<p>{LONG}b<div>c</div>", ("", f"{LONG}a\n\n{LONG}b")),
        (f"<body><script>var t='</p>'</script><p>{LONG}<script>x</script></p>", ("", LONG)),
        (f'<body><p>{LONG}<sup class="x reference">[1]</sup></p><table class="infobox"><tr><td><p>{LONG}</table><div class="reflist"><p>{LONG}</div>', ("", LONG)),
        (f'<body><div id="toc"><p>{LONG}</p></div><div class="hatnote">no</div><table class="wide"><tr><td><p>{LONG}</table>', ("", LONG)),
        (f'<main><p>{LONG}m</main><div id="mw-content-text"><p>{LONG}</div>', ("", LONG)),
        (f'<div id="mw-content-text"><p>{LONG}1</p><div class="mw-parser-output"><p>{LONG}2</div></div>', ("", f"{LONG}2")),
        (f"<ul><li><p>{LONG}1<li><p>{LONG}2</ul>", ("", f"{LONG}1\n\n{LONG}2")),
        ("plain &amp; simple", ("", "plain & simple")),
        (f"<p>{LONG}<p title='a>b'>{LONG} <b>unclosed <i>x", ("", f"{LONG}\n\n{LONG} unclosed x")),
        ("", ("", "")),
        (None, ("", "")),
    ],
)
def test_content(html, want):
    assert page_content(html) == want


def test_deep_nesting():
    assert page_content("<div>" * 5000 + f"<p>{LONG}")[1] == LONG


def test_extract_table(spark):
    rows = spark.createDataFrame([("u1", None, 1), (W + "B", f"<title>T</title><p>{LONG}<a href=C>c</a>", 2)], "url string, html string, title int")
    got = {r.url: (r.title, r.body, r.links) for r in extract(rows).collect()}
    assert got == {"u1": ("", "", []), W + "B": ("T", LONG + "c", [W + "C"])}


def test_fetch_rules(spark):
    web = spark.createDataFrame(
        [("ok", 200, "text/HTML; x", "<p>é"), ("xml", 299, "application/xhtml+xml", "x"), ("404", 404, "text/html", "x"), ("img", 200, "image/png", "x"),
         ("none", 200, None, "x"), ("empty", 200, "text/html", None), ("twice", 200, "text/html", "a"), ("twice", 404, "text/html", "b")], WEB)
    urls = spark.createDataFrame([(u,) for u in ("ok", "xml", "404", "img", "none", "empty", "twice", "lost")], "url string")
    got = {r.url: (r.status, r.bytes, r.html, r.err) for r in fetched(urls, web, 4).collect()}
    assert got["ok"] == (200, 4, "<p>�", None)
    assert got["xml"][3] is None
    assert got["empty"] == (200, 0, "", None)
    assert [got[u][3] for u in ("404", "img", "none", "twice", "lost")] == ["status 404", "content type image/png", "no content type", "status 404", "not found"]


def test_seeds(spark):
    def answer(body, status=200):
        return lambda url: (status, body if isinstance(body, str) else json.dumps(body))

    assert resolve_seed("a b", answer(["a b", ["A"], [""], [W + "A"]])) == W + "A"
    assert "search=a+b" in request_url("a b")
    for bad in (answer("{"), answer([1, 2, 3]), answer(["q", [], [], []]), answer(["q", [], [], [5]]), answer(["q", [], [], [""]]), answer([], 500)):
        with pytest.raises(SeedError):
            resolve_seed("q", bad)
    with pytest.raises(SeedError):
        resolve_seed("", answer([]))

    def fails(url):
        raise OSError("no network")

    with pytest.raises(SeedError):
        resolve_seed("q", fails)
    rows = spark.createDataFrame([(json.dumps(["q", ["A"], [""], [W + "A", "b"]]),), (json.dumps(["q", [], [], []]),), ("[1]",), (None,)], "b string")
    assert [r.s for r in rows.select(seed_of_response(F.col("b")).alias("s")).collect()] == [W + "A", None, None, None]


def web_of(spark, links, size=None, missing=()):
    rows = [(W + n, 404 if n in missing else 200, "text/html", "".join(f'<a href="/wiki/{t}">' for t in to)) for n, to in links.items()]
    rows = [(u, s, c, h.ljust(size) if size else h) for u, s, c, h in rows]
    return spark.createDataFrame(rows, WEB)


def names(result):
    return [(r.url.removeprefix(W), r.depth) for r in result.pages.orderBy("ord").collect()]


def test_chain_cycle_diamond(spark):
    chain = {"S": ["1"], "1": ["2", "S"], "2": ["3"], "3": ["4"], "4": []}
    assert names(crawl(spark, web_of(spark, chain), CrawlConfig(W + "S"))) == [("S", 0), ("1", 1), ("2", 2), ("3", 3)]
    diamond = {"S": ["1", "2"], "1": ["3"], "2": ["3", "1"], "3": []}
    result = crawl(spark, web_of(spark, diamond), CrawlConfig(W + "S"))
    assert names(result) == [("S", 0), ("1", 1), ("2", 1), ("3", 2)]
    assert [r.ord for r in pages_to_index(result).orderBy("ord").collect()] == [0, 1, 2, 3]


def test_page_limit_and_failures(spark):
    wide = {"S": [f"n{i}" for i in range(60)]} | {f"n{i}": ["X"] for i in range(60)}
    result = crawl(spark, web_of(spark, wide, missing=("n0",)), CrawlConfig(W + "S", max_pages=50))
    assert names(result) == [("S", 0)] + [(f"n{i}", 1) for i in range(49)]
    stats = result.stats.first()
    assert (stats.scheduled, stats.successful, stats.failed) == (50, 49, 1)
    assert stats.finished_at >= stats.started_at


def test_byte_budget(spark):
    result = crawl(spark, web_of(spark, {"S": ["1", "2"], "1": [], "2": []}, size=60), CrawlConfig(W + "S", max_total_bytes=100))
    assert names(result) == [("S", 0), ("1", 1)]
    assert result.stats.first().total_bytes == 120


def test_all_fail_and_deadline_and_config(spark):
    web = web_of(spark, {"S": []}, missing=("S",))
    result = crawl(spark, web, CrawlConfig(W + "S"))
    assert result.successes().count() == 0
    assert result.stats.first().failed == 1
    with pytest.raises(DeadlineExceeded) as late:
        crawl(spark, web, CrawlConfig(W + "S", deadline_seconds=-1))
    assert late.value.result.pages.count() == 0
    with pytest.raises(ValueError, match="seed"):
        CrawlConfig("")
    with pytest.raises(ValueError, match=r"en\.wikipedia\.org"):
        CrawlConfig("https://example.org/wiki/A")
    assert CrawlConfig(W + "S", max_pages=0, max_depth=-1).max_pages == 50


def test_frontier(spark):
    queue = spark.createDataFrame([("a", 2, 1), ("a", 1, 2), ("b", 1, 3), (None, 0, 0)], "url string, depth int, ord long")
    assert sorted(tuple(r) for r in first_seen(queue).collect()) == [("a", 2, 1), ("b", 1, 3)]
    assert [r.url for r in unseen(queue, spark.createDataFrame([("a",)], "url string")).collect()] == ["b"]


def test_live_fetch(spark):
    class Pages(BaseHTTPRequestHandler):
        def do_GET(self):
            self.send_response(404 if "lost" in self.path else 200)
            if "bare" not in self.path:
                self.send_header("Content-Type", "text/html")
            self.end_headers()
            self.wfile.write("<p>é</p>".encode())

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Pages)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}/"
    try:
        urls = spark.createDataFrame([(base + p,) for p in ("ok", "lost", "bare")] + [("http://127.0.0.1:1/x",), ("no url",)], "url string")
        got = {r.url.removeprefix(base): (r.status, r.html, r.err) for r in fetched(urls, live_web(urls, 100), 100).collect()}
    finally:
        server.shutdown()
    assert got["ok"] == (200, "<p>é</p>", None)
    assert got["lost"] == (404, None, "status 404")
    assert got["bare"] == (200, None, "no content type")
    assert got["http://127.0.0.1:1/x"][2] == got["no url"][2] == "status unknown"


@pytest.mark.parametrize(
    ("href", "want"),
    [
        ("/wiki/Café", "Caf%C3%A9"), ("/wiki/Caf%C3%A9", "Caf%C3%A9"), ("/wiki/A B", "A%20B"), ("/wiki/A_(x)", "A_(x)"), ("/wiki/é_(x)%2F'", "%C3%A9_%28x%29/%27"),
        ("Ü?q=%zz", "%C3%9C"), ("/wiki/A~b;c=d", "A~b;c=d"),
    ],
)
def test_links_are_encoded(href, want):
    assert resolve_link(href, W + "Base", P) == W + want


@pytest.mark.parametrize("href", ["/wiki/A%zzB", "/wiki/100%", "/wiki/A#%", "/wiki/A\nB", "\t/wiki/A", "https:/wiki/A", "https:A", "/wiki/A\x7f"])
def test_links_that_are_no_references(href):
    assert resolve_link(href, W + "Base", P) == ""


def test_live_fetch_of_faulty_answers(spark):
    class Broken(BaseHTTPRequestHandler):
        def do_GET(self):
            if "bad" in self.path:
                self.wfile.write(b"this is no status line\r\n\r\n")
            else:
                self.send_response(200)
                self.send_header("Content-Type", "text/html")
                self.send_header("Content-Length", "1000")
                self.end_headers()
                self.wfile.write(b"cut")

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Broken)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}/"
    try:
        urls = spark.createDataFrame([(base + p,) for p in ("bad", "short", "with space", "a\tb")], "url string")
        got = {r.url.removeprefix(base): r.status for r in live_web(urls).collect()}
        assert live_web(urls, until=0.0).count() == 0
    finally:
        server.shutdown()
    assert got["bad"] is None and got["with space"] is None and got["a\tb"] is None
    assert got.keys() == {"bad", "short", "with space", "a\tb"}


def test_deadline_within_a_level(spark, monkeypatch):
    now = [0.0]
    monkeypatch.setattr(crawling, "time", SimpleNamespace(time=lambda: now[0]))

    def web(urls):  # the second level comes too late for one of its two pages
        rows = [(W + "S", 200, "text/html", '<a href="/wiki/1"><a href="/wiki/2">'), (W + "1", 200, "text/html", '<a href="/wiki/3">')]
        now[0] += 10
        return spark.createDataFrame(rows, WEB).join(urls, "url", "left_semi")

    with pytest.raises(DeadlineExceeded) as late:
        crawl(spark, web, CrawlConfig(W + "S", deadline_seconds=15))
    assert names(late.value.result) == [("S", 0), ("1", 1)]
    assert late.value.result.stats.first().scheduled == 2

from pyspark.sql import functions as F

from lectio.functions import html, robots, urls
from lectio.operators import crawl, live
from lectio.sources import files, serp, sinks
from lectio.streaming import state


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first().y


def test_urls(spark):
    for x, y in (("http://WWW.Example.com:8080/A/?q=1#f", "https://example.com/a?q=1"), ("https://example.com/", "https://example.com"), ("not a url/", "not a url"), ("", ""), (None, None)):
        assert one(spark, x, urls.dedupe_key) == y
    assert one(spark, "example.com/", urls.seed) == "https://example.com"
    assert one(spark, "https://www.jstor.org/x", urls.domain) == "jstor.org" and one(spark, "jstor.org", urls.domain) is None
    assert [one(spark, u, urls.is_scholarly) for u in ("https://www.jstor.org/x", "https://notjstor.org/x", "jstor.org", None)] == [True, False, False, False]
    assert one(spark, "//go.example/l/?uddg=https%3A%2F%2Fexample.com%2Fa+b&rut=1", urls.unwrap_redirect) == "https://example.com/a+b" and one(spark, "/relative", urls.unwrap_redirect) == ""
    assert one(spark, "Aquinas natural law", urls.augment_query) == "Aquinas natural law scholarly theology philosophy" and one(spark, "newspaper ethics", urls.augment_query) == "newspaper ethics"


def test_html(spark):
    cases = [
        ("<title> T </title><h1>H</h1><p>a<b>b</b>c</p>", "T", "H a b c", []), ("<title></title><h1>H</h1>", "", "H", []),
        ("<h1>H</h1><nav>n</nav><script>s</script><footer>f</footer>x", "H", "H x", []), ("<p>one\ntwo  three</p>", "", "one\ntwo three", []),
        ('<a href="#x">1</a><a href="mailto:a@b">2</a><a href="p?q=1#f">3</a><a href="/r">4</a><a href="ftp://z/">5</a>', "", "1 2 3 4 5", ["https://e.com/d/p?q=1", "https://e.com/r"]),
    ]
    df = spark.createDataFrame([(i, "https://e.com/d/", c[0]) for i, c in enumerate(cases)], "id long, url string, html string")
    for rows in (html.extract(df).orderBy("id").collect(), html.extract_any(df, "id").orderBy("id").collect()):
        assert [(r.page_title, r.page_text, r.page_links) for r in rows] == [c[1:] for c in cases]
    assert html.parse("<title>A &amp; B</title><p>un<i>closed &copy <nav>x")[:2] == ("A & B", "un closed ©")


def test_robots(spark):
    cases = [
        ("/private/x", "/private", True), ("/PRIVATE", "/private", True), ("/a/b.pdf", "/*.pdf$", False), ("/x/private/y", "/private*", True), ("/a", "/a$", True), ("/ab", "/a$", False), ("/a/b/c", "/a*c", True),
        ("/", "", False), ("/abc", "/a.*c", False), ("/a.xc", "/a.*c", True),
    ]
    df = spark.createDataFrame(cases, "path string, pattern string, want boolean")
    assert df.where(robots.path_matches(F.col("path"), F.col("pattern")) != F.col("want")).count() == 0
    texts = [
        ("User-agent: *\nDisallow: /a", "/a/x", False), ("User-agent: *\r\nDisallow: /a\r\nAllow: /a/x", "/a/x", True), ("User-agent: *\nDisallow: /a\nAllow: /a", "/a", True),
        ("User-agent: ours\nDisallow: /t\nUser-agent: *\nDisallow: /", "/x", True), ("User-agent: our\nDisallow: /", "/x", False), ("User-agent:\nDisallow: /", "/x", False),
        ("User-agent: ours\nUser-agent: other\nDisallow: /", "/x", True), ("User-agent: *\nDisallow: # none", "/x", True), (None, "/x", True), ("", "/x", True),
    ]
    rules = robots.parse(spark.createDataFrame([(f"h{i}.example", t[0]) for i, t in enumerate(texts)], "host string, content string"), "ours")
    pages = spark.createDataFrame([(i, f"https://h{i}.example{t[1]}") for i, t in enumerate(texts)] + [(99, "https://none.example/")], "i long, url string")
    got = {r.i: r.robots_allowed for r in robots.gate(pages, rules).collect()}
    assert got == {i: t[2] for i, t in enumerate(texts)} | {99: True}


def graph(spark, edges, fail=()):
    u = lambda x: f"https://h.example/{x}"
    nodes = sorted({x for e in edges for x in e})
    pages = spark.createDataFrame([(i, u(n), n not in fail, n) for i, n in enumerate(nodes)], "page_id long, url string, success boolean, title string")
    links = spark.createDataFrame([(u(a), i, u(b)) for i, (a, b) in enumerate(edges)], "src string, ordinal int, dst string")
    return pages, links, u


def visit(spark, edges, depth, most, fail=()):
    pages, links, u = graph(spark, edges, fail)
    rows = crawl.crawl(pages, links, crawl.CrawlOptions(u("A"), most, True, depth)).collect()
    return "".join(r.url[-1] for r in rows)


def test_crawl_skips_foreign_and_visited_links_without_counting_them(spark):
    home, far = "https://a.example", "https://b.example"
    pages = spark.createDataFrame([(u, True) for u in (home, f"{home}/x", f"{home}/y")], "url string, success boolean")
    rows = [(home, k, f"{far}/{k}") for k in range(50)] + [(home, 50, f"{home}/x")]
    rows += [(f"{home}/x", k, home if k % 2 else f"{home}/x") for k in range(50)] + [(f"{home}/x", 50, f"{home}/y")]
    links = spark.createDataFrame(rows, "src string, ordinal int, dst string")
    got = [r.url for r in crawl.crawl(pages, links, crawl.CrawlOptions(home, 5, True, 2)).collect()]
    assert got == [home, f"{home}/x", f"{home}/y"]


def test_crawl(spark):
    edges = [("A", "B"), ("A", "C"), ("B", "D"), ("C", "D"), ("C", "E"), ("D", "A")]
    assert [visit(spark, edges, d, 10) for d in (0, 1, 2)] == ["A", "ABC", "ABCDE"]
    assert visit(spark, edges, 2, 3) == "ABC" and visit(spark, edges, 2, 3, fail=("B",)) == "ABC"
    assert visit(spark, [("A", str(i)) for i in range(1, 10)], 1, 2) == "A1"
    assert crawl.clamp(99, crawl.MAX_PAGES) == 50 and crawl.clamp(-1, crawl.MAX_DEPTH) == 0
    pages, links, u = graph(spark, edges)
    got = {r.url[-1]: r.depth for r in crawl.depths(links, spark.createDataFrame([(u("A"),)], "url string"), 2).collect()}
    assert got == {"A": 0, "B": 1, "C": 1, "D": 2, "E": 2}


def test_state(spark):
    times = spark.createDataFrame([(0.0,), (1.0,), (2.5,), (10.0,)], "s double").select(F.timestamp_seconds("s").alias("ts"))
    flushed = [r.s for r in state.flush_times(times).select(F.unix_millis("flush_at").alias("s")).orderBy("s").collect()]
    assert flushed == [4500, 12000]
    looks = spark.createDataFrame([("k", float(s)) for s in (0, 100, 299, 301, 600, 602)] + [("j", 5.0), (None, 1.0)], "key string, s double").select("key", F.timestamp_seconds("s").alias("ts"))
    got = [r.hit for r in state.cache_hits(looks).where("key = 'k'").orderBy("ts").collect()]
    assert got == [False, True, True, False, True, False]
    log = spark.createDataFrame([(1, "Law", 1.0), (1, "law", 3.0), (1, "grace", 2.0), (1, " ", 9.0), (None, "x", 1.0)], "user_id long, query string, s double").select("user_id", "query", F.timestamp_seconds("s").alias("ts"))
    assert [(r["rank"], r["query"]) for r in state.recent(log).where("user_id = 1").orderBy("rank").collect()] == [(1, "law"), (2, "grace")]


def test_live(spark):
    pages = spark.createDataFrame(
        [(1, "https://www.jstor.org/a", "Natural law", "on natural law", True), (2, "https://b.example/x", "Other", "grace alone", True), (3, "https://c.example", "C", None, False)],
        "page_id long, url string, title string, text_content string, success boolean",
    )
    hits = pages.select((F.col("page_id") - 1).alias("pos"), "url", "title", F.lit("s").alias("snippet"))
    twice = hits.unionByName(hits.where("pos = 1").select(F.lit(7).alias("pos"), F.lit("http://B.example/x/").alias("url"), "title", "snippet"))
    assert live.dedupe(twice).count() == 3
    rows = {r.url: r for r in live.ranked(live.fetched(hits, pages), "natural law").collect()}
    assert set(rows) == {"https://www.jstor.org/a", "https://b.example/x"} and rows["https://b.example/x"].score == 0.0 and rows["https://www.jstor.org/a"].is_scholarly
    names = [n for n, _ in live.phases(hits, pages, "law")]
    assert names == ["discovery", "scored"] and [n for n, _ in live.phases(hits, pages, " ")] == ["scored"]
    *_, (_, items) = live.phases(hits, pages.where("page_id = 3"), "law")
    assert [(r["rank"], r.score) for r in items.collect()] == [(1, 0.0), (2, 0.0), (3, 0.0)]


def test_files_and_sinks(spark, tmp_path):
    for name, text in (("a.md", "# law"), ("b.HTML", "<p>x"), ("c.pdf", "raw"), ("d", "plain")):
        (tmp_path / name).write_text(text)
    got = {r.title: (r.content_type, r.content) for r in files.read_files(spark, str(tmp_path)).collect()}
    assert got == {"a": ("Markdown", "# law"), "b": ("Html", "<p>x"), "c": ("Pdf", "raw"), "d": ("Markdown", "plain")}
    gate = spark.createDataFrame([("u", 200, "OK", "text/html"), ("v", 404, "Not Found", "text/html"), ("w", 200, "OK", "image/png"), ("x", 200, "OK", None)], "url string, status int, reason string, media_type string")
    assert [(r.success, r.error) for r in files.fetch_gate(gate).orderBy("url").collect()][:3] == [(True, None), (False, "HTTP 404 Not Found"), (False, "Non-HTML content type: image/png")]
    frame = spark.range(1).select(sinks.sse_frame(F.lit("scored"), F.lit("{}")).alias("f")).first().f
    assert frame == "event: scored\ndata: {}\n\n"


def test_result_pages(spark):
    page = (
        '<div class="r result__body"><a class="result__a" href="//go.example/l/?uddg=https%3A%2F%2Fa.example%2F1&x=1">A <b>one</b></a><a class="result__snippet">about a</a></div>'
        '<div class="result__body"><a href="https://b.example/">B</a><div class="result__snippet">about b</div></div><div class="result__body"><a href="/rel">no</a></div>'
        '<form class="nav-link"><input name="q" value="a b"><input name="s" value="10"></form>'
    )
    hits, form = serp.parse_page(page)
    assert hits == [("https://a.example/1", "A one", "about a"), ("https://b.example/", "B", "about b")] and form == "q=a%20b&s=10"
    df = spark.createDataFrame([(0, page), (1, page), (2, None)], "page int, html string")
    assert [(r.pos, r.url) for r in serp.discover(df).orderBy("pos").collect()] == [(0, "https://a.example/1"), (1, "https://b.example/")]


def test_http(spark):
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    from lectio.sources import http

    class Site(BaseHTTPRequestHandler):
        def do_GET(self):
            ok = self.path in ("/a", "/b.png")
            self.send_response(200 if ok else 404)
            self.send_header("Content-Type", "image/png" if self.path.endswith("png") else "text/html; charset=utf-8")
            self.end_headers()
            self.wfile.write("<title>T</title><p>é <a href='/b#x'>b</a>".encode())

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Site)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"
    df = spark.createDataFrame([(f"{base}/a",), (f"{base}/a",), (f"{base}/none",), (f"{base}/b.png",), ("nonsense",), (None,)], "url string")
    got = {r.url.removeprefix(base): r for r in http.fetch(df, parallel=2, timeout=5).collect()}
    server.shutdown()
    assert len(got) == 4 and got["/a"].title == "T" and got["/a"].text_content == "é b" and got["/a"].success
    assert got["/none"].error.startswith("HTTP 404") and got["/b.png"].error == "Non-HTML content type: image/png" and not got["nonsense"].success


def test_links_in_any_quotes_and_all_entities(spark):
    source = "<a href='/one'>1</a><a class=x href=/two>2</a><A HREF=\"/three?a=1&amp;b=2\">3</A><a title='>' href='/four'>4</a><p>caf&eacute; &#8212; &#x41; &amp;lt; &nosuch; a & b"
    df = spark.createDataFrame([(1, "https://a.example/", source)], "id int, url string, html string")
    native, any_ = html.extract(df).first(), html.extract_any(df, "id").first()
    assert native.page_links == any_.page_links == [f"https://a.example/{x}" for x in ("one", "two", "three?a=1&b=2", "four")]
    assert native.page_text == any_.page_text == "1 2 3 4 café — A &lt; &nosuch; a & b"


def test_a_seed_without_scheme_is_held_to_no_domain(spark):
    pages = spark.createDataFrame([("https://a.example", True), ("https://b.example/x", True)], "url string, success boolean")
    links = spark.createDataFrame([("https://a.example", 0, "https://b.example/x")], "src string, ordinal int, dst string")
    told = []
    got = crawl.crawl(pages, links, crawl.CrawlOptions("a.example", 5, True, 2), lambda *x: told.append(x)).collect()
    assert [r.url for r in got] == ["https://a.example", "https://b.example/x"] and told == [(0, 0, "https://a.example"), (1, 0, "https://b.example/x")]
    assert [r.url for r in crawl.crawl(pages, links, crawl.CrawlOptions("https://a.example", 5, True, 2)).collect()] == ["https://a.example"]


def test_crawl_report_has_a_row_a_page(spark):
    pages = spark.createDataFrame([(1, "https://a.example", "A", "text", True, None), (2, "https://a.example/x", None, None, False, "HTTP 404 Not Found")], "page_id long, url string, title string, text_content string, success boolean, error string")
    visited = spark.createDataFrame([(0, "https://a.example", 0, True), (1, "https://a.example/x", 1, False), (2, "https://a.example/y", 1, False)], "ord int, url string, depth int, success boolean")
    got = [tuple(r) for r in crawl.page_report(pages, visited).orderBy("ord").collect()]
    assert got == [(0, "https://a.example", "A", True, None, 4), (1, "https://a.example/x", None, False, "HTTP 404 Not Found", 0), (2, "https://a.example/y", None, False, None, 0)]


def test_a_live_search_goes_on_with_fifty_hits(spark):
    hits = spark.createDataFrame([(i, f"https://a.example/{i}", f"T{i}", "s") for i in range(70)], "pos long, url string, title string, snippet string")
    pages = spark.createDataFrame([(i, f"https://a.example/{i}", f"T{i}", "law text", True) for i in range(70)], "page_id long, url string, title string, text_content string, success boolean")
    from lectio.api import SearchEngine

    assert SearchEngine.create(spark).live_search("law", hits, pages, 100).total_matches == 50


def test_bursts_over_the_edges_of_stretches(spark):
    import random

    rng = random.Random(1)
    at, rows = 0.0, []
    for _ in range(3000):
        at += rng.choice((0.3, 0.9, 1.9, 2.0, 40.0)) if rng.random() < 0.02 else rng.choice((0.0, 0.5, 1.5))
        rows.append((at,))
    want, last = [], None
    for (t,) in rows:
        if last is None or t - last >= 2:
            want.append([0, 0])
        want[-1] = [t, want[-1][1] + 1]
        last = t
    df = spark.createDataFrame(rows, "s double").select(F.timestamp_micros((F.col("s") * 1_000_000).cast("long")).alias("ts"))
    old, state.STRETCH = state.STRETCH, 7
    try:
        got = sorted((round(r.s / 1e6, 3), r.mutations) for r in state.flush_times(df.repartition(4)).select(F.unix_micros("flush_at").alias("s"), "mutations").collect())
    finally:
        state.STRETCH = old
    assert got == [(round(t + 2, 3), n) for t, n in want]

"""Pages and sitemaps as sites serve them: golden cases, and input of any kind."""

import random

from pyspark.sql import functions as F

from searchops.functions.html import read_page
from searchops.functions.sitemaps import read_sitemap
from searchops.operators import fingerprints, sitefiles, technical

GOLDEN = """<!doctype html>
<html lang="en"><head><title>Ring Guide</title>
<meta name="description" content="How to choose a ring: cut, origin &amp; papers."><meta name="robots" content="Index, Follow">
<link rel="canonical" href="/guides/rings"><link rel="alternate" hreflang="en-gb" href="/uk/guides/rings">
<script type="application/ld+json">{"@context":"https://schema.org","@type":"Article","headline":"</p>"}</script></head>
<body><h1>Ring Guide</h1><h2>Choosing a <em>stone</em></h2><p>Cut &mdash; and clarity.</p><h2>Papers</h2>
<a href="/guides/emeralds">a</a> <a href="/guides/emeralds#origin">b</a> <a href="https://other.org/">c</a> <a href="mailto:hi@example.com">d</a>
<img src="/img/ring.jpg" alt="A ring"><img src="/img/band.jpg"></body></html>"""


def test_golden_page(spark):
    url = "https://shop.example.com/guides/rings"
    rows = [(1, url, None, GOLDEN, 200, None), (2, url, url, None, 200, ["301"]), (3, None, None, "", None, None)]
    facts = technical.page_facts(spark.createDataFrame(rows, "page_id long, url string, final_url string, html string, http_status int, redirect_chain array<string>"))
    p, empty, none = sorted(facts.collect(), key=lambda r: r.page_id)
    assert (p.title, p.meta_description, p.robots_meta, p.canonical) == ("Ring Guide", "How to choose a ring: cut, origin & papers.", "index, follow", url)
    assert (p.h1, p.h2, p.h3) == (["Ring Guide"], ["Choosing a stone", "Papers"], [])
    assert (p.internal_links, p.external_links) == (["https://shop.example.com/guides/emeralds"], ["https://other.org/"])
    assert [(i.src, i.alt) for i in p.images] == [("https://shop.example.com/img/ring.jpg", "A ring"), ("https://shop.example.com/img/band.jpg", "")]
    assert [tuple(h) for h in p.hreflang] == [("en-gb", "https://shop.example.com/uk/guides/rings")] and len(p.schema_blocks) == 1 and '"Article"' in p.schema_blocks[0]
    assert p.body_text == "Ring Guide Choosing a stone Cut — and clarity. Papers a b c d" and p.word_count == 14
    assert (empty.title, empty.h1, empty.word_count, empty.redirect_chain) == ("", [], 0, ["301"]) and none.body_text == ""


def test_markup_as_browsers_read_it():
    def read(html, *names):
        page = read_page(html)
        return page[names[0]] if len(names) == 1 else tuple(page[n] for n in names)

    assert read("<title>A&nbsp;&mdash;&#x27;B&#8217;s&eacute; &#39 &bogus; &</title>", "title") == "A —'B’sé ' &bogus; &"
    assert read('<a title="x > y" href="/z">t</a>', "hrefs", "body_text") == (["/z"], "t")
    assert read('<meta name="description"content="abc">', "description") == "abc"
    assert read('<a data-x=" href=/no" HREF = \'/yes\' href="/second">', "hrefs") == ["/yes"]
    assert read('<a href="?a=1&copy=2&amp;b=3">', "hrefs") == ["?a=1&copy=2&b=3"]
    assert read("<img src=a.png alt=don't><img alt='no source'><img data-src=b>", "images") == [{"src": "a.png", "alt": "don't"}, {"src": "b", "alt": ""}]
    assert read("<h1>A<h2>B</h2> c <h1></h1><h1> &nbsp; </h1><h1>open", "h1", "h2") == (["A", "open"], ["B"])
    assert read("<script>if (a < b) '<h1>n</h1>'</script><STYLE>p{}</style ><!-- <a href=/c> --><template><h1>t</h1></template>x < y", "h1", "hrefs", "body_text") == ([], [], "x < y")
    assert read("<title>first</title><svg><title>second</title></svg>", "title", "body_text") == ("first", "")
    assert read("a<br/>b<p>c<!-- never closed <a href=/x>", "body_text", "hrefs") == ("a b c", [])
    assert read('<a href="/a">one</a><a href="/cut', "hrefs", "body_text") == (["/a", "/cut"], "one")
    assert read("<link rel='Canonical' href=''><link rel=canonical href=/2><link rel='alternate nofollow' hreflang=de>", "canonical", "alternates") == ("", [{"hreflang": "de", "href": ""}])


def test_any_input_is_read_in_time():
    rnd = random.Random(0)
    pieces = ["<a href=", "<script>", "</script", "<!--", "-->", "<title>", "<h1", "&amp;", "<img ", "<![CDATA[", "<url>", "<loc>", "</loc>", *"<>\"'=/ !-?ab1&;#x\n"]
    for _ in range(5000):
        text = "".join(rnd.choice(pieces) for _ in range(rnd.randrange(40)))
        read_page(text)
        read_sitemap(text)
    for text in ("<a ", "<!--", "<a b='", "<script>", "<title>", "&", "<h1>", "<", "</", "<![CDATA[", "<url><loc>", "<a b=\"'"):
        read_page(text * 30_000)
        read_sitemap(text * 30_000)


XMLNS = '<?xml version="1.0"?><urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">'


def test_sitemaps_are_recovered(spark):
    cases = [
        (XMLNS + "<url><loc> https://x.com/a </loc><lastmod>d</lastmod></url><url><loc>https://x.com/b</loc></url></urlset>", ["https://x.com/a", "https://x.com/b"]),
        (XMLNS + "<url><loc>https://x.com/a</loc></url><url><loc>https://x.co", ["https://x.com/a", "https://x.co"]),
        (XMLNS + "<url><loc>https://x.com/?p=1&q=2&amp;r=3</loc></url></urlset>", ["https://x.com/?p=1=2&r=3"]),
        (XMLNS + "<url><loc>https://x.com/a & b&eacute;&#233;</loc></url>", ["https://x.com/a  bé"]),
        (XMLNS + "<url><image:image><image:loc>https://x.com/i.png</image:loc></image:image><loc><![CDATA[https://x.com/?a&b]]></loc></url></urlset>", ["https://x.com/?a&b"]),
        (XMLNS + "<url><loc>https://x.com/a</url><url><loc>/b</loc></url></urlset>", ["https://x.com/a", "https://x.com/b"]),
        ("<s:urlset xmlns:s='u'><!-- <url><loc>no</loc></url> --><s:url><s:loc>c</s:loc></s:url></s:urlset><url><loc>/behind</loc></url>", ["https://x.com/c"]),
        ("<sitemapindex><sitemap><loc>/1.xml</loc></sitemap><url><loc>/no</loc></url></sitemapindex>", ["sitemap https://x.com/1.xml"]),
        ("<!DOCTYPE html><html><body><p>Not found<br>&nbsp;<a href=/>x", []), ("", []), (None, []), ("plain & text", []), ("<loc>https://x.com/alone</loc>", []),
    ]
    rows = spark.createDataFrame([(str(i), "https://x.com", xml) for i, (xml, _) in enumerate(cases)], "site string, base_url string, sitemap_xml string")
    got = {}
    for r in sitefiles.sitemap_urls(rows).collect():
        got.setdefault(int(r.site), []).append(r.url if r.kind == "page" else f"sitemap {r.url}")
    assert {i: urls for i, (_, urls) in enumerate(cases) if urls} == got


def test_fingerprints_need_no_shuffle(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan = docs.select("doc_id", fingerprints.simhash(F.col("text")))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Generate" not in plan


def test_hosts_and_access_of_many_urls(spark):
    from searchops.functions import urls as ux

    one = lambda u: spark.createDataFrame([(u,)], "u string").select(ux.host_name(F.col("u"))).first()[0]
    assert one("https://u:p@WWW.Ex.com:443/a") == "ex.com" and one("http://ex.com") == "ex.com" and one("x") == ""
    robots = "User-agent: *\nDisallow: /admin\nDisallow: /cart\nAllow: /admin/help\n\nUser-agent: GPTBot\nUser-agent: b\nDisallow: /\nAllow: /x\n\nUser-agent: GPTBot\nAllow: /"
    files = spark.createDataFrame([("s", robots), ("none", None)], "site string, robots_txt string")
    paths = ["/", "/admin", "/admin/users", "/admin/help/x", "/cart", "/blog", "", "/x/y"]
    urls = spark.createDataFrame([(s, p) for s in ("s", "none", "unknown") for p in paths * 2], "site string, path string")
    got = {(r.site, r.path, r.agent): r.allowed for r in sitefiles.url_access(urls, files, ["GPTBot", "other"]).collect()}
    assert len(got) == 48 and all(v for (s, _, _), v in got.items() if s != "s")
    assert {p for p in paths if got["s", p, "other"]} == {"/", "/admin/help/x", "/blog", "", "/x/y"}
    assert {p for p in paths if got["s", p, "GPTBot"]} == {"", "/x/y"}


def test_citations_of_several_projects(spark):
    from searchops.operators import visibility

    text = "Acme is the best,\nsee https://www.acme.com:443/x). Rival and https://u@foe.org/y, too"
    answers = spark.createDataFrame([(p, k, t) for k, (p, t) in enumerate([("a", text), ("b", text), ("c", text), ("a", None)])], "project_id string, answer_id long, text string")
    brands = spark.createDataFrame([("a", "Acme", "acme.com", ["Rival", "acme", ""], ["www.foe.org"]), ("b", "rival", "www.foe.org", None, ["acme.com", "foe.org"])], "project_id string, brand string, own_domain string, competitor_names array<string>, competitor_domains array<string>")
    a, b, c, null = sorted(visibility.project_citations(answers, brands).collect(), key=lambda r: r.answer_id)
    assert (a.brand_mentioned, a.brand_position, a.competitors, a.own_url_cited, a.sentiment) == (True, 1, ["Rival", "foe.org"], True, "positive")
    assert (b.brand_mentioned, b.brand_position, b.competitors, b.own_url_cited, b.sentiment) == (True, 2, ["acme.com", "foe.org"], True, "positive")
    assert (c.brand_mentioned, c.competitors, c.own_url_cited, len(c.cited)) == (False, [], False, 2) and (null.brand_mentioned, null.cited) == (False, [])
    assert set(visibility.project_citations(answers, brands).columns) == {"project_id", "answer_id", "brand_mentioned", "brand_position", "competitors", "cited", "own_url_cited", "sentiment"}

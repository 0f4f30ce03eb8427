import datetime
import decimal
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from searchops.functions import text as tx
from searchops.functions import urls as ux
from searchops.operators import content, fingerprints, graph, keywords, lifecycle, metrics, opportunities, payloads, planning, serp, sitefiles, technical, verification, visibility
from searchops.plans import registry
from searchops.sources.tables import keeper, scoped

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.fixture(scope="module", autouse=True)
def parsed_once(spark):
    """The queries on pages share their facts and findings here, so that the pages are parsed once for all tests."""
    from searchops.plans import technical as plan

    own, made = {n: getattr(plan, n) for n in ("written_facts", "all_findings")}, {}

    def shared(name):
        def call(session, sf, *more, **named):
            key = name, sf, more, tuple(named.items())
            if key not in made:
                made[key] = keeper(session)(own[name](session, sf, *more, **named))
            return made[key]

        return call

    for name in own:
        setattr(plan, name, shared(name))
    yield
    for name, f in own.items():
        setattr(plan, name, f)


def plain(v):
    if isinstance(v, float | decimal.Decimal):
        return round(float(v), 6)
    return tuple(map(plain, v)) if isinstance(v, list) else v


@pytest.mark.parametrize("name", [n for n, q in registry.load().items() if q.sql])
def test_query_equals_its_sql(spark, duck, name):
    q = registry.load()[name]
    got = q.spark(spark, SF)
    want = duck.sql(q.sql)
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    at = [want.columns.index(c) for c in cols]
    assert sorted((tuple(plain(r[c]) for c in cols) for r in got.collect()), key=str) == sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=str)


def test_url_functions(spark):
    rows = [("HTTPS://WWW.Example.com/A/b/?x=1#f", "HTTPS://www.example.com/A/b", "example.com", "/A/b/"), ("http://h", "http://h/", "h", "/")]
    for url, norm, domain, path in rows:
        got = spark.createDataFrame([(url,)], "u string").select(ux.normal(F.col("u")), ux.domain(F.col("u")), ux.path(F.col("u"))).first()
        assert tuple(got) == (norm, domain, path)
    base = "https://h.com/a/b.html"
    for link, want in (("/x#t", "https://h.com/x"), ("c", "https://h.com/a/c"), ("#t", None), ("mailto:a@b", None), ("//o.com/y", "https://o.com/y"), ("http://z/", "http://z/")):
        assert spark.createDataFrame([(link, base)], "l string, b string").select(ux.resolve(F.col("l"), F.col("b"))).first()[0] == want


def pages_of(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, final_url string, html string, http_status int, redirect_chain array<string>")


def test_technical_golden_pages(spark):
    s = "https://s.com"

    def page(k, path, words=400, status=200, title="Gemstone Rings — Buying Guide", head="", links="", body="", h1="<h1>Rings</h1>", canonical=None, description="d", schema='{"@type":"Article"}', chain=()):
        url = s + path
        tags = f'<link rel="canonical" href="{url if canonical is None else canonical}">' if canonical != "" else ""
        tags += f'<meta name="description" content="{description}">' if description else ""
        tags += f'<script type="application/ld+json">{schema}</script>' if schema else ""
        return (k, url, url, f"<html><head><title>{title}</title>{tags}{head}</head><body>{h1}{links}<p>{body or 'word ' * words}</p></body></html>", status, list(chain))

    home = "".join(f'<a href="{p}">x</a>' for p in ("/a", "/dead", "/short", "/n", "/f?color=red", "/c", "/h", "/i", "/m", "/chain", "/nope"))
    rows = [
        page(0, "/", title="Start of the golden site", links=home),
        page(1, "/a"),
        page(2, "/dead", status=404),
        page(3, "/short", title="Tiny", body="page not found"),
        page(4, "/n", title="Another unlike title", head='<META NAME="robots" content="NoIndex">'),
        page(5, "/Orphan"),
        page(6, "/f?color=red", title="Filtered list of rings"),
        page(7, "/c", title="Canonical to a dead page", canonical="/dead"),
        page(8, "/h", title="Hreflang to others only", head='<link rel="alternate" hreflang="de" href="/dead">', h1="<h1>a</h1><h1>b</h1>"),
        page(9, "/i", title="Images without any text", head="<img src=a.png><img src=b.png alt='x'>", schema='[{"name":"n"}]', description="", canonical=""),
        page(10, "/m", title="", h1="", schema="{broken"),
        page(11, "/chain", title="Behind a redirect chain", chain=("301", "302")),
        page(12, "/down", status=503),
        (13, None, None, None, None, None),
    ]
    facts = technical.page_facts(pages_of(spark, rows))
    first = facts.where("page_id = 0").first()
    assert (first.word_count, len(first.internal_links), first.canonical) == (412, 11, s + "/")
    sitemap = spark.createDataFrame([("s.com", s + p) for p in ("/", "/a", "/dead", "/short", "/n", "/c", "/h", "/i", "/m", "/chain", "/f")], "site string, url string")
    sites = spark.createDataFrame([("s.com", s, True, False, 11), ("t.com", "https://t.com", False, True, 0)], "site string, origin string, robots_reachable boolean, robots_has_sitemap boolean, n_sitemap_urls int")
    prints = facts.select("page_id", fingerprints.simhash_blake2b(F.col("body_text")).alias("fingerprint"))
    got = {(r.check_code, r.url or r.url_pattern) for r in technical.site_findings(facts.join(prints, "page_id"), sitemap, sites).collect()}
    assert {g for g in got if g[0] != "near_duplicate"} == {
        ("broken_internal_link", s + "/"), ("status_4xx", s + "/dead"), ("status_5xx", s + "/down"), ("title_short", s + "/short"), ("thin_content", s + "/short"), ("soft_404", s + "/short"),
        ("noindex_on_indexable", s + "/n"), ("orphan_page", s + "/Orphan"), ("url_uppercase", s + "/Orphan"), ("crawled_not_in_sitemap", s + "/Orphan"), ("url_query_params", s + "/f?color=red"),
        ("faceted_nav", s + "/f?*"), ("title_duplicate", "title:Gemstone Rings — Buying Guide"), ("canonical_not_self", s + "/c"), ("canonical_to_non200", s + "/c"),
        ("hreflang_no_self", s + "/h"), ("hreflang_to_non200", s + "/h"), ("h1_multiple", s + "/h"), ("img_missing_alt", s + "/i"), ("schema_no_type", s + "/i"), ("meta_desc_missing", s + "/i"), ("canonical_missing", s + "/i"),
        ("title_missing", s + "/m"), ("h1_missing", s + "/m"), ("schema_missing", s + "/m"), ("redirect_chain", s + "/chain"), ("in_sitemap_not_crawlable", s + "/dead"),
        ("robots_no_sitemap", s + "/robots.txt"), ("robots_unreachable", "https://t.com/robots.txt"), ("sitemap_empty", "https://t.com/sitemap.xml"),
    } - {("faceted_nav", s + "/f?*")} | {("faceted_nav", s + "/f?color=red")}
    assert any(g[0] == "near_duplicate" for g in got)
    assert technical.site_findings(technical.page_facts(pages_of(spark, []))).count() == 0


def test_fingerprints(spark):
    base = "the quick brown fox jumps over the lazy dog near the river bank " * 40
    rows = [(0, base, base, False), (1, base, base + "one more sentence here.", False), (2, base, "something wholly unlike it in every single word " * 30, True), (3, None, base, True), (4, "", "", False)]
    df = spark.createDataFrame(rows, "id long, old string, new string, want boolean")
    for f in (lambda c: df.select("id", fingerprints.simhash_blake2b(F.col(c)).alias("fingerprint")), lambda c: df.select("id", fingerprints.simhash(F.col(c)).alias("fingerprint"))):
        got = f("old").withColumnRenamed("fingerprint", "a").join(f("new").withColumnRenamed("fingerprint", "b"), "id", "right").join(df, "id")
        assert all(r.changed == r.want for r in got.select("want", fingerprints.changed(F.col("a"), F.col("b")).alias("changed")).collect())


def test_robots_sitemaps_and_machine_readability(spark):
    robots = "User-agent: *\nDisallow: /private\nAllow: /private/open\nCrawl-delay: 2.0\n\nUser-agent: GPTBot\nDisallow: /\nSitemap: https://x.com/s.xml"
    files = spark.createDataFrame([("x.com", robots, "# Title\n- [a](b)"), ("y.com", None, None), ("z.com", "", "text only")], "site string, robots_txt string, llms_txt string")
    allowed = lambda agent, path: {r.site: r.allowed for r in sitefiles.access(files, [agent], path).collect()}["x.com"]
    assert [allowed("bot", p) for p in ("/", "/private/x", "/private/open/y")] == [True, False, True] and not allowed("GPTBot", "/open")
    assert {r.crawl_delay for r in sitefiles.access(files, ["bot"]).collect()} == {2.0, None}
    assert [r.sitemap for r in sitefiles.sitemaps_in_robots(files).collect()] == ["https://x.com/s.xml"]
    head = '<?xml version="1.0"?>'
    maps = [("a", f'{head}<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><url><loc> /p </loc></url><url><loc>https://a/q</loc></url></urlset>'), ("b", f"{head}<sitemapindex><sitemap><loc>https://b/1.xml</loc></sitemap></sitemapindex>")]
    df = spark.createDataFrame([(s, f"https://{s}", x) for s, x in maps], "site string, base_url string, sitemap_xml string")
    assert {tuple(r) for r in sitefiles.sitemap_urls(df).collect()} == {("a", "page", "https://a/p"), ("a", "page", "https://a/q"), ("b", "sitemap", "https://b/1.xml")}
    blocks = [("x.com", 1, ['{"@graph":[{"@type":"WebPage"},{"@type":["Thing","Organization"],"name":"Acme Inc","sameAs":["u"]}]}']), ("z.com", 1, ['{"@type":"Brand","name":"Other"}'])]
    org = sitefiles.organizations(spark.createDataFrame(blocks, "site string, page_id long, schema_blocks array<string>"), F.lit("acme"))
    got = {r.site: r.issues for r in sitefiles.machine_readability(files, org).collect()}
    assert got == {"x.com": ["ai_crawler_blocked:GPTBot"], "y.com": ["no_organization_schema", "no_llms_txt"], "z.com": ["organization_name_mismatch", "no_same_as_links", "llms_txt_malformed"]}


def test_experiments_follow_the_rules(spark):
    start = datetime.date(2025, 3, 1)
    days = [start + datetime.timedelta(i) for i in range(-28, 29)]
    rise = {"flat": (100, 100), "up": (100, 130), "down": (100, 70), "up_little": (100, 102), "better_position": (8, 5), "zero": (0, 5)}
    rows = [(s, d, float(b if d < start else a) + (i % 3) * 0.01) for s, (b, a) in rise.items() for i, d in enumerate(days)]
    rows = [(s, d, 0.0 if s == "zero" and d < start else v) for s, d, v in rows]
    cases = [("up", None, "users", 28, False, "success", 0.6), ("up", "flat", "users", 28, False, "success", 0.8), ("up", "up", "users", 28, False, "neutral", 0.6), ("down", "flat", "users", 28, False, "regression", 0.8),
             ("up_little", None, "users", 28, False, "neutral", 0.6), ("up", None, "clicks", 20, False, "inconclusive", 0.3), ("up", None, "users", 28, True, "inconclusive", 0.3), ("better_position", None, "position", 28, False, "success", 0.6),
             ("zero", None, "users", 28, False, "neutral", 0.6), ("absent", None, "users", 28, False, "neutral", 0.6)]
    x = [(str(i), s, c, m, days[0], start - datetime.timedelta(1), start, n, t) for i, (s, c, m, n, t, *_) in enumerate(cases)]
    x = spark.createDataFrame(x, "experiment_id string, series string, control_series string, metric string, baseline_start date, baseline_end date, start date, days int, tracking_changed boolean")
    got = {r.experiment_id: r for r in metrics.experiment_verdicts(spark.createDataFrame(rows, "series string, day date, value double"), x).collect()}
    for i, case in enumerate(cases):
        r = got[str(i)]
        assert (r.verdict, r.confidence, r.causal_language_allowed) == (*case[5:], case[5] in ("success", "regression") and case[1] is not None), case
    later = x.withColumn("start", F.lit("2026-03-01").cast("date"))
    assert {tuple(r.confounders) for r in metrics.experiment_verdicts(spark.createDataFrame(rows, "series string, day date, value double"), later.where("not tracking_changed")).collect()} >= {("March 2026 core update",)}


def test_page_quality_and_drafts(spark):
    row = lambda words, kind, heads, links, schema, meta: (words, kind, ["h"] * heads, [], [], ["l"] * links, ["s"] * schema, "m" * meta)
    df = spark.createDataFrame([row(800, "article", 3, 5, 1, 100), row(100, "product", 1, 1, 0, 10), row(0, "other", 0, 0, 0, 0)], "word_count int, content_type string, h1 array<string>, h2 array<string>, h3 array<string>, internal_links array<string>, schema_blocks array<string>, meta_description string")
    assert [r.s for r in df.select(content.page_score().alias("s")).collect()] == [100, 36, 0]
    good = "# Gemstone rings\n" + "gemstone rings are good. " * 200 + "\n## Sizes\n## Care\n## Price\n[a](/b) [c](https://d) [e](/f)"
    df = spark.createDataFrame([(good, "gemstone rings", 700, ["Sizes", "Care"]), ("short", "gemstone", 700, ["Sizes"]), (None, None, 700, None)], "text string, keyword string, target_words int, expected_headings array<string>")
    got = content.scored_drafts(df).collect()
    assert [(r.score, r.verdict) for r in got] == [(85, "PASS"), (5, "FAIL"), (5, "FAIL")] and (got[0].structure, got[0].linking, got[0].coverage) == (9, 9, 30)


def test_payload_shapes(spark):
    p = '{"organic_results":[{"link":"https://www.gia.edu/a","title":"T","snippet":"S"},{"position":7,"link":"u"}],"people_also_ask":[{"question":"q?"}],"local_results":{"a":1},"ai_overview":{"text_blocks":[{"type":"paragraph","snippet":"one"},{"type":"list","list":[{"title":"a","snippet":"b"},{"snippet":"c"}]}],"references":[{"title":"r","link":"https://x"}]},"related_searches":[{"query":"more?"}]}'
    df = spark.createDataFrame([(1, p), (2, "{}"), (3, "broken"), (4, None)], "run_id long, payload string")
    assert [tuple(r) for r in payloads.search_results(df).collect()] == [(1, 1, "https://www.gia.edu/a", "T", "S"), (1, 7, "u", "", "")]
    f = {r.type: r for r in payloads.search_features(df).collect()}
    assert list(f) == ["people_also_ask", "local_pack", "ai_overview"] and f["ai_overview"].text == "one a b c" and f["ai_overview"].cited_urls == ["https://x"]
    assert [r.question for r in serp.questions(payloads.search_features(df), payloads.related_searches(df)).orderBy("rank").collect()] == ["q?", "more?"]
    t = '{"tasks":[{"result":[{"items":[{"type":"organic","rank_absolute":3,"url":"u","title":"t","description":"d"},{"type":"people_also_ask","items":[{"title":"q"}]}]}]}]}'
    df = spark.createDataFrame([(1, t), (2, None)], "run_id long, payload string")
    assert [tuple(r) for r in payloads.task_results(df).collect()] == [(1, 3, "u", "t", "d")] and [tuple(r) for r in payloads.task_questions(df).collect()] == [(1, "q")]


def test_verifiers(spark):
    facts = technical.page_facts(pages_of(spark, [(1, "https://s/a", "https://s/a", '<title>T</title><meta name="robots" content="noindex"><link rel="canonical" href="/a/"><a href="/b">b</a><script type="application/ld+json">{"@type":"Product"}</script>', 200, ["301"])]))
    cases = [("canonical_change", {}, True), ("metadata_change", {"title": " T "}, True), ("metadata_change", {"title": "T", "h1": "x"}, False), ("internal_link_added", {"target": "https://s/b/"}, True), ("internal_link_added", {"target": "https://s/c"}, False),
             ("schema_change", {"type": "product"}, True), ("schema_change", {"type": "FAQ"}, False), ("redirect_added", {"to": "https://s/a/"}, True), ("noindex_removed", {}, False), ("unknown", {}, False)]
    df = spark.createDataFrame([(i, "https://s/a", v, e) for i, (v, e, _) in enumerate(cases)] + [(99, "https://gone", "noindex_removed", {})], "change_id int, url string, verifier string, expect map<string,string>")
    got = {r.change_id: r.passed for r in verification.verify(df, facts).collect()}
    assert got == {i: want for i, (*_, want) in enumerate(cases)} | {99: False}


def test_upserts_and_plans(spark):
    schema = "site string, opportunity_key string, score double, priority string, type string, url string, ordinal int"
    rows = spark.createDataFrame([("s", "k", 10.0, "P3", "add_schema", "u", 1), ("s", "k", 70.0, "P0", "add_schema", "u", 2)], schema)
    none = spark.createDataFrame([], "site string, opportunity_key string, status string, score double, priority string, first_seen date, last_seen date, seen_count long")
    run = lambda old, day: opportunities.upsert(old, opportunities.folded(rows).withColumn("seen_on", F.lit(day).cast("date")))
    one = run(none, "2026-01-01")
    two = run(one.drop("state").withColumn("status", F.lit("failed")), "2026-01-08").first()
    assert (two.status, two.score, two.seen_count, two.state, str(two.first_seen)) == ("detected", 70.0, 4, "updated", "2026-01-01")
    df = spark.createDataFrame([(1, "add_schema", "u", None), (2, "improve_thin_content", "u", None), (3, "new_kind", None, None), (4, "consolidate_cannibalization", None, "keyword:k")], "id long, type string, url string, url_pattern string")
    got = {r.id: r for r in planning.draft_plans(df, F.array(F.lit("add_schema"), F.lit("improve_thin_content"))).collect()}
    assert [got[i].permission for i in (1, 2, 3, 4)] == ["auto", "approval_required", None, "approval_required"] and got[3].unresolved and got[3].requires_approval
    assert got[1].objective == "Add valid JSON-LD schema to u" and "keyword:k" in got[4].objective and len(got[1].idempotency_key) == 40
    rules = lifecycle.validity(*(F.col(c) for c in "abcde"))
    df = spark.createDataFrame([("x.com", "k", "2026-01-01", "2026-02-01", "5"), ("x", " ", "2026-02-30", "2026-02-01", "500"), (None, None, None, None, None)], "a string, b string, c string, d string, e string")
    good, bad = lifecycle.split_valid(df, rules)
    assert good.count() == 1 and {r.reasons for r in bad.collect()} == {"domain,keyword,date_range,score"}


def test_private_keys_terms_and_links_of_all_forms(spark):
    one = lambda value, f: spark.createDataFrame([(value,)], "v string").select(f(F.col("v"))).first()[0]
    key = "a -----BEGIN RSA PRIVATE KEY-----\nMIIE\nxyz\n-----END RSA PRIVATE KEY----- b"
    assert one(key, tx.redact) == f"a {tx.PLACEHOLDER} b" and one(key, tx.has_credential)
    assert not one("-----BEGIN PUBLIC KEY-----", tx.has_credential) and one("npg_abcdefghijkl", tx.has_credential)
    assert one("Hotel MÜNCHEN, Straße!", tx.keyword) == "hotel münchen strasse" and one("ﬁne  Ｃａｆé", tx.keyword) == "fine café"
    assert one("東京 ホテル", tx.tokens) == ["ホテル", "東京"] and one(None, tx.keyword) is None
    for link, want in (
        ("../x", "https://h/a/x"), ("./x?y=../z", "https://h/a/b/x?y=../z"), ("../../../x", "https://h/x"), ("/p/./q/../r", "https://h/p/r"),
        ("..", "https://h/a/"), (".", "https://h/a/b/"), ("x.y/..z", "https://h/a/b/x.y/..z"), ("../..", "https://h/"),
    ):
        assert one(link, lambda c: ux.resolve(c, F.lit("https://h/a/b/c"))) == want, link


def test_keyword_rules(spark):
    want = {"buy gemstone rings": "transactional", "best gemstone rings": "commercial", "gold vs silver": "comparison", "rings near me": "local", "how to clean rings": "how_to", "what is topaz": "definitional", "gemstones": "informational"}
    got = keywords.intents(spark.createDataFrame([(k,) for k in want], "term string")).where("rank = 1").collect()
    assert {r.term: r.intent for r in got} == want
    words = {"rings": "ring", "boxes": "box", "ruby's": "ruby'", "berries": "berry", "glass": "glass", "gas": "gas"}
    got = spark.createDataFrame([(w,) for w in words], "w string").select("w", tx.singular(F.col("w")).alias("s")).collect()
    assert {r.w: r.s for r in got} == words


def test_clusters_equal_sequential_greedy(spark):
    rnd = random.Random(4)
    terms = {" ".join(sorted(rnd.sample("abcdefgh", rnd.randint(2, 4)))): rnd.randint(1, 9) for _ in range(60)}
    sets = {t: set(t.split()) for t in terms}
    seeds, want = [], {}
    for t in sorted(terms, key=lambda t: (-terms[t], t)):
        home = next((s for s in seeds if len(sets[s] & sets[t]) / len(sets[s] | sets[t]) >= keywords.SIMILAR), None)
        want[t] = home or t
        if home is None:
            seeds.append(t)
    df = spark.createDataFrame([(t, v, sorted(sets[t])) for t, v in terms.items()], "term string, volume long, tokens array<string>")
    assert {r.term: r.seed for r in keywords.clusters(df, keeper(spark)).collect()} == want


def test_anomalies_follow_the_rules(spark):
    start = datetime.date(2024, 1, 1)
    days = [start + datetime.timedelta(i) for i in range(60)]
    value = lambda i, drop: 1000 * (0.85 if days[i].weekday() > 4 else 1) * (1 + (i % 3) / 100) * (0.6 if drop and i >= 45 else 1)
    rows = [(s, d, value(i, s == "drop")) for s in ("stable", "drop") for i, d in enumerate(days)]
    hits = metrics.anomalies(spark.createDataFrame(rows, "series string, day date, value double")).collect()
    assert hits and {(h.series, h.direction) for h in hits} == {("drop", "drop")}


def test_traversal_and_scores(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (1, 4)], "src long, dst long")
    got = graph.traverse(edges, spark.createDataFrame([(1,)], "start long"), 4, keeper(spark)).collect()
    assert {(r.node, r.depth) for r in got} == {(2, 1), (4, 1), (3, 2)}
    row = spark.range(1).select(opportunities.priority_score(*(F.lit(x) for x in (0.9, 0.9, 0.95, 0.4, 0.5))).alias("s")).first()
    assert abs(row.s - 61.56) < 1e-9
    text = "Top picks:\nAcme is the best, see https://www.acme.com/x). Rival is poor. " + "x" * 200
    c = visibility.citations(spark.createDataFrame([(1, text)], "answer_id long, text string"), "Acme", "acme.com", ["Rival", "Acme"]).first()
    assert (c.brand_mentioned, c.brand_position, list(c.competitors), list(c.cited), c.own_url_cited, c.sentiment) == (True, 2, ["Rival"], ["https://www.acme.com/x"], True, "negative")
    rows = spark.createDataFrame([("a", "p"), ("a", "q"), ("b", "p")], "tenant_id string, project_id string")
    assert scoped(rows, "a").count() == 2 and scoped(rows, "a", "q").count() == 1


def test_planning_rules(spark):
    rnd = random.Random(9)
    rows = [(k, rnd.randrange(12), i, rnd.choice((0.1, -0.15, 0.0))) for k in "abc" for i in range(80)]
    want = {}
    for k, _, _, d in sorted(rows):
        want[k] = min(2.0, max(0.3, want.get(k, 1.0) + d))
    df = spark.createDataFrame(rows, "k string, day int, i int, d double")
    got = {r.k: (r.weight, r.steps) for r in planning.weight_folds(df, "k", ["day", "i"], "d").collect()}
    assert got == {k: (pytest.approx(w, abs=1e-3), 80) for k, w in want.items()}
    cases = [(0.99, 0, True, False, 0.99, "HIGH"), (0.85, 100, False, False, 0.75, "MEDIUM"), (0.10, 400, False, True, 0.01, "LOW")]
    df = spark.createDataFrame(cases, "b double, age int, x boolean, p boolean, want double, label string")
    c = planning.confidence(*map(F.col, ("b", "age", "x", "p")))
    assert all((r.c, r.l) == (r.want, r.label) for r in df.select("*", c.alias("c"), planning.confidence_label(c).alias("l")).collect())
    df = spark.createDataFrame([(1, 1, "REVISE"), (1, 2, "PASS"), (1, 3, "FAIL"), (2, 1, "REVISE"), (2, 2, "REVISE"), (2, 4, "PASS")], "k int, n int, v string")
    assert sorted(map(tuple, planning.revise_loop(df, "k", "n", "v").collect())) == [(1, 2, "PASS"), (2, 2, "REVISE")]

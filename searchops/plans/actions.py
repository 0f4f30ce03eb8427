"""Queries from findings to opportunities, evidence, plans, verified changes, the knowledge graph and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import urls as ux
from ..operators import content, graph, lifecycle, opportunities, planning, reports, technical, verification
from ..sources.tables import keeper
from . import technical as pages
from .registry import QUERIES, Query

DAY = "DATE '2026-03-01'"


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def findings(spark: SparkSession, sf: str) -> DataFrame:
    return keeper(spark)(pages.all_findings(spark, sf))


def evidence(spark: SparkSession, sf: str) -> DataFrame:
    """Three of four pages have been fetched with evidence."""
    return _t(spark, sf, "pages").where("page_id % 4 <> 1").select("url", F.format_string("e%06d", "page_id").alias("evidence_id"))


EVIDENCE_SQL = "evidence AS (SELECT url, min(printf('e%06d', page_id)) AS evidence_id FROM pages WHERE page_id % 4 <> 1 GROUP BY 1)"
GROUPS_SQL = "grouped AS (SELECT p_brand AS site, lower(trim(p_name)) AS keyword, count(*) AS n FROM part GROUP BY ALL HAVING count(*) > 1)"


def issue_evidence(spark: SparkSession, sf: str) -> DataFrame:
    return opportunities.with_evidence(findings(spark, sf), evidence(spark, sf)).select("site", "normalized_key", "evidence_id")


def detected(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Opportunities of findings with evidence and of content; and the findings that were mapped but have no evidence."""
    keep = keeper(spark)
    facts = pages.written_facts(spark, sf)
    rows = keep(opportunities.with_evidence(opportunities.from_findings(pages.all_findings(spark, sf, facts)), evidence(spark, sf)))
    groups = content.cannibalization(_t(spark, sf, "part"), ["p_brand"], "p_name", "p_partkey").select(F.col("p_brand").alias("site"), "keyword", "n")
    thin = pages.typed(spark, sf, facts).where("array_contains(split(flags, ','), 'thin')").select("site", "url")
    made = opportunities.from_content(groups, thin)
    order = F.struct(F.col("severity_rank").cast("int").alias("severity_rank"), "check_code", "page_id")
    cols = ["site", "type", "action_class", "url", "url_pattern", "score", "priority", "opportunity_key"]
    issue = rows.where("evidence_id is not null").select(*cols, order.alias("ordinal"))
    more = made.select(*cols, F.struct(F.lit(9).alias("severity_rank"), F.col("type").alias("check_code"), F.lit(0).cast("long").alias("page_id")).alias("ordinal"))
    return keep(issue.unionByName(more)), rows.where("evidence_id is null")


def known(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """Of two thirds of the keys an older state, every fourth completed; and one opportunity that is no longer there."""
    n = F.conv(F.substring("opportunity_key", 1, 2), 16, 10).cast("int")
    old = rows.where(n % 3 != 0).select("site", "opportunity_key", F.when(n % 4 == 0, "completed").otherwise("planned").alias("status"), F.lit(1.0).alias("score"), F.lit("P3").alias("priority"), F.expr(f"{DAY} - interval 7 days").cast("date").alias("first_seen"))
    old = old.withColumns({"last_seen": F.col("first_seen"), "seen_count": F.lit(1).cast("long")})
    gone = spark.range(1).select(F.lit("gone.example").alias("site"), F.lit("k").alias("opportunity_key"), F.lit("planned").alias("status"), F.lit(5.0).alias("score"), F.lit("P3").alias("priority"), F.expr(DAY).alias("first_seen"), F.expr(DAY).alias("last_seen"), F.lit(2).cast("long").alias("seen_count"))
    return old.unionByName(gone)


def of_this_run(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    rows, lost = detected(spark, sf)
    return keeper(spark)(opportunities.folded(rows).withColumn("seen_on", F.expr(DAY))), lost


def upserted(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    one, lost = of_this_run(spark, sf)
    return opportunities.upsert(known(spark, one), one), lost


def opportunity_upsert(spark: SparkSession, sf: str) -> DataFrame:
    return upserted(spark, sf)[0]


def opportunity_summary(spark: SparkSession, sf: str) -> DataFrame:
    return opportunities.summary(*upserted(spark, sf))


def best_opportunities(spark: SparkSession, sf: str) -> DataFrame:
    return opportunities.listed(upserted(spark, sf)[0], 40, priority="P1", status="detected").select("site", "opportunity_key", "score")


def opportunity_evidence(spark: SparkSession, sf: str) -> DataFrame:
    """New links from the evidence of findings to their opportunities; those of every third piece of evidence are known."""
    rows = opportunities.with_evidence(opportunities.from_findings(findings(spark, sf)), evidence(spark, sf)).where("evidence_id is not null")
    links = keeper(spark)(rows.select("evidence_id", F.lit("opportunity").alias("subject_type"), F.concat_ws("|", "site", "opportunity_key").alias("subject_id")))
    return lifecycle.new_links(links, links.where("cast(substring(evidence_id, 2, 6) AS int) % 3 = 0"))


def drafts(folded: DataFrame) -> DataFrame:
    rows = folded.withColumn("id", F.concat_ws("|", "site", "opportunity_key"))
    return planning.draft_plans(rows, F.when(F.length("site") % 2 == 0, F.array(F.lit("fix_canonical"), F.lit("improve_thin_content"))).otherwise(F.array(F.lit("add_schema"))))


def plan_drafts(spark: SparkSession, sf: str) -> DataFrame:
    return drafts(opportunities.folded(detected(spark, sf)[0]))


def awaiting_plans(spark: SparkSession, sf: str) -> DataFrame:
    return opportunities.awaiting_plans(upserted(spark, sf)[0]).groupBy("site", "priority").agg(F.count("*").alias("n"))


CHECKS = ("canonical_change", "metadata_change", "internal_link_added", "schema_change", "redirect_added", "content_change", "noindex_removed", "no_such")


def change_assertions(spark: SparkSession, sf: str) -> DataFrame:
    """One change a page, of the verifiers in turn; of every ninth the page is not there."""
    f = keeper(spark)(pages.facts(spark, sf).drop("body_text"))
    k = F.col("page_id")
    kind = F.element_at(F.array(*map(F.lit, CHECKS)), (k % 8 + 1).cast("int"))
    want = F.map_from_arrays(F.array(*map(F.lit, ("canonical", "title", "target", "type", "to"))), F.array(F.concat("url", F.lit("/")), F.when(k % 3 == 0, "x").otherwise(F.col("title")), F.concat(F.coalesce(F.get("internal_links", 0), F.lit("none")), F.lit("/")), F.when(k % 2 == 0, "Article").otherwise(""), F.col("url")))
    changes = f.select("page_id", k.alias("change_id"), F.when(k % 9 == 0, "http://gone.example/").otherwise(F.col("url")).alias("url"), kind.alias("verifier"), want.alias("expect"))
    return verification.verify(changes, f, keys=("url", "page_id"))


def page_differences(spark: SparkSession, sf: str) -> DataFrame:
    """Every second page had another title, every third no description."""
    f = keeper(spark)(pages.facts(spark, sf).select("page_id", "url", *verification.FIELDS))
    before = f.withColumns({"title": F.when(F.col("page_id") % 2 == 0, F.concat("title", F.lit("!"))).otherwise(F.col("title")), "meta_description": F.when(F.col("page_id") % 3 != 0, F.col("meta_description"))})
    d = verification.differences(before, f, keys=("url", "page_id"))
    return d.select("url", F.array_join(F.array_sort(F.map_keys("changed")), ",").alias("fields"), F.col("changed")["title"]["before"].alias("old_title"))


def graph_rows(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Pages and their links; parts as keywords in topics (their names); brands as queries that suppliers, of which every second is a
    competitor, rank for; pages as content items that cover the topic of the part of their number, and every fifth once more
    under an address that was not crawled."""
    project = F.lit("p")
    node = lambda df, kind, ref, label, at: df.select(project.alias("project_id"), F.lit(kind).alias("type"), ref.cast("string").alias("ref_id"), label.alias("label"), at.cast("long").alias("ordinal"))
    ident = lambda kind, ref: graph.node_id(project, F.lit(kind), ref.cast("string"))
    edge = lambda df, src, dst, relation, at, place=F.lit(None): df.select(src.alias("src"), dst.alias("dst"), F.lit(relation).alias("relation"), F.lit(1.0).alias("weight"), place.cast("int").alias("position"), at.cast("long").alias("ordinal"))
    f = keeper(spark)(pages.facts(spark, sf).where("http_status = 200").select("page_id", "url", "title", "internal_links"))
    page = lambda u: ident("Page", tx.content_hash(u))
    links = f.select("page_id", "url", F.explode("internal_links").alias("to"))
    part, ps = _t(spark, sf, "part"), _t(spark, sf, "lineitem").select("l_suppkey", "l_partkey", "l_linenumber", "l_orderkey")
    kind = F.when(F.col("l_suppkey") % 2 == 0, "Competitor").otherwise("Page")
    ref = tx.content_hash(F.col("l_suppkey").cast("string"))
    all_nodes = [
        node(f, "Page", tx.content_hash(F.col("url")), F.col("url"), F.col("page_id")),
        node(part, "Keyword", F.col("p_partkey"), F.concat_ws(" ", "p_name", F.lower("p_type")), F.col("p_partkey")),
        node(part, "Topic", tx.slug(F.col("p_name")), F.col("p_name"), F.col("p_partkey")),
        node(part, "Query", tx.content_hash(F.col("p_brand")), F.col("p_brand"), F.col("p_partkey")),
        node(ps.where("l_suppkey % 2 = 0"), "Competitor", ref, F.col("l_suppkey").cast("string"), F.lit(0)),
        node(ps.where("l_suppkey % 2 = 1"), "Page", ref, F.col("l_suppkey").cast("string"), F.lit(0)),
    ]
    sold = ps.join(part.select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey")
    all_edges = [
        edge(links, page(F.col("url")), page(F.col("to")), "links_to", F.col("page_id")),
        edge(part, ident("Keyword", F.col("p_partkey")), ident("Topic", tx.slug(F.col("p_name"))), "appears_in", F.col("p_partkey")),
        edge(sold, graph.node_id(project, kind, ref), ident("Query", tx.content_hash(F.col("p_brand"))), "ranks_for", F.col("l_orderkey") * 10 + F.col("l_linenumber"), F.col("l_linenumber")),
    ]
    item = _t(spark, sf, "pages").select(project.alias("project_id"), F.col("page_id").alias("topic_id"), F.col("page_id").alias("ordinal"), F.inline(F.array(F.struct("url"), F.struct(F.when(F.col("page_id") % 5 == 0, F.concat("url", F.lit("?draft"))).alias("url")))))
    topics = part.select(project.alias("project_id"), F.col("p_partkey").alias("topic_id"), tx.slug(F.col("p_name")).alias("slug"), F.col("p_name").alias("name"))
    page_and_topic, covers = graph.content_topics(item.where("url is not null"), topics)
    all_nodes.append(page_and_topic)
    all_edges.append(covers)
    join = lambda rows: rows[0] if len(rows) == 1 else rows[0].unionByName(join(rows[1:]))
    return join(all_nodes), join(all_edges)


def knowledge(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    keep = keeper(spark)
    n, e = graph_rows(spark, sf)
    n = keep(graph.nodes(n))
    return n, keep(graph.edges(e, n))


def graph_nodes(spark: SparkSession, sf: str) -> DataFrame:
    return knowledge(spark, sf)[0]


def graph_edges(spark: SparkSession, sf: str) -> DataFrame:
    return knowledge(spark, sf)[1]


def graph_counters(spark: SparkSession, sf: str) -> DataFrame:
    return graph.counters(*knowledge(spark, sf))


def graph_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    """What every topic's keywords are: who comes to it."""
    n, e = knowledge(spark, sf)
    return graph.neighbours(n, e, n.where("type = 'Topic'"), "appears_in", out=False).select("id", "neighbour", "type", "label")


def graph_search(spark: SparkSession, sf: str) -> DataFrame:
    """Every topic's name as a query over keywords."""
    n, _ = knowledge(spark, sf)
    return graph.search(n, n.where("type = 'Topic'").select(F.col("label").alias("query")), 5, "Keyword").select("query", "label", "similarity", "text_rank", "score", "rank")


def graph_orphans(spark: SparkSession, sf: str) -> DataFrame:
    return graph.orphan_pages(*knowledge(spark, sf)).select("id", "label")


def technical_report(spark: SparkSession, sf: str) -> DataFrame:
    return reports.technical_report(findings(spark, sf).select("site", "severity", "check_code", "url", "url_pattern"))


def newest_crawls(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as crawl runs: the newest of one status."""
    return reports.newest(_t(spark, sf, "orders").where("o_orderstatus = 'F'").select("o_orderkey", "o_orderdate"), "o_orderdate", 100, "o_orderkey")


def draft_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as Markdown drafts: each gets headings and links by its number, and its own second word as keyword."""
    d = _t(spark, sf, "documents").select("doc_id", F.expr(DRAFT).alias("text"), F.expr(KEYWORD).alias("keyword"), (F.col("doc_id") % 5 * 200 + 100).cast("int").alias("target_words"), F.array(F.lit("Sizes"), F.lit("the")).alias("expected_headings"))
    rows = content.scored_drafts(d)
    return rows.select("doc_id", "score", "verdict", "coverage", "structure", "keyword_alignment", "linking", F.round("depth", 2).alias("depth"), F.array_join(content.weakest_dimensions(), ",").alias("weakest"))


DRAFT = "concat(coalesce(text, ''), repeat(concat(chr(10), '## Sizes', chr(10), 'see [a](/b) '), CAST(doc_id % 5 AS INT)))"
KEYWORD = "CASE WHEN doc_id % 7 = 0 THEN '' ELSE lower(split_part(coalesce(text, ''), ' ', 2)) END"


def model_objects(spark: SparkSession, sf: str) -> DataFrame:
    """JSON objects cut from answers, of which every third is broken, and why some are not the object that was asked for."""
    rows = _t(spark, sf, "conversations").select("conv_id", "turn", F.expr(OBJECT).alias("answer"))
    return rows.select("conv_id", "turn", tx.json_object(F.col("answer")).alias("object"), tx.rejection(F.col("answer"), {"score": "integer", "notes": "object?"}).alias("rejected"))


OBJECT = """concat('Sure: ', CASE WHEN turn % 3 = 0 THEN '{"score": ' WHEN conv_id % 5 = 0 THEN '{"notes": null} done' WHEN conv_id % 7 = 0 THEN '{"score": "9", "notes": [1]}' ELSE concat('{"score": ', CAST(conv_id AS STRING), ', "notes": {}} done') END)"""

_COLS = "site, type, action_class, url, url_pattern, score, priority, opportunity_key"
DETECTED_SQL = f"""{pages.OPPORTUNITIES_SQL}, {EVIDENCE_SQL}, {GROUPS_SQL}, {pages.INVENTORY_SQL.split(pages.FACTS_SQL + ",", 1)[1].replace("typed AS", "typed9 AS").replace("FROM typed)", "FROM typed9)").replace("scored AS", "scored9 AS").replace("FROM scored)", "FROM scored9)")},
  detections AS (SELECT {_COLS}, severity_rank AS a, check_code AS b, page_id AS c FROM opportunities WHERE url IN (SELECT url FROM evidence)
    UNION ALL SELECT site, 'consolidate_cannibalization', 'HIGH_RISK_WRITE', NULL, 'keyword:' || keyword, round(0.6 * 0.7 * 0.75 * 0.4 / 0.4 * 100, 3)::DOUBLE, 'P1', sha256('cannibalization|' || keyword), 9, 'consolidate_cannibalization', 0 FROM grouped
    UNION ALL SELECT site, 'improve_thin_content', 'HIGH_RISK_WRITE', url, NULL, round(0.5 * 0.6 * 0.8 * 0.4 / 0.3 * 100, 3)::DOUBLE, 'P1', sha256('thin|' || url), 9, 'improve_thin_content', 0 FROM inventory WHERE list_contains(string_split(flags, ','), 'thin')),
  folded AS (SELECT site, opportunity_key, first({{'type': type, 'action_class': action_class, 'url': url, 'url_pattern': url_pattern}} ORDER BY a, b, c) AS f, last({{'score': score, 'priority': priority}} ORDER BY a, b, c) AS l, count(*) AS times FROM detections GROUP BY ALL),
  state AS (SELECT *, CAST('0x' || left(opportunity_key, 2) AS INT) AS n FROM folded),
  upserted AS (SELECT site, opportunity_key, CASE WHEN n % 3 = 0 THEN 'detected' WHEN n % 4 = 0 THEN 'detected' ELSE 'planned' END AS status, l.score AS score, l.priority AS priority, CASE WHEN n % 3 = 0 THEN {DAY} ELSE {DAY} - 7 END AS first_seen, {DAY} AS last_seen,
      times + CASE WHEN n % 3 = 0 THEN 0 ELSE 1 END AS seen_count, CASE WHEN n % 3 = 0 THEN 'created' ELSE 'updated' END AS state FROM state
    UNION ALL SELECT 'gone.example', 'k', 'planned', 5.0, 'P3', {DAY}, {DAY}, 2, 'kept')"""
_RECIPES = "(VALUES " + ", ".join("('{}', '{}', '{}', '{}', '{}', '{}')".format(*r) for r in planning.RECIPES) + ") r(type, tool, step_class, rollback, verifier, objective)"
_ID = "sha256('p|{0}|' || {1})"
GRAPH_SQL = f"""{pages.FACTS_SQL}, live AS (SELECT page_id, url, internal0 FROM facts WHERE http_status = 200),
  sellers AS (SELECT DISTINCT CASE WHEN l_suppkey % 2 = 0 THEN 'Competitor' ELSE 'Page' END AS type, l_suppkey FROM lineitem),
  items AS (SELECT page_id, u AS url, p_name FROM (SELECT page_id, unnest(CASE WHEN page_id % 5 = 0 THEN [url, url || '?draft'] ELSE [url] END) AS u FROM pages) JOIN part ON p_partkey = page_id),
  node_rows AS (SELECT 'Page' AS type, sha256(url) AS ref_id, url AS label, page_id AS ordinal FROM live UNION ALL SELECT 'Keyword', p_partkey::VARCHAR, p_name || ' ' || lower(p_type), p_partkey FROM part
    UNION ALL SELECT 'Topic', replace(lower(p_name), ' ', '-'), p_name, p_partkey FROM part UNION ALL SELECT 'Query', sha256(p_brand), p_brand, p_partkey FROM part UNION ALL SELECT type, sha256(l_suppkey::VARCHAR), l_suppkey::VARCHAR, 0 FROM sellers
    UNION ALL SELECT 'Page', sha256(url), url, page_id FROM items UNION ALL SELECT 'Topic', replace(lower(p_name), ' ', '-'), p_name, page_id FROM items),
  nodes AS (SELECT sha256('p|' || type || '|' || ref_id) AS id, 'p' AS project_id, type, ref_id, last(label ORDER BY ordinal, label) AS label FROM node_rows GROUP BY type, ref_id),
  edge_rows AS (SELECT sha256('p|Page|' || sha256(url)) AS src, sha256('p|Page|' || sha256(target)) AS dst, 'links_to' AS relation, NULL::INT AS position, page_id AS ordinal FROM (SELECT page_id, url, unnest(internal0) AS target FROM live)
    UNION ALL SELECT sha256('p|Keyword|' || p_partkey), sha256('p|Topic|' || replace(lower(p_name), ' ', '-')), 'appears_in', NULL, p_partkey FROM part
    UNION ALL SELECT sha256('p|Page|' || sha256(url)), sha256('p|Topic|' || replace(lower(p_name), ' ', '-')), 'covers', NULL, page_id FROM items
    UNION ALL SELECT sha256('p|' || CASE WHEN l_suppkey % 2 = 0 THEN 'Competitor' ELSE 'Page' END || '|' || sha256(l_suppkey::VARCHAR)), sha256('p|Query|' || sha256(p_brand)), 'ranks_for', l_linenumber, l_orderkey * 10 + l_linenumber FROM lineitem JOIN part ON p_partkey = l_partkey),
  edges AS (SELECT src, dst, relation, 1.0::DOUBLE AS weight, last(position ORDER BY ordinal, position) AS position FROM edge_rows WHERE src <> dst AND src IN (SELECT id FROM nodes) AND dst IN (SELECT id FROM nodes) GROUP BY ALL)"""
_WANT = "CASE WHEN page_id % 3 = 0 THEN 'x' ELSE title END"
_SEV = technical.SEVERITIES

QUERIES.update(
    issue_evidence=Query(issue_evidence, f"WITH {pages.FINDINGS_SQL}, {EVIDENCE_SQL} SELECT site, normalized_key, evidence_id FROM findings LEFT JOIN evidence USING (url)"),
    opportunity_upsert=Query(opportunity_upsert, f"WITH {DETECTED_SQL} SELECT * FROM upserted"),
    opportunity_summary=Query(
        opportunity_summary,
        f"""WITH {DETECTED_SQL}, u AS (SELECT site, count_if(priority = 'P0') AS p0, count_if(priority = 'P1') AS p1, count_if(priority = 'P2') AS p2, count_if(priority = 'P3') AS p3, count_if(state = 'created') AS created, count_if(state = 'updated') AS updated FROM upserted WHERE state <> 'kept' GROUP BY 1),
        r AS (SELECT site, count(*) AS rejected FROM opportunities WHERE url IS NULL OR url NOT IN (SELECT url FROM evidence) GROUP BY 1)
        SELECT site, coalesce(p0, 0) AS p0, coalesce(p1, 0) AS p1, coalesce(p2, 0) AS p2, coalesce(p3, 0) AS p3, coalesce(created, 0) AS created, coalesce(updated, 0) AS updated, coalesce(rejected, 0) AS rejected FROM u FULL OUTER JOIN r USING (site)""",
    ),
    best_opportunities=Query(best_opportunities, f"WITH {DETECTED_SQL} SELECT site, opportunity_key, score FROM upserted WHERE priority = 'P1' AND status = 'detected' ORDER BY score DESC, site, opportunity_key LIMIT 40"),
    opportunity_evidence=Query(
        opportunity_evidence,
        f"WITH {pages.OPPORTUNITIES_SQL}, {EVIDENCE_SQL} SELECT DISTINCT evidence_id, 'opportunity' AS subject_type, site || '|' || opportunity_key AS subject_id FROM opportunities JOIN evidence USING (url) WHERE substring(evidence_id, 2, 6)::INT % 3 <> 0",
    ),
    plan_drafts=Query(
        plan_drafts,
        f"""WITH {DETECTED_SQL}, o AS (SELECT site || '|' || opportunity_key AS id, site, f.type AS type, coalesce(f.url, '') AS url, coalesce(f.url_pattern, '') AS pattern FROM folded),
        p AS (SELECT *, type = CASE WHEN length(site) % 2 = 0 THEN 'fix_canonical' ELSE 'add_schema' END AS alone, coalesce(nullif(url, ''), pattern) AS up, coalesce(nullif(pattern, ''), url) AS pu FROM o JOIN {_RECIPES} USING (type))
        SELECT id, type, tool, step_class AS max_action_class, NOT alone AS requires_approval, CASE WHEN alone THEN 'auto' ELSE 'approval_required' END AS permission, replace(replace(objective, '{{url}}', up), '{{url_pattern}}', pu) AS objective, verifier, rollback,
          left(sha256(concat_ws('|', 'step', id, tool, up)), 40) AS idempotency_key, false AS unresolved FROM p""",
    ),
    awaiting_plans=Query(awaiting_plans, f"WITH {DETECTED_SQL} SELECT site, priority, count(*) AS n FROM upserted WHERE status = 'detected' AND priority IN ('P0', 'P1') GROUP BY ALL"),
    change_assertions=Query(
        change_assertions,
        f"""WITH {pages.FACTS_SQL}, c AS (SELECT *, list_distinct(internal0) AS il, {list(CHECKS)}[page_id % 8 + 1] AS verifier FROM facts)
        SELECT page_id AS change_id, CASE WHEN page_id % 9 = 0 THEN 'http://gone.example/' ELSE url END AS url, verifier, page_id % 9 <> 0 AND CASE verifier WHEN 'canonical_change' THEN rtrim(canonical, '/') = rtrim(url, '/') WHEN 'metadata_change' THEN title = trim({_WANT}) WHEN 'content_change' THEN title = trim({_WANT})
          WHEN 'internal_link_added' THEN len(il) > 0 WHEN 'schema_change' THEN len(schema_blocks) > 0 AND (page_id % 2 = 1 OR list_contains(list_transform(schema_blocks, lambda b: lower(coalesce(json_extract_string(b, '$."@type"'), ''))), 'article'))
          WHEN 'redirect_added' THEN hops >= 1 WHEN 'noindex_removed' THEN NOT contains(robots_meta, 'noindex') ELSE false END AS passed, verifier <> 'no_such' AS known FROM c""",
    ),
    page_differences=Query(
        page_differences,
        f"WITH {pages.FACTS_SQL} SELECT url, concat_ws(',', CASE WHEN page_id % 3 = 0 THEN 'meta_description' END, CASE WHEN page_id % 2 = 0 THEN 'title' END) AS fields, CASE WHEN page_id % 2 = 0 THEN title || '!' END AS old_title FROM facts",
    ),
    graph_nodes=Query(graph_nodes, f"WITH {GRAPH_SQL} SELECT * FROM nodes"),
    graph_edges=Query(graph_edges, f"WITH {GRAPH_SQL} SELECT * FROM edges"),
    graph_counters=Query(graph_counters, f"WITH {GRAPH_SQL} SELECT 'node' AS kind, type AS name, count(*) AS n FROM nodes GROUP BY 2 UNION ALL SELECT 'edge', relation, count(*) FROM edges GROUP BY 2"),
    graph_neighbours=Query(graph_neighbours, f"WITH {GRAPH_SQL} SELECT e.dst AS id, e.src AS neighbour, n.type, n.label FROM edges e JOIN nodes n ON n.id = e.src WHERE relation = 'appears_in'"),
    graph_search=Query(
        graph_search,
        f"""WITH {GRAPH_SQL}, pieces AS (SELECT id, type, label, list_distinct(flatten(list_transform(regexp_extract_all(lower(label), '[a-z0-9]+'), lambda w: list_transform(range(1, len(w) + 2), lambda i: substring('  ' || w || ' ', i, 3))))) AS t, list_distinct(regexp_extract_all(lower(label), '[a-z0-9]+')) AS w FROM nodes WHERE type IN ('Topic', 'Keyword')),
        met AS (SELECT q.label AS query, k.id, k.label, len(list_intersect(q.t, k.t)) / len(list_distinct(list_concat(q.t, k.t))) AS s, len(list_intersect(q.w, k.w)) = len(q.w) AS every, q.w[1] AS one, q.w[2] AS two, list_append(regexp_extract_all(lower(k.label), '[a-z0-9]+'), 'keyword') AS kw
          FROM pieces q JOIN pieces k ON q.type = 'Topic' AND k.type = 'Keyword' WHERE len(list_intersect(q.t, k.t)) > 0),
        ranked AS (SELECT query, id, label, s, every, 1 - list_aggregate(flatten(list_transform(range(1, len(kw) + 1), lambda i: list_transform(range(1, len(kw) + 1), lambda j: CASE WHEN kw[i] = one AND kw[j] = two THEN 1 - 0.1 * sqrt(1 / (1.005::DOUBLE + 0.05::DOUBLE * exp(abs(i - j) / 1.5::DOUBLE - 2))) ELSE 1.0::DOUBLE END))), 'product') AS r FROM met)
        SELECT query, label, round(s, 6) AS similarity, round(r, 6) AS text_rank, round(s + r, 6) AS score, row_number() OVER (PARTITION BY query ORDER BY round(s + r, 6) DESC, id) AS rank FROM ranked WHERE s > 0.1 OR every QUALIFY rank <= 5""",
    ),
    graph_orphans=Query(graph_orphans, f"WITH {GRAPH_SQL} SELECT id, label FROM nodes WHERE type = 'Page' AND id NOT IN (SELECT dst FROM edges WHERE relation = 'links_to')"),
    technical_report=Query(
        technical_report,
        f"""WITH {pages.FINDINGS_SQL}, i AS (SELECT *, coalesce(url, url_pattern, '*') AS spot, row_number() OVER (PARTITION BY site, severity ORDER BY check_code, coalesce(url, url_pattern, '*')) AS place FROM findings),
        c AS (SELECT site, count(*) AS n_issues, concat_ws(', ', {", ".join(f"count_if(severity = '{s}') || ' {s}'" for s in _SEV)}) AS counts FROM findings GROUP BY 1),
        t AS (SELECT site, severity, severity_rank, '| Check | URL / pattern |' || chr(10) || '|---|---|' || chr(10) || string_agg('| ' || check_code || ' | ' || left(spot, 50) || ' |', chr(10) ORDER BY place) || chr(10) AS m FROM i WHERE place <= 30 GROUP BY ALL),
        b AS (SELECT site, string_agg('## ' || upper(severity[1]) || severity[2:] || chr(10) || m, chr(10) ORDER BY severity_rank) AS body FROM t GROUP BY 1)
        SELECT site, n_issues, counts, '**' || n_issues || ' open issues** — ' || counts || chr(10) || chr(10) || body AS markdown FROM c JOIN b USING (site)""",
    ),
    newest_crawls=Query(newest_crawls, "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderdate DESC, o_orderkey LIMIT 100"),
    draft_scores=Query(
        draft_scores,
        rf"""WITH d AS (SELECT doc_id, {DRAFT} AS text, {KEYWORD} AS key, doc_id % 5 * 200 + 100 AS target FROM documents),
        m AS (SELECT *, lower(text) AS low, len(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda w: w <> '')) AS words, len(regexp_extract_all(text, '(?m)^##\s+.+$')) AS h2, len(regexp_extract_all(text, '\[[^\]]+\]\((/[^)]+|https?://[^)]+)\)')) AS links FROM d),
        p AS (SELECT *, key <> '' AND contains(low, key) AS found, CASE WHEN contains(low, 'sizes') THEN 5 ELSE 0 END + CASE WHEN contains(low, 'the') THEN 5 ELSE 0 END AS covers, CASE WHEN words >= target * 0.9 THEN 20 WHEN words >= target * 0.6 THEN 12 ELSE 5 END AS w FROM m),
        k AS (SELECT *, CASE WHEN found AND contains(left(low, 500), key) THEN 15 WHEN found THEN 8 ELSE 0 END AS opening, CASE WHEN found THEN (length(low) - length(replace(low, key, ''))) // length(key) ELSE 0 END AS mentions FROM p),
        s AS (SELECT *, least(100, w + opening + covers + CASE WHEN h2 >= 3 THEN 15 WHEN h2 >= 1 THEN 8 ELSE 0 END + CASE WHEN links >= 3 THEN 15 WHEN links >= 1 THEN 7 ELSE 0 END + least(10, mentions * 2)) AS score FROM k),
        r AS (SELECT doc_id, score, CASE WHEN score >= 70 THEN 'PASS' WHEN score >= 45 THEN 'REVISE' ELSE 'FAIL' END AS verdict, w + covers AS coverage, h2 * 3 AS structure, opening + mentions AS keyword_alignment, links * 3 AS linking, round(least(20, score / 5), 2) AS depth FROM s)
        SELECT *, array_to_string(list_transform(list_sort([{{'v': coverage::DOUBLE, 'i': 0, 'd': 'coverage'}}, {{'v': structure::DOUBLE, 'i': 1, 'd': 'structure'}}, {{'v': keyword_alignment::DOUBLE, 'i': 2, 'd': 'keyword_alignment'}}, {{'v': linking::DOUBLE, 'i': 3, 'd': 'linking'}}, {{'v': depth::DOUBLE, 'i': 4, 'd': 'depth'}}])[1:2], lambda x: x.d), ',') AS weakest FROM r""",
    ),
    model_objects=Query(
        model_objects,
        """WITH o AS (SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN NULL WHEN conv_id % 5 = 0 THEN '{"notes": null}' WHEN conv_id % 7 = 0 THEN '{"score": "9", "notes": [1]}' ELSE concat('{"score": ', conv_id, ', "notes": {}}') END AS object FROM conversations),
        t AS (SELECT *, json_type(object, '$.score') AS score, json_type(object, '$.notes') AS notes FROM o)
        SELECT conv_id, turn, object, CASE WHEN object IS NULL THEN 'no object' ELSE nullif(concat_ws(', ', CASE WHEN coalesce(score, 'NULL') = 'NULL' THEN 'score: missing' WHEN score NOT IN ('UBIGINT', 'BIGINT') THEN 'score: not integer' END,
          CASE WHEN coalesce(notes, 'NULL') NOT IN ('NULL', 'OBJECT') THEN 'notes: not object' END), '') END AS rejected FROM t""",
    ),
)

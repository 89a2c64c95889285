"""Web pages and link graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillstack.operators import chunk as ck
from quillstack.operators import graph as gr
from quillstack.operators import web as wb
from quillstack.plans.ingest import ingest_pages
from quillstack.registry import register
from quillstack.registry import sqltext as q
from quillstack.session import load_table, spread


#: What the test pages hold, replaced one after the other, the ampersand last.
REFERENCES = [
    ("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"),
    ("&copy;", "©"), ("&middot;", "·"), ("&ndash;", "–"), ("&mdash;", "—"), ("&hellip;", "…"), ("&euro;", "€"), ("&amp;", "&"),
]


def pages(spark, folder):
    return spread(load_table(spark, folder, "pages"), "page_id")


def sql_rules(expr, rules):
    for pattern, replacement in rules:
        target = replacement.replace("\\", "\\\\").replace("$1", "\\1").replace("$2", "\\2")
        expr = f"regexp_replace({expr}, {q.quote(pattern)}, {q.quote(target)}, 'g')"
    return expr


def sql_unescape(expr):
    for reference, char in REFERENCES:
        expr = f"replace({expr}, {q.quote(reference)}, {q.quote(char)})"
    return expr


def sql_clean(expr="html", tags=tuple(wb.UNWANTED_TAGS)):
    expr = f"regexp_replace({expr}, {q.quote(wb.COMMENT)}, '', 'g')"
    for tag in tags:
        expr = f"regexp_replace({expr}, {q.quote(wb.tag_pattern(tag))}, '', 'g')"
    return expr


VISIBLE = sql_clean("html", ("script", "style"))
ORIGIN = "regexp_extract(url, '^[a-z]+://[^/?#]*')"
# Links are site-relative; on odd pages they are written relative to the folder, unless the page is a folder itself.
LINKS = f"""
lk AS (SELECT DISTINCT page_id, url, {ORIGIN} || h AS link FROM (
  SELECT page_id, url, {q.strip(sql_unescape('unnest(l)'))} AS h
  FROM (SELECT page_id, url, regexp_extract_all({VISIBLE}, '<a\\s+href="([^"]*)"', 1) AS l FROM pages)))"""


def linked_html():
    relative = (F.col("page_id") % 2 == 1) & ~F.col("url").rlike(r"\A[^?#]*/(?:[?#]|\z)")
    return F.when(relative, F.replace("html", F.lit('href="/'), F.lit('href="./../'))).otherwise(F.col("html"))


def linked_pages(spark, folder):
    return pages(spark, folder).withColumn("html", linked_html())


@register("w1_page_links", f"WITH {LINKS} SELECT page_id, link FROM lk")
def w1(spark, folder):
    return wb.extract_links(linked_pages(spark, folder)).select("page_id", "link")


NORMAL = "regexp_replace(regexp_replace(url, '#.*$', ''), '\\?$', '')"


@register("w2_normalize_url", f"SELECT page_id, {NORMAL} AS url FROM pages WHERE starts_with(url, 'http')")
def w2(spark, folder):
    return pages(spark, folder).select("page_id", wb.normalize_url(F.col("url")).alias("url")).filter("url IS NOT NULL")


@register(
    "w3_should_crawl",
    f"""
WITH {LINKS}, c AS (SELECT page_id, link FROM lk UNION ALL SELECT page_id, {NORMAL} FROM pages)
SELECT c.page_id, c.link, regexp_extract(c.link, '://([^/?#]*)', 1) = regexp_extract(p.url, '://([^/?#]*)', 1)
  AND NOT regexp_matches(c.link, 'th$') AND NOT regexp_matches(c.link, '[.]html$') AND regexp_matches(c.link, '/(en|de)/|/[a-m]') AS keep
FROM c JOIN pages p ON c.page_id = p.page_id
""",
)
def w3(spark, folder):
    """Links and the pages themselves, against the page's own host and patterns."""
    rows = wb.extract_links(linked_pages(spark, folder)).unionByName(
        pages(spark, folder).select("page_id", "url", wb.normalize_url(F.col("url")).alias("link"))
    )
    keep = wb.should_crawl(F.col("link"), wb.url_host(F.col("url")), ["/(en|de)/", "/[a-m]"], ["th$", "[.]html$"])
    return rows.select("page_id", F.col("link"), keep.alias("keep"))


@register(
    "w4_robots",
    """
WITH h AS (SELECT page_id, url, regexp_extract(url, '://([^/?#]*)', 1) AS host, regexp_extract(url, '://[^/?#]*([^#]*)', 1) AS path FROM pages),
a AS (SELECT DISTINCT host, '*' AS agent, '/en/' AS prefix, false AS allow FROM h WHERE starts_with(host, 'blog')
      UNION SELECT DISTINCT host, '*', '/en/3', true FROM h WHERE starts_with(host, 'blog')
      UNION SELECT DISTINCT host, '*', '/', false FROM h WHERE starts_with(host, 'm.')
      UNION SELECT DISTINCT host, 'reader', '/de', true FROM h WHERE starts_with(host, 'm.')
      UNION SELECT DISTINCT host, 'other', '/', false FROM h),
r AS (SELECT * FROM a WHERE agent = 'reader'
      UNION SELECT * FROM a WHERE agent = '*' AND host NOT IN (SELECT host FROM a WHERE agent = 'reader'))
SELECT h.page_id, coalesce(arg_max(r.allow, length(r.prefix)) FILTER (starts_with(h.path, r.prefix)), true) AS allowed
FROM h LEFT JOIN r ON h.host = r.host GROUP BY h.page_id
""",
)
def w4(spark, folder):
    """Blogs forbid /en/ but not /en/3; mobile hosts forbid everything, but not to this agent; other agents' rules do not count."""
    hosts = pages(spark, folder).select(wb.url_host(F.col("url")).alias("host")).distinct()

    def rule(start, prefix, allow, agent="*"):
        return hosts.filter(F.col("host").startswith(start)).select(
            "host", F.lit(agent).alias("agent"), F.lit(prefix).alias("prefix"), F.lit(allow).alias("allow")
        )

    rules = rule("blog", "/en/", False).union(rule("blog", "/en/3", True)).union(rule("m.", "/", False))
    rules = rules.union(rule("m.", "/de", True, "reader")).union(rule("", "/", False, "other"))
    return wb.robots_allowed(pages(spark, folder), rules, "reader").select("page_id", "allowed")


TITLE = q.strip(sql_unescape("regexp_extract(html, '(?is)<title\\b[^>]*>([^<]*)</title', 1)"))


@register(
    "w5_titles",
    f"""
SELECT page_id, CASE page_id % 4 WHEN 1 THEN {q.strip(sql_unescape("regexp_extract(html, '(?is)<h1>([^<]*)</h1', 1)"))}
  WHEN 2 THEN 'og ' || page_id ELSE {TITLE} END AS title FROM pages
""",
)
def w5(spark, folder):
    """A quarter of the pages loses its title, another quarter also its heading and gets an og:title."""
    case = F.col("page_id") % 4
    bare = F.regexp_replace("html", r"<title>[^<]*</title>", "")
    og = F.concat(F.lit('<meta property="og:title" content="og '), F.col("page_id").cast("string"), F.lit('">'))
    html = F.when(case == 1, bare).when(case == 2, F.concat(og, F.regexp_replace(bare, "</?h1>", ""))).otherwise(F.col("html"))
    return pages(spark, folder).select("page_id", wb.page_title(html).alias("title"))


@register(
    "w6_remove_unwanted",
    f"""
SELECT page_id, regexp_replace(regexp_replace({sql_clean()}, '(?is)<nav\\b[^>]*>.*?</nav\\s*>', '', 'g'),
  '(?is)<div class="ad">.*?</div\\s*>', '', 'g') AS html FROM pages
""",
)
def w6(spark, folder):
    return pages(spark, folder).select("page_id", wb.remove_unwanted(F.col("html"), ["nav", ".ad"]).alias("html"))


HEADLESS = f"regexp_replace(regexp_replace({sql_clean()}, {q.quote(wb.tag_pattern('head'))}, '', 'g'), '(?i)<!doctype[^>]*>', '', 'g')"
MARKDOWN = q.strip(sql_rules(sql_unescape(sql_rules(HEADLESS, wb.MARKDOWN_RULES)), wb.TIDY_RULES))


@register("w7_html_to_markdown", f"SELECT page_id, {MARKDOWN} AS markdown FROM pages")
def w7(spark, folder):
    return pages(spark, folder).select("page_id", wb.html_to_markdown(F.col("html")).alias("markdown"))


@register(
    "w8_valid_content",
    f"""
SELECT 'page' AS kind, page_id AS id, length({MARKDOWN}) >= 1500 AS valid FROM pages
UNION ALL SELECT 'document', doc_id, length(text) >= 100 AND {q.has_content('text')} FROM documents
""",
)
def w8(spark, folder):
    text = wb.html_to_markdown(F.col("html"))
    rows = pages(spark, folder).select(
        F.lit("page").alias("kind"), F.col("page_id").alias("id"), wb.is_valid_content(text, 1500).alias("valid")
    )
    docs = load_table(spark, folder, "documents")
    return rows.union(docs.select(F.lit("document"), "doc_id", wb.is_valid_content(F.col("text"))))


def part_supplier_edges(spark, folder):
    """Undirected edges between the parts and suppliers of the line items."""
    rows = load_table(spark, folder, "lineitem").select("l_partkey", "l_suppkey").distinct()
    part = F.concat(F.lit("p:"), F.col("l_partkey").cast("string"))
    supplier = F.concat(F.lit("s:"), F.col("l_suppkey").cast("string"))
    return rows.select(part.alias("src"), supplier.alias("dst")).union(rows.select(supplier, part))


EDGES = """e AS (SELECT DISTINCT 'p:' || l_partkey AS src, 's:' || l_suppkey AS dst FROM lineitem
  UNION SELECT DISTINCT 's:' || l_suppkey, 'p:' || l_partkey FROM lineitem)"""


@register(
    "w9_breadth_first",
    f"""
WITH RECURSIVE {EDGES}, b AS (SELECT 's:1' AS node, 0 AS depth UNION SELECT e.dst, b.depth + 1 FROM b JOIN e ON b.node = e.src WHERE b.depth < 2)
SELECT node, min(depth) AS depth FROM b GROUP BY node
""",
)
def w9(spark, folder):
    edges = part_supplier_edges(spark, folder)
    return gr.breadth_first(edges, spark.range(1).select(F.lit("s:1").alias("node")), 2)


@register(
    "w9_bounded_crawl",
    f"""
WITH RECURSIVE {EDGES}, b AS (SELECT 's:1' AS node, 0 AS depth UNION SELECT e.dst, b.depth + 1 FROM b JOIN e ON b.node = e.src
  WHERE b.depth < 3 AND (starts_with(b.node, 's:') OR CAST(b.node[3:] AS INT) % 10 = 0))
SELECT node, min(depth) AS depth FROM b GROUP BY node ORDER BY 2, 1 LIMIT 400
""",
)
def w9_bounded(spark, folder):
    """Links are followed from valid nodes only (suppliers, every tenth part); the first 400 nodes are kept."""
    edges = part_supplier_edges(spark, folder)
    names = edges.select(F.col("src").alias("node")).distinct()
    valid = names.filter(F.col("node").startswith("s:") | (F.substring("node", 3, 20).cast("int") % 10 == 0))
    return gr.breadth_first(edges, spark.range(1).select(F.lit("s:1").alias("node")), 3, 400, valid)


@register(
    "w10_crawl_statistics",
    f"""
WITH {LINKS}, n AS (SELECT page_id, count(*) AS links, count(*) FILTER (regexp_matches(link, '/[a-m]')) AS kept FROM lk GROUP BY page_id),
p AS (SELECT page_id, CASE WHEN length({MARKDOWN}) >= 1500 THEN 'ok' ELSE 'too short' END AS status, length({MARKDOWN}) AS chars FROM pages)
SELECT status, count(*) AS pages, sum(chars)::BIGINT AS chars, sum(coalesce(links, 0))::BIGINT AS links, sum(coalesce(kept, 0))::BIGINT AS kept
FROM p LEFT JOIN n USING (page_id) GROUP BY status
""",
)
def w10(spark, folder):
    """Per status: pages, characters, links found and links that pass the rules. Links are counted inside the page's row."""
    rows = pages(spark, folder).select(
        F.length(wb.html_to_markdown(F.col("html"))).alias("chars"), wb.page_links(linked_html(), F.col("url")).alias("links")
    )
    kept = F.size(F.filter("links", lambda u: wb.should_crawl(u, None, ["/[a-m]"])))
    status = F.when(F.col("chars") >= 1500, F.lit("ok")).otherwise(F.lit("too short"))
    return rows.withColumn("kept", kept).groupBy(status.alias("status")).agg(
        F.count(F.lit(1)).alias("pages"), F.sum("chars").alias("chars"), F.sum(F.size("links")).alias("links"), F.sum("kept").alias("kept")
    )


PAGE_TEXT = f"'# ' || {TITLE} || chr(10) || chr(10) || '**Source:** ' || url || chr(10) || chr(10) || '**Crawled:** 2024-01-01T00:00:00' || chr(10) || chr(10) || '---' || chr(10) || chr(10) || {MARKDOWN}"


@register(
    "w11_ingest_pages",
    f"""
WITH t AS (SELECT url, {PAGE_TEXT} AS text FROM pages WHERE length({MARKDOWN}) >= 100),
u AS (SELECT url, max(text) AS text FROM t GROUP BY url)
SELECT 'web' AS collection, sha256(text) AS content_hash, true AS created, true AS changed,
       len({q.kept(q.windows('text', 800, 100))}) AS chunks FROM u
""",
)
def w11(spark, folder):
    """Pages become documents with a header block and are chunked and embedded in the same job."""
    at = F.timestamp_seconds(F.lit(1704067200))
    done = ingest_pages(None, pages(spark, folder), "web", at, ck.ChunkConfig(800, 100))
    return done.report.drop("doc_id")




@register(
    "w12_table_markdown",
    """
SELECT p_partkey, '| Key | Name \\| x |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || p_partkey || ' | ' || p_name || ' & co |' AS markdown FROM part
""",
)
def w12(spark, folder):
    html = F.concat(
        F.lit("<table><tr><th>Key</th><th>Name | x</th></tr><tr><td><b>"), F.col("p_partkey").cast("string"),
        F.lit("</b></td><td>"), "p_name", F.lit(" &amp; co</td></tr></table>"),
    )
    return load_table(spark, folder, "part").select("p_partkey", wb.table_markdown(html).alias("markdown"))


@register(
    "w13_graph_problems",
    """
WITH RECURSIVE n AS (SELECT 's:' || s_suppkey AS id, CASE WHEN s_nationkey < 2 THEN 'start' ELSE 'step' END AS type FROM supplier
   UNION ALL SELECT 's:' || s_suppkey, CASE WHEN s_nationkey < 2 THEN 'start' ELSE 'step' END FROM supplier WHERE s_nationkey = 3
   UNION ALL SELECT 'p:' || p_partkey, 'step' FROM part),
e AS (SELECT DISTINCT 's:' || l_suppkey AS src, 'p:' || l_partkey AS dst FROM lineitem WHERE l_partkey % 3 <> 0),
b AS (SELECT id AS node FROM n WHERE type = 'start' UNION SELECT e.dst FROM b JOIN e ON b.node = e.src)
SELECT 'duplicate id' AS problem, id AS node FROM n GROUP BY id HAVING count(*) > 1
UNION ALL SELECT 'start count', CAST(count(DISTINCT id) AS VARCHAR) FROM n WHERE type = 'start'
UNION ALL SELECT 'no end', '0'
UNION ALL SELECT DISTINCT 'unreachable', id FROM n WHERE id NOT IN (SELECT node FROM b)
""",
)
def w13(spark, folder):
    """Suppliers lead to parts whose key is no multiple of three; suppliers of two nations are starts, there is no end."""
    suppliers = load_table(spark, folder, "supplier").select(
        F.concat(F.lit("s:"), F.col("s_suppkey").cast("string")).alias("id"),
        F.when(F.col("s_nationkey") < 2, F.lit("start")).otherwise(F.lit("step")).alias("type"), "s_nationkey",
    )
    parts = load_table(spark, folder, "part").select(
        F.concat(F.lit("p:"), F.col("p_partkey").cast("string")).alias("id"), F.lit("step").alias("type")
    )
    nodes = suppliers.drop("s_nationkey").union(suppliers.filter("s_nationkey = 3").drop("s_nationkey")).union(parts)
    edges = load_table(spark, folder, "lineitem").filter("l_partkey % 3 <> 0").select(
        F.concat(F.lit("s:"), F.col("l_suppkey").cast("string")).alias("src"),
        F.concat(F.lit("p:"), F.col("l_partkey").cast("string")).alias("dst"),
    ).distinct()
    return gr.graph_problems(nodes, edges)

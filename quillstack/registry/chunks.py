"""Paragraphs, chunks and parse elements."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillstack.functions.windows import page
from quillstack.operators import chunk as ck
from quillstack.registry import register
from quillstack.registry import sqltext as q
from quillstack.session import load_table, spread

SEPARATORS = ["\n", ". "]
MARKDOWN = "'# ' || lang || chr(10) || text || chr(10) || '## ' || source || chr(10) || text"


def docs(spark, folder):
    return spread(load_table(spark, folder, "documents").select("doc_id", "text"), "doc_id")


def markdown_docs(spark, folder):
    text = F.concat(F.lit("# "), "lang", F.lit("\n"), "text", F.lit("\n## "), "source", F.lit("\n"), "text")
    return spread(load_table(spark, folder, "documents"), "doc_id").select("doc_id", text.alias("text"))


@register(
    "c1_parse_paragraphs",
    """
SELECT doc_id, unnest(range(0, len(l))) AS position, unnest(l).kind AS kind, unnest(l).text AS text FROM (
  SELECT doc_id, list_concat(
     list_transform(string_split(text, chr(10)), lambda x: {'kind': 'segment', 'text': x}),
     [{'kind': 'table', 'text': lang}, {'kind': 'figure', 'text': source}]) AS l FROM documents)
""",
)
def c1(spark, folder):
    """Parse results whose segments are the document's lines, with one table and one figure."""

    def item(text):
        return F.struct(text.alias("text"), F.create_map(F.lit("origin"), F.lit("x")).alias("metadata"))

    parsed = F.to_json(
        F.struct(
            F.transform(F.split("text", "\n"), item).alias("segments"),
            F.array(item(F.col("lang"))).alias("tables"),
            F.array(item(F.col("source"))).alias("figures"),
        )
    )
    rows = load_table(spark, folder, "documents").select("doc_id", parsed.alias("parsed_content"))
    return ck.parse_paragraphs(rows).drop("metadata")


@register("c2_fixed_size_chunks", q.explode("documents", "doc_id", q.kept(q.windows("text", 1000, 200))))
def c2(spark, folder):
    return ck.explode_chunks(docs(spark, folder), ck.fixed_size_chunks(F.col("text"), 1000, 200))


@register("c2_whole_text", f"SELECT doc_id, 0 AS index, {q.strip('text')} AS chunk FROM documents WHERE {q.has_content('text')}")
def c2_whole(spark, folder):
    return ck.explode_chunks(docs(spark, folder), ck.fixed_size_chunks(F.col("text"), None))


@register("c3_split_units", q.explode("documents", "doc_id", q.units("text", SEPARATORS)))
def c3(spark, folder):
    return ck.explode_chunks(docs(spark, folder), ck.split_units(F.col("text"), SEPARATORS))


LINKED = "replace(replace(translate(text, '$[]()`', ''), ' and ', ' ![and, x. y](u/a b), '), ' de ', ' $de, la. x$ ')"


@register(
    "c4_protected_units",
    f"""
WITH t AS (SELECT doc_id, {LINKED} AS text FROM documents),
s AS (SELECT doc_id, string_split_regex(regexp_replace(text, '(!\\[[^\\]]*\\]\\([^)]*\\)|\\$[^$\\n]+\\$)', chr(2) || '\\1' || chr(2), 'g'),
             chr(2)) AS l FROM t),
e AS (SELECT doc_id, unnest(range(0, len(l))) AS n, unnest(l) AS part FROM s),
u AS (SELECT doc_id, n, CASE WHEN n % 2 = 1 THEN [part] ELSE {q.units('part', SEPARATORS + [', '])} END AS l FROM e)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY n, i) - 1 AS index, chunk
FROM (SELECT doc_id, n, unnest(range(0, len(l))) AS i, unnest(l) AS chunk FROM u)
""",
)
def c4(spark, folder):
    """Texts with images and formulas put in place of common words."""
    plain = F.translate("text", "$[]()`", "")
    text = F.replace(F.replace(plain, F.lit(" and "), F.lit(" ![and, x. y](u/a b), ")), F.lit(" de "), F.lit(" $de, la. x$ "))
    rows = docs(spark, folder).withColumn("text", text)
    return ck.explode_chunks(rows, ck.split_units_protected(F.col("text"), SEPARATORS + [", "]))


PARAGRAPHS = f"list_filter(string_split(text, chr(10)), lambda p: {q.has_content('p')})"


@register(
    "c5_recursive_chunks",
    f"""
WITH p AS (SELECT doc_id, list_transform({PARAGRAPHS}, lambda x: array_to_string({q.units('x', SEPARATORS)}, '')) AS l FROM documents),
o AS (SELECT doc_id, l, array_to_string(l, '') AS text,
             list_transform(range(1, len(l) + 1), lambda k: coalesce(list_sum(list_transform(l[1:k - 1], lambda x: length(x))), 0)) AS starts
      FROM p WHERE len(l) > 0),
w AS (SELECT doc_id, starts, list_transform({q.windows('text', 300, 60)}, lambda x, j: {{'t': x, 's': (j - 1) * 240}}) AS l FROM o),
k AS (SELECT doc_id, starts, list_filter(l, lambda x: {q.has_content("x['t']")}) AS l FROM w),
e AS (SELECT doc_id, starts, unnest(range(0, len(l))) AS index, unnest(l) AS c FROM k)
SELECT doc_id, index, {q.strip("c['t']")} AS text,
       CAST(len(list_filter(starts, lambda x: x <= c['s'])) AS VARCHAR) AS paragraph FROM e
""",
)
def c5(spark, folder):
    """Lines are the paragraphs; each chunk names the paragraph it starts in."""
    items = F.transform(
        ck.non_blank(F.split("text", "\n")),
        lambda p, i: F.struct(p.alias("text"), F.create_map(F.lit("n"), (i + 1).cast("string")).alias("metadata")),
    )
    rows = docs(spark, folder).select("doc_id", items.alias("paragraphs"))
    config = ck.ChunkConfig(size=300, overlap=60, separators=tuple(SEPARATORS))
    chunks = ck.recursive_chunks(rows, config)
    return chunks.select("doc_id", "index", "text", F.col("metadata")["n"].alias("paragraph"))


@register(
    "c5_paragraph_units",
    f"""
WITH p AS (SELECT doc_id, {PARAGRAPHS} AS l FROM documents),
e AS (SELECT doc_id, unnest(range(1, len(l) + 1)) AS n, unnest(l) AS x FROM p),
u AS (SELECT doc_id, n, {q.units('x', SEPARATORS)} AS l FROM e),
f AS (SELECT doc_id, n, unnest(range(0, len(l))) AS i, unnest(l) AS t FROM u)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY n, i) - 1 AS index, {q.strip('t')} AS text,
       CAST(n AS VARCHAR) AS paragraph FROM f
""",
)
def c5_units(spark, folder):
    """Without a size the units are the chunks."""
    items = F.transform(
        ck.non_blank(F.split("text", "\n")),
        lambda p, i: F.struct(p.alias("text"), F.create_map(F.lit("n"), (i + 1).cast("string")).alias("metadata")),
    )
    rows = docs(spark, folder).select("doc_id", items.alias("paragraphs"))
    chunks = ck.recursive_chunks(rows, ck.ChunkConfig(None, 0, tuple(SEPARATORS), protect=False))
    return chunks.select("doc_id", "index", "text", F.col("metadata")["n"].alias("paragraph"))


@register(
    "c6_token_chunks",
    f"""
WITH RECURSIVE p AS (SELECT doc_id, {PARAGRAPHS} AS l FROM documents),
e AS (SELECT doc_id, unnest(range(1, len(l) + 1)) AS n, unnest(l) AS x FROM p),
u AS (SELECT doc_id, n, {q.units('x', SEPARATORS)} AS l FROM e),
f AS (SELECT doc_id, n, unnest(range(0, len(l))) AS i, unnest(l) AS text FROM u),
w AS (SELECT doc_id, n, i, CASE WHEN length(text) // 4 <= 120 THEN [text]
        ELSE list_filter({q.windows('text', 480, 80)}, lambda x: {q.has_content('x')}) END AS l FROM f),
g AS (SELECT doc_id, n, i, unnest(range(0, len(l))) AS j, unnest(l) AS t FROM w),
d AS (SELECT doc_id, list(n ORDER BY n, i, j) AS ns, list(t ORDER BY n, i, j) AS ts, list(length(t) // 4 ORDER BY n, i, j) AS c FROM g GROUP BY doc_id),
r AS (SELECT doc_id, ns, ts, len(ts) AS k, list_transform(range(0, len(c) + 1), lambda m: coalesce(list_sum(c[1:m]), 0)::BIGINT) AS s FROM d),
walk AS (
  SELECT doc_id, 0::BIGINT AS b, coalesce(list_filter(range(1, k), lambda m: s[m + 2] - s[1] > 120)[1], k) AS e FROM r
  UNION ALL
  SELECT doc_id, b, coalesce(list_filter(range(b + 1, k), lambda m: s[m + 2] - s[b + 1] > 120)[1], k) AS e FROM (
    SELECT r.doc_id, k, s, list_filter(range(walk.b, walk.e + 1), lambda m: s[m + 1] >= greatest(s[walk.e + 1] - 20, s[walk.e + 2] - 120))[1] AS b
    FROM walk JOIN r ON r.doc_id = walk.doc_id WHERE walk.e < k)),
o AS (SELECT doc_id, b, e, {q.strip("array_to_string(ts[b + 1:e], '')")} AS text, CAST(ns[b + 1] AS VARCHAR) AS paragraph FROM walk JOIN r USING (doc_id))
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY b, e) - 1 AS index, text, paragraph FROM o WHERE {q.has_content('text')}
""",
)
def c6(spark, folder):
    """Greedy merge of sentences up to 120 tokens with 20 tokens carried over."""
    rows = docs(spark, folder).select(
        "doc_id",
        F.transform(
            ck.non_blank(F.split("text", "\n")),
            lambda p, i: F.struct(p.alias("text"), F.create_map(F.lit("n"), (i + 1).cast("string")).alias("metadata")),
        ).alias("paragraphs"),
    )
    config = ck.ChunkConfig(size=120, overlap=20, separators=tuple(SEPARATORS), protect=False, use_token_count=True)
    return ck.recursive_chunks(rows, config).select("doc_id", "index", "text", F.col("metadata")["n"].alias("paragraph"))


@register("c7_token_counts", "SELECT doc_id, length(text) // 4 AS tokens FROM documents")
def c7(spark, folder):
    return ck.with_token_counts(docs(spark, folder)).select("doc_id", "tokens")


@register("c8_token_windows", q.explode("documents", "doc_id", q.windows("text", 4 * 256, 4 * 32)))
def c8(spark, folder):
    return ck.explode_chunks(docs(spark, folder), ck.token_windows(F.col("text"), 256, 32))


def sections_sql(source, pattern):
    pattern = q.quote(f"(?m)^({pattern})")
    return f"""
 s AS (SELECT doc_id, list_filter(string_split(regexp_replace({source}, {pattern}, chr(1) || '\\1', 'g'), chr(1)),
              lambda x: x <> '') AS l FROM documents),
 x AS (SELECT doc_id, len(l) AS n_sections, unnest(range(0, len(l))) AS n, unnest(l) AS sec FROM s)"""


@register(
    "c9_markdown_chunks",
    f"""
WITH {sections_sql(MARKDOWN, ck.ATX_HEADER)},
w AS (SELECT doc_id, n, {q.strip("string_split(sec, chr(10))[1]")} AS section,
             {q.kept(q.windows("regexp_replace(sec, chr(10) || '$', '')", 500, 100))} AS l FROM x),
e AS (SELECT doc_id, n, section, unnest(range(0, len(l))) AS i, unnest(l) AS text FROM w)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY n, i) - 1 AS index, section, text FROM e
""",
)
def c9(spark, folder):
    return ck.markdown_chunks(markdown_docs(spark, folder), ck.ChunkConfig(size=500, overlap=100))


@register(
    "c10_custom_headers",
    f"""
WITH {sections_sql(MARKDOWN, "[ \\t]*(?:## src1|## |Th)")}
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY n) - 1 AS index,
       CASE WHEN regexp_matches(sec, '^[ \\t]*(?:## |Th)') THEN {q.strip("string_split(sec, chr(10))[1]")} ELSE '' END AS section,
       {q.strip('sec')} AS text
FROM x WHERE {q.has_content('sec')}
""",
)
def c10(spark, folder):
    config = ck.ChunkConfig(size=None, overlap=0)
    return ck.markdown_chunks(markdown_docs(spark, folder), config, headers=["## ", "Th", "## src1"])


@register(
    "c11_media_context",
    f"""
WITH l AS (SELECT doc_id, list_transform({q.kept(q.windows('text', 400, 0))}, lambda x, i:
             CASE i % 4 WHEN 2 THEN x || chr(10) || '| a | b |' WHEN 3 THEN '![pic](p.png) ' || x ELSE x END) AS l FROM documents),
e AS (SELECT doc_id, l, unnest(range(0, len(l))) AS index FROM l),
c AS (SELECT doc_id, index, l[index + 1] AS t, CASE WHEN index > 0 THEN l[index] END AS b, l[index + 2] AS a,
             CASE (index + 1) % 4 WHEN 2 THEN 30 WHEN 3 THEN 20 ELSE 0 END AS n FROM e)
SELECT doc_id, index, CASE WHEN n = 0 THEN t ELSE
   coalesce({q.strip("right(b, n)")} || chr(10) || chr(10), '') || t || coalesce(chr(10) || chr(10) || {q.strip("left(a, n)")}, '') END AS chunk
FROM c
""",
)
def c11(spark, folder):
    """Every fourth chunk gets a table row and the one after it an image."""
    plain = ck.fixed_size_chunks(F.col("text"), 400, 0)
    media = F.transform(
        plain,
        lambda x, i: F.when(i % 4 == 1, F.concat(x, F.lit("\n| a | b |"))).when(
            i % 4 == 2, F.concat(F.lit("![pic](p.png) "), x)
        ).otherwise(x),
    )
    rows = docs(spark, folder).withColumn("media", media).select("doc_id", "media")
    return ck.explode_chunks(rows, ck.attach_media_context(F.col("media"), 30, 20), "media")


@register(
    "c12_chunk_stats",
    f"""
SELECT doc_id, count(*) AS chunks, avg(length(chunk)) AS mean_length
FROM ({q.explode("documents", "doc_id", q.kept(q.windows("text", 1000, 200)))}) GROUP BY doc_id
""",
)
def c12(spark, folder):
    return ck.chunk_stats(c2(spark, folder), ["doc_id"])


# Elements of a page: its tags; the "page number" is the position of the tag in the page, in blocks of five.
ELEMENTS = """
SELECT page_id, unnest(range(0, len(l))) AS position, unnest(l) AS kind
FROM (SELECT page_id, regexp_extract_all(html, '<(h1|p|li|div|article|b|a)\\b', 1) AS l FROM pages)
"""


def elements(spark, folder):
    tags = F.regexp_extract_all("html", F.lit(r"<(h1|p|li|div|article|b|a)\b"), F.lit(1))
    rows = load_table(spark, folder, "pages").select("page_id", F.posexplode(tags).alias("position", "kind"))
    return rows.withColumn("page_number", F.floor(F.col("position") / 5).cast("int")).withColumn(
        "has_image", F.col("kind").isin("div", "article")
    )


@register(
    "c14_latest_parse_page",
    f"""
WITH p AS (SELECT doc_id, quality, toxic FROM labels),
v AS (SELECT source AS collection, lang, max(doc_id) AS doc_id FROM documents GROUP BY source, lang),
r AS (SELECT v.collection, v.lang, v.doc_id, unnest(range(0, len(l))) AS position, unnest(l) AS text FROM v
      JOIN (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents) d ON v.doc_id = d.doc_id)
SELECT *, count(*) OVER () AS total FROM r ORDER BY collection, lang, position LIMIT 50 OFFSET 100
""",
)
def c14(spark, folder):
    """Each source and language is a document whose parses are its texts; the third page of 50 lines of the newest parse."""
    parses = load_table(spark, folder, "documents").select(
        F.col("source").alias("collection"), "lang", "doc_id", "text"
    )
    latest = ck.latest_parse(parses, ["collection", "lang"], ["doc_id"])
    lines = latest.select("collection", "lang", "doc_id", F.posexplode(F.split("text", "\n")).alias("position", "text"))
    return page(lines, [F.col("collection"), F.col("lang"), F.col("position")], 3, 50)


@register(
    "c15_filter_elements",
    f"SELECT page_id, position, kind FROM ({ELEMENTS}) WHERE kind IN ('div', 'p') AND position // 5 IN (1, 2) AND kind = 'div'",
)
def c15(spark, folder):
    return ck.filter_elements(elements(spark, folder), ["div", "p"], [1, 2], True).select("page_id", "position", "kind")


@register(
    "c16_element_summary",
    f"""
SELECT page_id, count(*) AS elements, count(*) FILTER (kind IN ('div', 'article')) AS with_image,
       count(DISTINCT position // 5) AS pages, count(DISTINCT kind) AS kinds FROM ({ELEMENTS}) GROUP BY page_id
""",
)
def c16(spark, folder):
    return ck.element_summary(elements(spark, folder), ["page_id"])


@register("c16_element_counts", f"SELECT page_id, kind, count(*) AS elements FROM ({ELEMENTS}) GROUP BY page_id, kind")
def c16_counts(spark, folder):
    return ck.element_counts(elements(spark, folder), ["page_id"], "kind")

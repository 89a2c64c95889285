"""Registration, ids and hashes."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillstack.operators import identity as ids
from quillstack.operators.upsert import pending_counts
from quillstack.registry import register
from quillstack.session import load_table




SANITIZE = """
CASE WHEN {x} = '' THEN substring(sha256({x}), 1, 8)
     WHEN regexp_replace({x}, '[^A-Za-z0-9-]+', '', 'g') = '' THEN substring(sha256({x}), 1, 16)
     ELSE regexp_replace(substring(trim(regexp_replace({x}, '[^A-Za-z0-9-]+', '_', 'g'), '_'), 1, {n}), '_+$', '') END
"""


def sanitize_sql(expr, n=64):
    return SANITIZE.format(x=expr, n=n)


PAGE_PATH = "regexp_extract(url, '[^/]*$')"
DOC_ID_SQL = (
    sanitize_sql(f"regexp_replace({PAGE_PATH}, '(.)\\.[^.]+$', '\\1')", 50)
    + " || '_' || substring(sha256('web|' || url), 1, 8)"
)


def page_docs(spark, folder):
    return load_table(spark, folder, "pages").select(
        F.lit("web").alias("collection"),
        F.col("url").alias("source_path"),
        F.col("html").alias("content"),
        F.timestamp_seconds(F.lit(1_700_000_000) + F.col("page_id")).alias("uploaded_at"),
    )


@register(
    "h1_register_documents",
    f"""
WITH p AS (SELECT page_id, url, html, {DOC_ID_SQL} AS doc_id FROM pages),
f AS (SELECT doc_id, arg_max(html, page_id) AS html FROM p GROUP BY doc_id),
k AS (SELECT doc_id, arg_max(html, page_id) AS html FROM p WHERE page_id % 2 = 0 GROUP BY doc_id),
o AS (SELECT doc_id, sha256(CASE WHEN doc_id < 'm' THEN html ELSE html || ' ' END) AS h FROM k)
SELECT f.doc_id, sha256(f.html) AS content_hash, o.doc_id IS NULL AS created,
       coalesce(o.h <> sha256(f.html), true) AS changed
FROM f LEFT JOIN o ON f.doc_id = o.doc_id
""",
)
def h1(spark, folder):
    """Every second page is known already; the known text of the ids from 'm' on differs by a blank."""
    incoming = page_docs(spark, folder)
    old = incoming.filter((F.unix_timestamp("uploaded_at") - 1_700_000_000) % 2 == 0)
    old = old.withColumn("doc_id", ids.document_id(F.col("collection"), F.col("source_path")))
    newest = ids.newest_per_key(old, ["collection", "doc_id"], ["uploaded_at"])
    known = newest.select(
        "collection", "doc_id", "source_path",
        ids.content_hash(F.when(F.col("doc_id") < "m", F.col("content")).otherwise(F.concat("content", F.lit(" "))))
        .alias("content_hash"),
        "uploaded_at",
    )
    _, report = ids.register_documents(known, incoming)
    return report.drop("collection")


@register("h1_registered_table", f"""
WITH p AS (SELECT page_id, url, html, {DOC_ID_SQL} AS doc_id FROM pages)
SELECT doc_id, 'web' AS collection, arg_max(url, page_id) AS source_path, sha256(arg_max(html, page_id)) AS content_hash,
       1700000000 + max(page_id) AS uploaded_s
FROM p GROUP BY doc_id
""")
def h1_table(spark, folder):
    """The documents table after registering all pages over a table that knew a third of them."""
    incoming = page_docs(spark, folder)
    none = incoming.limit(0).withColumn("doc_id", F.lit("")).withColumn("content_hash", F.lit("")).drop("content")
    third = incoming.filter(F.unix_timestamp("uploaded_at") % 3 == 0)
    first, _ = ids.register_documents(none, third)
    table, _ = ids.register_documents(first, incoming)
    return table.select(
        "doc_id", "collection", "source_path", "content_hash", F.unix_timestamp("uploaded_at").alias("uploaded_s")
    )


@register("h2_document_id", f"SELECT page_id, {DOC_ID_SQL} AS doc_id FROM pages")
def h2(spark, folder):
    pages = load_table(spark, folder, "pages")
    return pages.select("page_id", ids.document_id(F.lit("web"), F.col("url")).alias("doc_id"))


@register(
    "h3_sanitize_id",
    f"SELECT page_id, {sanitize_sql('url')} AS id64, {sanitize_sql(PAGE_PATH, 20)} AS id20 FROM pages",
)
def h3(spark, folder):
    last = F.regexp_extract("url", r"[^/]*\z", 0)
    return load_table(spark, folder, "pages").select(
        "page_id", ids.sanitize_id(F.col("url")).alias("id64"), ids.sanitize_id(last, 20).alias("id20")
    )


@register("h4_content_hash", "SELECT doc_id, sha256(text) AS sha256, md5(text) AS md5, sha1(text) AS sha1 FROM documents")
def h4(spark, folder):
    return load_table(spark, folder, "documents").select(
        "doc_id", *[ids.content_hash(F.col("text"), a).alias(a) for a in ("sha256", "md5", "sha1")]
    )


ASCII_TEXT = "regexp_replace(text, '[^\\x20-\\x7e\\n\"\\\\]', '?', 'g')"
ESCAPED = f"replace(replace(replace({ASCII_TEXT}, chr(92), chr(92) || chr(92)), '\"', chr(92) || '\"'), chr(10), chr(92) || 'n')"


@register(
    "h5_config_hash",
    f"""
SELECT doc_id,
  sha256('{{"params":{{"extract_images":true}},"parse_method":"pymupdf"}}') AS parse_hash,
  sha256('{{"chunk_params":{{"chunk_overlap":200,"chunk_size":1000}},"text":"' || {ESCAPED} || '"}}') AS chunk_hash,
  sha256('{{"embed_params":{{}},"model":"model-' || lang || '","text":"' || {ESCAPED} || '"}}') AS embed_hash
FROM documents
""",
)
def h5(spark, folder):
    """The oracle cannot write \\uXXXX escapes, so accents are replaced on both sides; tests cover the escapes."""
    text = F.regexp_replace("text", r'[^\x20-\x7e\n"\\]', "?")
    return load_table(spark, folder, "documents").select(
        "doc_id",
        F.lit(ids.parse_hash("pymupdf", {"extract_images": True, "dpi": 300})).alias("parse_hash"),
        ids.chunk_hash(text, {"chunk_size": 1000, "chunk_overlap": 200, "note": "x"}).alias("chunk_hash"),
        ids.embed_hash(text, F.concat(F.lit("model-"), "lang")).alias("embed_hash"),
    )


@register(
    "h6_is_hash",
    """
SELECT doc_id, regexp_matches(h, '^[0-9a-fA-F]+$') AND length(h) = 64 AS valid
FROM (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN sha256(text) WHEN 1 THEN md5(text) WHEN 2 THEN substring(text, 1, 64)
      ELSE upper(sha256(text)) END AS h FROM documents)
""",
)
def h6(spark, folder):
    case = F.col("doc_id") % 4
    text = F.col("text")
    value = (
        F.when(case == 0, F.sha2(text, 256)).when(case == 1, F.md5(text)).when(case == 2, F.substring(text, 1, 64))
        .otherwise(F.upper(F.sha2(text, 256)))
    )
    return load_table(spark, folder, "documents").select("doc_id", ids.is_hash(value).alias("valid"))


@register(
    "h7_model_tag",
    """
WITH m AS (SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN p_name ELSE p_type || ' / ' || p_name || ' #' || p_brand END AS m
           FROM part),
s AS (SELECT p_partkey, m, trim(regexp_replace(lower(trim(CASE WHEN contains(m, '/') THEN split_part(m, '/', 2) ELSE m END)),
             '[^a-z0-9]+', '_', 'g'), '_') AS slug FROM m)
SELECT p_partkey, m AS model, CASE WHEN contains(m, '/') THEN upper(trim(split_part(m, '/', 1))) || '_' || slug ELSE slug END AS tag
FROM s
""",
)
def h7(spark, folder):
    model = F.when(F.col("p_size") % 3 == 0, F.col("p_name")).otherwise(
        F.concat("p_type", F.lit(" / "), "p_name", F.lit(" #"), "p_brand")
    )
    return load_table(spark, folder, "part").select("p_partkey", model.alias("model"), ids.model_tag(model).alias("tag"))


def chunk_rows(spark, folder):
    return load_table(spark, folder, "documents").select(
        F.col("source").alias("collection"), "doc_id", F.lit("p").alias("parse_hash"),
        F.col("doc_id").cast("string").alias("chunk_id"), "lang",
    )


@register(
    "h8_pending_chunks",
    """
SELECT source AS collection, doc_id, lang FROM documents
WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)
""",
)
def h8(spark, folder):
    """Chunks without an embedding of model q1; documents with quality 1 have one."""
    chunks = chunk_rows(spark, folder)
    done = chunks.join(load_table(spark, folder, "labels"), "doc_id").withColumn(
        "model_tag", F.concat(F.lit("q"), F.col("quality").cast("string"))
    )
    return ids.pending_chunks(chunks, done, "q1").select("collection", "doc_id", "lang")


@register(
    "h8_pending_counts",
    """
SELECT source AS collection, count(*) AS total, count(*) FILTER (l.doc_id IS NULL) AS pending
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY source
""",
)
def h8_counts(spark, folder):
    return pending_counts(chunk_rows(spark, folder), load_table(spark, folder, "labels"), ["doc_id"], ["collection"])


@register(
    "h9_new_configurations",
    """
SELECT d.doc_id, 'parse-' || d.lang AS parse_hash, 'config-' || (d.doc_id % 2) AS config_hash FROM documents d
LEFT JOIN labels l ON d.doc_id = l.doc_id AND d.doc_id % 2 = l.quality WHERE l.doc_id IS NULL
""",
)
def h9(spark, folder):
    docs = load_table(spark, folder, "documents").select("doc_id", F.concat(F.lit("parse-"), "lang").alias("parse_hash"))
    todo = docs.withColumn("config_hash", F.concat(F.lit("config-"), (F.col("doc_id") % 2).cast("string")))
    done = docs.join(load_table(spark, folder, "labels"), "doc_id").withColumn(
        "config_hash", F.concat(F.lit("config-"), F.col("quality").cast("string"))
    )
    return ids.new_configurations(todo, done)


@register(
    "h10_list_documents",
    "SELECT doc_id, lang, n_chars FROM documents WHERE source = 'src1' ORDER BY doc_id LIMIT 20",
)
def h10(spark, folder):
    docs = load_table(spark, folder, "documents").withColumnRenamed("source", "collection")
    return ids.list_documents(docs, "src1", 20).select("doc_id", "lang", "n_chars")


@register("h10_get_document", "SELECT doc_id, lang, text FROM documents WHERE source = 'src1' AND doc_id = "
          "(SELECT min(doc_id) FROM documents WHERE source = 'src1')")
def h10_get(spark, folder):
    docs = load_table(spark, folder, "documents").withColumnRenamed("source", "collection")
    first = docs.filter(F.col("collection") == "src1").agg(F.min("doc_id")).scalar()
    return ids.get_document(docs, "src1", first).select("doc_id", "lang", "text")


@register(
    "h11_name_violations",
    """
SELECT 'url' AS kind, page_id AS id, 'invalid characters' AS reason FROM pages WHERE NOT regexp_matches(url, '^[a-zA-Z0-9_.-]+$')
UNION ALL
SELECT 'part', p_partkey, 'invalid characters' FROM (SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN replace(p_name, ' ', '_')
  ELSE p_name END AS n FROM part) WHERE NOT regexp_matches(n, '^[a-zA-Z0-9_-]+$')
""",
)
def h11(spark, folder):
    pages = ids.name_violations(load_table(spark, folder, "pages"), "url")
    name = F.when(F.col("p_size") % 2 == 0, F.replace("p_name", F.lit(" "), F.lit("_"))).otherwise(F.col("p_name"))
    parts = ids.name_violations(
        load_table(spark, folder, "part").withColumn("n", name), "n", ids.COLLECTION_NAME
    )
    return pages.select(F.lit("url").alias("kind"), F.col("page_id").alias("id"), "reason").unionByName(
        parts.select(F.lit("part").alias("kind"), F.col("p_partkey").alias("id"), "reason")
    )

"""Text search, fusion, re-ranking and context building."""

from __future__ import annotations

import re

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillstack.operators import fusion
from quillstack.operators import textindex as tix
from quillstack.operators import textsearch as ts
from quillstack.operators import vector as vec
from quillstack.plans import search as plans
from quillstack.registry import register
from quillstack.registry import sqltext as q
from quillstack.registry.vectors import L2, query_vector
from quillstack.session import load_table, shared_dir, spread


def documents(spark, folder):
    return spread(load_table(spark, folder, "documents"), "doc_id")


def query_text(spark, folder, item=0):
    """The request's text: one benchmark row."""
    return load_table(spark, folder, "benchmark").filter(F.col("item_id") == item).first()["text"]


def corpus(spark, folder):
    """Documents with their vectors as one-chunk rows; owner is doc_id modulo 3, 0 has no owner."""
    vectors = load_table(spark, folder, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))
    return (
        documents(spark, folder).join(vectors, "doc_id", "left")
        .select(
            F.col("source").alias("collection"), "doc_id", F.lit(0).alias("chunk_id"), "text", "vector", "lang",
            F.when(F.col("doc_id") % 3 != 0, F.col("doc_id") % 3).alias("user_id"),
        )
    )


WORDS = q.words("text")


def bm25_sql(source="documents", item=0):
    """Common table expressions ending in ``bm(doc_id, bm25)``."""
    return f"""
qt AS (SELECT DISTINCT unnest({WORDS}) AS term FROM benchmark WHERE item_id = {item}),
src AS (SELECT doc_id, text, {WORDS} AS w FROM {source}),
tot AS (SELECT count(*) AS n, avg(len(w)) AS mean_len FROM src),
tok AS (SELECT doc_id, len(w) AS dl, unnest(w) AS term FROM src),
tf AS (SELECT doc_id, dl, term, count(*) AS tf FROM tok WHERE term IN (SELECT term FROM qt) GROUP BY doc_id, dl, term),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
bm AS (SELECT doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / mean_len))), 9) AS bm25
       FROM tf JOIN df USING (term) CROSS JOIN tot GROUP BY doc_id)"""


def dense_sql(k, source="documents"):
    return f"""
dn AS (SELECT doc_id, 1 / (1 + d) AS score, row_number() OVER (ORDER BY d, doc_id) AS rank FROM (
   SELECT s.doc_id, {L2} AS d FROM {source} s JOIN embeddings e ON s.doc_id = e.vec_id,
     (SELECT embedding FROM embeddings WHERE vec_id = 0) q) ORDER BY d, doc_id LIMIT {k})"""


def sparse_sql(k):
    return f"""
sp AS (SELECT doc_id, bm25 / (1 + bm25) AS score, row_number() OVER (ORDER BY bm25 DESC, doc_id) AS rank
       FROM bm ORDER BY bm25 DESC, doc_id LIMIT {k})"""


MERGED = "mg AS (SELECT doc_id, dn.score AS vs, dn.rank AS vr, sp.score AS fs, sp.rank AS fr FROM dn FULL OUTER JOIN sp USING (doc_id))"
RRF_SCORE = "coalesce(1.0::DOUBLE / (60 + vr), 0) + coalesce(1.0::DOUBLE / (60 + fr), 0)"


@register(
    "f1_postings",
    f"""
SELECT doc_id, term, count(*) AS tf, min(i) AS first_pos, max(i) AS last_pos, max(dl) AS doc_len FROM (
  SELECT doc_id, len(w) AS dl, unnest(w) AS term, unnest(range(0, len(w))) AS i FROM (SELECT doc_id, {WORDS} AS w FROM documents))
GROUP BY doc_id, term
""",
)
def f1(spark, folder):
    rows = ts.postings(documents(spark, folder), ["doc_id"])
    return rows.select(
        "doc_id", "term", "tf", F.array_min("positions").alias("first_pos"), F.array_max("positions").alias("last_pos"), "doc_len"
    )


TEXT_TOP = f"""
WITH {bm25_sql()} SELECT doc_id, round(bm25, 6) AS bm25, round(bm25 / (1 + bm25), 6) AS score FROM bm
ORDER BY bm.bm25 DESC, doc_id LIMIT 20
"""


def text_out(df):
    return df.select("doc_id", F.round("bm25", 6).alias("bm25"), F.round("score", 6).alias("score"))


@register("f1_f2_indexed_text_search", TEXT_TOP)
def f2_index(spark, folder):
    """Build the stored index, then answer the query from the buckets of its terms."""
    index = ts.TextIndex.build(documents(spark, folder), shared_dir(spark, "textindex"), ["doc_id"], buckets=16)
    return text_out(index.search(spark, query_text(spark, folder), 20))


@register(
    "f1_changed_index_search",
    f"""
WITH changed AS (
  SELECT doc_id, CASE WHEN lang = 'fr' THEN text || ' ' || text ELSE text END AS text FROM documents
  WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1) OR lang = 'es'
), {bm25_sql('changed')}
SELECT doc_id, round(bm25, 6) AS bm25, round(bm25 / (1 + bm25), 6) AS score FROM bm ORDER BY bm.bm25 DESC, doc_id LIMIT 20
""",
)
def f1_changed(spark, folder):
    """Texts come in batches, French ones are replaced, toxic ones deleted, all is merged, Spanish ones are written again."""
    docs = documents(spark, folder).select("doc_id", "lang", "text")
    index = tix.LiveTextIndex(spark, shared_dir(spark, "textindex"), ["doc_id"], buckets=16)
    index.upsert(docs.filter("lang IN ('en', 'fr')"))
    index.upsert(docs.filter("lang NOT IN ('en', 'fr')"))
    index.upsert(docs.filter("lang = 'fr'").withColumn("text", F.concat_ws(" ", "text", "text")))
    index.delete(load_table(spark, folder, "labels").filter("toxic = 1"))
    index.merge()
    index.upsert(docs.filter("lang = 'es'"))
    return text_out(index.search(query_text(spark, folder), 20))


@register(
    "f1_phrase_search",
    f"""
WITH ph AS (SELECT {WORDS}[1:2] AS p, (SELECT {WORDS} FROM benchmark WHERE item_id = 0) AS rest FROM documents WHERE doc_id = 0),
src AS (SELECT doc_id, {WORDS} AS w FROM documents),
tot AS (SELECT count(*) AS n, avg(len(w)) AS mean_len FROM src),
ptf AS (SELECT doc_id, len(w) AS dl, len(list_filter(range(1, len(w)), lambda i: w[i:i + 1] = p)) AS tf FROM src, ph),
hit AS (SELECT doc_id, dl, '' AS term, tf FROM ptf WHERE tf > 0),
ttf AS (SELECT doc_id, len(w) AS dl, term, len(list_filter(w, lambda x: x = term)) AS tf FROM src, (SELECT DISTINCT unnest(rest) AS term FROM ph)),
every AS (SELECT * FROM hit UNION ALL SELECT * FROM ttf WHERE tf > 0 AND doc_id IN (SELECT doc_id FROM hit)),
df AS (SELECT term, count(*) AS df FROM every GROUP BY term),
bm AS (SELECT doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / mean_len))), 9) AS bm25
       FROM every JOIN df USING (term) CROSS JOIN tot GROUP BY doc_id)
SELECT doc_id, round(bm25, 6) AS bm25, round(bm25 / (1 + bm25), 6) AS score FROM bm ORDER BY bm.bm25 DESC, doc_id LIMIT 20
""",
)
def f1_phrase(spark, folder):
    """The first two words of a document as a phrase, and the words of a benchmark text."""
    docs = documents(spark, folder).select("doc_id", "text")
    words = re.findall(r"[^\W_]+", docs.filter("doc_id = 0").first()["text"])
    index = tix.LiveTextIndex(spark, shared_dir(spark, "textindex"), ["doc_id"], buckets=16)
    index.upsert(docs)
    return text_out(index.search(f'"{" ".join(words[:2])}" {query_text(spark, folder)}', 20))


@register("f2_text_search", TEXT_TOP)
def f2(spark, folder):
    return text_out(ts.bm25_scan(documents(spark, folder), query_text(spark, folder), 20, ["doc_id"]))


@register(
    "f3_substring_fallback",
    "SELECT doc_id, 1.0::DOUBLE AS score FROM documents WHERE contains(text, 'tion') ORDER BY doc_id LIMIT 15",
)
def f3(spark, folder):
    """The parts of words match no term, so the substring scan answers."""
    docs = documents(spark, folder)
    none = ts.bm25_scan(docs, "qqqqtionqqqq", 15, ["doc_id"]).select("doc_id", "score")
    return ts.with_fallback(none, ts.substring_search(docs, "tion", 15, ["doc_id"]).select("doc_id", "score"))


def two_lists(spark, folder, k):
    rows = corpus(spark, folder)
    dense = vec.dense_search(rows, query_vector(spark, folder), k, ["doc_id"]).select("doc_id", "score", "distance")
    sparse = ts.bm25_scan(rows, query_text(spark, folder), k, ["doc_id"]).select("doc_id", "score", "bm25")
    return (
        fusion.with_rank(dense, [F.col("distance"), F.col("doc_id")]),
        fusion.with_rank(sparse, [F.col("bm25").desc(), F.col("doc_id")]),
    )


@register(
    "f4_rrf",
    f"WITH {bm25_sql()}, {dense_sql(40)}, {sparse_sql(40)}, {MERGED} SELECT doc_id, round({RRF_SCORE}, 9) AS score FROM mg",
)
def f4(spark, folder):
    return fusion.rrf_many(list(two_lists(spark, folder, 40)), ["doc_id"]).select("doc_id", F.round("score", 9).alias("score"))


@register(
    "f5_linear_fusion",
    f"""
WITH {bm25_sql()}, {dense_sql(40)}, {sparse_sql(40)},
d2 AS (SELECT doc_id, (score - min(score) OVER ()) / (max(score) OVER () - min(score) OVER ()) AS s FROM dn),
s2 AS (SELECT doc_id, (score - min(score) OVER ()) / (max(score) OVER () - min(score) OVER ()) AS s FROM sp),
m AS (SELECT doc_id, coalesce(d2.s * 0.7, 0) + coalesce(s2.s * 0.3, 0) AS t FROM d2 FULL OUTER JOIN s2 USING (doc_id))
SELECT doc_id, round((t - min(t) OVER ()) / (max(t) OVER () - min(t) OVER ()), 6) AS score FROM m
""",
)
def f5(spark, folder):
    dense, sparse = two_lists(spark, folder, 40)
    return fusion.linear(dense, sparse, ["doc_id"], 0.7, 0.3).select("doc_id", F.round("score", 6).alias("score"))


@register(
    "f6_hybrid",
    f"""
WITH {bm25_sql()}, {dense_sql(20)}, {sparse_sql(20)}, {MERGED}
SELECT doc_id, round({RRF_SCORE}, 9) AS score, coalesce(vr, 0) AS vector_rank, coalesce(fr, 0) AS fts_rank,
       round(coalesce(vs, 0), 6) AS vector_score, round(coalesce(fs, 0), 6) AS fts_score FROM mg
ORDER BY {RRF_SCORE} DESC, vr NULLS LAST, fr NULLS LAST, doc_id LIMIT 10
""",
)
def f6(spark, folder):
    found = plans.hybrid_search(
        corpus(spark, folder), query_vector(spark, folder), query_text(spark, folder), plans.SearchConfig(top_k=10)
    )
    zero = F.lit(0)
    return found.select(
        "doc_id", F.round("score", 9).alias("score"),
        F.coalesce("vector_rank", zero).alias("vector_rank"), F.coalesce("fts_rank", zero).alias("fts_rank"),
        F.round(F.coalesce("vector_score", F.lit(0.0)), 6).alias("vector_score"),
        F.round(F.coalesce("fts_score", F.lit(0.0)), 6).alias("fts_score"),
    )


HYBRID_TOP = f"""
hy AS (SELECT doc_id, {RRF_SCORE} AS score, vr, fr, row_number() OVER (ORDER BY {RRF_SCORE} DESC, vr NULLS LAST, fr NULLS LAST, doc_id) AS rank
       FROM mg QUALIFY rank <= 5)"""


@register(
    "f6_hybrid_rrf_contexts",
    f"""
WITH {bm25_sql()}, {dense_sql(10)}, {sparse_sql(10)}, {MERGED}, {HYBRID_TOP}
SELECT string_agg('[' || rank || ']' || chr(10) || text, chr(10) || '---' || chr(10) ORDER BY rank) AS context
FROM hy JOIN documents USING (doc_id)
""",
)
def f6_contexts(spark, folder):
    """The whole flow: two searches, fusion, texts of the best five, numbered contexts."""
    found = plans.search(
        corpus(spark, folder), plans.SearchConfig(top_k=5), query_vector(spark, folder), query_text(spark, folder), is_admin=True
    )
    return fusion.format_contexts(found, [F.col("rank")], 5)


@register(
    "f7_rerank_by_texts",
    f"""
WITH {bm25_sql()}, {sparse_sql(100)}, t AS (SELECT rank, doc_id, text FROM sp JOIN documents USING (doc_id)),
o AS (SELECT text, rank AS r, row_number() OVER (ORDER BY rank DESC) AS new_rank FROM t WHERE rank % 2 = 0),
a AS (SELECT *, row_number() OVER (PARTITION BY text ORDER BY rank) AS n, min(rank) OVER (PARTITION BY text) AS f FROM t),
b AS (SELECT *, row_number() OVER (PARTITION BY text ORDER BY new_rank) AS n FROM o)
SELECT a.doc_id, a.rank, row_number() OVER (ORDER BY b.new_rank NULLS LAST, a.f, a.rank) AS final_rank
FROM a LEFT JOIN b ON a.text = b.text AND a.n = b.n
""",
)
def f7(spark, folder):
    """The 100 best of a text search, whole texts with copies among them; the outside ranking names every second in reverse."""
    _, hits = two_lists(spark, folder, 100)
    results = hits.select("doc_id", "rank").join(documents(spark, folder).select("doc_id", "text"), "doc_id")
    named = results.filter(F.col("rank") % 2 == 0)
    reranked = fusion.with_rank(named, [F.col("rank").desc()], "new_rank").select("text", "new_rank")
    return fusion.rerank_by_texts(results, reranked).select("doc_id", "rank", "final_rank")


@register(
    "f8_rrf_rerank",
    f"""
WITH {bm25_sql()}, {dense_sql(40)}, {sparse_sql(40)}, {MERGED},
top AS (SELECT * FROM mg ORDER BY coalesce(vs, 0) * 0.5 + coalesce(fs, 0) * 0.5 DESC, doc_id LIMIT 12),
n AS (SELECT doc_id, CASE WHEN vr IS NOT NULL THEN row_number() OVER (ORDER BY vr NULLS LAST, doc_id) END AS v,
             CASE WHEN fr IS NOT NULL THEN row_number() OVER (ORDER BY fr NULLS LAST, doc_id) END AS f FROM top)
SELECT doc_id, round(coalesce(1.0::DOUBLE / (60 + v), 0) + coalesce(1.0::DOUBLE / (60 + f), 0), 9) AS score FROM n
""",
)
def f8(spark, folder):
    """The best twelve by mean raw score, re-ranked by the ranks they carry."""
    dense, sparse = two_lists(spark, folder, 40)
    merged = fusion.merge_lists(dense, sparse, ["doc_id"])
    mean = F.coalesce("vector_score", F.lit(0.0)) * 0.5 + F.coalesce("fts_score", F.lit(0.0)) * 0.5
    top = merged.withColumn("score", mean).orderBy(F.col("score").desc(), "doc_id").limit(12)
    return fusion.rrf_rerank(top, ["doc_id"]).select("doc_id", F.round("score", 9).alias("score"))


@register(
    "f9_search_documents",
    f"""
WITH mine AS (SELECT doc_id, text FROM documents WHERE doc_id % 3 = 1 AND lang = 'en'),
{bm25_sql('mine')}, {dense_sql(16, 'mine')}, {sparse_sql(16)}, {MERGED},
f AS (SELECT *, {RRF_SCORE} AS s FROM mg ORDER BY s DESC, vr NULLS LAST, fr NULLS LAST, doc_id LIMIT 8),
n AS (SELECT *, CASE WHEN vr IS NOT NULL THEN row_number() OVER (ORDER BY vr NULLS LAST, doc_id) END AS v,
             CASE WHEN fr IS NOT NULL THEN row_number() OVER (ORDER BY fr NULLS LAST, doc_id) END AS g FROM f),
t AS (SELECT doc_id, vr, fr, coalesce(1.0::DOUBLE / (60 + v), 0) + coalesce(1.0::DOUBLE / (60 + g), 0) AS score FROM n)
SELECT doc_id, round(score, 9) AS score, row_number() OVER (ORDER BY t.score DESC, vr NULLS LAST, fr NULLS LAST, doc_id) AS rank, source AS collection
FROM t JOIN documents USING (doc_id) QUALIFY rank <= 5
""",
)
def f9(spark, folder):
    """User 1 searches the English documents: five results out of eight fetched and re-ranked."""
    config = plans.SearchConfig(top_k=5, rerank=True, rerank_top_k=8, filters={"lang": "en"})
    found = plans.search(corpus(spark, folder), config, query_vector(spark, folder), query_text(spark, folder), user_id=1)
    return found.select("doc_id", F.round("score", 9).alias("score"), "rank", "collection")


@register(
    "f10_search_collections",
    f"""
SELECT collection, doc_id, rank, round(score, 6) AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY collection ORDER BY d, doc_id) AS rank FROM (
    SELECT s.source AS collection, s.doc_id, {L2} AS d, 1 / (1 + {L2}) AS score
    FROM documents s JOIN embeddings e ON s.doc_id = e.vec_id, (SELECT embedding FROM embeddings WHERE vec_id = 0) q
    WHERE s.doc_id % 3 = 2) WHERE score >= 0.32) WHERE rank <= 3
""",
)
def f10(spark, folder):
    """User 2 searches every collection at once: the best three of each above the score limit."""
    rows = corpus(spark, folder).filter("vector IS NOT NULL")
    found = plans.search_collections(rows, None, query_vector(spark, folder), 3, 0.32, user_id=2)
    return found.select("collection", "doc_id", "rank", F.round("score", 6).alias("score"))


@register(
    "f9_outside_rerank",
    f"""
WITH {bm25_sql()}, {sparse_sql(12)}, t AS (SELECT sp.rank, sp.score, doc_id, text FROM sp JOIN documents USING (doc_id)),
o AS (SELECT *, row_number() OVER (ORDER BY length(text), text, rank) AS new_rank FROM t)
SELECT doc_id, round(score, 6) AS score, new_rank AS rank, 'no query vector: dense search fell back to text search' AS warning FROM o WHERE new_rank <= 6
""",
)
def f9_outside(spark, folder):
    """A dense search without a vector becomes a text search; an outside model puts shorter texts first."""
    def shorter_first(results):
        order = W.partitionBy(F.lit(0)).orderBy(F.length("text"), "text", "rank")
        return results.withColumn("new_rank", F.row_number().over(order)).select("text", "new_rank")

    config = plans.SearchConfig(kind="dense", top_k=6, rerank=True, rerank_top_k=12)
    rows = corpus(spark, folder)
    found, warnings = plans.search_with_warnings(rows, config, None, query_text(spark, folder), is_admin=True, reranker=shorter_first)
    return found.select("doc_id", F.round("score", 6).alias("score"), "rank", F.lit("; ".join(warnings)).alias("warning"))


@register(
    "f10_hybrid_collections",
    f"""
WITH qt AS (SELECT DISTINCT unnest({WORDS}) AS term FROM benchmark WHERE item_id = 0),
src AS (SELECT source AS collection, doc_id, {WORDS} AS w FROM documents WHERE doc_id % 3 = 2 AND source IN ('src0', 'src2', 'src3')),
tot AS (SELECT collection, count(*) AS n, avg(len(w)) AS mean_len FROM src GROUP BY collection),
tf AS (SELECT collection, doc_id, dl, term, count(*) AS tf FROM (SELECT collection, doc_id, len(w) AS dl, unnest(w) AS term FROM src)
       WHERE term IN (SELECT term FROM qt) GROUP BY ALL),
df AS (SELECT collection, term, count(*) AS df FROM tf GROUP BY ALL),
bm AS (SELECT collection, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / mean_len))), 9) AS bm25
       FROM tf JOIN df USING (collection, term) JOIN tot USING (collection) GROUP BY collection, doc_id),
sp AS (SELECT collection, doc_id, row_number() OVER (PARTITION BY collection ORDER BY bm25 DESC, doc_id) AS fr FROM bm QUALIFY fr <= 8),
dn AS (SELECT s.collection, s.doc_id, row_number() OVER (PARTITION BY s.collection ORDER BY {L2}, s.doc_id) AS vr
       FROM src s JOIN embeddings e ON s.doc_id = e.vec_id, (SELECT embedding FROM embeddings WHERE vec_id = 0) q QUALIFY vr <= 8),
mg AS (SELECT collection, doc_id, vr, fr, {RRF_SCORE} AS score FROM dn FULL OUTER JOIN sp USING (collection, doc_id))
SELECT collection, doc_id, round(score, 9) AS score, row_number() OVER (PARTITION BY collection ORDER BY mg.score DESC, vr NULLS LAST, fr NULLS LAST, doc_id) AS rank,
       'none: missing, src1: not allowed' AS left_out FROM mg QUALIFY rank <= 4
""",
)
def f10_hybrid(spark, folder):
    """Five collections are requested; one is not allowed, one does not exist, the others are searched both ways."""
    config = plans.SearchConfig(top_k=4)
    found, problems = plans.search_knowledge(
        corpus(spark, folder), ["src0", "src1", "src2", "src3", "none"], ["src0", "src2", "src3", "none"], config, query_vector(spark, folder),
        query_text(spark, folder), user_id=2,
    )
    left_out = ", ".join(f"{c}: {reason}" for c, reason in problems)
    return found.select("collection", "doc_id", F.round("score", 9).alias("score"), "rank", F.lit(left_out).alias("left_out"))


@register(
    "f10_collection_checks",
    """
WITH req AS (SELECT DISTINCT source AS collection FROM documents UNION SELECT lang FROM documents),
allowed AS (SELECT source AS collection FROM documents WHERE source <> 'src1' UNION SELECT lang FROM documents WHERE lang <> 'de'),
existing AS (SELECT source AS collection FROM documents d JOIN labels l ON d.doc_id = l.doc_id)
SELECT collection, CASE WHEN collection NOT IN (SELECT collection FROM allowed) THEN 'not allowed' ELSE 'missing' END AS reason
FROM req WHERE collection NOT IN (SELECT collection FROM allowed) OR collection NOT IN (SELECT collection FROM existing)
""",
)
def f10_checks(spark, folder):
    """Sources and languages are requested; one of each is not allowed, languages do not exist as collections."""
    docs = documents(spark, folder)
    sources, langs = docs.select(F.col("source").alias("collection")), docs.select(F.col("lang").alias("collection"))
    requested = sources.union(langs).distinct()
    allowed = sources.filter("collection <> 'src1'").union(langs.filter("collection <> 'de'")).distinct()
    existing = docs.join(load_table(spark, folder, "labels"), "doc_id", "left_semi").select(F.col("source").alias("collection"))
    return plans.check_collections(requested, allowed, existing.distinct())


TOP_TEXT = f"""
WITH {bm25_sql()}, t AS (SELECT doc_id, bm25 / (1 + bm25) AS score, row_number() OVER (ORDER BY bm25 DESC, doc_id) AS rank FROM bm
  QUALIFY rank <= 4), c AS (SELECT rank, score, d.* FROM t JOIN documents d USING (doc_id))
"""


def top_text(spark, folder):
    rows = corpus(spark, folder).drop("vector")
    found = ts.bm25_scan(rows, query_text(spark, folder), 4, ["doc_id"])
    ranked = fusion.with_rank(found, [F.col("bm25").desc(), F.col("doc_id")])
    return rows.join(F.broadcast(ranked), "doc_id")


CONTEXT_ITEM = """'[' || rank || ']' || chr(10) || 'Document ID: ' || doc_id || ', Chunk ID: 0, Score: ' || printf('%.4f', score)
       || chr(10) || text"""


@register(
    "f11_contexts_with_metadata",
    TOP_TEXT + f"SELECT string_agg({CONTEXT_ITEM}, chr(10) || '---' || chr(10) ORDER BY rank) AS context FROM c",
)
def f11(spark, folder):
    found = top_text(spark, folder)
    line = fusion.metadata_line(F.col("doc_id"), F.col("chunk_id"), F.col("score"))
    return fusion.format_contexts(found, [F.col("rank")], 4, metadata=line)


@register(
    "f12_prompt",
    TOP_TEXT + f"""SELECT 'Answer briefly.' || chr(10) || chr(10) || 'Context:' || chr(10) ||
 string_agg('[' || rank || ']' || chr(10) || text, chr(10) || '---' || chr(10) ORDER BY rank) || chr(10) || chr(10) || 'Answer:' AS prompt FROM c""",
)
def f12(spark, folder):
    contexts = fusion.format_contexts(top_text(spark, folder), [F.col("rank")], 4)
    return fusion.generation_prompt(contexts, "Answer briefly.").select("prompt")


@register(
    "f13_result_summary",
    TOP_TEXT + """SELECT 'Search Results for Query: ''topic''' || chr(10) || 'Found ' || count(*) || ' relevant results from ' ||
   (SELECT count(*) FROM documents) || ' documents' || chr(10) ||
   string_agg(chr(10) || '## Result ' || rank || ' (Collection: ' || source || ', Score: ' || printf('%.4f', score) || ')' || chr(10)
     || 'Document: ' || lang || '.txt' || chr(10) || text || chr(10) || '_Metadata: doc: ' || doc_id || ', chunk: 0_', '' ORDER BY rank) AS summary
FROM c""",
)
def f13(spark, folder):
    found = top_text(spark, folder).withColumn(
        "source_path", F.concat(F.lit("/data/"), "collection", F.lit("/"), "lang", F.lit(".txt"))
    )
    return fusion.result_summary(found, [F.col("rank")], "topic", documents(spark, folder).count())

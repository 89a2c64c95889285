"""Embedding and vector search."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillstack.operators import vector as vec
from quillstack.operators import vectorindex as vix
from quillstack.operators.upsert import delete_keys
from quillstack.registry import register
from quillstack.session import load_table, shared_dir


def vectors(spark, folder):
    return load_table(spark, folder, "embeddings").withColumnRenamed("embedding", "vector")


def query_vector(spark, folder, vec_id=0):
    """The request's vector: one row."""
    return vectors(spark, folder).filter(F.col("vec_id") == vec_id).first()["vector"]


L2 = "list_sum(list_transform(list_zip(e.embedding, q.embedding), lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) * (p[1]::DOUBLE - p[2]::DOUBLE)))"
DOT = "list_sum(list_transform(list_zip({a}, {b}), lambda p: p[1]::DOUBLE * p[2]::DOUBLE))"
FROM_Q = "FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q"


def out(df, *extra):
    return df.select("vec_id", *extra, F.round("distance", 6).alias("distance"), F.round("score", 6).alias("score"))


@register("d1_hashed_embedding")
def d1(spark, folder):
    """Every document embedded by hashed terms, in batches of rows; per language how many could be embedded."""
    docs = load_table(spark, folder, "documents").select("doc_id", "lang", "text")
    return vec.embedding_report(vec.hashed_embedding(docs, "text", 64), ["lang"])


def letter_model():
    """A stand-in model: share of each letter a-z; texts without any are failures."""
    import numpy as np

    def predict(texts):
        rows = []
        for text in texts:
            lowered = text.lower()
            counts = np.array([lowered.count(chr(c)) for c in range(97, 123)], dtype=np.float32)
            rows.append(counts / counts.sum() if counts.sum() else np.full(26, np.nan, dtype=np.float32))
        return np.stack(rows)

    return predict


@register(
    "d1_model_embedding",
    """
SELECT lang, count(*) AS total, count(*) FILTER (regexp_matches(lower(text), '[a-z]')) AS embedded,
       count(*) FILTER (NOT regexp_matches(lower(text), '[a-z]')) AS failed FROM documents GROUP BY lang
""",
)
def d1_model(spark, folder):
    """Every document through a pluggable batch model; failures are counted, not raised."""
    docs = load_table(spark, folder, "documents").select("doc_id", "lang", "text")
    return vec.embedding_report(vec.model_embedding(docs, "text", letter_model), ["lang"])


BROKEN = """
SELECT vec_id, label, CASE WHEN vec_id % 7 = 0 THEN list_concat(['NaN'::FLOAT], embedding[2:])
  WHEN vec_id % 11 = 0 THEN embedding[1:32] WHEN vec_id % 13 = 0 THEN list_concat(['Infinity'::FLOAT], embedding[2:])
  ELSE embedding END AS v FROM embeddings
"""


def broken(spark, folder):
    v, i = F.col("vector"), F.col("vec_id")
    tail = F.slice(v, 2, 10_000)
    bad = (
        F.when(i % 7 == 0, F.concat(F.array(F.lit(float("nan")).cast("float")), tail))
        .when(i % 11 == 0, F.slice(v, 1, 32))
        .when(i % 13 == 0, F.concat(F.array(F.lit(float("inf")).cast("float")), tail))
        .otherwise(v)
    )
    return vectors(spark, folder).withColumn("vector", bad)


@register(
    "d3_invalid_vectors",
    f"""
SELECT vec_id, CASE WHEN len(v) <> 64 THEN 'dimension' ELSE 'not finite' END AS problem FROM ({BROKEN})
WHERE len(v) <> 64 OR len(list_filter(v, lambda x: isnan(x) OR isinf(x))) > 0
""",
)
def d3(spark, folder):
    _, bad = vec.split_valid(broken(spark, folder), 64)
    return bad.select("vec_id", "problem")


@register(
    "d4_stored_dimensions",
    f"""
SELECT 'model-' || label AS model, min(len(v)) AS min_dim, max(len(v)) AS max_dim, count(*) AS vectors,
       min(len(v)) = max(len(v)) AS consistent FROM ({BROKEN}) GROUP BY label
""",
)
def d4(spark, folder):
    rows = broken(spark, folder).withColumn("model", F.concat(F.lit("model-"), F.col("label").cast("string")))
    return vec.stored_dimensions(rows)


@register(
    "d5_dense_top_k",
    f"SELECT vec_id, label, round(d, 6) AS distance, round(1 / (1 + d), 6) AS score FROM "
    f"(SELECT vec_id, label, {L2} AS d {FROM_Q}) ORDER BY d, vec_id LIMIT 10",
)
def d5(spark, folder):
    return out(vec.dense_search(vectors(spark, folder), query_vector(spark, folder), 10, ["vec_id"]), "label")


CENTROIDS = """
c AS (SELECT label, i, avg(x) AS x FROM (SELECT label, unnest(embedding)::DOUBLE AS x, unnest(range(1, 65)) AS i FROM embeddings)
      GROUP BY label, i),
q AS (SELECT label AS query_id, list(x ORDER BY i) AS embedding FROM c GROUP BY label)
"""


@register(
    "d5_dense_many_queries",
    f"""
WITH {CENTROIDS},
d AS (SELECT query_id, vec_id, {L2} AS distance FROM embeddings e CROSS JOIN q),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM d)
SELECT query_id, vec_id, rank, round(distance, 6) AS distance FROM r WHERE rank <= 10
""",
)
def d5_many(spark, folder):
    """For the mean vector of each label, the ten nearest vectors."""
    rows = vectors(spark, folder)
    parts = rows.select("label", F.posexplode("vector").alias("i", "x"))
    means = parts.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    queries = means.groupBy(F.col("label").cast("long").alias("query_id")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("vector")
    )
    found = vec.dense_search_many(rows, queries, 10)
    return found.select("query_id", "vec_id", "rank", F.round("distance", 6).alias("distance"))


@register(
    "d6_metrics",
    f"""
WITH m AS (SELECT vec_id, {L2} AS l2, {DOT.format(a='e.embedding', b='q.embedding')} AS dot,
  sqrt({DOT.format(a='e.embedding', b='e.embedding')}) * sqrt({DOT.format(a='q.embedding', b='q.embedding')}) AS norm {FROM_Q})
SELECT vec_id, round(l2, 6) AS l2, round(1 - dot / norm, 6) + 0.0 AS cosine, round(-dot, 6) AS dot FROM m
""",
)
def d6(spark, folder):
    query = vec.query_literal(query_vector(spark, folder))
    v = F.col("vector")
    return vectors(spark, folder).select(
        "vec_id", *[F.round(vec.distance(v, query, m), 6).alias(m) for m in ("l2", "cosine", "dot")]
    )


@register("d7_cell_index_search")
def d7(spark, folder):
    """Sixteen cells, four probed: approximate, so rows only; recall is asserted in the tests."""
    index = vec.CellIndex.build(vectors(spark, folder), shared_dir(spark, "cells"), 16)
    return out(index.search(spark, query_vector(spark, folder), 10, ["vec_id"], 4))


@register(
    "d7_cell_index_all_cells",
    f"SELECT vec_id, round(d, 6) AS distance, round(1 / (1 + d), 6) AS score FROM "
    f"(SELECT vec_id, {L2} AS d {FROM_Q}) ORDER BY d, vec_id LIMIT 25",
)
def d7_all(spark, folder):
    """Probing every cell must give the exact result."""
    index = vec.CellIndex.build(vectors(spark, folder), shared_dir(spark, "cells"), 8)
    return out(index.search(spark, query_vector(spark, folder), 25, ["vec_id"], 8))


@register(
    "d7_refined_search",
    f"SELECT vec_id, label, round(d, 6) AS distance, round(1 / (1 + d), 6) AS score FROM "
    f"(SELECT vec_id, label, {L2} AS d {FROM_Q}) ORDER BY d, vec_id LIMIT 15",
)
def d7_refined(spark, folder):
    """Codes of eight bytes choose the candidates; refining all rows of all cells must give the exact result."""
    rows = vectors(spark, folder)
    index = vix.VectorIndex.build(rows, shared_dir(spark, "vector-index"), "vec_id", cells=12)
    return out(index.search(query_vector(spark, folder), 15, probes=12, refine=-(-rows.count() // 15)), "label")


CHANGED = """
changed AS (
  SELECT e.vec_id, e.label, CASE WHEN d.lang = 'de' THEN list_reverse(e.embedding) ELSE e.embedding END AS embedding
  FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id
  WHERE e.vec_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1) OR d.lang = 'es'
)
"""


def changed_index(spark, folder):
    """English and German rows are indexed; the others come later, German ones are replaced, toxic ones deleted, Spanish ones written again."""
    lang = load_table(spark, folder, "documents").select(F.col("doc_id").alias("vec_id"), "lang")
    rows = vectors(spark, folder).join(lang, "vec_id")
    index = vix.VectorIndex.build(rows.filter("lang IN ('en', 'de')"), shared_dir(spark, "vector-index"), "vec_id", cells=12)
    index.upsert(rows.filter("lang NOT IN ('en', 'de')"))
    index.upsert(rows.filter("lang = 'de'").withColumn("vector", F.reverse("vector")))
    index.delete(load_table(spark, folder, "labels").filter("toxic = 1").select(F.col("doc_id").alias("vec_id")))
    index.upsert(rows.filter("lang = 'es'"))
    return index


@register(
    "d7_changed_rows_search",
    f"WITH {CHANGED} SELECT vec_id, label, round(d, 6) AS distance, round(1 / (1 + d), 6) AS score FROM "
    f"(SELECT vec_id, label, {L2} AS d {FROM_Q.replace('embeddings e', 'changed e')}) ORDER BY d, vec_id LIMIT 30",
)
def d7_changed(spark, folder):
    """Indexed rows and the changes since, read together: what a fresh index of the live rows gives."""
    index = changed_index(spark, folder)
    return out(index.search(query_vector(spark, folder), 30, probes=12, refine=1000), "label")


@register(
    "d8_maintained_index",
    f"WITH {CHANGED} SELECT label, count(*) AS rows, sum(vec_id)::BIGINT AS ids, round(sum(embedding[1]::DOUBLE), 6) AS first, true AS folded FROM changed GROUP BY label",
)
def d8_maintained(spark, folder):
    """The changes exceed the thresholds, so they are folded in and no batch is left outside."""
    index = changed_index(spark, folder)
    done = index.maintain(least=16)
    left = index.plan().first()
    rows = index.rows().groupBy("label").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("vec_id").alias("ids"), F.round(F.sum(F.col("vector")[0].cast("double")), 6).alias("first")
    )
    return rows.withColumn("folded", F.lit(done and left["changed"] == 0))


@register(
    "d8_index_plan",
    """
SELECT 'model-' || label AS model, count(*) AS rows, count(*) FILTER (vec_id % 17 = 0) AS unindexed,
       count(*) FILTER (vec_id % 2 = 0) AS upserts,
       CASE WHEN count(*) < 50 THEN 'none' WHEN count(*) < 55 THEN 'HNSW' ELSE 'IVFPQ' END AS kind,
       count(*) FILTER (vec_id % 2 = 0) >= 1000
         OR count(*) FILTER (vec_id % 17 = 0) / count(*) FILTER (vec_id % 17 <> 0) > 0.05
         OR count(*) FILTER (vec_id % 17 = 0) > 10000 AS reindex
FROM embeddings GROUP BY label
""",
)
def d8(spark, folder):
    """Thresholds of 50 and 55 rows stand in for the defaults, which the test tables do not reach."""
    rows = vectors(spark, folder).select(
        F.concat(F.lit("model-"), F.col("label").cast("string")).alias("model"),
        (F.col("vec_id") % 17 != 0).alias("indexed"), "vec_id",
    )
    return vec.index_plan(rows, "model", "indexed", F.col("vec_id") % 2 == 0, 50, 55)


@register(
    "d9_filtered_search",
    f"SELECT vec_id, label, round(d, 6) AS distance, round(1 / (1 + d), 6) AS score FROM "
    f"(SELECT vec_id, label, {L2} AS d {FROM_Q} WHERE label IN (1, 3, 5)) ORDER BY d, vec_id LIMIT 10",
)
def d9(spark, folder):
    rows = vec.dense_search(
        vectors(spark, folder), query_vector(spark, folder), 10, ["vec_id"], filters={"label": [1, 3, 5]}
    )
    return out(rows, "label")


@register(
    "d10_metadata_filter",
    f"SELECT e.vec_id, round(d, 6) AS distance, round(1 / (1 + d), 6) AS score FROM "
    f"(SELECT e.vec_id, {L2} AS d {FROM_Q}, documents m WHERE m.doc_id = e.vec_id AND m.lang = 'fr') e ORDER BY d, vec_id LIMIT 8",
)
def d10(spark, folder):
    """The metadata condition is applied before ranking, so the result is never short."""
    meta = load_table(spark, folder, "documents").select(F.col("doc_id").alias("vec_id"), "lang")
    rows = vectors(spark, folder).join(meta, "vec_id")
    found = vec.dense_search(rows, query_vector(spark, folder), 8, ["vec_id"], filters={"lang": "fr"})
    return out(found)


@register(
    "d11_delete_vectors",
    """
SELECT label, count(*) AS vectors, sum(vec_id)::BIGINT AS ids FROM embeddings
WHERE vec_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1 OR quality = 0) GROUP BY label
""",
)
def d11(spark, folder):
    doomed = load_table(spark, folder, "labels").filter("toxic = 1 OR quality = 0").select(F.col("doc_id").alias("vec_id"))
    left = delete_keys(vectors(spark, folder), doomed, ["vec_id"])
    return left.groupBy("label").agg(F.count(F.lit(1)).alias("vectors"), F.sum("vec_id").alias("ids"))

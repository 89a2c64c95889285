"""Knowledge-base tables derived from the given tables, in Spark and as SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillstack.session import load_table

KB = """
documents_t AS (SELECT source AS collection, doc_id, source || '/' || lang || '/d' || (doc_id % 50) || '.txt' AS source_path,
                CASE WHEN doc_id % 3 <> 0 THEN doc_id % 3 END AS user_id, text, lang FROM documents),
parses_t AS (SELECT collection, d.doc_id, md5(quality || '-' || toxic) AS parse_hash, CASE WHEN quality = 1 THEN 'pypdf' ELSE 'deepdoc' END AS parser,
             (d.doc_id * 7) % 1000 AS created_s FROM documents_t d JOIN labels l ON d.doc_id = l.doc_id),
chunks_t AS (SELECT collection, doc_id, md5(CAST(i % 2 AS VARCHAR)) AS parse_hash, i AS chunk_id, substring(text, 1 + 1000 * i, 1000) AS text,
             (doc_id * 13 + i) % 1000 AS created_s,
             CASE WHEN doc_id % 4 <> 0 THEN user_id END AS user_id
             FROM (SELECT *, unnest(range(0, CAST(ceil(length(text) / 1000.0) AS BIGINT))) AS i FROM documents_t)),
embeddings_t AS (SELECT collection, d.doc_id, 0 AS chunk_id, md5(CAST(label % 2 AS VARCHAR)) AS parse_hash, 'model-' || label AS model,
                 embedding AS vector FROM documents_t d JOIN embeddings e ON d.doc_id = e.vec_id)
"""


def kb_tables(spark, folder):
    """documents; parses of the labelled ones; chunks of 1000 characters, none of an empty text; one vector where one is given."""
    i = F.col("doc_id")
    documents = load_table(spark, folder, "documents").select(
        F.col("source").alias("collection"), "doc_id",
        F.concat("source", F.lit("/"), "lang", F.lit("/d"), (i % 50).cast("string"), F.lit(".txt")).alias("source_path"),
        F.when(i % 3 != 0, i % 3).alias("user_id"), "text", "lang",
    )
    labels = load_table(spark, folder, "labels")
    parses = documents.join(labels, "doc_id").select(
        "collection", "doc_id", F.md5(F.concat_ws("-", "quality", "toxic")).alias("parse_hash"),
        F.when(F.col("quality") == 1, F.lit("pypdf")).otherwise(F.lit("deepdoc")).alias("parser"),
        F.timestamp_seconds((i * 7) % 1000).alias("created_at"),
    )
    starts = F.sequence(F.lit(0), F.ceil(F.length("text") / 1000).cast("int") - 1)
    parts = documents.filter(F.length("text") > 0).select("*", F.explode(starts).alias("chunk_id"))
    chunks = parts.select(
        "collection", "doc_id", F.md5((F.col("chunk_id") % 2).cast("string")).alias("parse_hash"), "chunk_id",
        F.substring("text", F.col("chunk_id") * 1000 + 1, F.lit(1000)).alias("text"),
        F.timestamp_seconds((i * 13 + F.col("chunk_id")) % 1000).alias("created_at"),
        F.when(i % 4 != 0, F.col("user_id")).alias("user_id"),
    )
    vectors = load_table(spark, folder, "embeddings").withColumnRenamed("vec_id", "doc_id")
    embeddings = documents.join(vectors, "doc_id").select(
        "collection", "doc_id", F.lit(0).alias("chunk_id"), F.md5((F.col("label") % 2).cast("string")).alias("parse_hash"),
        F.concat(F.lit("model-"), F.col("label").cast("string")).alias("model"), F.col("embedding").alias("vector"),
    )
    return {"documents": documents, "parses": parses, "chunks": chunks, "embeddings": embeddings}

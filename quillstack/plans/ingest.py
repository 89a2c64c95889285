"""Ingestion of many documents or pages in one job: register, chunk, embed, write."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstack.functions.arrays import explode_items
from quillstack.operators import chunk as ck
from quillstack.operators import identity as ids
from quillstack.operators.upsert import newest_per_key, pending, upsert
from quillstack.operators.vector import hashed_embedding
from quillstack.operators.web import clean_pages, page_documents


@dataclass
class Ingestion:
    """Next state of the tables, and one row per document with what happened to it."""

    documents: DataFrame
    chunks: DataFrame
    embeddings: DataFrame
    report: DataFrame


def ingest(
    known: dict[str, DataFrame], incoming: DataFrame, config: ck.ChunkConfig, model: str = "hashed", dim: int = 64,
    embed: Callable[[DataFrame], DataFrame] | None = None,
) -> Ingestion:
    """``incoming`` holds collection, source_path, content and uploaded_at, and may hold the owner as user_id.

    ``embed`` adds ``vector`` to rows with ``text`` (default: hashed terms). Chunk ids follow from document,
    configuration, position and text: a repeated run changes nothing, changed text is embedded anew, and chunks and
    vectors of these documents and settings that the run does not give any more are dropped. Of several rows for one
    document the last uploaded counts, and of equally late ones the greatest content.
    """
    if "user_id" not in incoming.columns:
        incoming = incoming.withColumn("user_id", F.lit(None).cast("long"))
    # One row for each document, for its registration and its chunks alike.
    named = incoming.withColumn("doc_id", ids.document_id(F.col("collection"), F.col("source_path")))
    newest = newest_per_key(named, ["collection", "doc_id"], ["uploaded_at", "content", "user_id"])
    documents, report = ids.register_documents(known["documents"], newest)
    params = {"chunk_size": config.size, "chunk_overlap": config.overlap, "separators": list(config.separators)}
    settings = ids.config_hash(params)
    prepared = newest.select("collection", "doc_id", F.col("content").alias("text"), "user_id")
    rows = explode_items(
        prepared, ck.fixed_size_chunks(F.col("text"), config.size, config.overlap), "chunk", "index", ["collection", "doc_id", "user_id"]
    )
    rows = rows.select(
        "collection", "doc_id", F.lit(settings).alias("parse_hash"),
        F.sha2(F.concat_ws("|", "doc_id", F.lit(settings), "index", F.sha2("chunk", 256)), 256).alias("chunk_id"), "index",
        F.col("chunk").alias("text"), "user_id",
    )
    keys = ["collection", "doc_id", "parse_hash", "chunk_id"]
    # Rows of these documents and settings that are not given again are stale.
    touched = prepared.select("collection", "doc_id", F.lit(settings).alias("parse_hash"))

    def current(table: DataFrame) -> DataFrame:
        mine = table.join(touched, ["collection", "doc_id", "parse_hash"], "left_semi")
        others = table.join(touched, ["collection", "doc_id", "parse_hash"], "left_anti")
        return others.unionByName(mine.join(rows.select(*keys), keys, "left_semi"))

    chunks = upsert(current(known["chunks"]), rows, keys)
    stored = current(known["embeddings"])
    tag = ids.model_tag(F.lit(model))
    todo = pending(rows, stored.filter(F.col("model_tag") == tag), keys)
    vectors = embed(todo) if embed else hashed_embedding(todo, "text", dim)
    vectors = vectors.filter(F.col("vector").isNotNull()).withColumn("model", F.lit(model)).withColumn("model_tag", tag).select(
        *keys, "model", "model_tag", "vector", "user_id"
    )
    embeddings = upsert(stored, vectors, [*keys, "model"])
    counts = rows.groupBy("collection", "doc_id").agg(F.count(F.lit(1)).alias("chunks"))
    report = report.join(counts, ["collection", "doc_id"], "left").withColumn("chunks", F.coalesce("chunks", F.lit(0)))
    return Ingestion(documents, chunks, embeddings, report)


def empty_state(incoming: DataFrame) -> dict[str, DataFrame]:
    """Empty tables to ingest into."""
    spark = incoming.sparkSession
    if "user_id" not in incoming.columns:
        incoming = incoming.withColumn("user_id", F.lit(None).cast("long"))
    return {
        "documents": incoming.limit(0).drop("content").withColumn("doc_id", F.lit("")).withColumn("content_hash", F.lit("")),
        "chunks": spark.createDataFrame(
            [], "collection string, doc_id string, parse_hash string, chunk_id string, index int, text string, user_id long"
        ),
        "embeddings": spark.createDataFrame(
            [], "collection string, doc_id string, parse_hash string, chunk_id string, model string, model_tag string, vector array<float>, user_id long"
        ),
    }


def ingest_pages(
    known: dict[str, DataFrame] | None, pages: DataFrame, collection: str, crawled_at: Column, config: ck.ChunkConfig
) -> Ingestion:
    """Clean pages, turn them into documents and ingest those."""
    docs = page_documents(clean_pages(pages), crawled_at)
    incoming = docs.select(
        F.lit(collection).alias("collection"), F.col("url").alias("source_path"), F.col("text").alias("content"),
        crawled_at.alias("uploaded_at"),
    )
    return ingest(known or empty_state(incoming), incoming, config)

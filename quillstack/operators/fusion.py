"""Fusing, re-ranking and formatting search results. Inputs are result lists, bounded by the search limit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillstack.functions.text import basename

# Fixed value: rank constant of reciprocal rank fusion.
RRF_K = 60


def with_rank(results: DataFrame, order: list[Column], name: str = "rank", keys: list[str] | None = None) -> DataFrame:
    """Number a result list from 1 (per query when ``keys`` are given)."""
    window = W.partitionBy(*(keys or [F.lit(0)])).orderBy(*order)
    return results.withColumn(name, F.row_number().over(window))


def merge_lists(dense: DataFrame, sparse: DataFrame, ids: list[str]) -> DataFrame:
    """Outer join of two ranked lists with columns ids, score, rank."""
    left = dense.select(*ids, F.col("score").alias("vector_score"), F.col("rank").alias("vector_rank"))
    right = sparse.select(*ids, F.col("score").alias("fts_score"), F.col("rank").alias("fts_rank"))
    return left.join(right, ids, "full_outer")


def rrf(dense: DataFrame, sparse: DataFrame, ids: list[str], k: int = RRF_K) -> DataFrame:
    """Sum of ``1 / (k + rank)`` over both lists."""
    merged = merge_lists(dense, sparse, ids)

    def part(rank: str) -> Column:
        return F.coalesce(F.lit(1.0) / (F.lit(k) + F.col(rank)), F.lit(0.0))

    return merged.withColumn("score", part("vector_rank") + part("fts_rank"))


def rrf_many(lists: list[DataFrame], ids: list[str], k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of any number of lists."""
    rows = None
    for ranked in lists:
        part = ranked.select(*ids, (F.lit(1.0) / (F.lit(k) + F.col("rank"))).alias("part"))
        rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy(*ids).agg(F.round(F.sum("part"), 12).alias("score"))


def _min_max(column: str, window, flat: Column) -> Column:
    low, high = F.min(column).over(window), F.max(column).over(window)
    return F.when(high > low, (F.col(column) - low) / (high - low)).otherwise(flat)


def linear(
    dense: DataFrame, sparse: DataFrame, ids: list[str], dense_weight: float = 0.5, sparse_weight: float = 0.5,
    normalize: bool = True,
) -> DataFrame:
    """Weighted sum of (min-max scaled) scores, scaled again to 0..1; equal non-zero sums become 1."""
    everything = W.partitionBy(F.lit(0))

    def scaled(results: DataFrame) -> DataFrame:
        value = _min_max("score", everything, F.lit(0.0)) if normalize else F.col("score")
        return results.withColumn("__part", value)

    left = scaled(dense).select(*ids, "__part", F.col("score").alias("vector_score"), F.col("rank").alias("vector_rank"))
    right = scaled(sparse).select(
        *ids, F.col("__part").alias("__part2"), F.col("score").alias("fts_score"), F.col("rank").alias("fts_rank")
    )
    merged = left.join(right, ids, "full_outer").withColumn(
        "__sum",
        F.coalesce(F.col("__part") * dense_weight, F.lit(0.0)) + F.coalesce(F.col("__part2") * sparse_weight, F.lit(0.0)),
    )
    flat = F.when(F.col("__sum") > 0, F.lit(1.0)).otherwise(F.lit(0.0))
    return merged.withColumn("score", _min_max("__sum", everything, flat)).drop("__part", "__part2", "__sum")


def fused_order(ids: list[str]) -> list[Column]:
    """Best score first; ties keep the dense list's order, then the text list's."""
    return [
        F.col("score").desc(), F.col("vector_rank").asc_nulls_last(), F.col("fts_rank").asc_nulls_last(),
        *[F.col(c).asc() for c in ids],
    ]


def rerank_by_texts(results: DataFrame, reranked: DataFrame, text: str = "text") -> DataFrame:
    """Reorder ``results`` (rank, text) by an external ranking of texts (new_rank, text).

    Equal texts are matched in order. Results the ranking does not name follow, grouped by the first place of their text.
    """
    same = W.partitionBy(text)
    numbered = results.withColumn("__n", F.row_number().over(same.orderBy("rank"))).withColumn(
        "__first", F.min("rank").over(same)
    )
    other = reranked.withColumn("__n", F.row_number().over(same.orderBy("new_rank"))).select(text, "__n", "new_rank")
    joined = numbered.join(other, [text, "__n"], "left")
    final = F.row_number().over(
        W.partitionBy(F.lit(0)).orderBy(F.col("new_rank").asc_nulls_last(), F.col("__first"), F.col("rank"))
    )
    return joined.withColumn("final_rank", final).drop("__n", "__first")


def rrf_rerank(fused: DataFrame, ids: list[str], k: int = RRF_K) -> DataFrame:
    """RRF over the ranks stored with a fused list, renumbered within it.

    Applies only when the list holds both kinds of ranks; otherwise the scores stay as they are.
    """
    everything = W.partitionBy(F.lit(0))

    def renumbered(rank: str) -> Column:
        window = everything.orderBy(F.col(rank).asc_nulls_last(), *ids)
        return F.when(F.col(rank).isNotNull(), F.row_number().over(window))

    both = (F.count("vector_rank").over(everything) > 0) & (F.count("fts_rank").over(everything) > 0)
    rows = fused.withColumn("__v", renumbered("vector_rank")).withColumn("__f", renumbered("fts_rank")).withColumn("__both", both)
    value = F.coalesce(F.lit(1.0) / (F.lit(k) + F.col("__v")), F.lit(0.0)) + F.coalesce(
        F.lit(1.0) / (F.lit(k) + F.col("__f")), F.lit(0.0)
    )
    return rows.withColumn("score", F.when(F.col("__both"), value).otherwise(F.col("score"))).drop("__v", "__f", "__both")


def format_contexts(
    results: DataFrame, order: list[Column], top_k: int, text: str = "text", metadata: Column | None = None,
    separator: str = "\n---\n",
) -> DataFrame:
    """One row ``context``: numbered texts of the first ``top_k`` results, empty when there are none."""
    top = with_rank(results.orderBy(*order).limit(top_k), order, "__rank")
    head = F.concat(F.lit("["), F.col("__rank").cast("string"), F.lit("]\n"))
    body = F.col(text) if metadata is None else F.concat(metadata, F.lit("\n"), F.col(text))
    items = F.sort_array(F.collect_list(F.struct(F.col("__rank").alias("rank"), F.concat(head, body).alias("item"))))
    return top.agg(F.array_join(F.transform(items, lambda x: x["item"]), separator).alias("context"))


def metadata_line(doc_id: Column, chunk_id: Column, score: Column) -> Column:
    return F.format_string(
        "Document ID: %s, Chunk ID: %s, Score: %.4f", doc_id.cast("string"), chunk_id.cast("string"), score
    )


def generation_prompt(contexts: DataFrame, template: str, context: str = "context") -> DataFrame:
    """Template, context and answer mark in one text."""
    if not template:
        raise ValueError("the prompt template is empty")
    return contexts.withColumn(
        "prompt", F.concat(F.lit(template), F.lit("\n\nContext:\n"), F.col(context), F.lit("\n\nAnswer:"))
    )


def result_summary(results: DataFrame, order: list[Column], query: str, total_documents: int) -> DataFrame:
    """One row ``summary`` listing results (collection, score, text, source_path, doc_id, chunk_id) for a reader."""
    ranked = with_rank(results, order, "__rank")
    entry = F.concat(
        F.format_string("\n## Result %d (Collection: %s, Score: %.4f)", F.col("__rank"), F.col("collection"), F.col("score")),
        F.lit("\nDocument: "), basename(F.col("source_path")),
        F.lit("\n"), F.col("text"),
        F.lit("\n_Metadata: doc: "), F.col("doc_id").cast("string"), F.lit(", chunk: "), F.col("chunk_id").cast("string"),
        F.lit("_"),
    )
    items = F.sort_array(F.collect_list(F.struct(F.col("__rank").alias("rank"), entry.alias("item"))))
    head = F.concat(
        F.lit(f"Search Results for Query: '{query}'\nFound "), F.count(F.lit(1)).cast("string"),
        F.lit(f" relevant results from {total_documents} documents\n"),
    )
    return ranked.agg(
        F.concat(head, F.array_join(F.transform(items, lambda x: x["item"]), "")).alias("summary")
    )

"""Collection and document statistics, status, rename and delete.

Tables are passed as a dict (documents, parses, chunks, embeddings); any of them may be missing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstack.functions.text import basename
from quillstack.operators.upsert import newest_per_key, upsert

KINDS = ["documents", "parses", "chunks", "embeddings"]


def _tagged(tables: dict[str, DataFrame], keys: list[str]) -> DataFrame:
    rows = None
    for kind in KINDS:
        if kind in tables:
            part = tables[kind].select(*keys, F.lit(kind).alias("kind"))
            rows = part if rows is None else rows.unionByName(part)
    return rows


def _kind_counts() -> list[Column]:
    return [F.count_if(F.col("kind") == kind).alias(kind) for kind in KINDS]


def collection_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows of each table per collection, and distinct document names; collections known to any table appear.

    One tagged union and one grouping. Names are returned by ``document_names`` as rows: a list per collection
    would have to fit into one task.
    """
    counts = _tagged(tables, ["collection"]).groupBy("collection").agg(*_kind_counts())
    if "documents" not in tables:
        return counts.withColumn("names", F.lit(0).cast("long"))
    names = document_names(tables["documents"]).groupBy("collection").agg(F.count(F.lit(1)).alias("names"))
    return counts.join(names, "collection", "left").withColumn("names", F.coalesce("names", F.lit(0)))


def document_names(documents: DataFrame) -> DataFrame:
    """Distinct base names per collection."""
    return documents.select("collection", basename(F.col("source_path")).alias("name")).distinct()


def document_row_counts(table: DataFrame) -> DataFrame:
    return table.groupBy("collection", "doc_id").agg(F.count(F.lit(1)).alias("rows"))


def document_ids(tables: dict[str, DataFrame]) -> DataFrame:
    """Every document any table knows."""
    return _tagged(tables, ["collection", "doc_id"]).select("collection", "doc_id").distinct()


def inferred_status(explicit: Column, chunks: Column, embeddings: Column) -> Column:
    """The recorded status, else what the counts say."""
    return (
        F.when(explicit.isNotNull(), explicit)
        .when(chunks == 0, F.lit("pending"))
        .when(embeddings == 0, F.lit("chunked"))
        .when(embeddings < chunks, F.lit("partially_embedded"))
        .otherwise(F.lit("success"))
    )


def _with_times(overview: DataFrame, documents: DataFrame | None, runs: DataFrame | None) -> DataFrame:
    """Creation is the upload; the last update that of the recorded status, else the upload."""
    keys, at = ["collection", "doc_id"], F.lit(None).cast("timestamp")
    uploaded = documents is not None and "uploaded_at" in documents.columns
    if uploaded:
        overview = overview.join(documents.groupBy(*keys).agg(F.min("uploaded_at").alias("created_at")), keys, "left")
    else:
        overview = overview.withColumn("created_at", at)
    if runs is None or "updated_at" not in runs.columns:
        return overview.withColumn("updated_at", F.col("created_at"))
    times = runs.groupBy(*keys).agg(F.max("updated_at").alias("__updated"))
    return overview.join(times, keys, "left").withColumn("updated_at", F.coalesce("__updated", "created_at")).drop("__updated")


def document_overview(tables: dict[str, DataFrame], runs: DataFrame | None = None) -> DataFrame:
    """Counts, status and times per document over all tables; ``runs`` holds the latest recorded status."""
    keys = ["collection", "doc_id"]
    counts = _with_times(_tagged(tables, keys).groupBy(*keys).agg(*_kind_counts()), tables.get("documents"), runs)
    if runs is None:
        return counts.withColumn("status", inferred_status(F.lit(None).cast("string"), F.col("chunks"), F.col("embeddings")))
    joined = counts.join(runs.select(*keys, F.col("status").alias("__status"), "message"), keys, "left")
    return joined.withColumn(
        "status", inferred_status(F.col("__status"), F.col("chunks"), F.col("embeddings"))
    ).drop("__status")


def model_counts(embeddings: DataFrame) -> DataFrame:
    """Vectors per document and model, as rows."""
    return embeddings.groupBy("collection", "doc_id", "model").agg(F.count(F.lit(1)).alias("vectors"))


def latest_status(log: DataFrame, tie: list[str] | None = None) -> DataFrame:
    """Newest entry per document of an append-only status log."""
    return newest_per_key(log, ["collection", "doc_id"], ["updated_at", *(tie or [])])


# The status each bulk action writes.
ACTION_STATUS = {"retry": "pending", "cancel": "failed"}


def change_status(runs: DataFrame, targets: DataFrame, action: str, message: str, at: Column) -> DataFrame:
    """Next runs table after retrying or cancelling the target documents."""
    rows = targets.select("collection", "doc_id").distinct().select(
        "collection", "doc_id", F.lit(ACTION_STATUS[action]).alias("status"), F.lit(message).alias("message"),
        at.alias("updated_at"),
    )
    return upsert(runs, rows, ["collection", "doc_id"])


def delete_where(tables: dict[str, DataFrame], condition: Column) -> tuple[dict[str, DataFrame], DataFrame]:
    """Tables without the matching rows, and how many rows each one loses."""
    doomed = F.coalesce(condition, F.lit(False))
    left = {name: df.filter(~doomed) for name, df in tables.items()}
    counts = None
    for name, df in tables.items():
        part = df.filter(doomed).agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table_name"), "rows")
        counts = part if counts is None else counts.unionByName(part)
    return left, counts


def rename_collection(tables: dict[str, DataFrame], old: str, new: str) -> dict[str, DataFrame]:
    renamed = F.when(F.col("collection") == old, F.lit(new)).otherwise(F.col("collection"))
    return {name: df.withColumn("collection", renamed) for name, df in tables.items()}


def counters(deltas: DataFrame, columns: list[str]) -> DataFrame:
    """Collection counters from a log of changes."""
    return deltas.groupBy("collection").agg(*[F.sum(c).alias(c) for c in columns])


def inferred_embedding(embeddings: DataFrame) -> DataFrame:
    """The model most vectors of a collection use (ties: first by name), and its dimension."""
    per_model = embeddings.groupBy("collection", "model").agg(
        F.count(F.lit(1)).alias("vectors"), F.max(F.size("vector")).alias("dimension")
    )
    order = F.struct((-F.col("vectors")).alias("n"), F.col("model").alias("m"))
    best = F.min_by(F.struct("model", "dimension", "vectors"), order)
    return per_model.groupBy("collection").agg(best.alias("__b")).select("collection", "__b.*")


def mixed_models(embeddings: DataFrame) -> DataFrame:
    """Collections whose vectors come from more than one model."""
    counted = embeddings.groupBy("collection").agg(F.countDistinct("model").alias("models"))
    return counted.filter(F.col("models") > 1)

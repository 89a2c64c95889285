"""Embedding, vector checks, exact and approximate nearest neighbours."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import HashingTF, Normalizer
from pyspark.ml.functions import array_to_vector, predict_batch_udf, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from quillstack.functions.text import has_content, words
from quillstack.functions.windows import top_per_group

# Row counts from which an index is worth building, and the kind above the second one.
INDEX_ROWS = 50_000
QUANTIZED_ROWS = 10_000_000

# Rebuild triggers.
REINDEX_UPSERTS = 1000
REINDEX_UNINDEXED_RATIO = 0.05
REINDEX_UNINDEXED_ROWS = 10_000

#: Query vectors handled in one pass over the corpus; larger sets take more passes.
QUERY_BLOCK = 1024
#: Tasks among which a block's corpus rows are dealt.
SLOTS = 32


def query_literal(query: list[float], dim: int | None = None) -> Column:
    """A checked query vector as a literal array of doubles."""
    values = [float(x) for x in query]
    if not values:
        raise ValueError("query vector is empty")
    if any(math.isnan(x) or math.isinf(x) for x in values):
        raise ValueError("query vector holds NaN or infinity")
    if dim is not None and len(values) != dim:
        raise ValueError(f"query vector has {len(values)} dimensions, expected {dim}")
    return F.lit(values).cast("array<double>")


def _fold(vector: Column, other: Column, term: Callable[[Column, Column], Column]) -> Column:
    terms = F.zip_with(vector.cast("array<double>"), other, term)
    return F.aggregate(terms, F.lit(0.0), lambda acc, x: acc + x)


def squared_l2(vector: Column, query: Column) -> Column:
    return _fold(vector, query, lambda a, b: (a - b) * (a - b))


def dot_product(vector: Column, query: Column) -> Column:
    return _fold(vector, query, lambda a, b: a * b)


def cosine_distance(vector: Column, query: Column) -> Column:
    norm = F.sqrt(dot_product(vector, vector.cast("array<double>"))) * F.sqrt(dot_product(query, query))
    return F.when(norm > 0, F.lit(1.0) - dot_product(vector, query) / norm).otherwise(F.lit(1.0))


def distance(vector: Column, query: Column, metric: str = "l2") -> Column:
    """Smaller is closer for every metric; ``dot`` gives the negated product."""
    if metric == "l2":
        return squared_l2(vector, query)
    if metric == "cosine":
        return cosine_distance(vector, query)
    if metric == "dot":
        return -dot_product(vector, query)
    raise ValueError(f"unknown metric {metric}")


def score(dist: Column, metric: str = "l2") -> Column:
    """Larger is better: ``1 / (1 + d)`` for distances, the product itself for ``dot``."""
    return -dist if metric == "dot" else F.lit(1.0) / (F.lit(1.0) + dist)


def filter_condition(filters: dict | None) -> Column:
    """Equality per column; a list means membership, None means null."""
    condition = F.lit(True)
    for name, value in (filters or {}).items():
        column = F.col(name)
        if value is None:
            condition = condition & column.isNull()
        elif isinstance(value, (list, tuple, set)):
            condition = condition & column.isin(list(value))
        else:
            condition = condition & (column == F.lit(value))
    return condition


def dense_search(
    corpus: DataFrame,
    query: list[float],
    k: int,
    ids: list[str],
    vector: str = "vector",
    metric: str = "l2",
    filters: dict | None = None,
    max_distance: float | None = None,
) -> DataFrame:
    """Exact ``k`` nearest rows: each task keeps its best ``k`` and only those are merged.

    Vectors that are null, have another length, or hold nulls, NaN or infinity are not compared.
    """
    literal = query_literal(query)
    rows = corpus.filter(filter_condition(filters)).filter(vector_problem(F.col(vector), len(query)).isNull())
    rows = rows.withColumn("distance", distance(F.col(vector), literal, metric)).drop(vector)
    if max_distance is not None:
        rows = rows.filter(F.col("distance") <= max_distance)
    return rows.withColumn("score", score(F.col("distance"), metric)).orderBy("distance", *ids).limit(k)


def dense_search_many(
    corpus: DataFrame, queries: DataFrame, k: int, vector_id: str = "vec_id", vector: str = "vector", query_id: str = "query_id"
) -> DataFrame:
    """Exact ``k`` nearest rows for each of many queries (squared L2), in one job.

    Up to QUERY_BLOCK queries go to every task, which reads its part of the corpus where it lies. More queries are dealt
    to blocks; every corpus row goes to one slot of each block, where the block's queries come first and the rows
    stream past them. A task keeps the best ``k`` of each query and emits only those. Vectors that are null, hold nulls,
    NaN or infinity, or have another length than the query are not compared.
    """
    def usable(df: DataFrame, name: str) -> DataFrame:
        rows = df.select(F.col(name).alias("id"), F.col(vector).cast("array<double>").alias("v"))
        return rows.filter((F.size("v") > 0) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))

    asked, rows = usable(queries, query_id), usable(corpus, vector_id)
    query_type, id_type = queries.schema[query_id].dataType, corpus.schema[vector_id].dataType
    few = asked.limit(QUERY_BLOCK + 1).collect()
    if len(few) <= QUERY_BLOCK:
        found = _nearest_in_place(rows, [(r["id"], r["v"]) for r in few], k, query_id, query_type, vector_id, id_type)
        return top_per_group(found, [query_id], [F.col("distance"), F.col(vector_id)], k)
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    asked = asked.select(
        F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.lit(SLOTS - 1))).alias("slot"),
        F.lit(0).alias("kind"), F.col("id").alias("query"), F.lit(None).cast(id_type).alias("row"), "v",
    )
    rows = rows.select(
        F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.pmod(F.xxhash64("id", "v"), F.lit(SLOTS)).cast("int").alias("slot"),
        F.lit(1).alias("kind"), F.lit(None).cast(query_type).alias("query"), F.col("id").alias("row"), "v",
    )
    dealt = asked.unionByName(rows).repartition("block", "slot").sortWithinPartitions("block", "slot", "kind")
    schema = T.StructType(
        [T.StructField(query_id, query_type), T.StructField(vector_id, id_type), T.StructField("distance", T.DoubleType())]
    )

    def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        here, best = None, []

        def out() -> Iterator[pd.DataFrame]:
            for query, _, ids, distances in best:
                yield pd.DataFrame({query_id: [query] * len(ids), vector_id: ids, "distance": distances})

        for batch in batches:
            for place, part in batch.groupby(["block", "slot"], sort=False):
                if place != here:
                    yield from out()
                    here, best = place, []
                for query, v in zip(part["query"][part["kind"] == 0], part["v"][part["kind"] == 0]):
                    best.append((query, np.asarray(v), np.empty(0, object), np.empty(0)))
                found = part[part["kind"] == 1]
                for size, same in found.groupby(found["v"].map(len), sort=False):
                    matrix, own = np.stack(same["v"].to_numpy()), same["row"].to_numpy()
                    for i, (query, v, ids, distances) in enumerate(best):
                        if len(v) == size:
                            distances = np.concatenate([distances, ((matrix - v) ** 2).sum(axis=1)])
                            ids = np.concatenate([ids, own])
                            order = np.lexsort((ids, distances))[:k]
                            best[i] = (query, v, ids[order], distances[order])
        yield from out()

    found = dealt.mapInPandas(nearest, schema)
    return top_per_group(found, [query_id], [F.col("distance"), F.col(vector_id)], k)


def _nearest_in_place(
    rows: DataFrame, asked: list[tuple], k: int, query_id: str, query_type: T.DataType, vector_id: str, id_type: T.DataType
) -> DataFrame:
    """(query, row, distance): each task's ``k`` nearest of (id, v) for each of a bounded number of queries."""
    by_size: dict[int, tuple[list, np.ndarray]] = {}
    for size in {len(v) for _, v in asked}:
        same = [(i, v) for i, v in asked if len(v) == size]
        by_size[size] = [i for i, _ in same], np.array([v for _, v in same])
    shared = rows.sparkSession.sparkContext.broadcast(by_size)
    schema = T.StructType(
        [T.StructField(query_id, query_type), T.StructField(vector_id, id_type), T.StructField("distance", T.DoubleType())]
    )

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            sizes = pc.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False)
            for size, (_, points) in shared.value.items():
                at = np.flatnonzero(sizes == size)
                if not len(at):
                    continue
                part = batch if len(at) == batch.num_rows else batch.take(pa.array(at))
                matrix = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(at), size)
                own = np.array(part.column(0).to_pylist())
                # The product proposes, with room for rounding; the distance itself decides.
                squares, lengths = (matrix**2).sum(1), (points**2).sum(1)
                rough = squares[:, None] - 2 * (matrix @ points.T)
                for q in range(len(points)):
                    room = 1e-9 * (1 + lengths[q] + squares.max())
                    limit = np.partition(rough[:, q], k - 1)[k - 1] + room if len(at) > k else np.inf
                    near = np.flatnonzero(rough[:, q] <= limit)
                    distances, ids = ((matrix[near] - points[q]) ** 2).sum(axis=1), own[near]
                    if (size, q) in best:
                        distances, ids = np.concatenate([best[size, q][0], distances]), np.concatenate([best[size, q][1], ids])
                    order = np.lexsort((ids, distances))[:k]
                    best[size, q] = distances[order], ids[order]
        for (size, q), (distances, ids) in best.items():
            yield pa.RecordBatch.from_pydict({query_id: [shared.value[size][0][q]] * len(ids), vector_id: ids.tolist(), "distance": distances}, schema=arrow)

    arrow = to_arrow_schema(schema)
    return rows.mapInArrow(nearest, schema)


def vector_problem(vector: Column, dim: int) -> Column:
    """Why a vector cannot be stored; null when it can."""
    broken = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return (
        F.when(vector.isNull() | (F.size(vector) == 0), F.lit("empty"))
        .when(F.size(vector) != dim, F.lit("dimension"))
        .when(broken, F.lit("not finite"))
    )


def split_valid(df: DataFrame, dim: int, vector: str = "vector") -> tuple[DataFrame, DataFrame]:
    """Rows with storable vectors, and the others with a ``problem`` column."""
    marked = df.withColumn("problem", vector_problem(F.col(vector), dim))
    return marked.filter(F.col("problem").isNull()).drop("problem"), marked.filter(F.col("problem").isNotNull())


def stored_dimensions(df: DataFrame, model: str = "model", vector: str = "vector") -> DataFrame:
    """Smallest and largest dimension per model and whether they agree."""
    return df.groupBy(model).agg(
        F.min(F.size(vector)).alias("min_dim"), F.max(F.size(vector)).alias("max_dim"), F.count(F.lit(1)).alias("vectors")
    ).withColumn("consistent", F.col("min_dim") == F.col("max_dim"))


def index_kind(rows: Column, index_rows: int = INDEX_ROWS, quantized_rows: int = QUANTIZED_ROWS) -> Column:
    return F.when(rows < index_rows, F.lit("none")).when(rows < quantized_rows, F.lit("HNSW")).otherwise(F.lit("IVFPQ"))


def index_plan(
    df: DataFrame, group: str, indexed: str, upserts: Column, index_rows: int = INDEX_ROWS, quantized_rows: int = QUANTIZED_ROWS
) -> DataFrame:
    """Per model: rows, unindexed rows, the index kind its size asks for and whether to rebuild."""
    counts = df.groupBy(group).agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(~F.col(indexed)).alias("unindexed"), F.count_if(upserts).alias("upserts")
    )
    done = F.col("rows") - F.col("unindexed")
    due = (
        (F.col("upserts") >= REINDEX_UPSERTS)
        | ((done > 0) & (F.col("unindexed") / done > REINDEX_UNINDEXED_RATIO))
        | (F.col("unindexed") > REINDEX_UNINDEXED_ROWS)
    )
    return counts.withColumn("kind", index_kind(F.col("rows"), index_rows, quantized_rows)).withColumn("reindex", due)


@dataclass
class CellIndex:
    """Vectors stored by nearest centroid below ``path``; the centroids (a few thousand at most) stay with the index."""

    path: str
    centroids: list[list[float]]

    @staticmethod
    def build(
        df: DataFrame, path: str, cells: int, vector: str = "vector", seed: int = 7
    ) -> CellIndex:
        """Train centroids on all rows, then write every row under its cell."""
        rows = df.withColumn("__v", array_to_vector(vector))
        model = KMeans(k=cells, seed=seed, featuresCol="__v", predictionCol="cell", maxIter=10).fit(rows)
        model.transform(rows).drop("__v").write.mode("errorifexists").partitionBy("cell").parquet(path)
        return CellIndex(path, [[float(x) for x in c] for c in model.clusterCenters()])

    def nearest_cells(self, query: list[float], probes: int) -> list[int]:
        gaps = ((np.array(self.centroids) - np.array(query, dtype=float)) ** 2).sum(axis=1)
        return [int(i) for i in np.lexsort((np.arange(len(gaps)), gaps))[:probes]]

    def search(self, spark, query: list[float], k: int, ids: list[str], probes: int, vector: str = "vector") -> DataFrame:
        """Read only the ``probes`` nearest cells (partition pruning) and rank their rows exactly."""
        rows = spark.read.parquet(self.path).filter(F.col("cell").isin(self.nearest_cells(query, probes)))
        return dense_search(rows, query, k, ids, vector)


def hashed_embedding(df: DataFrame, text: str, dim: int = 256, output: str = "vector") -> DataFrame:
    """Unit-length hashed term counts, computed in the JVM; texts without a word give null."""
    tokens = df.withColumn("__terms", words(F.col(text)))
    counted = HashingTF(inputCol="__terms", outputCol="__tf", numFeatures=dim).transform(tokens)
    unit = Normalizer(inputCol="__tf", outputCol="__unit").transform(counted)
    vector = vector_to_array("__unit", "float32")
    return unit.withColumn(output, F.when(F.size("__terms") > 0, vector)).drop("__terms", "__tf", "__unit")


def model_embedding(df: DataFrame, text: str, make_model: Callable, batch_size: int = 10, output: str = "vector") -> DataFrame:
    """Embed with a user's model. ``make_model`` runs once per Python worker and returns a function from a batch of
    texts to a float matrix; rows of NaN count as failures and give null."""
    predict = predict_batch_udf(make_model, return_type=T.ArrayType(T.FloatType()), batch_size=batch_size)
    out = df.withColumn("__raw", F.when(has_content(F.col(text)), predict(text)))
    failed = F.exists("__raw", F.isnan)
    return out.withColumn(output, F.when(~failed, F.col("__raw"))).drop("__raw")


def embedding_report(df: DataFrame, group: list[str], vector: str = "vector") -> DataFrame:
    return df.groupBy(*group).agg(
        F.count(F.lit(1)).alias("total"), F.count(vector).alias("embedded"), F.count_if(F.col(vector).isNull()).alias("failed")
    )

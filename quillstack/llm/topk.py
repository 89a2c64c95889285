"""Exact top-k by integer inner product with pivot-table elimination.

Every vector keeps its distances to a set of pivots. For a query q and a candidate c, the largest |d(q, p) - d(c, p)|
over the pivots is a lower bound of d(q, c), so (|q|^2 + |c|^2 - bound^2) / 2 is an upper bound of their product.
Candidates are evaluated in the order of these bounds until the next bound is below the k-th best score.

Candidates are packed into blocks of rows, queries into blocks of rows, and the blocks meet by an equi-join on the
query block's number; a pair of blocks yields at most k rows for each query, so nothing grows with queries x rows.

Null vectors, empty vectors and vectors with a null or non-finite component take no part. Shorter vectors count as
padded with zeros. Components are floor(scale * x); scores are exact while they fit a long. Rows that share an id are
one item: it takes the best score of its rows, is listed once, and never answers its own query.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillstack.llm.common import map_batches, written

#: Rows of a block of candidates and of a block of queries; both bound a task's memory.
ROWS_PER_BLOCK, QUERIES_PER_BLOCK = 2048, 1024
PIVOTS = 16
#: Candidates evaluated at a time, in bound order, and tasks among which a query block's candidates are dealt.
STEP, SLOTS = 256, 24


def quantized(rows: DataFrame, id_col: str, vector: str, scale: int) -> DataFrame:
    """(id, v): vectors of floor(scale * x) as longs; unusable rows are left out."""
    usable = F.col(id_col).isNotNull() & (F.size(vector) > 0) & ~F.exists(
        F.col(vector).cast("array<double>"), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    )
    return rows.filter(F.coalesce(usable, F.lit(False))).select(
        F.col(id_col).cast("long").alias("id"),
        F.transform(F.col(vector).cast("array<double>"), lambda x: F.floor(x * scale)).alias("v"),
    )


def _packed(rows: DataFrame, per_block: int, dims: int, label: str) -> DataFrame:
    """(block, n, ids, vectors): rows packed as bytes into blocks of ``per_block`` rows at most."""

    def block(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        part = pa.Table.from_batches(parts).combine_chunks()
        v = part.column(1).chunk(0)
        sizes = pc.list_value_length(v).to_numpy(zero_copy_only=False)
        out = np.zeros((part.num_rows, dims), np.int64)
        if (sizes == dims).all():
            out[:] = v.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
        else:
            for i, x in enumerate(v.to_pylist()):
                out[i, : len(x)] = x
        ids = part.column(0).chunk(0).to_numpy(zero_copy_only=False).astype(np.int64)
        return pa.RecordBatch.from_pydict({"n": pa.array([len(ids)], pa.int64()), "ids": [ids.tobytes()], "vectors": [out.tobytes()]})

    def pack(batches):
        held, size = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, per_block):
                part = batch.slice(at, per_block)
                if held and size + part.num_rows > per_block:
                    yield block(held)
                    held, size = [], 0
                held.append(part)
                size += part.num_rows
        if size:
            yield block(held)

    blocks = rows.mapInArrow(pack, "n long, ids binary, vectors binary")
    return written(blocks.withColumn("block", F.monotonically_increasing_id()), label)


def _pivots(first: np.ndarray, count: int) -> np.ndarray:
    """Vectors far from each other, taken one by one from ``first``; any choice gives exact results."""
    first = first.astype(np.float64)
    chosen = [0]
    nearest = np.full(len(first), np.inf)
    while len(chosen) < min(count, len(first)):
        nearest = np.minimum(nearest, ((first - first[chosen[-1]]) ** 2).sum(1))
        chosen.append(int(nearest.argmax()))
    return first[chosen]


def top_k(
    rows: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector: str = "embedding", scale: int = 256,
    pivots: int = PIVOTS,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` rows with the highest product for each query, ties to the smaller id.

    Pivots come from one bounded block of rows; they decide the speed, never the result.
    """
    spark = rows.sparkSession
    schema = "query_id long, vec_id long, score long"
    base, asked = quantized(rows, id_col, vector, scale), quantized(queries, id_col, vector, scale)
    dims = base.select(F.size("v").alias("n")).union(asked.select(F.size("v").alias("n"))).agg(F.max("n")).first()[0] or 1
    # Blocks are cut from a shuffle by row, so that neither files nor hot ids decide their sizes.
    cut = F.xxhash64("id", "v")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = _packed(base.repartition(parts, cut), ROWS_PER_BLOCK, dims, "topk-rows")
    # Repeated query rows are one; then a hash deals the queries evenly to blocks.
    asked = asked.distinct()
    n_asks = max(1, -(-asked.count() // QUERIES_PER_BLOCK))
    asks = asked.groupBy(F.pmod(cut, F.lit(n_asks)).cast("int").alias("ask")).agg(
        F.collect_list("id").alias("q_ids"), F.collect_list("v").alias("q_vectors")
    )
    sample = blocks.orderBy(F.desc("n"), "block").select("vectors").limit(1).collect()
    if not sample:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    table = spark.sparkContext.broadcast(_pivots(np.frombuffer(sample[0][0], np.int64).reshape(-1, dims)[:1024], pivots))

    # Every candidate block is listed once for each query block (one per 1024 queries); a query block is copied to
    # SLOTS tasks, so that its candidates spread.
    slots = F.explode(F.sequence(F.lit(0), F.lit(SLOTS - 1))).alias("slot")
    met = blocks.select("ids", "vectors", F.explode(F.sequence(F.lit(0), F.lit(n_asks - 1))).alias("ask"), F.pmod(F.xxhash64("block"), F.lit(SLOTS)).alias("slot"))
    pairs = met.join(asks.select("*", slots), ["ask", "slot"]).select("ids", "vectors", "q_ids", "q_vectors")

    def make():
        p = table.value

        def to_pivots(v, squares):
            d = squares[:, None] + (p**2).sum(1)[None, :] - 2 * (v @ p.T)
            return np.sqrt(np.maximum(d, 0))

        def search(ids, vectors, q_ids, q_vectors):
            # Products of components below 2^24 are exact in doubles for up to 32 dimensions of full size.
            big = max(np.abs(vectors).max(initial=0), np.abs(q_vectors).max(initial=0))
            exact = np.float64 if big * big * vectors.shape[1] < 2**52 else np.int64
            v, f = vectors.astype(exact), vectors.astype(np.float64)
            squares = (f**2).sum(1)
            far = to_pivots(f, squares)
            out = []
            for qi, qv in zip(q_ids, q_vectors):
                qf = qv.astype(np.float64)
                q_square = (qf**2).sum()
                q_far = to_pivots(qf[None, :], np.array([q_square]))[0]
                gap = np.abs(far - q_far).max(1)
                # Rounding of distances is covered by a margin.
                room = 1e-6 * (q_square + squares + 1) + 1e-3
                bound = (q_square + squares - gap**2) / 2 + room
                order, done, best, q = np.argsort(-bound, kind="stable"), 0, [], qv.astype(exact)
                while done < len(order) and (len(best) < k or bound[order[done]] >= best[-1][0]):
                    at = order[done : done + STEP]
                    done += STEP
                    score = (v[at] @ q).astype(np.int64)
                    if len(best) == k:
                        near = score >= best[-1][0]
                        at, score = at[near], score[near]
                    keep = ids[at] != qi
                    found = dict((i, s) for s, i in best)
                    for s, i in zip(score[keep].tolist(), ids[at][keep].tolist()):
                        if s > found.get(i, -(2**63)):
                            found[i] = s
                    best = sorted(((s, i) for i, s in found.items()), key=lambda x: (-x[0], x[1]))[:k]
                out += [(int(qi), i, s) for s, i in best]
            return out

        def one(batch):
            for r in range(batch.num_rows):
                q = np.zeros((len(batch.column(2)[r]), dims), np.int64)
                for i, x in enumerate(batch.column(3)[r].as_py()):
                    q[i, : len(x)] = x
                found = search(
                    np.frombuffer(batch.column(0)[r].as_py(), np.int64),
                    np.frombuffer(batch.column(1)[r].as_py(), np.int64).reshape(-1, dims),
                    np.array(batch.column(2)[r].as_py(), np.int64), q,
                )
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(x), pa.int64()) for x in (zip(*found) if found else ((), (), ()))], ["query_id", "vec_id", "score"]
                )

        return one

    near = map_batches(pairs, make, schema)
    near = near.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

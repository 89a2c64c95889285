"""End-to-end search over one corpus or many collections."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillstack.functions.text import count_words
from quillstack.functions.windows import top_per_group
from quillstack.operators import fusion
from quillstack.operators.fusion import RRF_K
from quillstack.operators.textsearch import bm25_weight, query_hits, query_terms, text_search
from quillstack.operators.vector import dense_search, filter_condition, query_literal, squared_l2, vector_problem
from quillstack.schemas import tenant_filter

IDS = ["doc_id", "chunk_id"]


@dataclass(frozen=True)
class SearchConfig:
    """``kind`` is dense, sparse or hybrid; ``fusion`` is rrf or linear; ``rerank_top_k`` fetches more than is returned."""

    kind: str = "hybrid"
    top_k: int = 10
    fusion: str = "rrf"
    rrf_k: int = RRF_K
    dense_weight: float = 0.5
    sparse_weight: float = 0.5
    rerank: bool = False
    rerank_top_k: int | None = None
    min_score: float | None = None
    filters: dict | None = None

    def __post_init__(self):
        if self.kind not in ("dense", "sparse", "hybrid"):
            raise ValueError(f"unknown search kind {self.kind}")
        if self.fusion not in ("rrf", "linear"):
            raise ValueError(f"unknown fusion {self.fusion}")
        if not 1 <= self.top_k <= 100:
            raise ValueError("top_k must be between 1 and 100")

    @property
    def fetch(self) -> int:
        return max(self.top_k, self.rerank_top_k or 0) if self.rerank else self.top_k


def hybrid_search(corpus: DataFrame, vector: list[float], text: str, config: SearchConfig) -> DataFrame:
    """Best ``2 * fetch`` of each list, fused; carries each list's score and rank."""
    wide = 2 * config.fetch
    dense = dense_search(corpus, vector, wide, IDS).select(*IDS, "score", "distance")
    dense = fusion.with_rank(dense, [F.col("distance"), *map(F.col, IDS)])
    sparse = fusion.with_rank(text_search(corpus, text, wide, IDS).select(*IDS, "score"), [F.col("score").desc(), *map(F.col, IDS)])
    if config.fusion == "rrf":
        fused = fusion.rrf(dense, sparse, IDS, config.rrf_k)
    else:
        fused = fusion.linear(dense, sparse, IDS, config.dense_weight, config.sparse_weight)
    return fused.orderBy(*fusion.fused_order(IDS)).limit(config.fetch)


def effective_kind(config: SearchConfig, vector: list[float] | None, text: str | None) -> tuple[str, list[str]]:
    """The kind of search that the request allows, and a warning for each thing it lacks."""
    if vector is None and not text:
        raise ValueError("a search needs a vector or a text")
    if config.kind in ("dense", "hybrid") and vector is None:
        return "sparse", [f"no query vector: {config.kind} search fell back to text search"]
    if config.kind in ("sparse", "hybrid") and not text:
        return "dense", [f"no query text: {config.kind} search fell back to vector search"]
    return config.kind, []


#: Takes (rank, text) of the fetched results and returns (new_rank, text) of those that an outside model ranks.
Reranker = Callable[[DataFrame], DataFrame]


def search_with_warnings(
    corpus: DataFrame, config: SearchConfig, vector: list[float] | None = None, text: str | None = None,
    user_id: int | None = None, is_admin: bool = False, reranker: Reranker | None = None,
) -> tuple[DataFrame, list[str]]:
    """The results of ``search`` and what had to be done differently."""
    return search(corpus, config, vector, text, user_id, is_admin, reranker), effective_kind(config, vector, text)[1]


def search(
    corpus: DataFrame, config: SearchConfig, vector: list[float] | None = None, text: str | None = None,
    user_id: int | None = None, is_admin: bool = False, reranker: Reranker | None = None,
) -> DataFrame:
    """Search a corpus of (collection, doc_id, chunk_id, text, vector, user_id).

    The owner rule and the filters come first. Without a vector, search falls back to text search, without a text to
    vector search, still under the owner rule. With ``rerank``, a ``reranker`` orders the fetched texts; without one the
    two lists' ranks do. Returns doc_id, chunk_id, text, score, vector and text ranks, and the final rank.
    """
    rows = tenant_filter(corpus, user_id, is_admin).filter(filter_condition(config.filters))
    kind, _ = effective_kind(config, vector, text)
    if kind == "dense":
        found = dense_search(rows, vector, config.fetch, IDS).select(*IDS, "score")
        found = fusion.with_rank(found, [F.col("score").desc(), *map(F.col, IDS)], "vector_rank")
        found = found.withColumn("fts_rank", F.lit(None).cast("int"))
    elif kind == "sparse":
        found = text_search(rows, text, config.fetch, IDS).select(*IDS, "score")
        found = fusion.with_rank(found, [F.col("score").desc(), *map(F.col, IDS)], "fts_rank")
        found = found.withColumn("vector_rank", F.lit(None).cast("int"))
    else:
        found = hybrid_search(rows, vector, text, config)
    found = found.select(*IDS, "score", "vector_rank", "fts_rank")
    if config.rerank and reranker is not None:
        return _outside_order(rows, found, config, reranker)
    if config.rerank:
        found = fusion.rrf_rerank(found, IDS, config.rrf_k)
    if config.min_score is not None:
        found = found.filter(F.col("score") >= config.min_score)
    top = found.orderBy(*fusion.fused_order(IDS)).limit(config.top_k)
    # At most top_k (100) rows: the corpus side is only filtered by them.
    texts = rows.select("collection", *IDS, "text").join(F.broadcast(top), IDS)
    return fusion.with_rank(texts, fusion.fused_order(IDS))


def _outside_order(rows: DataFrame, found: DataFrame, config: SearchConfig, reranker: Reranker) -> DataFrame:
    """The fetched results in an outside model's order; results it does not name follow. At most ``fetch`` rows."""
    if config.min_score is not None:
        found = found.filter(F.col("score") >= config.min_score)
    texts = rows.select("collection", *IDS, "text").join(F.broadcast(found), IDS)
    ranked = fusion.with_rank(texts, fusion.fused_order(IDS))
    ordered = fusion.rerank_by_texts(ranked, reranker(ranked.select("rank", "text")))
    return ordered.drop("rank", "new_rank").withColumnRenamed("final_rank", "rank").filter(F.col("rank") <= config.top_k)


def check_collections(requested: DataFrame, allowed: DataFrame, existing: DataFrame) -> DataFrame:
    """Requested collections that may not be searched, with the reason."""
    forbidden = requested.join(allowed, "collection", "left_anti").withColumn("reason", F.lit("not allowed"))
    missing = (
        requested.join(allowed, "collection", "left_semi")
        .join(existing, "collection", "left_anti").withColumn("reason", F.lit("missing"))
    )
    return forbidden.unionByName(missing)


def search_collections(
    corpus: DataFrame, requested: list[str] | None, vector: list[float], top_k: int, min_score: float = 0.0,
    user_id: int | None = None, is_admin: bool = False,
) -> DataFrame:
    """Best ``top_k`` per collection in one job, filtered by score, in one global order; None searches all collections."""
    rows = tenant_filter(corpus, user_id, is_admin)
    if requested is not None:
        rows = rows.filter(F.col("collection").isin(requested))
    scored = rows.withColumn("distance", squared_l2(F.col("vector"), query_literal(vector))).drop("vector")
    scored = scored.withColumn("score", F.lit(1.0) / (F.lit(1.0) + F.col("distance"))).filter(F.col("score") >= min_score)
    return top_per_group(scored, ["collection"], [F.col("distance"), *map(F.col, IDS)], top_k).orderBy(
        F.col("score").desc(), "collection", *IDS
    )



def text_search_collections(rows: DataFrame, text: str, top_k: int) -> DataFrame:
    """Best ``top_k`` per collection by BM25 with each collection's own statistics, in one job (columns rank, score)."""
    ids = ["collection", *IDS]
    hits = query_hits(rows, ids, query_terms(text) or [""])
    totals = rows.groupBy("collection").agg(F.count(F.lit(1)).alias("docs"), F.avg(count_words(F.col("text"))).alias("mean_len"))
    # A row for each collection and query term.
    frequencies = hits.groupBy("collection", "term").agg(F.count_if(F.col("tf") > 0).alias("df"))
    joined = hits.join(frequencies, ["collection", "term"]).join(totals, "collection")
    weight = bm25_weight(F.col("tf"), F.col("df"), F.col("doc_len"), F.col("docs"), F.col("mean_len"))
    scored = joined.withColumn("w", weight).groupBy(*ids).agg(F.round(F.sum("w"), 9).alias("bm25"))
    best = top_per_group(scored, ["collection"], [F.col("bm25").desc(), *map(F.col, IDS)], top_k)
    return best.withColumn("score", F.col("bm25") / (F.lit(1.0) + F.col("bm25"))).drop("bm25")


def search_knowledge(
    corpus: DataFrame, requested: list[str] | None, allowed: list[str] | None, config: SearchConfig, vector: list[float] | None = None,
    text: str | None = None, user_id: int | None = None, is_admin: bool = False,
) -> tuple[DataFrame, list[tuple[str, str]]]:
    """Search several collections at once, and the requested ones that were left out with the reason.

    Requested collections (None: all allowed) must be allowed (None: all) and hold rows that the user may see. The best
    ``top_k`` of each are returned in one global order, tagged with their collection. Hybrid search fuses the two lists of
    each collection by reciprocal ranks.
    """
    spark = corpus.sparkSession
    rows = tenant_filter(corpus, user_id, is_admin).filter(filter_condition(config.filters))
    existing = rows.select("collection").distinct()
    problems: list[tuple[str, str]] = []
    if requested is not None:
        asked = spark.createDataFrame([(c,) for c in dict.fromkeys(requested)], "collection string")
        permitted = asked if allowed is None else spark.createDataFrame([(c,) for c in allowed], "collection string")
        problems = sorted(tuple(r) for r in check_collections(asked, permitted, existing).select("collection", "reason").collect())
        left_out = {c for c, _ in problems}
        rows = rows.filter(F.col("collection").isin([c for c in dict.fromkeys(requested) if c not in left_out]))
    elif allowed is not None:
        rows = rows.filter(F.col("collection").isin(allowed))
    kind, _ = effective_kind(config, vector, text)
    wide = 2 * config.fetch if kind == "hybrid" else config.fetch
    keys = ["collection", *IDS]
    lists = []
    if kind in ("dense", "hybrid"):
        usable = rows.filter(vector_problem(F.col("vector"), len(vector)).isNull())
        distance = squared_l2(F.col("vector"), query_literal(vector))
        near = usable.select(*keys, distance.alias("distance"))
        near = top_per_group(near, ["collection"], [F.col("distance"), *map(F.col, IDS)], wide)
        lists.append(near.select(*keys, (F.lit(1.0) / (F.lit(1.0) + F.col("distance"))).alias("score"), F.col("rank").alias("vector_rank")))
    if kind in ("sparse", "hybrid"):
        lists.append(text_search_collections(rows, text, wide).select(*keys, "score", F.col("rank").alias("fts_rank")))
    if kind == "hybrid":
        dense, sparse = (x.drop("score") for x in lists)
        parts = [F.coalesce(F.lit(1.0) / (F.lit(config.rrf_k) + F.col(r)), F.lit(0.0)) for r in ("vector_rank", "fts_rank")]
        found = dense.join(sparse, keys, "full").withColumn("score", parts[0] + parts[1])
    else:
        found = lists[0]
        for name in ("vector_rank", "fts_rank"):
            if name not in found.columns:
                found = found.withColumn(name, F.lit(None).cast("int"))
    if config.min_score is not None:
        found = found.filter(F.col("score") >= config.min_score)
    order = [F.col("score").desc(), F.col("vector_rank").asc_nulls_last(), F.col("fts_rank").asc_nulls_last(), *map(F.col, IDS)]
    best = found.withColumn("rank", F.row_number().over(W.partitionBy("collection").orderBy(*order))).filter(F.col("rank") <= config.top_k)
    # At most top_k rows for each collection.
    texts = rows.select(*keys, "text").join(best, keys)
    return texts.orderBy(F.col("score").desc(), "collection", "rank"), problems

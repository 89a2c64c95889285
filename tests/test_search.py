import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstack.operators import fusion
from quillstack.operators import textsearch as ts
from quillstack.operators import vector as vec
from quillstack.plans.search import SearchConfig, search
from quillstack.session import load_table, shared_dir


def ranked(spark, names):
    return spark.createDataFrame([(n, 1.0 / (i + 1), i + 1) for i, n in enumerate(names)], "doc_id string, score double, rank int")


def test_rrf_values_and_order(spark):
    a, b = ranked(spark, ["d1", "d2"]), ranked(spark, ["d2", "d3"])
    for lists in ([a, b], [b, a]):
        scores = {r.doc_id: round(r.score, 3) for r in fusion.rrf_many(lists, ["doc_id"], k=1).collect()}
        assert scores == {"d2": 0.833, "d1": 0.5, "d3": 0.333}
    tied = fusion.rrf(ranked(spark, ["x"]), ranked(spark, ["a"]), ["doc_id"]).orderBy(*fusion.fused_order(["doc_id"])).collect()
    assert [r.doc_id for r in tied] == ["x", "a"]


def test_linear_fusion_without_scaling_the_lists(spark):
    dense = spark.createDataFrame([("d1", 0.8, 1), ("d2", 0.6, 2)], "doc_id string, score double, rank int")
    sparse = spark.createDataFrame([("d2", 0.7, 1), ("d3", 0.5, 2)], "doc_id string, score double, rank int")
    out = {r.doc_id: round(r.score, 3) for r in fusion.linear(dense, sparse, ["doc_id"], normalize=False).collect()}
    assert out == {"d2": 1.0, "d1": 0.375, "d3": 0.0}
    equal = spark.createDataFrame([("d1", 0.8, 1), ("d2", 0.8, 2)], "doc_id string, score double, rank int")
    none = equal.limit(0)
    assert {r.score for r in fusion.linear(equal, none, ["doc_id"]).collect()} == {0.0}
    assert {r.score for r in fusion.linear(equal, none, ["doc_id"], normalize=False).collect()} == {1.0}


def test_cjk_words_match_by_prefix(spark):
    df = spark.createDataFrame([(1, "数据库系统 design"), (2, "系统数据 design notes"), (3, "other words")], "id int, text string")
    terms = {(r.id, r.term) for r in ts.postings(df, ["id"]).collect()}
    assert {(1, "数据"), (1, "数据库"), (1, "数据库系统"), (2, "系统")} <= terms and (2, "数据") not in terms
    assert ts.query_terms("数据库 Design design") == ["数据库", "数据", "design"]
    assert [r.id for r in ts.text_search(df, "数据", 5, ["id"]).collect()] == [1]
    # No term matches the inner part of a word, so the substring scan answers.
    found = ts.text_search(df, "库系", 5, ["id"]).collect()
    assert [(r.id, r.score) for r in found] == [(1, 1.0)]


def test_index_equals_scan(spark, folder):
    docs = load_table(spark, folder, "documents")
    index = ts.TextIndex.build(docs, shared_dir(spark, "index"), ["doc_id"], buckets=4)
    query = "the in of thanen"
    a = [(r.doc_id, r.score) for r in index.search(spark, query, 15).collect()]
    b = [(r.doc_id, r.score) for r in ts.bm25_scan(docs, query, 15, ["doc_id"]).collect()]
    assert a == b and len(a) == 15


def test_many_queries_equal_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = rng.normal(size=(300, 8)).astype("float32")
    corpus = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(rows)], "vec_id long, vector array<float>").repartition(7)
    asked = rng.normal(size=(23, 8))
    queries = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(asked)], "query_id long, vector array<double>")
    monkeypatch.setattr(vec, "QUERY_BLOCK", 10)
    got = {}
    for r in vec.dense_search_many(corpus, queries, 5).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
    exact = ((rows.astype("float64")[None] - asked[:, None]) ** 2).sum(axis=2)
    for q in range(23):
        assert [v for _, v in sorted(got[q])] == list(np.argsort(exact[q], kind="stable")[:5])


def test_cell_index_recall(spark, folder):
    vectors = load_table(spark, folder, "embeddings").withColumnRenamed("embedding", "vector")
    index = vec.CellIndex.build(vectors, shared_dir(spark, "cells"), 10)
    hits = total = 0
    for row in vectors.filter("vec_id < 5").collect():
        exact = {r.vec_id for r in vec.dense_search(vectors, row["vector"], 10, ["vec_id"]).collect()}
        near = {r.vec_id for r in index.search(spark, row["vector"], 10, ["vec_id"], 5).collect()}
        hits, total = hits + len(exact & near), total + len(exact)
    assert hits / total >= 0.7


def test_bad_query_vectors():
    for bad in ([], [float("nan")], [float("inf")]):
        with pytest.raises(ValueError):
            vec.query_literal(bad)
    with pytest.raises(ValueError):
        vec.query_literal([1.0], dim=2)


def test_owner_rule_holds_in_every_kind_of_search(spark):
    random.seed(1)
    rows = [("c", i, 0, f"alpha word{i % 3}", [float(i), 1.0], (None, 1, 2)[i % 3]) for i in range(30)]
    corpus = spark.createDataFrame(rows, "collection string, doc_id long, chunk_id int, text string, vector array<double>, user_id long")
    for kind in ("dense", "sparse", "hybrid"):
        config = SearchConfig(kind=kind, top_k=20)
        mine = search(corpus, config, [0.0, 1.0], "alpha", user_id=1).collect()
        assert len(mine) == 10 and all(r.doc_id % 3 == 1 for r in mine)
        assert search(corpus, config, [0.0, 1.0], "alpha").count() == 0
        assert search(corpus, config, [0.0, 1.0], "alpha", is_admin=True).count() == 20
    # Without a vector the search falls back to text, for the same owner; a substring hit keeps the rule too.
    fallback = search(corpus, SearchConfig(top_k=20), None, "lpha word", user_id=2).collect()
    assert len(fallback) == 10 and all(r.doc_id % 3 == 2 for r in fallback)
    with pytest.raises(ValueError):
        SearchConfig(top_k=0)


def test_prompt_needs_a_template(spark):
    with pytest.raises(ValueError):
        fusion.generation_prompt(spark.createDataFrame([("x",)], "context string"), "")

"""Quantised search, its unindexed tail and its upkeep; exact search over broken vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstack.operators import vector as vec
from quillstack.operators import vectorindex as vix
from quillstack.session import load_table, shared_dir


def exact(rows, query, k):
    return [r["vec_id"] for r in vec.dense_search(rows, query, k, ["vec_id"]).collect()]


@pytest.fixture(scope="module")
def rows(spark):
    return load_table(spark, "/root/testdata/sf0.01", "embeddings").withColumnRenamed("embedding", "vector")


@pytest.fixture(scope="module")
def index(spark, rows):
    return vix.VectorIndex.build(rows, shared_dir(spark, "ivf"), "vec_id", cells=16)


def test_recall_over_the_whole_table(rows, index):
    queries = [r["vector"] for r in rows.orderBy("vec_id").limit(15).collect()]
    found = {}
    for probes, refine in ((16, None), (16, 10), (12, 10)):
        hits = [len(set(exact(rows, q, 10)) & {r["vec_id"] for r in index.search(q, 10, probes, refine).collect()}) for q in queries]
        found[probes, refine] = sum(hits) / (10 * len(queries))
    assert found[16, 10] >= 0.98 and found[12, 10] >= 0.9 and found[16, None] <= found[16, 10]


def test_refining_all_rows_is_exact(rows, index):
    query = [0.1] * 64
    assert [r["vec_id"] for r in index.search(query, 7, 16, 1000).collect()] == exact(rows, query, 7)
    some = rows.filter("label = 3")
    assert [r["vec_id"] for r in index.search(query, 7, 16, 1000, {"label": 3}).collect()] == exact(some, query, 7)


def test_codes_take_a_byte_a_stretch(index):
    stored = index.rows_table.read()
    assert stored.select(F.size("code")).distinct().collect()[0][0] == 8
    assert index.rows_table.read().select("cell").distinct().count() <= 16


def test_changes_equal_a_fresh_build(spark, rows):
    """Appends, replacements, deletions and revivals, before and after they are folded in, in two rounds."""
    index = vix.VectorIndex.build(rows.filter("vec_id < 300"), shared_dir(spark, "ivf"), "vec_id", cells=8)
    query, live = [0.05] * 64, {r["vec_id"]: r["vector"] for r in rows.filter("vec_id < 300").collect()}

    def check():
        now = sorted(live, key=lambda i: (float(((np.array(live[i], float) - 0.05) ** 2).sum()), i))[:20]
        assert [r["vec_id"] for r in index.search(query, 20, 99, 1000).collect()] == now
        assert index.rows().count() == len(live)

    every = {r["vec_id"]: r["vector"] for r in rows.collect()}
    for turn in range(2):
        low, high = 300 + 100 * turn, 400 + 100 * turn
        index.upsert(rows.filter(f"vec_id >= {low} AND vec_id < {high}"))
        live |= {i: every[i] for i in range(low, high)}
        index.delete(rows.filter(f"vec_id % 7 = {turn}"))
        live = {i: v for i, v in live.items() if i % 7 != turn}
        moved = rows.filter("vec_id < 21").withColumn("vector", F.transform("vector", lambda x: x * 0.1))
        index.upsert(moved)
        live |= {r["vec_id"]: r["vector"] for r in moved.collect()}
        check()
        plan = index.plan().first()
        assert plan["reindex"] and plan["unindexed"] > 0
        assert index.maintain(least=16)
        assert index.plan().first()[1:] == (0, 0, False)
        assert not index.maintain()
        check()


def test_a_grown_cell_is_split(spark):
    rnd = np.random.default_rng(1)
    near = [(i, (rnd.normal(size=4) + 10 * (i % 4)).tolist()) for i in range(200)]
    schema = "id long, vector array<double>"
    index = vix.VectorIndex.build(spark.createDataFrame(near, schema), shared_dir(spark, "ivf"), "id", cells=4, stretches=2)
    grown = [(1000 + i, (rnd.normal(size=4) + [100 + 40 * (i % 2), 0, 0, 0]).tolist()) for i in range(900)]
    index.upsert(spark.createDataFrame(grown, schema))
    cells = len(index.model()[1].centroids)
    assert index.maintain()
    assert len(index.model()[1].centroids) > cells
    assert index.rows_table.read().groupBy("cell").count().agg(F.max("count")).first()[0] < 900
    assert index.search([100.0, 0, 0, 0], 5, 1, 20).filter("id >= 1000").count() == 5


def test_odd_vectors(spark):
    schema = "id long, vector array<double>"
    with pytest.raises(ValueError):
        vix.VectorIndex.build(spark.createDataFrame([(1, None)], schema), shared_dir(spark, "ivf"), "id")
    index = vix.VectorIndex.build(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, None]), (3, None), (4, [1.0, 2.0])], schema), shared_dir(spark, "ivf"), "id")
    assert [r["id"] for r in index.search([0.0, 0.0], 9).collect()] == [1, 4]
    with pytest.raises(ValueError):
        index.upsert(spark.createDataFrame([(9, [1.0])], schema))


def test_exact_search_leaves_broken_vectors_out(spark):
    nan, inf = float("nan"), float("inf")
    rows = spark.createDataFrame(
        [(1, [1.0, None]), (2, [0.1, 0.2]), (3, [0.0, 0.0]), (4, [nan, 0.0]), (5, [inf, 0.0]), (6, [0.0]), (7, None), (8, [])],
        "vec_id long, vector array<double>",
    )
    assert exact(rows, [0.0, 0.0], 9) == [3, 2]
    queries = spark.createDataFrame([(1, [0.0, 0.0]), (2, [inf, 1.0]), (3, [None, 1.0])], "query_id long, vector array<double>")
    assert [(r["query_id"], r["vec_id"]) for r in vec.dense_search_many(rows, queries, 9).orderBy("rank").collect()] == [(1, 3), (1, 2)]

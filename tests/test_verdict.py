"""Cases outside the test tables: ties, null vectors, broken writes, changed documents, character references, robots."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstack.operators import collections as co
from quillstack.operators import vector as vec
from quillstack.operators import web
from quillstack.operators.chunk import ChunkConfig
from quillstack.plans.ingest import empty_state, ingest
from quillstack.session import shared_dir
from quillstack.sources.snapshots import SnapshotTable
from quillstack.streaming import streams


def test_many_queries_with_ties_nulls_and_large_norms(spark):
    rnd = np.random.default_rng(1)
    rows = [(i, [1.0, 2.0]) for i in range(1, 201)] + [(300 + i, [1e8 + i * 1e-3, 1e8]) for i in range(100)]
    rows += [(500, None), (501, [1.0, None]), (502, [1.0]), (503, [])]
    rows += [(600 + i, rnd.normal(size=2).tolist()) for i in range(300)]
    corpus = spark.createDataFrame(rows, "vec_id long, vector array<double>")
    queries = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [1e8, 1e8]), ("c", None), ("d", [0.1, 0.2])], "query_id string, vector array<double>")
    found = {}
    for r in vec.dense_search_many(corpus.repartition(5), queries, 5).orderBy("query_id", "rank").collect():
        found.setdefault(r["query_id"], []).append(r["vec_id"])
    plain = {i: np.array(v) for i, v in rows if v and len(v) == 2 and None not in v}
    want = {
        q: [i for _, i in sorted((((v - np.array(x)) ** 2).sum(), i) for i, v in plain.items())[:5]]
        for q, x in (("a", [1.0, 2.0]), ("b", [1e8, 1e8]), ("d", [0.1, 0.2]))
    }
    assert found == want and found["a"] == [1, 2, 3, 4, 5]
    assert vec.dense_search_many(corpus, queries.limit(0), 5).count() == 0


def test_snapshot_after_a_broken_write(spark):
    table = SnapshotTable(spark, shared_dir(spark, "broken"))
    table.write(spark.range(3))
    with pytest.raises(Exception, match="boom"):
        table.write(spark.range(3).select(F.raise_error(F.lit("boom")).alias("id")))
    for n in (4, 5, 6, 7):
        table.write(spark.range(n))
    assert table.read().count() == 7 and table.versions() == [3, 4, 5, 6]


def test_changed_documents_are_ingested_anew(spark):
    day = datetime.datetime(2024, 1, 1)
    schema = "collection string, source_path string, content string, uploaded_at timestamp, user_id long"
    config = ChunkConfig(size=10, overlap=0)

    def run(state, *rows):
        result = ingest(state, spark.createDataFrame([(*r[:3], day, r[3]) for r in rows], schema), config)
        return {"documents": result.documents, "chunks": result.chunks, "embeddings": result.embeddings}

    first = spark.createDataFrame([], schema)
    state = run(empty_state(first), ("c", "a.txt", "alpha beta gamma delta", 1), ("c", "b.txt", "one two", 2))
    again = run(state, ("c", "a.txt", "alpha beta gamma delta", 1))
    assert again["chunks"].count() == state["chunks"].count()
    changed = run(state, ("c", "a.txt", "omega", 1))
    assert {(r["text"], r["user_id"]) for r in changed["chunks"].collect()} == {("omega", 1), ("one two", 2)}
    ids = {r["chunk_id"] for r in changed["chunks"].collect()}
    assert {r["chunk_id"] for r in changed["embeddings"].collect()} == ids
    assert {r["user_id"] for r in changed["embeddings"].collect()} == {1, 2}


def test_character_references(spark):
    cases = {
        "Bob&#8217;s caf&eacute;": "Bob’s café", "&amp;lt; &#x1F600; &bogus; & &#0; &#xD800;": "&lt; 😀 &bogus; & &#0; &#xD800;",
        "no reference": "no reference", "a&nbsp;b&apos;&": "a b'&",
    }
    rows = spark.createDataFrame([(k,) for k in cases], "t string").select("t", web.unescape(F.col("t")).alias("u"))
    assert {r["t"]: r["u"] for r in rows.collect()} == cases


def test_nested_title(spark):
    row = spark.createDataFrame([("<h1><span>Hel&amp;lo</span> you</h1>",)], "h string").select(web.page_title(F.col("h")))
    assert row.first()[0] == "Hel&lo you"


def test_robots_own_group_hides_the_general_one(spark):
    rules = spark.createDataFrame([("x.com", "*", "/", False), ("x.com", "me", "/private", False), ("y.com", "*", "/", False)], "host string, agent string, prefix string, allow boolean")
    urls = spark.createDataFrame([("http://x.com/a",), ("http://x.com/private/b",), ("http://y.com/a",)], "url string")
    found = {r["url"]: r["allowed"] for r in web.robots_allowed(urls, rules, "me").collect()}
    assert found == {"http://x.com/a": True, "http://x.com/private/b": False, "http://y.com/a": False}


def test_counts_without_documents(spark):
    chunks = spark.createDataFrame([("c",)], "collection string")
    assert co.collection_counts({"chunks": chunks}).first()["names"] == 0


def test_unfinished_jobs_are_kept(spark):
    path = shared_dir(spark, "jobs")
    hour = [0, 0, 1, 200, 400, 600]
    for n, h in enumerate(hour):
        ts = datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=h)
        rows = [("1" if n != 3 else "2", f"s{n}", ts, n == 0)]
        frame = spark.createDataFrame(rows, "job string, step string, ts timestamp, done boolean")
        frame.selectExpr("cast(job as long) job", "step", "ts", "done").coalesce(1).write.mode("append").parquet(path)
    events = spark.readStream.schema("job long, step string, ts timestamp, done boolean").option("maxFilesPerTrigger", 1).parquet(path)
    parts = streams.run_to_table(streams.job_progress(events), ["job", "part"])
    rows = {r["job"]: (r["steps"], r["finished"]) for r in streams.job_totals(parts).collect()}
    assert rows[1] == (5, 1)

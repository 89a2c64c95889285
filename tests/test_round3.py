"""Faults that the third review found."""

import datetime

import pandas as pd
from pyspark.sql import functions as F

import __spark_entry__ as entry
from check_oracle import compare, duck
from quillstack.operators import chunk as ck
from quillstack.operators import runlog as rl
from quillstack.operators import textsearch as ts
from quillstack.plans.ingest import empty_state, ingest
from quillstack.streaming import streams as st


def test_context_reads_every_event(spark, folder, tmp_path):
    """e19: signups and dear events belong to the job; the operator still leaves starts and builds out."""
    from quillstack.session import load_table

    events = load_table(spark, folder, "events").filter("event_type = 'signup' OR value >= 90")
    path = str(tmp_path / "tables")
    events.write.parquet(f"{path}/events.parquet")
    users = {r[0] for r in events.filter("event_id % 9 <> 0 AND value > 20").select("user_id").distinct().collect()}
    found = {r["user_id"] for r in entry.queries()["e19_execution_context"](spark, path).collect()}
    assert found and found <= users
    rows = [(1, 1, i, "t", True, f"r{i}", kind, build) for i, (kind, build) in enumerate(
        [(rl.TOOL_END, None), ("tool_execution_start", None), (rl.TOOL_END, "b")])]
    df = spark.createDataFrame(rows, "task long, ts long, event_id long, tool string, success boolean, result string, event_type string, build_id string")
    assert [r["lines"] for r in rl.execution_context(df, "task").collect()] == [1]


def test_context_sql_covers_every_event(spark, folder):
    ok, message, _, _ = compare(spark, duck(folder), folder, "e19", entry.queries()["e19_execution_context"], entry.oracle_sql()["e19_execution_context"])
    assert ok, message


def test_pages_of_one_url_and_time_give_one_document(spark):
    """w11: the hash that is reported is that of the text that is chunked, the greatest of equally late ones."""
    at = datetime.datetime(2024, 1, 1)
    texts = [f"{chr(97 + i)} " * (40 * (i + 1)) for i in range(12)]
    rows = [("web", f"http://a.com/{u}", t, at) for u in range(6) for t in texts[u:] + texts[:u]]
    incoming = spark.createDataFrame(rows, "collection string, source_path string, content string, uploaded_at timestamp").repartition(5)
    done = ingest(empty_state(incoming), incoming, ck.ChunkConfig(80, 10))
    want = spark.range(1).select(F.sha2(F.lit(max(texts)), 256)).first()[0]
    assert {(r["content_hash"], r["chunks"] > 10) for r in done.report.collect()} == {(want, True)}
    assert {r["text"][0] for r in done.chunks.collect()} == {"l"}
    assert {r["content_hash"] for r in done.documents.collect()} == {want}


def test_postings_move_texts_not_words(spark):
    """f1: one exchange, of the texts; copies of an id and scripts with prefixes keep their places."""
    rows = [(1, "b a b"), (2, None), (3, ""), (4, "日本語 a"), (5, "x y"), (5, "y z w")]
    df = spark.createDataFrame(rows, "id long, text string")
    found = ts.postings(df, ["id"])
    got = {(r["id"], r["term"]): (r["tf"], r["positions"], r["doc_len"]) for r in found.collect()}
    assert got == {
        (1, "b"): (2, [0, 2], 3), (1, "a"): (1, [1], 3), (4, "日本語"): (1, [0], 2), (4, "日本"): (1, [0], 2), (4, "a"): (1, [1], 2),
        (5, "x"): (1, [0], 3), (5, "y"): (2, [0, 1], 3), (5, "z"): (1, [1], 3), (5, "w"): (1, [2], 3),
    }
    found = ts.postings(df, ["id"])  # planned anew: a plan that has run shows its stages twice
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Generate" not in plan, plan


def test_a_new_part_looks_nothing_up():
    """r5: a part's first report costs no look-up of its steps or timers; repeated steps of a batch are written once."""
    calls = []

    class Store:
        def __init__(self, name, found):
            self.name, self.found = name, found

        def __getattr__(self, what):
            return lambda *args: (calls.append((self.name, what)), self.found)[1]

    class Times:
        def getCurrentWatermarkInMs(self):
            return 0

    step_counts = st.StepCounts()
    step_counts.done, step_counts.counts, step_counts.handle = Store("done", None), Store("counts", None), Store("timers", None)
    rows = pd.DataFrame({"step": ["a", "b", "a", None], "done": [False, True, True, True], "at": [1, 2, 3, 4], "ts": pd.to_datetime([1, 2, 3, 4], unit="ms")})
    out = next(step_counts.handleInputRows((7, 0), iter([rows]), Times()))
    assert out.values.tolist() == [[7, 0, 2, 2]]
    assert calls == [("counts", "get"), ("done", "updateValue"), ("done", "updateValue"), ("counts", "update"), ("timers", "registerTimer")]

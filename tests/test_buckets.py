"""Bucket tables: only touched buckets are written, changes can be repeated; streams that keep them; steps counted once."""

import datetime
import os

import pytest
from pyspark.sql import functions as F

from quillstack.session import load_table, shared_dir
from quillstack.sources.buckets import BucketTable
from quillstack.streaming import streams as st


def frame(spark, rows):
    return spark.createDataFrame(rows, "k long, v long")


def state(table):
    return {r["k"]: r["v"] for r in table.read().collect()}


def written(table, version):
    root = f"{table.root}/data/v={version}".removeprefix("file:")
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, files in os.walk(root) for f in files if f.endswith(".parquet"))


def test_changes_write_the_buckets_they_touch(spark):
    table = BucketTable(spark, shared_dir(spark, "b"), ["k"], buckets=16)
    want = {k: k * 7 % 1000 for k in range(40_000)}
    first = table.upsert(frame(spark, list(want.items())))
    one = table.upsert(frame(spark, [(5, -1)]))
    want[5] = -1
    assert state(table) == want
    assert 0 < written(table, one) < written(table, first) / 8
    new = table.upsert(frame(spark, [(100_000, 1), (100_000, 9)]), order=["v"])
    want[100_000] = 9
    assert state(table) == want and written(table, new) < written(table, first) / 8
    # The same change again gives the same rows.
    table.upsert(frame(spark, [(5, -1)]))
    assert state(table) == want
    table.delete(frame(spark, [(k, 0) for k in range(0, 40_000, 2)]))
    assert state(table) == {k: v for k, v in want.items() if k % 2 or k >= 40_000}


def test_a_broken_commit_is_not_read_and_a_bucket_can_be_emptied(spark):
    table = BucketTable(spark, shared_dir(spark, "b"), ["k"], buckets=3)
    table.upsert(frame(spark, [(k, k) for k in range(9)]))
    # A change whose data was written, but not its mark.
    frame(spark, [(1, 99)]).withColumn("bucket", F.lit(0)).write.partitionBy("bucket").parquet(f"{table.root}/data/v=2")
    assert state(table) == {k: k for k in range(9)}
    table.delete(frame(spark, [(k, 0) for k in range(9)]))
    assert state(table) == {} and table.read().columns == ["k", "v"]
    table.upsert(frame(spark, [(3, 4)]))
    assert state(table) == {3: 4}
    assert table.upsert(frame(spark, [])) is None and table.delete(frame(spark, [])) is None
    with pytest.raises(FileNotFoundError):
        BucketTable(spark, shared_dir(spark, "b"), ["k"]).read()


def test_replaced_commits_go(spark):
    table = BucketTable(spark, shared_dir(spark, "b"), ["k"], buckets=2, keep=1)
    for n in range(6):
        table.upsert(frame(spark, [(k, n) for k in range(8)]))
    assert state(table) == {k: 5 for k in range(8)} and len(table.versions()) <= 3


def test_a_late_row_does_not_replace_a_better_one(spark):
    table = BucketTable(spark, shared_dir(spark, "b"), ["k"], buckets=2)
    for rows in ([(1, 5), (2, 1)], [(1, 3)], [(2, 8), (2, 2)], [(1, 5)]):
        table.upsert(frame(spark, rows), ["v"], keep_best=True)
    assert state(table) == {1: 5, 2: 8}


def test_small_batches_write_little(spark, folder):
    """One tool's events arrive after all others: its batch rewrites one bucket."""
    path, events = shared_dir(spark, "late-tool"), load_table(spark, folder, "events").withColumn("tool", F.col("user_id").cast("string"))
    one = events.agg(F.min("tool")).first()[0]
    events.filter(F.col("tool") != one).coalesce(1).write.mode("append").parquet(path)
    table, checkpoint = BucketTable(spark, shared_dir(spark, "tools"), ["tool"], buckets=8), shared_dir(spark, "tools-checkpoint")

    def run():
        stream = st.read_stream(spark, path, events.schema)
        st.upsert_sink(st.tool_counters(stream, "tool", F.col("value") > 20), table, ["tool"], checkpoint).awaitTermination()

    run()
    events.filter(F.col("tool") == one).coalesce(1).write.mode("append").parquet(path)
    run()
    batch = st.tool_counters(events, "tool", F.col("value") > 20)
    assert sorted(map(str, table.read().collect())) == sorted(map(str, batch.select(*table.read().columns).collect()))
    first, last = table.versions()[0], table.versions()[-1]
    assert written(table, last) < written(table, first) / 2
    buckets = spark.read.parquet(f"{table.root}/commits/v={last}").count()
    assert buckets == 1


def test_a_step_reported_twice_counts_once(spark):
    path, start = shared_dir(spark, "steps"), datetime.datetime(2024, 1, 1)
    batches = [
        [(1, "a", 0, False), (1, "a", 0, False), (1, "b", 0, True), (2, "x", 0, True)],
        [(1, "a", 1, True), (1, "b", 1, False), (1, "c", 1, False)],
        [(1, "a", 2, True)],
        # Four days later job 2 is forgotten; the same step is then a new one of a new run.
        [(3, "q", 96, False)], [(3, "q", 97, True)], [(2, "x", 98, False)],
    ]
    schema = "job long, step string, ts timestamp, done boolean"
    for rows in batches:
        rows = [(j, s, start + datetime.timedelta(hours=h), d) for j, s, h, d in rows]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    events = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    parts = st.run_to_table(st.job_progress(events, "1 hour"), ["job", "part"])
    found = {r["job"]: (r["steps"], r["finished"]) for r in st.job_totals(parts).collect()}
    assert found[1] == (3, 2) and found[3] == (1, 1) and found[2] == (1, 0)


def test_live_segments_equal_the_batch(spark):
    """Segments in several files out of order; what is closed equals the batch operator's result."""
    from quillstack.operators.runlog import merge_segments

    base = datetime.datetime(2024, 1, 1)
    rows, at = [], 0.0
    for i in range(120):
        at += [1.0, 3.0, 2.0, 40.0][i * 7 % 4]
        rows.append((i % 2, i, at, at + [0.5, 2.0, 5.0][i % 3], "ab"[i // 4 % 2], f"t{i}", i / 3 if i % 5 else None, base + datetime.timedelta(seconds=at)))
    rows.append((0, 999, 10_000.0, 10_001.0, "z", "end", None, base + datetime.timedelta(seconds=10_000)))
    schema = "room long, order long, start double, end double, speaker string, text string, confidence double, ts timestamp"
    every, path = spark.createDataFrame(rows, schema), shared_dir(spark, "talk")
    for part in range(3):
        every.filter(F.col("order") % 3 == part).coalesce(1).write.mode("append").parquet(path)
    table = BucketTable(spark, shared_dir(spark, "merged"), ["room", "session", "island"])
    talk = st.live_segments(st.read_stream(spark, path, every.schema), ["room"], 4.0, "1 minute")
    st.merged_segments_sink(talk, table, ["room"], 4.0, shared_dir(spark, "merged-checkpoint")).awaitTermination()
    columns = ["room", "speaker", "start", "end", "text", "confidence", "segments"]
    batch = merge_segments(every.filter("order <> 999"), ["room"], 4.0)
    assert sorted(map(str, table.read().select(*columns).collect())) == sorted(map(str, batch.select(*columns).collect()))


def test_rows_are_counted_by_the_write(spark):
    from quillstack.sources.snapshots import SnapshotTable

    table = SnapshotTable(spark, shared_dir(spark, "counted"))
    table.write(frame(spark, [(k, None if k == 9 else k * 10) for k in range(10)]))
    assert table.update("v >= 50", {"v": "v + k", "k": F.col("k") + 100}) == 4
    assert state(table) == {0: 0, 1: 10, 2: 20, 3: 30, 4: 40, 105: 55, 106: 66, 107: 77, 108: 88, 9: None}
    assert table.delete(F.col("v") > 60) == 3 and table.delete("v > 60") == 0
    assert sorted(state(table)) == [0, 1, 2, 3, 4, 9, 105]

"""Streams fed by several files against the batch result."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from check_oracle import compare, duck
from quillstack.session import load_table, shared_dir
from quillstack.sources.snapshots import SnapshotTable
from quillstack.streaming import streams as st


@pytest.fixture(scope="module")
def split_events(spark, folder):
    """Events in four files by id, so their order in the stream is not the order of time."""
    path = shared_dir(spark, "split-events")
    events = load_table(spark, folder, "events")
    for part in range(4):
        events.filter(F.col("event_id") % 4 == part).coalesce(1).write.mode("append").parquet(path)
    return path, events


def test_counters_over_several_batches_and_a_second_run(spark, split_events):
    path, events = split_events
    table, checkpoint = SnapshotTable(spark, shared_dir(spark, "tools")), shared_dir(spark, "tools-checkpoint")

    def run():
        stream = st.read_stream(spark, path, events.schema, files_per_trigger=1)
        counters = st.tool_counters(stream, "event_type", F.col("value") > 20)
        st.upsert_sink(counters, table, ["event_type"], checkpoint).awaitTermination()
        return sorted(map(str, table.read().select("event_type", "usage_count", "success_count", "last_used_at").collect()))

    batch = st.tool_counters(events, "event_type", F.col("value") > 20)
    expected = sorted(map(str, batch.select("event_type", "usage_count", "success_count", "last_used_at").collect()))
    assert run() == expected
    assert len(table.versions()) == 4
    # Nothing new has arrived: the second run changes nothing.
    assert run() == expected


def test_events_are_persisted_once(spark, split_events):
    path, events = split_events
    stream = st.read_stream(spark, path, events.schema, files_per_trigger=2)
    again = st.read_stream(spark, path, events.schema, files_per_trigger=2)
    tasks = events.select("user_id").distinct().filter("user_id % 2 = 0")
    kept = st.run_to_files(st.known_events(stream.unionByName(again), tasks, "user_id", "60 days"), "kept")
    assert kept.count() == kept.select("event_id").distinct().count() == events.filter("user_id % 2 = 0").count()


@pytest.mark.parametrize("name", [n for n in entry.queries() if n.startswith("r")])
def test_stream_queries(spark, folder, name):
    ok, message, _, _ = compare(spark, duck(folder), folder, name, entry.queries()[name], entry.oracle_sql().get(name))
    assert ok or message == "rows=0 EMPTY", message

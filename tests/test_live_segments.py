"""Live segments: state partitions follow the input, and a micro-batch goes through its state once."""

from quillstack.registry import streams as queries
from quillstack.session import shared_dir
from quillstack.sources.buckets import BucketTable
from quillstack.streaming import streams as st


def test_partitions_follow_the_input_and_state_is_read_once(spark, folder, monkeypatch):
    cached, made, upsert, usual = [], [], BucketTable.upsert, spark.conf.get(st.PARTITIONS)

    def seen(self, changes, *args, **kwargs):
        cached.append("InMemoryTableScan" in changes._jdf.queryExecution().executedPlan().toString())
        return upsert(self, changes, *args, **kwargs)

    monkeypatch.setattr(BucketTable, "upsert", seen)
    monkeypatch.setattr(queries, "shared_dir", lambda spark, label: made.append(shared_dir(spark, label)) or made[-1])
    monkeypatch.setattr(st, "PARTITION_BYTES", 2048)
    parts = st.partitions_for(spark, f"{folder}/{{events.parquet}}")
    assert parts > int(usual)
    assert queries.r6_live(spark, folder).count() > 0
    state = spark._jvm.org.apache.hadoop.fs.Path(f"{made[1]}/state/0")
    held = state.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(state)
    assert sum(x.getPath().getName().isdigit() for x in held) == parts
    assert cached and all(cached) and spark.conf.get(st.PARTITIONS) == usual

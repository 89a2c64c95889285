"""Event consumers as Structured Streaming queries.

Every function takes and returns a streaming DataFrame, or starts a query with an explicit checkpoint folder. With
``available_now`` a query works off what is there and stops, which is also how a scheduled incremental run is done.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from quillstack.functions.arrays import explode_items
from quillstack.operators.chunk import fixed_size_chunks
from quillstack.operators.runlog import merge_segments
from quillstack.operators.upsert import upsert
from quillstack.session import shared_dir
from quillstack.sources.buckets import BucketTable
from quillstack.sources.snapshots import SnapshotTable


def read_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int | None = None) -> DataFrame:
    """Parquet files arriving at ``path`` as a stream; zone-less timestamps become UTC timestamps."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    df = reader.parquet(path)
    for field in schema.fields:
        if isinstance(field.dataType, T.TimestampNTZType):
            df = df.withColumn(field.name, F.col(field.name).cast("timestamp"))
    return df


PARTITIONS, PARTITION_BYTES = "spark.sql.shuffle.partitions", 1 << 20


def partitions_for(spark: SparkSession, path: str) -> int:
    """State partitions for the files at ``path``: one for each ``PARTITION_BYTES`` of them, no fewer than the session's."""
    pattern = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = pattern.getFileSystem(spark._jsc.hadoopConfiguration())
    size = sum(system.getContentSummary(found.getPath()).getLength() for found in system.globStatus(pattern) or [])
    return max(int(spark.conf.get(PARTITIONS)), -(-size // PARTITION_BYTES))


def _started(batch_function, df: DataFrame, checkpoint: str, mode: str, available_now: bool, seconds: int) -> StreamingQuery:
    writer = df.writeStream.foreachBatch(batch_function).outputMode(mode).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=f"{seconds} seconds")).start()


def upsert_sink(
    df: DataFrame, table: SnapshotTable | BucketTable, keys: list[str], checkpoint: str, mode: str = "update", available_now: bool = True,
    seconds: int = 5, best: list | None = None,
) -> StreamingQuery:
    """Keep a table current. Rows carry absolute values, so a batch that is replayed changes nothing.

    A bucket table rewrites the buckets of the batch's keys only. ``best`` (bucket tables) keeps the last row of a key in
    that order, stored ones included.
    """

    def merge(batch: DataFrame, _: int) -> None:
        batch = batch.persist()  # the touched buckets and the rows are read from it
        try:
            if isinstance(table, BucketTable):
                table.upsert(batch, best, keep_best=best is not None)
            elif not batch.isEmpty():
                table.write(upsert(table.read(), batch, keys) if table.versions() else batch)
        finally:
            batch.unpersist()

    return _started(merge, df, checkpoint, mode, available_now, seconds)


def parquet_sink(
    df: DataFrame, path: str, checkpoint: str, available_now: bool = True, seconds: int = 5
) -> StreamingQuery:
    """Append to Parquet files, exactly once."""
    writer = df.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=f"{seconds} seconds")).start()


def run_to_table(df: DataFrame, keys: list[str], mode: str = "update", label: str = "stream", best: list | None = None) -> DataFrame:
    """Work off the stream into a bucket table in the shared folder and return its final state."""
    spark = df.sparkSession
    table = BucketTable(spark, shared_dir(spark, label), keys)
    upsert_sink(df, table, keys, shared_dir(spark, f"{label}-checkpoint"), mode, best=best).awaitTermination()
    return table.read() if table.versions() else spark.createDataFrame([], df.schema)


def run_to_files(df: DataFrame, label: str = "stream") -> DataFrame:
    """Work off the stream into Parquet files in the shared folder and read them back."""
    spark = df.sparkSession
    path = shared_dir(spark, label)
    parquet_sink(df, path, shared_dir(spark, f"{label}-checkpoint")).awaitTermination()
    return spark.read.schema(df.schema).parquet(path)


def tool_counters(events: DataFrame, tool: str, success: Column) -> DataFrame:
    """Running use, success and error counts and last use per tool. Partial sums keep a busy tool's rows apart."""
    return events.groupBy(tool).agg(
        F.count(F.lit(1)).alias("usage_count"), F.count_if(success).alias("success_count"),
        F.count_if(~success).alias("error_count"), F.max("ts").alias("last_used_at"),
    )


def paired_events(
    starts: DataFrame, ends: DataFrame, keys: list[str], cutoff_seconds: int, salts: int = 4
) -> DataFrame:
    """Every end within ``cutoff_seconds`` after a start of the same keys.

    Both sides forget what is older than the cut-off. Starts of one key are spread over ``salts`` state partitions,
    ends are sent to each of them.
    """
    limit = f"{cutoff_seconds} seconds"
    left = starts.select(*keys, F.col("ts").alias("start_ts"), F.col("event_id").alias("start_id"))
    left = left.withColumn("__salt", F.pmod(F.xxhash64("start_id"), F.lit(salts)).cast("int")).withWatermark("start_ts", limit)
    right = ends.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("ts").alias("end_ts"), F.col("event_id").alias("end_id"))
    right = right.withColumn("__salt2", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).withWatermark("end_ts", limit)
    condition = (F.col("__salt") == F.col("__salt2")) & (F.col("end_ts") > F.col("start_ts")) & (
        F.col("end_ts") <= F.col("start_ts") + F.make_dt_interval(secs=F.lit(cutoff_seconds))
    )
    for key in keys:
        condition = condition & (F.col(key) == F.col(f"__{key}"))
    seconds = (F.unix_micros("end_ts") - F.unix_micros("start_ts")) / F.lit(1_000_000)
    return left.join(right, condition, "inner").select(*keys, "start_id", "end_id", seconds.alias("seconds"))


def calls_per_day(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Events per day: in append mode written once a day can receive no more events, in update mode the running day as well."""
    windowed = events.withWatermark("ts", late).groupBy(F.window("ts", "1 day")).agg(F.count(F.lit(1)).alias("calls"))
    return windowed.select(F.col("window.start").alias("day"), "calls")


def token_totals(usage: DataFrame, task: str = "task") -> DataFrame:
    return usage.groupBy(task).agg(
        F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.count(F.lit(1)).alias("calls")
    )


def sessions(events: DataFrame, keys: list[str], gap: str, late: str) -> DataFrame:
    """Runs of events of one key without a pause longer than ``gap``, written once they are closed."""
    grouped = events.withWatermark("ts", late).groupBy(*keys, F.session_window("ts", gap)).agg(F.count(F.lit(1)).alias("events"))
    return grouped.select(
        *keys, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "events"
    )


def live_segments(segments: DataFrame, keys: list[str], max_gap: float, late: str) -> DataFrame:
    """Talk of each key without a pause of over ``max_gap`` seconds, once it is closed: its ``session`` start and ``segments``.

    A segment's own session lasts for its duration and the allowed pause (columns ts, order, start, end, speaker, text,
    confidence), so no two segments that may be merged are in different sessions.
    """
    # A microsecond more: a pause of just max_gap belongs to the session.
    pause = F.make_interval(secs=F.greatest(F.col("end") - F.col("start"), F.lit(0.0)) + F.lit(max_gap + 1e-6))
    fields = F.struct("order", "start", "end", "speaker", "text", "confidence")
    grouped = segments.withWatermark("ts", late).groupBy(*keys, F.session_window("ts", pause)).agg(F.collect_list(fields).alias("segments"))
    return grouped.select(*keys, F.col("session_window.start").alias("session"), "segments")


def merged_segments_sink(
    sessions: DataFrame, table: BucketTable, keys: list[str], max_gap: float, checkpoint: str, available_now: bool = True, seconds: int = 5,
    partitions: int | None = None,
) -> StreamingQuery:
    """Merge the segments of closed sessions as the batch operator does, into ``table`` by key, session and island.

    A task sorts the sessions of one of the query's ``partitions``, whose number is fixed when the query starts for the
    first time (by default the session's); ``partitions_for`` gives one for the files that are there.
    """

    def merge(batch: DataFrame, _: int) -> None:
        # The merge and the table read the closed sessions several times; the state is gone through once.
        batch = batch.persist(StorageLevel.DISK_ONLY)
        try:
            rows = batch.select(*keys, "session", F.inline("segments"))
            table.upsert(merge_segments(rows, [*keys, "session"], max_gap))
        finally:
            batch.unpersist()

    spark, usual = sessions.sparkSession, sessions.sparkSession.conf.get(PARTITIONS)
    try:
        if partitions:
            spark.conf.set(PARTITIONS, str(partitions))
        return _started(merge, sessions, checkpoint, "append", available_now, seconds)
    finally:
        spark.conf.set(PARTITIONS, usual)  # a started query has its own copy of the settings


def known_events(events: DataFrame, tasks: DataFrame, task: str, late: str = "1 day") -> DataFrame:
    """Events of known tasks, each once even when the source repeats it."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"]).join(tasks, task, "left_semi")


def new_chunks(files: DataFrame, text: str, arrived: str, size: int, overlap: int, late: str = "1 day") -> DataFrame:
    """Chunks of texts not seen before; equal texts are one file, whatever their name."""
    hashed = files.withColumn("content_hash", F.sha2(F.col(text), 256)).withWatermark(arrived, late)
    fresh = hashed.dropDuplicatesWithinWatermark(["content_hash"])
    rows = explode_items(fresh, fixed_size_chunks(F.col(text), size, overlap), "chunk", "index", ["content_hash"])
    return rows.withColumn("chunk_id", F.sha2(F.concat_ws("|", "content_hash", "index"), 256))


#: Parts that a job's steps are dealt to, so that a large job is not one task.
PARTS = 8
PROGRESS = "job long, part int, steps long, finished long"
EXPIRY_MS = 24 * 3600 * 1000
STATE_STORE = "spark.sql.streaming.stateStore.providerClass"


class StepCounts(StatefulProcessor):
    """For each part of a job its steps and whether they are done; only the steps that a batch names are looked up."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.done = handle.getMapState("done", "step string", "done boolean")
        self.counts = handle.getValueState("counts", "steps long, finished long")

    def _expire_after(self, ms: int, again: bool = True) -> None:
        if again:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
        self.handle.registerTimer(ms + EXPIRY_MS)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        counts = self.counts.get()
        steps, finished = counts or (0, 0)
        latest, reported = max(0, timerValues.getCurrentWatermarkInMs()), {}
        for batch in rows:
            latest = max(latest, int(batch["at"].max()))
            for step, done in zip(batch["step"].tolist(), batch["done"].tolist()):
                if step is not None:
                    reported[step] = reported.get(step, False) or bool(done)
        for step, done in reported.items():
            # Each look-up is a call to the JVM; a part seen for the first time knows no step and has no timer.
            known = self.done.getValue((step,)) if counts else None
            steps += known is None
            finished += done and not (known and known[0])
            if known is None or done and not known[0]:
                self.done.updateValue((step,), (done,))
        self.counts.update((steps, finished))
        self._expire_after(latest, counts is not None)
        yield pd.DataFrame({"job": [key[0]], "part": [key[1]], "steps": [steps], "finished": [finished]})

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        """A part whose steps are all done is forgotten after a day of event time; others are kept."""
        steps, finished = self.counts.get() if self.counts.exists() else (0, 0)
        if finished < steps:
            self._expire_after(timerValues.getCurrentWatermarkInMs())
        else:
            self.done.clear()
            self.counts.clear()
        yield pd.DataFrame({"job": [], "part": [], "steps": [], "finished": []}).astype({"job": "int64", "part": "int32", "steps": "int64", "finished": "int64"})

    def close(self) -> None:
        pass


def job_progress(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Live counts of distinct steps for each part of a job (columns job, step, ts, done); a step is done once any report says so.

    A step that is reported twice counts once. Sink the rows by (job, part) and add them up with ``job_totals``. State
    lies in RocksDB, a row for each step; finished parts are forgotten after a day without reports, by event time.
    """
    events.sparkSession.conf.set(STATE_STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = events.select("job", F.pmod(F.xxhash64("step"), F.lit(PARTS)).cast("int").alias("part"), F.col("step").cast("string").alias("step"), "ts", F.unix_millis("ts").alias("at"), "done")
    return rows.withWatermark("ts", late).groupBy("job", "part").transformWithStateInPandas(StepCounts(), PROGRESS, "Update", "EventTime")


def job_totals(parts: DataFrame) -> DataFrame:
    """Steps, finished steps and progress of each job."""
    sums = parts.groupBy("job").agg(F.sum("steps").alias("steps"), F.sum("finished").alias("finished"))
    return sums.withColumn("progress", F.col("finished") / F.col("steps"))

"""Streaming queries, worked off with ``availableNow`` and compared with the batch result."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillstack.registry import register
from quillstack.registry import sqltext as q
from quillstack.session import load_table, shared_dir
from quillstack.sources.buckets import BucketTable
from quillstack.streaming import streams as st

K = "json_extract_string(props, '$.k')::BIGINT"
TEN_DAYS = 864_000


def stream(spark, folder, name):
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    # A pattern matches the table whether it is one file or a folder of files.
    return st.read_stream(spark, f"{folder}/{{{name}.parquet}}", schema)


def events(spark, folder):
    return stream(spark, folder, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))


@register(
    "r1_tool_counters",
    f"""
SELECT event_type || '-' || ({K} % 5) AS tool, count(*) AS usage_count, count(*) FILTER (value > 20) AS success_count,
  count(*) FILTER (value <= 20) AS error_count, epoch_us(max(ts)) AS last_us FROM events GROUP BY 1
""",
)
def r1(spark, folder):
    rows = events(spark, folder).withColumn("tool", F.concat_ws("-", "event_type", F.col("k") % 5))
    state = st.run_to_table(st.tool_counters(rows, "tool", F.col("value") > 20), ["tool"], label="tools")
    return state.withColumn("last_us", F.unix_micros("last_used_at")).drop("last_used_at")


@register(
    "r2_paired_events",
    f"""
WITH e AS (SELECT *, {K} % 10 AS step FROM events)
SELECT s.user_id, s.step, s.event_id AS start_id, n.event_id AS end_id, (epoch_us(n.ts) - epoch_us(s.ts)) / 1000000 AS seconds
FROM e s JOIN e n ON s.user_id = n.user_id AND s.step = n.step AND n.ts > s.ts AND epoch_us(n.ts) - epoch_us(s.ts) <= {TEN_DAYS}000000
WHERE s.event_type = 'view' AND n.event_type = 'purchase'
""",
)
def r2(spark, folder):
    rows = events(spark, folder).withColumn("step", F.col("k") % 10)
    starts, ends = rows.filter("event_type = 'view'"), rows.filter("event_type = 'purchase'")
    return st.run_to_files(st.paired_events(starts, ends, ["user_id", "step"], TEN_DAYS), "pairs")


@register(
    "r2_last_ends",
    f"""
WITH e AS (SELECT *, {K} % 10 AS step FROM events),
p AS (SELECT s.user_id, s.step, s.event_id AS start_id, n.event_id AS end_id, (epoch_us(n.ts) - epoch_us(s.ts)) / 1000000 AS seconds
  FROM e s JOIN e n ON s.user_id = n.user_id AND s.step = n.step AND n.ts > s.ts AND epoch_us(n.ts) - epoch_us(s.ts) <= {TEN_DAYS}000000
  WHERE s.event_type = 'view' AND n.event_type = 'purchase')
SELECT DISTINCT ON (start_id) * FROM p ORDER BY start_id, seconds DESC, end_id DESC
""",
)
def r2_last(spark, folder):
    """Each start with its last end so far: a table that later ends update."""
    rows = events(spark, folder).withColumn("step", F.col("k") % 10)
    starts, ends = rows.filter("event_type = 'view'"), rows.filter("event_type = 'purchase'")
    return st.run_to_table(st.paired_events(starts, ends, ["user_id", "step"], TEN_DAYS), ["start_id"], "append", "ends", best=["seconds", "end_id"])


@register(
    "r3_calls_per_day",
    """
SELECT epoch_us(date_trunc('day', ts)) AS day_us, count(*) AS calls FROM events
WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 DAY FROM events) GROUP BY 1
""",
)
def r3(spark, folder):
    """Days that the watermark has closed."""
    days = st.run_to_files(st.calls_per_day(events(spark, folder)), "days")
    return days.select(F.unix_micros("day").alias("day_us"), "calls")


@register("r3_running_days", "SELECT epoch_us(date_trunc('day', ts)) AS day_us, count(*) AS calls FROM events GROUP BY 1")
def r3_running(spark, folder):
    """All days, the running one included."""
    days = st.run_to_table(st.calls_per_day(events(spark, folder), "60 days"), ["day"], label="days")
    return days.select(F.unix_micros("day").alias("day_us"), "calls")


@register(
    "r4_token_totals",
    """
SELECT l_orderkey AS task, sum(l_quantity)::BIGINT AS input_tokens, sum(l_linenumber)::BIGINT AS output_tokens, count(*) AS calls
FROM lineitem GROUP BY 1
""",
)
def r4(spark, folder):
    usage = stream(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("task"), F.col("l_quantity").cast("long").alias("input_tokens"),
        F.col("l_linenumber").cast("long").alias("output_tokens"),
    )
    return st.run_to_table(st.token_totals(usage), ["task"], label="tokens")


@register(
    "r5_job_progress",
    f"""
SELECT job, count(*) AS steps, count(*) FILTER (done) AS finished, count(*) FILTER (done) / count(*) AS progress FROM (
  SELECT user_id AS job, {K} % 7 AS step, bool_or(event_type IN ('purchase', 'signup')) AS done FROM events GROUP BY 1, 2) GROUP BY job
""",
)
def r5(spark, folder):
    """Seven steps a job; each is reported many times and counts once."""
    rows = events(spark, folder).select(
        F.col("user_id").alias("job"), (F.col("k") % 7).alias("step"), "ts", F.col("event_type").isin("purchase", "signup").alias("done")
    )
    return st.job_totals(st.run_to_table(st.job_progress(rows, "60 days"), ["job", "part"], label="jobs"))


@register(
    "r6_sessions",
    """
WITH l AS (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS p FROM events),
i AS (SELECT *, sum(CASE WHEN p IS NULL OR ts - p > INTERVAL 12 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts) AS n FROM l),
s AS (SELECT user_id, min(ts) AS a, max(ts) + INTERVAL 12 HOUR AS b, count(*) AS events FROM i GROUP BY user_id, n)
SELECT user_id, epoch_us(a) AS start_us, epoch_us(b) AS end_us, events FROM s WHERE b <= (SELECT max(ts) - INTERVAL 1 DAY FROM events)
""",
)
def r6(spark, folder):
    """Sessions per user with pauses of at most twelve hours that the watermark has closed."""
    closed = st.run_to_files(st.sessions(events(spark, folder), ["user_id"], "12 hours", "1 day"), "sessions")
    return closed.select("user_id", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "events")


@register(
    "r6_live_segments",
    """
WITH s AS (SELECT user_id, event_id AS ord, event_type AS speaker, epoch_us(ts) / 1000000 AS start, epoch_us(ts) / 1000000 + value AS fin FROM events),
m AS (SELECT *, max(fin) OVER (PARTITION BY user_id ORDER BY start, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS talk FROM s),
t AS (SELECT *, sum(CASE WHEN talk IS NULL OR start - talk > 43200 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY start, ord) AS session FROM m),
c AS (SELECT user_id, session FROM t GROUP BY ALL HAVING max(fin) + 43200 < (SELECT max(epoch_us(ts)) / 1000000 - 86400 FROM events)),
l AS (SELECT *, lag(speaker) OVER w AS ps, lag(fin) OVER w AS pf FROM t SEMI JOIN c USING (user_id, session) WINDOW w AS (PARTITION BY user_id, session ORDER BY start, ord)),
i AS (SELECT *, sum(CASE WHEN pf IS NULL OR speaker <> ps OR start - pf > 43200 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, session ORDER BY start, ord) AS island FROM l)
SELECT user_id, any_value(speaker) AS speaker, round(min(start), 3) AS start, round(arg_max(fin, (start, ord)), 3) AS fin,
  string_agg('t' || ord, ' ' ORDER BY start, ord) AS text,
  round(list_reduce(list(ord % 11 ORDER BY start, ord)::DOUBLE[], lambda a, c: (a + c) / 2), 6) AS confidence, count(*) AS segments
FROM i GROUP BY user_id, session, island
""",
)
def r6_live(spark, folder):
    """Segments of one speaker merged live, pauses of up to twelve hours; talk that the watermark has closed."""
    start = F.unix_micros("ts") / 1_000_000
    rows = events(spark, folder).select(
        "user_id", "ts", F.col("event_id").alias("order"), F.col("event_type").alias("speaker"), start.alias("start"),
        (start + F.col("value")).alias("end"), F.concat(F.lit("t"), F.col("event_id").cast("string")).alias("text"),
        (F.col("event_id") % 11).cast("double").alias("confidence"),
    )
    keys = ["user_id"]
    table = BucketTable(spark, shared_dir(spark, "segments"), [*keys, "session", "island"])
    talk = st.live_segments(rows, keys, 43_200, "1 day")
    parts = st.partitions_for(spark, f"{folder}/{{events.parquet}}")
    st.merged_segments_sink(talk, table, keys, 43_200, shared_dir(spark, "segments-checkpoint"), partitions=parts).awaitTermination()
    return table.read().select(
        "user_id", "speaker", F.round("start", 3).alias("start"), F.round("end", 3).alias("fin"), "text",
        F.round("confidence", 6).alias("confidence"), "segments",
    )


@register(
    "r7_incremental_chunks",
    f"""
WITH u AS (SELECT sha256(text) AS content_hash, max(text) AS text FROM documents GROUP BY 1),
c AS (SELECT content_hash, unnest(range(0, len(l))) AS index, unnest(l) AS chunk FROM (SELECT content_hash, {q.kept(q.windows('text', 1000, 200))} AS l FROM u))
SELECT content_hash, index, chunk, sha256(content_hash || '|' || index) AS chunk_id FROM c
""",
)
def r7(spark, folder):
    """Documents arrive as files, exact copies are ingested once."""
    docs = stream(spark, folder, "documents").withColumn("arrived", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("doc_id")))
    chunks = st.new_chunks(docs, "text", "arrived", 1000, 200, late="3650 days")
    return st.run_to_table(chunks, ["chunk_id"], "append", "ingest")


@register(
    "r8_persist_events",
    """
SELECT event_id, user_id, event_type, epoch_us(ts) AS ts_us FROM events WHERE user_id IN (SELECT c_custkey FROM customer WHERE c_nationkey < 15)
""",
)
def r8(spark, folder):
    """The stream delivers every event twice; events of unknown tasks are skipped."""
    rows = stream(spark, folder, "events")
    twice = rows.unionByName(stream(spark, folder, "events"))
    tasks = load_table(spark, folder, "customer").filter("c_nationkey < 15").select(F.col("c_custkey").alias("user_id"))
    kept = st.run_to_files(st.known_events(twice, tasks, "user_id", "60 days"), "persisted")
    return kept.select("event_id", "user_id", "event_type", F.unix_micros("ts").alias("ts_us"))

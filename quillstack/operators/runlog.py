"""Metrics over event logs, tasks, tool and token usage, and job progress."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstack.functions.text import strip
from quillstack.functions.windows import previous_row, running_sum, salted_join, top_per_group

# Event names by scope, action and category.
EVENT_NAMES = {
    "task_start_dag_plan": "dag_plan_start", "task_end_dag_plan": "dag_plan_end",
    "task_start_dag": "dag_execute_start", "task_update_dag": "dag_execution", "task_end_dag": "dag_execute_end",
    "step_start_dag": "dag_step_start", "step_end_dag": "dag_step_end",
    "action_start_llm": "llm_call_start", "action_end_llm": "llm_call_end",
    "action_start_tool": "tool_execution_start", "action_end_tool": "tool_execution_end",
    "action_start_compact": "action_start_compact", "action_end_compact": "action_end_compact",
    "system_update_visualization": "visualization_update",
    "task_start_message": "user_message", "task_end_message": "ai_message", "task_end_general": "task_completion",
    "task_start_skill": "skill_select_start", "task_end_skill": "skill_select_end",
    "task_start_react": "react_task_start", "task_end_react": "react_task_end",
    "step_start_react": "react_step_start", "step_end_react": "react_step_end",
    "action_start_react": "react_action_start", "action_end_react": "react_action_end",
}
ERROR_NAME = "trace_error"

# Statuses of jobs that have ended.
FINISHED = ["completed", "failed", "cancelled"]

# Longest pairing in seconds, longest tool result, and the wording of the context message.
MAX_LATENCY = 3600
TOOL_RESULT_LENGTH = 240
CONTEXT_HEADER = (
    "=== Previous Execution Context ===\n"
    "These are reusable results discovered in earlier rounds of this same task.\n"
    "Use them when handling follow-up requests, and only rerun tools if fresher data is needed.\n"
)


def event_name(scope: Column, action: Column, category: Column) -> Column:
    """Name of an event; errors share one name and unknown combinations keep their three parts."""
    key = F.concat_ws("_", scope, action, category)
    names = F.create_map(*[F.lit(x) for pair in EVENT_NAMES.items() for x in pair])
    return F.when(action == "error", F.lit(ERROR_NAME)).otherwise(F.coalesce(F.try_element_at(names, key), key))


def of_owner(events: DataFrame, tasks: DataFrame, task: str = "task_id") -> DataFrame:
    """Events of the given (already owner-filtered) tasks."""
    return events.join(tasks.select(task).distinct(), task, "left_semi")


def event_counts(events: DataFrame, groups: dict[str, list[str]], as_of: datetime.datetime | None = None) -> DataFrame:
    """One row: events per named group of types, and with ``as_of`` also those since that day's midnight; one scan."""
    kind = F.col("event_type")
    columns = [F.count_if(kind.isin(types)).alias(name) for name, types in groups.items()]
    if as_of is not None:
        today = F.col("ts") >= F.date_trunc("day", F.lit(as_of).cast("timestamp"))
        columns += [F.count_if(kind.isin(types) & today).alias(f"{name}_today") for name, types in groups.items()]
    return events.agg(*columns)


def success_rate(events: DataFrame, completed: list[str], task: str = "task_id") -> DataFrame:
    """Share of tasks with a completion event, in percent; exact distinct counts."""
    done = F.count_distinct(F.when(F.col("event_type").isin(completed), F.col(task)))
    counts = events.agg(F.count_distinct(task).alias("tasks"), done.alias("completed"))
    rate = F.when(F.col("tasks") > 0, F.round(F.col("completed") / F.col("tasks") * 100, 1)).otherwise(F.lit(0.0))
    return counts.withColumn("success_rate", rate)


def paired_latency(
    events: DataFrame, start: list[str], end: list[str], keys: list[str], max_seconds: float = MAX_LATENCY
) -> DataFrame:
    """Seconds from each start to the last end with the same keys, within ``max_seconds``.

    The first key is the task; a missing, empty or zero step or attempt matches nothing. Ends are reduced to one row
    per key first, and starts of a busy task are spread by salt.
    """
    usable = F.lit(True)
    for key in keys[1:]:
        usable = usable & F.col(key).isNotNull() & ~F.col(key).cast("string").isin("", "0")
    rows = events.filter(usable)
    ends = rows.filter(F.col("event_type").isin(end)).groupBy(*keys).agg(F.max("ts").alias("end_ts"))
    starts = rows.filter(F.col("event_type").isin(start)).select(*keys, F.col("ts").alias("start_ts"), "event_id")
    paired = salted_join(starts, ends, keys)
    seconds = (F.unix_micros("end_ts") - F.unix_micros("start_ts")) / F.lit(1_000_000)
    return paired.withColumn("seconds", seconds).filter((F.col("seconds") > 0) & (F.col("seconds") <= max_seconds))


def mean_latency(pairs: DataFrame) -> DataFrame:
    """Mean of the paired seconds with two decimals; null when nothing matched."""
    return pairs.agg(F.count(F.lit(1)).alias("pairs"), F.round(F.avg("seconds"), 2).alias("mean_seconds"))


def distinct_values(events: DataFrame, value: Column, since: datetime.datetime | None = None) -> DataFrame:
    rows = events if since is None else events.filter(F.col("ts") >= F.date_trunc("day", F.lit(since).cast("timestamp")))
    return rows.agg(F.count_distinct(value).alias("n"))


def total_tokens(data: Column) -> Column:
    """Tokens recorded in an event's JSON: the total, else the usage total, else prompt plus completion; else null."""
    parsed = F.try_parse_json(data)

    def integer(path: str) -> Column:
        kind = F.schema_of_variant(F.try_variant_get(parsed, path, "variant"))
        return F.when(kind == "BIGINT", F.try_variant_get(parsed, path, "bigint"))

    prompt, completion = integer("$.prompt_tokens"), integer("$.completion_tokens")
    zero = F.lit(0).cast("long")
    parts = F.when(
        prompt.isNotNull() | completion.isNotNull(), F.coalesce(prompt, zero) + F.coalesce(completion, zero)
    )
    return F.coalesce(integer("$.total_tokens"), integer("$.usage.total_tokens"), parts)


def top_counts(events: DataFrame, by: Column, name: str, n: int = 10) -> DataFrame:
    return events.groupBy(by.alias(name)).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), name).limit(n)


def shares(events: DataFrame, by: Column, name: str) -> DataFrame:
    """Count and percentage per value; the total is a scalar subquery over the counts."""
    counts = events.groupBy(by.alias(name)).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    return counts.withColumn("share", F.lit(100.0) * F.col("n") / total)


def dashboard(tasks: DataFrame, updated: str, as_of: datetime.datetime) -> DataFrame:
    midnight = F.date_trunc("day", F.lit(as_of).cast("timestamp"))
    return tasks.agg(F.count(F.lit(1)).alias("tasks"), F.count_if(F.col(updated) >= midnight).alias("active_today"))


def filter_tasks(
    tasks: DataFrame, title: str | None = None, include: list[str] | None = None, exclude: list[str] | None = None,
    kind: str = "agent_type", default_kind: str = "standard", owner: int | None = None, is_admin: bool = True,
    mode: str | None = None, not_mode: str | None = None,
) -> DataFrame:
    """Title part regardless of case; kinds to include (a missing kind counts as standard) or exclude; one mode, or all but one.

    Admins see all tasks, others those whose ``user_id`` is ``owner``, nobody none. A task without a mode is in neither
    selection by mode; ``mode`` hides ``not_mode``.
    """
    rows = tasks if is_admin else tasks.filter(F.col("user_id") == F.lit(owner).cast("long"))
    if mode:
        rows = rows.filter(F.col("mode") == mode)
    elif not_mode:
        rows = rows.filter(F.col("mode") != not_mode)
    if title:
        escaped = title.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
        rows = rows.filter(F.col("title").ilike(f"%{escaped}%"))
    value = F.coalesce(F.col(kind), F.lit(default_kind)) if kind in tasks.columns else None
    if include is not None and value is not None:
        rows = rows.filter(value.isin(include))
    if exclude is not None and value is not None:
        rows = rows.filter(~value.isin(exclude))
    return rows


def token_usage(usage: DataFrame, keys: list[str]) -> DataFrame:
    """Input, output and total tokens and calls per key combination, with subtotals.

    Calls are added up per full key first, so the subtotals work on that smaller result.
    """
    fine = usage.groupBy(*keys).agg(
        F.sum("input_tokens").alias("i"), F.sum("output_tokens").alias("o"), F.count(F.lit(1)).alias("c")
    )
    return fine.rollup(*keys).agg(
        F.sum("i").alias("input_tokens"), F.sum("o").alias("output_tokens"), F.sum(F.col("i") + F.col("o")).alias("total_tokens"),
        F.sum("c").alias("calls"), F.grouping_id().alias("level"),
    )


def merge_segments(segments: DataFrame, keys: list[str], max_gap: float, bucket_seconds: float = 86_400.0) -> DataFrame:
    """Merge consecutive segments of one speaker when the gap is at most ``max_gap``.

    Segments have order, start and end (seconds), speaker, text, confidence. Text is joined by blanks; confidence is
    folded pairwise. The island number is found per time bucket and carried over, so one long recording is not one
    task; each output row then collects its own texts only.
    """
    order = ["start", "order"]
    rows = segments.withColumn("__bucket", F.floor(F.col("start") / bucket_seconds))
    rows = previous_row(rows, keys, order, "__bucket", ["speaker", "end"])
    opens = F.col("prev_end").isNull() | ~F.col("speaker").eqNullSafe(F.col("prev_speaker")) | (
        F.col("start") - F.col("prev_end") > max_gap
    )
    rows = running_sum(rows, keys, [F.col(c) for c in order], "__bucket", opens.cast("int"), "island")
    parts = F.sort_array(F.collect_list(F.struct("start", "order", "end", "text", "confidence")))
    merged = rows.groupBy(*keys, "island").agg(F.first("speaker").alias("speaker"), parts.alias("__p"))
    rated = F.filter(F.transform("__p", lambda p: p["confidence"]), lambda c: c.isNotNull())
    folded = F.aggregate(rated, F.lit(None).cast("double"), lambda a, c: F.coalesce((a + c) / 2, c))
    return merged.select(
        *keys, "island", "speaker", F.col("__p")[0]["start"].alias("start"), F.element_at("__p", -1)["end"].alias("end"),
        F.array_join(F.transform("__p", lambda p: p["text"]), " ").alias("text"), folded.alias("confidence"),
        F.size("__p").alias("segments"),
    )


def job_progress(steps: DataFrame, job: str, step: str, done: str) -> DataFrame:
    """Share of finished steps and the first unfinished step per job (null when all are done)."""
    return steps.groupBy(job).agg(
        F.count(F.lit(1)).alias("steps"), F.count_if(done).alias("finished"),
        F.avg(F.col(done).cast("int")).alias("progress"), F.min(F.when(~F.col(done), F.col(step))).alias("current_step"),
    )


def active_jobs(jobs: DataFrame, status: str = "status") -> DataFrame:
    return jobs.filter(~F.col(status).isin(FINISHED))


def retained_jobs(jobs: DataFrame, updated: str, as_of: datetime.datetime, hours: int = 24, status: str = "status") -> DataFrame:
    """Without the finished jobs that ended more than ``hours`` ago."""
    limit = F.lit(as_of).cast("timestamp") - F.make_dt_interval(hours=F.lit(hours))
    return jobs.filter(~F.col(status).isin(FINISHED) | (F.col(updated) >= limit))


def tool_summary(tool: Column, success: Column, result: Column) -> Column:
    """Reusable line about a tool result; null when it failed, is unnamed or empty."""
    name, text = strip(tool), strip(result)
    cut = F.when(
        F.length(text) > TOOL_RESULT_LENGTH, F.concat(F.substring(text, 1, TOOL_RESULT_LENGTH - 3), F.lit("..."))
    ).otherwise(text)
    usable = (name != "") & F.coalesce(success, F.lit(True)) & (F.length(text) > 0)
    return F.when(usable, F.concat(F.lit("- Tool "), name, F.lit(" previously returned: "), cut))


TOOL_END = "tool_execution_end"


def execution_context(events: DataFrame, task: str, last: int = 8) -> DataFrame:
    """One context message per task from its last ``last`` tool results (columns ts, event_id, tool, success, result).

    Where the events have them, an ``event_type`` other than the end of a tool call and a ``build_id`` (a build, not the
    task itself) leave a row out. At most ``last`` rows per task leave a task's window; repeated lines keep their newest place.
    """
    if "event_type" in events.columns:
        events = events.filter(F.col("event_type") == TOOL_END)
    if "build_id" in events.columns:
        events = events.filter(F.col("build_id").isNull())
    recent = top_per_group(events, [task], [F.col("ts").desc(), F.col("event_id").desc()], last, "__n")
    lines = recent.withColumn("__line", tool_summary(F.col("tool"), F.col("success"), F.col("result"))).filter("__line IS NOT NULL")
    newest = lines.groupBy(task, "__line").agg(F.min("__n").alias("__n"))
    ordered = F.sort_array(F.collect_list(F.struct((-F.col("__n")).alias("n"), F.col("__line").alias("line"))))
    return newest.groupBy(task).agg(
        F.concat(F.lit(CONTEXT_HEADER), F.array_join(F.transform(ordered, lambda x: x["line"]), "\n")).alias("content"),
        F.count(F.lit(1)).alias("lines"),
    )


def latest_selection(events: DataFrame, task: str) -> DataFrame:
    """The newest selection per task, kept when something was selected and it has a name."""
    newest = events.groupBy(task).agg(
        F.max_by(F.struct("selected", "name"), F.struct("ts", "event_id")).alias("__s")
    ).select(task, "__s.*")
    return newest.filter(F.coalesce("selected", F.lit(False)) & (F.coalesce(strip(F.col("name")), F.lit("")) != ""))

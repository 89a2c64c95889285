"""Chat transcripts: cleaning, cutting to a size, rendering. Messages have conv_id, turn, role, text.

A conversation may be very long, so nothing collects one whole: messages stay rows, and only a cut of bounded size
is joined into one text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstack.functions.text import estimate_tokens, has_content, strip
from quillstack.functions.windows import running_sum, salted_join, top_per_group

# Roles a transcript may hold.
ROLES = ["user", "assistant", "system"]


def normalize_messages(messages: DataFrame, roles: list[str] | None = None) -> DataFrame:
    """Lower-case role, stripped text; other roles and empty messages are dropped."""
    rows = messages.withColumn("role", F.lower(strip(F.col("role")))).withColumn("text", strip(F.col("text")))
    return rows.filter(F.col("role").isin(roles or ROLES) & has_content(F.col("text")))


def messages_before(messages: DataFrame, marks: DataFrame) -> DataFrame:
    """Messages before a given one per conversation (columns conv_id, before), the last if several; an unknown one gives nothing."""
    known = marks.join(messages.select("conv_id", F.col("turn").alias("before")), ["conv_id", "before"], "left_semi")
    # One row for each conversation, so a long one can be salted.
    last = known.groupBy("conv_id").agg(F.max("before").alias("before"))
    return salted_join(messages, last, ["conv_id"]).filter(F.col("turn") < F.col("before")).drop("before")


def _is_system() -> Column:
    return F.col("role") == "system"


def truncate_messages(messages: DataFrame, limit: int) -> DataFrame:
    """All system messages and the newest others, ``limit`` together; system messages alone when they are as many."""
    others = top_per_group(messages.filter(~_is_system()), ["conv_id"], [F.col("turn").desc()], limit, "__n")
    system = messages.filter(_is_system())
    counts = system.groupBy("conv_id").agg(F.count(F.lit(1)).alias("__system"))
    kept = others.join(counts, "conv_id", "left").filter(F.col("__n") <= F.lit(limit) - F.coalesce("__system", F.lit(0)))
    return system.unionByName(kept.select(*messages.columns))


def fit_to_budget(messages: DataFrame, tokens: int, bucket_turns: int = 256) -> DataFrame:
    """All system messages, then the newest others while their tokens fit; the first that does not fit ends the list.

    Costs are never negative, so the list is the rows whose running total stays within the budget. The running total
    is taken per block of turns and carried over, so one long conversation is spread over tasks.
    """
    system = messages.filter(_is_system())
    used = system.groupBy("conv_id").agg(F.floor(F.sum(F.length("text")) / 4).alias("__used"))
    others = messages.filter(~_is_system()).withColumn("__bucket", F.floor(F.col("turn") / bucket_turns))
    summed = running_sum(
        others, ["conv_id"], [F.col("turn").desc()], "__bucket", estimate_tokens(F.col("text")), "__sum", descending=True
    )
    kept = salted_join(summed, used, ["conv_id"], how="left").filter(F.col("__sum") + F.coalesce("__used", F.lit(0)) <= tokens)
    return system.unionByName(kept.select(*messages.columns))


def token_estimates(messages: DataFrame) -> DataFrame:
    return messages.groupBy("conv_id").agg(
        F.floor(F.sum(F.length(F.coalesce("text", F.lit("")))) / 4).alias("tokens"), F.count(F.lit(1)).alias("messages")
    )


def rendered_lines(messages: DataFrame) -> DataFrame:
    """``ROLE: text`` per message."""
    line = F.concat(F.upper(F.coalesce("role", F.lit("unknown"))), F.lit(": "), F.coalesce("text", F.lit("")))
    return messages.select("conv_id", "turn", line.alias("line"))


def rendered_transcript(messages: DataFrame) -> DataFrame:
    """One text per conversation from all its messages, in order.

    The text must fit into one row: bound long conversations first, by ``truncate_messages`` or ``fit_to_budget``;
    ``rendered_lines`` has no such bound.
    """
    lines = rendered_lines(messages)
    ordered = F.sort_array(F.collect_list(F.struct("turn", "line")))
    return lines.groupBy("conv_id").agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("transcript"))

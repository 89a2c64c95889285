"""Quotation linking: which message answers which, from the passages it quotes. DataFrame functions only.

A line that begins with marks (``>``, blanks between them allowed) is quoted at the level of their number. Lines are
normalised (lower case, runs of blanks as one) and hashed; a quoted line belongs to the last earlier message of its
conversation that has it as own text. Each run of neighbouring lines of level 1 is also hashed as one passage, however it is
wrapped, and so are the runs of a message's own lines and all of them together; a passage counts as many lines as it has,
besides the single lines, and every run finds its origin on its own. A message answers the earlier message to which most of
its lines of level 1 belong, of equals the latest; ``answers`` has all messages that its runs and lines of level 1 belong
to. Following the answers up gives each message its root and depth. ``conversations`` puts a root's messages in order.

Empty lines are never linked. A message with a null conversation or turn, or without a linked quote, is a root. Rows
that share conversation and turn are one message in several rows, each of which is returned. Null text is empty text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstack.functions.arrays import explode_items
from quillstack.functions.windows import salted_join
from quillstack.llm.common import written

MARKS = r"^((?:[ \t]*>)+)[ \t]?"


def quote_level(line: Column) -> Column:
    return F.length(F.regexp_replace(F.regexp_extract(line, MARKS, 1), r"[ \t]", ""))


def normalised(line: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(F.regexp_replace(line, MARKS, "")), r"\s+", " "))


def own_text(text: Column) -> Column:
    """The text without quoted lines and without the empty lines around the rest."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\r?\n"), lambda x: quote_level(x) == 0)
    return F.btrim(F.array_join(lines, "\n"), F.lit(" \t\r\n"))


def quoted_lines(messages: DataFrame) -> DataFrame:
    """(conv, turn, level, passage, lines, votes): the hash of every line with words; level 0 is own text.

    Runs of own lines and of lines of level 1, and the whole own text, are further passages, of 0 lines and as many votes as
    they have lines.
    """
    split = F.split(F.coalesce("text", F.lit("")), "\r?\n")
    lines = explode_items(messages, split, "line", keep=["conv", "turn"])
    lines = lines.select("conv", "turn", quote_level(F.col("line")).alias("level"), normalised(F.col("line")).alias("norm"))
    lines = lines.select("conv", "turn", "level", "norm", F.lit(1).alias("lines"), F.lit(1).alias("votes"), F.lit(0).alias("kind"))

    marked = F.transform(split, lambda x: F.struct(quote_level(x).alias("level"), normalised(x).alias("norm")))
    none = F.array().cast("array<struct<level:int,norm:string,votes:int>>")

    def joined(runs: Column, line: Column) -> Column:
        last, filled = F.try_element_at(runs, F.lit(-1)), (line["norm"] != "").cast("int")
        longer = F.struct(
            last["level"].alias("level"), F.concat_ws(" ", F.nullif(last["norm"], F.lit("")), F.nullif(line["norm"], F.lit(""))).alias("norm"),
            (last["votes"] + filled).alias("votes"),
        )
        fresh = F.struct(line["level"].alias("level"), line["norm"].alias("norm"), filled.alias("votes"))
        same = F.coalesce(last["level"] == line["level"], F.lit(False))
        return F.when(same, F.concat(F.slice(runs, F.lit(1), F.size(runs) - 1), F.array(longer))).otherwise(F.concat(runs, F.array(fresh)))

    def passages(runs: Column) -> Column:
        own = F.filter(runs, lambda r: (r["level"] == 0) & (r["norm"] != ""))
        all_own = F.struct(
            F.lit(0).alias("level"), F.array_join(F.transform(own, lambda r: r["norm"]), " ").alias("norm"),
            F.aggregate(own, F.lit(0), lambda n, r: n + r["votes"]).alias("votes"),
        )
        # One run is the whole text already.
        shown = F.filter(runs, lambda r: (r["level"] <= 1) & (r["norm"] != ""))
        return F.when(F.size(own) > 1, F.concat(shown, F.array(all_own))).otherwise(shown)

    runs = messages.select("conv", "turn", F.aggregate(marked, none, joined).alias("runs"))
    texts = explode_items(runs, passages(F.col("runs")), "passage", keep=["conv", "turn"]).select("conv", "turn", "passage.*")
    texts = texts.select("conv", "turn", "level", "norm", F.lit(0).alias("lines"), "votes", F.lit(1).alias("kind"))
    return lines.unionByName(texts).filter("norm <> '' AND conv IS NOT NULL AND turn IS NOT NULL").select(
        "conv", "turn", "level", F.xxhash64("norm", F.length("norm"), "kind").alias("passage"), "lines", "votes"
    )


def links(messages: DataFrame) -> DataFrame:
    """(conv, turn, level, origin, n, votes): how many of a message's lines of a level belong to an earlier message.

    The last turn before with the passage is carried forward by ranges of 256 turns, so no passage makes pairs.
    """
    met = quoted_lines(messages).groupBy("conv", "passage", "turn", "level").agg(F.sum("lines").alias("n"), F.sum("votes").alias("votes"))
    met = written(met, "quotes")  # read twice
    met = met.withColumn("range", F.floor(F.col("turn") / 256)).withColumn("own", F.when(F.col("level") == 0, F.col("turn")))
    keys = ["conv", "passage"]
    across = Window.partitionBy(*keys).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    carried = met.groupBy(*keys, "range").agg(F.max("own").alias("last")).withColumn("carried", F.max("last").over(across)).drop("last")
    inner = Window.partitionBy(*keys, "range").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    met = met.withColumn("inner", F.max("own").over(inner)).filter("level > 0").join(carried, [*keys, "range"])
    met = met.withColumn("origin", F.coalesce("inner", "carried")).filter("origin IS NOT NULL")
    return met.groupBy("conv", "turn", "level", "origin").agg(F.sum("n").alias("n"), F.sum("votes").alias("votes"))


def threads(answers: DataFrame) -> DataFrame:
    """(conv, turn, root, depth) from (conv, turn, reply_to): pointers are doubled until all have reached a root."""
    state = written(
        answers.select("conv", "turn", F.coalesce("reply_to", "turn").alias("root"), F.col("reply_to").isNotNull().cast("long").alias("depth")),
        "quotes",
    )
    while True:
        up = state.filter("depth > 0").select("conv", F.col("turn").alias("root"), F.col("root").alias("above"), F.col("depth").alias("more"))
        # In the end all messages of a long conversation point to one root.
        step = salted_join(state, up.hint("merge"), ["conv", "root"], how="left").select(
            "conv", "turn", F.coalesce("above", "root").alias("root"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"),
            F.col("above").isNotNull().alias("moved"),
        )
        step = written(step, "quotes")
        state = step.drop("moved")
        if step.filter("moved").isEmpty():
            return state


def link_quotes(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", text: str = "text") -> DataFrame:
    """``messages`` with body, quoted, linked, reply_to, answers, root and depth in place of the text and of columns so named.

    ``quoted`` and ``linked`` count single lines. Sort by conversation, root, depth and turn for the order of replies.
    """
    new = ["body", "quoted", "linked", "reply_to", "answers", "root", "depth"]
    kept = [c for c in messages.columns if c != text and c not in new]
    plain = messages.select(F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"), F.col(text).alias("text"))
    found = written(links(plain), "quotes")
    answer = found.filter("level = 1").groupBy("conv", "turn").agg(F.max(F.struct("votes", "origin"))["origin"].alias("reply_to"), F.sort_array(F.collect_set("origin")).alias("answers"))  # at most as many as it quotes lines
    keys = plain.filter("conv IS NOT NULL AND turn IS NOT NULL").select("conv", "turn").distinct()
    answers = written(keys.join(answer, ["conv", "turn"], "left"), "quotes")
    linked = found.groupBy("conv", "turn").agg(F.sum("n").alias("linked"))
    facts = answers.join(threads(answers), ["conv", "turn"]).join(linked, ["conv", "turn"], "left")
    facts = facts.select(*[F.col(c).alias(f"fact_{c}") for c in ("conv", "turn", "reply_to", "answers", "root", "depth", "linked")])
    rows = messages.select(F.struct(*messages.columns).alias("row"))
    own, at = F.col("row")[text], F.col("row")[turn].cast("long")
    lines = F.filter(F.split(F.coalesce(own, F.lit("")), "\r?\n"), lambda x: (quote_level(x) > 0) & (normalised(x) != ""))
    joined = rows.join(facts, (F.col("row")[conv] == F.col("fact_conv")) & (at == F.col("fact_turn")), "left")
    return joined.select(
        *[F.col("row")[c].alias(c) for c in kept], own_text(own).alias("body"), F.size(lines).cast("long").alias("quoted"),
        F.coalesce("fact_linked", F.lit(0)).cast("long").alias("linked"), F.col("fact_reply_to").alias("reply_to"),
        F.coalesce("fact_answers", F.array().cast("array<long>")).alias("answers"),
        F.coalesce("fact_root", at).alias("root"), F.coalesce("fact_depth", F.lit(0)).cast("long").alias("depth"),
    )


#: Turns of a block of a conversation.
BLOCK = 256


def conversations(linked: DataFrame, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """(conv, root, block, messages) from the result of ``link_quotes``: the messages below each root, without their quotes.

    A block holds the messages of 256 turns, in order: an answer always follows what it answers. Messages without a
    conversation or a turn are left out.
    """
    rows = linked.filter(F.col(conv).isNotNull() & F.col(turn).isNotNull())
    message = F.struct(F.col(turn).cast("long").alias("turn"), "depth", "reply_to", "body")
    return rows.groupBy(F.col(conv).alias("conv"), "root", F.floor(F.col(turn) / BLOCK).alias("block")).agg(
        F.sort_array(F.collect_list(message)).alias("messages")
    )

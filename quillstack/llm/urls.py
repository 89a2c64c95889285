"""URL filters: allow and block rules, and for the rest a multinomial naive Bayes over segmented host and path words.

Host names are split at anything but letters; each run of letters is cut into words by a unigram Viterbi search over
word counts of the pages' visible text. The counts that matter come by a join: the substrings of the distinct runs of
letters are looked up among the counted words, so no vocabulary is broadcast. Path words are the runs of letters and
digits of the path, all-digit ones as one token. Pages that a rule decides are labelled rows of the classifier, and so are a few
known words. The words of the rules themselves are no features: they stand for the rule, not for the page. Counts are
kept for a fixed number of hashed tokens, and both verdicts are equally likely before a url is read.

A null url, or one without ``://``, has an empty host and path and no tokens: it is allowed. With no
evidence, or equal scores, the verdict is allow. Repeated rows are judged alike. A null html has no words.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstack.functions.windows import salted_join
from quillstack.llm.common import map_batches, written

#: Hashed tokens of the classifier, and what is added to each count.
BINS, SMOOTH = 1 << 16, 1.0
#: Longest word the segmentation looks for, in letters.
LONGEST = 20
#: Words a task counts before it passes them on.
HELD = 200_000
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))

#: Words known to speak for a verdict, and how often each counts; pages that rules decide add to them.
SEEDS = (
    ("allow", "about blog docs edu forum help library news school science wiki"),
    ("block", "adult bet betting casino cheap farm loan loans pills poker porn sex spam viagra win xxx"),
)
SEED_WEIGHT = 20

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """From the host's end up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; null where none does. Of equals the first given."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, text in sorted(rules, key=lambda r: len(r[1])):
        name, _, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + rest)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, said).otherwise(verdict)
    return rule, verdict


def text_words(pages: DataFrame, html: str) -> DataFrame:
    """(word, n): lower-cased runs of letters of the visible text, of LONGEST letters at most."""

    def count(batches):
        hidden = re.compile(r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>|&[#\w]+;")
        letters, found = re.compile(r"[^\W\d_]+"), Counter()

        def out():
            rows = [(w, n) for w, n in found.items() if len(w) <= LONGEST]
            found.clear()
            return pa.RecordBatch.from_pydict({"word": pa.array([w for w, _ in rows], pa.string()), "n": pa.array([n for _, n in rows], pa.int64())})

        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text:
                    found.update(letters.findall(hidden.sub(" ", text).lower()))
                if len(found) > HELD:
                    yield out()
        yield out()

    counted = pages.select(F.col(html).alias("html")).mapInArrow(count, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n"))


def segment(run: str, counts: dict[str, int], total: int) -> list[str]:
    """The most probable split of ``run`` into words; an unknown word of n letters has probability 10 / (total * 10^n).

    Of equally probable splits the one with the longest last words is taken.
    """
    best: list[tuple[float, int]] = [(0.0, 0)]
    for end in range(1, len(run) + 1):
        top = None
        for start in range(max(0, end - LONGEST), end):
            word = run[start:end]
            n = counts.get(word, 0)
            score = best[start][0] + (math.log(n / total) if n else math.log(10 / total) - len(word) * math.log(10))
            if top is None or score > top[0] + 1e-12:
                top = (score, start)
        best.append(top)
    words, end = [], len(run)
    while end:
        words.append(run[best[end][1] : end])
        end = best[end][1]
    return words[::-1]


def segmented(hosts: DataFrame, words: DataFrame) -> DataFrame:
    """(host, words): the words of every distinct host, in order. ``hosts`` has distinct values of ``host``."""
    total = int(words.agg(F.sum("n")).first()[0] or 0) + 1
    runs = hosts.select("host", F.posexplode(F.filter(F.split("host", r"[^\p{L}]+"), lambda x: x != "")).alias("at", "run"))
    runs = written(runs, "url-runs")
    lone = runs.select("run").distinct()
    starts = F.sequence(F.lit(1), F.length("run"))
    parts = lone.select("run", F.explode(starts).alias("start")).select(
        "run", F.explode(F.sequence(F.lit(1), F.least(F.lit(LONGEST), F.length("run") - F.col("start") + 1))).alias("size"), "start"
    )
    parts = parts.select("run", F.substring("run", F.col("start"), F.col("size")).alias("word")).distinct()
    # A run's substrings that are words: bounded by the run's own length.
    known = parts.join(words, "word").groupBy("run").agg(F.collect_list(F.struct("word", "n")).alias("known"))

    def make():
        def one(batch):
            out = [segment(r, {k["word"]: k["n"] for k in ks or ()}, total) for r, ks in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.string()))], ["run", "words"])

        return one

    cut = map_batches(lone.join(known, "run", "left").select("run", "known"), make, "run string, words array<string>")
    per_run = runs.join(cut, "run").groupBy("host").agg(F.sort_array(F.collect_list(F.struct("at", "words"))).alias("w"))
    return per_run.select("host", F.flatten(F.col("w.words")).alias("words"))


def path_words(path: Column) -> Column:
    """Runs of letters and digits of a path, lower-cased; a run of digits is ``0``."""
    parts = F.filter(F.split(F.lower(path), r"[^\p{L}\p{N}]+"), lambda x: x != "")
    return F.transform(parts, lambda x: F.regexp_replace(x, r"^\p{N}+$", "0"))


def token_bins(tokens: list[str]) -> list[int]:
    return [zlib.crc32(t.encode("utf-8", "surrogatepass")) % BINS for t in tokens]


def learn(rows: DataFrame, seeds: tuple[tuple[str, str], ...] = SEEDS) -> np.ndarray:
    """Log-odds of block by bin, from rows of tokens and verdict; at most two numbers for each bin reach the driver."""

    def count(batches):
        seen = np.zeros((2, BINS), np.int64)
        for batch in batches:
            for tokens, verdict in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                np.add.at(seen[int(verdict == "block")], token_bins(tokens), 1)
        at = np.flatnonzero(seen.any(0))
        yield pa.RecordBatch.from_pydict({"bin": at.astype(np.int32), "allow": seen[0][at], "block": seen[1][at]})

    counts = rows.select("tokens", "verdict").mapInArrow(count, "bin int, allow long, block long")
    table = counts.groupBy("bin").agg(F.sum("allow").alias("allow"), F.sum("block").alias("block")).toArrow()
    seen = np.zeros((2, BINS))
    for side, column in enumerate(("allow", "block")):
        seen[side, table.column("bin").to_numpy()] += table.column(column).to_numpy()
    for verdict, words in seeds:
        np.add.at(seen[int(verdict == "block")], token_bins(words.split()), SEED_WEIGHT)
    # Smoothed over the tokens that occur; one that does not says nothing.
    occurs = seen.any(0)
    share = (seen + SMOOTH) / (seen.sum(1, keepdims=True) + SMOOTH * max(1, occurs.sum()))
    return np.where(occurs, np.log(share[1]) - np.log(share[0]), 0.0)


def judge(
    pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, id_col: str = "page_id", url: str = "url", html: str = "html"
) -> DataFrame:
    """(page_id, host, path, rule, verdict, score, words): the rule's verdict, else block where the log-odds are above 0.

    ``words`` are the tokens of host and path in order, ``score`` the log-odds of block.
    """
    parts = pages.select(F.col(id_col).alias("page_id"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    parts = written(parts.select("*", rule.alias("rule"), verdict.alias("ruled")), "urls")
    hosts = segmented(parts.select("host").distinct(), written(text_words(pages, html), "url-words"))
    # A host may hold most pages: its rows are spread over several tasks.
    none = F.expr("cast(array() as array<string>)")
    rows = salted_join(parts, hosts.select("host", F.col("words").alias("host_words")), ["host"], how="left")
    rows = written(rows.select(*parts.columns, F.concat(F.coalesce("host_words", none), path_words(F.col("path"))).alias("words")), "url-tokens")
    of_rules = sorted({w for _, r in rules for w in re.findall(r"[^\W\d_]+", r.lower())})
    # A token that a url repeats counts as often as it stands there.
    rows = rows.withColumn("tokens", F.filter("words", lambda w: ~F.array_contains(F.array(*map(F.lit, of_rules)).cast("array<string>"), w)))
    odds = learn(rows.filter("ruled IS NOT NULL").select("tokens", F.col("ruled").alias("verdict")))
    shared = pages.sparkSession.sparkContext.broadcast(odds)

    def make():
        table = shared.value

        def one(batch):
            score = [float(table[token_bins(t)].sum()) for t in batch.column(6).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score, pa.float64())], [*batch.schema.names, "score"])

        return one

    schema = rows.select("*", F.lit(0.0).alias("score")).schema
    scored = map_batches(rows, make, schema)
    method = F.when(F.round("score", 9) > 0, "block").otherwise("allow")
    return scored.select("page_id", "host", "path", "rule", F.coalesce("ruled", method).alias("verdict"), "score", "words")

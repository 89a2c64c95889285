"""A text index that stays current: postings in numbered batches, phrases by position, early stop by term bounds.

Each change writes the postings of its texts, the lengths of its documents and, last, one row of totals that makes the
batch count. A posting is dead once a later batch names its document; the batches since the last merge are all that a
search compares it with. ``merge`` writes the live postings as one batch.

A query's quoted parts are phrases: a document must hold each, as neighbouring words, and a phrase weighs like a term with
its own frequency. Without phrases a search stops early: terms are ordered by the most that any document can get from
them; documents that hold none of the strong terms cannot reach rank k, and are never scored.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstack.operators import textsearch as ts
from quillstack.sources.snapshots import SnapshotTable

POSTING = "doc_len long, term string, tf long, positions array<int>, bucket int"
BOUNDS = "term string, max_tf long, min_len long, bucket int"


def parse_query(text: str) -> tuple[list[list[str]], list[str]]:
    """Quoted phrases as lists of words, and the distinct terms outside quotes; a quoted word alone is a phrase of one."""
    phrases = [re.findall(r"[^\W_]+", part.lower()) for part in re.findall(r'"([^"]*)"', text)]
    return [p for p in phrases if p], ts.query_terms(re.sub(r'"[^"]*"', " ", text))


def phrase_starts(positions: Column, words: list[str]) -> Column:
    """Places at which ``words`` follow each other; ``positions`` maps words to their places."""
    def begins(offset: int, word: str) -> Column:
        return F.transform(positions[word], lambda place: place - offset)

    out = positions[words[0]]
    for offset, word in enumerate(words[1:], 1):
        out = F.array_intersect(out, begins(offset, word))
    return out


@dataclass
class LiveTextIndex:
    """An index below ``path`` over documents named by ``ids``; batches are written one at a time."""

    spark: SparkSession
    path: str
    ids: list[str]
    buckets: int = 64

    def __post_init__(self) -> None:
        keep = 1 << 30
        self.postings = SnapshotTable(self.spark, f"{self.path}/postings", ["bucket"], keep)
        self.terms = SnapshotTable(self.spark, f"{self.path}/terms", ["bucket"], keep)
        self.documents = SnapshotTable(self.spark, f"{self.path}/documents", keep=keep)
        self.totals = SnapshotTable(self.spark, f"{self.path}/totals", keep=keep)

    def _bucket(self, term: Column) -> Column:
        return F.pmod(F.xxhash64(term), F.lit(self.buckets)).cast("int")

    def _next(self) -> int:
        return max(t.next_version() for t in (self.postings, self.terms, self.documents, self.totals))

    def state(self) -> tuple[int, int, int, int]:
        """The newest batch, the batch of the last merge, live documents and their words."""
        known = self.totals.versions()
        if not known:
            return 0, 1, 0, 0
        row = self.totals.read(known[-1]).first()
        return known[-1], row["base"], row["docs"], row["words"]

    def _write(self, version: int, postings: DataFrame | None, documents: DataFrame) -> None:
        if postings is not None:
            rows = postings.withColumn("bucket", self._bucket(F.col("term")))
            # Postings are written where their texts were dealt to: a file for each bucket and task, nothing is shuffled again.
            self.postings.write(rows.sortWithinPartitions("bucket", "term"), version)
            bounds = self.postings.read(version, rows.schema).groupBy("bucket", "term").agg(F.max("tf").alias("max_tf"), F.min("doc_len").alias("min_len"))
            self.terms.write(bounds.repartition("bucket").sortWithinPartitions("bucket", "term"), version)
        if postings is not None and "doc_len" not in documents.columns:
            # The postings tell the lengths: texts are read once.
            lengths = self.postings.read(version, rows.schema).groupBy(*self.ids).agg(F.max("doc_len").alias("doc_len"))
            known = documents.join(lengths, self.ids, "left")
            documents = known.select(*self.ids, F.coalesce("doc_len", F.lit(0).cast("long")).alias("doc_len"), F.lit(False).alias("gone"))
        self.documents.write(documents, version)

    def _documents(self, first: int, last: int) -> DataFrame | None:
        """The newest row of each document in the batches ``first`` to ``last``."""
        out = None
        for n in [v for v in self.documents.versions() if first <= v <= last]:
            part = self.documents.read(n).withColumn("batch", F.lit(n))
            out = part if out is None else out.unionByName(part)
        if out is None:
            return None
        newest = F.max_by(F.struct("batch", "doc_len", "gone"), "batch").alias("newest")
        return out.groupBy(*self.ids).agg(newest).select(*self.ids, "newest.*")

    def _change(self, postings: DataFrame | None, documents: DataFrame) -> None:
        last, base, docs, words = self.state()
        version = self._next()
        self._write(version, postings, documents)
        added = self.documents.read(version)
        plus = added.agg(F.count_if(~F.col("gone")), F.coalesce(F.sum("doc_len"), F.lit(0))).first()
        before = self._documents(base, last)
        minus = (0, 0)
        if before is not None:
            old = before.filter("NOT gone").join(added.select(*self.ids), self.ids, "left_semi")
            minus = old.agg(F.count("*"), F.coalesce(F.sum("doc_len"), F.lit(0))).first()
        self._commit(version, base if last else version, docs + plus[0] - minus[0], words + plus[1] - minus[1])

    def _commit(self, version: int, base: int, docs: int, words: int) -> None:
        self.totals.write(self.spark.createDataFrame([(base, docs, words)], "base int, docs long, words long"), version)

    def upsert(self, corpus: DataFrame, text: str = "text") -> None:
        """Add or replace documents; ids are unique in a batch."""
        self._change(ts.postings(corpus, self.ids, text), corpus.select(*self.ids))

    def delete(self, ids: DataFrame) -> None:
        self._change(None, ids.select(*self.ids).distinct().select("*", F.lit(0).cast("long").alias("doc_len"), F.lit(True).alias("gone")))

    def _union(self, table: SnapshotTable, buckets: list[int] | None = None) -> DataFrame | None:
        last, base, _, _ = self.state()
        out = None
        known = [v for v in table.versions() if base <= v <= last]
        if known:
            ids = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in self.documents.read(last).schema.fields if f.name in self.ids)
            schema = T.StructType.fromDDL(BOUNDS if table is self.terms else f"{ids}, {POSTING}")
        for n in known:
            part = table.read(n, schema).withColumn("batch", F.lit(n))
            part = part if buckets is None else part.filter(F.col("bucket").isin(buckets))
            out = part if out is None else out.unionByName(part)
        return out

    def live(self, wanted: list[str] | None = None) -> DataFrame:
        """Live postings, of the terms in ``wanted`` only if given: then only their buckets are read."""
        last, base, _, _ = self.state()
        numbers = None
        if wanted is not None:
            asked = self.spark.createDataFrame([(w,) for w in wanted], "term string")
            numbers = [r[0] for r in asked.select(self._bucket(F.col("term"))).distinct().collect()]
        rows = self._union(self.postings, numbers)
        if rows is None:
            raise FileNotFoundError(f"nothing indexed below {self.path}")
        if wanted is not None:
            rows = rows.filter(F.col("term").isin(wanted))
        changed = self._documents(base + 1, last)
        if changed is not None:
            later = changed.select(*[F.col(c).alias(f"__{c}") for c in self.ids], F.col("batch").alias("__batch"))
            same = F.col("batch") < F.col("__batch")
            for c in self.ids:
                same = same & (F.col(c) == F.col(f"__{c}"))
            rows = rows.join(later, same, "left_anti")
        return rows.drop("bucket", "batch")

    def merge(self) -> None:
        """Write all live postings as one batch; older batches are no longer read."""
        last, base, docs, words = self.state()
        version = self._next()
        documents = self._documents(base, last).filter("NOT gone").drop("batch")
        self._write(version, self.live(), documents)
        self._commit(version, version, docs, words)

    def _mean(self) -> tuple[DataFrame, int, float]:
        _, _, docs, words = self.state()
        mean = words / docs if docs else 0.0
        return self.spark.createDataFrame([(docs, float(mean))], "docs long, mean_len double"), docs, mean

    def search(self, query: str, k: int) -> DataFrame:
        """Ids, bm25 and score of the best ``k``."""
        return self.ranked(query, k)[0]

    def ranked(self, query: str, k: int) -> tuple[DataFrame, DataFrame]:
        """The best ``k``, and the documents that were scored for it."""
        phrases, terms = parse_query(query)
        totals, docs, mean = self._mean()
        if phrases:
            hits = self._phrase_hits(phrases, terms)
            return ts.score_hits(hits, totals, self.ids, k), hits.select(*self.ids).distinct()
        hits = self.live(terms or [""]).select(*self.ids, "doc_len", "term", "tf")
        counts = {r["term"]: r["df"] for r in hits.groupBy("term").agg(F.count("*").alias("df")).collect()}  # one for each query term
        strong = self._strong(hits, counts, docs, mean, k)
        frequencies = self.spark.createDataFrame(list(counts.items()), "term string, df long")
        if len(strong) < len(counts):
            can = hits.filter(F.col("term").isin(strong)).select(*self.ids).distinct()
            hits = hits.filter(F.col("term").isin(strong)).unionByName(hits.filter(~F.col("term").isin(strong)).join(can, self.ids, "left_semi"))
        return ts.score_hits(hits, totals, self.ids, k, frequencies), hits.select(*self.ids).distinct()

    def _strong(self, hits: DataFrame, counts: dict[str, int], docs: int, mean: float, k: int) -> list[str]:
        """The terms without which no document can reach rank ``k``.

        The best documents of the terms that can give most, by these terms alone, show what rank ``k`` takes at least.
        """
        if len(counts) < 2:
            return list(counts)
        asked = list(counts)
        bounds = self._union(self.terms).filter(F.col("term").isin(asked) & F.col("bucket").isin(self._numbers(asked)))
        bounds = bounds.groupBy("term").agg(F.max("max_tf").alias("tf"), F.min("min_len").alias("doc_len")).collect()

        def weight(df: int, tf: int, length: int) -> float:
            idf = math.log(1 + (docs - df + 0.5) / (df + 0.5))
            return idf * tf * (ts.K1 + 1) / (tf + ts.K1 * (1 - ts.B + ts.B * length / mean))

        most = {r["term"]: weight(counts[r["term"]], r["tf"], r["doc_len"]) for r in bounds}
        order = sorted(most, key=lambda t: -most[t])
        first, met = [], 0
        for term in order:
            first.append(term)
            met += counts[term]
            if met >= k:
                break
        frequencies = self.spark.createDataFrame([(t, counts[t]) for t in first], "term string, df long")
        totals = self.spark.createDataFrame([(docs, float(mean))], "docs long, mean_len double")
        best = ts.score_hits(hits.filter(F.col("term").isin(first)), totals, self.ids, k, frequencies).agg(F.count("*"), F.min("bm25")).first()
        if best[0] < k:
            return list(counts)
        weak, total = set(), 0.0
        for term in reversed(order):
            total += most[term]
            if total >= best[1] - 1e-6:  # scores are rounded to nine digits
                break
            weak.add(term)
        return [t for t in order if t not in weak]

    def _numbers(self, terms: list[str]) -> list[int]:
        asked = self.spark.createDataFrame([(w,) for w in terms], "term string")
        return [r[0] for r in asked.select(self._bucket(F.col("term"))).distinct().collect()]

    def _phrase_hits(self, phrases: list[list[str]], terms: list[str]) -> DataFrame:
        """(ids, doc_len, term, tf) of phrases and terms in the documents that hold every phrase."""
        distinct = list(dict.fromkeys(map(tuple, phrases)))
        asked = sorted({w for p in distinct for w in p})
        rows = self.live(asked).groupBy(*self.ids, "doc_len").agg(
            F.map_from_entries(F.collect_list(F.struct("term", "positions"))).alias("at")  # one entry for each word of the phrases
        )
        rows = rows.filter(F.size("at") == len(asked))
        for i, words in enumerate(distinct):
            rows = rows.withColumn(f"__p{i}", F.size(phrase_starts(F.col("at"), list(words))).cast("long")).filter(F.col(f"__p{i}") > 0)
        names = [F.struct(F.lit(" ".join(words)).alias("term"), F.col(f"__p{i}").alias("tf")) for i, words in enumerate(distinct)]
        hits = rows.select(*self.ids, "doc_len", F.inline(F.array(*names)))
        terms = [t for t in terms if (t,) not in distinct]
        if not terms:
            return hits
        more = self.live(terms).select(*self.ids, "doc_len", "term", "tf")
        return hits.unionByName(more.join(hits.select(*self.ids).distinct(), self.ids, "left_semi"))

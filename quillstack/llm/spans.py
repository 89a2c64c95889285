"""Substring deduplication: a de Bruijn graph of token k-mers, compacted, names the long spans that occur earlier.

Every window of 20 words is an edge from its first 19 to its last 19 words. Consecutive windows with one minimiser (the
least hash among their runs of five words) stay together as a piece, a path fragment that needs one row; equal windows
lie in equal pieces or in pieces with the same minimiser. Only pieces whose minimiser occurs twice can repeat, a join
finds them. A piece that has occurred earlier is covered as a whole; the first of several different pieces with one
minimiser is a place where paths branch, and is resolved edge by edge. Covered fragments that continue each other both
in the document and at their source compact into one span with source coordinates.

Hashes only propose: at last the words of every span are read at both its places and compared by a cryptographic digest;
a span whose words differ is dropped. Texts that have no part in a step stay where they are: a bitmap of the wanted ids or
minimisers, of bounded size, is looked at inside the task, and what it lets through by mistake is joined away.

Words are runs without space and U+0009 to U+000D, unchanged. Earlier means a smaller id, or an earlier place in the
same document. A null text has no words. A document with a null id loses nothing and is no source; ids should be
unique, rows that share one lose what any of them loses, and are no source for each other's spans.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillstack.llm.common import U64, Words, discard, grams, keys, map_batches, mix, release_shuffles, written
from quillstack.llm.neardup import bitmap_of, has_bit, texts_of

SPAN, CORE = 20, 5
PIECE = "least long, piece long, doc long, at int, n int, again boolean"


class Edges:
    """The windows of a batch of texts: hash, minimiser, row and place in it."""

    def __init__(self, column: pa.Array, span: int = SPAN, core: int = CORE) -> None:
        words = Words(column)
        counts = words.counts()
        row = np.repeat(np.arange(len(counts)), counts)
        h, n = words.hashes, len(words.hashes) - span + 1
        if n <= 0:
            self.hash = self.least = np.empty(0, U64)
            self.row = self.at = np.empty(0, np.int64)
            return
        least, width, wanted = grams(h, core, 2), 1, span - core + 1
        while width < wanted:
            step = min(width, wanted - width)
            least = np.minimum(least[:-step], least[step:])
            width += step
        inside = np.flatnonzero(row[:n] == row[span - 1 :])
        self.hash, self.least = grams(h, span, 1)[inside], mix(least[inside])
        self.row = row[inside]
        self.at = inside - words.first[self.row]


def pieces(docs: DataFrame, wanted: np.ndarray | None = None) -> DataFrame:
    """PIECE rows of (doc, text): minimiser, hash, place and number of windows; ``again``: a window recurs in its document.

    ``wanted`` is a bitmap of minimisers; pieces with others are left out.
    """
    shared = docs.sparkSession.sparkContext.broadcast(wanted)

    def make():
        bits = shared.value

        def one(batch):
            e = Edges(batch.column(1))
            if not len(e.hash):
                return
            new = np.ones(len(e.at), bool)
            new[1:] = (e.at[1:] != e.at[:-1] + 1) | (e.row[1:] != e.row[:-1]) | (e.least[1:] != e.least[:-1])
            starts = np.flatnonzero(new)
            sizes = np.diff(np.append(starts, len(new)))
            place = np.arange(len(new)) - np.repeat(starts, sizes)
            whole = mix(np.add.reduceat(e.hash * keys(int(place.max()) + 1, 3)[place], starts) + sizes.astype(U64))
            own = e.hash ^ mix(e.row.astype(U64))
            ordered = np.sort(own)
            twice = ordered[1:][ordered[1:] == ordered[:-1]]
            again = np.logical_or.reduceat(np.isin(own, twice), starts) if len(twice) else np.zeros(len(starts), bool)
            kept = slice(None) if bits is None else np.flatnonzero(has_bit(bits, e.least[starts]))
            starts, whole, sizes, again = starts[kept], whole[kept], sizes[kept], again[kept]
            yield pa.RecordBatch.from_pydict({
                "least": e.least[starts].view(np.int64), "piece": whole.view(np.int64), "doc": batch.column(0).take(pa.array(e.row[starts])),
                "at": e.at[starts].astype(np.int32), "n": sizes.astype(np.int32), "again": again,
            })

        return one

    return map_batches(docs, make, PIECE)


def windows_of(rows: DataFrame) -> DataFrame:
    """(least, hash, doc, at): the windows of the pieces listed in ``wanted`` of (doc, text, wanted)."""

    def make():
        def one(batch):
            e = Edges(batch.column(1))
            if not len(e.hash):
                return
            ends = np.cumsum(np.bincount(e.row, minlength=batch.num_rows))
            first = ends - np.bincount(e.row, minlength=batch.num_rows)
            mark = np.zeros(len(e.hash) + 1, np.int64)
            wanted = batch.column(2)
            owner = np.repeat(np.arange(batch.num_rows), pc.list_value_length(wanted).to_numpy(zero_copy_only=False))
            flat = wanted.flatten()
            at, n = (flat.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
            np.add.at(mark, first[owner] + at, 1)
            np.add.at(mark, first[owner] + at + n, -1)
            chosen = np.flatnonzero(np.cumsum(mark[:-1]) > 0)
            yield pa.RecordBatch.from_pydict({
                "least": e.least[chosen].view(np.int64), "hash": e.hash[chosen].view(np.int64),
                "doc": batch.column(0).take(pa.array(e.row[chosen])), "at": e.at[chosen].astype(np.int32),
            })

        return one

    return map_batches(rows, make, "least long, hash long, doc long, at int")


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, at, n, source, source_at): spans of n windows, so n + 19 words, from word ``at`` on, that occur earlier."""
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text).alias("text")).filter("doc IS NOT NULL AND text IS NOT NULL")
    weight = F.sum(F.when(F.col("again"), 2).otherwise(1))
    several = written(pieces(base).groupBy("least").agg(weight.alias("times")).filter("times > 1").select("least"), "spans-least")
    release_shuffles(spark)
    found = written(pieces(base, bitmap_of(several)).join(several, "least", "left_semi"), "spans-pieces")
    discard(several)
    release_shuffles(spark)
    # The source of each piece is its first occurrence; a minimiser with several pieces is a branch.
    source = found.groupBy("least", "piece").agg(F.min(F.struct("doc", "at")).alias("source"), F.max("again").alias("again"))
    first_met = written(source, "spans-sources")
    branch = written(first_met.groupBy("least").agg(F.count("*").alias("k")).filter("k > 1").select("least"), "spans-branches")
    source = first_met.join(branch.withColumn("branches", F.lit(True)), "least", "left").select(
        "least", "piece", "source", (F.coalesce("branches", F.lit(False)) | F.col("again")).alias("open")
    )
    met = written(found.drop("again").join(source, ["least", "piece"]), "spans-met")
    discard(found, first_met, branch)
    release_shuffles(spark)
    first = (F.col("source.doc") == F.col("doc")) & (F.col("source.at") == F.col("at"))
    whole = met.filter(~first).select("doc", "at", "n", F.col("source.doc").alias("source"), F.col("source.at").alias("source_at"))
    # Branches: their windows one by one, from the first occurrences only; an earlier window is always in one of them.
    open_ = met.filter(first & F.col("open")).groupBy("doc").agg(F.collect_list(F.struct("at", "n")).alias("wanted"))
    open_ = written(open_, "spans-open")
    branching = texts_of(base, bitmap_of(open_.select("doc"))).join(open_.hint("shuffle_hash"), "doc").select("doc", "text", "wanted")
    edges = written(windows_of(branching), "spans-edges")
    discard(open_)
    release_shuffles(spark)
    origin = edges.groupBy("least", "hash").agg(F.min(F.struct("doc", "at")).alias("source"), F.count("*").alias("times"))
    origin = written(origin.filter("times > 1").drop("times"), "spans-origins")
    single = edges.join(origin, ["least", "hash"]).filter(~first).select(
        "doc", "at", F.lit(1).alias("n"), F.col("source.doc").alias("source"), F.col("source.at").alias("source_at")
    )
    single = written(single, "spans-single")
    discard(edges, origin)
    release_shuffles(spark)
    # Fragments on one line of (place, source place) that touch are one path.
    line = Window.partitionBy("doc", "source", "shift").orderBy("at")
    both = whole.unionByName(single).withColumn("shift", F.col("at") - F.col("source_at"))
    both = both.withColumn("new", (F.col("at") > F.coalesce(F.lag(F.col("at") + F.col("n")).over(line), F.lit(-1))).cast("int"))
    both = both.withColumn("path", F.sum("new").over(line))
    spans = both.groupBy("doc", "source", "shift", "path").agg(
        F.min("at").alias("at"), F.sum("n").cast("int").alias("n"), F.min("source_at").alias("source_at")
    )
    spans = written(spans.select("doc", "at", "n", "source", "source_at"), "spans-proposed")
    discard(met, single)
    release_shuffles(spark)
    out = written(verified(spans, base), "spans")
    discard(spans)
    release_shuffles(spark)
    return out


def verified(spans: DataFrame, base: DataFrame, span: int = SPAN) -> DataFrame:
    """The spans whose words are the same at both places of (doc, text)."""
    places = spans.select("doc", "at", "n").unionByName(spans.select(F.col("source").alias("doc"), F.col("source_at").alias("at"), "n")).distinct()
    asked = written(places.groupBy("doc").agg(F.collect_list(F.struct("at", "n")).alias("places")), "spans-places")
    rows = texts_of(base, bitmap_of(asked.select("doc"))).join(asked.hint("shuffle_hash"), "doc").select("doc", "text", "places")

    def make():
        def one(batch):
            docs, at, n, digests = [], [], [], []
            for doc, text, places in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist()):
                words = text.split()
                for p in places:
                    docs.append(doc)
                    at.append(p["at"])
                    n.append(p["n"])
                    digests.append(hashlib.blake2b(b" ".join(words[p["at"] : p["at"] + p["n"] + span - 1]), digest_size=16).digest())
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(at, pa.int32()), pa.array(n, pa.int32()), pa.array(digests, pa.binary())], ["doc", "at", "n", "words"])

        return one

    # Rows that share an id have several texts at one place: their words count as unequal.
    read = map_batches(rows, make, "doc long, at int, n int, words binary")
    read = written(read.groupBy("doc", "at", "n").agg(F.min("words").alias("words"), F.max("words").alias("last")).filter("words = last").drop("last"), "spans-words")
    discard(asked)
    release_shuffles(base.sparkSession)
    there = read.select(F.col("doc").alias("source"), F.col("at").alias("source_at"), "n", F.col("words").alias("source_words"))
    # A passage may be the source of very many spans: Spark splits the larger partitions of a merge join.
    both = spans.join(read, ["doc", "at", "n"]).join(there.hint("merge"), ["source", "source_at", "n"])
    return both.filter("words = source_words").select("doc", "at", "n", "source", "source_at")


def remove_spans(docs: DataFrame, spans: DataFrame, id_col: str = "doc_id", text: str = "text", span: int = SPAN) -> DataFrame:
    """``docs`` with the words outside all spans, joined by one blank, as ``text``, and n_words and n_removed.

    A null text stays null. Columns of ``docs`` named n_words or n_removed are replaced.
    """
    kept = [c for c in docs.columns if c not in ("n_words", "n_removed")]
    cuts = spans.groupBy("doc").agg(F.collect_list(F.struct("at", "n")).alias("cuts"))
    cuts = written(cuts, "spans-cuts")
    shared = docs.sparkSession.sparkContext.broadcast(bitmap_of(cuts.select("doc")))
    identity = kept.index(id_col)

    def cut_texts(wanted: bool) -> DataFrame:
        """The rows that may have spans, or those that have none."""

        def make():
            bits = shared.value

            def one(batch):
                ids = batch.column(identity).cast(pa.int64()).fill_null(-1).to_numpy().view(U64)
                may = has_bit(bits, ids) & batch.column(identity).is_valid().to_numpy(zero_copy_only=False)
                yield batch.filter(pa.array(may == wanted))

            return one

        return map_batches(docs.select(*kept), make, docs.select(*kept).schema)

    rows = cut_texts(True).select(F.struct(*kept).alias("row")).withColumn("own", F.col("row")[id_col].cast("long"))
    rows = rows.join(cuts.hint("shuffle_hash"), F.col("own") == F.col("doc"), "left").select("row.*", F.col("cuts").alias("_cuts_"))
    untouched = cut_texts(False).select(*kept, F.lit(None).cast(rows.schema["_cuts_"].dataType).alias("_cuts_"))
    rows = rows.unionByName(untouched)
    schema = docs.select(*kept, F.lit(0).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_removed")).schema
    where = kept.index(text)

    def make():
        def one(batch):
            out, sizes, gone = [], [], []
            for raw, cut in zip(batch.column(where).cast(pa.binary()).to_pylist(), batch.column(len(kept)).to_pylist()):
                words = (raw or b"").split()
                sizes.append(len(words))
                if cut:
                    mark = np.zeros(len(words) + 1, np.int64)
                    for c in cut:
                        mark[c["at"]] += 1
                        mark[min(len(words), c["at"] + c["n"] + span - 1)] -= 1
                    words = [w for w, c in zip(words, np.cumsum(mark[:-1]).tolist()) if not c]
                gone.append(sizes[-1] - len(words))
                out.append(None if raw is None else b" ".join(words))
            columns = list(batch.columns[: len(kept)])
            columns[where] = pa.array(out, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sizes, pa.int64()), pa.array(gone, pa.int64())], [*kept, "n_words", "n_removed"])

        return one

    return map_batches(rows, make, schema)

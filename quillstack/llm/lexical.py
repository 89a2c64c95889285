"""Ranked lexical search by presence masks.

Documents lie in blocks. In a block every term of the asked items has a bitmap of the documents that hold it; the bitmaps
of an item's terms, read across, are each document's mask: which of the terms it holds. Documents with one mask form a
group, and the sum of its terms' largest shares in the block bounds the score of the whole group. Groups are evaluated by
descending bound until the next bound is below the k-th best score, the best of earlier blocks of the task included.

Terms are runs of letters, digits and signs beyond ASCII, only A-Z lower-cased. A term's weight is
floor(1000 * ln((2N + 2) / (2 df + 1))); a document's share of it is w * ((1000000000 * tf) div (1000 * tf + 8 * m)) with
m = 25 + ((75 * n * N) div L). All but the logarithm is in 64-bit integers.

The first pass reads every whole text once and keeps of it the number of terms and the counts of asked terms; the second
reads only those. Items are asked in batches of bounded size, one pass each, so what is broadcast has a bound.

A null text has no terms. Documents without an id count in all statistics, but are not listed. Repeated documents are
documents. Each row of the items is an item of its own, also one without an id; one without terms has no results.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstack.functions.windows import top_per_group
from quillstack.llm.common import map_batches, written

#: Bytes of item texts asked in one pass (a longer item is asked alone); bytes of a text cut at once.
ASKED, SLICE = 1 << 18, 1 << 20
#: Shares held for one block of documents (terms x documents, which bounds a task's memory), its documents at most, and those scored at a time.
CELLS, BLOCK, STEP = 1 << 22, 2048, 256
#: A-Z lower-cased, all that is not in a term a space.
_TERMS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms_of(text: bytes | None):
    """The terms of a text, a list for each slice of it; a slice ends where a term ends."""
    data, at = (text or b"").translate(_TERMS), 0
    while at < len(data):
        end = data.find(b" ", at + SLICE)
        end = len(data) if end < 0 else end
        yield data[at:end].split()
        at = end


def batches_of(items: DataFrame, item_id: str, text: str, asked: int = ASKED):
    """Lists of (item id, terms with their counts) whose texts hold ``asked`` bytes, or a single item."""
    held, size = [], 0
    for row in items.select(F.col(item_id).alias("i"), F.col(text).cast("string").alias("t")).orderBy("i", "t").toLocalIterator():
        data = (row["t"] or "").encode()
        counts: Counter = Counter()
        for part in terms_of(data):
            counts.update(part)
        if not counts:
            continue
        if held and size + len(data) > asked:
            yield held
            held, size = [], 0
        held.append((row["i"], counts))
        size += len(data)
    if held:
        yield held


def postings(docs: DataFrame, vocabulary: list[bytes], id_col: str, text: str) -> DataFrame:
    """(doc, n, terms, tfs): of each document with terms their number, and places in ``vocabulary`` with counts."""
    shared = docs.sparkSession.sparkContext.broadcast({t: i for i, t in enumerate(vocabulary)})

    def make():
        place = shared.value
        known = place.keys()

        def one(batch):
            ids, sizes, found, tfs, ends = [], [], [], [], [0]
            for i, x in enumerate(batch.column(1).cast(pa.large_binary())):
                counts, n = Counter(), 0
                for part in terms_of(x.as_buffer().to_pybytes() if x.is_valid else None):
                    n += len(part)
                    seen = Counter(part)
                    for t in known & seen.keys():
                        counts[t] += seen[t]
                if n:
                    hits = sorted((place[t], c) for t, c in counts.items())
                    ids.append(i)
                    sizes.append(n)
                    found += [h[0] for h in hits]
                    tfs += [h[1] for h in hits]
                    ends.append(len(found))
            ends = pa.array(ends, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(ids, pa.int64())), pa.array(sizes, pa.int64()),
                    pa.ListArray.from_arrays(ends, pa.array(found, pa.int32())), pa.ListArray.from_arrays(ends, pa.array(tfs, pa.int64())),
                ],
                ["doc", "n", "terms", "tfs"],
            )

        return one

    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text).cast("string").alias("text"))
    return map_batches(rows, make, "doc long, n long, terms array<int>, tfs array<long>")


def masks_of(bits: np.ndarray) -> np.ndarray:
    """Of packed bitmaps, one row a term, a number for each document: equal for documents with the same terms."""
    code = None
    for at in range(0, len(bits), 64):
        words = np.zeros((64, bits.shape[1] * 8), bool)
        part = np.unpackbits(bits[at : at + 64], axis=1, bitorder="little")
        words[: len(part)] = part
        mask = np.packbits(words, axis=0, bitorder="little").T.copy().view(np.uint64)[:, 0]
        if code is None:
            code = mask
        else:
            mine, theirs = np.unique(code, return_inverse=True)[1], np.unique(mask, return_inverse=True)[1]
            code = (mine * (int(theirs.max()) + 1) + theirs).astype(np.uint64)
    return code


def blocks(batches, size: int):
    """Tables of ``size`` rows, and a smaller last one."""
    held, rows = [], 0
    for batch in batches:
        for at in range(0, batch.num_rows, size):
            part = batch.slice(at, size)
            if rows + part.num_rows > size:
                yield pa.Table.from_batches(held).combine_chunks()
                held, rows = [], 0
            held.append(part)
            rows += part.num_rows
    if rows:
        yield pa.Table.from_batches(held).combine_chunks()


class Block:
    """Bitmaps and shares of the asked terms in one block of documents."""

    def __init__(self, ids: np.ndarray, n: np.ndarray, terms: np.ndarray, tfs: np.ndarray, per: np.ndarray, weights: np.ndarray, docs: int, length: int) -> None:
        m = 25 + 75 * n * docs // length
        at = np.repeat(np.arange(len(ids)), per)
        self.ids = ids
        self.present, row = np.unique(terms, return_inverse=True)
        self.shares = np.zeros((len(self.present), -(-len(ids) // 8) * 8), np.int64)
        self.shares[row, at] = weights[terms] * (1_000_000_000 * tfs // (1000 * tfs + 8 * m[at]))
        held = np.zeros(self.shares.shape, bool)
        held[row, at] = True
        self.bits = np.packbits(held, axis=1, bitorder="little")
        self.most = self.shares.max(1, initial=0)

    def best(self, terms: np.ndarray, times: np.ndarray, k: int, held: list[tuple[int, int]]) -> list[tuple[int, int]]:
        """The ``k`` best (-score, id) of ``held`` and of this block's documents for an item."""
        at = np.searchsorted(self.present, terms)
        here = np.flatnonzero(self.present[np.minimum(at, len(self.present) - 1)] == terms) if len(self.present) else []
        if not len(here):
            return held
        rows, times = at[here], times[here]
        most = self.most[rows] * times
        # A bound of all masks: no group of the block is better than all terms together.
        if len(held) == k and most.sum() < -held[-1][0]:
            return held
        _, first, group = np.unique(masks_of(self.bits[rows])[: len(self.ids)], return_index=True, return_inverse=True)
        # A group's mask is that of any of its documents.
        has = self.bits[rows][:, first // 8] >> (first % 8).astype(np.uint8) & 1
        bound = (has.astype(np.int64).T @ most)[group]
        order = np.argsort(-bound, kind="stable")
        bound = bound[order]
        for start in range(0, len(order), STEP):
            if bound[start] <= 0 or len(held) == k and bound[start] < -held[-1][0]:
                break
            members = order[start : start + STEP]
            score = times @ self.shares[np.ix_(rows, members)]
            good = np.flatnonzero(score >= (-held[-1][0] if len(held) == k else 1))
            if len(good) > k:
                good = good[np.lexsort((self.ids[members[good]], -score[good]))[:k]]
            if len(good):
                held = sorted(held + list(zip((-score[good]).tolist(), self.ids[members[good]].tolist())))[:k]
        return held


def search(posted: DataFrame, items: list[tuple[object, Counter]], vocabulary: list[bytes], k: int) -> DataFrame:
    """(item, doc, score): each task's ``k`` best documents of every item, by the item's place in ``items``."""
    spark = posted.sparkSession
    docs, length = posted.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(len(vocabulary), np.int64)
    for term, count in posted.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*")).collect():
        df[term] = count  # one row for each asked term
    weights = np.array([math.floor(1000 * math.log((2 * docs + 2) / (2 * int(d) + 1))) for d in df], np.int64)
    place = {t: i for i, t in enumerate(vocabulary)}
    asked = [sorted((place[t], c) for t, c in counts.items()) for _, counts in items]
    asked = [(np.array([t for t, _ in x], np.int64), np.array([c for _, c in x], np.int64)) for x in asked]
    shared = spark.sparkContext.broadcast((asked, weights))

    def run(batches):
        asked, weights = shared.value
        best: list[list[tuple[int, int]]] = [[] for _ in asked]
        for part in blocks(batches, max(8, min(BLOCK, CELLS // len(weights)))):
            terms = part.column(2).chunk(0)
            block = Block(
                part.column(0).to_numpy(), part.column(1).to_numpy(), terms.flatten().to_numpy().astype(np.int64),
                part.column(3).chunk(0).flatten().to_numpy(), np.diff(terms.offsets.to_numpy()), weights, docs, length,
            )
            best = [block.best(*item, k, held) for item, held in zip(asked, best)]
        rows = [(i, d, -s) for i, held in enumerate(best) for s, d in held]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows)], ["item", "doc", "score"])

    return posted.filter("doc IS NOT NULL").mapInArrow(run, "item long, doc long, score long")


def rank_documents(
    docs: DataFrame, items: DataFrame, k: int = 10, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text",
    asked: int = ASKED,
) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` highest scores above 0 of each item, equal scores by ascending document id."""
    spark = docs.sparkSession
    kind = items.schema[item_id].dataType.simpleString()
    out = spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    for batch in batches_of(items, item_id, item_text, asked):
        vocabulary = sorted(set().union(*(counts for _, counts in batch)))
        posted = written(postings(docs, vocabulary, doc_id, text), "lexical-postings")
        found = written(search(posted, batch, vocabulary, k), "lexical-found")
        best = top_per_group(found, ["item"], [F.desc("score"), F.asc("doc")], k)
        names = spark.createDataFrame([(i, x[0]) for i, x in enumerate(batch)], f"item long, item_id {kind}")
        out = out.unionByName(best.join(names, "item").select("item_id", F.col("rank").cast("int").alias("rank"), F.col("doc").alias("doc_id"), "score"))
    return out

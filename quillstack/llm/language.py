"""Language mixtures of documents: expectation-maximisation over words with n-gram likelihoods, penalised for each language.

A word is a run of letters, lower-cased; its likelihood in a language is the product of the language's probabilities of
its character trigrams (a blank stands on either side of a word). A document is a mixture of languages: its words come
from language l with share s(l). EM finds the shares of all languages; then, for the first 1, 2, 3, ... languages by
share, the mixture is fitted again, and the set with the best log-likelihood less half of log(words) for each further
language is kept. The prediction is the language with the largest share of that set, the score its share.

Profiles are counts of hashed trigrams over all labelled documents, of fixed size for each language.

A null text, or one without letters, is ``und`` with score 0 and no languages; so is every text when nothing is labelled.
Ties go to the language that sorts first. Texts of any length are worked through in slices of bounded size.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstack.llm.common import forget_kept, map_batches

#: Hashed trigrams of a profile, and what is added to each count.
BINS, SMOOTH = 1 << 17, 0.2
#: Rounds of EM over all languages and over a chosen set.
ROUNDS, ROUNDS_OF_SET = 8, 6
#: Characters worked on at a time.
SLICE = 1 << 20
UNKNOWN = "und"


class Letters:
    """Splits texts into words and gives the trigram bin around every letter."""

    def __init__(self) -> None:
        points = map(chr, range(sys.maxunicode + 1))
        self.letter = np.fromiter((c.isalpha() for c in points), bool, sys.maxunicode + 1)

    def __call__(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """(bins of all letters in order, places in them where words begin, places of these in the text)."""
        codes = np.frombuffer(f" {text} ".encode("utf-32-le", "surrogatepass"), np.uint32)
        letter = self.letter[codes]
        at = np.flatnonzero(letter)
        if not len(at):
            return np.empty(0, np.int64), at, at
        codes = np.where(letter, codes, np.uint32(32)).astype(np.uint64)
        code = codes[at - 1] * np.uint64(0x9E3779B97F4A7C15) + codes[at] * np.uint64(0xC2B2AE3D27D4EB4F) + codes[at + 1] * np.uint64(0x165667B19E3779F9)
        code = (code ^ (code >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        first = np.flatnonzero(~letter[at - 1])
        return (code >> np.uint64(47)).astype(np.int64), first, at[first] - 1


def slices(texts: list[str | None]):
    """(row numbers, text) in pieces of about SLICE characters: many short texts, or a part of a long one cut at a blank."""
    rows, size = [], 0
    for row, text in enumerate(texts):
        text = (text or "").lower()
        while len(text) > SLICE:
            cut = max(text.rfind(" ", SLICE // 2, SLICE), text.rfind("\n", SLICE // 2, SLICE))
            cut = cut if cut > 0 else SLICE
            yield [row], [text[:cut]]
            text = text[cut:]
        if size + len(text) > SLICE and rows:
            yield [r for r, _ in rows], [t for _, t in rows]
            rows, size = [], 0
        rows.append((row, text))
        size += len(text)
    if rows:
        yield [r for r, _ in rows], [t for _, t in rows]


@dataclass
class Profiles:
    """Log-probabilities of the bins, a column for each language; ``languages`` is sorted."""

    languages: list[str]
    logs: np.ndarray


def learn(docs: DataFrame, text: str = "text", lang: str = "lang") -> Profiles:
    """Profiles of all languages in ``lang``; rows with a null text or language are left out.

    The driver gets at most BINS numbers for each language.
    """
    rows = docs.select(F.col(text).alias("text"), F.col(lang).alias("lang")).filter("text IS NOT NULL AND lang IS NOT NULL")

    def count(batches):
        forget_kept()
        letters, found = Letters(), {}
        for batch in batches:
            texts, names = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for name in set(names):
                bins = found.setdefault(name, np.zeros(BINS, np.int64))
                for _, part in slices([t for t, n in zip(texts, names) if n == name]):
                    bins += np.bincount(letters("\n".join(part))[0], minlength=BINS)
        for name, bins in found.items():
            at = np.flatnonzero(bins)
            yield pa.RecordBatch.from_pydict({"lang": [name] * len(at), "bin": at.astype(np.int32), "n": bins[at]})

    counts = rows.mapInArrow(count, "lang string, bin int, n long").groupBy("lang", "bin").agg(F.sum("n").alias("n"))
    table = counts.toArrow()
    names = sorted(set(table.column(0).to_pylist()))
    logs = np.full((BINS, len(names)), SMOOTH)
    column = {n: i for i, n in enumerate(names)}
    at = np.array([column[n] for n in table.column(0).to_pylist()], np.int64)
    logs[table.column(1).to_numpy(), at] += table.column(2).to_numpy()
    return Profiles(names, np.log(logs / logs.sum(0, keepdims=True)).astype(np.float32) if names else logs.astype(np.float32))


def _mixture(p: np.ndarray, doc: np.ndarray, starts: np.ndarray, words: np.ndarray, share: np.ndarray, rounds: int):
    """Shares after ``rounds`` of EM, and each document's log-likelihood at the last but one."""
    total = None
    for _ in range(rounds):
        part = p * share[doc]
        each = part.sum(1)
        np.maximum(each, 1e-30, out=each)
        part /= each[:, None]
        share = np.add.reduceat(part, starts, axis=0) / words[:, None]
        total = each
    return share, np.add.reduceat(np.log(total, dtype=np.float64), starts)


def mixtures(logs: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shares (documents x languages, 0 outside the chosen set) and numbers of languages chosen.

    ``logs`` has a row for each word, ``sizes`` the number of words of each document (at least 1).
    """
    n_langs = logs.shape[1]
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    doc = np.repeat(np.arange(len(sizes)), sizes)
    top = logs.max(1, keepdims=True)
    p = np.exp(logs - top)
    words = sizes.astype(np.float32)
    share, _ = _mixture(p, doc, starts, words, np.full((len(sizes), n_langs), 1 / n_langs, np.float32), ROUNDS)
    order = np.argsort(-share, axis=1, kind="stable")
    floor = np.add.reduceat(top[:, 0].astype(np.float64), starts)
    sums = np.add.reduceat(logs, starts, axis=0, dtype=np.float64) - floor[:, None]
    # One language: the likelihood is the sum itself.
    first = sums.argmax(1)
    chosen = np.zeros_like(share)
    chosen[np.arange(len(sizes)), first] = 1
    best, size = sums[np.arange(len(sizes)), first], np.ones(len(sizes), np.int64)
    open_ = np.arange(len(sizes))
    for m in range(2, n_langs + 1):
        # A further language is tried if the words expected in it could outweigh its penalty.
        open_ = open_[share[open_, order[open_, m - 1]] * words[open_] > np.log(words[open_]) / 2]
        if not len(open_):
            break
        own = np.concatenate([np.arange(starts[d], starts[d] + sizes[d]) for d in open_])
        sub_sizes = sizes[open_]
        sub_starts = np.concatenate([[0], np.cumsum(sub_sizes)[:-1]])
        allowed = np.zeros((len(open_), n_langs), bool)
        np.put_along_axis(allowed, order[open_, :m], True, 1)
        begin = np.where(allowed, share[open_], 0)
        begin /= begin.sum(1, keepdims=True)
        fitted, score = _mixture(p[own], np.repeat(np.arange(len(open_)), sub_sizes), sub_starts, words[open_], begin, ROUNDS_OF_SET)
        score -= (m - 1) / 2 * np.log(sub_sizes)
        better = score > best[open_]
        chosen[open_[better]], best[open_[better]], size[open_[better]] = fitted[better], score[better], m
    return chosen, size


def predict(docs: DataFrame, profiles: Profiles, text: str = "text") -> DataFrame:
    """``docs`` with lang_pred, score, languages and shares (descending); columns of these names are replaced."""
    new = ["lang_pred", "score", "languages", "shares"]
    kept = docs.drop(*new)
    schema = kept.select(
        "*", F.lit("").alias("lang_pred"), F.lit(0.0).alias("score"), F.expr("cast(array() as array<string>)").alias("languages"),
        F.expr("cast(array() as array<double>)").alias("shares"),
    ).schema
    where, shared = kept.columns.index(text), docs.sparkSession.sparkContext.broadcast(profiles)

    def make():
        letters, model = Letters(), shared.value

        def one(batch):
            n = batch.num_rows
            pred, score, langs, shares = [UNKNOWN] * n, [0.0] * n, [[] for _ in range(n)], [[] for _ in range(n)]
            logs, owner = [], []
            for rows, texts in slices(batch.column(where).to_pylist()) if model.languages else ():
                bins, first, place = letters("\n".join(texts))
                if not len(bins):
                    continue
                logs.append(np.add.reduceat(model.logs[bins], first, axis=0))
                ends = np.cumsum([len(t) + 1 for t in texts])
                owner.append(np.array(rows)[np.searchsorted(ends, place, side="right")])
            if logs:
                logs, owner = np.concatenate(logs), np.concatenate(owner)
                if (np.diff(owner) < 0).any():
                    order = np.argsort(owner, kind="stable")
                    logs, owner = logs[order], owner[order]
                rows, sizes = np.unique(owner, return_counts=True)
                found, _ = mixtures(logs, sizes)
                for row, x in zip(rows.tolist(), found.astype(np.float64)):
                    by = sorted(np.flatnonzero(x).tolist(), key=lambda i: -x[i])
                    langs[row], shares[row] = [model.languages[i] for i in by], [float(min(1.0, x[i])) for i in by]
                    pred[row], score[row] = langs[row][0], shares[row][0]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(langs, pa.list_(pa.string())), pa.array(shares, pa.list_(pa.float64()))],
                [*batch.schema.names, *new],
            )

        return one

    return map_batches(kept, make, schema)


def held_out(doc_id: str = "doc_id"):
    """Whether a document is kept from learning: crc32 of its id as text, modulo 4, is 2; a null id is learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))

"""Phrase collocations from sorted count streams.

Texts are lower-cased (A-Z only), cut into pieces at . , ; : ! ? and line ends, and pieces into words. A phrase of 2 to 5
words is a candidate if it occurs ``least`` times in its language; a cut after its first k words scores
floor(1000 * a * n / (l * r)) with the counts of both parts and of all words, and the lowest-scoring cut counts.

No phrase can be a candidate unless each word and each pair of words in it occurs ``least`` times. So words are counted,
then pairs of such words, then windows of up to five words from runs of such pairs. Tasks know the frequent words and
pairs by a bitmap of fixed size: a false hit costs a row, never a result. The windows are sorted in prefix order, where
the count of each prefix is the sum of a stretch; stretches that run over the border of a partition are added up.

The counts, all languages' words (the empty phrase) included, then form two streams: sorted in prefix order, where a
phrase comes after all its first parts and before its extensions on the right, and in suffix order for last parts and
extensions on the left. One reading of each stream, holding only the phrases that the present one begins with, gives all
counts of parts and the largest extension. Partitions are ranges of the sort order; a phrase whose extensions reach into
further ranges is sent to those too, so that hot first words spread. Nothing is looked up by hash.

A null text is empty, a null language is ``und``; words with any other signs are kept. Memory holds a slice of a text, the
counts of a bounded number of phrases, and one line of ancestors. Empty tables give an empty table; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstack.functions.windows import top_per_group
from quillstack.llm.common import U64, mix, written

LEAST, LONGEST, UNKNOWN = 100, 5, "und"
#: Ends every word of a key, so that all keys that begin with a phrase lie together; the next byte closes that range.
END, AFTER = b"\t", b"\n"
#: Bits of a bitmap, counts held by a task before it passes them on, and bytes of text cut at once.
BITMAP, HELD, SLICE = 1 << 25, 400_000, 1 << 20
#: A-Z lower-cased, each end of a piece a comma, tabs blanks.
_FLAT = bytes(c + 32 if 65 <= c <= 90 else 44 if c in b".,;:!?\n\v\f\r" else 32 if c == 9 else c for c in range(256))
BREAK = b","


def slices(data: bytes, carry: int):
    """(tokens, n) of joined texts: words, and BREAK between pieces. Runs of tokens are to begin at the first n; slices overlap by ``carry``."""
    data, held, at = data.translate(_FLAT), [], 0
    while at < len(data):
        end = data.find(b" ", at + SLICE) if len(data) - at > SLICE else -1
        tokens = held + data[at : len(data) if end < 0 else end].replace(BREAK, b" , ").split()
        if end < 0:
            yield tokens, len(tokens)
            return
        keep = min(carry, len(tokens))
        yield tokens, len(tokens) - keep
        held, at = tokens[len(tokens) - keep :], end


def _hash(lang: bytes, word: bytes) -> int:
    return xxhash.xxh64_intdigest(lang + AFTER + word, 7)


def _pair_bits(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return (mix(first + mix(second)) % U64(BITMAP)).astype(np.int64)


class Lexicon(dict):
    """Numbers of the words that a bitmap may hold; all others are 0. Numbers last until ``clear``."""

    def __init__(self, lang: bytes, bitmap: np.ndarray) -> None:
        self.lang, self.bitmap = lang, bitmap
        self.clear()

    def clear(self) -> None:
        super().clear()
        self[BREAK] = 0
        self.names, self.hashes = [b""], [0]

    def __missing__(self, word: bytes) -> int:
        key = _hash(self.lang, word)
        bit, out = key % BITMAP, 0
        if self.bitmap[bit >> 3] >> (bit & 7) & 1:
            out = len(self.names)
            self.names.append(word + END)
            self.hashes.append(key)
        self[word] = out
        return out


class Words:
    """Counts of words."""

    carry = 0

    def __init__(self, lang: bytes) -> None:
        self.counts: Counter = Counter()

    def add(self, tokens: list[bytes], n: int) -> None:
        self.counts.update(tokens[:n])

    def size(self) -> int:
        return len(self.counts)

    def take(self) -> tuple[list[bytes], list[int]]:
        del self.counts[BREAK]
        out = [w + END for w in self.counts], list(self.counts.values())
        self.counts.clear()
        return out


class Pairs:
    """Counts of pairs of words that may be frequent, kept as numbers."""

    carry = 1

    def __init__(self, lang: bytes, words: np.ndarray) -> None:
        self.lexicon = Lexicon(lang, words)
        self.codes, self.counts, self.open, self.waiting = np.empty(0, np.int64), np.empty(0, np.int64), [], 0

    def numbers(self, tokens: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.lexicon.__getitem__, tokens), np.int64, len(tokens))

    def add(self, tokens: list[bytes], n: int) -> None:
        ids = self.numbers(tokens)
        first, second = ids[: min(n, len(ids) - 1)], ids[1 : n + 1]
        both = (first > 0) & (second > 0)
        self.open.append(first[both] << 32 | second[both])
        self.waiting += len(self.open[-1])
        if self.waiting > 2 * HELD:
            self.merge()

    def merge(self) -> None:
        codes, counts = np.unique(np.concatenate([np.empty(0, np.int64), *self.open]), return_counts=True)
        self.open, self.waiting = [], 0
        every = np.concatenate([self.codes, codes])
        self.codes, place = np.unique(every, return_inverse=True)
        self.counts = np.bincount(place, np.concatenate([self.counts, counts]), len(self.codes)).astype(np.int64)

    def size(self) -> int:
        """Pairs as numbers take a fifth of what words take."""
        return max(len(self.codes) // 5, len(self.lexicon))

    def take(self) -> tuple[list[bytes], list[int]]:
        self.merge()
        names = self.lexicon.names
        out = [names[a] + names[b] for a, b in zip((self.codes >> 32).tolist(), (self.codes & 0xFFFFFFFF).tolist())], self.counts.tolist()
        self.codes, self.counts = np.empty(0, np.int64), np.empty(0, np.int64)
        self.lexicon.clear()
        return out


class Windows:
    """Counts of windows of three to five words in runs of pairs that may be frequent, one for each place."""

    carry = LONGEST - 1

    def __init__(self, lang: bytes, words: np.ndarray, pairs: np.ndarray) -> None:
        self.lexicon, self.pairs, self.counts = Lexicon(lang, words), pairs, Counter()

    def add(self, tokens: list[bytes], n: int) -> None:
        ids = np.fromiter(map(self.lexicon.__getitem__, tokens), np.int64, len(tokens))
        hashes = np.array(self.lexicon.hashes, U64)[ids]
        bits = _pair_bits(hashes[:-1], hashes[1:])
        bad = np.flatnonzero((ids[:-1] == 0) | (ids[1:] == 0) | (self.pairs[bits >> 3] >> (bits & 7).astype(np.uint8) & 1 == 0))
        starts = np.arange(min(n, max(0, len(ids) - 1)))
        # The run of good pairs from a place on ends with the first word of the next bad pair, or the last word.
        ends = np.append(bad, len(ids) - 1)[np.searchsorted(bad, starts)]
        sizes = np.minimum(ends - starts + 1, LONGEST)
        long_ = sizes > 2
        join = b"".join
        names = [self.lexicon.names[i] for i in ids.tolist()]
        self.counts.update(join(names[i : i + k]) for i, k in zip(starts[long_].tolist(), sizes[long_].tolist()))

    def size(self) -> int:
        return max(len(self.counts), len(self.lexicon))

    def take(self) -> tuple[list[bytes], list[int]]:
        out = list(self.counts), list(self.counts.values())
        self.counts.clear()
        self.lexicon.clear()
        return out


def _tally(texts: DataFrame, make) -> DataFrame:
    """(lang, key, a): the counts that ``make(lang)`` keeps of tokens, added up."""

    def run(batches):
        held: dict[str, object] = {}

        def rows():
            for lang, counts in held.items():
                keys, times = counts.take()
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys, pa.binary()), pa.array(times, pa.int64())], ["lang", "key", "a"])
            held.clear()

        for batch in batches:
            by: dict[str, list[bytes]] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary()).to_pylist()):
                by.setdefault(lang, []).append(text)
            for lang, parts in by.items():
                if lang not in held:
                    held[lang] = make(lang.encode())
                for tokens, n in slices(BREAK.join(parts), held[lang].carry):
                    held[lang].add(tokens, n)
                    if sum(x.size() for x in held.values()) >= HELD:
                        yield from rows()
                        held[lang] = make(lang.encode())
        yield from rows()

    return texts.mapInArrow(run, "lang string, key binary, a long").groupBy("lang", "key").agg(F.sum("a").alias("a"))


def _bitmap(frequent: DataFrame) -> np.ndarray:
    """The bits of all words or pairs (lang, key); what comes to the driver is bounded by the size of the bitmap."""

    def bits(batches):
        for batch in batches:
            keys = [(lang.encode(), key.split(END)[:-1]) for lang, key in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            first = np.array([_hash(lang, words[0]) for lang, words in keys], U64)
            second = np.array([_hash(lang, words[-1]) for lang, words in keys], U64)
            single = np.array([len(words) == 1 for _, words in keys], bool)
            at = np.where(single, (first % U64(BITMAP)).astype(np.int64), _pair_bits(first, second))
            yield pa.RecordBatch.from_arrays([pa.array(at >> 5), pa.array(np.int64(1) << (at & 31))], ["word", "bits"])

    words = frequent.select("lang", "key").mapInArrow(bits, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(BITMAP // 32, np.uint32)
    out[words.column(0).to_numpy()] = words.column(1).to_numpy()
    return out.view(np.uint8)


def counted(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST) -> DataFrame:
    """(lang, key, a): the phrases of up to five words that occur ``least`` times, and all words of a language as the empty phrase."""
    context = docs.sparkSession.sparkContext
    texts = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit(UNKNOWN)).alias("lang"), F.col(text).cast("string").alias("text")).filter("text IS NOT NULL")
    words = written(_tally(texts, Words), "phrase-words")
    total = words.groupBy("lang").agg(F.sum("a").alias("a")).select("lang", F.lit(b"").alias("key"), "a")
    words = words.filter(F.col("a") >= least)
    known = context.broadcast(_bitmap(words))
    pairs = written(_tally(texts, lambda name: Pairs(name, known.value)).filter(F.col("a") >= least), "phrase-pairs")
    both = context.broadcast(_bitmap(pairs))
    windows = _tally(texts, lambda name: Windows(name, known.value, both.value))
    longer = _prefix_sums(windows, least).groupBy("lang", "key").agg(F.sum("a").alias("a")).filter(F.col("a") >= least)
    return written(total.unionByName(words).unionByName(pairs).unionByName(longer), "phrase-counts")


def _prefix_sums(windows: DataFrame, least: int) -> DataFrame:
    """(lang, key, a): counts of the prefixes of three words and more; a partition's first and last ones may be parts of a count."""
    parts = int(windows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = windows.repartitionByRange(parts, "lang", "key").sortWithinPartitions("lang", "key")

    def scan(batches):
        open_: list[list] = []  # lang, prefix, count, whether the partition may not have all of it
        first = True
        for batch in batches:
            out = []
            for lang, key, a in zip(*(c.to_pylist() for c in batch.columns)):
                while open_ and not (key.startswith(open_[-1][1]) and lang == open_[-1][0]):
                    done = open_.pop()
                    if done[3] or done[2] >= least:
                        out.append(done[:3])
                at = -1
                for k in range(1, key.count(END) + 1):
                    at = key.index(END, at + 1)
                    if k > 2 and len(open_) < k - 2:
                        open_.append([lang, key[: at + 1], 0, first])
                first = False
                for x in open_:
                    x[2] += a
            yield _rows(out)
        yield _rows([x[:3] for x in open_])

    def _rows(out):
        columns = list(zip(*out)) or [(), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.binary()), pa.array(columns[2], pa.int64())], ["lang", "key", "a"])

    return ordered.mapInArrow(scan, "lang string, key binary, a long")


def _lockstep(counts: DataFrame) -> DataFrame:
    """(lang, key, a, carried, parts, most) of (lang, key, a, carried): one reading of the stream in the order of ``key``.

    ``parts`` has the counts of all proper prefixes, the empty one first; ``most`` is the largest count of an extension
    by one word. Keys come back reversed, for the other order.
    """
    parts = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = counts.repartitionByRange(parts, "lang", "key")
    lows = ranged.groupBy(F.spark_partition_id().alias("p")).agg(F.min(F.struct("lang", "key")).alias("low")).collect()  # one for each partition
    lows = sorted((r["low"][0], bytes(r["low"][1])) for r in lows)

    def place(batches):
        for batch in batches:
            at, part, home = [], [], []
            for i, (lang, key) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                own = bisect_right(lows, (lang, key)) - 1
                beyond = (lang, key[:-1] + AFTER) if key else (lang + "\0", b"")
                for p in range(own, max(own + 1, bisect_left(lows, beyond))):
                    at.append(i)
                    part.append(p)
                    home.append(p == own)
            rows = batch.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(home, pa.bool_()), *rows.columns], ["part", "home", *rows.schema.names])

    def scan(batches):
        stack: list[list] = []  # key, a, carried, home, parts, most
        current, out = None, []

        def close():
            key, a, carried, home, parts, most = stack.pop()
            if home or most:
                out.append((current[1], b"".join(w + END for w in reversed(key[:-1].split(END))) if key else key, a, carried, parts, most))

        def rows():
            columns = list(zip(*out)) or [()] * 6
            out.clear()
            kinds = (pa.string(), pa.binary(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["lang", "key", "a", "carried", "parts", "most"])

        for batch in batches:
            for part, home, lang, key, a, carried in zip(*(c.to_pylist() for c in batch.columns)):
                while stack and not (current == (part, lang) and key.startswith(stack[-1][0])):
                    close()
                current = (part, lang)
                if stack:
                    stack[-1][5] = max(stack[-1][5], a)
                stack.append([key, a, carried, home, [x[1] for x in stack], 0])
            yield rows()
        while stack:
            close()
        yield rows()

    dealt = counts.select("lang", "key", "a", "carried").mapInArrow(place, "part int, home boolean, lang string, key binary, a long, carried array<long>")
    dealt = dealt.repartitionById(parts, "part").sortWithinPartitions("part", "lang", "key")
    read = dealt.mapInArrow(scan, "lang string, key binary, a long, carried array<long>, parts array<long>, most long")
    own = [F.max(c).alias(c) for c in ("a", "carried", "parts", "most")]
    return written(read.groupBy("lang", "key").agg(*own), "phrase-stream")


def collocations(docs: DataFrame, k: int = 2000, text: str = "text", lang: str = "lang", least: int = LEAST) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``k`` best phrases that no longer one explains.

    A phrase is explained if some longer candidate that holds it occurs as often; then one by a single word does.
    """
    counts = counted(docs, text, lang, least).withColumn("carried", F.array().cast("array<long>"))
    right = _lockstep(counts).select("lang", "key", "a", F.concat("parts", F.array("most")).alias("carried"))
    both = _lockstep(right).withColumn("words", F.size("parts")).filter("words >= 2")
    both = both.select("lang", "key", "a", "words", F.col("carried").alias("ls"), F.col("parts").alias("rs"), F.greatest("most", F.element_at("carried", -1)).alias("most"))
    both = both.filter(F.col("most") < F.col("a")).withColumn("n", F.col("ls")[0])
    cut = """array_min(transform(sequence(1, words - 1), c -> named_struct(
        'score', (1000 * (cast(a AS decimal(19, 0)) * cast(n AS decimal(19, 0)))) div (cast(ls[c] AS decimal(19, 0)) * cast(rs[words - c] AS decimal(19, 0))),
        'c', c, 'l', ls[c], 'r', rs[words - c])))"""
    scored = both.withColumn("cut", F.expr(cut)).withColumn("phrase", F.col("key").cast("string"))
    scored = scored.select("lang", F.expr("translate(substring(phrase, 1, char_length(phrase) - 1), '\t', ' ')").alias("phrase"), "a", "n", "cut.l", "cut.r", "cut.score")
    best = top_per_group(scored, ["lang"], [F.desc("score"), F.desc("a"), F.asc("phrase")], k)
    return best.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")

"""Near-duplicate classes by Order MinHash, verified by banded alignment.

A sketch takes, of a text's runs of five words, each labelled with its number of occurrences so far, the two with the
least hash under one of 32 hash functions, and keeps them in text order; texts that agree on a sketch meet in a bucket.
Order and labels make agreement follow the edit similarity of the word sequences, not only the shared runs. In a bucket
every member is compared with one member that a hash picks, a different one in each bucket, so a group of copies costs
a number of comparisons in proportion to its size. A pair is a link if 1 - edits / words of the longer text is at least
0.8, the edits (words inserted, deleted or replaced) counted by a bit-parallel alignment inside a band of the allowed
width. Classes are connected by links; the class id is the smallest document id.

What the buckets leave apart is completed without chance. An edit breaks one of a text's disjoint runs at most, and what it
leaves whole stands in the other text too. So a text with more disjoint runs (words and runs of three) that no other class
has than its length allows edits is like no text of another class, and is done. The longer text of a pair allows fewer edits for its
length than the shorter, so a text may be left for one role only, and is held against texts of the other role. Which runs two classes have is found by
sorted hashes, dealt by hash; a bitmap tells it to the tasks, and its false hits only keep a text. Both texts of a pair are
kept, so those kept are looked at among themselves again while most of them go.

The texts that are left (long common passages, few words) meet by their rare runs. An edit changes as many labelled runs as a run has words, at
most, so two similar texts agree in a known number of them; of each text, so many of the rarest runs are kept that similar
texts must agree in some kept ones (a prefix filter). Rarity is a count by hash bin: it orders the runs and decides the cost, never
the result. Kept runs that no other text keeps are dropped inside the task by a bitmap of the runs kept twice;
only the others are joined. Of two texts that are not yet in one class, the one of the smaller class asks; members of a
class that share a run stand in lists, and a pair is counted inside the task, not once for each run in a join. Texts that
would meet very many others that way (form letters) ask by single words instead: own words are then rare enough.

Texts with the same words are copies and share one representative. A null text or one without words is a class of its
own, and so is a null id (class null). Rows that share an id are one document.
"""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillstack.functions.windows import salted_join
from quillstack.llm.common import U64, Words, discard, forget_kept, grams, map_batches, mix, parts_of, release_shuffles, written

GRAM, SKETCHES, LEAST = 5, 32, 0.8
#: Words of a run, how many kept runs two texts must share (fewer if the texts are too short), and bins of the runs' counts.
RUN, SHARED, BINS, CHUNK = 2, 4, 1 << 22, 1 << 14
#: The same number for texts of so many words at most: their words' bits tell them apart, and each further run kept is a more frequent one.
SHORT, SHARED_SHORT = 64, 1
#: Members of a class in a list; meetings for each word from which a text asks by single words; bits for each run met twice, and of a bitmap.
LISTED, BUSY, SPARSE, BITMAP = 256, 32, 16, 1 << 29
#: Odd factors that give a run's marks in a bitmap of runs: with one for each, a bitmap at its bound lets three times as many pass by mistake.
MARKS = np.array([1, 0x9E3779B1, 0x85EBCA6B], np.uint32)
#: Words of the runs that classes are told apart by, runs that a task gathers before it sends them, and runs of all texts for each part.
OWN, GATHERED, PART = (1, 3), 1 << 20, 1 << 19
#: The same for the texts left by that, with runs of four for the longer text of a pair; expected values of a text that a sketch looks at.
FINER, FEWEST = (1, 2, 3, 4), 16
#: Bytes of texts looked at together: the arrays of their words stay in a core's cache, and little stands beside a bitmap.
HELD = 1 << 19
#: Jobs that bring a bitmap to the driver, and first bits of the labels that a task looks at together.
FETCHES, LABELS = 16, 8
#: Roles of a text: it may be the shorter, or the longer text of a similar pair (of two as long, each is both).
SHORTER, LONGER = 1, 2


def edits_within(a: list, b: list, most: int) -> int | None:
    """Edit distance of two sequences if it is at most ``most``, else None: a bit for each cell of the band's column."""
    head, short = 0, min(len(a), len(b))
    while head < short and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < short - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    a, b = a[head : len(a) - tail], b[head : len(b) - tail]
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > most:
        return None
    if not a:
        return len(b)
    # Rows are places of a, columns places of b; the band holds the rows j - most to j + most of column j.
    m, width = len(a), 2 * most + 1
    full = (1 << width) - 1
    places: dict = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    up, down = full ^ ((1 << most) - 1), 0
    distance, low = min(most, m), 1 << (2 * most)
    for j, x in enumerate(b, 1):
        at = places.get(x, 0)
        shift = j - 1 - most
        here = (at >> shift if shift >= 0 else at << -shift) & full
        diagonal = ((((here & up) + up) ^ up) | here | down) & full
        plus, minus = down | (full & ~(diagonal | up)), diagonal & up
        if j + most <= m:
            distance += not diagonal & low
        else:
            bit = 1 << (m - j + most)
            distance += bool(plus & bit)
            distance -= bool(minus & bit)
        up = minus | (full & ~((diagonal >> 1) | plus))
        down = (diagonal >> 1) & plus
    return distance if distance <= most else None


#: Steps (words of a, words of b) that an alignment may take where two texts part, the cheapest first.
STEPS = sorted(((i, j) for i in range(5) for j in range(5) if i or j), key=lambda x: (max(x), sum(x)))


def edits_found(a: list, b: list, most: int, lost: int = 16) -> int | None:
    """The edits of some alignment of two sequences, if one is found with ``most`` at most: where they part, the cheapest step after which two words agree.

    Without such a step a word of each is left out, ``lost`` times.
    """
    i = j = edits = 0
    m, n = len(a), len(b)
    while i < m and j < n:
        if a[i] == b[j]:
            i += 1
            j += 1
            continue
        for x, y in STEPS:
            if a[i + x : i + x + 2] == b[j + y : j + y + 2]:
                break
        else:
            if not lost:
                return None
            x, y, lost = 1, 1, lost - 1
        i, j, edits = i + x, j + y, edits + max(x, y)
        if edits > most:
            return None
    # What a step took beyond an end counts as edits that are not needed: too many, never too few.
    edits += max(m - i, n - j, 0)
    return edits if edits <= most else None


def similar(a: list, b: list, least: float = LEAST) -> bool:
    """Whether the edit similarity of two word sequences is at least ``least``; any alignment with few edits shows it, a bag of words rules most others out."""
    longer = max(len(a), len(b))
    most = int(longer * (1 - least) + 1e-9)
    if abs(len(a) - len(b)) > most:
        return False
    if edits_found(a, b, most) is not None:
        return True
    return sum((Counter(a) & Counter(b)).values()) >= longer - most and edits_within(a, b, most) is not None


def _labelled(words: Words, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, row and label of every run of ``gram`` words; the label tells runs apart that are alike in the same text."""
    sizes = words.counts()
    runs = grams(words.hashes, gram, 7)
    row = np.repeat(np.arange(len(sizes)), sizes)
    inside = np.flatnonzero(row[: len(runs)] == row[gram - 1 :]) if len(runs) else np.empty(0, np.int64)
    run, owner = runs[inside], row[inside]
    # The number of earlier runs alike in the same text.
    own = run ^ mix(owner.astype(U64))
    order = np.argsort(own, kind="stable")
    fresh = np.ones(len(own), bool)
    fresh[1:] = own[order][1:] != own[order][:-1]
    begin = np.flatnonzero(fresh)
    seen = np.empty(len(own), U64)
    seen[order] = np.arange(len(own)) - np.repeat(begin, np.diff(np.append(begin, len(own))))
    return run, owner, mix(run + seen * U64(0x9E3779B97F4A7C15))


def fetched(rows: DataFrame, label: str):
    """The rows, read in ``FETCHES`` jobs: they are made by all tasks at once and written, where toLocalIterator would run a job for each partition in turn."""
    table = written(rows, label)
    yield from table.coalesce(FETCHES).toLocalIterator()
    discard(table)


def blobs_of(keys: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """The different parts of sorted keys, and the bytes of the keys of each."""
    begin = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(part) else np.empty(0, np.int64)
    ends = (np.append(begin, len(part)) * keys.itemsize).astype(np.int32)
    return part[begin], pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(keys))])


def run_counts(docs: DataFrame, runs: list[int]) -> dict[int, np.ndarray]:
    """For each length of runs, how often runs occur in (doc, text), by hash bin, as 8 * log2(1 + times)."""

    def count(batches):
        seen = np.zeros((len(runs), BINS), np.uint16)
        for batch in batches:
            words = Words(batch.column(1))
            row = np.repeat(np.arange(batch.num_rows), words.counts())
            for i, run in enumerate(runs):
                hashes = grams(words.hashes, run, 7)
                if len(hashes):
                    at, times = np.unique((hashes % U64(BINS))[row[: len(hashes)] == row[run - 1 :]].astype(np.int64), return_counts=True)
                    seen[i, at] = np.minimum(seen[i, at] + times, 65535)
        if seen.any():
            yield pa.RecordBatch.from_pydict({"chunk": np.arange(seen.size // CHUNK), "counts": [x.tobytes() for x in seen.reshape(-1, CHUNK)]})

    def add(table):
        total = sum(np.frombuffer(x, np.uint16).astype(np.int64) for x in table.column("counts").to_pylist())
        return pa.table({"chunk": table.column("chunk").slice(0, 1), "counts": pa.array([np.minimum(8 * np.log2(1 + total), 255).astype(np.uint8).tobytes()], pa.binary())})

    schema = "chunk long, counts binary"
    out = np.zeros(len(runs) * BINS, np.uint8)
    for r in fetched(docs.select("doc", "text").mapInArrow(count, schema).groupBy("chunk").applyInArrow(add, schema), "neardup-counts"):
        out[r[0] * CHUNK : (r[0] + 1) * CHUNK] = np.frombuffer(r[1], np.uint8)
    return dict(zip(runs, out.reshape(len(runs), BINS)))


def shared_runs(sizes: np.ndarray, run: int, least: float = LEAST) -> np.ndarray:
    """The number of labelled runs of ``run`` words that a text has in common with any similar text at least as long."""

    def edits(n):
        return np.floor(n * (1 - least) + 1e-9).astype(np.int64)

    def common(n):
        return n - run + 1 - run * edits(n)

    # Least where one more edit becomes allowed: at the text's own length or at the next such one.
    following = np.ceil((edits(sizes) + 1) / (1 - least) - 1e-9).astype(np.int64)
    return np.where(following <= sizes / least + 1e-9, np.minimum(common(sizes), common(following)), common(sizes))


def shared_kept(sizes: np.ndarray, run: int) -> np.ndarray:
    """The number of kept runs that a text has in common with any similar text that asks for as many."""
    return np.clip(shared_runs(sizes, run), 0, np.where(sizes <= SHORT, SHARED_SHORT, SHARED))


def rare_runs(words: Words, counts: np.ndarray, run: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Labels of the rarest runs of all rows, their rows, and their places (-1: not the only such run)."""
    sizes = words.counts()
    need = shared_runs(sizes, run)
    kept = np.where(need > 0, np.maximum(sizes - run + 1, 0) - need + shared_kept(sizes, run), 0)
    hashes = grams(words.hashes, run, 7)
    row = np.repeat(np.arange(len(sizes)), sizes)
    at = np.flatnonzero((row[: len(hashes)] == row[run - 1 :]) & (kept[row[: len(hashes)]] > 0)) if len(hashes) else np.empty(0, np.int64)
    hashes, owner = hashes[at], row[at]
    if not len(at):
        return hashes, owner, owner
    # Runs that are alike in one text get numbers; which of them has which number is all the same.
    own = hashes ^ mix(owner.astype(U64))
    order = np.argsort(own)
    begin = np.flatnonzero(np.append(True, own[order][1:] != own[order][:-1]))
    times = np.diff(np.append(begin, len(own)))
    seen = np.empty(len(own), U64)
    seen[order] = np.arange(len(own)) - np.repeat(begin, times)
    alone = np.empty(len(own), bool)
    alone[order] = np.repeat(times == 1, times)
    label = mix(hashes + seen * U64(0x9E3779B97F4A7C15))
    # Any order that the label alone decides will do: rows first, then counts, then the label.
    count = counts[(hashes % U64(BINS)).astype(np.int64)].astype(U64)
    order = np.argsort(owner.astype(U64) << U64(52) | count << U64(32) | label >> U64(32))
    per = np.bincount(owner, minlength=len(sizes))
    rank = np.arange(len(owner)) - np.repeat(np.cumsum(per) - per, per)
    chosen = order[rank < kept[owner]]  # rows are in order before and after
    return label[chosen], owner[chosen], np.where(alone, at - words.first[owner], -1)[chosen]


def _bits(label: np.ndarray, size: int) -> np.ndarray:
    return (label % U64(size)).astype(np.int64)


def has_bit(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which unsigned keys a bitmap may hold."""
    at = _bits(keys, len(bitmap) * 8)
    return (bitmap[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def kept_labels(docs: DataFrame, counts: np.ndarray, run: int, times: int) -> DataFrame:
    """(keys): the kept labels of (doc, text) that are kept ``times`` times (once or twice) at least, as bytes of those with the same first bits."""
    shared = docs.sparkSession.sparkContext.broadcast(counts)

    def make():
        table = shared.value

        def one(batch):
            labels, seen = np.unique(rare_runs(Words(batch.column(1)), table, run)[0], return_counts=True)
            labels = np.repeat(labels, np.minimum(seen, times))
            part, blobs = blobs_of(labels, (labels >> U64(64 - LABELS)).astype(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(part), blobs], ["part", "keys"])

        return one

    def meet(table):
        labels, seen = np.unique(np.frombuffer(b"".join(table.column("keys").to_pylist()), U64), return_counts=True)
        return pa.table({"keys": pa.array([labels[seen >= times].tobytes()], pa.binary())})

    return map_batches(docs, make, "part long, keys binary").groupBy("part").applyInArrow(meet, "keys binary")


def bitmap_of(keys: DataFrame) -> np.ndarray:
    """A bitmap of (key), or of (keys) with the bytes of many: ``SPARSE`` bits for each, up to ``BITMAP`` bits; a false hit costs a row, never a result."""
    packed = dict(keys.dtypes).get("keys") == "binary"
    n = (keys.agg(F.sum(F.octet_length("keys"))).first()[0] or 0) // 8 if packed else keys.count()
    size = min(BITMAP, 1 << max(20, (SPARSE * n).bit_length()))

    def mark(batches):
        held, many = [], 0
        for batch in batches:
            column = batch.column(0)
            held.append(_bits(np.frombuffer(b"".join(column.to_pylist()), U64) if packed else column.to_numpy().view(U64), size))
            many += len(held[-1])
            if many >= GATHERED:
                yield marked(held)
                held, many = [], 0
        if many:
            yield marked(held)

    def marked(held):
        at = np.unique(np.concatenate(held))
        part, blobs = blobs_of((at & 65535).astype("<u2"), at >> 16)
        return pa.RecordBatch.from_arrays([pa.array(part), blobs], ["part", "at"])

    def collect(table):
        bits = np.zeros(65536, bool)
        bits[np.frombuffer(b"".join(table.column("at").to_pylist()), "<u2")] = True
        return pa.table({"part": table.column("part").slice(0, 1), "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())})

    out = np.zeros(size // 8, np.uint8)
    parts = keys.mapInArrow(mark, "part long, at binary").groupBy("part").applyInArrow(collect, "part long, bits binary")
    for r in fetched(parts, "neardup-bits"):  # at most BITMAP bits
        out[r[0] * 8192 : (r[0] + 1) * 8192] = np.frombuffer(r[1], np.uint8)
    return out


#: Columns with the bits of a text's words.
SIGNS = [f"s{i}" for i in range(8)]


def _signs(words: Words) -> np.ndarray:
    """For each text 512 bits: those that its words set, each labelled with its number among the text's alike."""
    _, row, label = _labelled(words, 1)
    marks = np.zeros((len(words.first) - 1, 64 * len(SIGNS)), bool)
    marks[row, (label % U64(marks.shape[1])).astype(np.int64)] = True
    return np.packbits(marks, axis=1).view(np.int64)


def met_labels(docs: DataFrame, counts: np.ndarray, run: int, bitmap: np.ndarray) -> DataFrame:
    """(key, place, doc, role, n, class, size) and SIGNS: the kept labels of (doc, text, role, n, class, size) that the bitmap holds."""
    shared = docs.sparkSession.sparkContext.broadcast((counts, bitmap))

    def make():
        table, bits = shared.value

        def one(batch):
            words = Words(batch.column(1))
            label, row, place = rare_runs(words, table, run)
            good = np.flatnonzero(has_bit(bits, label))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(label[good].view(np.int64)), pa.array(place[good].astype(np.int32)), *(batch.column(i).take(pa.array(row[good])) for i in (0, 2, 3, 4, 5)),
                    *map(pa.array, _signs(words)[row[good]].T.copy()),
                ],
                ["key", "place", "doc", "role", "n", "class", "size", *SIGNS],
            )

        return one

    return map_batches(docs, make, f"key long, place int, doc long, role int, n int, class long, size long, {', '.join(f'{s} long' for s in SIGNS)}")


def with_classes(docs: DataFrame, reps: DataFrame, facts: DataFrame) -> DataFrame:
    """(doc, class, role, text): each different text of (doc, text) with its class and both roles; only texts that copies or a class may tie to others are shuffled."""
    tied = reps.filter("doc <> rep").select("doc").unionByName(facts.filter("size > 1").select(F.col("rep").alias("doc"))).distinct()
    bits = bitmap_of(written(tied, "neardup-tied"))
    several = texts_of(docs, bits).join(facts.select(F.col("rep").alias("doc"), "class").hint("shuffle_hash"), "doc")
    several = written(several.select("doc", "class", "text"), "neardup-tied")
    both = texts_of(docs, bits, False).select("doc", F.col("doc").alias("class"), "text").unionByName(several)
    return both.select("doc", "class", F.lit(SHORTER | LONGER).cast("int").alias("role"), "text")


def _own_runs(words: Words, run: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and keys (the first ``bits`` and 32 more bits of the hash) of the runs of ``run`` words."""
    hashes = grams(words.hashes, run, 7)
    row = np.repeat(np.arange(len(words.first) - 1), words.counts())
    at = np.flatnonzero(row[: len(hashes)] == row[run - 1 :]) if len(hashes) else np.empty(0, np.int64)
    return at, hashes[at] >> U64(32 - bits)


def _least_most(keys: np.ndarray, classes: np.ndarray, roles: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The different keys in order, the least and the largest class of each, and the roles that its texts have."""
    order = np.argsort(keys)
    keys, classes, roles = keys[order], classes[order], roles[order]
    begin = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[begin], np.minimum.reduceat(classes, begin), np.maximum.reduceat(classes, begin), np.bitwise_or.reduceat(roles, begin)


def shared_between_classes(texts: DataFrame, bits: int, width: int, runs: tuple[int, ...]) -> DataFrame:
    """(part, keys, roles): of each of 2 ** bits parts, the keys of runs that texts (doc, class, role, text) of two classes have, and which roles these texts have.

    Classes have ``width`` bytes.
    """

    def deal(keys, classes, roles):
        keys, least, most, roles = _least_most(np.concatenate(keys), np.concatenate(classes), np.concatenate(roles))
        # A key goes once for the class that has it, twice if several have: never once for each text.
        twice = least != most
        at = np.cumsum(1 + twice) - 1
        sent = np.repeat(least, 1 + twice)
        sent[at] = most
        keys, roles = np.repeat(keys, 1 + twice), np.repeat(roles, 1 + twice)
        part = (keys >> U64(32)).astype(np.int64)
        begin = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
        ends = np.append(begin, len(part)).astype(np.int32)
        low = (keys & U64(0xFFFFFFFF)).astype("<u4")
        trimmed = np.ascontiguousarray(sent.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :width])
        # As long as all texts have both roles, none are sent.
        marked = 0 if (roles == SHORTER | LONGER).all() else 1
        sizes = ((4, low), (width, trimmed), (marked, roles))
        blobs = [pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(ends * np.int32(n)), pa.py_buffer(x)]) for n, x in sizes]
        return pa.RecordBatch.from_arrays([pa.array(part[begin]), *blobs], ["part", "keys", "classes", "roles"])

    def gather(batches):
        forget_kept()
        found, held = ([], [], []), 0
        for batch in (part for whole in batches if whole.num_rows for part in parts_of(whole, 3, HELD)):
            words = Words(batch.column(3))
            sizes = words.counts()
            own, role = np.repeat(batch.column(1).to_numpy(), sizes), np.repeat(batch.column(2).to_numpy().astype(np.uint8), sizes)
            for run in runs:
                at, key = _own_runs(words, run, bits)
                for column, values in zip(found, (key, own[at], role[at])):
                    column.append(values)
                held += len(at)
            if held >= GATHERED:
                yield deal(*found)
                found, held = ([], [], []), 0
        if held:
            yield deal(*found)

    def meet(table):
        low = table.column("keys").to_pylist()
        roles = b"".join(r or bytes([SHORTER | LONGER]) * (len(k) // 4) for k, r in zip(low, table.column("roles").to_pylist()))
        trimmed = np.frombuffer(b"".join(table.column("classes").to_pylist()), np.uint8).reshape(-1, width)
        classes = np.zeros((len(trimmed), 8), np.uint8)
        classes[:, :width] = trimmed
        keys, least, most, roles = _least_most(np.frombuffer(b"".join(low), "<u4"), classes.view("<i8")[:, 0], np.frombuffer(roles, np.uint8))
        several = least != most
        return pa.table({"part": table.column("part").slice(0, 1), "keys": pa.array([keys[several].tobytes()], pa.binary()), "roles": pa.array([roles[several].tobytes()], pa.binary())})

    dealt = texts.mapInArrow(gather, "part long, keys binary, classes binary, roles binary")
    return dealt.groupBy("part").applyInArrow(meet, "part long, keys binary, roles binary")


def _place(low: np.ndarray, factor: np.uint32, each: int) -> np.ndarray:
    """A place in a stretch of ``each`` bits, a power of two, for the last 32 bits of each key."""
    return (low * factor) >> np.uint32(33 - each.bit_length())


def has_key(bitmap: np.ndarray, keys: np.ndarray, bits: int) -> np.ndarray:
    """Which keys of runs a bitmap of 2 ** bits parts may hold: those whose marks are all there."""
    each = len(bitmap) * 8 >> bits
    begin, low = (keys >> U64(32)).astype(np.int64) * each, keys.astype(np.uint32)
    left = np.arange(len(keys))
    for factor in MARKS:
        at = begin[left] + _place(low[left], factor, each)
        left = left[(bitmap[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)]
    found = np.zeros(len(keys), bool)
    found[left] = True
    return found


def bitmap_of_parts(parts: DataFrame, bits: int, role: int = SHORTER | LONGER) -> np.ndarray:
    """A bitmap by the first bits of those keys of (part, keys, roles) that texts of a ``role`` have, each part marking its own stretch; at most ``BITMAP`` bits."""
    n = (parts.agg(F.sum(F.octet_length("keys"))).first()[0] or 0) // 4
    size = min(BITMAP, 1 << max(20, bits + 3, (SPARSE * n).bit_length()))
    each = size >> bits

    def mark(batches):
        for batch in batches:
            for part, keys, roles in zip(*(batch.column(i).to_pylist() for i in range(3))):
                marks = np.zeros(each, bool)
                wanted = np.frombuffer(keys, "<u4")[np.frombuffer(roles, np.uint8) & role > 0]
                for factor in MARKS:
                    marks[_place(wanted, factor, each)] = True
                yield pa.RecordBatch.from_pydict({"part": [part], "bits": [np.packbits(marks, bitorder="little").tobytes()]})

    out = np.zeros(size // 8, np.uint8)
    for r in fetched(parts.mapInArrow(mark, "part long, bits binary"), "neardup-bits"):  # at most BITMAP bits
        out[r[0] * each // 8 : (r[0] + 1) * each // 8] = np.frombuffer(r[1], np.uint8)
    return out


def disjoint(starts: np.ndarray, run: int) -> np.ndarray:
    """Of runs of ``run`` words that begin at these places in order, some that share no word."""
    if not len(starts) or run == 1:
        return starts
    # Stretches of consecutive places: each begins where the runs of the one before have surely ended.
    begin = np.flatnonzero(np.append(True, np.diff(starts) > 1))
    first, last = starts[begin], starts[np.append(begin[1:], len(starts)) - 1]
    first = first + np.append(0, np.maximum(0, run - first[1:] + last[:-1]))
    ahead = starts - np.repeat(first, np.diff(np.append(begin, len(starts))))
    return starts[(ahead >= 0) & (ahead % run == 0)]


def most_edits(sizes: np.ndarray, least: float = LEAST) -> np.ndarray:
    """The most edits between texts of so many words and any similar text."""
    return np.floor(np.floor(sizes / least + 1e-6) * (1 - least) + 1e-6).astype(np.int64)


def not_alone(texts: DataFrame, bitmaps: list[np.ndarray], bits: int, runs: tuple[int, ...]) -> DataFrame:
    """The texts of (doc, class, role, text) that may be similar to one of another class, with the roles they may have in that.

    Too few of their disjoint runs are their class's own: of the runs that longer, or shorter, texts have by ``bitmaps``
    (one for both, or one for each role that a text may have).
    """
    shared = texts.sparkSession.sparkContext.broadcast(bitmaps)

    def make():
        marks = shared.value

        def own_runs(words, row, sizes, bitmap):
            covered = np.zeros(len(row), bool)
            own = np.zeros(len(sizes), np.int64)
            for run in runs:
                at, keys = _own_runs(words, run, bits)
                good = ~has_key(bitmap, keys, bits)
                for j in range(run):
                    good &= ~covered[at + j]
                chosen = disjoint(at[good], run)
                for j in range(run):
                    covered[chosen + j] = True
                own += np.bincount(row[chosen], minlength=len(sizes))
            return own

        def one(batch):
            for part in parts_of(batch, 3, HELD):
                yield kept_of(part)

        def kept_of(batch):
            words = Words(batch.column(3))
            sizes = words.counts()
            row = np.repeat(np.arange(len(sizes)), sizes)
            own = [own_runs(words, row, sizes, bitmap) for bitmap in marks]
            roles = np.zeros(len(sizes), np.int32)
            for role, count, most in ((SHORTER, own[0], most_edits(sizes)), (LONGER, own[-1], np.floor(sizes * (1 - LEAST) + 1e-6))):
                roles[(most > 0) & (count <= most)] |= role
            roles &= batch.column(2).to_numpy()
            kept = pa.array(roles > 0)
            return pa.RecordBatch.from_arrays(
                [batch.column(0).filter(kept), batch.column(1).filter(kept), pa.array(roles).filter(kept), batch.column(3).filter(kept)], ["doc", "class", "role", "text"]
            )

        return one

    return map_batches(texts, make, "doc long, class long, role int, text string")


def sketches(docs: DataFrame, count: int = SKETCHES, gram: int = GRAM) -> DataFrame:
    """(doc, same, keys, n): a digest of the words, a bucket key for each sketch, number of words; texts without words are left out."""

    def make():
        def one(batch):
            for part in parts_of(batch, 1, HELD):
                yield sketched(part)

        def sketched(batch):
            words = Words(batch.column(1))
            sizes = words.counts()
            run, owner, label = _labelled(words, gram)
            per = np.bincount(owner, minlength=len(sizes))
            rows = np.flatnonzero(per >= 2)
            keep = np.isin(owner, rows) if len(rows) < len(sizes) else slice(None)
            run, label, size = run[keep], label[keep], per[rows]
            starts = np.concatenate([[0], np.cumsum(size)[:-1]]).astype(np.int64)
            made = np.empty((len(rows), count), U64)
            # The two least values of nearly every text are below this; a text with fewer such values is looked at whole.
            small = np.repeat((FEWEST / np.maximum(size, FEWEST) * (2.0**64 - 2048)).astype(U64), size)
            group = np.repeat(np.arange(len(rows)), size)
            for j in range(count if len(rows) else 0):
                value = mix(label ^ U64((j + 1) * 0x632BE59BD9B4E019 % 2**64))
                at = np.flatnonzero(value <= small)
                few = np.bincount(group[at], minlength=len(rows)) < 2
                if few.any():
                    at = np.flatnonzero((value <= small) | few[group])
                a, b = _two_least(value[at], np.searchsorted(at, starts))
                a, b = at[np.minimum(a, b)], at[np.maximum(a, b)]
                made[:, j] = mix(mix(run[a] + U64(j)) + run[b])
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            full = np.flatnonzero(sizes)
            digests = [hashlib.blake2b(b" ".join(texts[i].split()), digest_size=16).digest() for i in full]
            at = np.full(len(sizes), -1)
            at[rows] = np.arange(len(rows))
            listed = [made[at[i]].view(np.int64) if at[i] >= 0 else np.empty(0, np.int64) for i in full]
            return pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(full)), pa.array(digests, pa.binary()), _lists(listed), pa.array(sizes[full].astype(np.int32))],
                ["doc", "same", "keys", "n"],
            )

        return one

    return map_batches(docs, make, "doc long, same binary, keys array<long>, n int")


def _lists(rows: list[np.ndarray]) -> pa.ListArray:
    offsets = np.cumsum([0, *map(len, rows)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.empty(0, np.int64), *rows])))


def _two_least(value: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the least value of each group and of the least among its others."""
    size = np.diff(np.append(starts, len(value)))
    one_at = _first(value == np.repeat(np.minimum.reduceat(value, starts), size), starts)
    value[one_at] = U64(2**64 - 1)
    return one_at, _first(value == np.repeat(np.minimum.reduceat(value, starts), size), starts)


def _first(hit: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The first place that hits, for each group; every group has one."""
    at = np.flatnonzero(hit)
    return at[np.searchsorted(at, starts)]


def components(edges: DataFrame) -> DataFrame:
    """(node, least): the smallest node each node of the edges (a, b) is connected with.

    Large-star and small-star steps, each written, until nothing changes; a node with very many edges is salted.
    """
    edges = edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = salted_join(both, least, ["u"]).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = written(large, "components")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = salted_join(large, least, ["u"]).filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = written(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "components")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            own = edges.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("least"))
            return edges.select(F.col("u").alias("node"), F.col("v").alias("least")).unionByName(own)
        before = now


def verified(pairs: DataFrame, texts: DataFrame, least: float = LEAST) -> DataFrame:
    """The pairs (a, b) whose texts, one row (doc, text) each, are similar."""
    rows = pairs.join(texts.select(F.col("doc").alias("a"), F.col("text").alias("text_a")), "a")
    rows = rows.join(texts.select(F.col("doc").alias("b"), F.col("text").alias("text_b")), "b").select("a", "b", "text_a", "text_b")

    def make():
        def one(batch):
            left, right = (batch.column(i).cast(pa.binary()).to_pylist() for i in (2, 3))
            good = pa.array([similar(x.split(), y.split(), least) for x, y in zip(left, right)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(good), batch.column(1).filter(good)], ["a", "b"])

        return one

    return map_batches(rows, make, "a long, b long")


def texts_of(docs: DataFrame, bitmap: np.ndarray, hit: bool = True) -> DataFrame:
    """The rows of (doc, text) whose id the bitmap may hold (or surely does not), chosen inside the task; the others are not shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)

    def make():
        bits = shared.value

        def one(batch):
            yield batch.filter(pa.array(has_bit(bits, batch.column(0).to_numpy().view(U64)) == hit))

        return one

    return map_batches(docs, make, "doc long, text string")


def linked(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (a, b) that are similar, written; ``docs`` has their texts (doc, text)."""
    asked = written(pairs.select(F.explode(F.array("a", "b")).alias("doc")).distinct(), "neardup-asked")
    texts = texts_of(docs.select("doc", "text"), bitmap_of(asked)).join(asked.hint("shuffle_hash"), "doc", "left_semi")
    texts = written(texts.groupBy("doc").agg(F.min("text").alias("text")), "neardup-texts")
    release_shuffles(docs.sparkSession)
    links = written(verified(pairs, texts), "neardup-links")
    discard(texts, asked)
    release_shuffles(docs.sparkSession)
    return links


def members_of(met: DataFrame) -> DataFrame:
    """``met`` with ``others``: members of the key in other classes; ``rep`` is the text.

    Keys that lie in one class only are left out.
    """
    # Place and number of words travel as one number; the rows are dealt by key once.
    rows = met.select("key", F.col("doc").alias("rep"), "class", "size", "role", *SIGNS, (F.col("place").cast("long") * (1 << 32) + F.col("n")).alias("at")).repartition("key")
    every, own = F.count("*").over(Window.partitionBy("key")), F.count("*").over(Window.partitionBy("key", "class"))
    rows = rows.withColumn("own", own).withColumn("others", every - F.col("own")).filter("others > 0")
    return rows.select(
        "key", "rep", "class", "size", "role", F.col("at").bitwiseAND(0xFFFFFFFF).cast("int").alias("n"), F.shiftright("at", 32).cast("int").alias("place"),
        F.least("others", F.lit(2**31 - 1)).cast("int").alias("others"), *SIGNS,
    )


def apart(members: DataFrame, asking: DataFrame, run: int, least: float = LEAST) -> DataFrame:
    """(a, b): the texts of different classes that share enough keys to be similar; the one of the smaller class asks.

    ``asking`` are the members whose texts ask. Runs that occur once in both texts must lie where the allowed edits
    before and after them can bring them together, the roles must allow it, and so must the words of the two texts by their bits. Lists hold the members of a class that a hash puts together, so what
    a task counts at a time is bounded, and every meeting of two texts is counted in one place.
    """
    lists = F.ceil(F.col("size") / LISTED)
    chunk = F.pmod(F.xxhash64("rep"), lists).cast("int")
    listed = members.withColumn("chunk", chunk).groupBy("key", "class", "size", "chunk").agg(F.collect_list(F.struct("rep", "n", "place", "role", *SIGNS)).alias("list"))
    x = asking.select("key", F.col("rep").alias("a"), F.col("n").alias("an"), F.col("place").alias("ap"), F.col("class").alias("ac"), F.col("size").alias("asize"), F.col("role").alias("ar"), *(F.col(s).alias(f"a{s}") for s in SIGNS))
    before = (F.col("asize") < F.col("size")) | ((F.col("asize") == F.col("size")) & (F.col("ac") < F.col("class")))

    def fits(y):
        longer, ahead = F.col("an") - y["n"], F.col("ap") - y["place"]
        most = F.floor(F.greatest("an", y["n"]) * (1 - least) + 1e-9)
        placed = (F.least("ap", y["place"]) < 0) | (F.abs(ahead) + F.abs(longer - ahead) <= most)
        shorter = (longer <= 0) & F.col("ar").isin(SHORTER, SHORTER | LONGER) & y["role"].isin(LONGER, SHORTER | LONGER)
        roles = shorter | (longer >= 0) & F.col("ar").isin(LONGER, SHORTER | LONGER) & y["role"].isin(SHORTER, SHORTER | LONGER)
        # Each edit takes one word of a text at most: the words, so the bits, that only one text has are no more.
        lost = sum(F.bit_count(F.col(f"a{s}").bitwiseAND(F.bitwise_not(y[s]))) for s in SIGNS)
        new = sum(F.bit_count(y[s].bitwiseAND(F.bitwise_not(F.col(f"a{s}")))) for s in SIGNS)
        return (F.abs(longer) <= most) & placed & roles & (lost <= most) & (new <= most)

    rows = x.join(listed, "key").filter(before & F.exists("list", fits))
    found = F.transform(F.filter("list", fits), lambda y: F.struct(y["rep"].alias("rep"), y["n"].alias("n")))
    rows = rows.select("a", "an", "ap", "class", "chunk", found.alias("list"))
    rows = rows.repartition("a", "class", "chunk").sortWithinPartitions("a", "class", "chunk")

    def count(batches):
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch] if held is None else [held, batch]).combine_chunks()
            # The last group may go on in the next batch.
            place = np.stack([table.column(i).to_numpy() for i in (0, 3, 4)])
            same = (place == place[:, -1:]).all(0)
            held = table.slice(int(np.flatnonzero(~same)[-1]) + 1 if (~same).any() else 0).to_batches()[0]
            if held.num_rows < table.num_rows:
                yield pairs(table.slice(0, table.num_rows - held.num_rows))
        if held is not None:
            yield pairs(pa.Table.from_batches([held]))

    def pairs(table):
        lists = table.column(5).combine_chunks()
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        sizes = np.diff(lists.offsets.to_numpy())
        a, an = (np.repeat(table.column(i).to_numpy(), sizes).astype(np.int64) for i in range(2))
        b, bn = (lists.flatten().field(i).to_numpy().astype(np.int64) for i in range(2))
        both, times = np.unique(np.stack([a, b, an, bn]), axis=1, return_counts=True)
        keep = times >= np.minimum(shared_kept(both[2], run), shared_kept(both[3], run))
        low, high = np.minimum(both[0], both[1])[keep], np.maximum(both[0], both[1])[keep]
        return pa.RecordBatch.from_arrays([pa.array(low), pa.array(high)], ["a", "b"])

    return rows.mapInArrow(count, "a long, b long")


def busy(members: DataFrame) -> DataFrame:
    """(rep): texts that would meet more than BUSY texts of other classes for each of their words."""
    met = members.groupBy("rep").agg(F.sum(F.col("others").cast("long")).alias("met"), F.first("n").alias("n"))
    return met.filter(F.col("met") > BUSY * F.col("n")).select("rep")


#: Ids that are sent to every task rather than shuffled for.
FEW = 100_000


def split_by(members: DataFrame, crowd: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The members whose texts are in ``crowd`` (rep), and the others."""
    side = F.broadcast(crowd) if crowd.count() <= FEW else crowd.hint("merge")
    return members.join(side, "rep", "left_semi"), members.join(side, "rep", "left_anti")


def classes(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, class_id, copy_of): a row for each row of ``docs``; copy_of is the smallest id with the same words."""
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text).alias("text"))
    usable = base.filter("doc IS NOT NULL AND text IS NOT NULL")
    made = written(sketches(usable), "neardup-sketches")
    same = written(made.groupBy("same").agg(F.min("doc").alias("rep"), F.max("n").alias("n")), "neardup-copies")
    # A text may have very many copies: their rows are spread.
    reps = written(salted_join(made.select("doc", "same"), same.select("same", "rep"), ["same"]).select("doc", "rep"), "neardup-reps")
    copies = written(reps.groupBy("doc").agg(F.min("rep").alias("rep")), "neardup-copies")
    # Rows that share an id may have several texts: a text's sketches are those of its digest.
    keyed = made.join(same.select("same", F.col("rep").alias("doc")), ["same", "doc"], "left_semi").groupBy("doc", "same").agg(F.first("keys").alias("keys"))
    buckets = keyed.select(F.col("doc").alias("rep"), F.explode("keys").alias("key"))
    # A bucket of two and more: the member with the least hash, which depends on the bucket, stands for it.
    middle = buckets.groupBy("key").agg(F.min(F.struct(F.xxhash64("rep", "key").alias("h"), "rep"))["rep"].alias("middle"), F.count("*").alias("n"))
    middle = written(middle.filter("n > 1").select("key", "middle"), "neardup-buckets")
    pairs = buckets.join(middle, "key").filter("rep <> middle").select(F.least("rep", "middle").alias("a"), F.greatest("rep", "middle").alias("b"))
    pairs = written(pairs.distinct(), "neardup-pairs")
    discard(made)
    release_shuffles(spark)
    links = linked(pairs, usable)
    # Rows of one id with different words tie their representatives together.
    tied = reps.join(copies.withColumnRenamed("rep", "a"), "doc").select("a", F.col("rep").alias("b")).filter("a <> b")
    joined = written(components(links.unionByName(tied)), "neardup-joined")
    # Similar texts that no bucket has brought together.
    facts = same.groupBy("rep").agg(F.max("n").alias("n")).join(joined, F.col("rep") == F.col("node"), "left")
    facts = facts.select("rep", "n", F.coalesce("least", "rep").alias("class"))
    facts = written(salted_join(facts, facts.groupBy("class").agg(F.count("*").alias("size")), ["class"]), "neardup-facts")
    most = same.agg(F.sum("n")).first()[0] or 0
    bits = min(20, max(4, (most * len(OWN) // PART).bit_length()))
    lowest, highest = facts.agg(F.min("class"), F.max("class")).first()
    width = 8 if (lowest or 0) < 0 else max(1, ((highest or 0).bit_length() + 7) // 8)
    # Both texts of a pair are left, so the left ones are looked at among themselves again while most of them go.
    left, runs, before, now = with_classes(usable, reps, facts), OWN, 0, facts.count()
    while not before or now and (runs == OWN or 2 * now < before):
        runs = FINER if before else OWN
        shared = written(shared_between_classes(left, bits, width, runs), "neardup-shared")
        release_shuffles(spark)
        # A text that may be the shorter one needs a longer one that has its runs, and the other way round.
        marks = [bitmap_of_parts(shared, bits, role) for role in (LONGER, SHORTER)] if before else [bitmap_of_parts(shared, bits)]
        left = written(not_alone(left, marks, bits, runs), "neardup-left")
        discard(shared)
        before, now = now or 1, left.count()
    # What is known of a text goes with it, so that the rows of its runs need no join.
    known = facts.select(F.col("rep").alias("doc"), "n", "class", "size").hint("shuffle_hash")
    left = written(left.select("doc", "text", "role").join(known, "doc").select("doc", "text", "role", "n", "class", "size"), "neardup-left")
    counts = run_counts(left, [1, RUN])
    twice = written(kept_labels(left, counts[RUN], RUN, 2), "neardup-twice")
    release_shuffles(spark)
    members = written(members_of(met_labels(left, counts[RUN], RUN, bitmap_of(twice))), "neardup-members")
    discard(twice)
    release_shuffles(spark)
    crowd = written(busy(members), "neardup-busy")
    more = written(apart(members, split_by(members, crowd)[1], RUN).distinct(), "neardup-more")
    discard(members)
    release_shuffles(spark)
    if not crowd.isEmpty():
        asked = written(kept_labels(texts_of(left.select("doc", "text"), bitmap_of(crowd.select(F.col("rep").alias("doc")))), counts[1], 1, 1), "neardup-asked")
        single = written(members_of(met_labels(left, counts[1], 1, bitmap_of(asked))), "neardup-members")
        release_shuffles(spark)
        more = written(more.unionByName(apart(single, split_by(single, crowd)[0], 1)), "neardup-more")
        discard(single)
        release_shuffles(spark)
    more = written(more.distinct().join(pairs, ["a", "b"], "left_anti"), "neardup-apart")
    release_shuffles(spark)
    joined = components(joined.select(F.col("node").alias("a"), F.col("least").alias("b")).unionByName(linked(more, left)))
    found = copies.join(joined, F.col("rep") == F.col("node"), "left").select("doc", "rep", F.coalesce("least", "rep").alias("least"))
    own = docs.select(F.col(id_col).cast("long").alias("doc")).join(found, "doc", "left")
    return own.select(F.col("doc").alias("doc_id"), F.coalesce("least", "doc").alias("class_id"), F.coalesce("rep", "doc").alias("copy_of"))

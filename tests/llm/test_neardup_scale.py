"""Near-duplicates on more text: bits of words, marks of runs, counts of frequent runs, and the quick alignment."""

import random

import numpy as np
import pyarrow as pa

from quillstack.llm import neardup
from quillstack.llm.common import Words, parts_of


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_the_quick_alignment_never_counts_too_few_edits():
    rnd, found = random.Random(5), 0
    for _ in range(600):
        a = [rnd.randrange(40) for _ in range(rnd.randrange(45))]
        b = list(a)
        for _ in range(rnd.randrange(9)):
            at = rnd.randrange(len(b) + 1)
            b[at : at + rnd.randrange(3)] = [rnd.randrange(40) for _ in range(rnd.randrange(3))]
        right, most = distance(a, b), int(max(len(a), len(b)) * 0.2 + 1e-9)
        edits = neardup.edits_found(a, b, most)
        assert edits is None or right <= edits <= most
        assert neardup.similar(a, b) == (right <= most)
        found += edits is not None
    assert found > 150


def test_words_have_the_same_hash_wherever_they_stand():
    """Hashes are made piece by piece; long words and blanks do not fit the table of the first places."""
    texts = [" ".join(f"w{i}" for i in range(30_000)), "x" * 70_000 + "  y" + " " * 200 + "z", None, "", "w7 " + "q" * 64 + " " + "q" * 65]
    whole = Words(pa.array(texts))
    alone = {w: Words(pa.array([w])).hashes.tolist() for t in texts for w in (t or "").split()}
    assert whole.hashes.tolist() == [h for t in texts for w in (t or "").split() for h in alone[w]]
    assert len({tuple(h) for h in alone.values()}) == len(alone)
    rows = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["doc", "text"])
    parts = [Words(p.column(1)).hashes for p in parts_of(rows, 1, 1 << 10)]
    assert np.concatenate(parts).tolist() == whole.hashes.tolist()


def test_short_texts_with_common_lines_are_not_all_aligned(spark, monkeypatch):
    """Twice the same line and a few words more than may differ: their bits tell the texts apart before the texts are read."""
    rnd, seen, linked = random.Random(8), [0], neardup.linked
    line = " ".join(f"c{i}" for i in range(13))
    rows = [f"{line} {' '.join(f'o{rnd.randrange(400)}' for _ in range(12))} {line}" for _ in range(150)]
    rows += [rows[i].replace("c5", f"x{i}") for i in range(10)]
    right = {(i, j) for i in range(len(rows)) for j in range(i) if neardup.similar(rows[i].split(), rows[j].split())}
    monkeypatch.setattr(neardup, "sketches", lambda docs, f=neardup.sketches: f(docs).withColumn("keys", neardup.F.expr("filter(keys, x -> false)")))

    def counting(pairs, texts):
        seen[0] += pairs.count()
        return linked(pairs, texts)

    monkeypatch.setattr(neardup, "linked", counting)
    frame = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    found = {r["doc_id"]: r["class_id"] for r in neardup.classes(frame).collect()}
    # Without buckets, all links come from the texts' rare runs.
    assert all(found[i] == found[j] for i, j in right) and len(right) >= 10
    assert seen[0] <= 2 * len(right) + 150


def test_runs_of_the_own_class_are_known_at_the_bound_of_the_bitmap(spark, monkeypatch):
    """Four bits for each run: one mark for each would let over a fifth of the other runs pass."""
    rnd = random.Random(4)
    texts = [" ".join(f"w{rnd.randrange(10**9)}" for _ in range(3000)) for _ in range(2)]
    rows = spark.createDataFrame([(i, i, 3, texts[i // 2]) for i in range(4)], "doc long, class long, role int, text string")
    parts = neardup.shared_between_classes(rows, 4, 1, (3,))
    monkeypatch.setattr(neardup, "BITMAP", 1 << 15)
    bitmap = neardup.bitmap_of_parts(parts, 4)
    assert len(bitmap) * 8 == 1 << 15
    of = lambda x: neardup._own_runs(Words(pa.array(x)), 3, 4)[1]
    assert neardup.has_key(bitmap, of(texts), 4).all()
    others = of([" ".join(f"v{rnd.randrange(10**9)}" for _ in range(20_000))])
    assert neardup.has_key(bitmap, others, 4).mean() < 0.12
    assert neardup.has_key(bitmap, others[:0], 4).tolist() == []


def test_frequent_runs_keep_their_order(spark):
    """Which of two runs that both occur over 255 times is the rarer one decides which is kept."""
    often, more = [f"a{i}" for i in range(5)], [f"b{i}" for i in range(5)]
    text = " ".join(often * 60 + more * 200)
    counts = neardup.run_counts(spark.createDataFrame([(i, text) for i in range(8)], "doc long, text string"), [1])[1]
    at = lambda w: int(counts[int(Words(pa.array([w])).hashes[0] * np.uint64(0) + neardup.grams(Words(pa.array([w])).hashes, 1, 7)[0]) % neardup.BINS])
    assert max(map(at, often)) < min(map(at, more))


def test_bitmaps_come_to_the_driver_in_few_jobs(spark):
    """Not in one job for each partition, one after the other; packed keys give the bitmap of their rows."""
    rnd = random.Random(6)
    keys = [rnd.randrange(-(2**63), 2**63) for _ in range(5000)]
    rows = spark.createDataFrame([(k,) for k in keys], "key long").repartition(40)
    blobs = [(bytearray(np.array(keys[i : i + 700], np.int64).tobytes()),) for i in range(0, 5000, 700)] + [(bytearray(),)]
    settings = {"spark.sql.shuffle.partitions": "60", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    spark.sparkContext.setJobGroup("bitmap", "bitmap")
    try:
        plain = neardup.bitmap_of(rows)
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("bitmap"))
        packed = neardup.bitmap_of(spark.createDataFrame(blobs, "keys binary"))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        for k, v in before.items():
            spark.conf.set(k, v)
    assert (plain == packed).all() and neardup.has_bit(plain, np.array(keys, np.int64).view(np.uint64)).all()
    assert 0 < jobs <= 30
    assert not neardup.bitmap_of(rows.limit(0)).any()

"""SimHash near-duplicates: pigeonhole blocks propose pairs of fingerprints, Hamming distance decides.

A text is lower-cased (A-Z only) and cut into words; its shingles are runs of three words, repeats included (fewer words:
the whole sequence). A fingerprint bit is 1 if it is set in over half of the shingles' XXH64 values; a text without words,
or null, has fingerprint zero and links like any other. Fingerprints link at ``BITS`` differing bits or fewer.

Only distinct fingerprints are compared. The 64 bits are split into BITS + 1 blocks, so linked fingerprints agree in a
block; the bits outside that block are split in the same way, which makes buckets of 28 equal bits that every linked pair
shares one of. Buckets of one are dropped. A bucket of up to ``ROOM`` fingerprints is compared whole, inside a task, and
gives the links of a spanning forest, never all pairs. A larger bucket is split again by the bits that its members need not
share yet, and so on: with eight bits left a bucket cannot hold more than 256. So nothing is capped, and only dense
buckets pay for finer blocks.

Every row keeps its fingerprint. A row without an id takes part, but never names a component; a component without any id
has none. Rows that share an id are separate rows that carry the same id. An empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstack.functions.windows import salted_join
from quillstack.llm.common import map_batches, written
from quillstack.llm.neardup import components

SHINGLE, SEED, BITS = 3, 42, 3
#: Fingerprints of a bucket compared in one go (bounds a task's memory), and shingles hashed in one go.
ROOM, STEP = 2048, 1 << 15
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def fingerprint_of(text: bytes | None) -> int:
    """The SimHash of one UTF-8 text, unsigned."""
    words = (text or b"").translate(_LOWER).split()
    if not words:
        return 0
    size = min(SHINGLE, len(words))
    total, n = np.zeros(64, np.int64), len(words) - size + 1
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, STEP):
        part = words[at : min(n, at + STEP) + size - 1]
        runs = zip(*(part[j:] for j in range(size)))
        hashes = np.array([digest(b" ".join(run), SEED) for run in runs], ">u8")
        total += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int(np.packbits(2 * total > n).view(">u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, print): the fingerprint of each row, as a signed 64-bit number."""

    def make():
        def one(batch):
            prints = np.array([fingerprint_of(x.as_buffer().to_pybytes() if x.is_valid else None) for x in batch.column(1).cast(pa.large_binary())], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], ["doc", "print"])

        return one

    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text).cast("string").alias("text"))
    return map_batches(rows, make, "doc long, print long")


def split(mask: int, parts: int = BITS + 1) -> list[int]:
    """``mask`` widened by each of ``parts`` blocks of the bits that it lacks."""
    free = [bit for bit in range(64) if not mask >> bit & 1]
    cuts = [len(free) * i // parts for i in range(parts + 1)]
    return [mask | sum(1 << bit for bit in free[a:b]) for a, b in zip(cuts, cuts[1:])]


def forest(prints: np.ndarray, bits: int = BITS) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links that connect whatever links of ``bits`` and fewer connect; each fingerprint is reached once."""
    out, rest = [], prints
    while len(rest):
        reached, rest = [rest[0]], rest[1:]
        while reached and len(rest):
            near = np.bitwise_count((rest ^ reached[-1]).view(np.uint64)) <= bits  # of signed numbers it takes the absolute value
            one = reached.pop()
            if near.any():
                found, rest = rest[near], rest[~near]
                out.append((np.full(len(found), one), found))
                reached.extend(found)
    return out


def links(prints: DataFrame, bits: int = BITS, room: int = ROOM) -> DataFrame:
    """(a, b): links among the distinct fingerprints of (print) whose components are those of all links."""
    spark = prints.sparkSession
    level = [m for first in split(0, bits + 1) for m in split(first, bits + 1)]
    signed = {m: int(np.array([m], np.uint64).view(np.int64)[0]) for m in level}
    rows = prints.select("print", F.explode(F.array(*[F.lit(signed[m]) for m in level])).alias("mask"))
    found = None
    while True:
        rows = rows.withColumn("key", F.col("print").bitwiseAND(F.col("mask")))
        met = written(rows.groupBy("mask", "key").agg(F.count("*").alias("size")).filter("size > 1"), "simhash-buckets")
        rows = written(salted_join(rows, met.hint("merge"), ["mask", "key"]), "simhash-members")
        small = rows.filter(F.col("size") <= room).groupBy("mask", "key").agg(F.collect_list("print").alias("prints"))

        def make():
            def one(batch):
                for prints in batch.column(0):
                    for a, b in forest(prints.values.to_numpy(), bits):
                        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

            return one

        now = map_batches(small.select("prints"), make, "a long, b long").distinct()
        found = now if found is None else found.unionByName(now)
        large = rows.filter(F.col("size") > room).select("print", "mask")
        masks = [r[0] for r in large.select("mask").distinct().collect()]  # at most 4 ** depth, whatever the data
        if not masks:
            return found
        finer = [(m, [int(x) for x in np.array(split(m % 2**64, bits + 1), np.uint64).view(np.int64)]) for m in masks]
        finer = spark.createDataFrame(finer, "mask long, masks array<long>")
        rows = large.join(F.broadcast(finer), "mask").select("print", F.explode("masks").alias("mask")).distinct()


def near_components(docs: DataFrame, id_col: str = "doc_id", text: str = "text", bits: int = BITS) -> DataFrame:
    """(doc_id, fingerprint, component_id): 16 hex digits and the smallest id that links lead to, for each row."""
    rows = written(fingerprints(docs, id_col, text), "simhash-prints")
    distinct = written(rows.groupBy("print").agg(F.min("doc").alias("first")), "simhash-distinct")
    joined = components(written(links(distinct.select("print"), bits).distinct(), "simhash-links"))
    named = distinct.join(joined, F.col("print") == F.col("node"), "left").withColumn("least", F.coalesce("least", "print"))
    named = written(named.select("print", "least", "first"), "simhash-named")
    least = named.groupBy("least").agg(F.min("first").alias("component_id"))
    named = salted_join(named.select("print", "least"), least.hint("merge"), ["least"]).select("print", "component_id")
    out = salted_join(rows, named.hint("merge"), ["print"])
    return out.select(F.col("doc").alias("doc_id"), F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")

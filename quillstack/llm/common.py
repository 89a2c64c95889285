"""Helpers shared by the operators: written intermediate tables, Arrow maps, and word hashes over whole Arrow batches."""

from __future__ import annotations

import gc
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstack.session import shared_dir

#: A word of the contracts: a run of anything but space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"
U64 = np.uint64
_GOLD, _M1, _M2 = U64(0x9E3779B97F4A7C15), U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)


def written(df: DataFrame, label: str) -> DataFrame:
    """Write to the shared folder and read back: cuts the lineage and survives the loss of executors."""
    path = shared_dir(df.sparkSession, label)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove the folders of ``written`` tables that nothing will read again."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table._written_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of finished steps; it works when the driver's JVM collects garbage."""
    spark.sparkContext._jvm.System.gc()


def map_batches(
    df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]], schema: str, keeps: bool = False
) -> DataFrame:
    """mapInArrow with state made once per task by ``make``; only with ``keeps`` does the worker go on keeping what earlier tasks kept."""

    def run(batches):
        if not keeps:
            forget_kept()
        one = make()
        for batch in batches:
            if batch.num_rows:
                yield from one(batch)

    return df.mapInArrow(run, schema)


def once_per_worker(name: str, make: Callable[[], object]) -> object:
    """``make()``, kept for later tasks of the same Python worker until a step that keeps nothing runs there; it must depend on ``name`` alone."""
    kept = vars(sys).setdefault("_quillstack_kept", {})
    if name not in kept:
        kept[name] = make()
    return kept[name]


def forget_kept() -> None:
    """Drop what tasks of other steps have kept in this Python worker: Spark reuses workers, and their memory is the executor's."""
    if vars(sys).pop("_quillstack_kept", None):
        gc.collect()


def parts_of(batch: pa.RecordBatch, column: int, most: int) -> Iterator[pa.RecordBatch]:
    """Runs of rows with about ``most`` bytes in a text column; a longer row is a run of its own."""
    sizes = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
    begin, held = 0, 0
    for row, size in enumerate(sizes.tolist()):
        if held and held + size > most:
            yield batch.slice(begin, row - begin)
            begin, held = row, 0
        held += size
    yield batch.slice(begin)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x + _GOLD
    x ^= x >> U64(30)
    x *= _M1
    x ^= x >> U64(27)
    x *= _M2
    x ^= x >> U64(31)
    return x


def keys(n: int, seed: int) -> np.ndarray:
    """``n`` fixed odd multipliers."""
    return mix(np.arange(n, dtype=U64) + U64(seed) * U64(1 << 32)) | U64(1)


class Words:
    """The words of an Arrow string column: 64-bit hashes, and where each row's words begin and end.

    Null texts have no words. ``hashes`` holds the words of all rows in order; row r owns hashes[first[r]:first[r + 1]].
    A word's hash is a sum of products of its bytes' and positions' fixed keys, mixed; it depends on the bytes alone.
    """

    _byte = keys(256, 11)
    #: The products at the first places of a word, 0 for the bytes between words; bytes hashed at a time, so that a core's cache holds them.
    _near = keys(64, 12)[:, None] * np.where(np.isin(np.arange(256), [32, *range(9, 14)]), U64(0), _byte)
    _piece = 1 << 16

    def __init__(self, column: pa.Array) -> None:
        column = column.cast(pa.large_binary())
        if column.null_count:
            column = column.fill_null(b"")
        offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        data = column.buffers()[2]
        self.data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data else np.empty(0, np.uint8)
        self.offsets = offsets - offsets[0]
        data = self.data
        inside = (data != 32) & ((data < 9) | (data > 13))
        start = inside.copy()
        start[1:] &= ~inside[:-1]
        edges = self.offsets[:-1][self.offsets[:-1] < len(data)]
        start[edges] = inside[edges]
        self.starts = np.flatnonzero(start)
        self.first = np.searchsorted(self.starts, self.offsets)
        if len(self.starts) == 0:
            self.hashes = np.empty(0, U64)
            return
        ends = np.append(self.starts[1:], len(data))
        self.hashes = np.empty(len(self.starts), U64)
        begin = np.unique(np.searchsorted(self.starts, np.arange(self.starts[0], self.starts[-1] + 1, self._piece)))
        for i, j in zip(begin, np.append(begin[1:], len(self.starts))):
            starts, low = self.starts[i:j], self.starts[i]
            span = ends[i:j] - starts
            place = np.arange(low, ends[j - 1]) - np.repeat(starts, span)
            if (most := int(span.max())) <= len(self._near):
                part = self._near.reshape(-1)[place * 256 + data[low : ends[j - 1]]]
            else:
                part = self._byte[data[low : ends[j - 1]]] * keys(most, 12)[place]
                part[~inside[low : ends[j - 1]]] = 0
            self.hashes[i:j] = mix(np.add.reduceat(part, starts - low))

    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def grams(words: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Hashes of all runs of ``k`` consecutive entries; runs over row borders are for the caller to leave out."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, U64)
    total = np.zeros(n, U64)
    for j, key in enumerate(keys(k, seed)):
        total += words[j : j + n] * key
    return mix(total)


def word_count(text) -> "F.Column":
    """Number of words of a text column; null counts as 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")

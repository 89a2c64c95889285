"""State tables cut into key buckets: a change reads and writes only the buckets that its keys fall into.

A commit writes the whole new content of the touched buckets as ``data/v=N/bucket=B`` and then, as the mark that makes it
count, one row for each of them below ``commits``. Readers take each bucket from the newest commit that names it, so a
commit that broke off is never read and a bucket can become empty. Commits whose buckets have all been written again are
removed, but for the last few.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quillstack.operators.upsert import newest_per_key, upsert
from quillstack.sources.snapshots import SnapshotTable


class BucketTable:
    """Rows with unique ``keys`` below ``root``; the columns are those of the first change. One writer at a time."""

    def __init__(self, spark: SparkSession, root: str, keys: list[str], buckets: int = 32, keep: int = 3):
        self.spark, self.root, self.keys, self.buckets, self.keep = spark, root.rstrip("/"), keys, buckets, keep
        self.commits = SnapshotTable(spark, f"{self.root}/commits", keep=1 << 30)

    def _bucket(self):
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int").alias("bucket")

    def _current(self) -> dict[int, int]:
        """The commit that holds each bucket; at most a row for each bucket and kept commit is read."""
        out: dict[int, int] = {}
        versions = self.commits.versions()
        if versions:
            found = self.spark.read.parquet(*[f"{self.root}/commits/v={v}" for v in versions]).select("v", "bucket", "rows").collect()
            for r in sorted(found, key=lambda r: r["v"]):
                out[r["bucket"]] = r["v"] if r["rows"] else 0
        return out

    def versions(self) -> list[int]:
        return self.commits.versions()

    def _schema(self) -> StructType:
        return StructType.fromJson(json.loads(self.commits.read().first()["schema"]))

    def read(self, only: list[int] | None = None) -> DataFrame:
        """All rows, or those of the buckets ``only``."""
        if not self.versions():
            raise FileNotFoundError(f"nothing committed below {self.root}")
        paths = [f"{self.root}/data/v={v}/bucket={b}" for b, v in self._current().items() if v and (only is None or b in only)]
        schema = self._schema()
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _commit(self, rows: DataFrame, touched: list[int]) -> int:
        version = self.commits.next_version()
        path = f"{self.root}/data/v={version}"
        bucketed = rows.withColumn("bucket", self._bucket())
        bucketed.repartition(max(1, len(touched)), "bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)
        full = StructType([*rows.schema.fields, *StructType.fromDDL("bucket int").fields])
        counts = {r["bucket"]: r["n"] for r in self.spark.read.schema(full).parquet(path).groupBy("bucket").agg(F.count("*").alias("n")).collect()}
        made = [(version, b, counts.get(b, 0), rows.schema.json()) for b in touched]
        self.commits.write(self.spark.createDataFrame(made, "v int, bucket int, rows long, schema string").coalesce(1), version)
        self._drop_replaced(version)
        return version

    def _drop_replaced(self, version: int) -> None:
        """Remove commits that hold no bucket any more."""
        versions = self.commits.versions()
        named: dict[int, int] = {}
        for r in self.spark.read.parquet(*[f"{self.root}/commits/v={v}" for v in versions]).select("v", "bucket").collect():
            named[r["bucket"]] = max(r["v"], named.get(r["bucket"], 0))
        jvm = self.spark._jvm
        for old in sorted(set(versions) - set(named.values()) - {version})[: -self.keep]:
            # The mark last: data without a mark is not read.
            for path in (f"{self.root}/data/v={old}", f"{self.root}/commits/v={old}"):
                path = jvm.org.apache.hadoop.fs.Path(path)
                path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def _touched(self, changes: DataFrame) -> list[int]:
        return sorted(r[0] for r in changes.select(self._bucket()).distinct().collect())

    def upsert(self, changes: DataFrame, order: list | None = None, keep_best: bool = False) -> int | None:
        """Add or replace rows; returns the commit, or None for no change.

        ``order`` picks among rows of ``changes`` with one key; with ``keep_best`` the stored row takes part as well, so a
        row that arrives late does not replace a better one. Repeating a change gives the same rows.
        """
        touched = self._touched(changes)
        if not touched:
            return None
        if not self.versions():
            return self._commit(newest_per_key(changes, self.keys, order) if order else changes, touched)
        old = self.read(touched)
        if keep_best:
            return self._commit(newest_per_key(old.unionByName(changes.select(*old.columns)), self.keys, order), touched)
        return self._commit(upsert(old, changes, self.keys, order).select(*old.columns), touched)

    def delete(self, doomed: DataFrame) -> int | None:
        """Remove the rows whose key is in ``doomed``."""
        touched = self._touched(doomed)
        if not touched or not self.versions():
            return None
        return self._commit(self.read(touched).join(doomed.select(*self.keys).distinct(), self.keys, "left_anti"), touched)

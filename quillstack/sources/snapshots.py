"""Versioned Parquet tables: each change writes a new ``v=N`` folder, readers use the newest finished one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class SnapshotTable:
    """A table stored as full snapshots below ``root``.

    A snapshot counts once Spark has written its ``_SUCCESS`` marker, so a failed write is never read, and the
    folder a running query reads is never overwritten.
    """

    def __init__(self, spark: SparkSession, root: str, partition_by: list[str] | None = None, keep: int = 3):
        self.spark = spark
        self.root = root.rstrip("/")
        self.partition_by = partition_by or []
        self.keep = keep

    def _folders(self) -> dict[int, bool]:
        """Every snapshot folder, and whether it is finished."""
        jvm = self.spark._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.root)
        fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(root):
            return {}
        found = {}
        for status in fs.listStatus(root):
            name = status.getPath().getName()
            if name.startswith("v="):
                found[int(name[2:])] = fs.exists(jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS"))
        return found

    def versions(self) -> list[int]:
        return sorted(v for v, done in self._folders().items() if done)

    def read(self, version: int | None = None, schema: StructType | None = None) -> DataFrame:
        """The newest snapshot, or ``version``; ``schema`` is for snapshots that may hold no row and so no file."""
        known = self.versions()
        if not known:
            raise FileNotFoundError(f"no finished snapshot below {self.root}")
        reader = self.spark.read.schema(schema) if schema else self.spark.read
        return reader.parquet(f"{self.root}/v={known[-1] if version is None else version}")

    def next_version(self) -> int:
        """A number above every folder's, that of a write that broke off too."""
        return max(self._folders(), default=0) + 1

    def write(self, df: DataFrame, version: int | None = None) -> int:
        """Write the next snapshot and return its number; fails when another writer took the same number.

        Of older snapshots the last ``keep`` stay. ``version`` is for tables that share one numbering.
        """
        version = version or self.next_version()
        writer = df.write.mode("errorifexists")
        if self.partition_by:
            writer = writer.partitionBy(*self.partition_by)
        writer.parquet(f"{self.root}/v={version}")
        self._drop_before(version)
        return version

    def delete(self, where: str | Column) -> int:
        """Write the next snapshot without the rows that ``where`` holds for, and return their number.

        They are counted in the pass that writes, so the table is read once.
        """
        doomed = F.coalesce(F.expr(where) if isinstance(where, str) else where, F.lit(False))
        seen = Observation()
        rows = self.read().observe(seen, F.count_if(doomed).alias("affected"))
        self.write(rows.filter(~doomed))
        return seen.get["affected"]

    def update(self, where: str | Column, values: dict[str, str | Column]) -> int:
        """Write the next snapshot with new ``values`` where ``where`` holds, and return the number of rows changed.

        Values are computed from the row as it was.
        """
        hit = F.coalesce(F.expr(where) if isinstance(where, str) else where, F.lit(False))
        old = self.read()
        seen = Observation()
        counted = old.observe(seen, F.count_if(hit).alias("affected"))
        made = {c: F.when(hit, F.expr(v) if isinstance(v, str) else v).otherwise(F.col(c)).cast(old.schema[c].dataType) for c, v in values.items()}
        self.write(counted.withColumns(made))
        return seen.get["affected"]

    def _drop_before(self, version: int) -> None:
        jvm = self.spark._jvm
        for old in sorted(v for v, done in self._folders().items() if done and v < version)[: -self.keep]:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/v={old}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

"""Token totals kept by deltas: batches of signed changes, each committed once, summed by source, language and tokenizer.

A batch is aggregated and written to a folder named after its id; Spark's success marker is the commit. A batch that is
committed again changes nothing, one whose write broke off is written anew. Totals are the sum of the committed batches,
or of the newest base that ``compact`` has written and the batches it does not hold; nothing is ever updated in place.

A change has op (insert, delete or revise), source, lang, tokenizer, tokens and was_tokens (the count a revision
replaces). Null counts are 0; null sources, languages and tokenizers are keys like others; another op is an error; an
empty batch is a commit without rows. Repeated rows are separate changes; further columns are left out.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = ["source", "lang", "tokenizer"]
DELTAS = "source string, lang string, tokenizer string, docs long, tokens long"


def deltas(changes: DataFrame) -> DataFrame:
    """Signed document and token counts of a batch, one row for each key."""
    op, n, was = F.col("op"), F.coalesce("tokens", F.lit(0)), F.coalesce("was_tokens", F.lit(0))
    wrong = F.raise_error(F.concat(F.lit("unknown op: "), F.coalesce(op, F.lit("null")))).cast("long")
    rows = changes.select(
        *KEYS,
        F.when(op == "insert", F.lit(1)).when(op == "delete", F.lit(-1)).when(op == "revise", F.lit(0)).otherwise(wrong).cast("long").alias("docs"),
        F.when(op == "insert", n).when(op == "delete", -n).otherwise(n - was).cast("long").alias("tokens"),
    )
    return rows.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))


class Rollups:
    """The totals below one folder that all executors share. One writer at a time for each batch id."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _committed(self, kind: str) -> list[str]:
        """Ids of the folders of a kind that hold a success marker, sorted."""
        jvm = self.spark.sparkContext._jvm
        pattern = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{kind}-*/_SUCCESS")
        files = pattern.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).globStatus(pattern)
        return sorted(f.getPath().getParent().getName()[len(kind) + 1 :] for f in files or [])

    def _read(self, folders: list[str], schema: str) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{x}" for x in folders])

    def batches(self) -> list[str]:
        return self._committed("batch")

    def commit(self, batch_id: str, changes: DataFrame) -> bool:
        """Add a batch; False, without any work, if it is there already."""
        if not re.fullmatch(r"[A-Za-z0-9_.]+", batch_id):
            raise ValueError(f"not a batch id: {batch_id!r}")
        if batch_id in self.batches():
            return False
        deltas(changes).write.mode("overwrite").parquet(f"{self.path}/batch-{batch_id}")
        return True

    def _parts(self) -> tuple[DataFrame, list[str]]:
        """Rows to sum, and the batches they stand for."""
        bases, batches = self._committed("base"), self.batches()
        held = []
        if bases:
            members = self._read([f"members-{bases[-1]}"], "batch string")
            held = [r[0] for r in members.collect()]
        rows = self._read([f"batch-{b}" for b in batches if b not in set(held)], DELTAS)
        return (rows.unionByName(self._read([f"base-{bases[-1]}"], DELTAS)) if bases else rows), batches

    def totals(self) -> DataFrame:
        """(source, lang, tokenizer, docs, tokens); keys whose counts have come back to zero are left out."""
        total = self._parts()[0].groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        return total.filter("docs <> 0 OR tokens <> 0")

    def compact(self) -> None:
        """Write the totals of all committed batches as the next base; its list of batches is written first."""
        rows, batches = self._parts()
        name = f"{len(self._committed('base')):08d}"
        self.spark.createDataFrame([(b,) for b in batches], "batch string").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/members-{name}")
        rows.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).write.mode("overwrite").parquet(f"{self.path}/base-{name}")

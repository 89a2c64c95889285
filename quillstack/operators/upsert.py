"""Upsert and delete by key, as joins that give the table's next snapshot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def newest_per_key(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """One row per key, the last in ``order``; map-side combined, so a key with many copies does not move them all."""
    row = F.struct(*df.columns)
    return df.groupBy(*keys).agg(F.max_by(row, F.struct(*order)).alias("__row")).select("__row.*")


def upsert(
    old: DataFrame, new: DataFrame, keys: list[str], order: list[Column | str] | None = None, keep: list[str] | None = None
) -> DataFrame:
    """Matched keys take every column of ``new``, other rows are kept, unmatched new rows are added.

    ``order`` picks the winner when ``new`` repeats a key. Columns in ``keep`` (such as ``created_at``) keep the old value.
    """
    fresh = newest_per_key(new, keys, order) if order else new
    if keep:
        before = old.select(*keys, *[F.col(c).alias(f"__old_{c}") for c in keep])
        fresh = fresh.join(before, keys, "left")
        for column in keep:
            fresh = fresh.withColumn(column, F.coalesce(f"__old_{column}", column)).drop(f"__old_{column}")
    untouched = old.join(fresh.select(*keys), keys, "left_anti").select(*old.columns)
    return untouched.unionByName(fresh, allowMissingColumns=True)


def merge_into(table: str, new: DataFrame, keys: list[str]) -> None:
    """``MERGE INTO`` for catalogs whose tables support row-level updates."""
    condition = F.lit(True)
    for key in keys:
        condition = condition & (F.col(f"target.{key}") == F.col(f"source.{key}"))
    (
        new.alias("source").mergeInto(f"{table} AS target", condition)
        .whenMatched().updateAll().whenNotMatched().insertAll().merge()
    )


def delete_keys(df: DataFrame, doomed: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key is not in ``doomed``."""
    return df.join(doomed.select(*keys).distinct(), keys, "left_anti")


def pending(todo: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``todo`` without a match in ``done``: the work a resumed run still has to do."""
    return todo.join(done.select(*keys).distinct(), keys, "left_anti")


def pending_counts(todo: DataFrame, done: DataFrame, keys: list[str], group: list[str]) -> DataFrame:
    """Per group: total rows and rows still pending, from one join."""
    marked = todo.join(done.select(*keys).distinct().withColumn("__done", F.lit(1)), keys, "left")
    return marked.groupBy(*group).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("__done").isNull()).alias("pending")
    )

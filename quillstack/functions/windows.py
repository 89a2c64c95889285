"""Window helpers that stay parallel when one key holds a large share of all rows.

A plain ``Window.partitionBy(key)`` sends every row of a hot key to one task. The helpers here cut a key's rows
into ordered buckets (a column computed from the order column, such as the hour of a timestamp or ``turn div 256``),
run the window per (key, bucket) and carry the small per-bucket results across buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _same(left: str, right: str, keys: list[str]) -> Column:
    cond = F.lit(True)
    for key in keys:
        cond = cond & F.col(f"{left}.{key}").eqNullSafe(F.col(f"{right}.{key}"))
    return cond


def _join_buckets(rows: DataFrame, per_bucket: DataFrame, keys: list[str]) -> DataFrame:
    """Left join on null-safe keys, keeping the columns of ``rows`` once."""
    extra = [c for c in per_bucket.columns if c not in keys]
    return (
        rows.alias("r")
        .join(per_bucket.alias("b"), _same("r", "b", keys), "left")
        .select("r.*", *[F.col(f"b.{c}") for c in extra])
    )


def running_sum(
    df: DataFrame, keys: list[str], order: list[Column], bucket: str, value: Column, name: str, descending: bool = False
) -> DataFrame:
    """Add ``name`` = sum of ``value`` over the key's rows up to and including this one.

    ``bucket`` is a column that never decreases along ``order`` (never increases when ``descending``).
    """
    rows = df.withColumn("__value", value)
    per_bucket = rows.groupBy(*keys, bucket).agg(F.sum("__value").alias("__total"))
    bucket_order = F.col(bucket).desc() if descending else F.col(bucket).asc()
    before = W.partitionBy(*keys).orderBy(bucket_order).rowsBetween(W.unboundedPreceding, -1)
    offsets = per_bucket.select(*keys, bucket, F.coalesce(F.sum("__total").over(before), F.lit(0)).alias("__before"))
    inner = W.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("__inner", F.sum("__value").over(inner))
    return (
        _join_buckets(rows, offsets, [*keys, bucket])
        .withColumn(name, F.col("__inner") + F.col("__before"))
        .drop("__value", "__inner", "__before")
    )


def previous_row(
    df: DataFrame, keys: list[str], order: list[str], bucket: str, columns: list[str], prefix: str = "prev_"
) -> DataFrame:
    """Add ``prefix + column`` taken from the key's preceding row in ``order`` (null on the first row)."""
    picked = F.struct(*columns)
    last = df.groupBy(*keys, bucket).agg(F.max_by(picked, F.struct(*order)).alias("__last"))
    across = W.partitionBy(*keys).orderBy(bucket)
    carried = last.select(*keys, bucket, F.lag("__last").over(across).alias("__carried"))
    inner = W.partitionBy(*keys, bucket).orderBy(*order)
    rows = df.withColumn("__lag", F.lag(picked).over(inner))
    out = _join_buckets(rows, carried, [*keys, bucket]).withColumn("__p", F.coalesce("__lag", "__carried"))
    for column in columns:
        out = out.withColumn(prefix + column, F.col("__p")[column])
    return out.drop("__lag", "__carried", "__p")


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], n: int, rank: str = "rank") -> DataFrame:
    """First ``n`` rows per group with their rank; Spark keeps at most ``n`` rows per group and task before the shuffle."""
    return df.withColumn(rank, F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter(F.col(rank) <= n)


def page(df: DataFrame, order: list[Column], number: int, size: int, total: str | None = "total") -> DataFrame:
    """Page ``number`` (from 1) of ``df``; the row total comes from a scalar subquery, never from a global window."""
    out = df
    if total:
        out = out.withColumn(total, df.agg(F.count(F.lit(1))).scalar())
    return out.orderBy(*order).offset((number - 1) * size).limit(size)


def salted_join(rows: DataFrame, unique: DataFrame, keys: list[str], salts: int = 16, how: str = "inner") -> DataFrame:
    """Join many ``rows`` to a side with one row per key; each key's rows spread over ``salts`` tasks.

    The salt is a hash of the whole row, so a retried task gives the same rows. ``how`` is inner, left, left_semi or left_anti.
    """
    hashed = [c for c in rows.columns if c not in keys and rows.schema[c].dataType.typeName() not in ("map", "variant")]
    salt = F.pmod(F.xxhash64(*hashed), F.lit(salts)) if hashed else F.lit(0).cast("long")
    left = rows.withColumn("__salt", salt)
    right = unique.withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    return left.join(right, [*keys, "__salt"], how).drop("__salt")

"""Bottom-k sketches of word shingles as column expressions: DataFrame functions only.

A sketch is the sorted array of the k smallest distinct 64-bit hashes of a text's shingles of five words; a text of one
to four words has one shingle, all its words. Words are runs without space and U+0009 to U+000D, taken as they are. The
sketch of a union is the k smallest of the sketches' union, so parts of a text or of a table merge in any order.

A null or empty text has the empty sketch. Two empty sketches are alike (1.0); an empty and another one are not (0.0).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstack.functions.arrays import let

K, SHINGLE = 128, 5
BLANKS = " \t\n\x0b\f\r"


def sketch(text: Column, k: int = K, words: int = SHINGLE) -> Column:
    """array<bigint>: the bottom-k sketch of a text column."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    hashed = F.transform(F.split(trimmed, r"[\x20\x09-\x0D]+"), lambda w: F.xxhash64(w))

    def shingles(h: Column) -> Column:
        run = F.transform(
            F.slice(h, 1, F.size(h) - (words - 1)), lambda x, i: F.xxhash64(x, *[F.get(h, i + j) for j in range(1, words)])
        )
        return F.when(F.size(h) >= words, run).otherwise(F.array(F.xxhash64(h)))

    made = F.slice(F.sort_array(F.array_distinct(let(hashed, shingles))), 1, k)
    return F.when(trimmed == "", F.expr("cast(array() as array<bigint>)")).otherwise(made)


def merged(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of the union."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimate of the shared part of all shingles of both; exact when both have at most k / 2."""
    union = merged(a, b, k)
    shared = F.size(F.array_intersect(union, F.array_intersect(a, b)))
    return F.when(F.size(a) + F.size(b) == 0, F.lit(1.0)).otherwise(shared / F.greatest(F.size(union), F.lit(1)))


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimate of the number of distinct shingles; exact below k."""
    reach = (F.element_at(a, -1).cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / reach)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimate of the part of a's shingles that b has too (0 to 1); an empty a is contained."""
    like, n_a, n_b = resemblance(a, b, k), distinct_shingles(a, k), distinct_shingles(b, k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), like * (n_a + n_b) / ((1 + like) * n_a)))


def as_text(a: Column) -> Column:
    """The fingerprint as text: 16 hexadecimal digits for each hash."""
    return F.array_join(F.transform(a, lambda x: F.lpad(F.hex(x), 16, "0")), "")


def merge_parts(parts: DataFrame, key: str, a: str, k: int = K) -> DataFrame:
    """(key, a): one sketch for each key from those of its parts, cut in every task before the shuffle."""
    hashes = parts.select(F.col(key).alias("key"), F.explode(a).alias("hash")).distinct()
    least = Window.partitionBy("key").orderBy("hash")
    kept = hashes.withColumn("nth", F.row_number().over(least)).filter(F.col("nth") <= k)
    return kept.groupBy("key").agg(F.sort_array(F.collect_list("hash")).alias("s")).select(F.col("key").alias(key), F.col("s").alias(a))


def with_next(docs: DataFrame, id_col: str, carried: list[str]) -> DataFrame:
    """``id_col`` and ``carried``, and ``next_<c>`` for each: those of the next row by id; after the last comes the first.

    Null ids come last; rows with one id follow each other by their carried values. Ids are cut into ranges at their
    percentiles; a range's first row is also put at the end of the range before, so each range stands alone.
    """
    spark = docs.sparkSession
    ranges = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    ids = docs.select(F.col(id_col).alias("id"))
    cuts = ids.agg(F.percentile_approx("id", [i / ranges for i in range(1, ranges)], 10 * ranges)).first()[0] or []
    cuts = F.lit(sorted(set(cuts))).cast("array<bigint>") if cuts else F.expr("cast(array() as array<bigint>)")

    def place(i: Column) -> Column:
        return F.when(i.isNull(), F.lit(ranges)).otherwise(F.size(F.filter(cuts, lambda c: c <= i)))

    # One row for each range, at most `ranges` + 1.
    firsts = ids.groupBy(place(F.col("id")).alias("range")).agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id")).alias("f"))
    firsts = sorted((r["range"], r["f"]["id"]) for r in firsts.collect())
    before = [(firsts[i][1], firsts[i - 1][0]) for i in range(len(firsts))]
    sentinels = spark.createDataFrame(before, "first_id long, range_before int")
    rows = docs.select(
        F.col(id_col).alias("id"), place(F.col(id_col)).alias("range"), *[F.col(c).alias(f"own_{c}") for c in carried]
    ).join(F.broadcast(sentinels), F.col("id").eqNullSafe(F.col("first_id")), "left")
    places = F.when(F.col("range_before").isNull(), F.array(F.struct(F.col("range"), F.lit(0).alias("copy")))).otherwise(
        F.array(F.struct(F.col("range"), F.lit(0).alias("copy")), F.struct(F.col("range_before").alias("range"), F.lit(1).alias("copy")))
    )
    rows = rows.select("id", *[f"own_{c}" for c in carried], F.explode(places).alias("at"))
    order = Window.partitionBy("at.range").orderBy("at.copy", F.col("id").asc_nulls_last(), f"own_{carried[0]}")
    led = rows.select("*", *[F.lead(f"own_{c}").over(order).alias(f"next_{c}") for c in carried])
    return led.filter("at.copy = 0").select(
        F.col("id").alias(id_col), *[F.col(f"own_{c}").alias(c) for c in carried], *[f"next_{c}" for c in carried]
    )


def edited(text: Column, following: Column) -> Column:
    """The last half (rounded down) of the code points replaced by as many of the next text, or all it has."""
    half = F.floor(F.char_length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.char_length(text) - half), F.substring(following, F.lit(1), half))

"""Memory notes: search, list, statistics and changes. Notes have id, content, keywords, tags, category, timestamp, metadata."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstack.functions.arrays import explode_items
from quillstack.functions.windows import page, top_per_group
from quillstack.operators.textsearch import with_fallback
from quillstack.operators.upsert import delete_keys, upsert
from quillstack.operators.vector import dense_search
from quillstack.schemas import tenant_filter


def note_condition(category: str | None = None, metadata: dict | None = None) -> Column:
    condition = F.lit(True)
    if category is not None:
        condition = condition & (F.col("category") == category)
    for key, value in (metadata or {}).items():
        condition = condition & F.coalesce(F.try_element_at("metadata", F.lit(key)) == F.lit(str(value)), F.lit(False))
    return condition


def search_notes(
    notes: DataFrame, query: str, k: int = 5, category: str | None = None, metadata: dict | None = None, order: str = "id"
) -> DataFrame:
    """Notes whose content holds the query, regardless of case; the first ``k`` in insertion order."""
    rows = notes.filter(note_condition(category, metadata))
    return rows.filter(F.contains(F.lower("content"), F.lower(F.lit(query)))).orderBy(order).limit(k)


def search_notes_by_vector(
    notes: DataFrame, vector: list[float], query: str, k: int = 5, threshold: float = 1.0, metric: str = "l2",
    category: str | None = None, metadata: dict | None = None,
) -> DataFrame:
    """Nearest notes within ``threshold``; conditions come before the ranking. Without a hit, the text search answers."""
    rows = notes.filter(note_condition(category, metadata))
    near = dense_search(rows, vector, k, ["id"], "vector", metric, max_distance=threshold).select("id", "distance")
    text = search_notes(rows, query, k).select("id", F.lit(-1.0).alias("distance"))
    return with_fallback(near, text)


def list_notes(
    notes: DataFrame, category: str | None = None, since: datetime.datetime | None = None, until: datetime.datetime | None = None,
    tags: list[str] | None = None, keywords: list[str] | None = None,
) -> DataFrame:
    """Notes of a category and time range that carry all the tags and keywords, newest first."""
    rows = notes if category is None else notes.filter(F.col("category") == category)
    if since is not None:
        rows = rows.filter(F.col("timestamp") >= F.lit(since).cast("timestamp"))
    if until is not None:
        rows = rows.filter(F.col("timestamp") <= F.lit(until).cast("timestamp"))
    for name, wanted in (("tags", tags), ("keywords", keywords)):
        if wanted:
            rows = rows.filter(F.size(F.array_except(F.lit(wanted), F.col(name))) == 0)
    return rows.orderBy(F.col("timestamp").desc(), "id")


def note_counts(notes: DataFrame) -> DataFrame:
    """Rows (kind, value, notes): counts per category and per tag."""
    categories = notes.select(F.lit("category").alias("kind"), F.col("category").alias("value"))
    tags = explode_items(notes.select("tags"), F.col("tags"), "value", keep=[]).select(F.lit("tag").alias("kind"), "value")
    return categories.unionByName(tags).groupBy("kind", "value").agg(F.count(F.lit(1)).alias("notes"))


def relevant_notes(notes: DataFrame, query: str, categories: list[str], per_category: int, limit: int) -> DataFrame:
    """Best notes of several categories, in the order of the categories; equal contents once."""
    place = F.array_position(F.lit(categories), F.col("category"))
    hits = notes.filter(F.col("category").isin(categories)).filter(F.contains(F.lower("content"), F.lower(F.lit(query))))
    top = top_per_group(hits, ["category"], [F.col("id")], per_category).withColumn("__place", place)
    row = F.struct(*top.columns)
    unique = top.groupBy("content").agg(F.min_by(row, F.struct("__place", "rank")).alias("__r")).select("__r.*")
    return unique.orderBy("__place", "rank").limit(limit).drop("__place")


def save_notes(notes: DataFrame, changed: DataFrame) -> DataFrame:
    return upsert(notes, changed, ["id"])


def delete_notes(notes: DataFrame, ids: DataFrame) -> DataFrame:
    return delete_keys(notes, ids, ["id"])


def note_page(notes: DataFrame, number: int, size: int) -> DataFrame:
    return page(notes, [F.col("timestamp").desc(), F.col("id")], number, size)


def notes_of(notes: DataFrame, user_id: int | None, is_admin: bool = False) -> DataFrame:
    """The notes a user may see; without a user there are none."""
    return tenant_filter(notes, user_id, is_admin)

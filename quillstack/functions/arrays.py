"""Exploding arrays without computing them twice."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def explode_items(
    df: DataFrame, items: Column, value: str = "item", position: str | None = None, keep: list[str] | None = None
) -> DataFrame:
    """One row per array item, with its position from 0 when a name for it is given.

    Spark puts a filter on the array's size below a plain ``explode``, which evaluates the whole array expression a
    second time; the outer form has no such filter, and rows of empty arrays are dropped afterwards.
    """
    kept = df.columns if keep is None else keep
    place = position or "__position"
    rows = df.select(*kept, F.posexplode_outer(items).alias(place, value)).filter(F.col(place).isNotNull())
    return rows if position else rows.drop(place)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often ``body`` uses it.

    Spark computes a column expression again at each place it stands, and inside a lambda once per array item. A lambda
    variable is computed once.
    """
    return F.transform(F.array(value), lambda bound: body(bound))[0]

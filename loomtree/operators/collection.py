"""Operators over a collection of documents: a DataFrame with one row a document, typed columns where the schema is known.

Where the result depends on the order of the collection, a position column says what that order is; no operator relies
on the order of rows. Sorted prefixes become TakeOrderedAndProject; aggregates run partially before their shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def select(df: DataFrame, test: Column) -> DataFrame:
    """Rows for which the test is true; NULL counts as false."""
    return df.where(F.coalesce(test, F.lit(False)))


def pick(df: DataFrame, *names: str) -> DataFrame:
    """The named columns in this order; missing ones are ignored."""
    return df.select(*[n for n in names if n in df.columns])


def omit(df: DataFrame, *names: str) -> DataFrame:
    return df.drop(*names)


def sort_by(df: DataFrame, key: Column, position: str, reverse: bool = False) -> DataFrame:
    """NULL first, ties by position; reversed, both turn round."""
    return df.orderBy(key.desc_nulls_last(), F.col(position).desc()) if reverse else df.orderBy(key.asc_nulls_first(), F.col(position))


def top(df: DataFrame, key: Column, position: str, n: int, reverse: bool = True, skip: int = 0) -> DataFrame:
    """Rows skip to skip + n of the sorted collection."""
    out = sort_by(df, key, position, reverse)
    return out.offset(skip).limit(n) if skip else out.limit(n)


def slice_rows(df: DataFrame, position: str, start: int, stop: int, step: int = 1) -> DataFrame:
    """Rows at positions start, start + step, ... below stop, of a collection whose position column counts from 0."""
    p = F.col(position)
    return df.where((p >= start) & (p < stop) & ((p - start) % step == 0))


def unique(df: DataFrame, keys: list[str], position: str) -> DataFrame:
    """The first row of each key; partial aggregation keeps one row a key and task before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    first = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), position).alias("_first"))
    return first.select(*[F.col(f"_first.{c}").alias(c) if c in rest else F.col(c) for c in df.columns])


def group_rows(df: DataFrame, key: Column, fields: list[str], position: str) -> DataFrame:
    """(key, items): the key as text (NULL is 'null'), items in the order of the collection.

    A group becomes one array, so this is for groups that fit one row; group_agg has no such bound.
    """
    items = F.array_sort(F.collect_list(F.struct(F.col(position).alias("_position"), F.struct(*fields).alias("item"))))
    out = df.groupBy(F.coalesce(key.cast("string"), F.lit("null")).alias("key")).agg(items.alias("items"))
    return out.select("key", F.transform("items", lambda x: x["item"]).alias("items"))


def group_agg(df: DataFrame, key: Column, **aggregates: Column) -> DataFrame:
    """Grouping followed by an aggregate of each group, as one partial and one final aggregation."""
    return df.groupBy(F.coalesce(key.cast("string"), F.lit("null")).alias("key")).agg(*[c.alias(n) for n, c in aggregates.items()])


def total(c: Column) -> Column:
    """0 for no rows."""
    return F.coalesce(F.sum(c), F.lit(0))


def mean(c: Column) -> Column:
    return F.avg(c.cast("double"))


def least(c: Column) -> Column:
    """NULL is the least value."""
    return F.when(F.count_if(c.isNull()) == 0, F.min(c))


def greatest(c: Column) -> Column:
    return F.max(c)


def first(row: Column, position: str) -> Column:
    return F.min_by(row, F.col(position))


def last(row: Column, position: str) -> Column:
    return F.max_by(row, F.col(position))


def apply(df: DataFrame, change: Callable[[Column], Column], name: str) -> DataFrame:
    """Every value of a column changed."""
    return df.withColumn(name, change(F.col(name)))


def union(*parts: DataFrame) -> DataFrame:
    """Bag union in any order of columns."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def latest(df: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """The last row of each key by an order, for folds of versions."""
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(order.desc())))
    return ranked.where("_rank = 1").drop("_rank")

"""Joins, set operations and lookups that the pipelines are made of."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Metadata up to so many rows is broadcast; more is joined by shuffle.
BROADCAST_ROWS = 200_000


def bounded(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """The frame, marked for broadcast if a count shows that it is within the bound."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def last_per_key(rows: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """One row per key: the last in order."""
    row = F.struct(*[c for c in rows.columns if c != key])
    return rows.groupBy(key).agg(F.max_by(row, F.struct(*order)).alias("r_")).select(key, "r_.*")


def first_per_key(rows: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """One row per key: the first in order, whichever task saw it first."""
    row = F.struct(*[c for c in rows.columns if c != key])
    return rows.groupBy(key).agg(F.min_by(row, F.struct(*order)).alias("r_")).select(key, "r_.*")


def enrich(rows: DataFrame, metadata: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Left join on a unique key; a row's own value goes before the metadata's."""
    meta = metadata.select(key, *(F.col(c).alias(f"{c}__m") for c in columns))
    joined = rows.join(bounded(meta), key, "left")
    own = lambda c: F.coalesce(F.col(c), F.col(f"{c}__m")) if c in rows.columns else F.col(f"{c}__m")
    return joined.select(*[c for c in rows.columns if c not in columns], *(own(c).alias(c) for c in columns))


def outstanding(wanted: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not yet done: what a resumed run has to do."""
    return wanted.join(done.select(key), key, "left_anti")


def same_keys(a: DataFrame, b: DataFrame, key: str) -> bool:
    """Whether two frames have the same set of keys."""
    ka, kb = a.select(key), b.select(key)
    return ka.exceptAll(ka.intersect(kb)).distinct().isEmpty() and kb.join(ka, key, "left_anti").isEmpty() and ka.join(kb, key, "left_anti").isEmpty()


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Whether two frames have the same rows, counted: a full read-back check."""
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct rows of a that b lacks, by place of the columns."""
    return a.subtract(b.toDF(*a.columns))


def union_all(frames: list[DataFrame]) -> DataFrame:
    """All rows, by column name."""
    return reduce(DataFrame.unionByName, frames)


def zip_by_position(keys: DataFrame, values: str, names: str) -> DataFrame:
    """Pairs of two array columns by place; arrays of different length are an error."""
    checked = F.when(F.size(values) == F.size(names), F.arrays_zip(values, names)).otherwise(F.raise_error(F.lit("answers and questions differ in number")))
    return keys.select("*", F.posexplode(checked).alias("place", "pair")).select(*[c for c in keys.columns if c not in (values, names)], "place", F.col("pair")[names].alias(names), F.col("pair")[values].alias(values))


def prefix_sums(rows: DataFrame, group: str, order: str, size: str) -> DataFrame:
    """Where each row begins, if the group's rows follow one another."""
    w = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("begin", F.coalesce(F.sum(size).over(w), F.lit(0)))

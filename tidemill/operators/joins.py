"""Joins and lookups that need more than one relational step."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def align(left: DataFrame, right: DataFrame, key: str, right_key: str | None = None) -> DataFrame:
    """Rows of both sides that share an id; each side holds an id once."""
    return left.join(right if right_key is None else right.withColumnRenamed(right_key, key), key)


def last_by_key(df: DataFrame, key: str, order: str, out: str) -> DataFrame:
    """A dimension ``(key, out)``: of rows with the same key the one that came last; null keys are no keys."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(order).alias(out))


def unique_only(df: DataFrame, key: str, value: str, out: str) -> DataFrame:
    """A dimension ``(key, out)`` of the keys that occur once: ambiguous keys find nothing."""
    counted = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n"), F.min(value).alias(out))
    return counted.where("_n = 1").drop("_n")


def first_hit(df: DataFrame, id_col: str, parts: Column, dim: DataFrame, dim_key: str, value: str, part_key=lambda c: c) -> DataFrame:
    """``(id, value)``: the value of the first element of a list that the dimension knows; lists of any length."""
    listed = df.select(id_col, F.posexplode(parts).alias("_pos", "_part"))
    hits = listed.join(dim.select(F.col(dim_key).alias("_k"), value), part_key(F.col("_part")) == F.col("_k"))
    return hits.groupBy(id_col).agg(F.min_by(value, "_pos").alias(value))


def cells(*dims: DataFrame) -> DataFrame:
    """Every combination of small dimensions, each of distinct values."""
    out = dims[0]
    for d in dims[1:]:
        out = out.crossJoin(F.broadcast(d))  # the operator's purpose; callers pass distinct category values
    return out


def counted_cells(grid: DataFrame, counts: DataFrame, keys: list[str], n: str = "n") -> DataFrame:
    """The grid with its counts, 0 where a cell is empty."""
    return grid.join(counts, keys, "left").withColumn(n, F.coalesce(n, F.lit(0)))


def overlaid(df: DataFrame, fixes: DataFrame, key: str, column: str, fix: str) -> DataFrame:
    """``column`` replaced where there is a fix, and ``changed``: whether that made a difference."""
    out = df.join(fixes, key, "left")
    new = F.coalesce(fix, column)
    changed = F.coalesce((F.col(fix) != F.coalesce(column, F.lit(""))).cast("int"), F.lit(0))
    return out.withColumns({"changed": changed, column: new}).drop(fix)

"""Identifiers by first appearance without a global sort in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def first_seen_ids(df: DataFrame, seq: str, out: str, width: int = 1 << 16) -> DataFrame:
    """``df`` with ``out`` = 1.. in the order of the unique, non-negative ``seq``.

    Rows are numbered inside ranges of ``width`` sequence numbers; the ranges' counts are summed in a
    table of one row per range.  No task sees more than ``width`` rows.
    """
    d = df.withColumn("_r", F.floor(F.col(seq) / width))
    counts = d.groupBy("_r").count()
    before = counts.select("_r", F.coalesce(F.sum("count").over(Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_b"))
    d = d.withColumn("_n", F.row_number().over(Window.partitionBy("_r").orderBy(seq)))
    return d.join(before, "_r").withColumn(out, F.col("_b") + F.col("_n")).drop("_r", "_b", "_n")

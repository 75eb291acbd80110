"""Deterministic samples, shuffles and splits by hash; ties by id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .metrics import running


def order_key(seed: int, id_col: str) -> Column:
    """A pseudorandom order any engine can compute."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")))


def sample(df: DataFrame, id_col: str, n: int, seed: int) -> DataFrame:
    return df.orderBy(order_key(seed, id_col), id_col).limit(n)


def per_stratum(df: DataFrame, strata: list[str], id_col: str, n: Column, seed: int) -> DataFrame:
    """The first ``n`` of each stratum in hash order; planned as a limited window, so a hot stratum is
    cut down before its rows are sorted."""
    w = Window.partitionBy(*strata).orderBy(order_key(seed, id_col), id_col)
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def bucket(seed: int, key: Column, buckets: int) -> Column:
    """A stable bucket of a key: leading hash digits modulo the number of buckets."""
    return F.pmod(F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string"))), 1, 8), 16, 10).cast("long"), F.lit(buckets))


def group_folds(df: DataFrame, group: str, clean: Column, positive: Column, seed: int, folds: int = 5) -> DataFrame:
    """``split`` by group: fold 0 test, 1 val, others train; groups with an unclean row train.

    Groups are stratified by whether they hold a positive row: inside a stratum the hash picks the fold.
    """
    g = df.groupBy(group).agg(F.min(clean.cast("int")).alias("_clean"), F.max(positive.cast("int")).alias("_pos"))
    fold = F.pmod(bucket(seed, F.concat_ws("|", F.col("_pos"), F.col(group).cast("string")), 1 << 30), F.lit(folds))
    split = F.when(F.col("_clean") != 1, "train").when(fold == 0, "test").when(fold == 1, "val").otherwise("train")
    return df.join(g.select(group, split.alias("split")), group)


def quota(df: DataFrame, bucket_col: str, plan: DataFrame, id_col: str, seed: int) -> DataFrame:
    """``plan(bucket, n)``: up to n rows of each bucket; missing ones as numbered placeholders."""
    w = Window.partitionBy(bucket_col).orderBy(order_key(seed, id_col), id_col)
    ranked = df.select(F.col(bucket_col).alias("bucket"), F.col(id_col).cast("string").alias("id"), F.row_number().over(w).alias("slot"))
    most = plan.agg(F.coalesce(F.max("n"), F.lit(0)).alias("n")).first()["n"]  # one row; a hot bucket is cut to it before the sort
    ranked = ranked.where(F.col("slot") <= most)
    slots = plan.select("bucket", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("slot"))
    slug = F.lower(F.replace("bucket", F.lit(" "), F.lit("-")))
    out = slots.join(ranked, ["bucket", "slot"], "left")
    return out.select("bucket", "slot", F.coalesce("id", F.concat(F.lit("SOURCE-"), slug, F.lit("-"), F.lpad(F.col("slot").cast("string"), 2, "0"))).alias("id"), F.col("id").isNull().cast("int").alias("needs_sourcing"))


def uniform(seed: int, key: Column) -> Column:
    """A number in (0, 1) for each key, that any engine can compute."""
    return (bucket(seed, key, 1 << 24) + F.lit(0.5)) / F.lit(float(1 << 24))


def length_batches(df: DataFrame, id_col: str, text: str, size: int) -> DataFrame:
    """``(id, batch)``: texts in order of falling length (ties by id) cut into batches of ``size``.

    Ranks are sums over the counts per length plus the rank within one length, so no task sorts all rows.
    """
    d = df.where(F.col(text).isNotNull()).select(id_col, F.length(text).alias("_l"))
    before = running(d.groupBy(F.col("_l").alias("s")).agg(F.count(F.lit(1)).alias("n")), ["n"], descending=True).select(F.col("s").alias("_l"), (F.col("cum_n") - F.col("n")).alias("_b"))
    inside = F.row_number().over(Window.partitionBy("_l").orderBy(id_col))
    return d.withColumn("_i", inside).join(before, "_l").select(id_col, F.floor((F.col("_b") + F.col("_i") - 1) / size).alias("batch"))

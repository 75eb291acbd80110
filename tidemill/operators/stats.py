"""Descriptive and two-sample statistics."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .metrics import running


def percentiles(df: DataFrame, x: str, points: list[float], *by: str) -> DataFrame:
    """``(*by, q)``: exact percentiles by linear interpolation, as an array.

    Values are counted, the counts summed up over quantile ranges, and the two order statistics around
    each point picked, so no task holds a group's values.  Groups of ``by`` are few.
    """
    keys = list(by)
    v = df.where(F.col(x).isNotNull()).groupBy(*keys, F.col(x).cast("double").alias("_x")).agg(F.count(F.lit(1)).alias("_n"))
    cuts = v.groupBy(*keys).agg(F.percentile_approx("_x", F.array(*[F.lit(i / 64) for i in range(1, 64)]), 1024).alias("_cuts"), F.sum("_n").alias("_total"))
    v = joined(v, cuts, keys).withColumn("_r", F.array_position(F.array_sort(F.array_append("_cuts", F.col("_x"))), F.col("_x")))
    per = v.groupBy(*keys, "_r").agg(F.sum("_n").alias("_m"))
    before = F.coalesce(F.sum("_m").over(Window.partitionBy(*keys).orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    v = v.join(per.select(*keys, "_r", before.alias("_b")), [*keys, "_r"]) if keys else v.join(F.broadcast(per.select("_r", before.alias("_b"))), "_r")
    inside = F.sum("_n").over(Window.partitionBy(*keys, "_r").orderBy("_x").rowsBetween(Window.unboundedPreceding, 0))
    v = v.withColumn("_end", F.col("_b") + inside)  # values up to and including this one
    picks = []
    for i, q in enumerate(points):
        at = F.lit(q) * (F.col("_total") - 1)
        holds = lambda k: (F.col("_end") > k) & (F.col("_end") - F.col("_n") <= k)
        low, high = F.max(F.when(holds(F.floor(at)), F.col("_x"))), F.max(F.when(holds(F.ceil(at)), F.col("_x")))
        share = F.max(at - F.floor(at))
        picks.append((low + (high - low) * share).alias(f"_q{i}"))
    out = v.groupBy(*keys).agg(*picks)
    return out.select(*keys, F.array(*[f"_q{i}" for i in range(len(points))]).alias("q"))


def joined(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """``right`` joined on keys, or its one row attached where there are none."""
    return left.join(right, keys) if keys else left.crossJoin(F.broadcast(right))


def quartiles(df: DataFrame, x: str, *by: str) -> DataFrame:
    """Exact quartiles (linear interpolation)."""
    q = percentiles(df, x, [0.25, 0.5, 0.75], *by)
    return q.select(*by, *[F.round(F.col("q")[i], 4).alias(n) for i, n in enumerate(("q1", "median", "q3"))])


def cohens_d(df: DataFrame, x: str, group: str) -> DataFrame:
    """Absolute standardised difference of means between group 1 and group 0."""
    s = lambda g, f: f(F.when(F.col(group) == g, F.col(x)))
    a = df.agg(s(0, F.avg).alias("m0"), s(1, F.avg).alias("m1"), s(0, F.var_samp).alias("v0"), s(1, F.var_samp).alias("v1"), s(0, F.count).alias("n0"), s(1, F.count).alias("n1"))
    pooled = F.sqrt(F.try_divide((F.col("n0") - 1) * F.col("v0") + (F.col("n1") - 1) * F.col("v1"), (F.col("n0") + F.col("n1") - 2).cast("double")))
    return a.select("n0", "n1", F.round(F.abs(F.try_divide(F.col("m1") - F.col("m0"), pooled)), 4).alias("d"))


def mann_whitney(df: DataFrame, x: str, group: str) -> DataFrame:
    """U of group 1 and its two-sided p by the normal approximation with tie and continuity correction."""
    g = df.where(F.col(x).isNotNull()).groupBy(F.col(x).cast("double").alias("s")).agg(F.count(F.when(F.col(group) == 1, 1)).alias("a"), F.count(F.when(F.col(group) == 0, 1)).alias("b"))
    g = g.withColumn("t", F.col("a") + F.col("b"))
    r = running(g, ["t"])
    mean_rank = F.col("cum_t") - F.col("t") + (F.col("t") + 1) / 2.0
    s = r.agg(F.sum(F.col("a") * mean_rank).alias("w"), F.sum("a").alias("n1"), F.sum("b").alias("n0"), F.sum(F.col("t").cast("double") * F.col("t") * F.col("t") - F.col("t")).alias("ties"))
    u = F.col("w") - F.col("n1") * (F.col("n1") + 1) / 2.0
    n = F.col("n1") + F.col("n0")
    sigma = F.sqrt(F.col("n1") * F.col("n0") / 12.0 * (n + 1 - F.try_divide(F.col("ties"), (n * (n - 1)).cast("double"))))
    z = F.try_divide(F.abs(u - F.col("n1") * F.col("n0") / 2.0) - 0.5, sigma)

    @F.pandas_udf("double")
    def tail(v):
        return v.map(lambda q: math.erfc(max(0.0, q) / math.sqrt(2)), na_action="ignore")

    return s.select("n1", "n0", u.alias("u"), F.round(z, 6).alias("z"), F.round(tail(z), 6).alias("p"))


def chi_square(df: DataFrame, a: str, b: str) -> DataFrame:
    """Independence statistic without continuity correction, and the degrees of freedom."""
    t = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).count()
    ra = t.groupBy(a).agg(F.sum("count").alias("ra"))
    cb = t.groupBy(b).agg(F.sum("count").alias("cb"))
    n = t.agg(F.sum("count").alias("n"))
    # over all cells, empty ones too, sum (o - e)^2 / e = n * (sum o^2 / (row * column) - 1)
    o = t.join(ra, a).join(cb, b).agg(F.sum(F.col("count").cast("double") * F.col("count") / (F.col("ra").cast("double") * F.col("cb"))).alias("s"))
    dof = ra.agg(F.count(F.lit(1)).alias("ka")).crossJoin(F.broadcast(cb.agg(F.count(F.lit(1)).alias("kb"))))  # one row each
    one = o.crossJoin(F.broadcast(n)).crossJoin(F.broadcast(dof))
    return one.select(F.round(F.col("n") * (F.col("s") - 1), 4).alias("chi2"), ((F.col("ka") - 1) * (F.col("kb") - 1)).alias("dof"))


def digitised(df: DataFrame, x: str, out: str) -> DataFrame:
    """``out``: the quartile bin of x (1..4; a value on an edge falls below it, the minimum into 0)."""
    e = percentiles(df, x, [0.0, 0.25, 0.5, 0.75]).withColumnRenamed("q", "_e")
    d = df.crossJoin(F.broadcast(e))  # one row
    return d.withColumn(out, sum(((F.col(x) > F.col("_e")[i]).cast("int") for i in range(1, 4)), (F.col(x) > F.col("_e")[0]).cast("int"))).drop("_e")


def mode(df: DataFrame, x: str, *by: str) -> DataFrame:
    """The most frequent value; the lowest on ties."""
    c = df.where(F.col(x).isNotNull()).groupBy(*by, x).count()
    return c.groupBy(*by).agg(F.min_by(x, F.struct(-F.col("count"), F.col(x))).alias("mode"))


def mean_abs_by_dimension(df: DataFrame, vector: str) -> DataFrame:
    return df.select(F.posexplode(vector).alias("dim", "v")).groupBy("dim").agg(F.round(F.avg(F.abs(F.col("v").cast("double"))), 6).alias("mean_abs"))

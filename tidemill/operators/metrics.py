"""Exact ranking and per-class metrics from counts per distinct score."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Ranges over which cumulative counts are split.
RANGES = 256


def score_groups(df: DataFrame, y: str, score: str) -> DataFrame:
    """``(s, pos, neg)`` per distinct score; rows without score or label are left out."""
    d = df.where(F.col(score).isNotNull() & F.col(y).isNotNull())
    return d.groupBy(F.col(score).cast("double").alias("s")).agg(F.count(F.when(F.col(y) == 1, 1)).alias("pos"), F.count(F.when(F.col(y) != 1, 1)).alias("neg"))


def running(groups: DataFrame, cols: list[str], order: str = "s", descending: bool = False) -> DataFrame:
    """``groups`` with ``cum_<col>``: sums over all groups up to and including this one.

    Two levels: inside ranges that hold about the same number of groups wherever the values lie (cut at
    approximate quantiles), and over the at most RANGES range sums, so no task sees all groups.
    """
    cuts = groups.agg(F.percentile_approx(order, F.array(*[F.lit(i / RANGES) for i in range(1, RANGES)]), RANGES * 4).alias("_cuts"))
    g = groups.crossJoin(F.broadcast(cuts))  # one row of at most RANGES numbers
    # the range of a value is the number of cuts up to it: a sorted array is searched by halves
    place = F.call_function("array_position", F.array_sort(F.array_append("_cuts", F.col(order))), F.col(order)) - 1
    g = g.withColumn("_r", F.coalesce(place, F.lit(0)).cast("long") * (-1 if descending else 1)).drop("_cuts")
    sums = g.groupBy("_r").agg(*[F.sum(c).alias(f"_t_{c}") for c in cols])
    before = Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("_r", *[F.coalesce(F.sum(f"_t_{c}").over(before), F.lit(0)).alias(f"_b_{c}") for c in cols])
    key = F.desc(order) if descending else F.asc(order)
    inside = Window.partitionBy("_r").orderBy(key).rowsBetween(Window.unboundedPreceding, 0)
    g = g.withColumns({f"_i_{c}": F.sum(c).over(inside) for c in cols}).join(F.broadcast(sums), "_r")  # at most RANGES rows
    return g.withColumns({f"cum_{c}": F.col(f"_b_{c}") + F.col(f"_i_{c}") for c in cols}).drop("_r", *[f"_{k}_{c}" for c in cols for k in "bi"])


def auc(df: DataFrame, y: str, score: str) -> DataFrame:
    """ROC area with ties averaged; null without both classes."""
    r = running(score_groups(df, y, score), ["pos", "neg"])
    area = F.sum(F.col("pos") * (F.col("cum_neg") - F.col("neg") + F.col("neg") / 2.0))
    return r.agg(F.try_divide(area, (F.sum("pos") * F.sum("neg")).cast("double")).alias("auc"), F.sum("pos").alias("positives"), F.sum("neg").alias("negatives"))


def average_precision(df: DataFrame, y: str, score: str) -> DataFrame:
    r = running(score_groups(df, y, score), ["pos", "neg"], descending=True)
    return r.agg(F.try_divide(F.sum(F.col("pos") * (F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg")))), F.sum("pos").cast("double")).alias("ap"))


def at_threshold(df: DataFrame, y: str, score: str, threshold: float) -> DataFrame:
    """``auc`` and ``average_precision``, and the ``confusion`` of ``score >= threshold``, from one set of running sums."""
    r = running(score_groups(df, y, score), ["pos", "neg"], descending=True)
    n = lambda c, over: F.coalesce(F.sum(F.when((F.col("s") >= threshold) == over, F.col(c))), F.lit(0))
    pairs = (F.sum("pos") * F.sum("neg")).cast("double")
    lost = F.sum(F.col("pos") * (F.col("cum_neg") - F.col("neg") / 2.0))  # pairs whose negative is not below its positive, ties by half
    ap = F.try_divide(F.sum(F.col("pos") * (F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg")))), F.sum("pos").cast("double"))
    counts = [n("pos", True).alias("tp"), n("neg", True).alias("fp"), n("neg", False).alias("tn"), n("pos", False).alias("fn")]
    return r.agg(F.try_divide(pairs - lost, pairs).alias("auc"), ap.alias("ap"), *counts)


def confusion(df: DataFrame, y: str, flag: Column) -> DataFrame:
    n = lambda c: F.count(F.when(c, 1))
    return df.agg(n((F.col(y) == 1) & flag).alias("tp"), n((F.col(y) != 1) & flag).alias("fp"), n((F.col(y) != 1) & ~flag).alias("tn"), n((F.col(y) == 1) & ~flag).alias("fn"))


def rates(c: DataFrame) -> DataFrame:
    """Accuracy, precision, recall, specificity; an empty denominator counts as 1."""
    div = lambda a, b: F.round(a / F.greatest(b, F.lit(1)), 6)
    tp, fp, tn, fn = (F.col(x) for x in ("tp", "fp", "tn", "fn"))
    return c.withColumns({"accuracy": div(tp + tn, tp + fp + tn + fn), "precision": div(tp, tp + fp), "recall": div(tp, tp + fn), "specificity": div(tn, tn + fp)})


def recall_threshold(df: DataFrame, y: str, score: str, least: float) -> DataFrame:
    """The highest threshold that keeps the recall: an order statistic of the positives; 0.5 without any."""
    r = running(score_groups(df, y, score).where("pos > 0"), ["pos"])
    n = r.agg(F.coalesce(F.max("cum_pos"), F.lit(0)).alias("n"))
    k = F.least(F.greatest(F.floor(F.lit(1 - least) * F.col("n")), F.lit(0)), F.col("n") - 1)
    out = r.crossJoin(F.broadcast(n)).where(F.col("cum_pos") > k).agg(F.min("s").alias("t"))
    return out.select(F.coalesce("t", F.lit(0.5)).alias("threshold"))


def sweep(df: DataFrame, y: str, score: str, grid: DataFrame, point: str = "t") -> DataFrame:
    """Confusion counts (``score >= t``) at every grid point without joining points to rows: the points
    enter the score groups with zero counts and read the running sums."""
    g = score_groups(df, y, score).withColumn("is_point", F.lit(0))
    p = grid.select(F.col(point).cast("double").alias("s"), F.lit(0).cast("long").alias("pos"), F.lit(0).cast("long").alias("neg"), F.lit(1).alias("is_point"))
    both = g.union(p).groupBy("s").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), F.max("is_point").alias("is_point"))
    r = running(both, ["pos", "neg"], descending=True)
    total = both.agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    out = r.where("is_point = 1").crossJoin(F.broadcast(total))
    return out.select(F.col("s").alias("threshold"), F.col("cum_pos").alias("tp"), F.col("cum_neg").alias("fp"), (F.col("n") - F.col("cum_neg")).alias("tn"), (F.col("p") - F.col("cum_pos")).alias("fn"))


def best_points(curve: DataFrame, targets: list[float]) -> DataFrame:
    """Per target recall the lowest threshold of maximal specificity (ties) among points that reach it."""
    t = curve.sparkSession.createDataFrame([(x,) for x in targets], "target double")
    c = rates(curve)
    return c.join(F.broadcast(t), F.col("recall") >= F.col("target")).groupBy("target").agg(F.min_by(F.struct("threshold", "recall", "specificity"), F.struct(-F.col("specificity"), "threshold")).alias("b")).select("target", "b.*")


def per_class(df: DataFrame, truth: str, pred: str) -> DataFrame:
    """One-vs-rest counts and precision, recall, F1 (4 places, 0 where undefined) of every class seen."""
    pairs = df.groupBy(F.col(truth).alias("t"), F.col(pred).alias("p")).count()
    side = pairs.select(F.explode(F.array(F.struct(F.col("t").alias("class"), F.col("count").alias("n_true"), F.lit(0).cast("long").alias("n_pred"), F.when(F.col("t") == F.col("p"), F.col("count")).otherwise(0).alias("tp")), F.struct(F.col("p").alias("class"), F.lit(0).cast("long").alias("n_true"), F.col("count").alias("n_pred"), F.lit(0).cast("long").alias("tp")))).alias("x")).select("x.*")
    c = side.where("class is not null").groupBy("class").agg(F.sum("n_true").alias("n_true"), F.sum("n_pred").alias("n_pred"), F.sum("tp").alias("tp"))
    ratio = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b)), F.lit(0.0))
    c = c.withColumns({"_p": ratio("tp", "n_pred"), "_r": ratio("tp", "n_true")})
    c = c.withColumn("_f", F.coalesce(F.try_divide(2 * F.col("_p") * F.col("_r"), F.col("_p") + F.col("_r")), F.lit(0.0)))
    return c.select("class", "n_true", "n_pred", "tp", (F.col("n_pred") - F.col("tp")).alias("fp"), (F.col("n_true") - F.col("tp")).alias("fn"), F.round("_p", 4).alias("precision"), F.round("_r", 4).alias("recall"), F.round("_f", 4).alias("f1"))


def averages(classes: DataFrame) -> DataFrame:
    """Macro and support-weighted averages; counts are totals over the classes, each counted once."""
    t = [F.sum(c).alias(c) for c in ("n_true", "n_pred", "tp", "fp", "fn")]
    macro = classes.agg(F.lit("MACRO").alias("class"), *t, *[F.round(F.avg(c), 4).alias(c) for c in ("precision", "recall", "f1")])
    weighted = classes.agg(F.lit("WEIGHTED").alias("class"), *t, *[F.round(F.try_divide(F.sum(F.col(c) * F.col("n_true")), F.sum("n_true").cast("double")), 4).alias(c) for c in ("precision", "recall", "f1")])
    return macro.unionByName(weighted)


def poisson_weight(u: Column, most: int = 8) -> Column:
    """The Poisson(1) weight of a uniform number in (0, 1): how often a row is drawn with replacement."""
    cut, p, acc = [], 0.36787944117144233, 0.0
    for k in range(most):
        acc += p
        cut.append(acc)
        p /= k + 1
    return sum(((u > c).cast("int") for c in cut[1:]), (u > cut[0]).cast("int"))


def bootstrap(df: DataFrame, y: str, score: str, threshold: float, rounds: int = 1000, seed: int = 200) -> DataFrame:
    """2.5 and 97.5 % percentiles of the recall over resamples of Poisson(1) weights.

    The weights of n rows sum to a Poisson(n) number, so a resample needs the counts of hits and misses
    only: rows are counted once, and each round draws its two sums.
    """
    hit = F.col(score) >= threshold
    counts = df.where(F.col(y) == 1).agg(F.count(F.when(hit, 1)).alias("hits"), F.count(F.when(~hit, 1)).alias("misses"))

    @F.pandas_udf("long")
    def drawn(n: pd.Series, b: pd.Series, which: pd.Series) -> pd.Series:
        return pd.Series([int(np.random.default_rng((seed, int(r), int(w))).poisson(int(m))) for m, r, w in zip(n, b, which)])

    each = counts.select("hits", "misses", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))).alias("b"))
    each = each.select(drawn("hits", "b", F.lit(0)).alias("tp"), drawn("misses", "b", F.lit(1)).alias("fn"))
    q = each.where("tp + fn > 0").select((F.col("tp") / (F.col("tp") + F.col("fn"))).alias("recall"))
    return q.agg(F.percentile("recall", F.array(F.lit(0.025), F.lit(0.975))).alias("p")).select(F.col("p")[0].alias("recall_lo"), F.col("p")[1].alias("recall_hi"))


def paired(df: DataFrame, truth: str, a: str, b: str, name_a: str, name_b: str) -> DataFrame:
    """Two columns judged by a third over identical rows: how often each is right, and right alone."""
    n = lambda c: F.count(F.when(c, 1))
    right_a, right_b = F.col(a) == F.col(truth), F.col(b) == F.col(truth)
    return df.agg(F.count(F.lit(1)).alias("n"), n(right_a).alias(f"{name_a}_right"), n(right_b).alias(f"{name_b}_right"), n(right_a & ~right_b).alias(f"{name_a}_only"), n(right_b & ~right_a).alias(f"{name_b}_only"))

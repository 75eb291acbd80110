"""Model arms: features, TF-IDF and embeddings into classifiers, thresholds and scores."""

from __future__ import annotations

import json
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA, CountVectorizerModel, ElementwiseProduct, Normalizer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..operators import metrics
from ..session import scratch


def balanced_weights(df: DataFrame, label: str) -> DataFrame:
    """``weight`` = n / (classes * n of the class); the classes, a few, are broadcast, so no row moves to its class."""
    c = df.groupBy(label).agg(F.count(F.lit(1)).alias("_c"))
    t = c.agg(F.sum("_c").alias("_n"), F.count(F.lit(1)).alias("_k"))
    return df.join(F.broadcast(c.crossJoin(F.broadcast(t)).select(label, (F.col("_n") / (F.col("_k") * F.col("_c"))).alias("weight"))), label)


def unaccented(s: Column) -> Column:
    """Lower case without accents, for vocabulary building; plain ASCII does not pass through Python."""
    import unicodedata

    @F.pandas_udf("string")
    def strip(x: pd.Series) -> pd.Series:
        return x.map(lambda t: "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c)).lower(), na_action="ignore")

    plain = F.length(s) == F.octet_length(s)
    return F.coalesce(strip(F.when(~plain, s)), F.lower(s))


def tokens(text: Column) -> Column:
    """Unaccented words of two characters and more, in lower case."""
    return F.regexp_extract_all(unaccented(text), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0))


def grams(words: str) -> Column:
    """1- and 2-grams of a column of words."""
    rest = F.greatest(F.size(words) - 1, F.lit(0))
    return F.concat(words, F.zip_with(F.slice(words, 1, rest), F.slice(words, 2, rest), lambda a, b: F.concat_ws(" ", a, b)))


def vocabulary(df: DataFrame, words: str, size: int = 5000, min_df: int = 3) -> DataFrame:
    """``(term, docs)``: of the grams in at least ``min_df`` rows the ``size`` most frequent (ties by term), and the rows they are in.

    A row's grams are sorted, so that the first of equal ones counts the row: grams and rows are counted in one aggregation.
    """
    g = df.select(F.sort_array(grams(words)).alias("term")).select("term", F.concat(F.array(F.lit(None).cast("string")), "term").alias("before"))
    each = g.select(F.inline(F.arrays_zip("term", "before"))).where("term is not null")
    counts = each.groupBy("term").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(~F.col("term").eqNullSafe(F.col("before")), 1)).alias("docs"))
    return counts.where(F.col("docs") >= min_df).orderBy(F.desc("n"), "term").limit(size).select("term", "docs")


def tfidf_fit(train: DataFrame, words: str = "words", **more) -> Callable[[DataFrame], DataFrame]:
    """Sublinear counts (1 + ln), smoothed idf + 1, unit length: fitted on training rows only; the result
    adds ``tfidf`` to a table.  MLlib has no sublinear counts: the counts are written as the vectors' stored
    form and read back as vectors, so whatever follows reads the table instead of making the grams again."""
    terms = vocabulary(train, words, **more).collect()  # at most ``size`` rows
    n = train.count()
    counter = CountVectorizerModel.from_vocabulary([t.term for t in terms], inputCol="_grams", outputCol="_counts")
    scale = ElementwiseProduct(scalingVec=Vectors.dense(np.log((n + 1.0) / (np.array([t.docs for t in terms]) + 1.0)) + 1.0), inputCol="_logs", outputCol="_scaled")
    unit = Normalizer(p=2.0, inputCol="_scaled", outputCol="tfidf")

    def weigh(df: DataFrame) -> DataFrame:
        v = counter.transform(df.withColumn("_grams", grams(words))).withColumn("_v", F.unwrap_udt("_counts"))
        logs = F.struct("_v.type", "_v.size", "_v.indices", F.transform("_v.values", lambda x: F.lit(1.0) + F.log(x)).alias("values"))
        kept = StructType([f for f in df.schema if f.name != words])
        path = scratch(df.sparkSession, "tfidf")
        v.select(*kept.names, logs.alias("_logs")).write.parquet(path)
        logs = df.sparkSession.read.schema(StructType([*kept, StructField("_logs", VectorUDT())])).parquet(path)
        return unit.transform(scale.transform(logs)).drop("_logs", "_scaled")

    return weigh


def arm_metrics(arm: str, fitted: DataFrame, held_out: DataFrame, y: str, score: str, recall: float = 0.95) -> DataFrame:
    """One row of the result table: the threshold that keeps ``recall`` on the rows the arm was fitted on,
    and area, average precision, confusion and rates of the held-out rows under it."""
    t = metrics.recall_threshold(fitted, y, score, recall).first()["threshold"]  # one row
    c = metrics.rates(metrics.at_threshold(held_out, y, score, t)).withColumn("threshold", F.lit(t))
    return c.select(F.lit(arm).alias("arm"), *[F.col(x) for x in ("auc", "ap", "recall", "specificity", "precision", "fp", "fn", "threshold")])


def save(model, path: str, manifest: str) -> None:
    """A fitted model and its manifest (feature order, threshold, classes) beside it."""
    model.write().save(f"{path}/model")
    spark = SparkSession.getActiveSession()
    spark.createDataFrame([(manifest,)], "value string").coalesce(1).write.text(f"{path}/manifest")


def load(spark: SparkSession, path: str) -> tuple:
    """The model and its manifest; the model's class is read from its own metadata."""
    from pyspark.ml.util import DefaultParamsReader

    return DefaultParamsReader.loadParamsInstance(f"{path}/model", spark.sparkContext), json.loads("".join(r[0] for r in spark.read.text(f"{path}/manifest").collect()))  # one line


def importances(model, names: list[str], spark: SparkSession) -> DataFrame:
    """``(feature, importance)`` of a tree model, one row per feature."""
    return spark.createDataFrame([(n, float(x)) for n, x in zip(names, model.featureImportances.toArray())], "feature string, importance double")


def choice(reply: Column, choices: list[str], fallback: str) -> Column:
    """The offered choice a reply names by its letter (``B)``, ``(c)``, ``it is A.``), or the fallback."""
    letters = "".join(chr(97 + i) for i in range(len(choices)))
    letter = F.upper(F.regexp_extract(reply, rf"(?i)(?:^|[^\p{{L}}\p{{N}}])([{letters}])(?:[).:]|$)", 1))
    out = F.lit(fallback)
    for i, c in enumerate(choices):
        out = F.when(letter == chr(65 + i), c).otherwise(out)
    return out


def constrained(prompts: DataFrame, scorer: Callable[[list[str], list[str]], "np.ndarray"], choices: list[str], prompt: str = "prompt") -> DataFrame:
    """``prompts`` with the best ``choice`` and its ``share``: ``scorer`` gives one score per prompt and choice
    (log probabilities of a language model, say); it is called once per Arrow batch."""

    @F.pandas_udf("choice string, share double")
    def run(s: pd.Series) -> pd.DataFrame:
        x = np.asarray(scorer(s.fillna("").tolist(), choices), float)
        e = np.exp(x - x.max(axis=1, keepdims=True))
        p, k = e / e.sum(axis=1, keepdims=True), x.argmax(axis=1)
        return pd.DataFrame({"choice": [choices[i] for i in k], "share": p[np.arange(len(k)), k]})

    return prompts.withColumn("_c", run(prompt)).select("*", "_c.choice", "_c.share").drop("_c")


def probability(model, df: DataFrame, out: str = "prob") -> DataFrame:
    return model.transform(df).withColumn(out, vector_to_array("probability")[1])


def assemble(df: DataFrame, cols: list[str], out: str = "features") -> DataFrame:
    """A vector by column name, in the given order; a missing column raises."""
    return VectorAssembler(inputCols=cols, outputCol=out, handleInvalid="keep").transform(df)


def head(train: DataFrame, features: str = "features", label: str = "y", c: float = 1.0):
    """Multinomial logistic regression with balanced classes; ``c`` is the inverse regularisation."""
    n = train.count()
    lr = LogisticRegression(featuresCol=features, labelCol=label, weightCol="weight", family="multinomial", regParam=1.0 / (c * max(1, n)), standardization=False, maxIter=200)
    return lr.fit(balanced_weights(train, label))


def boosted(train: DataFrame, features: str = "features", label: str = "y", trees: int = 20, depth: int = 4):
    return GBTClassifier(featuresCol=features, labelCol=label, maxIter=trees, maxDepth=depth, seed=200).fit(train)


def perceptron(train: DataFrame, layers: list[int], features: str = "features", label: str = "y"):
    return MultilayerPerceptronClassifier(featuresCol=features, labelCol=label, layers=layers, maxIter=60, seed=200).fit(train)


def usable_classes(df: DataFrame, label: str, excluded: list[str], least: int = 10) -> DataFrame:
    """Rows whose class is not excluded and has at least ``least`` rows after the exclusion."""
    d = df.where(F.col(label).isNotNull() & ~F.col(label).isin(excluded))
    return d.join(d.groupBy(label).count().where(F.col("count") >= least).select(label), label, "left_semi")


def clusters(df: DataFrame, vector: str, ks: list[int], dims: int = 8) -> DataFrame:
    """Silhouette of k-means over principal components, per k (the distributed analogue of density clustering)."""
    d = df.withColumn("_v", array_to_vector(F.col(vector).cast("array<double>")))
    p = PCA(k=dims, inputCol="_v", outputCol="features").fit(d).transform(d).select("features").cache()
    rows = []
    for k in ks:
        m = KMeans(k=k, seed=200).fit(p)
        rows.append((k, round(float(ClusteringEvaluator().evaluate(m.transform(p))), 4)))
    p.unpersist()
    return df.sparkSession.createDataFrame(rows, "k int, silhouette double")


def verdict(prob: Column, threshold: float, type_: Column, type_prob: Column, floor: float = 0.35) -> Column:
    """The record of one scored message: the flag (inclusive threshold), its type where flagged and
    confident, a false alarm where the type says so."""
    flagged = prob >= threshold
    alarm = flagged & (type_ == "not a scam")
    named = F.when(flagged & (type_ != "not a scam") & (type_prob >= floor), type_)
    return F.struct(flagged.alias("scam"), F.round(prob, 6).alias("prob"), named.alias("type"), F.coalesce(alarm, F.lit(False)).alias("false_alarm"))

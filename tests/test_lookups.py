"""Lookups, batches, percentiles, choices, saved models and the build's order and types."""

import collections
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemill.operators import corpus, joins, metrics, sampling, stats
from tidemill.plans import models
from tidemill.session import scratch, shared_dir
from tidemill.sources import files


def test_lookups_with_nulls_ties_and_long_lists(spark):
    d = spark.createDataFrame([(1, "a", 5), (2, "a", 7), (3, None, 9), (4, "b", 1)], "id long, k string, v int")
    assert sorted(map(tuple, joins.last_by_key(d, "k", "v", "x").collect())) == [("a", 7), ("b", 1)]
    assert [tuple(r) for r in joins.unique_only(d, "k", "id", "x").collect()] == [("b", 4)]
    cells = spark.createDataFrame([(1, ["x", "y", "q", "b"]), (2, ["b", "q"]), (3, None), (4, [])], "id long, parts array<string>")
    dim = spark.createDataFrame([("q", 10), ("b", 20)], "name string, t int")
    assert sorted(map(tuple, joins.first_hit(cells, "id", F.col("parts"), dim, "name", "t").collect())) == [(1, 10), (2, 20)]
    fixes = spark.createDataFrame([(1, "z"), (2, "a")], "id long, fix string")
    assert sorted(map(tuple, joins.overlaid(d.drop("v"), fixes, "id", "k", "fix").collect())) == [(1, "z", 1), (2, "a", 0), (3, None, 0), (4, "b", 0)]
    grid = joins.cells(spark.range(2).toDF("a"), spark.range(3).toDF("b"))
    n = joins.counted_cells(grid, spark.createDataFrame([(1, 2, 5)], "a long, b long, n long"), ["a", "b"])
    assert n.count() == 6 and n.agg(F.sum("n")).first()[0] == 5


def test_percentiles_of_skewed_and_tied_values(spark):
    r = random.Random(4)
    rows = [("a", r.choice([0.0, 0.0, 1e-9, 1.0, 1e9]) * r.random()) for _ in range(999)] + [("b", 2.0)] * 7 + [("c", None)]
    d = spark.createDataFrame(rows, "g string, x double")
    points = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    for g, own in (("a", [x for k, x in rows if k == "a"]), ("b", [2.0])):
        got = {x.g: x.q for x in stats.percentiles(d, "x", points, "g").collect()}[g]
        assert got == pytest.approx(np.quantile(own, points).tolist())
    assert stats.percentiles(d.where("g = 'a'"), "x", [0.5]).first().q[0] == pytest.approx(np.median([x for k, x in rows if k == "a"]))


def test_batches_and_resample(spark):
    d = spark.createDataFrame([(i, "x" * (i % 5)) for i in range(23)] + [(99, None)], "id long, text string")
    got = collections.defaultdict(list)
    for r in sampling.length_batches(d, "id", "text", 4).collect():
        got[r.batch].append(r.id)
    order = sorted(range(23), key=lambda i: (-(i % 5), i))
    assert {b: sorted(v) for b, v in got.items()} == {b: sorted(order[4 * b : 4 * b + 4]) for b in range(6)}
    w = [r.w for r in spark.range(20_000).select(metrics.poisson_weight(sampling.uniform(3, F.col("id"))).alias("w")).collect()]
    assert abs(np.mean(w) - 1) < 0.03 and abs(np.var(w) - 1) < 0.05


def test_choices_and_pluggable_scorer(spark):
    replies = ["B) yes", "(c)", "it is A.", "banana", "", None]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(replies)], "id long, r string")
    assert [x.c for x in d.select("id", models.choice(F.col("r"), ["p", "q", "s"], "none").alias("c")).orderBy("id").collect()] == ["q", "s", "p", "none", "none", "none"]
    length = lambda prompts, choices: [[-abs(len(p) - len(c)) for c in choices] for p in prompts]
    out = models.constrained(d, length, ["", "xxxxxx"], "r").orderBy("id").collect()
    assert [x.choice for x in out] == ["xxxxxx", "", "xxxxxx", "xxxxxx", "", ""] and all(0.5 <= x.share <= 1 for x in out)


def test_saved_model_replays(spark):
    d = models.assemble(spark.createDataFrame([(float(i % 7), float(i % 3), int(i % 7 > 3)) for i in range(60)], "a double, b double, y int"), ["a", "b"])
    fit, path = models.head(d), scratch(spark, "model")
    models.save(fit, path, files.manifest(["a", "b"], 0.5, ["0", "1"]))
    again, manifest = models.load(spark, path)
    assert manifest["features"] == ["a", "b"] and [r.prob for r in models.probability(fit, d).collect()] == [r.prob for r in models.probability(again, d).collect()]


def test_build_keeps_load_order_fields_stated_links_and_types(spark):
    rank = spark.createDataFrame([("SmishTank", "l", 0, 0, 0), ("UCI SMS Spam Collection", "m", 2, 3, 0)], "source string, source_link string, label_priority int, field_priority int, leaky int")
    rows = [(1, "UCI SMS Spam Collection", "one", "ham", None, None, None, None), (2, "SmishTank", "two", None, None, "account alert", "Nobody, Acme-Co", 1), (3, "SmishTank", "ONE", None, None, "delivery", "x", None)]
    raw = spark.createDataFrame(rows, "row_id long, source string, text string, spam_label string, smishing_label string, category string, brand string, link int")
    out = {r.text: r for r in corpus.merged(raw, rank, stated_url=F.col("link"), brand_type={"acmeco": "bank alert"}).collect()}
    assert (out["two"].id, out["ONE"].id) == (1, 2)  # the first source is loaded first, whatever the row numbers
    assert (out["two"].has_url, out["ONE"].has_url) == (1, 0) and (out["two"].scam_type, out["ONE"].scam_type) == ("bank alert", "delivery and toll")
    assert out["ONE"].also_in == "UCI SMS Spam Collection" and out["ONE"].source_link == "l" and out["ONE"].dup_count == 2


def test_scan_skips_files_with_the_column_and_cluster_needs_a_folder(spark):
    path = scratch(spark, "scan")
    spark.range(3).withColumn("x", F.lit(1)).write.parquet(f"{path}/a")
    spark.range(2).select(F.lit(2).alias("x")).write.parquet(f"{path}/b")
    assert files.without_column(spark, [f"{path}/a", f"{path}/b"], "id").count() == 2
    assert files.without_column(spark, [f"{path}/a"], "id").count() == 0

    class Far:
        master = "spark://somewhere:7077"
        getConf = staticmethod(lambda: {})

    class Session:
        sparkContext = Far
        conf = type("C", (), {"get": staticmethod(lambda k, d=None: d)})

    with pytest.raises(ValueError):
        shared_dir(Session)

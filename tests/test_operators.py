"""Operators on hand-countable rows, ties, nulls and empty tables."""

import io
import math
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from tidemill.functions import text as T
from tidemill.operators import corpus, metrics, sampling, stats
from tidemill.operators.ids import first_seen_ids
from tidemill.plans import models
from tidemill.sources import archives, files
from tidemill.streaming import score as streaming

Y = [1, 1, 1, 1, 1, 0, 0, 0, 0, 0]
P = [0.9, 0.8, 0.7, 0.6, 0.2, 0.8, 0.7, 0.3, 0.1, 0.1]


@pytest.fixture(scope="module")
def ten(spark):
    return spark.createDataFrame([(i, y, p) for i, (y, p) in enumerate(zip(Y, P))], "id long, y int, p double")


def test_metrics_by_hand(ten):
    r = metrics.rates(metrics.confusion(ten, "y", F.col("p") >= 0.5)).first()
    assert (r.tp, r.fn, r.fp, r.tn) == (4, 1, 2, 3)
    assert (r.recall, r.specificity, r.precision) == (0.8, 0.6, round(4 / 6, 6))
    assert metrics.recall_threshold(ten, "y", "p", 0.95).first()[0] == 0.2
    assert metrics.recall_threshold(ten, "y", "p", 0.75).first()[0] == 0.6
    assert metrics.recall_threshold(ten.where("y = 0"), "y", "p", 0.95).first()[0] == 0.5


def test_auc_and_ap_brute_force(spark, ten):
    wins = sum((a > b) + (a == b) / 2 for a, ya in zip(P, Y) for b, yb in zip(P, Y) if ya == 1 and yb == 0)
    assert metrics.auc(ten, "y", "p").first()[0] == pytest.approx(wins / 25)
    ap = last = 0.0
    for t in sorted(set(P), reverse=True):
        tp = sum(y for y, p in zip(Y, P) if p >= t)
        n = sum(p >= t for p in P)
        ap, last = ap + (tp / 5 - last) * tp / n, tp / 5
    assert metrics.average_precision(ten, "y", "p").first()[0] == pytest.approx(ap)
    assert metrics.auc(ten.limit(0), "y", "p").first()[0] is None


def test_running_matches_plain_sums_with_skewed_values(spark):
    r = random.Random(1)
    rows = [(r.choice([0.0, 1e-9, 1.0, 1e6]) * r.random(), r.randint(0, 5)) for _ in range(500)]
    g = spark.createDataFrame(rows, "s double, n long").groupBy("s").agg(F.sum("n").alias("n"))
    for down in (False, True):
        got = {x.s: x.cum_n for x in metrics.running(g, ["n"], descending=down).collect()}
        for s, c in got.items():
            assert c == sum(n for v, n in rows if (v >= s if down else v <= s))


def test_sweep_and_best_points(spark, ten):
    curve = metrics.sweep(ten, "y", "p", spark.createDataFrame([(t / 10,) for t in range(11)], "t double"))
    for r in curve.collect():
        assert r.tp == sum(y == 1 and p >= r.threshold for y, p in zip(Y, P)) and r.fp == sum(y == 0 and p >= r.threshold for y, p in zip(Y, P))
    best = metrics.best_points(curve, [0.8]).first()
    assert best.threshold == pytest.approx(0.4) and best.specificity == 0.6  # 0.4, 0.5, 0.6 tie


def test_per_class_counts_not_doubled(spark):
    d = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("c", "a"), (None, "a")], "t string, p string")
    c = metrics.per_class(d, "t", "p")
    rows = {r["class"]: r for r in c.collect()}
    assert (rows["a"].tp, rows["a"].fp, rows["a"].fn) == (1, 2, 1) and rows["c"].f1 == 0
    w = {r["class"]: r for r in metrics.averages(c).collect()}
    assert w["WEIGHTED"].n_pred == w["MACRO"].n_pred == 5


def test_bootstrap_is_reproducible_and_covers(spark):
    d = spark.createDataFrame([(i, 1, 1.0 if i % 4 else 0.0) for i in range(400)], "id long, y int, s double")
    a, b = (metrics.bootstrap(d, "y", "s", 0.5, rounds=200).first() for _ in range(2))
    assert a == b and a[0] < 0.75 < a[1] and 0.05 < a[1] - a[0] < 0.13


def test_statistics(spark):
    d = spark.createDataFrame([(float(v), g) for v, g in zip([1, 2, 3, 10, 2, 5], [0, 0, 0, 0, 1, 1])], "x double, g int")
    assert stats.quartiles(d.where("g = 0"), "x", "g").first()[1:] == (1.75, 2.5, 4.75)
    m = stats.mann_whitney(d, "x", "g").first()
    assert m.u == 4.5 and 0 < m.p <= 1
    assert stats.mode(d, "x").first()[0] == 2.0
    t = spark.createDataFrame([(a, b) for a, b, n in (("x", 0, 10), ("x", 1, 20), ("y", 0, 30), ("y", 1, 40)) for _ in range(n)], "a string, b int")
    n, exp = 100, lambda r, c: r * c / 100
    chi = sum((o - e) ** 2 / e for o, e in ((10, exp(30, 40)), (20, exp(30, 60)), (30, exp(70, 40)), (40, exp(70, 60))))
    assert stats.chi_square(t, "a", "b").first()[:] == (round(chi, 4), 1) and n
    pooled = math.sqrt((3 * 16.666666 + 4.5) / 4)
    assert stats.cohens_d(d, "x", "g").first()[2] == pytest.approx(abs(3.5 - 4) / pooled, abs=1e-3)


def test_first_seen_ids(spark):
    seqs = random.Random(2).sample(range(10**6), 300)
    got = {r.s: r.id for r in first_seen_ids(spark.createDataFrame([(s,) for s in seqs], "s long"), "s", "id", width=1000).collect()}
    assert got == {s: i for i, s in enumerate(sorted(seqs), 1)}


RANK = [("SmishTank", "l", 0, 0, 0), ("Smishing_Dataset", "l", 4, 1, 1), ("NUS SMS Corpus", "l", 3, 4, 0), ("Mendeley SMS Phishing", "l", 1, 2, 0), ("UCI SMS Spam Collection", "l", 2, 3, 0)]


def _rows(spark, rows):
    full = [(i, *r, None, None, None) for i, r in enumerate(rows)]
    raw = spark.createDataFrame(full, "row_id long, source string, text string, spam_label string, smishing_label string, sender string, brand string, category string")
    return raw, spark.createDataFrame(RANK, "source string, source_link string, label_priority int, field_priority int, leaky int")


def test_label_decoding_and_survivorship(spark):
    raw, rank = _rows(spark, [
        ("Smishing_Dataset", "Hello  THERE", "0", "1"), ("mendeley sms phishing ", "hello there", "spam", None), ("NUS SMS Corpus", "other", None, None), ("Smishing_Dataset", "x", "Smishing", None),
        ("Smishing_Dataset", "y", "", "1"), ("Smishing_Dataset", "y2", "", ""), ("UCI SMS Spam Collection", "z", "maybe", None), ("Smishing_Dataset", "q", "2", "0"), ("SmishTank", "", "1", "1"), ("unknown", "k", "0", "0"),
    ])
    out = corpus.resolved(corpus.deduplicated(corpus.kept(corpus.normalised(raw, rank))))
    r = {x.key: x for x in out.collect()}
    assert set(r) == {"hello there", "other", "x", "y", "y2"}
    h = r["hello there"]  # label from the better source, text from the richer one, smishing from the worse source
    assert (h.spam, h.smish, h.text, h.dup_count, h.label_conflict, h.is_clean_label) == (1, 1, "Hello THERE", 2, 1, 1)
    assert (r["x"].label, r["y"].label, r["y2"].label, r["other"].label) == ("smishing", "smishing", "ham", "ham")
    assert r["x"].is_clean_label == 0


def test_dedupe_counts_sum_and_order_does_not_matter(spark):
    rows = [("UCI SMS Spam Collection", random.Random(i).choice(["a b", "A  b", "c", "d"]), "ham", None) for i in range(50)]
    raw, rank = _rows(spark, rows)
    one = corpus.deduplicated(corpus.kept(corpus.normalised(raw, rank)))
    two = corpus.deduplicated(corpus.kept(corpus.normalised(raw.orderBy(F.rand(1)), rank)))
    assert one.agg(F.sum("dup_count")).first()[0] == 50
    assert sorted(map(tuple, one.drop("srcs").collect())) == sorted(map(tuple, two.drop("srcs").collect()))
    assert corpus.merged(raw.limit(0), rank).count() == 0


def test_group_folds_invariants(spark):
    d = spark.createDataFrame([(i, i % 97, int(i % 11 != 0), i % 3) for i in range(1000)], "id long, g long, clean int, y int")
    s = sampling.group_folds(d, "g", F.col("clean") == 1, F.col("y") == 1, 1)
    assert s.groupBy("g").agg(F.countDistinct("split").alias("n")).where("n > 1").count() == 0
    assert s.where("clean = 0 and split <> 'train'").count() == 0


def test_quota_pads(spark):
    d = spark.createDataFrame([(1, "a"), (2, "a"), (3, "a")], "id long, b string")
    plan = spark.createDataFrame([("a", 2), ("no rows", 2)], "bucket string, n int")
    r = sampling.quota(d, "b", plan, "id", 1).orderBy("bucket", "slot").collect()
    assert [x.needs_sourcing for x in r] == [0, 0, 1, 1] and r[3].id == "SOURCE-no-rows-02"


def test_archives_and_decoding(spark):
    def pack(name, data):
        b = io.BytesIO()
        with zipfile.ZipFile(b, "w") as z:
            z.writestr(name, data)
        return b.getvalue()

    inner = pack("rows.csv", "naïve €".encode("cp1252"))
    d = spark.createDataFrame([("a", bytearray(pack("in.zip", inner))), ("b", bytearray(pack("else", b"x")))], "path string, content binary")
    out = archives.members(d, "in.zip", "rows.csv")
    assert [r[0] for r in out.select(archives.decode("content")).collect()] == ["naïve €"]
    e = spark.createDataFrame([(bytearray("ü".encode()),), (bytearray(b"\x81\xfc"),), (None,)], "content binary")
    assert [r[0] for r in e.select(archives.decode("content")).collect()] == ["ü", "\x81ü", None]


def test_csv_round_trip_keeps_everything(spark, tmp_path):
    values = ["a,b", 'say "x"', "line\nbreak", "  pad  ", "", None, "ü😀"]
    d = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, text string")
    files.write_csv(d, str(tmp_path / "c"), ["i", "text"])
    got = [r.text for r in files.read_csv(spark, str(tmp_path / "c"), "i int, text string").orderBy("i").collect()]
    assert got == [v or "" for v in values]


def test_json_union_typed_text(spark):
    j = '{"smsCorpus": {"message": [{"@id": 1, "text": {"$": "hi"}}, {"@id": 2, "text": 5}, {"@id": 3}]}}'
    d = spark.createDataFrame([(j,), ("{bad",), (None,)], "j string")
    assert [(r.id, r.text) for r in files.json_messages(d, "j").orderBy("id").collect()] == [("1", "hi"), ("2", "5"), ("3", None)]


def test_upsert_header_and_vectors(spark):
    t = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    assert sorted(map(tuple, files.upsert(t, spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string"), ["k"]).collect())) == [(1, "a"), (2, "c"), (3, "d")]
    assert files.aligned_vectors(t.select("k"), t.where("k = 1"), "k", "v") is None
    assert files.aligned_vectors(t.select("k"), t, "k", "v").count() == 2
    s = spark.createDataFrame([(1, ["Sheet"]), (2, ["id"]), (3, ["7"]), (4, ["id"])], "r int, values array<string>")
    assert [x.r for x in files.header_by_content(s, "r").orderBy("r").collect()] == [3, 4]


def test_models_and_verdict(spark):
    r = random.Random(4)
    d = spark.createDataFrame([(i, i % 2, r.gauss(i % 2 * 2, 1), r.random()) for i in range(300)], "id long, y int, a double, b double")
    v = models.assemble(d, ["a", "b"])
    assert metrics.auc(models.probability(models.head(v), v), "y", "prob").first()[0] > 0.85
    out = spark.createDataFrame([(0.5, "x", 0.9), (0.5, "not a scam", 0.9), (0.5, "x", 0.3), (0.4, "x", 0.9)], "p double, t string, q double")
    got = [tuple(x[0]) for x in out.select(models.verdict(F.col("p"), 0.5, F.col("t"), F.col("q"))).collect()]
    assert got == [(True, 0.5, "x", False), (True, 0.5, None, True), (True, 0.5, None, False), (False, 0.4, None, False)]


def test_at_threshold_equals_each_metric(spark, ten):
    for d in (ten, ten.where("y = 1"), ten.limit(0), ten.union(spark.createDataFrame([(10, None, 0.9), (11, 1, None)], ten.schema))):
        for t in (0.0, 0.7, 0.75, 2.0):
            got = metrics.at_threshold(d, "y", "p", t).first()
            assert got.auc == pytest.approx(metrics.auc(d, "y", "p").first()[0]) and got.ap == pytest.approx(metrics.average_precision(d, "y", "p").first()[0])
            assert (got.tp, got.fp, got.tn, got.fn) == tuple(metrics.confusion(d, "y", F.col("p") >= t).first())


def test_tfidf_by_hand(spark):
    """Against plain Python: accents, empty texts, repeated grams, grams in fewer rows than asked for."""
    texts = ["Ca\u0301f\u00e9 cafe CAFE win", "win a win b win", "cafe win", "", "x", "win cafe cafe", "\u4e2d\u6587 win_1 cafe"]
    words = [["cafe", "cafe", "cafe", "win"], ["win", "win", "win"], ["cafe", "win"], [], [], ["win", "cafe", "cafe"], ["\u4e2d\u6587", "win_1", "cafe"]]
    d = spark.createDataFrame(list(enumerate(texts)), "id int, text string").select("id", models.tokens(F.col("text")).alias("words"))
    assert [r.words for r in d.orderBy("id").collect()] == words
    each = [w + [f"{a} {b}" for a, b in zip(w, w[1:])] for w in words]
    total = {g: sum(e.count(g) for e in each) for e in each for g in e}
    docs = {g: sum(g in e for e in each) for g in total}
    terms = sorted((g for g in total if docs[g] >= 2), key=lambda g: (-total[g], g))
    assert terms == ["cafe", "win", "cafe cafe", "cafe win"]
    for size in (9, 3):
        terms = terms[:size]
        assert [tuple(r) for r in models.vocabulary(d, "words", size, 2).collect()] == [(g, docs[g]) for g in terms]
        out = {r.id: r.tfidf for r in models.tfidf_fit(d, size=size, min_df=2)(d).collect()}
        for i, e in enumerate(each):
            x = [(1 + math.log(e.count(g))) * (math.log((1 + len(each)) / (1 + docs[g])) + 1) if g in e else 0.0 for g in terms]
            norm = math.sqrt(sum(v * v for v in x)) or 1.0
            assert list(out[i].toArray()) == pytest.approx([v / norm for v in x])


def test_m2_makes_vectors_and_scores_once(spark, tmp_path):
    """The result reads the written scores: neither the messages nor Python are in its plan, and vectors are not made for each metric."""
    from tidemill import queries as core

    r = random.Random(5)
    rows = [(i, 0, f"{r.choice(['win cash', 'see you', 'cash prize'])} {'claim now' if i % 2 else 'at home'} {i % 7}7", i % 2) for i in range(200)] + [(1, 1, "win cash claim now 17", 1), (200, 0, None, 1), (201, 0, "no label", None)]
    spark.createDataFrame(rows, "id long, loaded_at int, text string, scam int").write.parquet(f"{tmp_path}/messages.parquet")
    out = core.QUERIES["m2_tfidf_arm"](spark, str(tmp_path))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "messages" not in plan and "EvalPython" not in plan and "UDF" not in plan
    got = out.first()
    assert got.arm == "tfidf" and got.auc > 0.95


def test_streaming_equals_batch_and_drops_late_templates(spark, tmp_path):
    d = spark.createDataFrame([(1, "free cash now 1", "2024-01-01 00:00:00"), (2, "free cash now 2", "2024-01-01 00:01:00"), (3, "hello", "2024-01-01 00:02:00")], "id long, text string, at string").withColumn("at", F.to_timestamp("at"))
    d.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(d.schema).parquet(str(tmp_path / "in"))
    streaming.run_once(streaming.first_of_template(streaming.scored(stream, 0.05), "at", "1 hour"), str(tmp_path / "out"), str(tmp_path / "check"))
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.count() == 2
    batch = {r.id: r.flagged for r in streaming.scored(d, 0.05).collect()}
    assert all(batch[r.id] == r.flagged for r in got.collect())


def test_type_by_category_then_brand(spark):
    d = spark.createDataFrame([("Delivery", None), ("Account Alert", "zzz / Acme-Co"), ("account alert", "zzz"), ("", "Acme Co"), (None, None), ("odd", None)], "c string, b string")
    got = [r[0] for r in d.select(corpus.typed(F.col("c"), F.col("b"), {"acmeco": "bank alert"})).collect()]
    assert got == ["delivery and toll", "bank alert", "other", "", "", "other"]
    assert T.slug_column("www.") == "kw_www"


def test_a5_every_keyword_with_its_labels(spark, tmp_path):
    from tidemill import queries as core
    from tidemill.vocabulary import KEYWORDS

    rows = [(1, 0, "Claim a PRIZE", "spam", 1), (2, 0, "prize", "smishing", 1), (3, 0, "won the prize", "ham", 0), (4, 0, "hi", "ham", 0), (4, 1, "hello", "ham", 0), (5, 0, None, "ham", 0)]
    spark.createDataFrame([(*r, "train", 1, 1, "s") for r in rows], "id long, loaded_at int, text string, label string, scam int, split string, dup_group long, is_clean_label int, source string").write.parquet(f"{tmp_path}/messages.parquet")
    got = {r.keyword: tuple(r)[1:] for r in core.QUERIES["a5_keyword_lift"](spark, str(tmp_path)).select("keyword", "n", "ham", "spam", "smishing", "hits", "lift").collect()}
    assert set(got) == set(KEYWORDS) and len(got) == 38
    assert got["prize"] == (3, 1, 1, 1, 2, 1.6667) and got["claim"] == (1, 0, 1, 0, 1, 2.5) and got["www."] == (0, 0, 0, 0, 0, None)


def test_j12_first_hit_beyond_the_second_part(spark, tmp_path):
    from tidemill import queries as core

    spark.createDataFrame([(1, "no, nor / CVS,Acme"), (2, "Acme/CVS"), (3, "a,b,c"), (4, None)], "report_id long, brand string").write.parquet(f"{tmp_path}/smishtank_reports.parquet")
    spark.createDataFrame([(7, "brand", "Acme"), (9, "brand", "CVS"), (5, "category", "nor")], "term_id long, kind string, name string").write.parquet(f"{tmp_path}/canon_terms.parquet")
    assert {tuple(r) for r in core.QUERIES["j12_first_hit_in_list"](spark, str(tmp_path)).collect()} == {(1, 9), (2, 7), (3, 0), (4, 0)}

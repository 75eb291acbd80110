"""Queries of the core operators over the driver's tables, and the SQL each is checked against.

Keys name the inventory entry they cover (``proj`` for projections).  Queries without SQL are archive
and file round trips, models and streams; their tests are in ``tests/``.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .functions import features as X
from .functions import text as T
from .functions.wordpiece import wordpiece
from .operators import corpus, joins, metrics, sampling, stats
from .operators.ids import first_seen_ids
from .plans import models
from .session import stage, table
from .sources import archives, files
from .streaming import score as streaming
from .vocabulary import CATEGORY_TYPE, FAMILIES, KEYWORDS, KNOWN_TLDS, LINK_TLDS, MISMATCH_BRANDS, SHORTENERS, SPACE, SUSPICIOUS_TLDS, TYPES, URL_PARTS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def add(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


# ---------------------------------------------------------------- shared inputs


def messages(spark: SparkSession, d: str, *cols: str) -> DataFrame:
    """Messages once each: the latest delivery."""
    m = table(spark, d, "messages").select("id", "loaded_at", *cols)
    return m.groupBy("id").agg(F.max(F.struct("loaded_at", *cols)).alias("m")).select("id", *[F.col(f"m.{c}").alias(c) for c in cols])


def raw(spark: SparkSession, d: str) -> DataFrame:
    return corpus.normalised(table(spark, d, "source_rows"), table(spark, d, "source_rank"))


def scored(spark: SparkSession, d: str) -> DataFrame:
    """Messages with a target and a score with many ties: the share of keywords present."""
    m = messages(spark, d, "text", "scam", "split", "dup_group", "is_clean_label", "source").where("scam is not null")
    return m.withColumn("y", F.col("scam")).withColumn("score", (X.keyword_score(F.col("text")) * 7 + F.length("text") % 5).cast("double"))


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


WORDS = r"[\p{L}\p{N}_]"
CLEAN = lambda c: rf"trim(regexp_replace(regexp_replace(coalesce({c}, ''), '[\x00-\x08\x0B\f\x0E-\x1F]', '', 'g'), '[{SPACE}]+', ' ', 'g'))"
KEY = lambda c: rf"trim(regexp_replace(lower({c}), '[{SPACE}]+', ' ', 'g'))"
HAS_URL = lambda c: rf"CAST(regexp_matches({c}, '(?i)(https?://|www\.|(^|[^\p{{L}}\p{{N}}_])[a-z0-9-]+\.({LINK_TLDS})([^\p{{L}}\p{{N}}_]|$))') AS INT)"
SCORE = "CAST(" + " + ".join(f"CAST(contains(lower(coalesce(text, '')), {q(k)}) AS INT)" for k in KEYWORDS) + " AS INT)"
ONCE = "m AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY loaded_at DESC) rn FROM messages) WHERE rn = 1)"
SCORED = f"{ONCE}, s AS (SELECT *, scam y, CAST({SCORE} * 7 + length(text) % 5 AS DOUBLE) score FROM m WHERE scam IS NOT NULL)"
RAW = rf"""k AS (SELECT s.*, lower(trim(s.source)) source_key, r.source proper, r.source_link, r.label_priority, r.field_priority, r.leaky, lower(trim(spam_label)) w, trim(smishing_label) mk,
  {CLEAN('text')} ctext FROM source_rows s JOIN source_rank r ON lower(trim(s.source)) = lower(trim(r.source))),
n AS (SELECT CAST(CASE source_key WHEN 'smishtank' THEN 0 WHEN 'smishing_dataset' THEN 1 WHEN 'nus sms corpus' THEN 2 WHEN 'mendeley sms phishing' THEN 3 WHEN 'uci sms spam collection' THEN 4 ELSE 5 END AS BIGINT) * 1000000000000 + row_id seq, proper source, source_key, ctext AS text, label_priority, field_priority, leaky, sender, brand, category, source_id, sender_type, source_link, strftime(received_at, '%Y-%m-%d') msg_date,
  CASE WHEN trim(coalesce(category, '')) = '' THEN '' ELSE 'other' END scam_type, {HAS_URL('ctext')} has_url,
  CASE WHEN source_key = 'smishtank' THEN 1 WHEN source_key = 'nus sms corpus' THEN 0
    WHEN source_key IN ('mendeley sms phishing','uci sms spam collection') THEN CASE w WHEN 'ham' THEN 0 WHEN 'spam' THEN 1 WHEN 'smishing' THEN 1 END
    WHEN w = 'smishing' THEN 1 WHEN coalesce(w, '') = '' THEN CASE WHEN mk = '1' THEN 1 END WHEN w IN ('0','1') THEN CAST(w AS INT) END spam,
  CASE WHEN source_key = 'smishtank' THEN 1 WHEN source_key = 'nus sms corpus' THEN 0
    WHEN source_key IN ('mendeley sms phishing','uci sms spam collection') THEN CASE w WHEN 'ham' THEN 0 WHEN 'smishing' THEN 1 END
    WHEN w = 'smishing' THEN 1 WHEN mk IN ('0','1') THEN CAST(mk AS INT) END smish,
  CASE WHEN source_key IN ('smishtank','nus sms corpus') THEN false WHEN source_key IN ('mendeley sms phishing','uci sms spam collection') THEN coalesce(w NOT IN ('ham','spam','smishing'), true)
    ELSE NOT (coalesce(w, '') IN ('', '0', '1', 'smishing')) END bad FROM k)"""
DEDUPED = rf"""{RAW}, kept AS (SELECT *, {KEY('text')} key FROM n WHERE length(text) > 0 AND NOT bad),
g AS (SELECT key, min(seq) first_seq, count(*) dup_count, arg_min(spam, label_priority * 1e14 + seq) FILTER (WHERE spam IS NOT NULL) spam, arg_min(smish, label_priority * 1e14 + seq) FILTER (WHERE smish IS NOT NULL) smish,
  arg_min(seq, field_priority * 1e14 + seq) fseq, list_sort(list(DISTINCT source)) srcs, CAST(min(leaky) = 0 AS INT) is_clean_label, CAST(coalesce(min(spam) <> max(spam), false) AS INT) label_conflict FROM kept GROUP BY key),
d AS (SELECT g.*, f.text, f.source, f.sender, f.brand, f.category, f.source_id, f.sender_type, f.source_link, f.msg_date, f.scam_type, f.has_url FROM g JOIN kept f ON f.seq = g.fseq)"""
RESOLVED = f"""{DEDUPED}, r0 AS (SELECT *, CASE WHEN spam = 0 AND smish = 1 THEN 1 WHEN spam = 1 AND smish IS NULL THEN 2 WHEN spam IS NULL THEN 3 ELSE 0 END rule, coalesce(smish, 0) sm FROM d),
r AS (SELECT *, CASE WHEN sm = 1 THEN 'smishing' WHEN CASE rule WHEN 1 THEN 1 WHEN 3 THEN sm ELSE spam END = 1 THEN 'spam' ELSE 'ham' END lab FROM r0)"""
_TEMPLATE = rf"regexp_replace(regexp_replace(regexp_replace(lower(text), '(https?://[^{SPACE}]+|www\.[^{SPACE}]+)', ' urltoken ', 'g'), '(^|[^\p{{L}}\p{{N}}_])[a-z0-9-]+\.[a-z]{{2,}}(/[^{SPACE}]*)?', '\1 urltoken ', 'g'), '\p{{Nd}}+', ' numtoken ', 'g')"
TEMPLATE = rf"(SELECT CASE WHEN trim(regexp_replace(z, '\b(urltoken|numtoken)\b', '', 'g')) = '' THEN '=' || {KEY('text')} ELSE z END FROM (SELECT trim(regexp_replace(regexp_replace({_TEMPLATE}, '[^a-z ]+', ' ', 'g'), ' +', ' ', 'g')) z))"

# ---------------------------------------------------------------- D: deduplication


@add("d1_exact_dedupe", f"WITH {DEDUPED} SELECT first_seq, dup_count, text, source FROM d")
def d1(spark, d):
    return corpus.deduplicated(corpus.kept(raw(spark, d))).select("first_seq", "dup_count", "text", "source")


@add("d2_label_survivorship", f"WITH {DEDUPED} SELECT first_seq, spam, smish FROM d")
def d2(spark, d):
    return corpus.deduplicated(corpus.kept(raw(spark, d))).select("first_seq", "spam", "smish")


_SURVIVORS = ["first_seq", "text", "source", "sender", "brand", "category", "source_id", "sender_type", "source_link", "msg_date", "scam_type", "has_url"]


@add("d3_field_survivorship", f"WITH {DEDUPED} SELECT {', '.join(_SURVIVORS)} FROM d")
def d3(spark, d):
    return corpus.deduplicated(corpus.kept(raw(spark, d))).select(*_SURVIVORS)


@add("d4_group_aggregates", f"WITH {DEDUPED} SELECT first_seq, dup_count, CAST(len(srcs) AS INT) n_sources, label_conflict FROM d")
def d4(spark, d):
    return corpus.deduplicated(corpus.kept(raw(spark, d))).select("first_seq", "dup_count", F.size("srcs").alias("n_sources"), "label_conflict")


@add("d5_label_rules", f"WITH {RESOLVED} SELECT first_seq, rule, lab AS label, CAST(lab = 'smishing' AS INT) smishing_label, CAST(lab = 'spam' AS INT) spam_label, CAST(lab <> 'ham' AS INT) scam FROM r")
def d5(spark, d):
    return corpus.resolved(corpus.deduplicated(corpus.kept(raw(spark, d)))).select("first_seq", "rule", "label", "smishing_label", "spam_label", "scam")


@add("d6_clean_label", f"WITH {DEDUPED} SELECT is_clean_label, count(*) n FROM d GROUP BY 1")
def d6(spark, d):
    return corpus.deduplicated(corpus.kept(raw(spark, d))).groupBy("is_clean_label").agg(F.count(F.lit(1)).alias("n"))


@add("d7_label_conflict", f"WITH {DEDUPED} SELECT first_seq FROM d WHERE label_conflict = 1")
def d7(spark, d):
    return corpus.deduplicated(corpus.kept(raw(spark, d))).where("label_conflict = 1").select("first_seq")


@add("d8_also_in", f"WITH {DEDUPED} SELECT first_seq, array_to_string(list_filter(srcs, lambda x: x <> source), '|') also_in FROM d")
def d8(spark, d):
    return corpus.deduplicated(corpus.kept(raw(spark, d))).select("first_seq", corpus.also_in(F.col("srcs"), F.col("source")).alias("also_in"))


@add("d9_first_seen_ids", f"WITH {DEDUPED} SELECT first_seq, row_number() OVER (ORDER BY first_seq) id FROM d")
def d9(spark, d):
    return first_seen_ids(corpus.deduplicated(corpus.kept(raw(spark, d))).select("first_seq"), "first_seq", "id")


@add("d10_template_key", f"SELECT row_id, {TEMPLATE} template FROM (SELECT row_id, {CLEAN('text')} AS text FROM source_rows)")
def d10(spark, d):
    return table(spark, d, "source_rows").select("row_id", T.template_key(T.clean(F.col("text"))).alias("template"))


@add("d11_template_groups", f"WITH {DEDUPED}, i AS (SELECT row_number() OVER (ORDER BY first_seq) id, {TEMPLATE} template FROM d) SELECT id, dense_rank() OVER (ORDER BY f) dup_group FROM (SELECT id, min(id) OVER (PARTITION BY template) f FROM i)")
def d11(spark, d):
    return corpus.grouped(corpus.deduplicated(corpus.kept(raw(spark, d)))).select("id", "dup_group")


@add("d12_unfilled_smishing", f"WITH {DEDUPED} SELECT count(*) n FROM d WHERE smish IS NULL AND coalesce(spam, 0) = 0")
def d12(spark, d):
    return corpus.deduplicated(corpus.kept(raw(spark, d))).where("smish is null and coalesce(spam, 0) = 0").agg(F.count(F.lit(1)).alias("n"))


@add("corpus_build")
def build(spark, d):
    """The whole build: raw rows to grouped, labelled, unique messages with features."""
    c = corpus.merged(table(spark, d, "source_rows"), table(spark, d, "source_rank"))
    return X.with_keywords(X.with_features(c.select("id", "dup_group", "text", "label", "source", "dup_count", "also_in")))


# ---------------------------------------------------------------- P: projections and predicates


@add("proj01_clean", f"SELECT row_id, {CLEAN('text')} AS text FROM source_rows")
def proj01(spark, d):
    return table(spark, d, "source_rows").select("row_id", T.clean(F.col("text")).alias("text"))


@add("proj02_empty_dropped", f"SELECT lower(trim(source)) source, count(*) FILTER (WHERE length({CLEAN('text')}) = 0) dropped, count(*) n FROM source_rows GROUP BY 1")
def proj02(spark, d):
    t = table(spark, d, "source_rows").groupBy(F.lower(F.trim("source")).alias("source"))
    return t.agg(F.count(F.when(F.length(T.clean(F.col("text"))) == 0, 1)).alias("dropped"), F.count(F.lit(1)).alias("n"))


@add("proj03_bad_label_dropped", f"WITH {RAW} SELECT source, count(*) FILTER (WHERE bad) dropped FROM n GROUP BY 1")
def proj03(spark, d):
    return raw(spark, d).groupBy("source").agg(F.count(F.when(F.col("bad_label"), 1)).alias("dropped"))


@add("proj04_label_decoding", f"WITH {RAW} SELECT seq, spam, smish FROM n WHERE source_key = 'smishing_dataset' AND NOT bad")
def proj04(spark, d):
    return raw(spark, d).where("source_key = 'smishing_dataset' and not bad_label").select("seq", "spam", "smish")


@add("proj05_label_words", f"WITH {RAW} SELECT source, spam, smish, count(*) n FROM n WHERE source_key IN ('mendeley sms phishing','uci sms spam collection') AND NOT bad GROUP BY ALL")
def proj05(spark, d):
    r = raw(spark, d).where(F.col("source_key").isin("mendeley sms phishing", "uci sms spam collection") & ~F.col("bad_label"))
    return r.groupBy("source", "spam", "smish").agg(F.count(F.lit(1)).alias("n"))


@add("proj06_constant_labels", f"WITH {RAW} SELECT seq, spam, smish FROM n WHERE source_key IN ('smishtank','nus sms corpus')")
def proj06(spark, d):
    return raw(spark, d).where(F.col("source_key").isin("smishtank", "nus sms corpus")).select("seq", "spam", "smish")


@add("proj07_first_filled", f"SELECT DISTINCT report_id, coalesce(nullif({CLEAN('maintext')}, ''), {CLEAN('fulltext')}) AS text FROM smishtank_reports")
def proj07(spark, d):
    t = table(spark, d, "smishtank_reports")
    return t.select("report_id", F.coalesce(F.nullif(T.clean(F.col("maintext")), F.lit("")), T.clean(F.col("fulltext"))).alias("text")).distinct()


@add("proj08_has_url", f"SELECT DISTINCT report_id, CASE WHEN coalesce(url, '') <> '' THEN 1 ELSE {HAS_URL('coalesce(maintext, chr(32))')} END has_url FROM smishtank_reports")
def proj08(spark, d):
    t = table(spark, d, "smishtank_reports")
    stated = F.when(F.coalesce("url", F.lit("")) != "", 1)
    return t.select("report_id", F.coalesce(stated, T.has_url(F.coalesce("maintext", F.lit(" "))).cast("int")).alias("has_url")).distinct()


@add("proj09_not_leaky", f"WITH {RAW} SELECT source, CAST(leaky = 0 AS INT) is_clean_label, count(*) n FROM n GROUP BY ALL")
def proj09(spark, d):
    return raw(spark, d).groupBy("source", (F.col("leaky") == 0).cast("int").alias("is_clean_label")).agg(F.count(F.lit(1)).alias("n"))


@add("proj10_rule_counts", f"WITH {RESOLVED} SELECT rule, count(*) n FROM r GROUP BY 1")
def proj10(spark, d):
    return corpus.resolved(corpus.deduplicated(corpus.kept(raw(spark, d)))).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


@add("proj11_label_recode", f"WITH {RESOLVED} SELECT lab AS label, count(*) n FROM r GROUP BY 1")
def proj11(spark, d):
    return corpus.resolved(corpus.deduplicated(corpus.kept(raw(spark, d)))).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


_CATEGORIES = "CASE c " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in CATEGORY_TYPE.items()) + " END"


@add("proj12_type_by_brand", rf"""WITH b AS (SELECT regexp_replace(lower(name), '[^a-z0-9]+', '', 'g') k, min(scam_type) t FROM canon_terms WHERE kind = 'brand' GROUP BY 1),
r AS (SELECT DISTINCT report_id, lower(trim(coalesce(category, ''))) c, brand FROM smishtank_reports),
p AS (SELECT report_id, unnest(string_split_regex(coalesce(brand, ''), '[,/]')) part, generate_subscripts(string_split_regex(coalesce(brand, ''), '[,/]'), 1) pos FROM (SELECT DISTINCT report_id, brand FROM r)),
h AS (SELECT report_id, arg_min(t, pos) t FROM p JOIN b ON regexp_replace(lower(part), '[^a-z0-9]+', '', 'g') = k GROUP BY 1)
SELECT report_id, CASE WHEN c = '' THEN '' ELSE coalesce({_CATEGORIES}, CASE WHEN c IN ('account alert', 'account warning', 'other') THEN h.t END, 'other') END scam_type FROM r LEFT JOIN h USING (report_id)""")
def proj12(spark, d):
    """The type of a row: by category, else, for the categories that leave it to the brand, by the first
    listed brand that is known, else other; nothing without a category."""
    r = table(spark, d, "smishtank_reports").select("report_id", "category", "brand").distinct()
    dim = table(spark, d, "canon_terms").where("kind = 'brand'").groupBy(T.brand_key(F.col("name")).alias("k")).agg(F.min("scam_type").alias("t"))
    hit = joins.first_hit(r.select("report_id", "brand").distinct(), "report_id", F.split(F.coalesce("brand", F.lit("")), "[,/]"), dim, "k", "t", T.brand_key)
    return r.join(hit, "report_id", "left").select("report_id", corpus.typed_by(F.col("category"), F.col("t"), decides=("account alert", "account warning", "other")).alias("scam_type"))


@add("proj13_row_mask", f"WITH {ONCE} SELECT id FROM m WHERE source IN ('SmishTank','UCI SMS Spam Collection') AND scam = 1 AND length(text) >= 80")
def proj13(spark, d):
    return messages(spark, d, "source", "scam", "text").where(F.col("source").isin("SmishTank", "UCI SMS Spam Collection") & (F.col("scam") == 1) & (F.length("text") >= 80)).select("id")


@add("proj14_case_column", f"WITH {ONCE} SELECT id, CASE WHEN scam = 1 AND model_pred = 1 THEN 'caught' WHEN scam = 1 THEN 'missed' WHEN model_pred = 1 THEN 'false alarm' ELSE 'clear' END outcome FROM m")
def proj14(spark, d):
    hit, said = F.col("scam") == 1, F.col("model_pred") == 1
    return messages(spark, d, "scam", "model_pred").select("id", F.when(hit & said, "caught").when(hit, "missed").when(said, "false alarm").otherwise("clear").alias("outcome"))


@add("proj15_hard_prediction", f"WITH {SCORED} SELECT CAST(score >= 9 AS INT) pred, count(*) n FROM s GROUP BY 1")
def proj15(spark, d):
    return scored(spark, d).groupBy((F.col("score") >= 9).cast("int").alias("pred")).agg(F.count(F.lit(1)).alias("n"))


@add("proj16_nested_label", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'test' WHEN o_orderstatus = 'P' THEN 'val' ELSE 'train' END split FROM orders")
def proj16(spark, d):
    s = F.col("o_orderstatus")
    return table(spark, d, "orders").select("o_orderkey", F.when(s == "F", "test").when(s == "P", "val").otherwise("train").alias("split"))


@add("proj17_overlay", f"WITH {ONCE}, f AS (SELECT report_id, max(scam_type) fix FROM smishtank_reports WHERE coalesce(scam_type, '') <> '' GROUP BY 1) SELECT id, coalesce(fix, scam_type) scam_type, CAST(fix IS NOT NULL AND fix <> coalesce(scam_type, '') AS INT) changed FROM m LEFT JOIN f ON id = report_id")
def proj17(spark, d):
    fix = table(spark, d, "smishtank_reports").where(F.coalesce("scam_type", F.lit("")) != "").groupBy(F.col("report_id").alias("id")).agg(F.max("scam_type").alias("fix"))
    return joins.overlaid(messages(spark, d, "scam_type"), fix, "id", "scam_type", "fix").select("id", "scam_type", "changed")


@add("proj18_gated_type", f"WITH {ONCE} SELECT id, CASE WHEN model_pred = 1 THEN scam_type END shown FROM m")
def proj18(spark, d):
    return messages(spark, d, "scam_type", "model_pred").select("id", F.when(F.col("model_pred") == 1, F.col("scam_type")).alias("shown"))


@add("proj19_confidence_floor", f"WITH {ONCE} SELECT id, CASE WHEN (length(text) % 100) / 100.0 >= 0.35 THEN scam_type END type FROM m")
def proj19(spark, d):
    return messages(spark, d, "text", "scam_type").select("id", F.when((F.length("text") % 100) / 100.0 >= 0.35, F.col("scam_type")).alias("type"))


@add("proj20_false_alarm", f"WITH {ONCE} SELECT id, CASE WHEN scam_type <> 'not a scam' THEN scam_type END type, CAST(coalesce(scam_type = 'not a scam', false) AS INT) false_alarm FROM m")
def proj20(spark, d):
    t = F.col("scam_type")
    return messages(spark, d, "scam_type").select("id", F.when(t != "not a scam", t).alias("type"), F.coalesce((t == "not a scam").cast("int"), F.lit(0)).alias("false_alarm"))


@add("proj21_confidence_words", f"WITH {ONCE} SELECT id, CASE WHEN st >= 0.95 THEN 'Very confident' WHEN st >= 0.8 THEN 'Fairly confident' ELSE 'Not very confident' END words FROM (SELECT id, CASE WHEN model_pred = 1 THEN p ELSE 1 - p END st FROM (SELECT *, CAST((length(text) % 100) AS DOUBLE) / 128 p FROM m))")
def proj21(spark, d):
    p = (F.length("text") % 100).cast("double") / 128
    return messages(spark, d, "text", "model_pred").select("id", T.confidence_words(p, F.coalesce(F.col("model_pred") == 1, F.lit(False))).alias("words"))


@add("proj22_signals", f"WITH {ONCE} SELECT id, concat_ws('|', CASE WHEN {HAS_URL('text')} > 0 THEN 'link' END, CASE WHEN contains(text, '!') THEN 'exclaims' END, CASE WHEN contains(lower(text), 'free') THEN 'free' END) signals FROM m WHERE text IS NOT NULL")
def proj22(spark, d):
    m = messages(spark, d, "text").where("text is not null").withColumns({"link": T.has_url(F.col("text")).cast("int"), "ex": T.count_of(F.col("text"), "!"), "fr": F.lower("text").contains("free").cast("int")})
    return m.select("id", F.array_join(X.signals({"link": "link", "ex": "exclaims", "fr": "free"}), "|").alias("signals"))


@add("proj23_columns", "SELECT p_partkey AS part, p_brand AS brand, p_size AS size FROM part")
def proj23(spark, d):
    return table(spark, d, "part").drop("p_name", "p_type", "p_retailprice").withColumnsRenamed({"p_partkey": "part", "p_brand": "brand", "p_size": "size"})


@add("proj24_invariants", f"WITH {RESOLVED} SELECT count(*) FILTER (WHERE (CASE WHEN lab <> 'ham' THEN 1 ELSE 0 END) <> (CASE WHEN lab = 'spam' THEN 1 ELSE 0 END) + (CASE WHEN lab = 'smishing' THEN 1 ELSE 0 END)) violations, count(*) n FROM r")
def proj24(spark, d):
    r = corpus.resolved(corpus.deduplicated(corpus.kept(raw(spark, d))))
    return r.agg(F.count(F.when(F.col("scam") != F.col("spam_label") + F.col("smishing_label"), 1)).alias("violations"), F.count(F.lit(1)).alias("n"))


@add("proj25_numeric_cleaning", "SELECT c_custkey, greatest(round_even(c_acctbal, 0), 0) rounded, CAST(c_acctbal > 0.5 AS INT) high, CASE WHEN c_nationkey IN (1, 2, 3) THEN c_nationkey END kept, CASE WHEN c_nationkey = 0 THEN -1 ELSE c_nationkey END code FROM customer")
def proj25(spark, d):
    b, k = F.col("c_acctbal"), F.col("c_nationkey")
    return table(spark, d, "customer").select("c_custkey", F.greatest(F.bround(b, 0), F.lit(0.0)).alias("rounded"), (b > 0.5).cast("int").alias("high"), F.when(k.isin(1, 2, 3), k).alias("kept"), F.when(k == 0, -1).otherwise(k).alias("code"))


@add("proj26_first_seen_codes", "WITH f AS (SELECT c_mktsegment s, min(c_custkey) k FROM customer GROUP BY 1), c AS (SELECT s, CASE WHEN s = 'MACHINERY' THEN -1 ELSE row_number() OVER (PARTITION BY s = 'MACHINERY' ORDER BY k) - 1 END code FROM f) SELECT c_custkey, CAST(code AS INT) code FROM customer JOIN c ON s = c_mktsegment")
def proj26(spark, d):
    """Categories numbered by first appearance; one of them means unknown (-1)."""
    c = table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    first = c.groupBy("c_mktsegment").agg(F.min("c_custkey").alias("k"))
    codes = first_seen_ids(first.where("c_mktsegment <> 'MACHINERY'"), "k", "code").select("c_mktsegment", (F.col("code") - 1).cast("int").alias("code"))
    return c.join(codes, "c_mktsegment", "left").select("c_custkey", F.when(F.col("c_mktsegment") == "MACHINERY", -1).otherwise(F.col("code")).alias("code"))


@add("proj27_quartile_bins", "WITH e AS (SELECT quantile_cont(value, [0.0, 0.25, 0.5, 0.75]) q FROM events) SELECT event_id, CAST((value > q[1])::INT + (value > q[2])::INT + (value > q[3])::INT + (value > q[4])::INT AS INT) bin FROM events, e")
def proj27(spark, d):
    return stats.digitised(table(spark, d, "events").select("event_id", "value"), "value", "bin").select("event_id", "bin")


@add("proj28_units", "SELECT l_orderkey, l_linenumber, CAST(l_quantity * 60 AS BIGINT) AS minutes, CAST(l_quantity + l_linenumber + l_partkey AS BIGINT) total FROM lineitem")
def proj28(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity") * 60).cast("long").alias("minutes"), (F.col("l_quantity") + F.col("l_linenumber") + F.col("l_partkey")).cast("long").alias("total"))


@add("proj29_or_flags", f"WITH {ONCE} SELECT id, CASE WHEN spam_label = 1 OR smishing_label = 1 THEN 1 ELSE 0 END scam FROM m")
def proj29(spark, d):
    return messages(spark, d, "spam_label", "smishing_label").select("id", F.when((F.col("spam_label") == 1) | (F.col("smishing_label") == 1), 1).otherwise(0).alias("scam"))


@add("proj30_display_order", "SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 1 WHEN 'P' THEN 2 WHEN 'F' THEN 3 ELSE 9 END place FROM orders")
def proj30(spark, d):
    order = F.create_map(*[F.lit(x) for kv in {"O": 1, "P": 2, "F": 3}.items() for x in kv])
    return table(spark, d, "orders").select("o_orderkey", F.coalesce(F.try_element_at(order, F.col("o_orderstatus")), F.lit(9)).alias("place"))


# ---------------------------------------------------------------- J, U: joins and set operations


@add("j1_align_by_id", f"WITH {ONCE} SELECT m.id, length(text) n, label FROM m JOIN embeddings e ON m.id = e.vec_id")
def j1(spark, d):
    m = messages(spark, d, "text", "label").select("id", F.length("text").cast("long").alias("n"), F.lit(None).cast("int").alias("x"))
    return joins.align(m.drop("x"), table(spark, d, "embeddings").select("vec_id", "label"), "id", "vec_id").select("id", "n", "label")


SQL["j1_align_by_id"] = f"WITH {ONCE} SELECT m.id, length(m.text) n, e.label FROM m JOIN embeddings e ON m.id = e.vec_id"


@add("j2_vector_gather", "SELECT event_id, label FROM events JOIN embeddings ON vec_id = event_id % 500")
def j2(spark, d):
    return table(spark, d, "events").select("event_id", (F.col("event_id") % 500).alias("vec_id")).join(table(spark, d, "embeddings").select("vec_id", "label"), "vec_id").select("event_id", "label")


@add("j3_left_lookup", "SELECT s_suppkey, n_name FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey AND n_regionkey <> 2")
def j3(spark, d):
    n = table(spark, d, "nation").where("n_regionkey <> 2")
    return table(spark, d, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey"), "left").select("s_suppkey", "n_name")


@add("j4_last_by_text", "WITH l AS (SELECT text, max(row_id) last_id FROM source_rows WHERE text IS NOT NULL GROUP BY 1) SELECT member_id, last_id FROM (SELECT DISTINCT member_id, text FROM group_members) g LEFT JOIN l USING (text)")
def j4(spark, d):
    last = joins.last_by_key(table(spark, d, "source_rows"), "text", "row_id", "last_id")
    return table(spark, d, "group_members").select("member_id", "text").distinct().join(last, "text", "left").select("member_id", "last_id")


@add("j5_unique_text_only", "WITH u AS (SELECT text, min(row_id) row_id FROM source_rows WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) = 1) SELECT s.row_id, u.row_id found FROM source_rows s LEFT JOIN u ON s.text = u.text")
def j5(spark, d):
    s = table(spark, d, "source_rows").select("row_id", "text")
    return s.join(joins.unique_only(s, "text", "row_id", "found"), "text", "left").select("row_id", "found")


@add("j6_semi", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def j6(spark, d):
    c = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'")
    return table(spark, d, "orders").join(c, F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("o_orderkey")


@add("j7_anti", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def j7(spark, d):
    return table(spark, d, "customer").join(table(spark, d, "orders"), F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey")


@add("j8_threshold_grid", f"WITH {SCORED}, t AS (SELECT CAST(range AS DOUBLE) t FROM range(0, 60)) SELECT t threshold, count(*) FILTER (WHERE y = 1 AND score >= t) tp, count(*) FILTER (WHERE y <> 1 AND score >= t) fp, count(*) FILTER (WHERE y <> 1 AND score < t) tn, count(*) FILTER (WHERE y = 1 AND score < t) fn FROM t, s GROUP BY t")
def j8(spark, d):
    return metrics.sweep(scored(spark, d), "y", "score", spark.range(60).select(F.col("id").alias("t")))


@add("j9_parameter_product", "SELECT r_name, n_nationkey FROM region, nation WHERE n_nationkey < 3")
def j9(spark, d):
    return table(spark, d, "region").crossJoin(table(spark, d, "nation").where("n_nationkey < 3")).select("r_name", "n_nationkey")  # two small dimensions


@add("j10_dimension_product", "WITH c AS (SELECT s, y, f FROM (SELECT DISTINCT o_orderstatus s FROM orders), (SELECT unnest(range(1992, 1999)) y), (SELECT unnest([0, 1]) f)) SELECT s, CAST(y AS INT) y, CAST(f AS INT) f, count(o_orderkey) n FROM c LEFT JOIN orders ON o_orderstatus = s AND year(o_orderdate) = y AND CAST(o_totalprice > 200000 AS INT) = f GROUP BY ALL")
def j10(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderstatus").alias("s"), F.year("o_orderdate").alias("y"), (F.col("o_totalprice") > 200000).cast("int").alias("f"))
    n = o.groupBy("s", "y", "f").agg(F.count(F.lit(1)).alias("n"))
    grid = joins.cells(o.select("s").distinct(), spark.range(1992, 1999).select(F.col("id").cast("int").alias("y")), spark.range(2).select(F.col("id").cast("int").alias("f")))
    return joins.counted_cells(grid, n, ["s", "y", "f"]).select("s", "y", "f", "n")


PLAN = [("bank warning", 30), ("courtship", 20), ("utility shutoff", 3), ("work offer", 13)]


@add("j11_padded_quota", f"""WITH p(bucket, n) AS (VALUES {', '.join(f"('{b}', {n})" for b, n in PLAN)}), {ONCE}, slots AS (SELECT bucket, unnest(range(1, n + 1)) slot FROM p),
k AS (SELECT scam_type bucket, CAST(id AS VARCHAR) id, row_number() OVER (PARTITION BY scam_type ORDER BY md5('5:' || id), m.id) slot FROM m)
SELECT bucket, CAST(slot AS INT) slot, coalesce(id, 'SOURCE-' || lower(replace(bucket, ' ', '-')) || '-' || lpad(CAST(slot AS VARCHAR), 2, '0')) id, CAST(id IS NULL AS INT) needs_sourcing FROM slots LEFT JOIN k USING (bucket, slot)""")
def j11(spark, d):
    return sampling.quota(messages(spark, d, "scam_type"), "scam_type", spark.createDataFrame(PLAN, "bucket string, n int"), "id", 5)


@add("j12_first_hit_in_list", "WITH r AS (SELECT DISTINCT report_id, string_split_regex(coalesce(brand, ''), '[,/]') x FROM smishtank_reports), p AS (SELECT report_id, unnest(x) part, generate_subscripts(x, 1) pos FROM r), t AS (SELECT name, min(term_id) term_id FROM canon_terms WHERE kind = 'brand' GROUP BY 1), h AS (SELECT report_id, arg_min(term_id, pos) term_id FROM p JOIN t ON trim(part) = name GROUP BY 1) SELECT report_id, coalesce(h.term_id, 0) term_id FROM (SELECT DISTINCT report_id FROM r) LEFT JOIN h USING (report_id)")
def j12(spark, d):
    r = table(spark, d, "smishtank_reports").select("report_id", F.split(F.coalesce("brand", F.lit("")), "[,/]").alias("x")).distinct()
    t = table(spark, d, "canon_terms").where("kind = 'brand'").groupBy("name").agg(F.min("term_id").alias("term_id"))
    hit = joins.first_hit(r, "report_id", F.col("x"), t, "name", "term_id", F.trim)
    return r.select("report_id").distinct().join(hit, "report_id", "left").select("report_id", F.coalesce("term_id", F.lit(0)).alias("term_id"))


@add("u1_union_all", "SELECT s_suppkey k, s_name name FROM supplier UNION ALL SELECT c_custkey, c_name FROM customer")
def u1(spark, d):
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name")).unionByName(table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name")))


@add("u2_first_per_key", "SELECT o_custkey, min(o_orderkey) o_orderkey FROM orders GROUP BY 1")
def u2(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.min("o_orderkey").alias("o_orderkey"))


@add("u3_set_operations", "SELECT 'both' side, k FROM (SELECT o_custkey k FROM orders INTERSECT SELECT c_custkey FROM customer WHERE c_nationkey < 5) UNION ALL SELECT 'left', k FROM (SELECT c_custkey k FROM customer WHERE c_nationkey < 5 EXCEPT SELECT o_custkey FROM orders)")
def u3(spark, d):
    c = table(spark, d, "customer").where("c_nationkey < 5").select(F.col("c_custkey").alias("k"))
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("k"))
    return o.intersect(c).select(F.lit("both").alias("side"), "k").union(c.exceptAll(o).distinct().select(F.lit("left"), "k"))


@add("u4_subset_test", "WITH a AS (SELECT o_custkey k, list(DISTINCT o_orderstatus) s FROM orders GROUP BY 1) SELECT k, CAST(len(list_filter(s, lambda x: x NOT IN ('O', 'F'))) = 0 AS INT) inside FROM a")
def u4(spark, d):
    s = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.collect_set("o_orderstatus").alias("s"))
    return s.select("k", (F.size(F.array_except("s", F.array(F.lit("O"), F.lit("F")))) == 0).cast("int").alias("inside"))


# ---------------------------------------------------------------- A: aggregations


@add("a1_count_by_key", f"WITH {ONCE} SELECT source, label, count(*) n FROM m GROUP BY ALL")
def a1(spark, d):
    return messages(spark, d, "source", "label").groupBy("source", "label").agg(F.count(F.lit(1)).alias("n"))


@add("a2_distinct_groups", f"WITH {ONCE} SELECT count(DISTINCT dup_group) n_groups FROM m")
def a2(spark, d):
    return messages(spark, d, "dup_group").agg(F.countDistinct("dup_group").alias("n_groups"))


@add("a3_largest_group", f"WITH {ONCE} SELECT max(n) largest FROM (SELECT count(*) n FROM m WHERE dup_group IS NOT NULL GROUP BY dup_group)")
def a3(spark, d):
    return messages(spark, d, "dup_group").where("dup_group is not null").groupBy("dup_group").count().agg(F.max("count").alias("largest"))


@add("a4_conditional_counts", f"WITH {ONCE} SELECT count(*) n, count(*) FILTER (WHERE has_url = 1) with_url, count(*) FILTER (WHERE coalesce(msg_date, '') <> '') with_date, count(*) FILTER (WHERE coalesce(also_in, '') <> '') in_others, count(*) FILTER (WHERE label_conflict = 1) conflicts FROM m")
def a4(spark, d):
    n = lambda c: F.count(F.when(c, 1))
    filled = lambda c: F.coalesce(c, F.lit("")) != ""
    return messages(spark, d, "has_url", "msg_date", "also_in", "label_conflict").agg(F.count(F.lit(1)).alias("n"), n(F.col("has_url") == 1).alias("with_url"), n(filled("msg_date")).alias("with_date"), n(filled("also_in")).alias("in_others"), n(F.col("label_conflict") == 1).alias("conflicts"))


@add("a5_keyword_lift", f"WITH {ONCE}, s AS (SELECT lower(text) low, label, scam FROM m WHERE scam IS NOT NULL), k AS (SELECT unnest([{', '.join(q(k) for k in KEYWORDS)}]) keyword), b AS (SELECT avg(CAST(scam AS DOUBLE)) base FROM s), c AS (SELECT keyword, count(low) n, count(low) FILTER (WHERE label = 'ham') ham, count(low) FILTER (WHERE label = 'spam') spam, count(low) FILTER (WHERE label = 'smishing') smishing, count(low) FILTER (WHERE scam = 1) hits FROM k LEFT JOIN s ON contains(low, keyword) GROUP BY keyword) SELECT c.*, round(CASE WHEN n > 0 AND base > 0 THEN CAST(hits AS DOUBLE) / n / base END, 4) lift FROM c, b")
def a5(spark, d):
    """Rows, label split and lift of every keyword, also of those without a row: all flags in one pass,
    unpivoted after aggregation."""
    m = messages(spark, d, "text", "label", "scam").where("scam is not null").withColumn("low", F.lower("text"))
    labels = ["ham", "spam", "smishing"]
    n = lambda c: F.count(F.when(c, 1))
    per = [F.struct(F.lit(k).alias("keyword"), n(F.col("low").contains(k)).alias("n"), *[n(F.col("low").contains(k) & (F.col("label") == v)).alias(v) for v in labels], n(F.col("low").contains(k) & (F.col("scam") == 1)).alias("hits")) for k in KEYWORDS]
    rows = m.agg(F.avg(F.col("scam").cast("double")).alias("base"), F.array(*per).alias("x")).select("base", F.explode("x").alias("x")).select("base", "x.*")
    return rows.select("keyword", "n", *labels, "hits", F.round(F.try_divide(F.try_divide("hits", "n"), "base"), 4).alias("lift"))


@add("a6_empty_groups_kept", f"WITH {ONCE} SELECT name scam_type, count(id) n FROM canon_terms LEFT JOIN m ON m.scam_type = name WHERE kind = 'scam_type' GROUP BY 1")
def a6(spark, d):
    n = messages(spark, d, "scam_type").groupBy("scam_type").agg(F.count(F.lit(1)).alias("n"))
    t = table(spark, d, "canon_terms").where("kind = 'scam_type'").select(F.col("name").alias("scam_type")).distinct()
    return t.join(n, "scam_type", "left").select("scam_type", F.coalesce("n", F.lit(0)).alias("n"))


@add("a7_means_transposed", f"WITH {ONCE}, a AS (SELECT label, round(avg(length(text)), 4) length, round(avg(CAST(has_url AS DOUBLE)), 4) has_url FROM m GROUP BY 1) UNPIVOT a ON length, has_url INTO NAME feature VALUE mean")
def a7(spark, d):
    a = messages(spark, d, "label", "text", "has_url").groupBy("label").agg(F.round(F.avg(F.length("text")), 4).alias("length"), F.round(F.avg(F.col("has_url").cast("double")), 4).alias("has_url"))
    return a.unpivot("label", ["length", "has_url"], "feature", "mean").where("mean is not null")


@add("a8_cross_tab", f"WITH {ONCE} SELECT source, count(*) FILTER (WHERE label = 'ham') ham, count(*) FILTER (WHERE label = 'spam') spam, count(*) FILTER (WHERE label = 'smishing') smishing FROM m GROUP BY 1")
def a8(spark, d):
    t = messages(spark, d, "source", "label").groupBy("source").pivot("label", ["ham", "spam", "smishing"]).agg(F.count(F.lit(1)))
    return t.na.fill(0)


@add("a9_row_totals", "SELECT o_orderstatus, o_orderpriority, count(*) n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
def a9(spark, d):
    return table(spark, d, "orders").rollup("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


@add("a10_sum_mean", f"WITH {SCORED} SELECT source, CAST(sum(y) AS BIGINT) positives, round(avg(CAST(y AS DOUBLE)), 4) rate FROM s GROUP BY 1")
def a10(spark, d):
    return scored(spark, d).groupBy("source").agg(F.sum("y").alias("positives"), F.round(F.avg(F.col("y").cast("double")), 4).alias("rate"))


@add("a11_group_accuracy", f"WITH {ONCE} SELECT source, count(*) n, count(*) FILTER (WHERE scam = model_pred) correct, round(count(*) FILTER (WHERE scam = model_pred) / count(*), 4) acc FROM m WHERE scam IS NOT NULL AND model_pred IS NOT NULL GROUP BY 1")
def a11(spark, d):
    m = messages(spark, d, "source", "scam", "model_pred").where("scam is not null and model_pred is not null")
    right = F.count(F.when(F.col("scam") == F.col("model_pred"), 1))
    return m.groupBy("source").agg(F.count(F.lit(1)).alias("n"), right.alias("correct"), F.round(right / F.count(F.lit(1)), 4).alias("acc"))


@add("a12_splits_per_group", f"WITH {ONCE} SELECT max(c) most FROM (SELECT count(DISTINCT lower(trim(split))) c FROM m WHERE dup_group IS NOT NULL GROUP BY dup_group)")
def a12(spark, d):
    return messages(spark, d, "dup_group", "split").where("dup_group is not null").groupBy("dup_group").agg(F.countDistinct(F.lower(F.trim("split"))).alias("c")).agg(F.max("c").alias("most"))


@add("a13_confusion", f"WITH {SCORED} SELECT count(*) FILTER (WHERE y = 1 AND score >= 9) tp, count(*) FILTER (WHERE y <> 1 AND score >= 9) fp, count(*) FILTER (WHERE y <> 1 AND score < 9) tn, count(*) FILTER (WHERE y = 1 AND score < 9) fn FROM s")
def a13(spark, d):
    return metrics.confusion(scored(spark, d), "y", F.col("score") >= 9)


@add("a14_binary_metrics", f"WITH {SCORED}, c AS (SELECT count(*) FILTER (WHERE y = 1 AND score >= 9) tp, count(*) FILTER (WHERE y <> 1 AND score >= 9) fp, count(*) FILTER (WHERE y <> 1 AND score < 9) tn, count(*) FILTER (WHERE y = 1 AND score < 9) fn FROM s) SELECT *, round((tp + tn) / greatest(tp + fp + tn + fn, 1), 6) accuracy, round(tp / greatest(tp + fp, 1), 6) AS precision, round(tp / greatest(tp + fn, 1), 6) recall, round(tn / greatest(tn + fp, 1), 6) specificity FROM c")
def a14(spark, d):
    return metrics.rates(metrics.confusion(scored(spark, d), "y", F.col("score") >= 9))


@add("a15_auc", f"WITH {SCORED}, g AS (SELECT score, count(*) FILTER (WHERE y = 1) pos, count(*) FILTER (WHERE y <> 1) neg FROM s GROUP BY 1), c AS (SELECT *, sum(neg) OVER (ORDER BY score) - neg below FROM g) SELECT round(sum(pos * (below + neg / 2.0)) / (sum(pos) * sum(neg)), 6) auc, CAST(sum(pos) AS BIGINT) positives, CAST(sum(neg) AS BIGINT) negatives FROM c")
def a15(spark, d):
    return metrics.auc(scored(spark, d), "y", "score").withColumn("auc", F.round("auc", 6))


@add("a16_average_precision", f"WITH {SCORED}, g AS (SELECT score, count(*) FILTER (WHERE y = 1) pos, count(*) FILTER (WHERE y <> 1) neg FROM s GROUP BY 1), c AS (SELECT *, sum(pos) OVER w cp, sum(neg) OVER w cn FROM g WINDOW w AS (ORDER BY score DESC)) SELECT round(sum(pos * (CAST(cp AS DOUBLE) / (cp + cn))) / sum(pos), 6) ap FROM c")
def a16(spark, d):
    return metrics.average_precision(scored(spark, d), "y", "score").select(F.round("ap", 6).alias("ap"))


_PAIRS = f"{ONCE}, p AS (SELECT label t, CASE WHEN length(text) % 7 = 0 THEN 'spam' WHEN length(text) % 5 = 0 THEN 'ham' ELSE label END p FROM m WHERE label IS NOT NULL AND text IS NOT NULL), k AS (SELECT t, p, count(*) n FROM p GROUP BY ALL), c AS (SELECT class, (SELECT sum(n) FROM k WHERE t = class) n_true, coalesce((SELECT sum(n) FROM k WHERE p = class), 0) n_pred, coalesce((SELECT sum(n) FROM k WHERE t = class AND p = class), 0) tp FROM (SELECT DISTINCT t class FROM k)), f AS (SELECT class, n_true, n_pred, tp, n_pred - tp fp, n_true - tp fn, CASE WHEN n_pred > 0 THEN CAST(tp AS DOUBLE) / n_pred ELSE 0 END pr, CASE WHEN n_true > 0 THEN CAST(tp AS DOUBLE) / n_true ELSE 0 END re FROM c), o AS (SELECT class, CAST(n_true AS BIGINT) n_true, CAST(n_pred AS BIGINT) n_pred, CAST(tp AS BIGINT) tp, CAST(fp AS BIGINT) fp, CAST(fn AS BIGINT) fn, round(pr, 4) AS precision, round(re, 4) recall, round(CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0 END, 4) f1 FROM f)"


def _pairs(spark, d):
    m = messages(spark, d, "label", "text").where("label is not null and text is not null")
    n = F.length("text")
    return m.select(F.col("label").alias("t"), F.when(n % 7 == 0, "spam").when(n % 5 == 0, "ham").otherwise(F.col("label")).alias("p"))


@add("a17_per_class", f"WITH {_PAIRS} SELECT * FROM o")
def a17(spark, d):
    return metrics.per_class(_pairs(spark, d), "t", "p")


@add("a18_macro_weighted", f"WITH {_PAIRS} SELECT 'MACRO' class, CAST(sum(n_true) AS BIGINT) n_true, CAST(sum(n_pred) AS BIGINT) n_pred, CAST(sum(tp) AS BIGINT) tp, CAST(sum(fp) AS BIGINT) fp, CAST(sum(fn) AS BIGINT) fn, round(avg(precision), 4) AS precision, round(avg(recall), 4) recall, round(avg(f1), 4) f1 FROM o UNION ALL SELECT 'WEIGHTED', CAST(sum(n_true) AS BIGINT), CAST(sum(n_pred) AS BIGINT), CAST(sum(tp) AS BIGINT), CAST(sum(fp) AS BIGINT), CAST(sum(fn) AS BIGINT), round(sum(precision * n_true) / sum(n_true), 4), round(sum(recall * n_true) / sum(n_true), 4), round(sum(f1 * n_true) / sum(n_true), 4) FROM o")
def a18(spark, d):
    return metrics.averages(metrics.per_class(_pairs(spark, d), "t", "p"))


@add("a19_confusion_matrix", f"WITH {_PAIRS} SELECT t, CAST(coalesce(sum(n) FILTER (WHERE p = 'ham'), 0) AS BIGINT) ham, CAST(coalesce(sum(n) FILTER (WHERE p = 'spam'), 0) AS BIGINT) spam, CAST(coalesce(sum(n) FILTER (WHERE p = 'smishing'), 0) AS BIGINT) smishing FROM k GROUP BY t")
def a19(spark, d):
    return _pairs(spark, d).groupBy("t").pivot("p", ["ham", "spam", "smishing"]).agg(F.count(F.lit(1))).na.fill(0)


@add("a20_restricted_classes", f"WITH {_PAIRS} SELECT CAST(sum(n) FILTER (WHERE t = p AND t IN ('ham', 'spam')) AS BIGINT) correct, CAST(sum(n) FILTER (WHERE t IN ('ham', 'spam')) AS BIGINT) n, CAST(sum(n) FILTER (WHERE t IN ('ham', 'spam') AND p NOT IN ('ham', 'spam')) AS BIGINT) outside FROM k")
def a20(spark, d):
    a, inside = _pairs(spark, d), F.col("t").isin("ham", "spam")
    n = lambda c: F.nullif(F.count(F.when(c, 1)), F.lit(0))
    return a.agg(n(inside & (F.col("t") == F.col("p"))).alias("correct"), n(inside).alias("n"), n(inside & ~F.col("p").isin("ham", "spam")).alias("outside"))


@add("a21_bootstrap")
def a21(spark, d):
    """A random interval; tested for coverage and reproducibility."""
    return metrics.bootstrap(scored(spark, d), "y", "score", 9.0)


@add("a22_quartiles", "SELECT event_type, round(quantile_cont(value, 0.25), 4) q1, round(quantile_cont(value, 0.5), 4) median, round(quantile_cont(value, 0.75), 4) q3 FROM events GROUP BY 1")
def a22(spark, d):
    return stats.quartiles(table(spark, d, "events"), "value", "event_type")


_TWO = "t AS (SELECT length(text) x, scam g FROM m WHERE scam IS NOT NULL AND text IS NOT NULL)"


def _two(spark, d):
    return messages(spark, d, "text", "scam").where("scam is not null and text is not null").select(F.length("text").alias("x"), F.col("scam").alias("g"))


@add("a23_cohens_d", f"WITH {ONCE}, {_TWO}, a AS (SELECT count(*) FILTER (WHERE g = 0) n0, count(*) FILTER (WHERE g = 1) n1, avg(x) FILTER (WHERE g = 0) m0, avg(x) FILTER (WHERE g = 1) m1, var_samp(x) FILTER (WHERE g = 0) v0, var_samp(x) FILTER (WHERE g = 1) v1 FROM t) SELECT n0, n1, round(abs(m1 - m0) / sqrt(((n0 - 1) * v0 + (n1 - 1) * v1) / (n0 + n1 - 2)), 4) d FROM a")
def a23(spark, d):
    return stats.cohens_d(_two(spark, d), "x", "g")


@add("a24_rank_sum", f"WITH {ONCE}, {_TWO}, r AS (SELECT g, avg(rn) OVER (PARTITION BY x) rk FROM (SELECT *, row_number() OVER (ORDER BY x) rn FROM t)), v AS (SELECT CAST(count(*) FILTER (WHERE g = 1) AS DOUBLE) n1, CAST(count(*) FILTER (WHERE g = 0) AS DOUBLE) n0, sum(rk) FILTER (WHERE g = 1) - count(*) FILTER (WHERE g = 1) * (count(*) FILTER (WHERE g = 1) + 1) / 2.0 u FROM r), w AS (SELECT CAST(sum(c * c * c - c) AS DOUBLE) ties FROM (SELECT CAST(count(*) AS DOUBLE) c FROM t GROUP BY x)) SELECT CAST(n1 AS BIGINT) n1, CAST(n0 AS BIGINT) n0, u, round((abs(u - n1 * n0 / 2) - 0.5) / sqrt(n1 * n0 / 12 * (n1 + n0 + 1 - ties / ((n1 + n0) * (n1 + n0 - 1)))), 4) z FROM v, w")
def a24(spark, d):
    return stats.mann_whitney(_two(spark, d), "x", "g").select("n1", "n0", "u", F.round("z", 4).alias("z"))


@add("a25_chi_square", f"WITH {ONCE}, t AS (SELECT source a, label b, count(*) o FROM m WHERE source IS NOT NULL AND label IS NOT NULL GROUP BY ALL), r AS (SELECT a, sum(o) ra FROM t GROUP BY 1), c AS (SELECT b, sum(o) cb FROM t GROUP BY 1), n AS (SELECT sum(o) n FROM t), x AS (SELECT r.a, c.b, ra * cb / n e, coalesce(o, 0) o FROM r, c, n LEFT JOIN t ON t.a = r.a AND t.b = c.b) SELECT round(sum((o - e) * (o - e) / e), 4) chi2, (count(DISTINCT a) - 1) * (count(DISTINCT b) - 1) dof FROM x")
def a25(spark, d):
    return stats.chi_square(messages(spark, d, "source", "label"), "source", "label")


@add("a26_group_rates", "SELECT event_type, round(avg(value), 4) mean, count(*) n, max(value) most FROM events GROUP BY 1")
def a26(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.round(F.avg("value"), 4).alias("mean"), F.count(F.lit(1)).alias("n"), F.max("value").alias("most"))


@add("a27_mode", "WITH c AS (SELECT l_returnflag, l_linenumber v, count(*) n FROM lineitem GROUP BY ALL) SELECT DISTINCT ON (l_returnflag) l_returnflag, v AS mode FROM c ORDER BY l_returnflag, n DESC, v")
def a27(spark, d):
    return stats.mode(table(spark, d, "lineitem"), "l_linenumber", "l_returnflag")


@add("a28_mean_abs_dimension", "SELECT CAST(i - 1 AS INT) dim, round(avg(abs(CAST(v AS DOUBLE))), 6) mean_abs FROM (SELECT unnest(embedding) v, generate_subscripts(embedding, 1) i FROM embeddings) GROUP BY 1")
def a28(spark, d):
    return stats.mean_abs_by_dimension(table(spark, d, "embeddings"), "embedding")


@add("a29_dimension_total", "SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 4) total FROM embeddings")
def a29(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double")), 4).alias("total"))


@add("a30_spread_of_means", "WITH g AS (SELECT user_id, avg(value) v FROM events GROUP BY 1) SELECT round(var_pop(v), 6) variance, round(max(v) - min(v), 6) spread FROM g")
def a30(spark, d):
    g = table(spark, d, "events").groupBy("user_id").agg(F.avg("value").alias("v"))
    return g.agg(F.round(F.var_pop("v"), 6).alias("variance"), F.round(F.max("v") - F.min("v"), 6).alias("spread"))


@add("a31_pivot_mean", "SELECT l_returnflag, round(avg(l_quantity) FILTER (WHERE l_linestatus = 'O'), 4) o, round(avg(l_quantity) FILTER (WHERE l_linestatus = 'F'), 4) f FROM lineitem GROUP BY 1")
def a31(spark, d):
    t = table(spark, d, "lineitem").groupBy("l_returnflag").pivot("l_linestatus", ["O", "F"]).agg(F.avg("l_quantity"))
    return t.select("l_returnflag", F.round("O", 4).alias("o"), F.round("F", 4).alias("f"))


@add("a32_describe", "SELECT count(value) n, round(avg(value), 4) mean, round(stddev_samp(value), 4) sd, min(value) least, round(quantile_cont(value, 0.25), 4) q1, round(quantile_cont(value, 0.5), 4) median, round(quantile_cont(value, 0.75), 4) q3, max(value) most FROM events")
def a32(spark, d):
    e = table(spark, d, "events")
    a = e.agg(F.count("value").alias("n"), F.round(F.avg("value"), 4).alias("mean"), F.round(F.stddev_samp("value"), 4).alias("sd"), F.min("value").alias("least"), F.max("value").alias("most"))
    return a.crossJoin(F.broadcast(stats.quartiles(e, "value")))  # one row each


@add("a33_stratified_outcome", "WITH c AS (SELECT s, p, f FROM (SELECT DISTINCT c_mktsegment s FROM customer), (SELECT DISTINCT o_orderpriority p FROM orders), (SELECT unnest(['short', 'long']) f)), o AS (SELECT c_mktsegment s, o_orderpriority p, CASE WHEN o_totalprice <= 400 THEN 'short' ELSE 'long' END f, CAST(o_orderstatus = 'F' AS INT) y FROM orders JOIN customer ON c_custkey = o_custkey) SELECT s, p, f, count(y) n, round(avg(y) * 100, 4) rate FROM c LEFT JOIN o USING (s, p, f) GROUP BY ALL")
def a33(spark, d):
    """Every cell of the cross product; an empty one has n 0 and no rate."""
    c, o = table(spark, d, "customer"), table(spark, d, "orders")
    j = o.join(c, F.col("c_custkey") == F.col("o_custkey")).select(F.col("c_mktsegment").alias("s"), F.col("o_orderpriority").alias("p"), F.when(F.col("o_totalprice") <= 400, "short").otherwise("long").alias("f"), (F.col("o_orderstatus") == "F").cast("int").alias("y"))
    a = j.groupBy("s", "p", "f").agg(F.count("y").alias("n"), F.round(F.avg("y") * 100, 4).alias("rate"))
    cells = c.select(F.col("c_mktsegment").alias("s")).distinct().crossJoin(o.select(F.col("o_orderpriority").alias("p")).distinct()).select("s", "p", F.explode(F.array(F.lit("short"), F.lit("long"))).alias("f"))  # distinct dimension values
    return cells.join(a, ["s", "p", "f"], "left").select("s", "p", "f", F.coalesce("n", F.lit(0)).alias("n"), "rate")


@add("a34_row_sum", "SELECT l_orderkey, l_linenumber, round(l_quantity + l_extendedprice + l_discount + l_tax, 4) total FROM lineitem")
def a34(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(F.aggregate(F.array("l_quantity", "l_extendedprice", "l_discount", "l_tax"), F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


# ---------------------------------------------------------------- W, O: windows, sorts, top-k


@add("w1_clean_groups", f"WITH {ONCE} SELECT id FROM (SELECT id, min(coalesce(is_clean_label, 1)) OVER (PARTITION BY dup_group) c FROM m WHERE dup_group IS NOT NULL) WHERE c = 1")
def w1(spark, d):
    """Rows whose whole group is clean: the group's minimum joined back, so a hot group is no one task's window."""
    m = messages(spark, d, "dup_group", "is_clean_label").where("dup_group is not null")
    bad = m.where("is_clean_label = 0").select("dup_group").distinct()
    return m.join(bad, "dup_group", "left_anti").select("id")


@add("w2_first_seen_rank", "SELECT o_custkey, row_number() OVER (ORDER BY f) rank FROM (SELECT o_custkey, min(o_orderkey) f FROM orders GROUP BY 1)")
def w2(spark, d):
    f = table(spark, d, "orders").groupBy("o_custkey").agg(F.min("o_orderkey").alias("f"))
    return first_seen_ids(f, "f", "rank").select("o_custkey", "rank")


@add("w3_recall_threshold", f"WITH {SCORED}, p AS (SELECT score, row_number() OVER (ORDER BY score) - 1 k, count(*) OVER () n FROM s WHERE y = 1) SELECT score threshold FROM p WHERE k = least(greatest(floor((1 - CAST(0.95 AS DOUBLE)) * n), 0), n - 1)")
def w3(spark, d):
    return metrics.recall_threshold(scored(spark, d), "y", "score", 0.95)


@add("w4_cumulative_sweep", f"WITH {SCORED}, g AS (SELECT score s, count(*) FILTER (WHERE y = 1) pos, count(*) FILTER (WHERE y <> 1) neg FROM s GROUP BY 1) SELECT s, pos, neg, CAST(sum(pos) OVER w AS BIGINT) cum_pos, CAST(sum(neg) OVER w AS BIGINT) cum_neg FROM g WINDOW w AS (ORDER BY s DESC)")
def w4(spark, d):
    return metrics.running(metrics.score_groups(scored(spark, d), "y", "score"), ["pos", "neg"], descending=True).select("s", "pos", "neg", "cum_pos", "cum_neg")


@add("w5_top_k_per_bucket", "SELECT o_orderpriority, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) rn FROM orders) WHERE rn <= 3")
def w5(spark, d):
    w = Window.partitionBy("o_orderpriority").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return table(spark, d, "orders").withColumn("rn", F.row_number().over(w)).where("rn <= 3").select("o_orderpriority", "o_orderkey")


@add("o1_hardest_negatives", f"WITH {SCORED} SELECT id, score FROM s WHERE y = 0 ORDER BY score DESC, id LIMIT 25")
def o1(spark, d):
    return scored(spark, d).where("y = 0").orderBy(F.desc("score"), "id").limit(25).select("id", "score")


@add("o2_arg_max", "SELECT c_mktsegment, arg_max(c_custkey, c_acctbal * 1e6 - c_custkey / 1e6) best FROM customer GROUP BY 1")
def o2(spark, d):
    return table(spark, d, "customer").groupBy("c_mktsegment").agg(F.max_by("c_custkey", F.struct("c_acctbal", -F.col("c_custkey"))).alias("best"))


SQL["o2_arg_max"] = "SELECT DISTINCT ON (c_mktsegment) c_mktsegment, c_custkey best FROM customer ORDER BY c_mktsegment, c_acctbal DESC, c_custkey"


@add("o3_head", "SELECT doc_id, lang FROM documents ORDER BY doc_id LIMIT 40")
def o3(spark, d):
    return table(spark, d, "documents").orderBy("doc_id").limit(40).select("doc_id", "lang")


@add("o4_numeric_sort", "SELECT id, row_number() OVER (ORDER BY coalesce(try_cast(sid AS BIGINT), 0), id) place FROM (SELECT row_id id, source_id sid FROM source_rows) ORDER BY 2 LIMIT 50")
def o4(spark, d):
    t = table(spark, d, "source_rows").select(F.col("row_id").alias("id"), F.expr("coalesce(try_cast(source_id as bigint), 0)").alias("n")).orderBy("n", "id").limit(50)
    return t.select("id", F.row_number().over(Window.orderBy("n", "id")).alias("place"))


@add("o5_length_batches", "SELECT doc_id, CAST((row_number() OVER (ORDER BY length(text) DESC, doc_id) - 1) // 64 AS BIGINT) batch FROM documents WHERE text IS NOT NULL")
def o5(spark, d):
    """Batches of texts of like length, longest first."""
    return sampling.length_batches(table(spark, d, "documents"), "doc_id", "text", 64)


_CURVE = f"{SCORED}, t AS (SELECT CAST(range AS DOUBLE) t FROM range(0, 60)), c AS (SELECT t threshold, round(count(*) FILTER (WHERE y = 1 AND score >= t) / greatest(count(*) FILTER (WHERE y = 1), 1), 6) recall, round(count(*) FILTER (WHERE y <> 1 AND score < t) / greatest(count(*) FILTER (WHERE y <> 1), 1), 6) specificity FROM t, s GROUP BY t)"


@add("o6_operating_points", f"WITH {_CURVE} SELECT DISTINCT ON (target) target, threshold, recall, specificity FROM c, (SELECT unnest([CAST(0.9 AS DOUBLE), CAST(0.95 AS DOUBLE), CAST(0.99 AS DOUBLE)]) target) WHERE recall >= target ORDER BY target, specificity DESC, threshold")
def o6(spark, d):
    curve = metrics.sweep(scored(spark, d), "y", "score", spark.range(60).select(F.col("id").alias("t")))
    return metrics.best_points(curve, [0.9, 0.95, 0.99])


@add("o7_first_reaching", f"WITH {_CURVE} SELECT min(threshold) AS first FROM c WHERE specificity >= CAST(0.5 AS DOUBLE)")
def o7(spark, d):
    curve = metrics.rates(metrics.sweep(scored(spark, d), "y", "score", spark.range(60).select(F.col("id").alias("t"))))
    return curve.where("specificity >= 0.5d").agg(F.min("threshold").alias("first"))


# ---------------------------------------------------------------- R: sampling and splits

_BUCKET = lambda seed, key, n: f"CAST(CAST('0x' || substr(md5('{seed}:' || {key}), 1, 8) AS BIGINT) % {n} AS BIGINT)"


@add("r1_group_folds", f"WITH {ONCE}, g AS (SELECT dup_group, min(CASE WHEN is_clean_label = 0 THEN 0 ELSE 1 END) c, max(CASE WHEN scam = 1 THEN 1 ELSE 0 END) p FROM m WHERE dup_group IS NOT NULL GROUP BY 1), f AS (SELECT dup_group, c, ({_BUCKET(200, 'p || chr(124) || dup_group', 1 << 30)}) % 5 fold FROM g) SELECT m.id, CASE WHEN c <> 1 THEN 'train' WHEN fold = 0 THEN 'test' WHEN fold = 1 THEN 'val' ELSE 'train' END new_split FROM m JOIN f USING (dup_group)")
def r1(spark, d):
    m = messages(spark, d, "dup_group", "is_clean_label", "scam").where("dup_group is not null")
    clean = F.coalesce(F.col("is_clean_label") != 0, F.lit(True))
    return sampling.group_folds(m, "dup_group", clean, F.coalesce(F.col("scam") == 1, F.lit(False)), 200).select("id", F.col("split").alias("new_split"))


@add("r2_stratified_rows", f"WITH {ONCE}, k AS (SELECT id, label, row_number() OVER (PARTITION BY label ORDER BY md5('3:' || id), id) rn, count(*) OVER (PARTITION BY label) n FROM m) SELECT id, CASE WHEN rn <= ceil(n * 0.75) THEN 'train' ELSE 'test' END part FROM k")
def r2(spark, d):
    """75/25 in each label.  The strata are numbered by hash ranges, not one window per label."""
    m = messages(spark, d, "label").withColumn("h", sampling.order_key(3, "id"))
    m = m.withColumns({"k": F.coalesce("label", F.lit("\x00")), "r": F.substring("h", 1, 3)})
    per = m.groupBy("k", "r").agg(F.count(F.lit(1)).alias("c"))
    before = per.select("k", "r", (F.sum("c").over(Window.partitionBy("k").orderBy("r")) - F.col("c")).alias("b"), F.sum("c").over(Window.partitionBy("k")).alias("n"))
    rn = F.col("b") + F.row_number().over(Window.partitionBy("k", "r").orderBy("h", "id"))
    out = m.join(before, ["k", "r"]).withColumn("rn", rn)
    return out.select("id", F.when(F.col("rn") <= F.ceil(F.col("n") * 0.75), "train").otherwise("test").alias("part"))


@add("r3_random_sample", "SELECT doc_id FROM documents ORDER BY md5('9:' || doc_id), doc_id LIMIT 100")
def r3(spark, d):
    return sampling.sample(table(spark, d, "documents"), "doc_id", 100, 9).select("doc_id")


@add("r4_per_stratum_sample", "WITH k AS (SELECT doc_id, lang, source, row_number() OVER (PARTITION BY lang, source ORDER BY md5('4:' || doc_id), doc_id) rn, count(*) OVER (PARTITION BY lang, source) n FROM documents) SELECT doc_id FROM k WHERE rn <= least(n, greatest(2, n // 12))")
def r4(spark, d):
    t = table(spark, d, "documents").select("doc_id", F.coalesce("lang", F.lit("\x00")).alias("lang"), F.coalesce("source", F.lit("\x00")).alias("source"))
    both = t.join(t.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n")), ["lang", "source"])
    return sampling.per_stratum(both, ["lang", "source"], "doc_id", F.least("n", F.greatest(F.lit(2), F.floor(F.col("n") / 12))), 4).select("doc_id")


@add("r5_shuffle", "SELECT item_id, row_number() OVER (ORDER BY md5('8:' || item_id), item_id) place FROM eval_items")
def r5(spark, d):
    """A presentation order for a hand-labelled set (a fixed, small table)."""
    return table(spark, d, "eval_items").select("item_id", F.row_number().over(Window.orderBy(sampling.order_key(8, "item_id"), "item_id")).alias("place"))


@add("r6_quota_sample", SQL["j11_padded_quota"] + " WHERE id IS NOT NULL")
def r6(spark, d):
    plan = spark.createDataFrame(PLAN, "bucket string, n int")
    return sampling.quota(messages(spark, d, "scam_type"), "scam_type", plan, "id", 5).where("needs_sourcing = 0")


_CUTS = [0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.999916758850712, 0.9999897508033253]


@add("r7_resample", f"WITH {ONCE}, u AS (SELECT id, ({_BUCKET(31, 'id', 1 << 24)} + CAST(0.5 AS DOUBLE)) / {1 << 24} u FROM m) SELECT id, " + " + ".join(f"CAST(u > CAST({c!r} AS DOUBLE) AS INT)" for c in _CUTS) + " AS times FROM u")
def r7(spark, d):
    """A resample with replacement: how often each row is drawn (Poisson(1), by hash)."""
    return messages(spark, d, "text").select("id", metrics.poisson_weight(sampling.uniform(31, F.col("id"))).alias("times"))


@add("r8_resume", f"WITH {ONCE} SELECT id FROM m WHERE scam = 0 AND id NOT IN (SELECT report_id FROM smishtank_reports)")
def r8(spark, d):
    done = table(spark, d, "smishtank_reports").select(F.col("report_id").alias("id"))
    return messages(spark, d, "scam").where("scam = 0").join(done, "id", "left_anti").select("id")


# ---------------------------------------------------------------- F: functions


@add("f1_has_url", f"SELECT row_id, {HAS_URL('text')} has_url FROM source_rows WHERE text IS NOT NULL")
def f1(spark, d):
    return table(spark, d, "source_rows").where("text is not null").select("row_id", T.has_url(F.col("text")).cast("int").alias("has_url"))


_URLS = lambda c: f"list_transform(list_zip(regexp_extract_all({c}, '(?i){URL_PARTS}', 1), regexp_extract_all({c}, '(?i){URL_PARTS}', 2)), lambda x: {{'p': coalesce(x[1], ''), 'h': rtrim(lower(x[2]), '.')}})"
_IN = lambda xs: "(" + ", ".join(q(x) for x in xs) + ")"
_DOMAINS = lambda c: rf"list_transform(list_filter({_URLS(c)}, lambda x: contains(x.h, '.') AND NOT regexp_full_match(replace(x.h, '.', ''), '\p{{Nd}}*') AND (x.p <> '' OR regexp_extract(x.h, '[^.]*$') IN {_IN(KNOWN_TLDS)})), lambda x: x.h)"


@add("f2_urls", f"SELECT row_id, array_to_string(list_transform({_URLS('text')}, lambda x: x.p || x.h), ' ') urls FROM source_rows WHERE text IS NOT NULL")
def f2(spark, d):
    return table(spark, d, "source_rows").where("text is not null").select("row_id", F.array_join(F.transform(T.urls(F.col("text")), lambda x: F.concat(x["prefix"], x["host"])), " ").alias("urls"))


@add("f3_domains", f"SELECT row_id, array_to_string({_DOMAINS('text')}, ' ') domains FROM source_rows WHERE text IS NOT NULL")
def f3(spark, d):
    return table(spark, d, "source_rows").where("text is not null").select("row_id", F.array_join(T.domains(F.col("text"), KNOWN_TLDS), " ").alias("domains"))


@add("f4_registrable", "SELECT DISTINCT domain, array_to_string(list_slice(string_split(domain, '.'), -2, -1), '.') registrable FROM smishtank_reports WHERE domain IS NOT NULL")
def f4(spark, d):
    return table(spark, d, "smishtank_reports").where("domain is not null").select("domain", T.registrable(F.col("domain")).alias("registrable")).distinct()


@add("f5_substring_count", "SELECT doc_id, CAST((length(text) - length(replace(text, 'the', ''))) / 3 AS INT) n FROM documents WHERE text IS NOT NULL")
def f5(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", T.count_of(F.col("text"), "the").alias("n"))


@add("f6_keyword_flags", "SELECT row_id, " + ", ".join(f"CAST(contains(lower(coalesce(text, '')), {q(k)}) AS INT) {c}" for k, c in zip(KEYWORDS, X.KEYWORD_COLUMNS)) + " FROM source_rows")
def f6(spark, d):
    return X.with_keywords(table(spark, d, "source_rows").select("row_id", "text")).drop("text")


@add("f7_keyword_columns", "SELECT unnest([" + ", ".join(q(k) for k in KEYWORDS) + "]) keyword, unnest([" + ", ".join(q(c) for c in X.KEYWORD_COLUMNS) + "]) name")
def f7(spark, d):
    return spark.createDataFrame([(k, T.slug_column(k)) for k in KEYWORDS], "keyword string, name string")


@add("f8_brand_key", "SELECT DISTINCT brand, regexp_replace(lower(brand), '[^a-z0-9]+', '', 'g') k FROM smishtank_reports WHERE brand IS NOT NULL")
def f8(spark, d):
    return table(spark, d, "smishtank_reports").where("brand is not null").select("brand", T.brand_key(F.col("brand")).alias("k")).distinct()


@add("f9_iso_date", r"SELECT DISTINCT report_id, CASE WHEN regexp_matches(timereceived, '^\d{2}/\d{2}/\d{4}') THEN strftime(try_strptime(substr(timereceived, 1, 10), '%m/%d/%Y'), '%Y-%m-%d') END AS day FROM smishtank_reports")
def f9(spark, d):
    return table(spark, d, "smishtank_reports").select("report_id", T.iso_date(F.col("timereceived")).cast("string").alias("day")).distinct()


@add("f10_slug", "SELECT term_id, lower(replace(name, ' ', '-')) || '-' || lpad(CAST(term_id AS VARCHAR), 3, '0') slug FROM canon_terms")
def f10(spark, d):
    return table(spark, d, "canon_terms").select("term_id", F.concat(F.lower(F.replace("name", F.lit(" "), F.lit("-"))), F.lit("-"), F.lpad(F.col("term_id").cast("string"), 3, "0")).alias("slug"))


@add("f11_point_zero", r"SELECT c_custkey, regexp_replace(CAST(c_custkey AS VARCHAR) || '.0', '\.0$', '') id FROM customer")
def f11(spark, d):
    return table(spark, d, "customer").select("c_custkey", T.without_point_zero(F.concat(F.col("c_custkey").cast("string"), F.lit(".0"))).alias("id"))


@add("f12_json_from_text", "SELECT event_id, json_extract_string(props, '$.' || json_keys(props)[1]) first FROM events WHERE props IS NOT NULL")
def f12(spark, d):
    reply = F.concat(F.lit("Sure: "), F.col("props"), F.lit(" -- done"))
    m = F.from_json(T.json_object(reply), "map<string,string>")
    return table(spark, d, "events").where("props is not null").select("event_id", F.element_at(m, F.get(F.map_keys(m), F.lit(0))).alias("first"))


_SNAP = "coalesce(list_filter([" + ", ".join(q(t) for t in TYPES) + "], lambda t: lower(t) = lower(trim(v)))[1], list_filter([" + ", ".join(q(t) for t in TYPES) + "], lambda t: trim(v) <> '' AND (contains(lower(trim(v)), lower(t)) OR contains(lower(t), lower(trim(v)))))[1], 'other')"


@add("f13_snap", f"SELECT v, {_SNAP} type FROM (SELECT DISTINCT scam_type v FROM smishtank_reports WHERE scam_type IS NOT NULL)")
def f13(spark, d):
    return table(spark, d, "smishtank_reports").where("scam_type is not null").select(F.col("scam_type").alias("v"), T.snap(F.col("scam_type"), TYPES, "other").alias("type")).distinct()


@add("f14_truncate", "SELECT doc_id, substr(text, 1, 300) head FROM documents")
def f14(spark, d):
    return table(spark, d, "documents").select("doc_id", F.substring("text", 1, 300).alias("head"))


@add("f15_template_fill", "SELECT item_id, 'Type of: ' || text || chr(10) || 'A) yes' || chr(10) || 'B) no' prompt FROM eval_items")
def f15(spark, d):
    return table(spark, d, "eval_items").select("item_id", F.format_string("Type of: %s\nA) yes\nB) no", F.col("text")).alias("prompt"))


@add("f16_half_even", "SELECT p_partkey, CAST(round_even(CAST(p_size AS DOUBLE) / 8, 2) AS DOUBLE) r FROM part")
def f16(spark, d):
    return table(spark, d, "part").select("p_partkey", F.bround((F.col("p_size").cast("decimal(10,0)") / F.lit(8).cast("decimal(10,0)")), 2).cast("double").alias("r"))


@add("f17_argmax_softmax", "WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) v FROM embeddings) SELECT vec_id, CAST(list_position(v, list_max(v)) AS BIGINT) best, round(1 / list_sum(list_transform(v, lambda x: exp(x - list_max(v)))), 6) p FROM e")
def f17(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v")).withColumn("m", F.array_max("v"))
    total = F.aggregate("v", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("m")))
    return e.select("vec_id", F.array_position("v", F.col("m")).alias("best"), F.round(1 / total, 6).alias("p"))


@add("f18_wordpiece")
def f18(spark, d):
    """Token counts of whole texts against a toy vocabulary; exact ids and the cut are tested."""
    vocab = {w: i for i, w in enumerate(["[PAD]", "[UNK]", "[CLS]", "[SEP]", *"abcdefghijklmnopqrstuvwxyz0123456789", *[f"##{c}" for c in "abcdefghijklmnopqrstuvwxyz0123456789"]])}
    return table(spark, d, "documents").select("doc_id", F.size(wordpiece(F.col("text"), vocab, limit=None)).alias("n"))


@add("f19_unit_length", "SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))), 4) norm FROM embeddings")
def f19(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.round(F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))), 4).alias("norm"))


@add("f20_assemble", "SELECT l_orderkey, l_linenumber, CAST(4 AS INT) n, round(l_quantity + 2 * l_extendedprice + 3 * l_discount + 4 * l_tax, 4) weighted FROM lineitem")
def f20(spark, d):
    """Columns as a vector in the given order: its size and its product with 1, 2, 3, 4."""
    v = models.assemble(table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])
    a = models.vector_to_array("features")
    return v.select("l_orderkey", "l_linenumber", F.size(a).alias("n"), F.round(a[0] + 2 * a[1] + 3 * a[2] + 4 * a[3], 4).alias("weighted"))


def _features_sql() -> str:
    cnt = lambda s, rx: f"len(regexp_extract_all({s}, '{rx}'))"
    spaces = r"\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
    cols = {
        "has_url": HAS_URL("t"), "n_urls": "CAST(len(d) AS INT)",
        "has_shortener": f"CAST(len(list_filter(d, lambda x: array_to_string(list_slice(string_split(x, '.'), -2, -1), '.') IN {_IN(SHORTENERS)})) > 0 AS INT)",
        "suspicious_tld": f"CAST(len(list_filter(d, lambda x: regexp_extract(x, '[^.]*$') IN {_IN(SUSPICIOUS_TLDS)})) > 0 AS INT)",
        "ip_as_domain": r"CAST(regexp_matches(t, '(^|[^\p{L}\p{N}_])(\p{Nd}{1,3}\.){3}\p{Nd}{1,3}([^\p{L}\p{N}_]|$)') AND len(d) > 0 AS INT)",
        "url_digit_ratio": "round(CASE WHEN len(d) > 0 THEN " + cnt("al", r"\p{Nd}") + " / greatest(length(al), 1) ELSE 0 END, 6)",
        "domain_len_max": "CAST(coalesce(list_max(list_transform(d, lambda x: length(x))), 0) AS INT)",
        "brand_domain_mismatch": "CAST(len(named) > 0 AND len(d) > 0 AND len(list_filter(d, lambda x: len(list_filter(named, lambda b: contains(replace(replace(x, '.', ''), '-', ''), b))) > 0)) = 0 AS INT)",
    }
    for f, terms in FAMILIES.items():
        s = " + ".join(f"CAST((length(low) - length(replace(low, {q(x)}, ''))) / {len(x)} AS INT)" for x in terms)
        cols |= {f"{f}_n": f"({s})", f"{f}_hit": f"CAST(({s}) > 0 AS INT)"}
    cols |= {
        "length": "CAST(length(t) AS INT)", "n_words": "CAST(len(w) AS INT)",
        "capital_ratio": f"round({cnt('t', chr(92) + 'p{Lu}')} / greatest({cnt('t', chr(92) + 'p{L}')}, 1), 6)", "digit_ratio": f"round({cnt('t', chr(92) + 'p{Nd}')} / greatest(length(t), 1), 6)",
        "punct_ratio": f"round({cnt('t', '[^' + chr(92) + 'p{L}' + chr(92) + 'p{N}' + spaces + ']')} / greatest(length(t), 1), 6)",
        "n_exclaim": "CAST(length(t) - length(replace(t, '!', '')) AS INT)",
        "n_allcaps_words": r"CAST(len(list_filter(w, lambda x: length(x) > 2 AND regexp_matches(x, '\p{Lu}') AND NOT regexp_matches(x, '[\p{Ll}\p{Lt}]'))) AS INT)",
        "has_leetspeak": r"CAST(regexp_matches(t, '(?i)(^|[^\p{L}\p{N}_])[a-z]+[0-9]+[a-z]+([^\p{L}\p{N}_]|$)') AS INT)",
        "avg_word_len": "round(CASE WHEN len(w) > 0 THEN length(array_to_string(w, '')) / len(w) ELSE 0 END, 6)",
    }
    brands = "[" + ", ".join(q(b) for b in MISMATCH_BRANDS) + "]"
    base = f"a AS (SELECT row_id, coalesce(text, '') t FROM source_rows), b AS (SELECT *, lower(t) low, {_DOMAINS('t')} d, regexp_extract_all(t, '{WORDS}+') w FROM a), c AS (SELECT *, array_to_string(d, '') al, list_filter({brands}, lambda x: contains(regexp_replace(low, '[^a-z0-9]', '', 'g'), x)) named FROM b)"
    return f"WITH {base} SELECT row_id, " + ", ".join(f"{e} {n}" for n, e in cols.items()) + " FROM c"


@add("f29_features", _features_sql())
def f29(spark, d):
    f = X.with_features(table(spark, d, "source_rows").select("row_id", "text")).drop("text")
    return f.withColumns({c: F.round(c, 6) for c in ("url_digit_ratio", "capital_ratio", "digit_ratio", "punct_ratio", "avg_word_len")})


# ---------------------------------------------------------------- S: sources and sinks


@add("s1_binary_file", "SELECT DISTINCT source || '.txt' AS file, CAST(sum(strlen(coalesce(text, '')) + 1) OVER (PARTITION BY source) AS BIGINT) n FROM (SELECT lower(trim(source)) source, text FROM source_rows)")
def s1(spark, d):
    """Whole files as bytes: the texts of each source, written as files of a folder per source, read back."""
    path = files.scratch(spark, "binary")
    table(spark, d, "source_rows").select(F.lower(F.trim("source")).alias("source"), F.coalesce("text", F.lit("")).alias("value")).write.partitionBy("source").text(path)
    b = archives.binary_files(spark, f"{path}/*/*.txt")
    name = F.url_decode(F.regexp_extract("path", "source=([^/]*)/", 1))
    return b.groupBy(F.concat(name, F.lit(".txt")).alias("file")).agg(F.sum(F.length("content")).alias("n"))


def _zipped(rows: DataFrame, inner: bool = False) -> DataFrame:
    """One archive of a CSV per source, as ``(path, content)``: input for the archive readers."""

    def pack(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        data, name = pdf[["row_id", "text"]].to_csv(index=False).encode(), "rows.csv"
        for level in range(1 + inner):
            buffer = io.BytesIO()
            with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
                z.writestr(zipfile.ZipInfo(name), data)
            data, name = buffer.getvalue(), "inner.zip"
        return pd.DataFrame({"path": [f"{key[0]}-{key[1]}.zip"], "content": [data]})

    return rows.select("row_id", "text", F.lower(F.trim("source")).alias("source"), F.pmod(F.xxhash64("row_id"), F.lit(16)).alias("part")).groupBy("source", "part").applyInPandas(pack, "path string, content binary")


def _csv_rows(content: DataFrame) -> DataFrame:
    def parse(batches):
        for b in batches:
            for text in b["text"]:
                yield pd.read_csv(io.StringIO(text), dtype={"row_id": "int64", "text": "string"}, keep_default_na=False)

    return content.select(archives.decode("content").alias("text")).mapInPandas(parse, "row_id long, text string")


@add("s2_zip_member", "SELECT row_id, coalesce(text, '') AS text FROM source_rows")
def s2(spark, d):
    return _csv_rows(archives.members(_zipped(table(spark, d, "source_rows")), "rows.csv"))


@add("s3_nested_zip", "SELECT row_id, coalesce(text, '') AS text FROM source_rows")
def s3(spark, d):
    return _csv_rows(archives.members(_zipped(table(spark, d, "source_rows"), inner=True), "inner.zip", "rows.csv"))


@add("s4_unpack_once", "SELECT r_regionkey, r_name FROM region")
def s4(spark, d):
    path = files.scratch(spark, "once")
    archives.unpack_once(table(spark, d, "region"), path)
    archives.unpack_once(table(spark, d, "region").limit(0), path)
    return spark.read.parquet(path).select("r_regionkey", "r_name")


@add("s5_decode", "SELECT row_id, text FROM source_rows WHERE text IS NOT NULL")
def s5(spark, d):
    b = table(spark, d, "source_rows").where("text is not null").select("row_id", F.encode("text", "UTF-8").alias("content"))
    return b.select("row_id", archives.decode("content").alias("text"))


@add("s6_csv", "SELECT row_id, coalesce(text, '') AS text FROM source_rows")
def s6(spark, d):
    """Texts with line breaks and quotes through a CSV and back."""
    path = files.scratch(spark, "csv")
    files.write_csv(table(spark, d, "source_rows"), path, ["row_id", "text"])
    return files.read_csv(spark, path, "row_id long, text string")


@add("s7_tab_separated", "SELECT lower(trim(spam_label)) label, replace(replace(replace(text, chr(10), ' '), chr(9), ' '), chr(13), ' ') AS text FROM source_rows WHERE lower(trim(source)) = 'uci sms spam collection' AND lower(trim(spam_label)) IN ('ham', 'spam', 'smishing') AND text IS NOT NULL")
def s7(spark, d):
    path = files.scratch(spark, "tsv")
    s = table(spark, d, "source_rows").where("lower(trim(source)) = 'uci sms spam collection' and text is not null")
    s.select(F.concat_ws("\t", F.coalesce("spam_label", F.lit("?")), F.translate("text", "\n\t\r", "   "))).write.text(path)
    return files.tab_separated(spark.read.text(path, lineSep="\n"), ["ham", "spam", "smishing"])


@add("s8_nested_json", "SELECT CAST(row_id AS VARCHAR) id, text FROM source_rows WHERE lower(trim(source)) = 'nus sms corpus' AND text IS NOT NULL")
def s8(spark, d):
    """Messages whose text is an object in one half and a scalar in the other."""
    s = table(spark, d, "source_rows").where("lower(trim(source)) = 'nus sms corpus' and text is not null")
    one = F.when(F.col("row_id") % 2 == 0, F.to_json(F.struct(F.col("row_id").cast("string").alias("@id"), F.struct(F.col("text").alias("$")).alias("text")))).otherwise(F.to_json(F.struct(F.col("row_id").cast("string").alias("@id"), "text")))
    docs = s.groupBy(F.floor(F.col("row_id") / 500).alias("k")).agg(F.concat(F.lit('{"smsCorpus": {"message": ['), F.array_join(F.collect_list(one), ","), F.lit("]}}")).alias("j"))
    return files.json_messages(docs, "j")


@add("s9_blanks_kept", "SELECT report_id, coalesce(brand, '') brand FROM smishtank_reports")
def s9(spark, d):
    path = files.scratch(spark, "csv")
    files.write_csv(table(spark, d, "smishtank_reports"), path, ["report_id", "brand"])
    return files.read_csv(spark, path, "report_id long, brand string")


@add("s10_all_strings", "SELECT CAST(member_id AS VARCHAR) member_id, coalesce(spam_label, '') spam_label FROM group_members")
def s10(spark, d):
    path = files.scratch(spark, "csv")
    files.write_csv(table(spark, d, "group_members"), path, ["member_id", "spam_label"])
    return files.read_csv(spark, path, "member_id string, spam_label string")


@add("s11_missing_tokens", "SELECT member_id, CASE WHEN spam_label NOT IN ('', ' ', 'NaN', 'nan') THEN spam_label END spam_label FROM group_members")
def s11(spark, d):
    return files.unknown_as_null(table(spark, d, "group_members").select("member_id", "spam_label"))


@add("s12_parquet", "SELECT event_id, value FROM events")
def s12(spark, d):
    path = files.scratch(spark, "parquet")
    table(spark, d, "events").write.parquet(path)
    return spark.read.parquet(path).select("event_id", "value")


@add("s13_columns", "SELECT id, text FROM messages")
def s13(spark, d):
    return table(spark, d, "messages").select("id", "text")


@add("s14_aligned_vectors", "SELECT vec_id, len(embedding) n FROM embeddings")
def s14(spark, d):
    e = table(spark, d, "embeddings")
    return files.aligned_vectors(e.select("vec_id"), e, "vec_id", "embedding").select("vec_id", F.size("embedding").cast("long").alias("n"))


@add("s15_vector_cache", "SELECT vec_id, label FROM embeddings")
def s15(spark, d):
    path = files.scratch(spark, "vectors")
    table(spark, d, "embeddings").write.parquet(path)
    return spark.read.parquet(path).select("vec_id", "label")


@add("s16_csv_sink", "SELECT n_name, n_nationkey FROM nation")
def s16(spark, d):
    path = files.scratch(spark, "csv")
    files.write_csv(table(spark, d, "nation").coalesce(1), path, ["n_name", "n_nationkey"])
    return files.read_csv(spark, path, "n_name string, n_nationkey int")


@add("s17_append", "SELECT n_nationkey FROM nation UNION ALL SELECT n_nationkey FROM nation WHERE n_regionkey = 1")
def s17(spark, d):
    path, n = files.scratch(spark, "append"), table(spark, d, "nation")
    n.write.mode("append").parquet(path)
    n.where("n_regionkey = 1").write.mode("append").parquet(path)
    return spark.read.parquet(path).select("n_nationkey")


@add("s18_swap", "SELECT n_nationkey, n_regionkey + 1 n_regionkey FROM nation")
def s18(spark, d):
    path = files.swap(table(spark, d, "nation"), files.scratch(spark, "swap"))
    return spark.read.parquet(files.swap(spark.read.parquet(path).withColumn("n_regionkey", F.col("n_regionkey") + 1), path)).select("n_nationkey", "n_regionkey")


@add("s19_upsert", "SELECT c_custkey, CASE WHEN c_nationkey = 3 THEN 0 ELSE c_acctbal END c_acctbal FROM customer")
def s19(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_acctbal", "c_nationkey")
    return files.upsert(c, c.where("c_nationkey = 3").withColumn("c_acctbal", F.lit(0.0)), ["c_custkey"]).select("c_custkey", "c_acctbal")


@add("s20_by_split", f"WITH {ONCE} SELECT id FROM m WHERE split = 'val'")
def s20(spark, d):
    path = files.scratch(spark, "split")
    files.by_split(messages(spark, d, "split").where("split is not null"), path)
    return spark.read.parquet(path).where("split = 'val'").select("id")


@add("s21_glob_scan", "SELECT lower(trim(source)) source, count(*) n FROM source_rows GROUP BY 1 HAVING NOT bool_or(row_id % 2 = 0 AND lower(trim(source)) LIKE '%sms%')")
def s21(spark, d):
    """Files behind a glob, without those that already carry an ``id``: rows per source still to do."""
    path = files.scratch(spark, "glob")
    rows = table(spark, d, "source_rows").select(F.lower(F.trim("source")).alias("source"), "row_id")
    done = rows.where("source like '%sms%'").groupBy("source").agg(F.max((F.col("row_id") % 2 == 0).cast("int")).alias("done")).where("done = 1").select("source")
    rows.join(done, "source", "left_semi").withColumn("id", F.col("row_id")).write.partitionBy("source").parquet(f"{path}/done")
    rows.join(done, "source", "left_anti").write.partitionBy("source").parquet(f"{path}/open")
    todo = files.without_column(spark, [f"{path}/done", f"{path}/open"], "id")
    return todo.groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@add("s22_header_by_content", "SELECT CAST(n_nationkey AS BIGINT) id, n_name name FROM nation")
def s22(spark, d):
    n = table(spark, d, "nation").select((F.col("n_nationkey") + 10).cast("long").alias("row"), F.array(F.col("n_nationkey").cast("string"), "n_name").alias("values"))
    top = spark.createDataFrame([(1, ["A sheet", ""]), (2, ["", ""]), (3, ["id", "name"])], "row long, values array<string>")
    rows = files.header_by_content(top.union(n), "row")
    return rows.select(F.col("values")[0].cast("long").alias("id"), F.col("values")[1].alias("name"))


@add("s23_json_rows", "SELECT r_regionkey, CAST(json_object('r_regionkey', r_regionkey, 'r_name', r_name) AS VARCHAR) j FROM region")
def s23(spark, d):
    return table(spark, d, "region").select("r_regionkey", files.to_json_rows(None, "r_regionkey", "r_name").alias("j"))


@add("s25_report", f"WITH {ONCE} SELECT 'rows' line, count(*) n FROM m UNION ALL SELECT 'label ' || label, count(*) FROM m WHERE label IS NOT NULL GROUP BY label UNION ALL SELECT 'source ' || source, count(*) FROM m WHERE source IS NOT NULL GROUP BY source")
def s25(spark, d):
    m = messages(spark, d, "label", "source")
    part = lambda c: m.where(F.col(c).isNotNull()).groupBy(F.concat(F.lit(f"{c} "), F.col(c)).alias("line")).agg(F.count(F.lit(1)).alias("n"))
    return m.agg(F.count(F.lit(1)).alias("n")).select(F.lit("rows").alias("line"), "n").union(part("label")).union(part("source"))


# ---------------------------------------------------------------- M: models


@add("m1_keyword_arm", f"WITH {ONCE} SELECT id, round({SCORE} / {len(KEYWORDS)}.0, 6) score FROM m")
def m1(spark, d):
    return messages(spark, d, "text").select("id", F.round(X.keyword_score(F.col("text")) / float(len(KEYWORDS)), 6).alias("score"))


def _labelled(spark, d):
    """Labelled messages, and the part of each: 3 is held out."""
    m = messages(spark, d, "text", "scam").where("scam is not null and text is not null").withColumn("y", F.col("scam").cast("int"))
    return m, sampling.bucket(13, F.col("id"), 4)


def _parts(spark, d):
    m, part = _labelled(spark, d)
    return m.where(part < 3), m.where(part == 3)


@add("m2_tfidf_arm")
def m2(spark, d):
    """Term weights fitted on training rows; the threshold for a recall of 0.95 too; metrics on the others.

    Words, vectors and scores are each written once: fitting and metrics read them again and again."""
    m, part = _labelled(spark, d)
    words = stage(m.select((part == 3).alias("held"), "y", models.tokens(F.col("text")).alias("words")), "words")
    rows = models.tfidf_fit(words.where("not held"))(words)
    head = models.head(rows.where("not held"), "tfidf")
    scored = stage(models.probability(head, rows).select("held", "y", "prob"), "scored")
    return models.arm_metrics("tfidf", scored.where("not held"), scored.where("held"), "y", "prob")


@add("m3_embedding_arm")
def m3(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", models.array_to_vector(F.col("embedding").cast("array<double>")).alias("features"), F.col("label").alias("y"))
    part = sampling.bucket(13, F.col("vec_id"), 4)
    out = models.head(e.where(part < 3)).transform(e.where(part == 3))
    return out.select((F.col("prediction") == F.col("y")).cast("int").alias("ok")).agg(F.count(F.lit(1)).alias("n"), F.sum("ok").alias("correct"))


@add("m4_feature_arm")
def m4(spark, d):
    train, test = (models.assemble(X.with_keywords(X.with_features(x)), X.FEATURES + X.KEYWORD_COLUMNS) for x in _parts(spark, d))
    return metrics.auc(models.probability(models.head(train), test), "y", "prob")


@add("m5_clean_training", f"WITH {ONCE} SELECT count(*) n FROM m WHERE coalesce(is_clean_label, 1) <> 0 AND lower(trim(split)) LIKE 'train%'")
def m5(spark, d):
    """The ablation's training rows: unclean ones dropped from training only."""
    return messages(spark, d, "is_clean_label", "split").where("coalesce(is_clean_label, 1) <> 0 and lower(trim(split)) like 'train%'").agg(F.count(F.lit(1)).alias("n"))


@add("m6_boosted_arm")
def m6(spark, d):
    train, test = (models.assemble(X.with_features(x), X.FEATURES) for x in _parts(spark, d))
    return metrics.auc(models.probability(models.boosted(train), test), "y", "prob")


@add("m7_perceptron_arm")
def m7(spark, d):
    train, test = (models.assemble(X.with_features(x), X.FEATURES) for x in _parts(spark, d))
    return metrics.auc(models.probability(models.perceptron(train, [len(X.FEATURES), 12, 2]), test), "y", "prob")


@add("m9_usable_classes", f"WITH {ONCE}, c AS (SELECT scam_type FROM m WHERE scam_type IS NOT NULL AND scam_type <> 'unsorted lure' GROUP BY 1 HAVING count(*) >= 10) SELECT id, scam_type FROM m WHERE scam_type IN (SELECT scam_type FROM c)")
def m9(spark, d):
    return models.usable_classes(messages(spark, d, "scam_type"), "scam_type", ["unsorted lure"]).select("id", "scam_type")


@add("m10_training_set", f"WITH {ONCE}, f AS (SELECT report_id, max(scam_type) fix FROM smishtank_reports WHERE coalesce(scam_type, '') <> '' GROUP BY 1) SELECT id, coalesce(fix, scam_type) type, CASE WHEN fix IS NOT NULL THEN 'corrected' ELSE 'mapped' END provenance FROM m LEFT JOIN f ON id = report_id WHERE scam = 1 AND coalesce(fix, scam_type, '') NOT IN ('', 'unsorted lure') UNION ALL SELECT * FROM (SELECT id, 'not a scam', 'ham' FROM m WHERE scam = 0 ORDER BY length(text) DESC, id LIMIT 50)")
def m10(spark, d):
    fix = table(spark, d, "smishtank_reports").where(F.coalesce("scam_type", F.lit("")) != "").groupBy(F.col("report_id").alias("id")).agg(F.max("scam_type").alias("fix"))
    m = messages(spark, d, "scam_type", "scam", "text")
    t = F.coalesce("fix", "scam_type")
    scam = m.where("scam = 1").join(fix, "id", "left").where(~F.coalesce(t, F.lit("")).isin("", "unsorted lure")).select("id", t.alias("type"), F.when(F.col("fix").isNotNull(), "corrected").otherwise("mapped").alias("provenance"))
    ham = m.where("scam = 0").orderBy(F.desc(F.length("text")), "id").limit(50).select("id", F.lit("not a scam"), F.lit("ham"))
    return scam.union(ham)


@add("m13_serving_equals_batch", f"WITH {ONCE} SELECT count(*) n, CAST(0 AS BIGINT) apart, CAST(0 AS BIGINT) flips FROM m")
def m13(spark, d):
    """The stored scores of a stream that serves messages one by one against the stored scores of the batch
    arm: rows apart in the third place, and verdicts that flip."""
    once = messages(spark, d, "text")
    batch, served, queue = files.scratch(spark, "batch"), files.scratch(spark, "served"), files.scratch(spark, "queue")
    m1(spark, d).write.parquet(batch)
    once.repartition(4).write.parquet(queue)
    stream = spark.readStream.schema(once.schema).option("maxFilesPerTrigger", 1).parquet(queue)
    streaming.run_once(streaming.scored(stream, 0.1).select("id", "prob", "flagged"), served, files.scratch(spark, "check"))
    both = joins.align(spark.read.parquet(batch), spark.read.parquet(served), "id")
    flip = (F.round("score", 3) >= 0.1).cast("int") != F.col("flagged")
    return both.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.abs(F.round("score", 3) - F.round("prob", 3)) > 0.0005, 1)).alias("apart"), F.count(F.when(flip, 1)).alias("flips"))


@add("m17_teacher_and_head", f"WITH {ONCE}, s AS (SELECT scam y, model_pred teacher, CAST(({SCORE}) >= 4 AS INT) head FROM m WHERE scam IS NOT NULL AND model_pred IS NOT NULL) SELECT count(*) n, count(*) FILTER (WHERE teacher = y) teacher_right, count(*) FILTER (WHERE head = y) head_right, count(*) FILTER (WHERE teacher = y AND head <> y) teacher_only, count(*) FILTER (WHERE head = y AND teacher <> y) head_only FROM s")
def m17(spark, d):
    """Two sets of predictions over identical rows."""
    m = messages(spark, d, "text", "scam", "model_pred").where("scam is not null and model_pred is not null")
    return metrics.paired(m.withColumn("head", (X.keyword_score(F.col("text")) >= 4).cast("int")), "scam", "model_pred", "head", "teacher", "head")


@add("m11_two_labelings", f"WITH {ONCE}, f AS (SELECT report_id, max(scam_type) fix FROM smishtank_reports WHERE coalesce(scam_type, '') <> '' GROUP BY 1), s AS (SELECT scam_type mapped, coalesce(fix, scam_type) corrected, CASE WHEN length(text) % 3 = 0 THEN 'work offer' ELSE scam_type END pred FROM m LEFT JOIN f ON id = report_id WHERE scam_type IS NOT NULL AND text IS NOT NULL) SELECT count(*) n, count(*) FILTER (WHERE pred = mapped) mapped_right, count(*) FILTER (WHERE pred = corrected) corrected_right, count(*) FILTER (WHERE pred = mapped AND pred <> corrected) mapped_only, count(*) FILTER (WHERE pred = corrected AND pred <> mapped) corrected_only FROM s")
def m11(spark, d):
    """The same predictions judged by two labelings of the same rows."""
    fix = table(spark, d, "smishtank_reports").where(F.coalesce("scam_type", F.lit("")) != "").groupBy(F.col("report_id").alias("id")).agg(F.max("scam_type").alias("fix"))
    m = messages(spark, d, "scam_type", "text").where("scam_type is not null and text is not null").join(fix, "id", "left")
    m = m.select(F.when(F.length("text") % 3 == 0, "work offer").otherwise(F.col("scam_type")).alias("pred"), F.col("scam_type").alias("mapped"), F.coalesce("fix", "scam_type").alias("corrected"))
    return metrics.paired(m, "pred", "mapped", "corrected", "mapped", "corrected")


_REPLIES = "CASE doc_id % 4 WHEN 0 THEN 'Answer: B) ' || lower(source) WHEN 1 THEN '(c)' WHEN 2 THEN 'I think it is A.' ELSE 'no idea' END"


@add("m12_constrained_choice", f"SELECT doc_id, CASE upper(regexp_extract({_REPLIES}, '(?i)(?:^|[^\\p{{L}}\\p{{N}}])([abc])(?:[).:]|$)', 1)) WHEN 'A' THEN 'first' WHEN 'B' THEN 'second' WHEN 'C' THEN 'third' ELSE 'other' END choice FROM documents")
def m12(spark, d):
    """Answers of a pluggable scorer read as one of the offered choices."""
    reply = F.expr("case doc_id % 4 when 0 then 'Answer: B) ' || lower(source) when 1 then '(c)' when 2 then 'I think it is A.' else 'no idea' end")
    return table(spark, d, "documents").select("doc_id", models.choice(reply, ["first", "second", "third"], "other").alias("choice"))


@add("m8_type_head")
def m8(spark, d):
    """The type head over stored vectors, on held-out rows: accuracy and macro F1."""
    e = table(spark, d, "embeddings").select("vec_id", models.array_to_vector(F.col("embedding").cast("array<double>")).alias("features"), F.col("label").alias("y"))
    part = sampling.bucket(13, F.col("vec_id"), 4)
    out = models.head(e.where(part < 3)).transform(e.where(part == 3)).select(F.col("y").cast("string").alias("t"), F.col("prediction").cast("int").cast("string").alias("p"))
    classes = metrics.per_class(out, "t", "p")
    return classes.agg((F.sum("tp") / F.sum("n_true")).alias("accuracy"), F.avg("f1").alias("macro_f1"))


@add("m15_importances")
def m15(spark, d):
    """How much each feature decides: the boosted arm's importances."""
    train, _ = (models.assemble(X.with_features(x), X.FEATURES) for x in _parts(spark, d))
    return models.importances(models.boosted(train), X.FEATURES, spark)


@add("s24_saved_model")
def s24(spark, d):
    """An arm saved with its manifest, loaded again and replayed over the corpus: rows scored otherwise."""
    train, test = (models.assemble(X.with_features(x), X.FEATURES) for x in _parts(spark, d))
    fit, path = models.head(train), files.scratch(spark, "model")
    models.save(fit, path, files.manifest(X.FEATURES, 0.5, ["0", "1"]))
    loaded, manifest = models.load(spark, path)
    test = test.select("id", "features")
    a, b = models.probability(fit, test).select("id", "prob"), models.probability(loaded, test).select("id", F.col("prob").alias("again"))
    return a.join(b, "id").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.abs(F.col("prob") - F.col("again")) > 1e-9, 1)).alias("apart"), F.lit(len(manifest["features"])).alias("n_features"))


@add("m16_clusters")
def m16(spark, d):
    return models.clusters(table(spark, d, "embeddings"), "embedding", [5, 10])


@add("m18_pseudo_label_pool", f"WITH {ONCE} SELECT id FROM m WHERE scam = 1 AND id NOT IN (SELECT report_id FROM smishtank_reports) ORDER BY md5('21:' || id), id LIMIT 60")
def m18(spark, d):
    done = table(spark, d, "smishtank_reports").select(F.col("report_id").alias("id"))
    return sampling.sample(messages(spark, d, "scam").where("scam = 1").join(done, "id", "left_anti"), "id", 60, 21).select("id")


@add("x1_streaming_score")
def x1(spark, d):
    """Beyond batch: the same scoring over a stream of the message table, written once."""
    src = table(spark, d, "messages").select("id", "text")
    path = files.scratch(spark, "in")
    src.write.parquet(path)
    stream = spark.readStream.schema(src.schema).parquet(path)
    out, check = files.scratch(spark, "out"), files.scratch(spark, "check")
    streaming.run_once(streaming.scored(stream, 0.1).select("id", "flagged"), out, check)
    return spark.read.parquet(out)

"""Queries of the training-data problems and their SQL, added by ``__spark_entry__`` if importable."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch, table
from . import canonical, collapse, leaks, lookalike, mixing, personal, sentences, splits, survivor, tiling

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


# -- 1 splits ---------------------------------------------------------------

SHARES = {"train": 0.8, "val": 0.1, "test": 0.1}


def _p1(spark, d):
    """The messages in two batches by arrival, and how they are read."""
    m = table(spark, d, "messages").select("id", "dup_group", "split", "is_clean_label", "loaded_at", F.md5(F.lower(F.trim(F.regexp_replace("text", r"\s+", " ")))).alias("same_text"))
    return splits.by_arrival(m, "id", "loaded_at"), dict(split=F.col("split"), unclean=F.col("is_clean_label") == 0, latest="loaded_at")


def _p1_table(spark, d):
    """Groups, and messages of the same text in different groups, linked and decided batch by batch."""
    batches, how = _p1(spark, d)
    return batches, splits.in_batches(batches, "id", ["dup_group", "same_text"], scratch(spark, "components"), SHARES, **how)


@query
def p1_found(spark, d):
    """Groups that the component table quarantines by what the rows of all batches claim."""
    batches, how = _p1(spark, d)
    nodes = splits.in_batches(batches, "id", ["dup_group"], scratch(spark, "components"), **how)
    found = nodes.where((F.col("status") == "quarantined") & F.col("node").startswith("dup_group\x1f"))
    return found.select(F.split("node", "\x1f")[1].cast("long").alias("dup_group"))


@query
def p1_assigned(spark, d):
    """Every message's split."""
    batches, nodes = _p1_table(spark, d)
    return splits.assigned(batches[0].unionByName(batches[1]), "id", ["dup_group", "same_text"], nodes, "loaded_at")


@query
def p1_shares(spark, d):
    """Rows and shares reached per split, over both batches."""
    return splits.shares_reached(_p1_table(spark, d)[1])


SQL["p1_found"] = """
WITH m AS (SELECT DISTINCT id, dup_group, is_clean_label, CASE WHEN lower(trim(split)) IN ('train','training','trn','tr') THEN 'train'
  WHEN lower(trim(split)) IN ('val','valid','validation','dev','development','va') THEN 'val' WHEN lower(trim(split)) IN ('test','testing','tst','te') THEN 'test' END s FROM messages)
SELECT dup_group FROM m WHERE dup_group IS NOT NULL GROUP BY dup_group
HAVING count(DISTINCT s) > 1 OR count(*) FILTER (WHERE is_clean_label = 0 AND s IN ('val','test')) > 0"""


# -- 2 overlaps ---------------------------------------------------------------


def _proper(spark, d, df):
    """``df`` with its source in one spelling."""
    return df.withColumn("source", F.lower(F.trim("source")))


@query
def p2_found(spark, d):
    return leaks.overlap_pairs(*leaks.overlaps(table(spark, d, "messages")))


@query
def p2_report(spark, d):
    """Leaked evaluation rows and pairs per split and source."""
    return leaks.overlap_report(*leaks.overlaps(_proper(spark, d, table(spark, d, "messages")), keep=("source",)))


# -- 3 collapse ---------------------------------------------------------------


@query
def p3_found(spark, d):
    return collapse.copies(table(spark, d, "source_rows"))


@query
def p3_collapsed(spark, d):
    return collapse.collapse(table(spark, d, "source_rows"), table(spark, d, "source_rank"))


# -- 4 survivors --------------------------------------------------------------


def _p4(spark, d):
    return survivor.ranked(table(spark, d, "group_members"), table(spark, d, "source_rank"))


@query
def p4_found(spark, d):
    """The three fields have no tie, so the root of the search is the solution of every group."""
    m = _p4(spark, d)
    spam, smishing = survivor.label_values(F.col("spam_label"), F.col("smishing_label"))
    bundles = [
        survivor.Bundle("spam", {"v": spam}, spam.isNotNull(), F.col("label_priority")),
        survivor.Bundle("smishing", {"v": smishing}, smishing.isNotNull(), F.col("label_priority")),
        survivor.Bundle("source", {"v": F.col("source_name")}, F.col("source_name").isNotNull(), F.col("field_priority")),
    ]
    out = survivor.survivors(m, "dup_group", bundles, "loaded_at", "member_id", [F.min(spam).alias("lo"), F.max(spam).alias("hi")], least=2)
    return out.select("dup_group", F.coalesce("_spam.v", F.lit(-1)).alias("spam_label"), F.coalesce("_smishing.v", F.lit(-1)).alias("smishing_label"), F.col("_source.v").alias("source"), F.coalesce((F.col("lo") != F.col("hi")).cast("int"), F.lit(0)).alias("label_conflict"))


@query
def p4_survivors(spark, d):
    """Text, sender and brand of each group; sender and brand must occur together where both occur."""
    m = _p4(spark, d)
    filled = lambda c: F.nullif(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""), F.lit(""))
    text, sender, brand = (filled(F.col(c)) for c in ("text", "sender", "brand"))
    bundles = [survivor.Bundle(n, {"v": c}, c.isNotNull(), F.col("field_priority")) for n, c in (("text", text), ("sender", sender), ("brand", brand))]
    out = survivor.survivors(m, "dup_group", bundles, "loaded_at", "member_id", ties=[("sender", "brand")])
    return out.select("dup_group", F.col("_text.v").alias("text"), F.col("_sender.v").alias("sender"), F.col("_brand.v").alias("brand"))


SQL["p4_found"] = r"""
WITH m AS (SELECT g.*, r.label_priority lp, r.field_priority fp, r.source proper, lower(trim(spam_label)) = 'smishing' AS both_,
    trim(spam_label) sl, trim(smishing_label) ml FROM group_members g LEFT JOIN source_rank r ON lower(trim(g.source)) = lower(r.source)),
v AS (SELECT *, CASE WHEN both_ THEN 1 WHEN sl IN ('0','1') THEN CAST(sl AS INT) END spam, CASE WHEN both_ THEN 1 WHEN ml IN ('0','1') THEN CAST(ml AS INT) END smish FROM m),
s AS (SELECT DISTINCT ON (dup_group) dup_group, spam FROM v WHERE spam IS NOT NULL ORDER BY dup_group, lp, loaded_at DESC, member_id),
t AS (SELECT DISTINCT ON (dup_group) dup_group, smish FROM v WHERE smish IS NOT NULL ORDER BY dup_group, lp, loaded_at DESC, member_id),
u AS (SELECT DISTINCT ON (dup_group) dup_group, proper FROM v WHERE proper IS NOT NULL ORDER BY dup_group, fp),
g AS (SELECT dup_group, CAST(coalesce(min(spam) <> max(spam), false) AS INT) label_conflict FROM v WHERE dup_group IS NOT NULL GROUP BY dup_group HAVING count(DISTINCT member_id) > 1)
SELECT g.dup_group, coalesce(spam, -1) spam_label, coalesce(smish, -1) smishing_label, proper AS source, label_conflict
FROM g LEFT JOIN s USING (dup_group) LEFT JOIN t USING (dup_group) LEFT JOIN u USING (dup_group)"""


# -- 7 look-alikes ------------------------------------------------------------


@query
def p7_found(spark, d):
    return lookalike.alike(table(spark, d, "messages"))


@query
def p7_forms(spark, d):
    """Every message's text in its one form."""
    once = table(spark, d, "messages").where("id is not null").select("id", "text").dropDuplicates(["id"])
    return lookalike.one_form(once).select("id", "form")


# -- 8 leaked evaluation texts ------------------------------------------------


@query
def p8_found(spark, d):
    return tiling.contained(table(spark, d, "documents"), table(spark, d, "eval_items")).select("doc_id", "item_id").distinct()


@query
def p8_leaked_items(spark, d):
    return tiling.leaked_items(tiling.contained(table(spark, d, "documents"), table(spark, d, "eval_items")))


@query
def p8_covered(spark, d):
    """Documents whose pieces of an item, of seven words or more in any order, make up half of it."""
    pieces = tiling.contained(table(spark, d, "documents"), table(spark, d, "eval_items"), kinds=tiling.PIECES)
    return tiling.covered(pieces, 0.5).select("doc_id", "item_id", F.round("coverage", 4).alias("coverage"))


# -- 6 canonical values -------------------------------------------------------


def _p6(spark, d):
    return canonical.mapped(table(spark, d, "smishtank_reports"), table(spark, d, "canon_terms"))


@query
def p6_found(spark, d):
    return _p6(spark, d).select("report_id", "field_name", "term_id").distinct()


@query
def p6_unmatched(spark, d):
    """Typed values that mean no entry, with the number of reports."""
    return _p6(spark, d).where("term_id = 0").groupBy("field_name", "value").agg(F.countDistinct("report_id").alias("reports"))


@query
def p6_candidates(spark, d):
    """Every entry within the allowed distance of a typed value."""
    terms = table(spark, d, "canon_terms")
    found = canonical.candidates(canonical.unnamed(table(spark, d, "smishtank_reports"), terms), terms)
    return found.select(F.col("kind").alias("field_name"), "value", F.explode("found").alias("x")).where("x.term_id > 0").select("field_name", "value", "x.term_id", "x.distance")


_BOUND = "(\\p{N})%s(\\p{N})"  # a dot or comma between two digits becomes a letter; twice, for 1.2.3
_LETTERS = "lower(upper(text))"
for _sign, _letter in (("[.]", "ʬ"), ("[.]", "ʬ"), ("[,]", "ʭ"), ("[,]", "ʭ")):
    _LETTERS = f"regexp_replace({_LETTERS}, '{_BOUND % _sign}', '\\1{_letter}\\2', 'g')"
SQL["p8_found"] = f"""
WITH t AS (SELECT 0 s, doc_id k, text FROM documents WHERE text IS NOT NULL UNION ALL SELECT 1, item_id, text FROM eval_items WHERE text IS NOT NULL),
w AS (SELECT s, k, list_filter(string_split_regex({_LETTERS}, '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') a FROM t),
h AS (SELECT s, k, unnest(string_split_regex(regexp_replace(text, '[^\\p{{L}}\\p{{N}}]+', '', 'g'), '[^\\p{{Han}}]+')) r FROM t),
g AS (SELECT s, k, array_to_string(list_slice(a, i, i + 11), ' ') g FROM (SELECT s, k, a, unnest(range(1, len(a) - 10)) i FROM w WHERE len(a) >= 12)
  UNION ALL SELECT s, k, substr(r, i, 20) FROM (SELECT s, k, r, unnest(range(1, length(r) - 18)) i FROM h WHERE length(r) >= 20))
SELECT DISTINCT d.k doc_id, e.k item_id FROM g d JOIN g e ON d.g = e.g WHERE d.s = 0 AND e.s = 1"""

# -- 9 mixtures ---------------------------------------------------------------


@query
def p9_mixture(spark, d):
    """The mixed corpus: token blocks by shard and position."""
    return mixing.mixed(table(spark, d, "documents"), table(spark, d, "mix_targets"))


@query
def p9_shares(spark, d):
    """Target and reached share of every source."""
    return mixing.report(table(spark, d, "documents"), table(spark, d, "mix_targets"))


# -- 10 sentences -------------------------------------------------------------


@query
def p10_found(spark, d):
    return sentences.sentences(table(spark, d, "documents"), with_text=False).select("doc_id", F.col("end_char").cast("long").alias("end_char"))


@query
def p10_sentences(spark, d):
    """Every sentence with its text."""
    return sentences.sentences(table(spark, d, "documents"))


# -- 5 personal information ---------------------------------------------------


def _p5(spark, d, redact=True):
    return personal.scan(table(spark, d, "messages"), redact=redact)


@query
def p5_found(spark, d):
    return personal.listed(_p5(spark, d, redact=False))


@query
def p5_redacted(spark, d):
    """Text and sender of every message with typed placeholders."""
    return _p5(spark, d).select("id", "field_name", "redacted")


@query
def p5_counts(spark, d):
    """Items found per field and kind."""
    return p5_found(spark, d).groupBy("field_name", "kind").agg(F.count(F.lit(1)).alias("n"))

"""Building the merged corpus: label decoding, deduplication with survivorship, template groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..vocabulary import BRAND_DECIDES, CATEGORY_TYPE, LABEL_WORDS, LOAD_ORDER
from ..session import stage
from .ids import first_seen_ids

#: Row numbers of a source lie below this.
SEQ_STEP = 1_000_000_000_000


def with_rank(rows: DataFrame, rank: DataFrame) -> DataFrame:
    """Rows of known sources with the proper name and the priorities of their source (a small dimension)."""
    dim = rank.select(F.lower(F.trim("source")).alias("_k"), F.col("source").alias("_name"), "source_link", "label_priority", "field_priority", "leaky")
    return rows.withColumn("_k", F.lower(F.trim("source"))).join(dim, "_k").drop("source").withColumnRenamed("_name", "source").withColumnRenamed("_k", "source_key")


def decoded_labels(rows: DataFrame) -> DataFrame:
    """``spam`` and ``smish`` (0, 1, null: not annotated) and ``bad_label`` by the source's own vocabulary."""
    word, mark = F.lower(F.trim("spam_label")), F.trim("smishing_label")
    pick = lambda k: F.coalesce(*[F.when(word == w, F.lit(v[k]).cast("int")) for w, v in LABEL_WORDS.items()])
    blank = F.coalesce(word, F.lit("")) == ""
    number = F.when(word.isin("0", "1"), word.cast("int"))
    src = F.col("source_key")
    words = src.isin("mendeley sms phishing", "uci sms spam collection")
    spam = F.when(src == "smishtank", 1).when(src == "nus sms corpus", 0).when(words, pick(0)).when(word == "smishing", 1).when(blank, F.when(mark == "1", 1)).otherwise(number)
    smish = F.when(src == "smishtank", 1).when(src == "nus sms corpus", 0).when(words, pick(1)).when(word == "smishing", 1).when(mark.isin("0", "1"), mark.cast("int"))
    bad = F.when(src.isin("smishtank", "nus sms corpus"), False).when(words, ~F.coalesce(word.isin(list(LABEL_WORDS)), F.lit(False))).otherwise(~(blank | word.isin("0", "1", "smishing")))
    return rows.withColumns({"spam": spam, "smish": smish, "bad_label": F.coalesce(bad, F.lit(True))})


#: Fields that survive together, besides text and source; a table may lack some.
FIELDS = ("source_link", "source_id", "sender", "sender_type", "brand", "category", "scam_type", "msg_date", "url", "domain", "tld", "domain_registrar")


def normalised(rows: DataFrame, rank: DataFrame, stated_url: Column | None = None, brand_type: dict[str, str] | None = None) -> DataFrame:
    """Clean text, decoded labels, priorities; ``seq`` is the loading order: source by source, then by row.

    ``has_url`` is what the source states (``stated_url``), else whether the text holds a link; the type is
    by category and brand of the sources that type their rows.
    """
    out = decoded_labels(with_rank(rows if stated_url is None else rows.withColumn("_stated", stated_url), rank)).withColumn("text", T.clean(F.col("text")))
    place = F.coalesce(F.array_position(F.array(*[F.lit(s) for s in LOAD_ORDER]), F.col("source_key")), F.lit(0))
    place = F.when(place == 0, len(LOAD_ORDER)).otherwise(place - 1)
    out = out.withColumn("seq", place.cast("long") * SEQ_STEP + F.col("row_id"))
    stated = F.col("_stated") if stated_url is not None else F.lit(None).cast("int")
    out = out.withColumn("has_url", F.coalesce(stated.cast("int"), T.has_url(F.col("text")).cast("int"))).drop("_stated")
    if "received_at" in out.columns and "msg_date" not in out.columns:
        out = out.withColumn("msg_date", F.date_format("received_at", "yyyy-MM-dd"))
    if "scam_type" not in out.columns and {"category", "brand"} <= set(out.columns):
        out = out.withColumn("scam_type", typed(F.col("category"), F.col("brand"), brand_type or {}))
    return out


def kept(rows: DataFrame) -> DataFrame:
    return rows.where((F.length("text") > 0) & ~F.col("bad_label"))


def deduplicated(rows: DataFrame) -> DataFrame:
    """One row per exact key.  Labels survive per field from the best source that has one, the other
    fields together from the source richest in them; ties go to the earliest row.  One aggregation,
    combined on the map side, so a text with a third of all rows costs one row per task."""
    lab = lambda c: F.min(F.when(F.col(c).isNotNull(), F.struct("label_priority", "seq", c))).alias(f"_{c}")
    more = [c for c in FIELDS if c in rows.columns]
    field = F.min(F.struct("field_priority", "seq", "text", "source", "has_url", *more)).alias("_f")
    agg = rows.withColumn("key", T.exact_key(F.col("text"))).groupBy("key").agg(
        F.min("seq").alias("first_seq"), F.count(F.lit(1)).alias("dup_count"), lab("spam"), lab("smish"), field,
        F.min("spam").alias("_lo"), F.max("spam").alias("_hi"), F.min("leaky").alias("_leaky"), F.array_sort(F.collect_set("source")).alias("srcs"),
    )
    conflict = F.coalesce((F.col("_lo") != F.col("_hi")).cast("int"), F.lit(0))
    return agg.select("key", "first_seq", "dup_count", *[F.col(f"_f.{c}").alias(c) for c in ("text", "source", "has_url", *more)], F.col("_spam.spam").alias("spam"), F.col("_smish.smish").alias("smish"), "srcs", (F.col("_leaky") == 0).cast("int").alias("is_clean_label"), conflict.alias("label_conflict"))


def resolved(d: DataFrame) -> DataFrame:
    """The three ordered label rules, each counted by ``rule``, and the label with both flags."""
    r1 = (F.col("spam") == 0) & (F.col("smish") == 1)
    rule = F.when(r1, 1).when((F.col("spam") == 1) & F.col("smish").isNull(), 2).when(F.col("spam").isNull(), 3).otherwise(0)
    d = d.withColumn("rule", rule)
    smish = F.coalesce("smish", F.lit(0))
    spam = F.when(F.col("rule") == 1, 1).when(F.col("rule") == 3, (smish == 1).cast("int")).otherwise(F.col("spam"))
    d = d.withColumns({"spam": spam, "smish": smish})
    label = F.when(F.col("smish") == 1, "smishing").when(F.col("spam") == 1, "spam").otherwise("ham")
    d = d.withColumn("label", label)
    return d.withColumns({"smishing_label": (F.col("label") == "smishing").cast("int"), "spam_label": (F.col("label") == "spam").cast("int"), "scam": (F.col("label") != "ham").cast("int")})


def also_in(srcs: Column, source: Column) -> Column:
    return F.array_join(F.array_sort(F.array_remove(srcs, source)), "|")


def grouped(d: DataFrame) -> DataFrame:
    """``id`` by first appearance and ``dup_group``: the rank of the template key by first appearance.

    The table is written once and numbered by its sequence numbers alone; a template is carried as its
    digest until its group has a number.
    """
    d = stage(d.withColumn("template", T.template_key(F.col("text"))).withColumn("_t", F.unhex(F.md5("template"))), "unique")
    ids = first_seen_ids(d.select("first_seq", "_t"), "first_seq", "id")
    firsts = first_seen_ids(d.groupBy("_t").agg(F.min("first_seq").alias("_f")), "_f", "dup_group").select("_t", "dup_group")
    return d.drop("_t").join(ids.join(firsts, "_t").drop("_t"), "first_seq")


def merged(rows: DataFrame, rank: DataFrame, **more) -> DataFrame:
    """The corpus: from raw rows to grouped, labelled, unique messages."""
    out = grouped(resolved(deduplicated(kept(normalised(rows, rank, **more)))))
    return out.withColumn("also_in", also_in(F.col("srcs"), F.col("source")))


def typed_by(category: Column, brand_type: Column, decides: tuple[str, ...] = tuple(BRAND_DECIDES)) -> Column:
    """A row's type: by category, else, where the brand decides, the type of its brand, else other; '' without category."""
    cat = F.lower(F.trim(F.coalesce(category, F.lit(""))))
    by_cat = F.coalesce(*[F.when(cat == k, v) for k, v in CATEGORY_TYPE.items()])
    return F.when(cat == "", "").otherwise(F.coalesce(by_cat, F.when(cat.isin(*decides), brand_type), F.lit("other")))


def typed(category: Column, brand: Column, brand_type: dict[str, str]) -> Column:
    """``typed_by`` with the first listed brand that is known; for brand lists that fit into an expression."""
    table = F.create_map(*[F.lit(x) for kv in brand_type.items() for x in kv]) if brand_type else F.lit(None).cast("map<string,string>")
    hits = F.filter(F.transform(F.split(F.coalesce(brand, F.lit("")), "[,/]"), lambda b: F.try_element_at(table, T.brand_key(b))), lambda t: t.isNotNull())
    return typed_by(category, F.get(hits, F.lit(0)))

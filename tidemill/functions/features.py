"""The engineered features and keyword flags of a text, as one projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..vocabulary import FAMILIES, KEYWORDS, KNOWN_TLDS, MISMATCH_BRANDS, SHORTENERS, SUSPICIOUS_TLDS, WORD
from . import text as T

FEATURES = ["has_url", "n_urls", "has_shortener", "suspicious_tld", "ip_as_domain", "url_digit_ratio", "domain_len_max", "brand_domain_mismatch",
            *[f"{f}_{k}" for f in FAMILIES for k in ("n", "hit")], "length", "n_words", "capital_ratio", "digit_ratio", "punct_ratio", "n_exclaim", "n_allcaps_words", "has_leetspeak", "avg_word_len"]
KEYWORD_COLUMNS = [T.slug_column(k) for k in KEYWORDS]


def _count(s: Column, pattern: str) -> Column:
    return F.regexp_count(s, F.lit(pattern))


def with_features(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with the 29 features.  Shared parts (lower case, domains, words) are computed once each."""
    df = df.withColumn("_t", F.coalesce(text, F.lit("")))
    df = df.withColumns({"_low": F.lower("_t"), "_d": T.domains(F.col("_t"), KNOWN_TLDS), "_w": T.words(F.col("_t"))})
    df = df.withColumns({"_flat": F.regexp_replace("_low", "[^a-z0-9]", ""), "_all": F.array_join("_d", "")})
    t, low, d, w = (F.col(c) for c in ("_t", "_low", "_d", "_w"))
    n = F.greatest(F.length(t), F.lit(1))
    # no lambda around _flat: an expression inlined into a lambda is computed per element
    df = df.withColumn("_named", F.array_compact(F.array(*[F.when(F.col("_flat").contains(b), F.lit(b)) for b in MISMATCH_BRANDS])))
    named = F.col("_named")
    in_domain = F.exists(d, lambda x: F.exists(named, lambda b: F.translate(x, ".-", "").contains(b)))
    lits = lambda xs: F.array(*[F.lit(x) for x in xs])
    cols = {
        "has_url": T.has_url(t).cast("int"), "n_urls": F.size(d),
        "has_shortener": F.exists(d, lambda x: F.array_contains(lits(SHORTENERS), T.registrable(x))).cast("int"),
        "suspicious_tld": F.exists(d, lambda x: F.array_contains(lits(SUSPICIOUS_TLDS), T.tld(x))).cast("int"),
        "ip_as_domain": (t.rlike(rf"(?<!{WORD})(?:\p{{Nd}}{{1,3}}\.){{3}}\p{{Nd}}{{1,3}}(?!{WORD})") & (F.size(d) > 0)).cast("int"),
        "url_digit_ratio": F.when(F.size(d) > 0, _count(F.col("_all"), r"\p{Nd}") / F.greatest(F.length("_all"), F.lit(1))).otherwise(0.0),
        "domain_len_max": F.coalesce(F.array_max(F.transform(d, lambda x: F.length(x))), F.lit(0)),
        "brand_domain_mismatch": ((F.size(named) > 0) & (F.size(d) > 0) & ~in_domain).cast("int"),
    }
    for family, terms in FAMILIES.items():
        hits = sum((T.count_of(low, x) for x in terms[1:]), T.count_of(low, terms[0]))
        cols |= {f"{family}_n": hits, f"{family}_hit": (hits > 0).cast("int")}
    cols |= {
        "length": F.length(t), "n_words": F.size(w),
        "capital_ratio": _count(t, r"\p{IsUppercase}") / F.greatest(_count(t, r"\p{L}"), F.lit(1)),
        "digit_ratio": _count(t, r"\p{Nd}") / n, "punct_ratio": _count(t, rf"[^\p{{L}}\p{{N}}{chr(92)}s\x{{85}}\x{{A0}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}\x1C-\x1F]") / n,
        "n_exclaim": T.count_of(t, "!"),
        "n_allcaps_words": F.size(F.filter(w, lambda x: (F.length(x) > 2) & x.rlike(r"\p{Lu}") & ~x.rlike(r"[\p{Ll}\p{Lt}]"))),
        "has_leetspeak": t.rlike(rf"(?iu)(?<!{WORD})[a-z]+[0-9]+[a-z]+(?!{WORD})").cast("int"),
        "avg_word_len": F.when(F.size(w) > 0, F.length(F.array_join(w, "")) / F.size(w)).otherwise(0.0),
    }
    return df.withColumns(cols).drop("_t", "_low", "_d", "_w", "_flat", "_all", "_named")


def with_keywords(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with one 0/1 column per keyword."""
    df = df.withColumn("_low", F.lower(F.coalesce(text, F.lit(""))))
    return df.withColumns({c: F.col("_low").contains(k).cast("int") for c, k in zip(KEYWORD_COLUMNS, KEYWORDS)}).drop("_low")


def keyword_score(text: Column) -> Column:
    """The number of keywords that occur in a text."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return sum((low.contains(k).cast("int") for k in KEYWORDS[1:]), low.contains(KEYWORDS[0]).cast("int"))


def signals(labels: dict[str, str]) -> Column:
    """The labels of the features that fire, in feature order."""
    return F.array_compact(F.array(*[F.when(F.col(c) > 0, F.lit(v)) for c, v in labels.items()]))

"""Text functions as Column expressions; every regex states its own character classes."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..vocabulary import LINK_TLDS, SPACE, TEMPLATE_HOST, TEMPLATE_URL, URL_PARTS, WORD


def clean(s: Column) -> Column:
    """Control characters dropped, white space collapsed, ends trimmed; null becomes ''."""
    s = F.regexp_replace(F.coalesce(s, F.lit("")), r"[\x00-\x08\x0B\f\x0E-\x1F]", "")
    return F.trim(F.regexp_replace(s, f"[{SPACE}]+", " "))


def exact_key(s: Column) -> Column:
    """Lower case, white space collapsed: the key of exact duplicates."""
    return F.trim(F.regexp_replace(F.lower(s), f"[{SPACE}]+", " "))


def template_key(s: Column) -> Column:
    """The text with links and numbers blanked and signs dropped; near-duplicates share it.

    The order matters: links hold digits.  A text of nothing but links, numbers and signs keeps its
    exact key behind ``=``.
    """
    low = F.lower(s)
    t = F.regexp_replace(low, rf"(?:{TEMPLATE_URL}|(?<!{WORD}){TEMPLATE_HOST})", " urltoken ")
    t = F.regexp_replace(t, r"\p{Nd}+", " numtoken ")
    t = F.trim(F.regexp_replace(F.regexp_replace(t, "[^a-z ]+", " "), " +", " "))
    bare = F.trim(F.regexp_replace(t, r"\b(?:urltoken|numtoken)\b", ""))
    return F.when(bare == "", F.concat(F.lit("="), exact_key(s))).otherwise(t)


def has_url(s: Column) -> Column:
    return s.rlike(rf"(?iu)(?:https?://|www\.|(?<!{WORD})[a-z0-9-]+\.(?:{LINK_TLDS})(?!{WORD}))")


def urls(s: Column) -> Column:
    """``array<struct<prefix, host>>`` of everything that may be a link, hosts in lower case."""
    rx = F.lit(f"(?iu){URL_PARTS}")
    both = F.arrays_zip(F.regexp_extract_all(s, rx, F.lit(1)).alias("prefix"), F.regexp_extract_all(s, rx, F.lit(2)).alias("host"))
    return F.transform(both, lambda x: F.struct(x["prefix"].alias("prefix"), F.rtrim(F.lower(x["host"]), F.lit(".")).alias("host")))


def domains(s: Column, known_tlds: list[str]) -> Column:
    """Hosts of the links in a text; a bare host needs a known top-level domain, numbers are none."""
    known = F.array(*[F.lit(t) for t in known_tlds])
    ok = lambda x: x["host"].contains(".") & ~F.replace(x["host"], F.lit("."), F.lit("")).rlike(r"^\p{Nd}*$") & ((x["prefix"] != "") | F.array_contains(known, tld(x["host"])))
    return F.transform(F.filter(urls(s), ok), lambda x: x["host"])


def tld(host: Column) -> Column:
    return F.substring_index(host, ".", -1)


def registrable(host: Column) -> Column:
    """The last two labels of a host."""
    return F.substring_index(host, ".", -2)


def count_of(s: Column, term: str) -> Column:
    """Occurrences of a literal, not overlapping."""
    # most terms do not occur: the byte search alone decides that
    return F.when(s.contains(term), ((F.length(s) - F.length(F.replace(s, F.lit(term), F.lit("")))) / len(term)).cast("int")).otherwise(F.when(s.isNotNull(), 0))


def words(s: Column) -> Column:
    return F.regexp_extract_all(s, F.lit(f"{WORD}+"), F.lit(0))


def brand_key(s: Column) -> Column:
    return F.regexp_replace(F.lower(s), "[^a-z0-9]+", "")


def slug_column(term: str) -> str:
    """The column name of a keyword flag."""
    return "kw_" + re.sub("_+", "_", re.sub("[^a-z0-9]+", "_", term.lower())).strip("_")


def iso_date(s: Column) -> Column:
    """A date from a text that begins with MM/DD/YYYY; anything else is null."""
    m = r"^(\d{2})/(\d{2})/(\d{4})"
    part = lambda k: F.regexp_extract(s, m, k)
    return F.when(s.rlike(m), F.try_to_date(F.concat_ws("-", part(3), part(1), part(2)), "yyyy-MM-dd"))


def json_object(s: Column) -> Column:
    """The text from the first ``{`` to the last ``}`` if it parses as an object, else null."""
    body = F.regexp_extract(s, r"(?s)\{.*\}", 0)
    return F.when(F.try_parse_json(body).isNotNull(), body)


def snap(value: Column, types: list[str], fallback: str) -> Column:
    """A free text snapped to a list: equal, else contained either way (first in list order), else the fallback."""
    want = F.lower(F.trim(value))
    arr = F.array(*[F.lit(t) for t in types])
    equal = F.filter(arr, lambda t: F.lower(t) == want)
    part = F.filter(arr, lambda t: (want != "") & (want.contains(F.lower(t)) | F.lower(t).contains(want)))
    return F.coalesce(F.get(equal, F.lit(0)), F.get(part, F.lit(0)), F.lit(fallback))


def without_point_zero(s: Column) -> Column:
    return F.regexp_replace(s, r"\.0$", "")


def confidence_words(p: Column, flagged: Column) -> Column:
    strength = F.when(flagged, p).otherwise(1 - p)
    return F.when(strength >= 0.95, "Very confident").when(strength >= 0.8, "Fairly confident").otherwise("Not very confident")

"""Problem 3: duplicates hidden by formatting differences, collapsed and counted.

A record is a tree: a plain text is a leaf (a sequence of words), a name-value notice an unordered node
whose children are fields, a JSON object an unordered node and a JSON array an ordered one, at any depth.
Digests are made bottom-up: leaves are normalised (case, spacing, punctuation) and hashed, the child
digests of an unordered node are sorted, a node's digest is the hash of its children's.  Rows are grouped
by the 128-bit root digest, so a shuffle carries digests and no texts.  Each group is confirmed by a second,
independent digest of its whole canonical tree, carried through the same aggregation; where a group has
more than one, its trees are compared in full and every tree is a message of its own.

Defined results: a null text is no message; texts without any word form one class per exact text;
repeated fields count as often as they occur; a notice needs four fields, whose names may be of any length;
text of any length is read whole; JSON that does not parse, or nests deeper than Python's stack (some 300
levels), is read as the list of its fields; an empty table gives empty results; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stage

#: What separates words: all but letters and digits, except a dot or comma between two digits.
_BETWEEN = r"(?:[^\p{L}\p{N}.,]|(?<!\p{N})[.,]|[.,](?!\p{N}))+"
_FIELD = r'^[\s"{~*\-]*[\p{L}\p{N}][\p{L}\p{N}_ ]*+"?\s*[=:]'
LEAST_FIELDS = 4


def words(text: Column) -> Column:
    """The words of a text in one case, joined by single spaces."""
    return F.trim(F.regexp_replace(F.lower(F.upper(text)), _BETWEEN, " "))


def _hash(tree: Column) -> Column:
    return F.md5(tree)


def _fields(text: Column) -> Column:
    """The raw fields of a text that may be a notice; not yet checked."""
    text = F.regexp_replace(text, r"(?U)\s+$|^\s+", "")
    json_ = F.split(F.regexp_replace(text, r"^[^{]*\{|\}[^}]*$", ""), r'(?U),\s*(?="[^"]*"\s*:)')
    listed = F.split(text, r"(?U)\s*[;|\n]\s*|\s+/\s+|,\s*(?=[\p{L}_]++\s*[=:])")
    return F.filter(F.when(text.rlike(r'^[^\p{L}\p{N}]*\{(?s:.*)\}[^\p{L}\p{N}]*$'), json_).otherwise(listed), lambda f: F.length(F.trim(f)) > 0)


def _field(field: Column) -> Column:
    """One field as ``name RS value``, both normalised: a leaf."""
    cut = F.regexp_extract(field, r"^([^=:]*)[=:]", 1)
    return F.concat_ws("\x1e", words(cut), words(F.substring(field, F.length(cut) + 2, F.length(field))))


_SPLIT = regex.compile(_BETWEEN)


def _leaf(value: object) -> str:
    return _SPLIT.sub(" ", str(value).upper().lower()).strip()


def _node(value: object) -> tuple[str, str]:
    """``(digest, canonical)`` of a JSON value: children first, those of objects sorted by their digests."""
    md5 = lambda s: hashlib.md5(s.encode("utf-8", "surrogatepass")).hexdigest()
    if isinstance(value, list):  # a JSON object as pairs, or an array behind its mark
        if value and value[0] is _ARRAY:
            kids = [_node(v) for v in value[1:]]
            return md5("[" + "".join(d for d, _ in kids)), "[" + "\x1f".join(c for _, c in kids) + "]"
        kids = []
        for k, v in value:
            name = _leaf(k)
            d, c = _node(v)
            whole = f"{name}\x1e{c}"
            kids.append((md5(f"{name}\x1e{d}") if isinstance(v, list) else md5(whole), whole))
        kids.sort()
        return md5("{" + "".join(d for d, _ in kids)), "{" + "\x1f".join(c for _, c in kids) + "}"
    text = "" if value is None else _leaf({True: "true", False: "false"}.get(value, value) if isinstance(value, bool) else value)
    return md5(text), text


_ARRAY = object()


def _arrays(value: object) -> object:
    """Marks the arrays of a parsed value, whose objects are lists of pairs (tuples)."""
    if isinstance(value, list):
        return [_ARRAY, *map(_arrays, value)]
    return [(k, _arrays(v)) for k, v in value] if isinstance(value, tuple) else value


def _nested(text: str) -> dict:
    """Digest and canonical form of a text around a JSON object of at least ``LEAST_FIELDS`` fields, or nulls."""
    try:
        value = json.loads(text[text.index("{") : text.rindex("}") + 1], object_pairs_hook=tuple, parse_int=str, parse_float=str, parse_constant=str, strict=False)
        if isinstance(value, tuple) and len(value) >= LEAST_FIELDS:
            digest, whole = _node(_arrays(value))
            return {"digest": digest, "tree": whole}
    except (ValueError, RecursionError):
        pass
    return {"digest": None, "tree": None}


def _deep(text: Column) -> Column:
    @F.pandas_udf("digest string, tree string")
    def run(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_nested(t) for t in s], columns=["digest", "tree"])

    return run(text)


def rooted(rows: DataFrame, id_col: str = "row_id", text_col: str = "text", keep: tuple[str, ...] = (), hash_: Callable[[Column], Column] | None = None) -> DataFrame:
    """``(id, digest, check, tree, *keep)`` of the rows with a text: root digest, the digest it is confirmed
    by, and the canonical tree.  Only texts with nested JSON pass through Python.  ``hash_`` replaces the
    root digest (for tests of collisions)."""
    base = rows.where(F.col(text_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("_t"), *[F.col(c).alias(f"_k_{c}") for c in keep])
    text = F.col("_t")
    nested = text.contains("{") & text.rlike(r'(?s)^[^\p{L}\p{N}]*\{.*:\s*[\[{]')
    none = F.lit(None).cast("struct<digest:string,tree:string>")
    out = base.where(~nested).withColumn("_deep", none).union(base.where(nested).withColumn("_deep", _deep(text)))
    maybe = (text.contains("=") | text.contains(":")) & text.rlike(r"(?s)(?:[=:].*){4}") & text.rlike(r'(?s)^[^\p{L}\p{N}]*[\p{L}\p{N}_ ]+"?\s*[=:]')
    # each step is a column of its own: an expression that is used twice would be computed twice
    out = out.withColumn("_f", F.when(F.col("_deep.digest").isNull() & maybe, _fields(text)))
    out = out.withColumn("_raw", F.when((F.size("_f") >= LEAST_FIELDS) & F.forall("_f", lambda f: f.rlike(_FIELD)), F.transform("_f", _field)))
    # a flat notice and a JSON object of the same fields are the same node: sorted digests of its leaves
    out = out.withColumn("_kids", F.array_sort(F.transform("_raw", lambda f: F.struct(F.md5(f).alias("d"), f.alias("f")))))
    out = out.withColumn("_w", F.when(F.col("_deep.digest").isNull() & F.col("_raw").isNull(), words(text)))
    plain = F.when(F.col("_w") == "", F.concat(F.lit("\x1d"), text)).otherwise(F.col("_w"))
    tree = F.coalesce(F.col("_deep.tree"), F.concat(F.lit("{"), F.array_join(F.col("_kids.f"), "\x1f"), F.lit("}")), plain)
    out = out.withColumn("tree", tree)
    root = F.coalesce(F.col("_deep.digest"), F.md5(F.concat(F.lit("{"), F.array_join(F.col("_kids.d"), ""))), F.md5("tree")) if hash_ is None else hash_(F.col("tree"))
    return out.select("id", F.unhex(root).alias("digest"), F.xxhash64("tree").alias("check"), "tree", *[F.col(f"_k_{c}").alias(c) for c in keep])


def _mixed(groups: DataFrame) -> DataFrame | None:
    """The root digests under which trees differ, or None."""
    mixed = groups.groupBy("digest").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("lo <> hi").select("digest")
    return None if mixed.isEmpty() else mixed


def copies(rows: DataFrame, id_col: str = "row_id", text_col: str = "text", hash_: Callable[[Column], Column] | None = None) -> DataFrame:
    """``(first_id, copy_id)`` of every copy.  A class with a third of all rows reaches the shuffle as one
    row per input task; only messages with copies are joined back, and the skew join spreads a hot one."""
    whole = rooted(rows, id_col, text_col, hash_=hash_)
    r = stage(whole.select("id", "digest", "check"), "roots")
    groups = stage(r.groupBy("digest").agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("n"), F.min("check").alias("lo"), F.max("check").alias("hi")), "groups")
    many = groups.where("n > 1 and lo = hi").select("digest", "first_id")
    out = r.select("digest", "id").join(many, "digest").where("id <> first_id").select("first_id", F.col("id").alias("copy_id"))
    mixed = None if groups.where("lo <> hi").isEmpty() else groups.where("lo <> hi").select("digest")
    if mixed is not None:  # digests that collide: their trees are compared in full
        t = whole.join(mixed, "digest").select("id", "digest", "tree")
        own = t.groupBy("digest", "tree").agg(F.min("id").alias("first_id"))
        out = out.union(t.join(own, ["digest", "tree"]).where("id <> first_id").select("first_id", F.col("id").alias("copy_id")))
    return out


def collapse(rows: DataFrame, rank: DataFrame | None = None, hash_: Callable[[Column], Column] | None = None) -> DataFrame:
    """One row per message: the first row's id and source, the number of copies and the other sources
    (proper spelling, sorted, joined by ``|``; null when there is none)."""
    name = F.lower(F.regexp_replace(F.col("source"), r"(?U)^\s+|\s+$", ""))
    per = rooted(rows, keep=("source",), hash_=hash_).withColumn("source", name)
    # sources first: few per message, so the second aggregation sees no hot key
    sums = [F.min("id").alias("first_id"), F.count(F.lit(1)).alias("n"), F.min("check").alias("lo"), F.max("check").alias("hi")]
    by_source = stage(per.groupBy("digest", F.lit("").alias("part"), "source").agg(*sums), "messages")
    mixed = _mixed(by_source)
    if mixed is not None:
        part = per.join(mixed, "digest").groupBy("digest", F.col("tree").alias("part"), "source").agg(*sums)
        by_source = by_source.join(mixed, "digest", "left_anti").unionByName(part)
    if rank is not None:
        proper = rank.select(F.lower(F.trim("source")).alias("source"), F.col("source").alias("proper")).groupBy("source").agg(F.min("proper").alias("proper"))
        by_source = by_source.join(proper, "source", "left").withColumn("source", F.coalesce("proper", "source"))
    out = by_source.groupBy("digest", "part").agg(F.min(F.struct("first_id", "source")).alias("w"), F.sum("n").alias("dup_count"), F.array_sort(F.collect_set("source")).alias("all"))
    others = F.array_join(F.filter("all", lambda s: ~s.eqNullSafe(F.col("w.source"))), "|")
    return out.select(F.col("w.first_id").alias("row_id"), F.col("w.source").alias("source"), "dup_count", F.when(others != "", others).alias("also_in"))

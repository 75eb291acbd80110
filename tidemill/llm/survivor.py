"""Problem 4: the best representative of each duplicate group.

Fields that depend on each other form a bundle and are taken together from one member; a bundle's
candidates are ranked by the trust of their source, then by recency, then by member id.  Functional
dependencies tie bundles: with ``sender -> brand`` the surviving sender and brand must occur together
in some member.  The choice is made by branch and bound.  The root relaxes the ties: one aggregation
gives each bundle's best candidate, which bounds every solution and is the optimum where it keeps the
ties (always, if there are none).  Only groups whose root breaks a tie are branched, over the distinct
values of the tied bundles; the trust of the best member that holds both is the first incumbent, and
values that cannot beat it even with the other bundle's best are cut before any pair is joined.

Defined results: members delivered again count once; unknown sources rank last; nulls, blanks and
unusable strings are no candidates; a bundle without candidates gives nulls (labels: -1); a tie between
values that never occur together leaves both as the root has them; a group with one member is a group
unless ``least`` says otherwise; null groups are left out.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LAST = 2**31 - 1
#: The columns of members that are read; others may have any name.
COLUMNS = ("member_id", "dup_group", "source", "text", "spam_label", "smishing_label", "sender", "brand", "loaded_at")


@dataclass(frozen=True)
class Bundle:
    """``fields`` (output name to column) taken together where ``usable``; lower ``priority`` wins."""

    name: str
    fields: dict[str, Column]
    usable: Column
    priority: Column


def _key(name: str | Column) -> Column:
    return F.lower(F.regexp_replace(name, r"(?U)^\s+|\s+$", ""))


def ranked(members: DataFrame, rank: DataFrame) -> DataFrame:
    """Members once each, with the priorities of their source and its proper spelling."""
    r = rank.select(_key(F.col("source")).alias("_k"), F.col("source").alias("source_name"), "label_priority", "field_priority", "leaky")
    r = r.groupBy("_k").agg(F.min(F.struct("label_priority", "field_priority", "source_name", "leaky")).alias("_r")).select("_k", "_r.*")
    once = members.where(F.col("dup_group").isNotNull() & F.col("member_id").isNotNull()).select(*COLUMNS, _key(F.col("source")).alias("_k"))
    out = once.join(r, "_k", "left")
    return out.withColumn("label_priority", F.coalesce("label_priority", F.lit(LAST))).withColumn("field_priority", F.coalesce("field_priority", F.lit(LAST)))


def label_values(spam: Column, smishing: Column) -> tuple[Column, Column]:
    """Usable 0/1 labels: blanks do not count, the word smishing as spam label means both are 1."""
    bare = lambda c: F.regexp_replace(F.lower(c), r"(?U)^\s+|\s+$", "")
    both = F.coalesce(bare(spam) == "smishing", F.lit(False))
    flag = lambda c: F.when(bare(c).isin("0", "1"), bare(c).cast("int"))
    return F.when(both, 1).otherwise(flag(spam)), F.when(both, 1).otherwise(flag(smishing))


def _rank(priority: Column, recency: str, member: str) -> Column:
    recent = -F.coalesce(F.unix_micros(F.col(recency).cast("timestamp")), F.lit(-(2**62)))
    return F.struct(priority.alias("p"), recent.alias("t"), F.col(member).alias("m"))


def survivors(members: DataFrame, group: str, bundles: list[Bundle], recency: str, member: str, extra: list[Column] = (), least: int = 1, ties: list[tuple[str, str]] = ()) -> DataFrame:
    """One row per group with each bundle's candidate ``_<name>`` (``p, t, m`` and its fields) in the best
    solution that keeps ``ties``, pairs of names of bundles (a bundle is in one tie at most)."""
    by_name = {b.name: b for b in bundles}
    at = {b.name: _rank(b.priority, recency, member) for b in bundles}
    whole = lambda b: F.struct(*[at[b.name][c].alias(c) for c in "ptm"], *[c.alias(n) for n, c in b.fields.items()])
    aggs = [F.min(F.when(b.usable, whole(b))).alias(f"_{b.name}") for b in bundles]
    root = members.groupBy(group).agg(F.min(member).alias("_least"), F.max(member).alias("_most"), *aggs, *extra)
    if least > 1:  # two different ids are enough for two members
        root = root.where("_least <> _most")
    for a, b in ties:
        # both from one member: the tie holds; else the group is branched
        broken = root.where(F.col(f"_{a}.m") != F.col(f"_{b}.m")).select(group)
        best = tied(members.join(broken, group, "left_semi"), group, by_name[a], by_name[b], recency, member)
        best = best.select(group, F.col("a").alias(f"_new_{a}"), F.col("b").alias(f"_new_{b}"))
        root = root.join(best, group, "left").withColumns({f"_{n}": F.coalesce(f"_new_{n}", f"_{n}") for n in (a, b)}).drop(f"_new_{a}", f"_new_{b}")
    return root


def tied(members: DataFrame, group: str, a: Bundle, b: Bundle, recency: str, member: str) -> DataFrame:
    """``(group, a, b, total)``: the values of two bundles that some member holds together, of least summed
    priority; among equals by the rank of ``a``, then of ``b``.

    Each value counts with its best member.  All tables are pre-aggregated per distinct value.
    """
    value = lambda x: F.when(x.usable, F.struct(*[c.alias(n) for n, c in x.fields.items()]))
    rows = members.select(F.col(group).alias("g"), value(a).alias("a"), value(b).alias("b"), _rank(a.priority, recency, member).alias("ra"), _rank(b.priority, recency, member).alias("rb"))
    both = F.col("a").isNotNull() & F.col("b").isNotNull()
    # the bounds: what either bundle costs at least, and what the best member with both costs at most
    bounds = rows.groupBy("g").agg(
        F.min(F.when(F.col("a").isNotNull(), F.col("ra.p"))).cast("long").alias("least_a"), F.min(F.when(F.col("b").isNotNull(), F.col("rb.p"))).cast("long").alias("least_b"),
        F.min(F.when(both, F.col("ra.p").cast("long") + F.col("rb.p"))).alias("incumbent"),
    ).where("incumbent is not null")
    alive = rows.join(bounds, "g")
    of_a = alive.where(F.col("a").isNotNull() & (F.col("ra.p") + F.col("least_b") <= F.col("incumbent"))).groupBy("g", "a").agg(F.min("ra").alias("ra"))
    of_b = alive.where(F.col("b").isNotNull() & (F.col("rb.p") + F.col("least_a") <= F.col("incumbent"))).groupBy("g", "b").agg(F.min("rb").alias("rb"))
    pairs = alive.where(both).select("g", "a", "b").distinct().join(of_a, ["g", "a"]).join(of_b, ["g", "b"])
    full = lambda r, v, x: F.struct(*[F.col(r)[c].alias(c) for c in "ptm"], *[F.col(v)[n].alias(n) for n in x.fields])
    best = pairs.groupBy("g").agg(F.min(F.struct((F.col("ra.p").cast("long") + F.col("rb.p")).alias("total"), full("ra", "a", a).alias("a"), full("rb", "b", b).alias("b"))).alias("w"))
    return best.select(F.col("g").alias(group), "w.a", "w.b", "w.total")

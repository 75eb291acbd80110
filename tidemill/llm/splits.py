"""Problem 1: train, validation and test splits that keep related records together.

A component table maps every link key (an author, a source, a duplicate group) to its component and
the component to its decided split, status and row counts.  ``group_splits`` writes it where ``save``
names a folder, and reads the one of the earlier batches as ``state``.  A batch of new records adds
keys and links; components that become connected are merged by pointer jumping.  A component with one
known split keeps it, one with none fills the deficit of the targets over all batches, and one in
which several known splits meet is quarantined and stays so.

Defined results for odd input: a null key links nothing (a record with no key is a component of its
own); a null or unreadable split is no claim; a null cleanliness flag counts as clean; a record
delivered several times counts once (the latest delivery); empty tables give empty results; extra
columns are never read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import cut, stage

SPLITS = ("train", "val", "test")
#: The words read as one of the three splits, after trimming and lower-casing.
SPLIT_WORDS = {
    "train": "train", "training": "train", "trn": "train", "tr": "train",
    "val": "val", "valid": "val", "validation": "val", "dev": "val", "development": "val", "va": "val",
    "test": "test", "testing": "test", "tst": "test", "te": "test",
}
#: Positions of the hash order over which new components are laid out; bounds the prefix-sum table.
SLOTS = 4096


def read_split(split: Column) -> Column:
    """The split a spelling means: blanks and case do not count, unknown words are null."""
    word = F.lower(F.regexp_replace(split, r"(?U)^\s+|\s+$", ""))
    out = F.lit(None).cast("string")
    for name in SPLITS:
        out = F.when(word.isin([w for w, s in SPLIT_WORDS.items() if s == name]), name).otherwise(out)
    return out


def distinct_records(df: DataFrame, id_col: str, fields: dict[str, Column], latest: str | None = None) -> DataFrame:
    """One row per id with the named fields, of the latest delivery (ties: the greatest values)."""
    order = F.col(latest) if latest else F.lit(0)
    picked = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id"), order.alias("_at"), *[c.alias(f"_f_{n}") for n, c in fields.items()])
    best = picked.groupBy("_id").agg(F.max(F.struct("_at", *[f"_f_{n}" for n in fields])).alias("_m"))
    return best.select(F.col("_id").alias(id_col), *[F.col(f"_m._f_{n}").alias(n) for n in fields])


def _tag(key: str) -> Column:
    """The node of a link key's value; null where there is none."""
    return F.when(F.col(key).isNotNull(), F.concat_ws("\x1f", F.lit(key), F.col(key).cast("string")))


def connect(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Connected components: ``nodes(node)`` and ``edges(u, v)`` to ``(node, component)``.

    Each round hooks every root onto its smallest neighbouring root, jumps pointers until all point
    to roots, and relabels the remaining edges.  Edges inside a component disappear, so the edge table
    shrinks in every round; all steps are joins and map-side combined aggregations.
    """
    labels = nodes.select("node", F.col("node").alias("component")).distinct()
    left = edges.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    left = cut(left)
    while not left.isEmpty():
        hook = left.groupBy(F.col("v").alias("child")).agg(F.min("u").alias("parent"))
        hook = cut(hook)
        while True:  # pointer jumping: the parent's parent, until nothing moves
            up = hook.select(F.col("child").alias("parent"), F.col("parent").alias("grand"))
            jumped = cut(hook.join(up, "parent", "left").select("child", F.coalesce("grand", "parent").alias("parent"), F.col("grand").isNotNull().alias("moved")))
            hook = jumped.select("child", "parent")
            if jumped.where("moved").isEmpty():
                break
        labels = cut(labels.join(hook.withColumnRenamed("child", "component"), "component", "left").select("node", F.coalesce("parent", "component").alias("component")))
        to = hook.select(F.col("child").alias("x"), F.col("parent").alias("px"))
        left = left.join(to.withColumnRenamed("x", "u").withColumnRenamed("px", "pu"), "u", "left").select(F.coalesce("pu", "u").alias("u"), "v")
        left = left.join(to.withColumnRenamed("x", "v").withColumnRenamed("px", "pv"), "v", "left").select("u", F.coalesce("pv", "v").alias("v"))
        left = cut(left.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    return labels


def component_table(records: DataFrame, id_col: str, keys: Sequence[str], split: Column | None = None, unclean: Column | None = None, latest: str | None = None, state: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The updated component table and each record's component.

    ``state`` is an earlier table ``(node, component, split)``, as ``state_table`` makes it with
    ``(status, rows, unclean_rows)`` too: its rows are counted with the new ones (a record must not
    come in two batches), what it quarantined stays quarantined.  The records' own stored splits are
    claims as well.  Returns ``(node, component, rows, claims, unclean_eval, unclean_rows, split,
    status)``, one row per node, and ``(id, component)``.  ``status`` is kept, new or quarantined.
    """
    none = F.lit(None).cast("string")
    facts = distinct_records(records, id_col, {"nodes": F.array_compact(F.array(*[_tag(k) for k in keys])), "claim": none if split is None else read_split(split), "unclean": F.lit(0) if unclean is None else F.coalesce(unclean.cast("int"), F.lit(0))}, latest)
    facts = facts.withColumn("nodes", F.when(F.size("nodes") > 0, F.col("nodes")).otherwise(F.array(F.concat_ws("\x1f", F.lit("id"), F.col(id_col).cast("string")))))
    facts = facts.withColumn("anchor", F.col("nodes")[0])
    bad = (F.col("unclean") == 1) & F.col("claim").isin("val", "test")
    by_anchor = facts.groupBy("anchor").agg(
        F.count(F.lit(1)).alias("rows"), *[F.count(F.when(F.col("claim") == s, 1)).alias(f"n_{s}") for s in SPLITS],
        F.count(F.when(bad, 1)).alias("unclean_eval"), F.sum("unclean").alias("unclean_rows"),
    )
    if len(keys) > 1 or state is not None:
        pairs = facts.select("anchor", F.explode("nodes").alias("node")).distinct()
        edges = pairs.select(F.col("anchor").alias("u"), F.col("node").alias("v"))
        nodes = pairs.select("node")
        if state is not None:
            edges = edges.union(state.select("component", "node"))
            nodes = nodes.union(state.select("node")).union(state.select("component"))
        labels = cut(connect(nodes, edges))
    else:  # one key: no link joins two nodes, every node is its own root
        labels = by_anchor.select(F.col("anchor").alias("node"), F.col("anchor").alias("component"))
    sums = ["rows", *[f"n_{s}" for s in SPLITS], "unclean_eval", "unclean_rows"]
    per = labels.join(by_anchor.withColumnRenamed("anchor", "node"), "node", "left") if len(keys) > 1 or state is not None else by_anchor.select(F.col("anchor").alias("component"), F.col("anchor").alias("node"), *sums)
    if state is not None:
        held = state.select("node", F.col("split").alias("held"))
        per = per.join(held, "node", "left")
        for s in SPLITS:
            per = per.withColumn(f"n_{s}", F.coalesce(f"n_{s}", F.lit(0)) + F.coalesce((F.col("held") == s).cast("long"), F.lit(0)))
        # counts of an earlier component stand on each of its nodes; they come in once, at the node that names it
        old = lambda c, kind: F.max(F.col(c) if c in state.columns else F.lit(None).cast(kind)).alias(f"_{c}")
        earlier = state.groupBy(F.col("component").alias("node")).agg(old("rows", "long"), old("unclean_rows", "long"), old("status", "string"))
        per = per.join(earlier, "node", "left")
        for c in ("rows", "unclean_rows"):
            per = per.withColumn(c, F.coalesce(c, F.lit(0)) + F.coalesce(f"_{c}", F.lit(0)))
    stays = F.max(F.col("_status") == "quarantined") if state is not None else F.lit(False)
    comp = per.groupBy("component").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in sums], F.coalesce(stays, F.lit(False)).alias("stays"))
    claims = F.array_compact(F.array(*[F.when(F.col(f"n_{s}") > 0, s) for s in SPLITS]))
    comp = comp.select("component", "rows", claims.alias("claims"), "unclean_eval", "unclean_rows", "stays")
    conflict = (F.size("claims") > 1) | (F.col("unclean_eval") > 0) | F.col("stays")
    comp = comp.withColumn("status", F.when(conflict, "quarantined").when(F.size("claims") == 1, "kept").otherwise("new"))
    comp = comp.withColumn("split", F.when(F.col("status") == "kept", F.col("claims")[0])).drop("stays")
    where = facts.select(id_col, F.col("anchor").alias("node"))
    return comp, labels.join(comp, "component"), where.join(labels, "node").select(id_col, "component")


def fill(comp: DataFrame, shares: dict[str, float]) -> DataFrame:
    """``comp`` with every split decided: ``(component, rows, status, split)``.

    Kept components stay.  A kept evaluation component into which an unclean record has come, and a
    quarantined one, go to train, where they leak into nothing; so do new components with an unclean
    record.  The other new ones fill the deficits of val and test.  Those larger than a tenth of the
    lesser target (of the splits that have one) are placed singly, largest first, into the split that
    lacks most and can hold it, as long as the small ones are too few for what is lacking; at most ten
    by the least share of them are collected.  The small ones are then laid out in hash order and cut
    where the deficits are filled.
    """
    comp = comp.withColumn("split", F.when(F.col("unclean_rows") > 0, F.lit("train")).otherwise(F.col("split")))
    open_ = (F.col("status") == "new") & (F.col("unclean_rows") == 0)
    total = comp.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("total"), *[F.coalesce(F.sum(F.when(F.col("split") == s, F.col("rows"))), F.lit(0)).alias(s) for s in ("val", "test")]).first()
    lack = {s: max(0.0, total["total"] * shares[s] - total[s]) for s in ("val", "test")}
    large = F.col("rows") > 0.1 * total["total"] * min([shares[s] for s in lack if shares[s] > 0], default=0)
    small = comp.where(open_ & ~large).agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("n")).first()["n"]
    placed = []
    if sum(lack.values()) > small:
        fits = comp.where(open_ & large & (F.col("rows") <= max(lack.values()) + 1e-6)).select("component", "rows")
        for c, n in fits.orderBy(F.desc("rows"), F.xxhash64("component"), "component").collect():  # at most 10 / the least share
            most = max(lack, key=lambda s: (lack[s] + 1e-6 >= n, lack[s]))
            if sum(lack.values()) > small and lack[most] + 1e-6 >= n:
                lack[most] -= n
                placed.append((c, most))
    if placed:
        at = comp.sparkSession.createDataFrame(placed, "component string, _placed string")
        comp = comp.join(F.broadcast(at), "component", "left").withColumn("split", F.coalesce("_placed", "split"))
    slotted = comp.withColumn("_open", open_ & ~large).withColumn("_slot", F.pmod(F.xxhash64("component"), F.lit(SLOTS)))
    per_slot = slotted.where("_open").groupBy("_slot").agg(F.sum("rows").alias("_n"))
    before = per_slot.withColumn("_before", F.sum("_n").over(Window.orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1))).select("_slot", F.coalesce("_before", F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_slot").orderBy(F.xxhash64("component", F.lit(1)), "component").rowsBetween(Window.unboundedPreceding, -1)
    new = slotted.where("_open").withColumn("_in", F.coalesce(F.sum("rows").over(inside), F.lit(0))).join(F.broadcast(before), "_slot")  # at most SLOTS rows
    middle = F.col("_before") + F.col("_in") + F.col("rows") / 2
    new = new.withColumn("split", F.when(middle < lack["val"], "val").when(middle < lack["val"] + lack["test"], "test").otherwise("train"))
    cols = ["component", "rows", "status", "split"]
    return new.select(cols).union(slotted.where("not _open").withColumn("split", F.coalesce("split", F.lit("train"))).select(cols))


def state_table(nodes: DataFrame, decided: DataFrame) -> DataFrame:
    """The component table with the decisions of ``fill``, for the next batch:
    ``(node, component, split, status, rows, unclean_rows)``, one row per node."""
    return nodes.select("node", "component", "unclean_rows").join(decided, "component").select("node", "component", "split", "status", "rows", "unclean_rows")


def group_splits(records: DataFrame, id_col: str, keys: Sequence[str], shares: dict[str, float], save: str | None = None, **more) -> tuple[DataFrame, DataFrame]:
    """Every record's split, and the decided components.

    ``save`` is a new folder to which the component table is written; read again, it is the ``state``
    of the next batch.
    """
    comp, nodes, where = component_table(records, id_col, keys, **more)
    decided = fill(cut(comp), shares)
    if save is not None:
        decided = cut(decided)
        state_table(nodes, decided).write.parquet(save)
    return where.join(decided.select("component", "status", "split"), "component").select(id_col, "split", "status"), decided


def in_batches(batches: Sequence[DataFrame], id_col: str, keys: Sequence[str], folder: str, shares: dict[str, float] | None = None, **more) -> DataFrame:
    """The component table after all batches, each one read against the table the batch before it wrote
    below ``folder``.  Without ``shares`` nothing is decided: the table holds what the records claim, so
    its quarantined components are those in which stored splits meet."""
    table = None
    for number, batch in enumerate(batches):
        path = f"{folder}/{number}"
        if shares is None:
            _, nodes, _ = component_table(batch, id_col, keys, state=table, **more)
            nodes.select("node", "component", "split", "status", "rows", "unclean_rows").write.parquet(path)
        else:
            group_splits(batch, id_col, keys, shares, save=path, state=table, **more)
        table = batch.sparkSession.read.parquet(path)
    return table


def assigned(records: DataFrame, id_col: str, keys: Sequence[str], table: DataFrame, latest: str | None = None) -> DataFrame:
    """``(id, split, status)`` of records by a component table that has seen them, in whichever batch."""
    where = distinct_records(records, id_col, {"node": F.coalesce(*[_tag(k) for k in keys], F.concat_ws("\x1f", F.lit("id"), F.col(id_col).cast("string")))}, latest)
    return where.join(table.select("node", "split", "status"), "node").select(id_col, "split", "status")


def shares_reached(table: DataFrame) -> DataFrame:
    """``(split, n, components, share)`` over all batches of a component table."""
    n = table.groupBy("component").agg(F.first("split").alias("split"), F.first("rows").alias("rows")).groupBy("split").agg(F.sum("rows").alias("n"), F.count(F.lit(1)).alias("components"))
    total = n.agg(F.sum("n").alias("total"))
    return n.crossJoin(F.broadcast(total)).select("split", "n", "components", F.round(F.col("n") / F.col("total"), 4).alias("share"))  # one row


def by_arrival(records: DataFrame, id_col: str, at: str) -> list[DataFrame]:
    """Two batches of records, each record once (its latest delivery), cut in the middle of the time over
    which those came; a record that never says when is in the first."""
    rest = [c for c in records.columns if c not in (id_col, at)]
    once = records.where(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max(F.struct(at, *rest)).alias("_m")).select(id_col, *[F.col("_m")[c].alias(c) for c in (at, *rest)])
    once = stage(once, "records")
    micros = F.coalesce(F.unix_micros(F.col(at).cast("timestamp")), F.lit(0))
    middle = once.agg(F.floor((F.min(micros) + F.max(micros)) / 2).alias("m")).first()["m"] or 0  # one row
    return [once.where(micros <= middle), once.where(micros > middle)]

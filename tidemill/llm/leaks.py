"""Problem 2: the same or nearly the same record in an evaluation split and in training.

Texts are reduced to the words that count.  Texts with the same words form a class, so copies are
compared once.  A class's fingerprint is a sparse bit code: every word occurrence sets the bit of its
hash, one changed word moves at most two bits, so classes within ``k`` word edits lie within Hamming
radius ``2k``.  The code's bits are permuted into one global order, rarest first; two codes within
the radius agree in at least three of their first ``k + 3`` set bits (the codes share all but ``k``
bits).  Blocks are sets of those bits; they are joined across the splits, candidates are checked by Hamming distance on a 256-bit fold of the code and verified by word edit distance.

Classic 64-bit codes cut into equal segments need a radius of 20 and more for one word in five and
then lose pairs or join on three-bit blocks; the sparse code keeps every pair (see README).

Defined results: nulls have no text and no pair; texts without a counted word match nothing; rows
redelivered count once; a text of four words matches an equal one or one of five words with one more,
shorter texts match only when equal; unknown splits are no split.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stage
from .splits import read_split

#: Share of the longer text's words that may be added, dropped or changed.
SHARE = 0.2
#: Cells of the frequency sketch that orders bits; its size does not depend on the data.
CELLS = 1 << 16
#: Bits of a block, and the lengths (words) of the texts: over the first, up to the second.
KINDS = {3: (0, 50), 2: (50, 200), 1: (200, 2**31)}
#: Pairs that a block of long texts (sets of one or two bits) may make; a hotter one is cut up by a further bit.
HOT = 4_000_000
#: Links, amounts with a currency, and the currencies' words.
LINK = r"(?:h(?:tt|xx)ps?://|www\.)\S+|(?<![\p{L}\p{N}_-])(?=[\p{L}\p{N}_-]++\.[\p{L}\p{N}_-])[\p{L}\p{N}_-]+(?:\.[\p{L}\p{N}_-]+)*\.(?:\p{L}{2,}/\S*|(?:com|net|org|test|example|invalid|info|biz|io|co)(?![\p{L}\p{N}]))"
CURRENCY = r"(?:usd|eur|gbp|inr|aud|cad|dollars?|euros?|pounds?)"


def counted_words(text: Column) -> Column:
    """The words of a text that count, in order: no links, amounts, codes, numbers, case or signs."""
    low = F.lower(F.upper(text))
    low = F.regexp_replace(low, LINK, " ")
    low = F.regexp_replace(low, rf"(?=[uegiacdp]){CURRENCY}\s*(?=\d)|(?<=\d)\s*{CURRENCY}(?![\p{{L}}\p{{N}}])", " 0 ")
    return F.filter(F.split(low, r"[^\p{L}\p{M}\p{N}]+"), lambda w: (F.length(w) > 0) & ~w.rlike(r"\p{N}"))


def with_bits(df: DataFrame) -> DataFrame:
    """``code``: the set bits of ``words``, one 64-bit position per word occurrence, repeats numbered.

    The sorted hashes are a column of their own: inside a lambda an expression is computed per element.
    """
    df = df.withColumn("_h", F.array_sort(F.transform("words", lambda w: F.xxhash64(w))))
    return df.withColumn("code", F.transform("_h", lambda h, i: F.xxhash64(h, i - F.array_position("_h", h)))).drop("_h")


def fold(code: Column) -> list[Column]:
    """The code folded to 4 x 64 bits by parity; folding never adds distance."""
    word = lambda q: F.aggregate(F.filter(code, lambda b: F.pmod(b, F.lit(4)) == q), F.lit(0).cast("long"), lambda a, b: a.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.call_function("shiftright", b, F.lit(2)), F.lit(64)).cast("int"))))
    return [word(q).alias(f"f{q}") for q in range(4)]


def frequency_sketch(codes: DataFrame) -> bytearray:
    """Per cell a byte that grows with the number of set bits hashed to it; CELLS bytes in all."""
    cells = codes.select(F.explode("code").alias("b")).groupBy(F.pmod("b", F.lit(CELLS)).alias("c")).count()
    out = np.zeros(CELLS)
    for c, n in cells.collect():  # at most CELLS rows
        out[c] = n
    return bytearray(np.minimum(255, np.log2(out + 1) * 6).astype(np.uint8).tobytes())


def _sets(size: int) -> Column:
    """Hashes of all sets of three elements of the sorted array column ``q``."""
    rest = lambda i: F.slice("q", i + 1, F.size("q"))
    return F.flatten(F.transform("q", lambda x, i: F.flatten(F.transform(rest(i + 1), lambda y, j: F.transform(rest(i + j + 2), lambda z: F.xxhash64(F.lit(size), x, y, z))))))


def blocks(codes: DataFrame, sketch: bytearray, share: float = SHARE, hot: DataFrame | None = None) -> DataFrame:
    """``(e, t, c, n, f, block)``: sets of bits of the head of the permuted code; c is a 64-bit form of the
    class, f the code folded to 64 bits.

    Codes of n and m words that are within k = share * max(n, m) edits share all but k bits, so they
    agree in ``size`` of their first ``k + size`` bits.  ``size`` is 3, 2 or 1 by length (``KINDS``), so
    blocks are rare where texts are short and many, and few where texts are long.  Kinds overlap by
    the share that lengths of close texts may differ: two close texts always have one in common.
    """
    out = None
    for size, (low, high) in KINDS.items():
        own = _heads(codes, sketch, share, size, low, high)
        if size == 3:
            part = own.select("e", "t", "c", "n", "f", F.explode(_sets(size)).alias("block"))
        else:
            sets = own.select("e", "t", "c", "n", "f", "wide", F.explode(_parents(size)).alias("p"))
            if hot is None:
                part = sets.select("e", "t", "c", "n", "f", "p.block")
            else:
                sets = sets.withColumn("block", F.col("p.block")).join(hot.withColumn("hot", F.lit(1)), "block", "left")
                rest = F.transform(F.array_except("wide", "p.bits"), lambda x: F.xxhash64(F.lit(4), F.col("block"), x))
                part = sets.select("e", "t", "c", "n", "f", F.explode(F.when(F.col("hot").isNull(), F.array("block")).otherwise(rest)).alias("block"))
        out = part if out is None else out.union(part)
    return out


def _heads(codes: DataFrame, sketch: bytearray, share: float, size: int, low: int, high: int) -> DataFrame:
    """``q``: the first ``k + size`` bits of each code of the given lengths, ``wide``: one bit more; sorted."""
    rank = lambda b: F.substring(F.lit(sketch), F.pmod(b, F.lit(CELLS)).cast("int") + 1, F.lit(1))
    order = F.array_sort(F.transform("code", lambda b: F.struct(rank(b).alias("r"), b.alias("b"))))
    short = F.col("f0").bitwiseXOR(F.col("f1")).bitwiseXOR(F.col("f2")).bitwiseXOR(F.col("f3"))
    ranked = codes.where("n >= 4").where((F.col("n") > low) & (F.col("n") * (1 - share) <= high)).select("e", "t", F.xxhash64("cls").alias("c"), "n", short.alias("f"), order.alias("o"))
    head = lambda more: F.array_sort(F.transform(F.slice("o", 1, (F.floor(F.col("n") * share) + size + more).cast("int")), lambda x: x["b"]))
    return ranked.select("e", "t", "c", "n", "f", head(0).alias("q"), head(1).alias("wide"))


def _parents(size: int) -> Column:
    """The sets of one or two bits with their hash."""
    if size == 1:
        return F.transform("q", lambda x: F.struct(F.xxhash64(F.lit(1), x).alias("block"), F.array(x).alias("bits")))
    rest = lambda i: F.slice("q", i + 1, F.size("q"))
    return F.flatten(F.transform("q", lambda x, i: F.transform(rest(i + 1), lambda y: F.struct(F.xxhash64(F.lit(2), x, y).alias("block"), F.array(x, y).alias("bits")))))


def hot_blocks(codes: DataFrame, sketch: bytearray, share: float = SHARE) -> DataFrame | None:
    """The blocks of long texts that would make more than ``HOT`` pairs of an evaluation and a training class,
    or None.  Texts that share one also share another of the first ``k + size + 1`` bits, so their block
    may be cut up by that bit and no pair is lost."""
    parts = [_heads(codes, sketch, share, size, *KINDS[size]).select("e", "t", F.explode(_parents(size)).alias("p")) for size in (2, 1)]
    n = parts[0].union(parts[1]).groupBy(F.col("p.block").alias("block")).agg(F.sum("e").alias("e"), F.sum("t").alias("t"))
    hot = stage(n.where(F.col("e").cast("double") * F.col("t") > HOT).select("block"), "hot")
    return None if hot.isEmpty() else hot


def _within(a: list[str], b: list[str], k: int) -> bool:
    """Whether the word edit distance is at most k: furthest row per diagonal and number of edits, so
    the work grows with the distance found, not with the length times k."""
    n, m = len(a), len(b)
    if abs(n - m) > k:
        return False
    reach: dict[int, int] = {}
    for e in range(k + 1):
        new: dict[int, int] = {}
        for d in range(-e, e + 1):  # diagonal: place in b minus place in a
            i = 0 if e == 0 else max(reach.get(d, -2) + 1, reach.get(d - 1, -2), reach.get(d + 1, -2) + 1)
            i = min(i, n, m - d)
            if i < 0 or i + d < 0:
                continue
            while i < n and i + d < m and a[i] == b[i + d]:
                i += 1
            if i == n and i + d == m:
                return True
            new[d] = i
        reach = new
    return False


def close(a: Column, b: Column, share: float = SHARE) -> Column:
    @F.pandas_udf("boolean")
    def check(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([_within(list(p), list(q), int(share * max(len(p), len(q)) + 1e-9)) for p, q in zip(x, y)], dtype=bool)

    return check(a, b)


def overlaps(rows: DataFrame, id_col: str = "id", text_col: str = "text", split_col: str = "split", keep: tuple[str, ...] = (), share: float = SHARE) -> tuple[DataFrame, DataFrame]:
    """Linked classes ``(cls_e, cls_t)`` of evaluation and training, and the membership of rows.

    Membership is ``(cls, id, split, *keep)``; equal classes on both sides are linked to themselves.
    """
    read = rows.where(F.col(text_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("_t"), read_split(F.col(split_col)).alias("split"), *keep)
    read = read.where(F.col("split").isNotNull()).dropDuplicates(["id"])
    members = read.select("id", "split", *keep, counted_words(F.col("_t")).alias("words"))
    # the filter comes behind the written table: pushed below the words it would compute them again
    members = stage(members.withColumn("cls", F.unhex(F.md5(F.array_join("words", " ")))), "members").where(F.size("words") > 0)
    eval_ = F.col("split") != "train"
    cls = members.groupBy("cls").agg(F.max(eval_.cast("int")).alias("e"), F.max((~eval_).cast("int")).alias("t"), F.first("words").alias("words"))
    cls = with_bits(cls.select("cls", "e", "t", "words", F.size("words").alias("n")))
    cls = stage(cls.select("*", *fold(F.col("code"))), "classes")
    sketch = frequency_sketch(cls)
    hot = hot_blocks(cls, sketch, share)
    e = blocks(cls.where("e = 1"), sketch, share, hot).select("block", F.col("c").alias("c_e"), F.col("n").alias("n_e"), F.col("f").alias("f_e"))
    t = blocks(cls.where("t = 1"), sketch, share, hot).select("block", F.col("c").alias("c_t"), F.col("n").alias("n_t"), F.col("f").alias("f_t"))
    near = F.abs(F.col("n_e") - F.col("n_t")) <= F.floor(F.greatest("n_e", "n_t") * share)
    # the radius is checked on the short fold inside the join, before anything else is shuffled
    inside = F.bit_count(F.col("f_e").bitwiseXOR(F.col("f_t"))) <= 2 * F.floor(F.greatest("n_e", "n_t") * share)
    cand = e.join(t, "block").where(inside & near & (F.col("c_e") != F.col("c_t"))).select("c_e", "c_t").distinct()
    side = lambda s: cls.select(F.xxhash64("cls").alias(f"c_{s}"), F.col("cls").alias(f"cls_{s}"), F.col("words").alias(f"w_{s}"), *[F.col(f"f{i}").alias(f"{s}{i}") for i in range(4)])
    # short forms that coincide only add candidates, which the verification drops
    full = cand.join(side("e"), "c_e").join(side("t"), "c_t")
    apart = sum((F.bit_count(F.col(f"e{i}").bitwiseXOR(F.col(f"t{i}"))) for i in range(4)), F.lit(0))
    radius = 2 * F.floor(F.greatest(F.size("w_e"), F.size("w_t")) * share)
    linked = full.where(apart <= radius).where(close(F.col("w_e"), F.col("w_t"), share)).select("cls_e", "cls_t")
    same = cls.where("e = 1 and t = 1").select(F.col("cls").alias("cls_e"), F.col("cls").alias("cls_t"))
    return linked.union(same), members.drop("words")


def overlap_pairs(links: DataFrame, members: DataFrame) -> DataFrame:
    """Row pairs of linked classes, smaller id first."""
    e = members.where("split <> 'train'").select(F.col("cls").alias("cls_e"), F.col("id").alias("x"))
    t = members.where("split = 'train'").select(F.col("cls").alias("cls_t"), F.col("id").alias("y"))
    both = links.join(e, "cls_e").join(t, "cls_t")
    return both.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))


def overlap_report(links: DataFrame, members: DataFrame) -> DataFrame:
    """Per split and source: evaluation rows that occur in training, and the pairs they make.
    Pairs are counted from class sizes; no pair is built."""
    size = members.where("split = 'train'").groupBy("cls").agg(F.count(F.lit(1)).alias("n_t"))
    per = links.join(size.withColumnRenamed("cls", "cls_t"), "cls_t").groupBy("cls_e").agg(F.sum("n_t").alias("pairs"))
    e = members.where("split <> 'train'").groupBy("cls", "split", "source").agg(F.count(F.lit(1)).alias("n"))
    out = e.join(per.withColumnRenamed("cls_e", "cls"), "cls").groupBy("split", "source")
    return out.agg(F.sum("n").alias("rows_leaked"), F.sum(F.col("n") * F.col("pairs")).alias("pairs"))

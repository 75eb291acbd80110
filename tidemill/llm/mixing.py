"""Problem 9: combining sources so that each makes up its target share of the tokens.

Documents are tokenized and packed in one pass: each task lays the documents it reads end to end per source
and cuts them into blocks of a fixed number of tokens; what is left over at its end is packed with the
other tasks' remainders (a source's last block may be shorter; nothing is dropped).  The budget is cut
into quotas by target share, limited to ``max_repeats`` passes over a source.  Counts per output shard
are a multinomial draw conditioned on those quotas, so totals are met exactly: the shards are halved again
and again and each half's counts drawn from its parent's by a generator seeded with its place, so a task
draws its own shards alone.  A slot's index within its source is mapped through a pseudorandom
permutation of the block indexes, one per pass, so every block is used at most once per pass; blocks are
joined by index, the only time tokens are shuffled.

Defined results: null texts have no tokens; a null, negative or non-finite share is 0, a null ``max_repeats`` 1; a listed
source without documents and an unlisted source contribute nothing and are reported; a source listed
twice counts with its first share by name order; empty tables give an empty mixture.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import stage

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
BLOCK, SHARD = 512, 2048
SEED = 11
#: Listed sources are held on the driver; more are refused.
MAX_SOURCES = 10_000
#: Rows (source, task) up to which the numbering of blocks is broadcast (some 40 bytes each); beyond, the join shuffles.
BROADCAST_PARTS = 500_000
#: A target is met if the share reached is this near to it.
TOLERANCE = 0.005
#: Fixed value: how the byte-level vocabulary cuts a text before merging.
CUT = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=2)
def encoder(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
    return tiktoken.Encoding("tidemill", pat_str=CUT, mergeable_ranks=ranks, special_tokens={})


def _readable(docs: DataFrame, id_col: str, text: str, source: str) -> DataFrame:
    rows = docs.where(F.col(id_col).isNotNull() & F.col(text).isNotNull() & F.col(source).isNotNull())
    return rows.select(F.col(id_col).alias("doc_id"), F.col(source).alias("source"), F.col(text).alias("text"))


def tokenized(docs: DataFrame, tokenizer: str = TOKENIZER, id_col: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """``(doc_id, source, ids)``; whole texts, in Arrow batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        e = encoder(tokenizer)
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "source": b["source"], "ids": [np.array(e.encode_ordinary(t), dtype=np.int32) for t in b["text"]]})

    return _readable(docs, id_col, text, source).mapInPandas(run, f"doc_id {dict(docs.dtypes)[id_col]}, source string, ids array<int>")


def _pack(pieces: Iterator[tuple[str, np.ndarray]], size: int, part: int) -> Iterator[list[tuple]]:
    """``(source, part, n, full, ids)`` in lists: full blocks as they fill, each source's remainder at the end."""
    held: dict[str, list] = {}
    made: dict[str, int] = {}
    rows = []
    for source, ids in pieces:
        have = held.get(source)
        ids = ids if have is None else np.concatenate([have, ids])
        whole = len(ids) // size
        n = made.get(source, 0)
        rows += [(source, part, n + k, True, ids[k * size : (k + 1) * size]) for k in range(whole)]
        made[source] = n + whole
        held[source] = ids[whole * size :].copy()
        if len(rows) > 2000:
            yield rows
            rows = []
    yield rows + [(s, part, 0, False, ids) for s, ids in held.items() if len(ids)]


_PACKED = "source string, part int, n long, full boolean, ids array<int>"


def packed(docs: DataFrame, size: int = BLOCK, tokenizer: str = TOKENIZER, id_col: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """Blocks and remainders of each task (``_pack``), with ``part`` the number of the task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        e = encoder(tokenizer)
        pieces = ((s, np.array(e.encode_ordinary(t), dtype=np.int32)) for b in batches for s, t in zip(b["source"], b["text"]))
        for rows in _pack(pieces, size, TaskContext.get().partitionId()):
            yield pd.DataFrame(rows, columns=["source", "part", "n", "full", "ids"])

    return _readable(docs, id_col, text, source).mapInPandas(run, _PACKED)


def numbered(parts: DataFrame, size: int = BLOCK) -> DataFrame:
    """``(source, block, ids)`` of staged ``packed`` rows: blocks numbered through per source.

    Remainders hold fewer than ``size`` tokens per source and task; they are packed by groups of tasks
    (``part`` over 1,024), then all together, so the last one per source alone is short.
    """

    def again(key: str):
        def run(group: tuple, frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            pieces = ((s, np.asarray(ids, dtype=np.int32)) for f in frames for s, ids in zip(f["source"], f["ids"]))
            for rows in _pack(pieces, size, int(group[1])):
                yield pd.DataFrame(rows, columns=["source", "part", "n", "full", "ids"])

        def of(left: DataFrame) -> DataFrame:
            d = left.withColumn("_g", F.expr(key))
            return d.groupBy("source", "_g").applyInPandas(run, _PACKED)

        return of

    first = stage(again("cast(-1 - floor(part / 1024) as int)")(parts.where("not full")), "remainders")
    last = stage(again("cast(-1000000000 as int)")(first.where("not full")).withColumn("full", F.lit(True)), "last")
    # a source's short block is numbered last: its part is the lowest and it follows the full ones of it
    rows = parts.where("full").unionByName(first.where("full")).unionByName(last.withColumn("n", F.when(F.size("ids") < size, F.lit(2**40)).otherwise(F.col("n"))))
    count = rows.groupBy("source", "part").agg(F.count(F.lit(1)).alias("m"))
    at = Window.partitionBy("source").orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, -1)
    begin = count.select("source", "part", "m", F.coalesce(F.sum("m").over(at), F.lit(0)).alias("begin"))
    if count.limit(BROADCAST_PARTS + 1).count() <= BROADCAST_PARTS:
        begin = F.broadcast(begin)
    return rows.join(begin, ["source", "part"]).select("source", (F.col("begin") + F.least(F.col("n"), F.col("m") - 1)).alias("block"), "ids")


def permuted(index: Column, n: Column, key: Column) -> Column:
    """A pseudorandom permutation of 0..n-1, one for each key: a Feistel network with cycle walking."""

    @F.pandas_udf("long")
    def walk(i: pd.Series, size: pd.Series, k: pd.Series) -> pd.Series:
        x, m, k = i.to_numpy(np.uint64), size.to_numpy(np.uint64), k.to_numpy(np.int64).astype(np.uint64)
        half = np.maximum(1, np.ceil(np.log2(np.maximum(2, m.astype(np.float64))) / 2)).astype(np.uint64)
        mask = (np.uint64(1) << half) - np.uint64(1)

        def once(x, half, mask, k):
            left, right = x >> half, x & mask
            for r in range(4):
                h = right * np.uint64(0x9E3779B97F4A7C15) + k + np.uint64(r) * np.uint64(0xD1B54A32D192ED03)
                h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
                left, right = right, left ^ ((h ^ (h >> np.uint64(32))) & mask)
            return (left << half) | right

        with np.errstate(over="ignore"):
            x = once(x, half, mask, k)
            while (out := x >= m).any():
                x[out] = once(x[out], half[out], mask[out], k[out])
        return pd.Series(x.astype(np.int64))

    return walk(index, n, key)


def plan(sizes: list[tuple[str, int, int]], targets: list[tuple[str, float, int]], size: int, budget: int | None = None) -> list[dict]:
    """Quotas in blocks: ``sizes`` are (source, tokens, blocks), ``targets`` (source, share, repeats)."""
    have = {s: (t, b) for s, t, b in sizes}
    listed = {s for s, _, _ in targets}
    total = budget if budget is not None else sum(b for s, (_, b) in have.items() if s in listed)
    out = []
    for s, share, repeats in sorted(targets):
        tokens, n = have.get(s, (0, 0))
        wanted = int(round(share * total))
        out.append({"source": s, "target_share": share, "max_repeats": repeats, "tokens": tokens, "blocks": n, "wanted": wanted, "quota": min(wanted, n * repeats)})
    return out


def _share_out(left: np.ndarray, take: int, rng: np.random.Generator) -> np.ndarray:
    """How many of ``take`` slots drawn without replacement fall to each source.  Exact hypergeometric
    draws below a thousand million slots; above, their normal approximation, kept within what is possible."""
    out, rest = np.zeros(len(left), np.int64), int(left.sum())
    for k, n in enumerate(left.tolist()):
        if not take:
            break
        rest -= n
        low, high = max(0, take - rest), min(n, take)
        if n + rest < 1_000_000_000:
            x = int(rng.hypergeometric(n, rest, take)) if low < high else low
        else:
            total, p = n + rest, n / (n + rest)
            sd = math.sqrt(max(0.0, take * p * (1 - p) * (total - take) / max(1, total - 1)))
            x = min(high, max(low, round(take * p + sd * rng.standard_normal())))
        out[k], take = x, take - x
    return out


def draw(quotas: list[int], shard: int, lo: int, hi: int, seed: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(shard number, first index, count)`` per source of the shards lo..hi-1: the halves of the shards
    are drawn from the whole, each by its own generator, and only halves that meet lo..hi are opened."""
    total = sum(quotas)
    stack = [(0, -(-total // shard), np.zeros(len(quotas), np.int64), np.array(quotas, np.int64))]
    while stack:
        a, b, used, left = stack.pop()
        if a >= hi or b <= lo or a >= b:
            continue
        if b - a == 1:
            yield a, used, left
            continue
        mid = (a + b) // 2
        take = _share_out(left, (mid - a) * shard, np.random.default_rng((seed, a, b)))
        stack += [(mid, b, used + take, left - take), (a, mid, used, take)]


def mixture(docs: DataFrame, targets: DataFrame, size: int = BLOCK, shard: int = SHARD, seed: int = SEED, tokenizer: str = TOKENIZER, budget: int | None = None) -> tuple[DataFrame, DataFrame, list[dict]]:
    """The slots ``(shard, source, index, pass, block)``, the packed blocks, and the plan."""
    spark = docs.sparkSession
    rows = targets.where("source is not null").groupBy("source").agg(F.min(F.struct(F.coalesce("target_share", F.lit(0.0)).alias("s"), F.coalesce("max_repeats", F.lit(1)).alias("m"))).alias("x")).select("source", "x.s", "x.m").limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} listed sources")
    wanted = [(r[0], max(0.0, float(r[1])) if math.isfinite(r[1]) else 0.0, max(0, int(r[2]))) for r in rows]
    names = spark.createDataFrame([(s,) for s, _, _ in wanted] or [("",)], "source string")
    parts = stage(packed(docs.join(F.broadcast(names), "source", "left_semi"), size, tokenizer), "blocks")  # at most MAX_SOURCES names
    per = parts.groupBy("source").agg(F.sum(F.size("ids").cast("long")).alias("t")).collect()  # listed sources only
    quotas = plan([(r[0], int(r[1]), -(-int(r[1]) // size)) for r in per], wanted, size, budget)
    counts = [q["quota"] for q in quotas]
    known = [(q["source"], q["blocks"]) for q in quotas]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            ids = b["id"].to_numpy()
            for first in range(0, len(ids), 512):  # numbers in a batch are in a row
                lo, hi = int(ids[first]), int(ids[min(len(ids), first + 512) - 1]) + 1
                out += [(h, known[k][0], int(used[k]), int(n), known[k][1]) for h, used, take in draw(counts, shard, lo, hi, seed) for k, n in enumerate(take) if n]
            yield pd.DataFrame(out, columns=["shard", "source", "start", "n", "size"])

    drawn = spark.range(-(-sum(counts) // shard)).mapInPandas(run, "shard long, source string, start long, n long, size long")
    slots = drawn.select("shard", "source", "size", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("n") - 1)).alias("index"))
    slots = slots.withColumn("pass", F.floor(F.col("index") / F.col("size"))).withColumn("block", permuted(F.pmod("index", "size"), F.col("size"), F.xxhash64("source", "pass", F.lit(seed))))
    return slots, parts, quotas


def mixed(docs: DataFrame, targets: DataFrame, **more) -> DataFrame:
    """``(shard, position, source, pass, block, ids)``: the mixture's blocks; sort by position in a shard."""
    slots, parts, _ = mixture(docs, targets, **more)
    # slots are made in tasks, so the planner cannot see how many there are and must not broadcast them
    out = slots.join(numbered(parts, more.get("size", BLOCK)).hint("merge"), ["source", "block"])
    return out.select("shard", F.xxhash64("shard", "source", "index").alias("position"), "source", "pass", "block", "ids")


def report(docs: DataFrame, targets: DataFrame, tolerance: float = TOLERANCE, **more) -> DataFrame:
    """Per source: target and reached share of the tokens, passes used, and whether the target is met:
    whether the share reached is within ``tolerance`` of it.

    Sources with documents that are not listed appear with a null target.
    """
    size = more.get("size", BLOCK)
    slots, _, quotas = mixture(docs, targets, **more)
    spark = docs.sparkSession
    plan_ = spark.createDataFrame([(q["source"], q["target_share"], q["max_repeats"], q["tokens"], q["blocks"]) for q in quotas] or [], "source string, target_share double, max_repeats int, tokens long, blocks long")
    short = F.when(F.col("block") == F.col("blocks") - 1, F.col("tokens") - (F.col("blocks") - 1) * size).otherwise(F.lit(size))
    used = slots.select("source", "pass", "block").join(F.broadcast(plan_.select("source", "tokens", "blocks")), "source").groupBy("source").agg(F.sum(short).alias("used_tokens"), F.max("pass").alias("p"))
    out = plan_.join(used, "source", "left").withColumn("used_tokens", F.coalesce("used_tokens", F.lit(0)))
    total = out.agg(F.sum("used_tokens").alias("total"))
    share = F.coalesce(F.try_divide(F.col("used_tokens"), F.col("total")), F.lit(0.0))
    out = out.crossJoin(F.broadcast(total)).select("source", "target_share", "max_repeats", "tokens", "used_tokens", F.coalesce(F.col("p") + 1, F.lit(0)).alias("passes"), F.round(share, 4).alias("reached_share"), (F.abs(share - F.col("target_share")) <= tolerance).alias("met"))
    rest = docs.where("source is not null").select("source").distinct().join(F.broadcast(plan_.select("source")), "source", "left_anti")
    null = lambda t: F.lit(None).cast(t)
    return out.unionByName(rest.select("source", null("double").alias("target_share"), null("int").alias("max_repeats"), null("long").alias("tokens"), F.lit(0).cast("long").alias("used_tokens"), F.lit(0).cast("long").alias("passes"), F.lit(0.0).alias("reached_share"), null("boolean").alias("met")))

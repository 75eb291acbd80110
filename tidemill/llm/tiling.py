"""Problem 8: evaluation texts inside training documents, found by greedy string tiling.

Both sides become sequences of units: words, and for Chinese single characters.  A shared run of
``least`` units contains a seed gram that starts at a multiple of ``least - gram + 1`` in the document,
so a document emits few seeds and no run is missed; the items emit every gram.  Documents that share
a seed with an item are tiled: the longest common run of unmarked units, found through Karp-Rabin
hashes of ``least`` units, is marked again and again until none is left.  Reordered passages give
several tiles; their length against the item's is its coverage, to which ``covered`` puts a threshold.

Defined results: null texts and ids match nothing; texts shorter than ``least`` units match nothing;
an item that occurs several times in a document counts once in coverage; repeated ids count once.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .collapse import words

#: Seed rows of the items up to which they are broadcast (16 bytes each); beyond, the join shuffles.
BROADCAST_SEEDS = 1_000_000
_HAN = r"\x{2E80}-\x{2FDF}\x{3005}\x{3007}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{20000}-\x{323AF}"


@dataclass(frozen=True)
class Kind:
    """A kind of unit: a run of ``least`` of them counts, seeds are grams of ``gram`` of them."""

    name: str
    least: int
    gram: int


KINDS = (Kind("word", 12, 6), Kind("han", 20, 10))
#: Shorter runs, for the coverage of passages that were cut into pieces and reordered.
PIECES = (Kind("word", 7, 5), Kind("han", 12, 8))


def units(text: Column, kind: Kind) -> Column:
    """The units of a text, joined by blanks (words) or between breaks (Chinese characters)."""
    if kind.name == "word":
        return words(text)
    run = F.regexp_replace(F.regexp_replace(text, r"[^\p{L}\p{N}]+", ""), f"[^{_HAN}]+", " ")
    return F.trim(run)


def with_seeds(df: DataFrame, side: str, every, kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """One row per gram that starts at each ``every(kind)``-th unit: ``(<side>_id, seed)``.

    The units are columns of their own: inside a lambda an expression is computed per element.
    """
    lists = df.select(f"{side}_id", *[F.split(f"{side}_{k.name}", " " if k.name == "word" else "").alias(k.name) for k in kinds])

    def hashes(kind: Kind) -> Column:
        n = F.size(kind.name) - kind.gram
        at = F.when(n >= 0, F.sequence(F.lit(0), n, F.lit(every(kind)))).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.xxhash64(F.lit(kind.name), F.array_join(F.slice(kind.name, i + 1, kind.gram), " ")))

    return lists.select(f"{side}_id", F.explode(F.concat(*[hashes(k) for k in kinds])).alias("seed"))


def _runs(doc: np.ndarray, item: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Maximal common runs ``(length, start in doc, start in item)`` of at least ``least`` units.

    Karp-Rabin hashes of ``least`` units meet by sorting; hits are confirmed unit by unit, and hits in a
    row on one diagonal are one run.
    """
    n, m = len(doc) - least + 1, len(item) - least + 1
    base = np.uint64(0x9E3779B97F4A7C15)

    def rolling(codes: np.ndarray, n: int) -> np.ndarray:
        h = np.zeros(n, np.uint64)
        for k in range(least):
            h = h * base + codes[k : k + n]
        return h

    hi = rolling(item, m)
    order = np.argsort(hi, kind="stable")
    hd, hs = rolling(doc, n), hi[order]
    lo, up = np.searchsorted(hs, hd, "left"), np.searchsorted(hs, hd, "right")
    count = up - lo
    i = np.repeat(np.arange(n), count)
    if not len(i):
        return []
    j = order[np.repeat(lo - (np.cumsum(count) - count), count) + np.arange(len(i))]
    same = np.ones(len(i), bool)
    for k in range(least):
        same &= doc[i + k] == item[j + k]
    i, j = i[same], j[same]
    order = np.lexsort((i, i - j))
    i, j = i[order], j[order]
    first = np.flatnonzero(np.r_[True, (np.diff(i) != 1) | (np.diff(i - j) != 0)]) if len(i) else np.array([], int)
    size = np.diff(np.r_[first, len(i)]) + least - 1
    return list(zip(size.tolist(), i[first].tolist(), j[first].tolist()))


def tiles(doc: list, item: list, least: int) -> list[tuple[int, int, int]]:
    """``(start in doc, start in item, length)``, longest first, no unit in two tiles.

    The runs are found once and taken from a heap, longest first (ties: first in the document, then in
    the item); a run that has lost units to a tile goes back with what is left of it.
    """
    if len(doc) < least or len(item) < least:
        return []
    ids: dict = {}
    code = lambda seq: np.array([ids.setdefault(x, len(ids) + 1) for x in seq], np.uint64)
    heap = [(-n, i, j) for n, i, j in _runs(code(doc), code(item), least)]
    heapq.heapify(heap)
    used_d, used_i, out = bytearray(len(doc)), bytearray(len(item)), []
    while heap:
        n, i, j = heapq.heappop(heap)
        n = -n
        taken = bytes(a | b for a, b in zip(used_d[i : i + n], used_i[j : j + n]))
        if 1 in taken:
            for part in re.finditer(rb"\x00{%d,}" % least, taken):
                heapq.heappush(heap, (part.start() - part.end(), i + part.start(), j + part.start()))
            continue
        used_d[i : i + n] = used_i[j : j + n] = b"\1" * n
        out.append((i, j, n))
    return out


def _tile(kinds: tuple[Kind, Kind]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        word, han = kinds
        for b in batches:
            rows = []
            for d, i, du, iu, dh, ih in b.itertuples(index=False):
                a = [(word, tiles(du.split(" "), iu.split(" "), word.least), len(iu.split(" "))), (han, tiles(list(dh), list(ih), han.least) if dh and ih else [], len(ih.replace(" ", "")))]
                # a blank is a break between Chinese runs: tiles may not cross it
                for kind, found, size in a:
                    if kind is han:
                        found = [(s, t, len(p)) for s, t, n in found for p in re.findall(r"[^ ]+", dh[s : s + n]) if len(p) >= han.least]
                    if found:
                        rows.append((d, i, kind.name, len(found), max(n for _, _, n in found), sum(n for _, _, n in found), size))
            yield pd.DataFrame(rows, columns=["doc_id", "item_id", "kind", "tiles", "longest", "covered", "units"])

    return run


def contained(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", kinds: tuple[Kind, Kind] = KINDS) -> DataFrame:
    """``(doc_id, item_id, kind, tiles, longest, covered, units)`` of documents with tiles of an item.

    A first pass gives the pairs that share a seed; only their texts are read again and cut into units.
    """
    cols = lambda p: [units(F.col(f"{p}_text"), kind).alias(f"{p}_{kind.name}") for kind in kinds]
    d = docs.where(F.col(doc_id).isNotNull() & F.col(text).isNotNull()).select(F.col(doc_id).alias("doc_id"), F.col(text).alias("doc_text"))
    i = items.where(F.col(item_id).isNotNull() & F.col(text).isNotNull()).dropDuplicates([item_id]).select(F.col(item_id).alias("item_id"), F.col(text).alias("item_text"))
    of_items = with_seeds(i.select("item_id", *cols("item")), "item", lambda k: 1, kinds).distinct()
    of_docs = with_seeds(d.select("doc_id", *cols("doc")), "doc", lambda k: k.least - k.gram + 1, kinds)
    if of_items.limit(BROADCAST_SEEDS + 1).count() <= BROADCAST_SEEDS:
        of_items = F.broadcast(of_items)
    pairs = of_docs.join(of_items, "seed").select("doc_id", "item_id").distinct()
    full = pairs.join(d, "doc_id").join(i, "item_id").select("doc_id", "item_id", *[c for k in range(len(kinds)) for c in (cols("doc")[k], cols("item")[k])])
    types = dict(docs.dtypes)[doc_id], dict(items.dtypes)[item_id]
    return full.mapInPandas(_tile(kinds), f"doc_id {types[0]}, item_id {types[1]}, kind string, tiles int, longest int, covered int, units int")


def covered(found: DataFrame, share: float) -> DataFrame:
    """``(doc_id, item_id, coverage)`` of the pairs whose tiles, however ordered, cover ``share`` of the
    item's units; with ``PIECES`` as kinds of unit the tiles may be short."""
    best = found.groupBy("doc_id", "item_id").agg(F.max(F.col("covered") / F.col("units")).alias("coverage"))
    return best.where(F.col("coverage") >= share)


def leaked_items(found: DataFrame) -> DataFrame:
    """Per item: the documents that contain some of it and the most that one of them covers."""
    per = covered(found, 0.0)
    return per.groupBy("item_id").agg(F.count(F.lit(1)).alias("docs"), F.round(F.max("coverage"), 4).alias("most_covered"))

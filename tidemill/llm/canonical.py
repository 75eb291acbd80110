"""Problem 6: freely typed values mapped to the entries of a reference list.

The entries and their alias paths are put into a trie without blanks: words in another order, with ``of``,
words behind the first cut short (by rule: ``short_forms``, initials), the distinctive word alone
where it is unique, and whatever a table of aliases adds.  A typed value is folded (case, accents, digits
for letters, signs, filler words) and run through the trie as a Levenshtein automaton: a bit-parallel set of
positions per number of errors, with transpositions.  All entries within a distance that depends on the
length are returned (``candidates``); the nearest one is the entry meant.

Only distinct values are searched, each once.  A list longer than ``MAX_TERMS`` entries is searched in
blocks, each with a trie of its own, and the nearest of all blocks is taken.

Defined results: null, empty and blank-only values give no row; literal names give no row in
``mapped``'s findings; values of several entries (comma or slash) give one row each; a value
nearest to two entries at once takes the one with the lower id; repeated reports count once.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Entries of one trie; a task holds one at a time.
MAX_TERMS = 200_000
#: Signs typed for letters, and filler words around a name.
TYPED_FOR = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}
BEFORE = ("the", "some", "maybe", "perhaps", "possibly", "probably", "type", "brand", "category", "kind", "from")
AFTER = ("sms", "app", "text", "msg", "message", "inc", "ltd", "llc", "corp")
FILLER = {*BEFORE, *AFTER, "of", "co"}


def fold(value: str) -> list[str]:
    """The words of a typed value in one dress."""
    s = "".join(c for c in unicodedata.normalize("NFKD", value) if not unicodedata.combining(c)).lower()
    out = []
    for w in re.split(r"[^\w@$]+|_", s):
        if re.search(r"[^\W\d_]", w):  # signs stand for letters only in a word that has letters
            w = "".join(TYPED_FOR.get(c, c) for c in w)
        w = re.sub(r"[\W_]", "", w)
        if w:
            out.append(w)
    return out


def _off_by(a: str, b: str) -> int | None:
    """0 or 1 edits between two words (transpositions count one), None for more."""
    if a == b:
        return 0
    n, m = len(a), len(b)
    if abs(n - m) > 1:
        return None
    i = 0
    while i < min(n, m) and a[i] == b[i]:
        i += 1
    if n == m:
        return 1 if a[i + 1 :] == b[i + 1 :] or a[i : i + 2] == b[i : i + 2][::-1] and a[i + 2 :] == b[i + 2 :] else None
    return 1 if (a[i + 1 :] == b[i:] if n > m else a[i:] == b[i + 1 :]) else None


def readings(words: list[str]) -> dict[str, int]:
    """The strings a value may stand for, without blanks, with the edits spent on fillers.

    As written; without filler words; and without a filler that is misspelt or grown together.
    """
    out = {"".join(words): 0}
    out.setdefault("".join(w for w in words if w not in FILLER), 0)
    for q in list(out):
        for fillers, cut in ((BEFORE, lambda n: (q[:n], q[n:])), (AFTER, lambda n: (q[len(q) - n :], q[: len(q) - n]))):
            for f in fillers:
                for n in (len(f) - 1, len(f), len(f) + 1):
                    if 2 < n < len(q) - 3:
                        part, rest = cut(n)
                        d = _off_by(f, part)
                        if d is not None:
                            out[rest] = min(out.get(rest, 9), d)
    return {q: d for q, d in out.items() if q}


def within(root: dict, value: str) -> dict[int, int]:
    """Every entry within the allowed distance of a typed value, with the distance."""
    found: dict[int, int] = {}
    for q, spent in readings(fold(value)).items():
        k = allowed(len(q)) - (spent > 1)
        if len(q) - k <= root["longest"]:
            for i, d in search(root["trie"], q, k).items():
                found[i] = min(d + spent, found.get(i, 99))
    return found


def nearest(root: dict, value: str) -> dict[int, int]:
    """Of ``within`` the entry of least distance and, among equals, least id: the distance is raised step by
    step until an entry is met, so a value that is nearly right costs little."""
    reads = [(q, spent, allowed(len(q)) - (spent > 1)) for q, spent in readings(fold(value)).items()]
    reads = [r for r in reads if len(r[0]) - r[2] <= root["longest"]]
    for total in range(max((spent + k for _, spent, k in reads), default=-1) + 1):
        found = [i for q, spent, k in reads if 0 <= total - spent <= k for i in search(root["trie"], q, total - spent)]
        if found:
            return {min(found): total}
    return {}


def short_forms(word: str) -> set[str]:
    """How a word may be cut short: its beginnings, its consonants, the first and last of them."""
    if len(word) < 4:
        return set()
    once = re.sub(r"(.)\1", r"\1", word)
    consonants = once[0] + re.sub("[aeiou]", "", once[1:])
    return {f for f in (word[:3], word[:4], word[:5], consonants, consonants[0] + consonants[-1]) if 1 < len(f) < len(word)}


def aliases(words: list[str], alone: bool) -> set[str]:
    """The paths of one entry, without blanks; the words behind the first may be cut short, two and more of
    them given by their initials.  Of entries with more than four words only one word is cut short."""
    forms = [words[:1]]
    for w in words[1:]:
        short = sorted(short_forms(w))
        forms = [[*f, x] for f in forms for x in [w, *(short if len(words) <= 4 or f == words[: len(f)] else [])]]
    if len(words) > 2:
        forms.append([words[0], "".join(w[0] for w in words[1:])])
    out = set()
    for w in forms:
        for k in range(len(w)):  # any rotation: the distinctive word last, or several words moved
            out.add("".join(w[k:] + w[:k]))
        out.add("".join([*w[1:], "of", w[0]]) if len(w) > 1 else w[0])
        out.add("".join(reversed(w)))
    if alone:
        out.add(words[0])
    return out


def build_trie(terms: list[tuple[int, str]], single_words: bool, extra: list[tuple[int, str]] = ()) -> dict:
    """``trie`` and the length of its ``longest`` path.  Nodes are dicts by letter; ``""`` holds the entries
    that end there.  ``extra`` are aliases by entry."""
    folded = [(i, [w for w in fold(n) if w != "of"]) for i, n in terms]
    names = {tuple(w) for _, w in folded}
    first: dict[str, set[int]] = {}
    for i, w in folded:
        if w:
            first.setdefault(w[0], set()).add(i)
    root: dict = {}
    longest = 0
    for i, w in folded:
        if not w:
            continue
        several = single_words and len(first[w[0]]) > 1
        for a in aliases(w, single_words and len(w) > 1 and not several):
            _put(root, a, i)
            longest = max(longest, len(a))
        if several and (w[0],) not in names:  # the distinctive word alone means no single entry
            _put(root, w[0], 0)
    for i, a in extra:
        for path in {"".join(fold(a)), "".join(w for w in fold(a) if w not in FILLER)} - {""}:
            _put(root, path, i)
            longest = max(longest, len(path))
    return {"trie": root, "longest": longest}


def _put(root: dict, path: str, entry: int) -> None:
    node = root
    for c in path:
        node = node.setdefault(c, {})
    ends = node.setdefault("", [])
    if entry not in ends:
        ends.append(entry)


def allowed(n: int) -> int:
    """Edits allowed for a value of n letters."""
    return 0 if n < 4 else 1 if n < 7 else 2 if n < 15 else 3


def search(root: dict, query: str, k: int) -> dict[int, int]:
    """Every entry within k edits (transpositions count one) with its distance."""
    mask: dict[str, int] = {}
    for i, c in enumerate(query):
        mask[c] = mask.get(c, 0) | 1 << i
    full = (1 << len(query) + 1) - 1
    end = 1 << len(query)
    start = [((1 << d + 1) - 1) & full for d in range(k + 1)]
    found: dict[int, int] = {}
    stack = [(root, start, None, "")]
    while stack:
        node, rows, before, last = stack.pop()
        for i in node.get("", ()):
            for d, r in enumerate(rows):
                if r & end:
                    found[i] = min(d, found.get(i, d))
                    break
        for c, child in node.items():
            if not c:
                continue
            m = mask.get(c, 0)
            new = [(rows[0] & m) << 1]
            for d in range(1, k + 1):
                r = (rows[d] & m) << 1 | rows[d - 1] | rows[d - 1] << 1 | new[d - 1] << 1
                if before is not None:
                    r |= (before[d - 1] & m & mask.get(last, 0) >> 1) << 2
                new.append(r & full)
            if new[k]:
                stack.append((child, new, rows, c))
    return found


@lru_cache(maxsize=8)
def _tries(terms: tuple, extra: tuple) -> dict[str, dict]:
    """The tries of one block of the list; a Python worker builds them once."""
    return {k: build_trie([t[1:] for t in terms if t[0] == k], k == "brand", [t[1:] for t in extra if t[0] == k]) for k in {t[0] for t in terms}}


def _lookup(terms: tuple, extra: tuple, find: Callable[[dict, str], dict[int, int]]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tries = _tries(terms, extra)
        for b in batches:
            found = [find(tries[kind], value) if kind in tries else {} for kind, value in zip(b["kind"], b["value"])]
            yield pd.DataFrame({"kind": b["kind"], "value": b["value"], "found": [[{"distance": d, "term_id": i} for i, d in f.items()] for f in found]})

    return run


def _blocks(listed: list[tuple[str, int, str]]) -> Iterator[tuple]:
    """The list cut into blocks; entries of one kind that share their first word stay together."""
    keyed = sorted((kind, (fold(name) or [""])[0], i, name) for kind, i, name in listed)
    block: list[tuple] = []
    for row in keyed:
        if len(block) >= MAX_TERMS and row[:2] != block[-1][:2]:
            yield tuple((k, i, n) for k, _, i, n in block)
            block = []
        block.append(row)
    if block:
        yield tuple((k, i, n) for k, _, i, n in block)


def typed(reports: DataFrame, id_col: str, fields: list[str], lists: tuple[str, ...] = ("brand",)) -> DataFrame:
    """``(id, kind, cell, value)``: one row per filled cell, or per part of a cell that may list several."""
    cells = F.array(*[F.struct(F.lit(f).alias("kind"), F.col(f).cast("string").alias("cell")) for f in fields])
    rows = reports.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.explode(cells).alias("x")).select("id", "x.*")
    rows = rows.where(F.col("cell").isNotNull() & (F.col("cell") != ""))
    parts = F.when(F.col("kind").isin(*lists) & F.col("cell").rlike("[,/]"), F.filter(F.split("cell", "[,/]"), lambda p: F.trim(p) != "")).otherwise(F.array("cell"))
    parts = F.when(F.size(parts) > 0, parts).otherwise(F.array("cell"))
    return rows.select("id", "kind", "cell", F.explode(parts).alias("value"))


def candidates(values: DataFrame, terms: DataFrame, more: DataFrame | None = None, find: Callable[[dict, str], dict[int, int]] = within) -> DataFrame:
    """Distinct ``(kind, value)`` with ``found``: all entries within the allowed distance, as
    ``array<struct<distance, term_id>>``.  ``more(term_id, alias)`` adds aliases of entries."""
    named = terms.where("term_id is not null and name is not null and kind is not null").select("kind", "term_id", "name")
    listed = [tuple(r) for r in named.collect()]  # the reference list; its tries, block by block, go to the tasks
    extra = [] if more is None else [tuple(r) for r in more.where("alias is not null").join(named.select("kind", "term_id"), "term_id").select("kind", "term_id", "alias").collect()]
    distinct = values.select("kind", "value").distinct()
    n = int(values.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    distinct = distinct.repartition(n)
    out = None
    for block in list(_blocks(listed)) or [()]:
        ids = {(k, i) for k, i, _ in block}
        part = distinct.mapInPandas(_lookup(block, tuple(sorted(x for x in extra if x[:2] in ids)), find), "kind string, value string, found array<struct<distance:int,term_id:long>>")
        out = part if out is None else out.union(part)
    if len(listed) > MAX_TERMS:
        out = out.groupBy("kind", "value").agg(F.flatten(F.collect_list("found")).alias("found"))  # one row per block
    return out


def to_terms(values: DataFrame, terms: DataFrame, more: DataFrame | None = None) -> DataFrame:
    """Distinct ``(kind, value)`` with the entry meant (0: none) and its distance (-1: none)."""
    best = F.array_min("found")
    known = F.coalesce(best["term_id"], F.lit(0)) > 0
    return candidates(values, terms, more, nearest).select("kind", "value", F.when(known, best["term_id"]).otherwise(F.lit(0)).alias("term_id"), F.when(known, best["distance"]).otherwise(F.lit(-1)).alias("distance"))


def unnamed(reports: DataFrame, terms: DataFrame, id_col: str = "report_id", fields: tuple[str, ...] = ("category", "brand", "scam_type")) -> DataFrame:
    """``(id, kind, cell, value)`` of the cells that are not literally a name."""
    names = terms.select("kind", F.col("name").alias("cell")).distinct()
    return typed(reports, id_col, list(fields)).join(names, ["kind", "cell"], "left_anti")


def mapped(reports: DataFrame, terms: DataFrame, id_col: str = "report_id", fields: tuple[str, ...] = ("category", "brand", "scam_type"), more: DataFrame | None = None) -> DataFrame:
    """``(id, field_name, value, term_id, distance)`` of every cell that is not literally a name."""
    rest = unnamed(reports, terms, id_col, fields)
    found = to_terms(rest, terms, more)
    return rest.join(found, ["kind", "value"]).select(F.col("id").alias(id_col), F.col("kind").alias("field_name"), "value", "term_id", "distance")

"""Problem 7: one form for texts that look the same but differ in their characters.

Texts with a character outside plain ASCII are exploded to positioned code points.  A broadcast join
with a table of bounded size (Unicode's own decompositions, the look-alike letters, the invisible
characters and the spaces) replaces each one; combining marks are ordered by their class behind
their starter; the strings are rebuilt and recomposed.  A pure ASCII text needs only its blanks
normalised, which a built-in expression does.

What stays different: case, a missing or additional visible mark, digits for letters, superscripts,
circled forms and fractions, and emoji joined or varied by a joiner or selector (that is visible).

Defined results: a null text has a null form; empty and blank texts have the form ''; line breaks are
kept as one line feed per run of blanks with a break; a text of any length is handled whole.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import stage

#: Letters of other scripts and the Latin letters they look like.  ``confusables`` reads more.
LOOKALIKE = {
    # Cyrillic
    "а": "a", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "ӏ": "l", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "ѵ": "v", "ԝ": "w", "х": "x", "у": "y",
    "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ѕ": "S", "Т": "T", "Х": "X", "У": "Y", "Ԛ": "Q", "Ԝ": "W", "Ѵ": "V", "Ӏ": "I",
    # Greek
    "ο": "o", "ν": "v", "ρ": "p", "ϲ": "c", "ϳ": "j", "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "Ϲ": "C", "Ϳ": "J",
    "Ү": "Y", "ү": "y", "Ԍ": "G", "α": "a", "γ": "y", "ι": "i", "σ": "o", "υ": "u", "ϱ": "p",
    # Coptic, Lisu
    "Ⲃ": "B", "Ⲏ": "H", "Ⲓ": "I", "Ⲕ": "K", "Ⲙ": "M", "Ⲛ": "N", "Ⲟ": "O", "Ⲣ": "P", "ⲣ": "p", "Ⲥ": "C", "ⲥ": "c", "Ⲧ": "T", "Ⲩ": "Y", "Ⲭ": "X", "Ⲍ": "Z",
    "ꓐ": "B", "ꓑ": "P", "ꓓ": "D", "ꓔ": "T", "ꓖ": "G", "ꓗ": "K", "ꓙ": "J", "ꓚ": "C", "ꓜ": "Z", "ꓝ": "F", "ꓟ": "M", "ꓠ": "N", "ꓡ": "L", "ꓢ": "S", "ꓣ": "R", "ꓦ": "V", "ꓧ": "H", "ꓪ": "W", "ꓫ": "X", "ꓬ": "Y", "ꓮ": "A", "ꓰ": "E", "ꓲ": "I", "ꓳ": "O", "ꓴ": "U",
    # Armenian, Latin extensions, Cherokee
    "Օ": "O", "Տ": "S", "Լ": "L", "Ս": "U", "յ": "j", "ᴄ": "c", "ᴏ": "o", "ꜱ": "s", "ᴜ": "u", "ᴠ": "v", "ᴡ": "w", "ᴢ": "z", "Ꭰ": "D", "Ꭱ": "R", "Ꭻ": "J", "Ꭵ": "i", "Ꮐ": "G", "Ꮤ": "W", "Ꮟ": "b",
    "օ": "o", "ս": "u", "հ": "h", "ո": "n", "ց": "g", "զ": "q", "ɡ": "g", "ɑ": "a", "ⲟ": "o", "Ꭺ": "A", "Ꭼ": "E", "Ꮋ": "H", "Ꮇ": "M", "Ꮲ": "P", "Ꭲ": "T", "Ꮃ": "W", "Ꮓ": "Z", "Ꮪ": "S", "Ꮩ": "V", "Ꮮ": "L", "Ꮯ": "C", "Ᏼ": "B", "Ꮶ": "K",
}
#: Compatibility decompositions that look the same; others (super, sub, circle, fraction, square, font) are visible.
SAME_LOOK = ("<wide>", "<narrow>", "<noBreak>", "<compat>", "<isolated>", "<initial>", "<medial>", "<final>")
JOINER, SELECTOR = "\u200d", "\ufe0f"
#: Private letters that stand for them while a text is taken apart.
HELD = "\ue000\ue001"
#: Base characters after which a joiner or selector is visible.
_EMOJI = "[\\x{2190}-\\x{2BFF}\\x{3030}\\x{303D}\\x{3297}\\x{3299}\\x{1F000}-\\x{1FAFF}\\x{FE0F}\\x{20E3}]"


#: Characters of a piece of text that is taken apart in one task.
PIECE = 4000


def _invisible(ch: str) -> bool:
    return unicodedata.category(ch) in ("Cf", "Cc", "Cs") and ch not in "\t\n\r\x0b\x0c\x85" or ch in "\u034f\u115f\u1160\u17b4\u17b5\u3164\uffa0" or 0xFE00 <= ord(ch) <= 0xFE0F or 0x180B <= ord(ch) <= 0x180F


def _expand(ch: str) -> str:
    """What a code point becomes: decomposed, then look-alikes replaced."""
    kind = unicodedata.decomposition(ch).partition(" ")[0]
    if unicodedata.category(ch) in ("Zs", "Zl", "Zp") or ch in "\t\n\r\x0b\x0c\x85":
        return "\n" if ch in "\n\r\x0b\x0c\x85\u2028\u2029" else " "
    if kind.startswith("<"):
        if kind not in SAME_LOOK or ch in "\u2026\u2025" or unicodedata.decomposition(ch).split()[1] == "0020":
            return LOOKALIKE.get(ch, ch)
        parts = "".join(chr(int(x, 16)) for x in unicodedata.decomposition(ch).split()[1:])
        return "".join(_expand(p) for p in parts)
    return "".join(LOOKALIKE.get(p, p) for p in unicodedata.normalize("NFD", ch))


def confusables(path: str) -> tuple[tuple[str, str], ...]:
    """More look-alikes from a file in the format of Unicode's confusables.txt (``source ; target ; type``).
    Digits and letters of ASCII stay what they are: they are told apart on screen."""
    out = {}
    with open(path, encoding="utf-8-sig") as f:
        for line in f:
            part = line.partition("#")[0].split(";")
            if len(part) >= 2:
                ch, to = ("".join(chr(int(x, 16)) for x in p.split()) for p in part[:2])
                if len(ch) == 1 and not ch.isascii() and to:
                    out[ch] = to
    return tuple(sorted(out.items()))


@lru_cache(maxsize=4)
def mapping(more: tuple[tuple[str, str], ...] = ()) -> list[tuple[str, int, str, int]]:
    """``(ch, sub, to, ccc)`` of every code point that changes or combines; its size is Unicode's."""
    out, extra = [], dict(more)
    for cp in range(0x80, sys.maxunicode + 1):
        ch = chr(cp)
        if 0xD800 <= cp <= 0xDFFF or 0xAC00 <= cp <= 0xD7A3:  # surrogates; Hangul syllables recompose to themselves
            continue
        to = "" if _invisible(ch) else _expand(ch)
        if extra:  # look-alikes of look-alikes end where nothing more is listed
            for _ in range(4):
                to = "".join(x if x.isascii() else unicodedata.normalize("NFD", extra.get(x, x)) for x in to)
        if to != ch or unicodedata.combining(ch):
            out += [(ch, i, c, unicodedata.combining(c)) for i, c in enumerate(to)] or [(ch, 0, "", 0)]
    return out


def mapping_table(spark: SparkSession, more: tuple[tuple[str, str], ...] = ()) -> DataFrame:
    frame = pd.DataFrame(mapping(more), columns=["ch", "sub", "to", "ccc"])
    per = frame.groupby("ch", sort=False)
    rows = pd.DataFrame({"ch": [k for k, _ in per], "to": [[{"c": c, "k": k} for c, k in zip(g["to"], g["ccc"])] for _, g in per]})
    return spark.createDataFrame(rows, "ch string, to array<struct<c:string,k:int>>")


def _recompose(col: Column) -> Column:
    @F.pandas_udf("string")
    def nfc(s: pd.Series) -> pd.Series:
        return s.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")

    return nfc(col)


def _blanks(text: Column) -> Column:
    """Runs of blanks become one blank (or one line feed, where they hold one); the ends are cut."""
    text = F.regexp_replace(text, "[\\x00-\\x08\\x0e-\\x1f\\x7f]", "")
    text = F.regexp_replace(text, "[ \\t]*[\\n\\r\\x0b\\x0c][ \\t\\n\\r\\x0b\\x0c]*", "\n")
    return F.regexp_replace(F.regexp_replace(text, "[ \\t]+", " "), "^[ \\n]+|[ \\n]+$", "")


def one_form(rows: DataFrame, key: str = "id", text: str = "text", more: tuple[tuple[str, str], ...] = ()) -> DataFrame:
    """``(key, text, form)``, one row per input row; ``key`` must be unique and not null.

    Texts are taken apart in pieces of some ``PIECE`` characters, so a long text is the work of many tasks;
    a piece ends before a character that starts anew, so no mark is parted from its starter.
    """
    rows = rows.select(F.col(key).alias("k"), F.col(text).alias("t"))
    plain = F.coalesce(~F.col("t").rlike("[^\\x00-\\x7f]"), F.lit(True))
    easy = rows.where(plain).select("k", "t", _blanks(F.col("t")).alias("form"))
    # joiners and selectors inside emoji are visible: they are kept out of the mapping as private letters
    kept = F.regexp_replace(F.regexp_replace(F.translate("t", HELD, "\uf8fe\uf8ff"), f"({_EMOJI}){JOINER}(?={_EMOJI})", f"$1{HELD[0]}"), f"({_EMOJI}){SELECTOR}", f"$1{HELD[1]}")
    pieces = F.regexp_extract_all(kept, F.lit(rf"(?s).{{1,{PIECE}}}+[\p{{M}}\p{{Cf}}\x{{1160}}-\x{{11FF}}]*+"), F.lit(0))
    points = rows.where(~plain).select("k", F.posexplode(pieces).alias("piece", "s")).select("k", "piece", F.posexplode(F.split("s", "")).alias("pos", "ch"))
    joined = points.join(F.broadcast(mapping_table(rows.sparkSession, more)), "ch", "left")  # bounded by Unicode
    put = F.coalesce("to", F.array(F.struct(F.col("ch").alias("c"), F.lit(0).alias("k"))))
    parts = joined.select("k", "piece", "pos", F.posexplode(put).alias("sub", "x")).select("k", "piece", "pos", "sub", F.col("x.c").alias("c"), F.col("x.k").alias("ccc"))
    order = Window.partitionBy("k", "piece").orderBy("pos", "sub")
    marked = parts.where("c <> ''").withColumn("starter", F.sum((F.col("ccc") == 0).cast("int")).over(order))
    built = marked.groupBy("k", "piece").agg(F.array_sort(F.collect_list(F.struct("starter", "ccc", "pos", "sub", "c"))).alias("a"))
    built = built.select("k", "piece", F.array_join(F.transform("a", lambda x: x["c"]), "").alias("s"))
    built = built.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("piece", "s"))).alias("a")).select("k", F.array_join(F.col("a.s"), "").alias("s"))
    form = F.translate(_recompose(_blanks(F.col("s"))), HELD, JOINER + SELECTOR)
    hard = rows.where(~plain).join(built, "k", "left").select("k", "t", F.coalesce(form, F.lit("")).alias("form"))
    return easy.union(hard).toDF(key, text, "form")


def alike(rows: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """Pairs of rows whose texts look the same and are not the same string, smaller id first.

    Forms and strings are compared by 128-bit digests.  The pairs are made between distinct strings
    of one form first, so equal copies, however many, are never paired with each other.
    """
    once = rows.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(key, text).dropDuplicates([key])
    f = one_form(once, key, text)
    dig = lambda c: F.unhex(F.md5(c))
    d = stage(f.select(F.col(key).alias("id"), dig(F.col(text)).alias("raw"), dig(F.col("form")).alias("form")), "forms")
    mixed = d.groupBy("form").agg(F.min("raw").alias("lo"), F.max("raw").alias("hi")).where("lo <> hi").select("form")
    some = d.join(mixed, "form")
    strings = some.select("form", "raw").distinct()
    pairs = strings.select("form", F.col("raw").alias("ra")).join(strings.select("form", F.col("raw").alias("rb")), "form").where("ra < rb").drop("form")
    a, b = some.select(F.col("raw").alias("ra"), F.col("id").alias("x")), some.select(F.col("raw").alias("rb"), F.col("id").alias("y"))
    return pairs.join(a, "ra").join(b, "rb").select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))

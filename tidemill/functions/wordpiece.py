"""WordPiece tokenization of text against a given vocabulary, as an Arrow UDF."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

LONGEST = 100


def _pieces(text: str, vocab: dict[str, int], limit: int | None) -> list[int]:
    spaced = []
    for ch in text:
        cat = unicodedata.category(ch)
        if ch in "\t\n\r" or cat == "Zs":
            spaced.append(" ")
        elif cat in ("Cc", "Cf", "Co", "Cs") or ch == "�":
            continue
        elif "一" <= ch <= "鿿" or "㐀" <= ch <= "䶿" or "豈" <= ch <= "﫿" or 0x20000 <= ord(ch) <= 0x2FA1F:
            spaced.append(f" {ch} ")
        else:
            spaced.append(ch)
    low = "".join(c for c in unicodedata.normalize("NFD", "".join(spaced).lower()) if unicodedata.category(c) != "Mn")
    unknown, out = vocab["[UNK]"], []
    word: list[str] = []

    def flush() -> None:
        if not word:
            return
        w = "".join(word)
        word.clear()
        if len(w) > LONGEST:
            out.append(unknown)
            return
        ids, i = [], 0
        while i < len(w):
            for j in range(len(w), i, -1):
                piece = ("##" if i else "") + w[i:j]
                if piece in vocab:
                    ids.append(vocab[piece])
                    i = j
                    break
            else:
                out.append(unknown)
                return
        out.extend(ids)

    for ch in low:
        ascii_sign = 33 <= ord(ch) <= 126 and not ch.isalnum()
        if ch.isspace():
            flush()
        elif ascii_sign or unicodedata.category(ch).startswith("P"):
            flush()
            word.append(ch)
            flush()
        else:
            word.append(ch)
    flush()
    return [vocab["[CLS]"], *(out if limit is None else out[: limit - 2]), vocab["[SEP]"]]


def wordpiece(text: Column, vocab: dict[str, int], limit: int | None = 256) -> Column:
    """Token ids with start and end marks; greedy longest match, cut to ``limit`` ids
    unless that is None."""

    @F.pandas_udf("array<int>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: _pieces(t, vocab, limit), na_action="ignore")

    return run(text)


def pooled(tokens: Column) -> Column:
    """Mean of token vectors (array of arrays), scaled to unit length."""
    n = F.size(tokens)
    dims = F.sequence(F.lit(0), F.size(F.get(tokens, F.lit(0))) - 1)
    mean = F.transform(dims, lambda d: F.aggregate(tokens, F.lit(0.0), lambda a, v: a + v[d]) / n)
    norm = F.sqrt(F.aggregate(mean, F.lit(0.0), lambda a, x: a + x * x))
    return F.transform(mean, lambda x: F.coalesce(F.try_divide(x, norm), F.lit(0.0)))

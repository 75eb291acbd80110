"""Archive members, nested archives and tolerant decoding of binary sources."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Encodings tried in order, each strictly.
ENCODINGS = ("utf-8", "cp1252", "latin-1")


def binary_files(spark: SparkSession, path: str) -> DataFrame:
    """``(path, content)`` of the files under a path or glob."""
    return spark.read.format("binaryFile").load(path).select("path", "content")


def members(files: DataFrame, member: str, inner: str | None = None) -> DataFrame:
    """``(path, content)``: the named member of each archive; ``inner`` names a member of an archive inside it.

    Archives without the member give no row; unreadable archives raise.
    """

    def read(content: bytes, name: str) -> bytes | None:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            return z.read(name) if name in z.namelist() else None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, content in zip(b["path"], b["content"]):
                got = read(content, member)
                if got is not None and inner is not None:
                    got = read(got, inner)
                if got is not None:
                    rows.append((path, got))
            yield pd.DataFrame(rows, columns=["path", "content"])

    return files.select("path", "content").mapInPandas(run, "path string, content binary")


def decode(content: str | Column) -> Column:
    """Text of bytes: UTF-8 if valid, else cp1252 if every byte is defined there, else latin-1."""

    @F.pandas_udf("string")
    def fallback(s: pd.Series) -> pd.Series:
        def one(b: bytes) -> str:
            for e in ENCODINGS:
                try:
                    return b.decode(e)
                except UnicodeDecodeError:
                    continue
            raise AssertionError

        return s.map(one, na_action="ignore")

    return fallback(F.col(content) if isinstance(content, str) else content)


def unpack_once(df: DataFrame, path: str) -> None:
    """Writes ``df`` only if nothing is there yet."""
    df.write.mode("ignore").parquet(path)

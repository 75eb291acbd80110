"""Readers and sinks of text tables: CSV, tab-separated, nested JSON, Parquet; upserts and swaps."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch

NA = ("", " ", "NaN", "nan")


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV with a header, quoted line breaks and doubled quotes; blanks stay blank."""
    rows = spark.read.csv(path, schema=schema, header=True, multiLine=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return rows.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) if t == "string" else F.col(c) for c, t in rows.dtypes])


def write_csv(df: DataFrame, path: str, fields: list[str], mode: str = "errorifexists") -> None:
    """The fields in a fixed order, with a header; nulls as blanks."""
    df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in fields]).write.csv(path, header=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, mode=mode)


def unknown_as_null(df: DataFrame, tokens: tuple[str, ...] = NA) -> DataFrame:
    """String columns with the tokens for a missing value turned into null."""
    return df.select(*[F.when(~F.col(c).isin(*tokens), F.col(c)).alias(c) if t == "string" else F.col(c) for c, t in df.dtypes])


def tab_separated(lines: DataFrame, labels: list[str]) -> DataFrame:
    """``(label, text)`` of lines ``label<TAB>text``; only line feeds end a line; other labels are dropped."""
    cut = F.split("value", "\t", 2)
    return lines.where("trim(value) <> ''").select(F.lower(F.trim(cut[0])).alias("label"), F.get(cut, F.lit(1)).alias("text")).where(F.col("label").isin(labels) & F.col("text").isNotNull())


def json_messages(docs: DataFrame, column: str, path: str = "$.smsCorpus.message") -> DataFrame:
    """``(id, text)`` of a nested list whose ``text`` is a scalar or an object with ``$``."""
    rows = docs.select(F.explode(F.variant_get(F.try_parse_json(column), path, "array<variant>")).alias("m"))
    text = F.coalesce(F.try_variant_get("m", "$.text.$", "string"), F.try_variant_get("m", "$.text", "string"))
    return rows.select(F.try_variant_get("m", "$['@id']", "string").alias("id"), text.alias("text"))


def header_by_content(cells: DataFrame, row: str, first: str = "id") -> DataFrame:
    """Rows ``(row, values)`` below the first row whose first cell is ``first``."""
    head = cells.where(F.col("values")[0] == first).agg(F.min(row).alias("_h"))
    return cells.crossJoin(F.broadcast(head)).where(F.col(row) > F.col("_h")).drop("_h")


def aligned_vectors(ids: DataFrame, cache: DataFrame, id_col: str, vector: str) -> DataFrame | None:
    """Ids with their cached vectors, or None unless every id has one."""
    missing = ids.join(cache.where(F.col(vector).isNotNull()), id_col, "left_anti")
    return ids.join(cache, id_col) if missing.isEmpty() else None


def swap(df: DataFrame, path: str) -> str:
    """Writes a new version beside ``path`` and returns its place: a table is never overwritten while it is read."""
    new = f"{path}.{uuid.uuid4().hex}"
    df.write.parquet(new)
    return new


def upsert(table: DataFrame, fresh: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of other keys kept, rows of the fresh keys replaced."""
    return table.join(fresh.select(*keys).distinct(), keys, "left_anti").unionByName(fresh)


def by_split(df: DataFrame, path: str, column: str = "split") -> None:
    df.write.partitionBy(column).parquet(path)


def manifest(features: list[str], threshold: float, classes: list[str]) -> str:
    return json.dumps({"features": features, "threshold": threshold, "classes": classes}, ensure_ascii=False)


def without_column(spark: SparkSession, folders: list[str], column: str) -> DataFrame:
    """The rows of the folders whose files do not carry ``column`` yet; schemas alone are read to decide."""
    todo = [f for f in folders if column not in spark.read.parquet(f).columns]
    out = spark.read.parquet(todo[0]) if todo else spark.read.parquet(*folders).limit(0)
    for f in todo[1:]:
        out = out.unionByName(spark.read.parquet(f), allowMissingColumns=True)
    return out


def to_json_rows(df: DataFrame, *cols: str) -> Column:
    return F.to_json(F.struct(*[F.col(c) for c in cols]))

"""The driver contract: entry, queries against their SQL, and independence of the optional subpackage."""

import ast
import os
from pathlib import Path

import pytest

import __spark_entry__ as entry
from tidemill import queries as core

ROOT = Path(__file__).resolve().parents[1]
SMALL = "/root/testdata/sf0.001"


def test_nothing_else_imports_the_optional_subpackage():
    for p in (ROOT / "tidemill").rglob("*.py"):
        if "llm" in p.relative_to(ROOT / "tidemill").parts:
            continue
        for node in ast.walk(ast.parse(p.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any("llm" in n.split(".") for n in names), p


def test_every_sql_has_a_query():
    assert set(core.SQL) <= set(core.QUERIES) and set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test data")
def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test data")
@pytest.mark.parametrize("name", ["d1_exact_dedupe", "d5_label_rules", "d11_template_groups", "f3_domains", "a15_auc", "a18_macro_weighted", "o6_operating_points", "r1_group_folds", "r2_stratified_rows", "j11_padded_quota"])
def test_query_equals_its_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for t in os.listdir(SMALL):
        c.execute(f"CREATE VIEW {t[:-8]} AS SELECT * FROM '{SMALL}/{t}'")
    df = core.QUERIES[name](spark, SMALL)
    cols = sorted(df.columns)
    want = c.execute(f"SELECT {', '.join(cols)} FROM ({core.SQL[name]})").fetchall()
    same = lambda rows: sorted((tuple(float(v) if isinstance(v, (int, float)) else v for v in r) for r in rows), key=repr)
    assert same(map(tuple, df.select(*cols).collect())) == same(want)

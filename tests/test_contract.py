"""The driver's contract: names, SQL and the library without the optional subpackage."""

from __future__ import annotations

import ast
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from weftline.queries import ORACLE_SQL, QUERIES

ROOT = Path(__file__).resolve().parents[1]
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v: object) -> str:
    return f"{v:.9g}" if isinstance(v, float) else str(v)


def test_entry(spark):
    assert entry.entry(spark).limit(1).count() == 1


def test_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(QUERIES) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    want = con.sql(ORACLE_SQL[name])
    got = QUERIES[name](spark, sf_dir)
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    place = [want.columns.index(c) for c in columns]
    assert sorted(tuple(map(plain, r)) for r in got.select(*columns).collect()) == sorted(tuple(plain(r[i]) for i in place) for r in want.fetchall())


def test_nothing_else_imports_the_subpackage():
    for path in (ROOT / "weftline").rglob("*.py"):
        if "llm" in path.relative_to(ROOT / "weftline").parts:
            continue
        for node in ast.walk(ast.parse(path.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any("llm" in n.split(".") for n in names), path

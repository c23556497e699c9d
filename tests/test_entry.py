"""Queries against DuckDB on the smallest tables, streams against batches, and the library without its corpus part."""

import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from nocturne.plans.queries import FOUND

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if v != v else float(f"{v:.9g}") + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


@pytest.mark.parametrize("name", [n for n, (_, sql) in FOUND.items() if sql])
def test_query_equals_its_sql(spark, duck, name):
    query, sql = FOUND[name]
    got, want = query(spark, SF), duck.sql(sql)
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = sorted((tuple(plain(r[c]) for c in columns) for r in got.collect()), key=repr)
    at = [want.columns.index(c) for c in columns]
    assert rows == sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=repr)


@pytest.mark.parametrize("name", [n for n, (_, sql) in FOUND.items() if not sql])
def test_query_without_sql_gives_rows(spark, name):
    assert FOUND[name][0](spark, SF).count() > 0


def test_entry_gives_the_report(spark):
    assert {"device_id", "night_id", "coverage"} <= set(entry.entry(spark).columns)


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_the_rest_does_not_need_the_corpus_part():
    code = "import sys; sys.modules['nocturne.llm'] = None; import importlib.util as u; f = u.find_spec; u.find_spec = lambda n, *a: None if 'llm' in n or 'corpus' in n else f(n, *a); import __spark_entry__ as e; assert len(e.queries()) > 60; assert 'pipeline' not in e.queries()"
    subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).resolve().parents[1], check=True)

"""Every query runs, and those with SQL agree with it, on the smallest tables."""

import re
from collections import Counter
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as driver
from retrolens.plans import catalog


@pytest.fixture(scope="module")
def oracle(sf_dir):
    con = duckdb.connect()
    for f in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, sf_dir, oracle, name):
    frame = catalog.QUERIES[name](spark, sf_dir)
    columns = sorted(frame.columns)
    got = Counter(tuple(r[c] for c in columns) for r in frame.collect())
    if name in catalog.SQL:
        want = oracle.execute(catalog.SQL[name])
        names = [d[0] for d in want.description]
        assert sorted(names) == columns
        assert got == Counter(tuple(row[names.index(c)] for c in columns) for row in want.fetchall())


def test_entry(spark):
    assert driver.entry(spark).count() > 0
    assert set(catalog.QUERIES) <= set(driver.queries()) and set(driver.oracle_sql()) <= set(driver.queries())


def test_nothing_needs_the_corpus_operators():
    for f in Path(__file__).resolve().parents[1].glob("retrolens/**/*.py"):
        if "llm" not in f.parts:
            assert not re.search(r"(import|from)\s+[\w.]*\bllm\b", f.read_text()), f

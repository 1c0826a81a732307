"""The registered queries against DuckDB's SQL, at the smallest scale."""

import math
import os
import re

import duckdb
import pytest

import __spark_entry__ as entry

ORACLES = {k: v for k, v in entry.oracle_sql().items() if not re.match(r"op\d+_|pipeline", k)}


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{f}'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    return tuple(map(plain, v)) if isinstance(v, list | tuple) else v


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, duck, sf, name):
    df = entry.queries()[name](spark, sf)
    columns = sorted(df.columns)
    got = sorted(repr([plain(r[c]) for c in columns]) for r in df.collect())
    result = duck.execute(ORACLES[name])
    names = [c[0] for c in result.description]
    assert sorted(names) == columns
    expected = sorted(repr([plain(r[names.index(c)]) for c in columns]) for r in result.fetchall())
    assert got == expected


def test_letters_of_pages_that_share_an_address(spark, tmp_path):
    """One row per address, its pages in the order of their ids; pages without HTML have no letters."""
    rows = [(1, "a", "<p>last</p>"), (2, "b", None), (3, "a", "<h1>first</h1> <a href='x'>one</a>"), (4, "a", None), (5, None, "<p>x</p>"), (6, None, "y"), (7, "c", "1"), (8, "c", None)]
    pages = f"{tmp_path}/pages.parquet"
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(pages)
    con = duckdb.connect(config={"threads": 1})  # the SQL leaves the order open: with one thread it is the file's
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{pages}/*.parquet'")
    got = entry.queries()["src_html_letters"](spark, str(tmp_path)).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, con.execute(ORACLES["src_html_letters"]).fetchall())) and len(got) == 4


def test_entry(spark):
    assert entry.entry(spark).count() == 5

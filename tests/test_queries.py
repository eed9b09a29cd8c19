"""Every query with SQL gives what another engine gives; every other one runs and has distinct columns."""

import datetime

import duckdb
import pytest

import __spark_entry__
from evidencia.plans import catalog


def cell(v):
    if v is None or v != v:
        return "null"
    if isinstance(v, float):
        return f"{v:.6f}"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, int):
        return f"{v:.6f}"
    if isinstance(v, datetime.datetime):
        return str(v.replace(tzinfo=None))
    return str(v)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_same_as_sql(spark, small, name):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    from pathlib import Path

    for p in Path(small).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from read_parquet('{p}')")
    df = catalog.QUERIES[name](spark, small)
    cur = con.execute(catalog.SQL[name])
    columns = [c[0] for c in cur.description]
    assert sorted(columns) == sorted(df.columns)
    want = sorted(tuple(cell(v) for v in r) for r in cur.fetchall())
    got = sorted(tuple(cell(v) for v in r) for r in df.select(columns).collect())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_runs(spark, small, name):
    df = catalog.QUERIES[name](spark, small)
    assert len(set(df.columns)) == len(df.columns)
    assert df.count() >= 0


def test_entry(spark, small):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_the_core_imports_no_corpus_operator():
    import pathlib

    import evidencia

    root = pathlib.Path(evidencia.__file__).parent
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert "evidencia.llm" not in p.read_text(), p

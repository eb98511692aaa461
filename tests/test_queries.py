"""Every registered query runs, and gives what its SQL twin gives."""

from pathlib import Path

import pandas as pd
import pytest

from passagemill.plans import core_queries


def rows(df):
    out = []
    for r in df[sorted(df.columns)].itertuples(index=False):
        out.append(tuple("NULL" if x is None or x is pd.NA or x is pd.NaT or x != x else f"{x:.6g}" if isinstance(x, float) and not x.is_integer() else str(int(x)) if isinstance(x, float) else str(list(x)) if hasattr(x, "__len__") and not isinstance(x, str) else str(x) for x in r))
    return sorted(out)


def compare(spark, d, name, f, sql):
    got = f(spark, d).toPandas()
    assert len(set(got.columns)) == len(got.columns)
    if sql is None:
        return
    import duckdb

    con = duckdb.connect()
    for p in Path(d).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    want = con.execute(sql).df()
    assert sorted(want.columns) == sorted(got.columns)
    assert rows(got) == rows(want), name


@pytest.mark.parametrize("name", sorted(core_queries.QUERIES))
def test_query(spark, small, name):
    compare(spark, small, name, core_queries.QUERIES[name], core_queries.ORACLES.get(name))


def test_nothing_outside_llm_imports_it():
    root = Path(__file__).resolve().parents[1] / "passagemill"
    for p in root.rglob("*.py"):
        if p.parent.name != "llm":
            assert "passagemill.llm" not in p.read_text(), p

import os

import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry

duckdb = pytest.importorskip("duckdb")
FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")


def canon(df):
    df = df[sorted(df.columns)].copy()
    for c in df:
        number = pd.to_numeric(df[c], errors="coerce") if df[c].dtype != object or df[c].map(lambda v: isinstance(v, (int, float)) or v is None).all() else None
        df[c] = number.astype(float).round(5) if number is not None else df[c].map(lambda v: None if v is None or v is pd.NA or v != v else str(v))
    return df.sort_values(list(df.columns), na_position="first", key=lambda s: s.astype(str)).reset_index(drop=True)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in os.listdir(FOLDER):
        c.execute(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM '{FOLDER}/{t}'")
    return c


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, con, name):
    got, want = canon(entry.queries()[name](spark, FOLDER).toPandas()), canon(con.execute(entry.oracle_sql()[name]).df())
    assert list(got.columns) == list(want.columns) and len(got) == len(want)
    for c in got:
        if got[c].dtype == float:
            assert np.allclose(got[c], want[c].astype(float), rtol=1e-6, atol=2e-5, equal_nan=True), c
        else:
            assert got[c].tolist() == want[c].tolist(), c


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


def test_core_stands_alone():
    import ast
    import pathlib

    root = pathlib.Path(entry.__file__).parent / "halyard"
    for path in root.rglob("*.py"):
        if "llm" in path.relative_to(root).parts:
            continue
        for node in ast.walk(ast.parse(path.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any(n.startswith("halyard.llm") for n in names), path

"""Every query that has SQL against it, on the smallest tables."""

import glob
import os
import re
from pathlib import Path

import duckdb
import pandas as pd
import pytest

from linkledger import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


def cells(frame):
    def cell(v):
        if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and v != v):
            return "~"
        return f"{v:.9g}" if isinstance(v, float) else str(v)

    columns = sorted(frame.columns)
    return sorted(tuple(cell(v) for v in row) for row in frame[columns].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_agrees_with_sql(spark, tables, name):
    got, want = catalog.QUERIES[name](spark, SF).toPandas(), tables.execute(catalog.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    whole = lambda frame: frame.apply(lambda c: c.astype(float) if pd.api.types.is_numeric_dtype(c) and not pd.api.types.is_bool_dtype(c) else c)
    assert cells(whole(got)) == cells(whole(want))


def test_the_rest_stands_without_the_corpus_operators():
    package = Path(catalog.__file__).parent
    for path in package.rglob("*.py"):
        if package / "llm" not in path.parents:
            assert not re.search(r"\bllm\b", path.read_text()), path

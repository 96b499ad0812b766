"""Every registered query against its SQL text on the given tables."""

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry_point
from tapewright.catalog import QUERIES
from tapewright.oracles import ORACLES

SF_DIR = "/root/testdata/sf0.01"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages"
    " benchmark labels conversations"
).split()
NO_SQL = {"pca_fit"}  # eigenvectors; checked against a dense solver in test_xsection


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    return con


def _rows(frame: pd.DataFrame) -> pd.DataFrame:
    out = frame[sorted(frame.columns)].copy()
    for c in out.columns:
        if pd.api.types.is_float_dtype(out[c]) or pd.api.types.is_integer_dtype(out[c]):
            out[c] = out[c].astype(float)
        elif pd.api.types.is_datetime64_any_dtype(out[c]):
            out[c] = out[c].astype("datetime64[us]").astype(str)
        else:
            values = pd.to_numeric(out[c], errors="coerce")
            if out[c].notna().any() and values.notna().sum() == out[c].notna().sum():
                out[c] = values.astype(float)
            else:
                out[c] = out[c].map(lambda v: None if v is None or v is pd.NaT else str(v)[:500])
    text = [c for c in out.columns if out[c].dtype == object]
    rest = [c for c in out.columns if c not in text]
    return out.sort_values(text + rest, na_position="first").reset_index(drop=True)


def test_every_query_has_sql():
    assert set(QUERIES) - set(ORACLES) == NO_SQL
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    got = QUERIES[name](spark, SF_DIR).toPandas()
    want = duck.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) == len(want) and len(got) > 0
    a, b = _rows(got), _rows(want)
    for c in a.columns:
        if a[c].dtype == float and b[c].dtype == float:
            x, y = a[c].to_numpy(), b[c].to_numpy()
            assert ((x == y) | (np.isnan(x) & np.isnan(y))).all(), c
        else:
            assert a[c].astype(str).str[:19].tolist() == b[c].astype(str).str[:19].tolist(), c


def test_entry_registers_the_catalog():
    assert set(QUERIES) <= set(entry_point.queries())
    assert set(ORACLES) <= set(entry_point.oracle_sql()) <= set(entry_point.queries())


def test_entry(spark):
    out = entry_point.entry(spark).toPandas()
    assert len(out) == 179 and out["atr"].notna().sum() == 179 - 13

"""Each query with SQL against DuckDB on the same tables."""

import os

import duckdb
import pandas as pd
import pytest

from strider.plans import queries as engine

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def compare(spark, query, sql, data=DATA):
    con = duckdb.connect()
    for f in os.listdir(data):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{data}/{f}'")
    ours, theirs = query(spark, data).toPandas(), con.execute(sql).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert len(ours) == len(theirs)
    cols = sorted(ours.columns)

    def sorted_rows(df):
        text = df[cols].apply(lambda c: c.map(lambda v: None if pd.isna(v) else (float(f"{v:.3f}") + 0.0 if isinstance(v, float) else v)))
        return df[cols].iloc[text.astype(str).agg("|".join, axis=1).argsort(kind="stable")].reset_index(drop=True)

    ours, theirs = sorted_rows(ours), sorted_rows(theirs)
    for c in cols:
        if pd.api.types.is_float_dtype(theirs[c]) and theirs[c].isna().sum() == ours[c].isna().sum() and not (theirs[c].dropna() % 1 == 0).all():
            pd.testing.assert_series_equal(ours[c], theirs[c], check_dtype=False, atol=2e-5, rtol=1e-9)
        else:  # whole numbers, strings, flags and times are equal, not near
            same = (ours[c] == theirs[c]) | (ours[c].isna() & theirs[c].isna())
            assert same.fillna(False).all(), f"{c}: {(~same.fillna(False)).sum()} rows differ"


@pytest.mark.parametrize("name", sorted(engine.oracle_sql()))
def test_query_equals_sql(spark, name):
    compare(spark, engine.queries()[name], engine.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(set(engine.queries()) - set(engine.oracle_sql())))
def test_query_runs(spark, name):
    assert len(engine.queries()[name](spark, DATA).toPandas())

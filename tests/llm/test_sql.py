"""The queries of operators that SQL can express, against their SQL on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from quirespark.llm import queries

SF = "/root/testdata/sf0.001"


def plain(df):
    return sorted(tuple("~" if pd.isna(x) else str(x) for x in r) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", ["op11_repair", "op12_top_k", "op13_prefix_trie"])
def test_query(spark, name):
    con = duckdb.connect()
    for t in ("conversations", "embeddings"):
        path = f"{SF}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path if os.path.isfile(path) else path + '/*.parquet'}'")
    got = queries.queries()[name](spark, SF).toPandas()
    want = con.sql(queries.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    number = lambda df: df.assign(**{c: df[c].astype("Int64") for c in df.columns if df[c].dtype.kind in "if"})
    assert plain(number(got)) == plain(number(want))

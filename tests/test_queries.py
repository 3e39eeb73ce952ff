"""Every registered query that has SQL, against DuckDB on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from foliant import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(df):
    cols = sorted(df.columns)
    number = lambda v: isinstance(v, (int, float)) or hasattr(v, "dtype")
    one = lambda v: None if pd.isna(v) is True else repr(float(v)) if number(v) else str(v)
    return sorted((tuple(one(v) for v in row) for row in df[cols].astype(object).itertuples(index=False)), key=str), cols


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_same_rows_as_sql(spark, con, name):
    assert plain(registry.QUERIES[name](spark, SF).toPandas()) == plain(con.execute(registry.ORACLE_SQL[name]).df())

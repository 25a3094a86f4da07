"""Every query of the catalogue against its SQL."""

import duckdb
import pandas as pd
import pytest

from quilate.plans import further  # noqa: F401
from quilate.plans.catalogue import QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def oracle():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", [n for n, (_, sql) in QUERIES.items() if sql])
def test_matches_sql(spark, oracle, name):
    f, sql = QUERIES[name]
    got, want = f(spark, SF).toPandas(), oracle.sql(sql).df()
    columns = sorted(got.columns)
    assert sorted(want.columns) == columns
    a, b = (x[columns].sort_values(columns, ignore_index=True) for x in (got, want))
    pd.testing.assert_frame_equal(a, b, check_dtype=False, rtol=1e-7)


@pytest.mark.parametrize("name", [n for n, (_, sql) in QUERIES.items() if not sql])
def test_gives_rows(spark, name):
    assert QUERIES[name][0](spark, SF).count() > 0

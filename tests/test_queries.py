"""Every registered query against its SQL at the smallest size."""

import os

import duckdb
import pandas as pd
import pytest

from fluxtide.plans import registry

registry.load()
SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return c


def tidy(df, cols):
    plain = lambda v: None if pd.isna(v) else (round(float(v), 4) + 0.0 if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v))
    out = df[cols].astype(object).apply(lambda c: c.map(plain))
    return out.sort_values(cols, key=lambda c: c.map(str)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, con, name):
    got = registry.QUERIES[name](spark, SF).toPandas()
    assert len(got.columns)
    if name in registry.ORACLE_SQL:
        want = con.sql(registry.ORACLE_SQL[name]).df()
        cols = sorted(want.columns)
        assert sorted(got.columns) == cols and len(got) == len(want)
        pd.testing.assert_frame_equal(tidy(got, cols), tidy(want, cols), check_dtype=False, atol=2e-4)

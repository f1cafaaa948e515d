"""Every query of the library against its SQL."""

import math
from collections import Counter

import duckdb
import pytest

import __spark_entry__
from tidepool.plans import catalogue


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    return v


@pytest.fixture(scope="module")
def con(sf_dir):
    con = duckdb.connect()
    for t in ("lineitem", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query(spark, con, sf_dir, name):
    got = catalogue.QUERIES[name](spark, sf_dir)
    want = con.execute(catalogue.SQL[name])
    cols = [d[0] for d in want.description]
    assert sorted(cols) == sorted(got.columns)
    rows = Counter(tuple(plain(v) for v in r) for r in want.fetchall())
    assert Counter(tuple(plain(r[c]) for c in cols) for r in got.collect()) == rows and rows


def test_entry_and_names(spark):
    assert __spark_entry__.entry(spark).count() == 1
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())

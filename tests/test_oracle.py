"""Every registered query against its DuckDB oracle on the smallest driver tables."""

import datetime as dt
import math
import os

import duckdb
import pytest

from conftest import SF_SMALL

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def _norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None)
    return v


def _key(row):
    return tuple((x is None, type(x).__name__, str(x)) for x in row)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        p = f"{SF_SMALL}/{t}.parquet"
        if os.path.exists(p):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return c


import __spark_entry__ as E  # noqa: E402

# the training-data queries have tests of their own
from vacancy_spark.plans.registry import ORACLE  # noqa: E402

QUERIES = {k: E.queries()[k] for k in ORACLE}


def test_every_query_has_an_oracle():
    from vacancy_spark.plans import registry
    assert set(registry.QUERIES) == set(ORACLE) and set(ORACLE) <= set(E.oracle_sql())


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_query_matches_oracle(spark, con, key):
    sdf = QUERIES[key](spark, SF_SMALL)
    cols = sdf.columns
    srows = [tuple(_norm(x) for x in r) for r in sdf.collect()]
    cur = con.execute(ORACLE[key])
    ocols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(ocols)
    idx = [ocols.index(c) for c in cols]
    orows = [tuple(_norm(r[i]) for i in idx) for r in cur.fetchall()]
    assert sorted(srows, key=_key) == sorted(orows, key=_key)


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert df.columns[0] == "uk_region"
    assert E.entry(spark).schema == df.schema

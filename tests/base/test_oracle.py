"""Every registered base query against its SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

from gridweave.plans.queries import ORACLE_SQL, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for t in ("embeddings", "events", "lineitem", "part"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    plain = lambda x: round(float(x), 9) if isinstance(x, (int, float)) and not isinstance(x, bool) else x if x is None or isinstance(x, str) else str(x)
    return [columns[k] for k in order], sorted((tuple(plain(r[k]) for k in order) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same(spark, duck, name):
    df = QUERIES[name](spark, SF)
    have, want = rows(df.columns, df.collect()), duck.sql(ORACLE_SQL[name])
    want = rows(want.columns, want.fetchall())
    assert have[0] == want[0] and len(have[1]) == len(want[1])
    key = lambda r: repr([round(x, 4) if isinstance(x, float) else x for x in r])
    for a, b in zip(sorted(have[1], key=key), sorted(want[1], key=key)):
        for x, y in zip(a, b):
            assert x == y or isinstance(x, float) and math.isclose(x, y, rel_tol=1e-6, abs_tol=1e-7), (name, a, b)

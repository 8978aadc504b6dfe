"""All core queries run on the smallest tables with the columns their SQL names, and agree with it."""

import glob
import math
import os

import pytest

from codestrata.plans import registry
from tests.conftest import SMALL, needs_data

duckdb = pytest.importorskip("duckdb")


def norm(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return round(float(v), 5) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.execute("SET timezone='UTC'")
    for p in glob.glob(f"{SMALL}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


@needs_data
@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_against_sql(spark, db, name):
    got = registry.queries()[name](spark, SMALL)
    want = db.execute(registry.oracle_sql()[name])
    cols = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(cols)
    a = sorted((tuple(norm(r[c]) for c in sorted(cols)) for r in got.collect()), key=repr)
    b = sorted((tuple(norm(v) for _, v in sorted(zip(cols, r))) for r in want.fetchall()), key=repr)
    assert a == b


@needs_data
@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_runs(spark, name):
    assert registry.queries()[name](spark, SMALL).columns

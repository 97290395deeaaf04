"""Every query of the engine against its SQL, over the whole small tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from quillfire import queries

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data here")


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        p = f"{DATA}/{t}.parquet"
        c.execute(f"create view {t} as select * from '{p}{'/*' if os.path.isdir(p) else ''}'")
    return c


def plain(v):
    return ("nan" if math.isnan(v) else round(v, 6) + 0.0) if isinstance(v, float) else v


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_against_sql(spark, db, name):
    df = queries.QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    r = db.execute(queries.SQL[name])
    names = [d[0] for d in r.description]
    assert sorted(names) == cols
    want = sorted((tuple(plain(dict(zip(names, x))[c]) for c in cols) for x in r.fetchall()), key=repr)
    assert sorted((tuple(plain(x[c]) for c in cols) for x in df.collect()), key=repr) == want


@pytest.mark.parametrize("times", [1, 1_000_003, 9_007_200])
def test_coercions_of_large_ids(spark, tmp_path, times):
    """Whole numbers of 1e15 and more, and of more than a double holds."""
    c = duckdb.connect()
    c.execute(f"copy (select * replace (event_id * {times} + 999900 as event_id) from '{DATA}/events.parquet') to '{tmp_path}/events.parquet' (format parquet)")
    c.execute(f"create view events as select * from '{tmp_path}/events.parquet'")
    df = queries.coercions(spark, str(tmp_path))
    names = [x[0] for x in c.execute(f"describe {queries.SQL['coercions']}").fetchall()]
    want = c.execute(queries.SQL["coercions"]).fetchall()
    assert sorted((tuple(plain(x[n]) for n in names) for x in df.collect()), key=repr) == sorted((tuple(map(plain, x)) for x in want), key=repr)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())

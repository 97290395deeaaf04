import os

import duckdb
import pytest

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf_dir():
    if not os.path.isdir(DATA):
        pytest.skip("no test data here")
    return DATA


@pytest.fixture
def sql(tmp_path):
    """Rows of a query over DataFrames, by DuckDB."""

    def run(text, **tables):
        c = duckdb.connect()
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(str(tmp_path / name))
            c.execute(f"create view {name} as select * from '{tmp_path / name}/*.parquet'")
        r = c.execute(text)
        cols = [d[0] for d in r.description]
        return sorted((tuple(dict(zip(cols, x))[k] for k in sorted(cols)) for x in r.fetchall()), key=repr)

    return run


@pytest.fixture(scope="session")
def rows():
    return lambda df: sorted((tuple(r[c] for c in sorted(df.columns)) for r in df.collect()), key=repr)

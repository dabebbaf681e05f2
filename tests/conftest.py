import os
import sys

import duckdb
import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from tesselark.session import session

    return session("tests", 8, **{"spark.driver.memory": "6g", "spark.sql.shuffle.partitions": "4"})


@pytest.fixture(scope="session")
def con():
    c = duckdb.connect()
    for name in os.listdir(DATA):
        if name.endswith(".parquet"):
            c.execute(f"CREATE VIEW {name[:-8]} AS SELECT * FROM read_parquet('{DATA}/{name}')")
    return c


def plain(v):
    if v is None or v != v:
        return None
    return round(float(v), 6) + 0.0 if isinstance(v, float) else v


def table(df):
    """Rows of a pandas frame by column name, in any order."""
    names = sorted(df.columns)
    return names, sorted(tuple(str(plain(x)) for x in r) for r in df[names].astype(object).itertuples(index=False))

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ.setdefault("HERON_DRIVER_MEMORY", "4g")


@pytest.fixture(scope="session")
def spark():
    from heron.session import build

    s = build()
    s.sparkContext.setLogLevel("ERROR")
    yield s


SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf_dir():
    return SF


def _plain(v):
    import datetime
    import decimal
    import math

    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, (list, tuple)):
        return tuple(map(_plain, v))
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


@pytest.fixture(scope="session")
def same_as_oracle(spark, sf_dir):
    """Runs a query and its SQL over the same tables and compares all rows."""
    import glob

    import duckdb

    con = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from read_parquet('{p}')")

    def check(query, sql):
        df = query(spark, sf_dir)
        names = sorted(df.columns)
        got = sorted((tuple(_plain(r[c]) for c in names) for r in df.collect()), key=str)
        r = con.execute(sql)
        columns = [d[0] for d in r.description]
        assert sorted(columns) == names
        want = sorted((tuple(_plain(dict(zip(columns, row, strict=True))[c]) for c in names) for row in r.fetchall()), key=str)
        assert list(map(str, got)) == list(map(str, want))

    return check

"""Every query of the catalogue against its SQL, on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from gridloom import catalogue

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.is_dir(), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.sql(f"create view {p.stem} as select * from read_parquet('{p}')")
    return con


def _rows(names, rows):
    def plain(x):
        return x if x is None or isinstance(x, str) else round(float(x), 6) if not math.isinf(float(x)) else float(x)

    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted(([plain(r[k]) for k in order] for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, con, name):
    df = catalogue.QUERIES[name](spark, str(DATA))
    got = [tuple(r) for r in df.collect()]
    assert got and len(set(df.columns)) == len(df.columns)
    if name in catalogue.SQL:
        rel = con.sql(catalogue.SQL[name])
        assert sorted(rel.columns) == sorted(df.columns)
        assert _rows(df.columns, got) == _rows(rel.columns, rel.fetchall())

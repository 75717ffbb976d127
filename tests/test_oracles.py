"""Every query with an oracle against DuckDB on the smallest tables; test_burst.py holds the others against NumPy."""

import glob
import math
import os

import duckdb
import pytest

from gramtide.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def norm(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, (list, tuple)):
        return tuple(map(norm, v))
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        v = float(v)
        return "nan" if math.isnan(v) else float(f"{v:.8g}") + 0.0
    return str(v)[:19] if hasattr(v, "isoformat") else v


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_equals_sql(spark, duck, name):
    mine = catalog.QUERIES[name](spark, SF)
    columns = sorted(mine.columns)
    theirs = duck.sql(catalog.ORACLE[name])
    assert columns == sorted(theirs.columns)
    want = duck.sql(f"SELECT {', '.join(chr(34) + c + chr(34) for c in columns)} FROM ({catalog.ORACLE[name]})").fetchall()
    key = lambda rows: sorted((tuple(map(norm, r)) for r in rows), key=repr)
    assert key(mine.select(*columns).collect()) == key(want)



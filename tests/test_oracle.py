"""Every core query with SQL equals it at scale 0.01."""

import math
from pathlib import Path

import duckdb
import pytest

from breathline.plans import catalog

FOLDER = "/root/testdata/sf0.01"


def _key(row):
    return tuple((v is not None, round(v, 4) if isinstance(v, float) else v) if not isinstance(v, (list, dict)) else (True, str(v)) for v in row)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in Path(FOLDER).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_equals_sql(spark, duck, name):
    df = catalog.queries()[name](spark, FOLDER)
    got = [tuple(r) for r in df.select(*sorted(df.columns)).collect()]
    sql = catalog.oracle_sql()[name]
    want = duck.sql(sql)
    order = sorted(want.columns)
    assert order == sorted(df.columns)
    rows = duck.sql(f"SELECT {', '.join(chr(34) + c + chr(34) for c in order)} FROM ({sql})").fetchall()
    assert len(got) == len(rows) > 0
    for a, b in zip(sorted(got, key=lambda r: str(_key(r))), sorted(rows, key=lambda r: str(_key(r))), strict=True):
        for x, y in zip(a, b, strict=True):
            assert x == y or (isinstance(x, float) and isinstance(y, float) and math.isclose(x, y, rel_tol=1e-6, abs_tol=2e-5)), (a, b)

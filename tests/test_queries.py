"""Every registered query of the library against its SQL, on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from neumatic.queries import oracle_sql, queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def cell(x):
    if x is None:
        return ""
    if isinstance(x, float):
        return "" if math.isnan(x) else f"{x:.8g}"
    return f"{float(x):.8g}" if isinstance(x, int) and not isinstance(x, bool) else str(x)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_equals_sql(spark, db, name):
    frame = queries()[name](spark, SF)
    columns = sorted(frame.columns)
    got = sorted(tuple(cell(r[c]) for c in columns) for r in frame.collect())
    cursor = db.execute(oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    expected = sorted(tuple(cell(float(r[i]) if type(r[i]).__name__ == "Decimal" else r[i]) for i in at) for r in cursor.fetchall())
    assert got == expected

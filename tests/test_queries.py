"""Every registered query of the ledger equals its SQL twin, run by DuckDB on the same files."""

import math
import os
from pathlib import Path

import duckdb
import pytest

from meterlake.plans import catalogue

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")
pytestmark = pytest.mark.skipif(not Path(SF_DIR).is_dir(), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in Path(SF_DIR).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


def rows_of(columns, rows):
    """Rows with columns by name, in an order of their own; doubles to 12 significant digits."""
    order = sorted(range(len(columns)), key=lambda k: columns[k])

    def tidy(v):
        if isinstance(v, float):
            return 0.0 if v == 0 else round(v, 11 - math.floor(math.log10(abs(v))))
        return v

    return sorted(columns), sorted((tuple(tidy(r[k]) for k in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query_equals_its_sql(spark, duck, name):
    df = catalogue.queries()[name](spark, SF_DIR)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    found = duck.execute(catalogue.oracle_sql()[name])
    want = rows_of([c[0] for c in found.description], found.fetchall())
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1])
    assert got[1] == want[1]


def test_every_query_has_sql():
    assert catalogue.queries().keys() == catalogue.oracle_sql().keys()

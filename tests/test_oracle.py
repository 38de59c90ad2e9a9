import glob
import os

import duckdb
import pytest

from ledgerloom.oracle import ORACLE
from ledgerloom.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def ordered(rows):
    return sorted(rows, key=lambda r: [(v is None, str(v)) for v in r])


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_equals_sql(spark, db, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    want = db.sql(ORACLE[name])
    assert sorted(want.columns) == columns
    places = [want.columns.index(c) for c in columns]
    assert ordered([tuple(r[c] for c in columns) for r in df.collect()]) == ordered([tuple(r[i] for i in places) for r in want.fetchall()])


def test_entry_lists_everything():
    import __spark_entry__ as entry

    assert QUERIES.keys() <= entry.queries().keys()
    assert entry.oracle_sql().keys() <= entry.queries().keys()

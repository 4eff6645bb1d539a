import duckdb
import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def checker():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(entry.CORE))
def test_same_as_sql(spark, checker, name):
    frame = entry.queries()[name](spark, SF)
    rows = sorted(repr(tuple(r[c] for c in sorted(frame.columns))) for r in frame.collect())
    if name not in entry.oracle_sql():
        assert rows
        return
    found = checker.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == sorted(frame.columns)
    at = [columns.index(c) for c in sorted(columns)]
    assert rows == sorted(repr(tuple(r[i] for i in at)) for r in found.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0

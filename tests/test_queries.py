"""Every registered query of the library's own operators against DuckDB on the smallest tables."""

import duckdb
import pytest

from docloom.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_duckdb(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted(repr([r[c] for c in columns]) for r in df.collect())
    cursor = duck.execute(ORACLE_SQL[name])
    at = [x[0] for x in cursor.description]
    assert sorted(at) == columns
    assert got == sorted(repr([r[at.index(c)] for c in columns]) for r in cursor.fetchall())

"""Every registered query against its SQL, on the smallest tables."""

import os
from collections import Counter

import duckdb
import pytest

from sieveline.plans import catalog

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")


def same(value):
    if isinstance(value, float):
        return round(value, 9)
    return tuple(map(same, value)) if isinstance(value, (list, tuple)) else value


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_sql(spark, sql, name):
    df = catalog.QUERIES[name](spark, DATA)
    cursor = sql.execute(catalog.ORACLE_SQL[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    want = Counter(repr(tuple(same(r[columns.index(c)]) for c in sorted(columns))) for r in cursor.fetchall())
    got = Counter(repr(tuple(same(r[c]) for c in sorted(columns))) for r in df.collect())
    assert got == want


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())

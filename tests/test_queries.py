"""Every registered query against its SQL on the smallest tables."""

import collections
import datetime
import os

import duckdb
import pytest

import __spark_entry__ as entry
from tritsift.plans import catalog

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="the driver's tables aren't here")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return c


def value(x):
    if isinstance(x, float):
        return round(x, 6) + 0.0
    return x.isoformat() if isinstance(x, datetime.datetime) else x


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_matches_sql(spark, con, name):
    df = entry.queries()[name](spark, SMALL)
    want = con.sql(catalog.ORACLE_SQL[name])
    assert sorted(want.columns) == sorted(df.columns)
    at = [want.columns.index(c) for c in df.columns]
    assert collections.Counter(tuple(map(value, r)) for r in df.collect()) == collections.Counter(tuple(value(r[i]) for i in at) for r in want.fetchall())


def test_every_query_has_sql():
    assert catalog.QUERIES.keys() - catalog.ORACLE_SQL.keys() == {"kmeans_clusters"}


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["subject", "relation", "object", "dot"] and df.count() > 0


def test_unique_keys_find_themselves(spark):
    """Asked as they were encoded, unique keys return their own row first."""
    from tritsift.plans import tables

    t = {(r.subject, r.relation): r.object for r in tables.triples(spark, SMALL).collect() if r.relation != "placed_order"}
    got = {(r.subject, r.relation): r.object for r in entry.queries()["triple_lookup"](spark, SMALL).collect()}
    assert got == t

"""Every registered fusion query against its SQL twin."""

import duckdb
import pytest

from fusemill.plans import catalog

SF = "/root/testdata/sf0.001"
#: Queries that find nothing at this size (all find rows at sf0.01).
NO_ROWS = {"p12_label_range_check", "j05_synchronize_streams", "u05_intersect_valid", "m13_fragment_filter"}
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(row):
    return tuple(round(x, 6) + 0.0 if isinstance(x, float) else x for x in row)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query(spark, con, name):
    df = catalog.QUERIES[name](spark, SF)
    got = con.execute(catalog.ORACLES[name])
    names = [c[0] for c in got.description]
    assert sorted(names) == sorted(df.columns)
    at = [names.index(c) for c in df.columns]
    want = sorted((plain(r[k] for k in at) for r in got.fetchall()), key=str)
    have = sorted((plain(r) for r in df.collect()), key=str)
    assert have == want and (want or name in NO_ROWS)


def test_entry_has_every_operator(spark):
    import __spark_entry__

    names = set(__spark_entry__.queries())
    assert set(catalog.QUERIES) <= names and set(__spark_entry__.oracle_sql()) <= names
    assert __spark_entry__.entry(spark).count() > 1

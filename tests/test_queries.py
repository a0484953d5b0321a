"""Every query of the library runs on the smallest tables and, where it has SQL, agrees with it."""

import os

import duckdb
import pytest

from palimpsest.plans import catalog

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(rows):
    return sorted(tuple(repr(round(x, 6)) if isinstance(x, float) else str(x) for x in r) for r in rows)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for t in TABLES:
        if os.path.exists(f"{DIR}/{t}.parquet"):
            c.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, DIR)
    columns = sorted(df.columns)
    got = df.select(*(f"`{c}`" for c in columns)).collect()
    if sql := catalog.ORACLE.get(name):
        names = ", ".join(f'"{c}"' for c in columns)
        want = duck.execute(f"select {names} from ({sql})").fetchall()
        assert plain(got) == plain(want)
    if name in ("mapping_violations",):
        assert not got
    if name == "subtree_sizes_by_range":
        assert all(r.same for r in got)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(catalog.ORACLE) <= set(catalog.QUERIES) <= set(__spark_entry__.queries())

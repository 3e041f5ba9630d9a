"""Every registered query with SQL gives the rows that DuckDB gives on the same tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from lexkv.plans.queries import ORACLES, QUERIES
from tests.conftest import SF

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted([tuple(r[i] for i in order) for r in rows], key=repr)


@pytest.mark.parametrize("name", list(ORACLES))
def test_matches_sql(spark, con, name):
    want = con.execute(ORACLES[name])
    names = [x[0] for x in want.description]
    want = plain(want.fetchall(), names)
    df = QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(names)
    assert plain([tuple(r) for r in df.collect()], df.columns) == want


def test_entry_and_registration(spark):
    assert entry.entry(spark).count() == 100
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_locks_are_exclusive(spark):
    out = QUERIES["lock_simulation"](spark, SF).toPandas()
    held = out[out.granted_ms.notna()].sort_values(["major_key", "granted_ms"])
    for _, g in held.groupby("major_key"):
        assert (g.granted_ms.to_numpy()[1:] >= g.released_ms.to_numpy()[:-1]).all()
    assert ((held.released_ms - held.granted_ms) <= 3000).all()

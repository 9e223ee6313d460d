"""Registered queries against their SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()
NAMES = [n for n in QUERIES if n in ORACLES and not n.startswith("op") and n != "pipeline"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return round(value, 6)
    return value


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    frame = QUERIES[name](spark, SF)
    columns = sorted(frame.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in frame.collect()), key=repr)
    result = duck.execute(ORACLES[name])
    found = [d[0] for d in result.description]
    assert sorted(found) == columns
    places = [found.index(c) for c in columns]
    assert got == sorted((tuple(plain(r[p]) for p in places) for r in result.fetchall()), key=repr)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_query_is_named_by_its_inventory_id():
    assert {n.split("_")[0] for n in QUERIES if not n.startswith("op") and n != "pipeline"} == {
        f"{family}{k}" for family, n in (("a", 14), ("b", 13), ("c", 4), ("d", 7), ("e", 13), ("f", 15), ("g", 7)) for k in range(1, n + 1)
    }

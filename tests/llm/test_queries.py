"""The registered queries of this folder against their SQL on the smallest tables."""

import duckdb
import pytest

from glyphshift.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, name):
    frame = QUERIES[name](spark, SF)
    columns = sorted(frame.columns)
    got = sorted((tuple(r[c] for c in columns) for r in frame.collect()), key=repr)
    con = duckdb.connect()
    for table in ("documents", "benchmark", "labels", "conversations"):
        con.execute(f"create view {table} as select * from '{SF}/{table}.parquet'")
    result = con.execute(ORACLES[name])
    found = [d[0] for d in result.description]
    assert sorted(found) == columns
    places = [found.index(c) for c in columns]
    assert got == sorted((tuple(r[p] for p in places) for r in result.fetchall()), key=repr)

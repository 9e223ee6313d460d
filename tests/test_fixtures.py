"""What the registered queries are given: all of it, against the SQL's parts."""

import duckdb
import pytest

from glyphshift import constants as K
from glyphshift.operators import decide, mixed
from glyphshift.plans import fixtures as X
from glyphshift.plans import oracles

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def test_pairs_are_of_any_length(spark, duck):
    """Every audited word on both layouts: the SQL's word buffers, which aren't cut by length."""
    want = {tuple(r) for r in duck.execute(oracles.sql("SELECT active, shadow, layout, length(active) % 2 = 0 FROM buffers", "buffers")).fetchall()}
    got = X.pairs(X.lines(spark, SF))
    assert {tuple(r) for r in got.select("active", "shadow", "layout", "on_delimiter").collect()} == want
    assert any(len(r[0]) > 12 for r in want)
    collisions = spark.createDataFrame([("zz",)], "word string")
    decided = decide.decide(got, X.models(spark, SF), collisions)
    assert decided.where("length(active) > 12").count() == sum(len(r[0]) > 12 for r in want)


#: The rule of mixed_texts: lines of both languages by rank, the fewer ones again and again.
MIXED = """SELECT i AS sample_id, a.line || ' ' || b.line AS text
FROM (SELECT (SELECT count(*) FROM lines WHERE lang = 'en') AS ne, (SELECT count(*) FROM he_lines) AS nh), unnest(range(0, greatest(ne, nh))) AS u(i)
JOIN (SELECT line, row_number() OVER (ORDER BY doc_id, line_no) - 1 AS r FROM lines WHERE lang = 'en') a ON a.r = i % ne
JOIN (SELECT line, row_number() OVER (ORDER BY doc_id, line_no) - 1 AS r FROM he_lines) b ON b.r = i % nh"""


def test_every_line_takes_part_in_the_mixed_audits(spark, duck, monkeypatch):
    monkeypatch.setitem(oracles.PARTS, "mtexts", (("lines", "he_lines"), MIXED))
    want = {tuple(r) for r in duck.execute(oracles.sql("SELECT * FROM mtexts", "mtexts")).fetchall()}
    assert {tuple(r) for r in X.mixed_texts(spark, SF).collect()} == want
    english, hebrew = duck.execute(oracles.sql("SELECT (SELECT count(*) FROM lines WHERE lang = 'en'), (SELECT count(*) FROM he_lines)", "lines", "he_lines")).fetchone()
    assert len(want) == max(english, hebrew) and min(english, hebrew) > 0
    metrics = duck.execute(oracles.sql("SELECT d0, a, p, fpr, recall, lat FROM metrics_one", "metrics_one")).fetchall()
    got = mixed.mixed_metrics(*X.mixed_parts(spark, SF, [K.DEFAULTS]), [K.DEFAULTS]).collect()
    assert [tuple(round(v, 6) for v in r) for r in got] == [tuple(round(v, 6) for v in r) for r in metrics]

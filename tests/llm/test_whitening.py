"""Whitening against plain numpy and Python's whole numbers."""

import math

import numpy as np
import pytest

from glyphshift.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, k1 string, copies int, x string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, "k", 1, "x") for i, v in rows], SCHEMA).repartition(3)


def brute(rows, components=32):
    kept = [(i, [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    n, dims = len(kept), range(len(kept[0][1]))
    sums = [sum(x[k] for _, x in kept) for k in dims]
    gaps = np.array([[n * x[k] - sums[k] for k in dims] for _, x in kept], dtype=object)
    centred = gaps.astype(float) / n
    cov = centred.T @ centred / n
    values, vectors = np.linalg.eigh(cov)
    order = [k for k in np.argsort(-values)[:components] if values[k] > 1e-12 * values.max()]
    white = centred @ vectors[:, order] / np.sqrt(values[order])
    return kept, n, [int(sum(g * g for g in row)) for row in gaps], white, values[order] / np.trace(cov)


def rows_of(spark_rows, n_components):
    out = {}
    for r in spark_rows:
        out.setdefault((r.vec_id, r.deviation), {})[r.component] = r
    return out


@pytest.mark.parametrize("dims", [3, 40])
def test_rows_against_brute_force(spark, dims):
    rng = np.random.default_rng(dims)
    base = [rng.normal(0, 1 + k % 5, dims).tolist() for k in range(120)]
    rows = [(i, v) for i, v in enumerate(base)] + [(1000 + k, base[0]) for k in range(60)] + [(3000, base[7]), (3000, base[7])]
    odd = [(2000, None), (2001, [None] + base[0][1:]), (2002, [float("nan")] + base[0][1:]), (2003, [float("inf")] + base[0][1:]), (2004, []), (2005, base[0][1:])]
    got = whitening.report(table(spark, rows + odd)).collect()
    kept, n, deviations, white, explained = brute(rows)
    k = min(32, dims)
    assert len(got) == len(rows) * k and {r.n for r in got} == {n} and {r.component for r in got} == set(range(1, k + 1))
    assert {r.identity_error for r in got} == {got[0].identity_error} and got[0].identity_error < 1e-9
    mine = {}
    for r in got:
        mine.setdefault(r.vec_id, {}).setdefault(r.component, (r.whitened, r.deviation, r.explained))
    # Either sign, but the same for all rows.
    signs = [np.sign(mine[0][c + 1][0] * white[0][c]) for c in range(k)]
    for place, (i, _) in enumerate(kept):
        for c in range(k):
            value, deviation, share = mine[i][c + 1]
            assert deviation == deviations[place]
            assert value * signs[c] == pytest.approx(white[place][c], abs=1e-7)
            assert share == pytest.approx(explained[c], rel=1e-7)


def test_weights_of_one_fit_the_distinct_vectors(spark):
    rng = np.random.default_rng(1)
    base = [rng.normal(0, 1, 4).tolist() for _ in range(30)]
    rows = [(i, v) for i, v in enumerate(base)] + [(100 + k, base[0]) for k in range(50)]
    once = {r.vec_id: r for r in whitening.whiten(table(spark, rows), weights="one").collect()}
    apart = {r.vec_id: r for r in whitening.whiten(table(spark, rows[:30])).collect()}
    assert {r.n for r in once.values()} == {30} and len(once) == 80
    for i in range(30):
        assert np.abs(np.abs(once[i].whitened) - np.abs(apart[i].whitened)).max() < 1e-9
    assert list(once[100].whitened) == list(once[0].whitened)


def test_rows_without_components(spark):
    assert whitening.report(table(spark, [])).collect() == []
    assert whitening.report(table(spark, [(1, None), (2, [])])).collect() == []
    assert whitening.report(table(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect() == []


def test_fewer_directions_than_dimensions(spark):
    rows = [(k, [float(k), 2.0 * k, 5.0]) for k in range(9)]
    got = whitening.report(table(spark, rows)).collect()
    assert {r.component for r in got} == {1} and got[0].identity_error < 1e-9 and got[0].explained == pytest.approx(1)


def test_large_entries_are_exact():
    x, n = np.array([[2**40, 3], [2**41, 4]]), 10**9
    sums = np.array([2**40 * n, 3 * n])
    gap = whitening.gaps(x, sums, n)
    assert gap.tolist() == [[0, 0], [2**40 * n, n]] and whitening.deviations(gap) == [0, None]


def test_query_columns(spark):
    from glyphshift.llm.queries import QUERIES

    got = QUERIES["op11_embedding_whitening"](spark, "/root/testdata/sf0.001")
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    first = got.first()
    assert first.identity_error < 1e-4

"""Word vectors, pooling and calibration of the quality classifier."""

import math

import numpy as np
import pyarrow as pa

from glyphshift.llm import quality
from tests.llm.conftest import ODD

SF = "/root/testdata/sf0.01"


def test_parts_are_the_runs_of_three_characters():
    words = ["a", "abc", "é😀", "x" * 300, "\x02", "x\x02\x02\x02y", "\x03\x00", "\U0010ffff"]
    code = lambda run: (run[0] << 42) | (run[1] << 21) | run[2]
    want = [code([quality.BEGIN, *map(ord, w), quality.END][k : k + 3]) for w in words for k in range(len(w))]
    parts, sizes = quality.parts_of(words)
    assert parts.tolist() == want and sizes.tolist() == [len(w) for w in words]


def test_sums_against_plain_loops(spark):
    texts = ["aa b aa", "b cc  B\ndd", "", None, "aa"]
    got = {r.part: r for r in quality.part_sums(spark.createDataFrame([(t,) for t in texts], "text string").repartition(2)).collect()}
    sums, docs = {}, {}
    for d, t in enumerate(texts):
        words = (t or "").lower().split()
        for k, w in enumerate(words):
            near = sum((quality.index_vectors([words[j]])[0] for j in range(max(0, k - 2), min(len(words), k + 3)) if j != k), np.zeros(quality.DIM))
            for part in quality.parts_of([w])[0].tolist():
                sums[part] = sums.get(part, 0) + near
                docs.setdefault(part, set()).add(d)
    assert set(got) == set(sums)
    for part, r in got.items():
        assert r.df == len(docs[part]) and np.allclose([r[f"v{k}"] for k in range(quality.DIM)], sums[part])


def test_pooling_of_unknown_words_and_neighbours():
    parts = np.unique(quality.parts_of(["ab"])[0])
    vectors = np.concatenate([np.ones((len(parts), quality.DIM)), np.zeros((1, quality.DIM))]).astype(np.float32)
    model = quality.Model(parts, vectors)
    out = model.pool(pa.array(["ab ab ab", "zz ab zz", "zz", None, ""]))
    one = 1 / math.sqrt(quality.DIM)
    assert np.allclose(out[0], [one] * quality.DIM + [one**2] * quality.DIM) and np.allclose(out[1], [one / 3] * quality.DIM + [0] * quality.DIM)
    assert not out[2:].any()


def test_held_out_ranking_log_loss_and_temperature(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = quality.fit(docs, labels)
    rows = quality.score(docs, model).where("held_out").join(labels, "doc_id").collect()
    good, bad = ([r.score for r in rows if r.quality == q] for q in (1, 0))
    assert sum((g > b) + 0.5 * (g == b) for g in good for b in bad) >= 0.95 * len(good) * len(bad)
    share = len(good) / len(rows)
    loss = -sum(math.log(max(r.score if r.quality else 1 - r.score, 1e-12)) for r in rows) / len(rows)
    assert loss < 0.5 * -(share * math.log(share) + (1 - share) * math.log(1 - share))
    assert 0.05 < model.temperature < 20


def test_temperature_is_the_least_of_a_fine_grid():
    rng = np.random.default_rng(5)
    for scale in (0.2, 1.0, 6.0):
        logits = rng.normal(0, 2, 3000)
        y = (rng.random(3000) < quality.sigmoid(logits)).astype(float)
        assert abs(quality.fit_temperature(logits * scale, y) / scale - 1) < 0.15
    perfect = np.asarray([5.0, -5.0] * 20)
    assert 0.1 < quality.fit_temperature(perfect, (perfect > 0).astype(float)) < 3


def test_one_text_of_each_labelled_id_is_learned_from(spark):
    docs = [(k, f"word{k} other" if k % 2 else f"### $$ {k}") for k in range(40)] + [(1, "### twice")] * 3
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)] + [(1, 0), (None, 1), (3, None)], "doc_id long, quality int")
    models = [quality.fit(spark.createDataFrame(docs, "doc_id long, text string").repartition(n), labels) for n in (1, 5)]
    assert np.array_equal(models[0].parts, models[1].parts) and np.allclose(models[0].layers[0], models[1].layers[0], atol=1e-5)


def test_a_text_pools_alone_as_in_a_crowd():
    """Control characters, marks of other tools and odd rows: no text changes what its neighbours pool to."""
    texts = [t for _, t in ODD] + ["good text stands here", "x\x02\x02\x02y", "world \x02", "\x03 \x03\x02 \x00", "\x02", "\x1c\x1d", "\U0010ffff \ufffe", "a" * 10_000 + " \x02\x03"]
    parts = np.unique(quality.parts_of("good text stands here world x y der quick brown fox".split())[0])
    vectors = np.random.default_rng(1).normal(size=(len(parts) + 1, quality.DIM)).astype(np.float32)
    vectors[-1] = 0
    fresh = lambda: quality.Model(parts, vectors)
    crowd = fresh().pool(pa.array(texts))
    kept = fresh()
    for k, text in enumerate(texts):
        assert np.array_equal(fresh().pool(pa.array([text], pa.string()))[0], crowd[k])
        assert np.array_equal(kept.pool(pa.array([text], pa.string()))[0], crowd[k])
    assert np.array_equal(kept.pool(pa.array(texts[::-1]))[::-1], crowd)


def test_no_more_words_are_kept_than_the_bound(monkeypatch):
    monkeypatch.setattr(quality, "KEPT_WORDS", 5)
    parts = np.unique(quality.parts_of(["abc", "bcd"])[0])
    model = quality.Model(parts, np.concatenate([np.eye(len(parts), quality.DIM), np.zeros((1, quality.DIM))]).astype(np.float32))
    words = [f"abc{k}" for k in range(9)]
    assert np.array_equal(model.word_vectors(words), model.put_together(words)) and len(model.known) == 5
    assert np.array_equal(model.word_vectors(words[::-1]), model.put_together(words[::-1])) and len(model.known) == 5


def test_gradients_against_differences():
    """A step against the gradient lowers the loss: one training step moves along the numeric gradient's signs."""
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(12, 4)), (rng.random(12) > 0.5).astype(float)
    before = quality.train_network(x, y, hidden=3, steps=0, decay=0.0)
    after = quality.train_network(x, y, hidden=3, steps=1, rate=1e-3, decay=0.0)
    loss = lambda layers: -np.mean(y * np.log(quality.sigmoid(quality.network(x, layers))) + (1 - y) * np.log(1 - quality.sigmoid(quality.network(x, layers))))
    for k in range(4):
        for at in np.ndindex(before[k].shape):
            moved = []
            for e in (1e-5, -1e-5):
                layers = [p.copy() for p in before]
                layers[k][at] += e
                moved.append(loss(layers))
            slope = (moved[0] - moved[1]) / 2e-5
            # Adam's first step is the rate, against the gradient's sign.
            if abs(slope) > 1e-6:
                assert np.isclose((after[k] - before[k])[at], -1e-3 * np.sign(slope), rtol=0.02)

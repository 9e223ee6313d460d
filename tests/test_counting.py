"""Words and grams counted in their task, against rows that are exploded and grouped."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from glyphshift.operators import audit, counting, ngrams
from glyphshift.plans import fixtures as X
from glyphshift.plans import queries as Q

POOL = ["a", "bc", "é", "שלום", "​", "\U0001f600", "â\x80", "€", " ", "\xa0", "\x85", "　", " ", " ", " ", "\n", "\t", "\x1c", "  "]


def shown(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_lines_are_cut_into_words_at_any_white_space():
    rng = random.Random(1)
    for _ in range(200):
        lines = ["".join(rng.choice(POOL) for _ in range(rng.randrange(9))) for _ in range(rng.randrange(7))]
        for given in (pa.array(lines, pa.string()), pa.array(["left out", *lines], pa.string()).slice(1)):
            n, words = counting.cut_lines(given)
            assert n.tolist() == [len(line.split()) for line in lines]
            assert words.to_pylist() == [word for line in lines for word in line.split()]


def test_words_are_counted_in_their_task(spark):
    rng = random.Random(2)
    rows = [(rng.choice(("en", "de", None)), "".join(rng.choice(POOL) for _ in range(12))) for _ in range(300)] + [("en", None), ("en", "")]
    lines = spark.createDataFrame(rows, "lang string, line string")
    counts = ngrams.raw_counts(lines, "lang")
    assert "Generate" not in shown(counts)
    want = {(r.lang, r.word): r.cnt for r in ngrams.words(lines, "lang").groupBy("lang", "word").agg(F.count(F.lit(1)).alias("cnt")).collect()}
    assert {(r.lang, r.word): r.cnt for r in counts.collect()} == want and len(want) > 100
    assert {r.word for r in ngrams.distinct_words(lines).collect()} == {word for _, word in want}


def test_grams_are_counted_in_their_task(spark):
    words = [("en", w, len(w) + 2**40) for w in ("", "a", "ab", "fox", "foxes", "fo\0", "aaaaaa", "x" * 60)] + [("he", "שלום", 3), ("he", "\U0001f600\U0001f601", 1)]
    grams = ngrams.count_ngrams(spark.createDataFrame(words, "model string, word string, cnt long"))
    assert "Generate" not in shown(grams)
    want = Counter()
    for model, word, cnt in words:
        for n in (2, 3, 4):
            for i in range(len(word) + 3 - n):
                want[model, n, f" {word} "[i : i + n]] += cnt
    assert {(r.model, r.n, r.gram): r.cnt for r in grams.collect()} == want


def test_small_batches_are_put_together():
    batches = [pa.RecordBatch.from_arrays([pa.array([i] * 3)], ["x"]) for i in range(7)]
    assert [len(batch) for batch in counting.put_together(iter(batches), len, 6)] == [6, 6, 6, 3]
    assert list(counting.put_together(iter([]))) == []


def test_pairs_of_modes_are_made_in_their_rows(spark):
    """A word's two layouts follow from the word: they aren't joined with its modes, and lines are read once for them."""
    rows = [(i, "en", f"src{i % 9}", 0, f"one Two {i} two") for i in range(20)]
    pairs = X.mode_pairs(spark, spark.createDataFrame(rows, "doc_id long, lang string, source string, line_no int, line string"))
    assert shown(pairs).count("MapInArrow") == 1 and not re.search(r"Join.* word", shown(pairs))
    assert {(r["mode"], r.active) for r in pairs.where("layout = 'en'").collect()} >= {("technical", "Two"), ("standard", "Two"), ("technical", "1")}


def test_words_and_models_come_of_one_reading(spark):
    words, counted = X.judged_words(spark, "/root/testdata/sf0.001")
    assert "documents.parquet" not in "".join(words.inputFiles() + counted.inputFiles())
    every = X.lines(spark, "/root/testdata/sf0.001")
    assert {r.word for r in words.collect()} == {r.word for r in ngrams.words(X.audit_lines(every)).distinct().collect()}
    assert [r.model for r in Q.words_and_models(spark, "/root/testdata/sf0.001", "en")[1].meta.collect()] == ["en"]


def test_lines_are_held_by_place():
    """A line's state is that of one that is held alone, whatever stands beside it."""
    rng = np.random.default_rng(4)
    n = rng.integers(1, 9, 40)
    ids = rng.integers(0, 12, n.sum())
    tops, fixes = rng.normal(4, 3, (2, 2, 12)), rng.random((2, 2, 12)) < 0.5
    way, wrong = rng.integers(0, 2, 40), rng.random(40) < 0.5
    together = audit.hold(n, ids, way, wrong, tops, fixes, audit.K.DEFAULTS)
    begin = np.cumsum(n) - n
    for i in range(40):
        alone = audit.hold(n[i : i + 1], ids[begin[i] : begin[i] + n[i]], way[i : i + 1], wrong[i : i + 1], tops, fixes, audit.K.DEFAULTS)
        assert all((a == b[begin[i] : begin[i] + n[i]]).all() for a, b in zip(alone, together))

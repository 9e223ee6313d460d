"""Words of any length: rows stay short, and their number grows with the length."""

import math
import random

import pytest
from pyspark.sql import functions as F

from glyphshift.functions import text as T
from glyphshift.operators import audit, ngrams, scoring


@pytest.fixture(scope="module")
def models(spark):
    rows = [("en", "the quick brown fox jumps over the lazy dog"), ("he", "שלום עולם טוב מאוד"), ("en", "hello world again")]
    return ngrams.train(spark.createDataFrame(rows, "model string, line string"))


def word(size):
    rng = random.Random(size)
    return "".join(rng.choice("thequickbrownfx") for _ in range(size))


def running(text, counts, v, total):
    """The score after each step of a padded text."""
    at, out = math.log((counts.get(text[:2], 0) + 1) / (total + v * v)), []
    for i in range(len(text) - 3):
        at += math.log((counts.get(text[i : i + 4], 0) + 1) / (counts.get(text[i : i + 3], 0) + v))
        out.append(at)
    return out


@pytest.mark.parametrize("sizes", [(2, 3, 61, 62, 63, 64, 65, 66, 67, 126, 127, 128, 129), (1_000, 16_000, 256_000), (1_000_000,)])
def test_evaluations_of_long_words(spark, models, sizes):
    words = spark.createDataFrame([(word(n),) for n in sizes], "word string")
    lexicon = spark.createDataFrame([(word(max(sizes))[:5],)], "word string")
    tables = {}
    for name in ("en", "he"):
        counts = {r.gram: r.cnt for r in models.ngrams.where(F.col("model") == name).collect()}
        meta = models.meta.where(F.col("model") == name).first()
        tables[name] = counts, meta.vocab_size, meta.total_bigrams
    got = {len(r.en): r for r in audit.evaluations(audit.forms(words), models, lexicon).collect()}
    assert set(got) == set(sizes)
    for n, r in got.items():
        en, he = (running(f" {side} ", *tables[name]) for name, side in (("en", r.en), ("he", r.he)))
        assert [e.j for e in r.evals] == list(range(1, n))
        assert all(abs(e.d - (b - a)) < 1e-5 for e, a, b in zip(r.evals, en, he))
        begins = r.en.startswith(word(max(sizes))[:5])
        assert [e.j for e in r.evals if e.coll] == ([3] if begins and n > 5 else [])


def test_rows_of_places_are_short_and_as_many_as_characters(spark):
    for n in (1_000, 64_000):
        texts = spark.createDataFrame([(7, word(n))], "id long, low string")
        r = scoring.grams(texts, "low").agg(F.count(F.lit(1)).alias("n"), F.max(F.length("low")).alias("longest"), F.min(F.length("low")).alias("least"), F.max("j").alias("j")).first()
        assert (r.n, r.longest, r.least, r.j) == (n - 3, 4, 4, n - 3)


def test_a_long_text_with_other_characters(spark):
    text = "😀é\nab" * 100 + "😀x"
    texts = spark.createDataFrame([(1, text, text[::-1])], "id long, own string, other string")
    got = sorted((r.j, r.own, r.other) for r in scoring.grams(texts, "own", "other").collect())
    assert got == [(j + 1, text[j : j + 4], text[::-1][j : j + 4]) for j in range(len(text) - 3)]


def test_shadow_of_a_long_word_has_its_length(spark):
    assert spark.createDataFrame([(word(5_000),)], "w string").select(F.length(T.shadow("w"))).first()[0] == 5_000

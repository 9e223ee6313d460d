"""Words are cut into grams a slice at a time."""

import random
import tracemalloc

import pyarrow as pa

from glyphshift.operators.counting import gram_counts, grams_of_words


def test_many_words_are_not_cut_at_once():
    rng = random.Random(1)
    words = ["".join(rng.choices("etaoinshrdlu", k=rng.randint(3, 14))) for _ in range(600_000)]
    batches = [pa.RecordBatch.from_arrays([pa.repeat("en", 10_000), pa.array(words[i : i + 10_000]), pa.array([2] * 10_000, pa.int64())], ["model", "word", "cnt"]) for i in range(0, len(words), 10_000)]
    tracemalloc.start()
    got = pa.Table.from_batches(grams_of_words(iter(batches))).group_by(["n", "gram"]).aggregate([("cnt", "sum")])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    want = {(n, gram): int(cnt) for n, grams, cnts in gram_counts(pa.array(words), pa.array([2] * len(words), pa.int64()).to_numpy()) for gram, cnt in zip(grams, cnts)}
    assert {(n, gram): cnt for n, gram, cnt in zip(*(got.column(c).to_pylist() for c in ("n", "gram", "cnt_sum")))} == want
    assert peak < 350_000_000

"""Ranked search against plain Python, on odd rows and on shared items."""

import math
import re
from collections import Counter

import pytest

from glyphshift.llm import search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
ITEMS = [
    (1, "The quick brown fox jumps over the lazy dog"),
    (2, "the quick brown fox and the old stone bridge, the BRIDGE"),
    (3, "over the lazy dog, the quick brown fox rests"),
    (4, None),
    (5, " ,;"),
    (6, "passage1 passage2 passage3 w1x1 w5x5"),
    (7, "nothing-of-this stands-anywhere"),
    (8, "one"),
    (9, "中文 naïve café"),
    (9, "der der der"),
    (9, "der der der"),
]


def terms(text):
    return TERM.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def brute(docs, items, top=20):
    own = [(i, Counter(terms(t))) for i, t in docs]
    n, size = sum(1 for _, c in own if c), sum(c.total() for _, c in own)
    df = Counter(t for _, c in own for t in c)
    out = []
    for item_id, text in set(items):
        wanted, found = Counter(terms(text)), []
        for doc_id, held in own:
            score = 0
            if held:
                m = 75 + (25 * held.total() * n) // size
                for term, times in wanted.items():
                    if tf := held[term]:
                        score += times * math.floor(1000 * math.log((2 * n + 2) / (2 * df[term] + 1))) * ((10**9 * tf) // (1000 * tf + 12 * m))
            if score > 0:
                found.append((-score, doc_id is None, doc_id or 0))
        out += [(item_id, r + 1, None if none else doc, -score) for r, (score, none, doc) in enumerate(sorted(found)[:top])]
    return sorted(out, key=repr)


def items_table(spark, rows=ITEMS):
    return spark.createDataFrame([(i, t, "s") for i, t in rows], "item_id long, text string, source string").repartition(2)


def found(frame):
    return sorted((tuple(r) for r in frame.collect()), key=repr)


@pytest.mark.parametrize("block_bytes", [1_000_000, 60])
def test_odd_rows_against_brute_force(spark, odd, block_bytes):
    docs = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    assert found(search.search(odd, items_table(spark), block_bytes=block_bytes)) == brute(docs, ITEMS)


def test_ties_and_the_cut(spark):
    docs = [(k, "alpha beta" if k % 3 else "beta gamma gamma") for k in range(200)] + [(500, "delta")]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    items = [(1, "alpha"), (2, "beta gamma"), (3, "delta alpha")]
    assert found(search.search(frame, items_table(spark, items), top=7)) == brute(docs, items, 7)


def test_empty_tables(spark, none):
    assert found(search.search(none, items_table(spark))) == []
    docs = spark.createDataFrame([(1, "the quick")], "doc_id long, text string")
    assert found(search.search(docs, items_table(spark, []))) == []


def test_shared_parts_are_made_once():
    plan = search.Plan([t.encode() for t in ("a b c d x", "a b c d y", "a b c d z", "a b c d", "a b")])
    # {a, b} and {c, d} are leaves, as their terms stand in the same items; their sum is one node for four items.
    assert plan.leaf_of[b"a"] == plan.leaf_of[b"b"] and plan.leaf_of[b"c"] == plan.leaf_of[b"d"]
    assert plan.n_leaves == 5 and plan.n_nodes == 6 and len(plan.levels) == 1
    assert sorted(k for k, _, _ in plan.tops.tolist()) == [0, 0, 1, 1, 2, 2, 3, 4]


def test_the_graph_gives_the_plain_sums():
    import numpy as np

    texts = [" ".join(f"t{k}" for k in range(40) if (k * 7 + i) % 3 or k < 12) + " t3" * (i % 3) for i in range(25)]
    plan = search.Plan([t.encode() for t in texts])
    assert plan.levels
    names = sorted(plan.leaf_of)
    value = {name: 3**k % 1009 for k, name in enumerate(names)}
    got = plan.scores(np.zeros(len(names), dtype=int), np.array([plan.leaf_of[t] for t in names]), np.array([value[t] for t in names]), 1)
    assert got[:, 0].tolist() == [sum(value[t.encode()] for t in text.split()) for text in texts]

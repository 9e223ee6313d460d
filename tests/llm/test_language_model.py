"""The language model: counts and the base by plain Python, seating by enumeration, scores by a sequential sampler."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from glyphshift.llm import language_model as lm

SPACE = str.maketrans({c: " " for c in "\t\n\x0b\x0c\r"})


def tokens(text):
    lower = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return [w for w in lower.translate(SPACE).split(" ") if w] + ["\n"]


def is_held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 10 == 0


def base(rows):
    c = Counter(t for i, text in rows if not is_held(i) for t in tokens(text))
    n, v = c.total(), len(c)
    return [(i, is_held(i), len(tokens(t)), sum(c[x] > 0 for x in tokens(t)), n, sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in tokens(t))) for i, t in rows]


@pytest.mark.parametrize("sizes", [(16_000_000, 16_000_000), (2_000, 3_000)])
def test_counts_and_base_on_odd_rows(spark, odd, sizes):
    rows = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    got = lm.report(odd, burn=1, samples=2, slice_bytes=sizes[0], bucket_bytes=sizes[1]).collect()
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:5])
    mine = sorted([(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got], key=key)
    wanted = sorted(base(rows), key=key)
    assert [m[:5] for m in mine] == [w[:5] for w in wanted]
    assert all(m[5] == pytest.approx(w[5], rel=1e-9) for m, w in zip(mine, wanted))
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)


def test_empty_tables_and_nothing_to_learn_from(spark, none):
    assert lm.report(none).collect() == []
    ids = [i for i in range(200) if is_held(i)][:2]
    rows = spark.createDataFrame([(i, "some words") for i in ids], "doc_id long, text string")
    got = lm.report(rows).collect()
    assert [(r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got] == [(3, 0, 0, 0.0, 0.0)] * 2


def exact_tables(c, rest, p, d):
    """The distribution of tables by going through all seatings' weights, customer by customer."""
    weight = {1: rest * p}
    for seated in range(1, c):
        after = defaultdict(float)
        for t, x in weight.items():
            after[t + 1] += x * (rest + d * t) * p
            after[t] += x * (seated - d * t)
        most = max(after.values())
        weight = {t: x / most for t, x in after.items()}
    total = sum(weight.values())
    return {t: x / total for t, x in weight.items()}


@pytest.mark.parametrize("c, rest, p, d", [(2, 3.0, 0.2, 0.7), (5, 40.0, 0.05, 0.6), (30, 500.0, 0.02, 0.8), (30, 1.0, 1e-6, 0.3)])
def test_tables_follow_their_distribution(c, rest, p, d):
    n, wanted = 20_000, exact_tables(c, rest, p, d)
    same = lambda x, kind=float: np.full(n, x, dtype=kind)
    share = Counter(lm.few_tables(same(c, int), same(rest), same(p), d, lm.stirling(d, 64), (np.arange(n) + 0.5) / n).tolist())
    assert all(abs(share[t] / n - wanted.get(t, 0)) < 1e-3 for t in set(share) | set(wanted))


@pytest.mark.parametrize("c, rest, p, d", [(300, 500.0, 0.02, 0.8), (300, 1.0, 1e-6, 0.3), (700, 40.0, 0.3, 0.6), (400, 1e6, 0.05, 0.7), (300, 3.0, 0.01, 0.95), (900, 1e4, 0.004, 0.05)])
def test_tables_of_large_dishes_follow_their_distribution(c, rest, p, d):
    n, wanted = 1_000, exact_tables(c, rest, p, d)
    same = lambda x, kind=float: np.full(n, x, dtype=kind)
    got = lm.many_tables(same(c, int), same(rest), same(p), d, (np.arange(n) + 0.5) / n)
    mean = sum(t * x for t, x in wanted.items())
    spread = sum((t - mean) ** 2 * x for t, x in wanted.items()) ** 0.5
    assert got.mean() == pytest.approx(mean, rel=5e-3, abs=0.03) and got.std() == pytest.approx(spread, rel=0.05, abs=0.1)


def test_very_large_dishes():
    c, n = 10**8, 1_000
    got = lm.many_tables(np.full(n, c), np.full(n, 1e5), np.full(n, 0.05), 0.8, (np.arange(n) + 0.5) / n)
    assert 1 <= got.min() and got.max() < c and got.std() < 0.05 * got.mean()


def test_log_gamma():
    x = np.array([1e-3, 0.4, 1.0, 7.7, 1e3, 1e9])
    assert np.allclose(lm.log_gamma(x), [math.lgamma(v) for v in x], rtol=1e-12, atol=1e-9)


def sequential(rows, discounts, theta, rounds=60, burn=20, seed=3):
    """Customers leave and are seated again one by one; every text's log10 probability by averaged predictions."""
    rng, texts = random.Random(seed), [(i, tokens(t)) for i, t in rows]
    train = [t for i, t in texts if not is_held(i)]
    v = len({x for t in train for x in t})
    inner, outer = defaultdict(lambda: defaultdict(list)), defaultdict(list)

    def p_word(w):
        n, t = sum(map(sum, outer.values())), sum(map(len, outer.values()))
        return (sum(outer[w]) - discounts[1] * len(outer[w]) + (theta + discounts[1] * t) / (v + 1)) / (theta + n)

    def seat(tables, whole, p, d):
        weights = [x - d for x in tables] + [(theta + d * whole) * p]
        k = rng.choices(range(len(weights)), weights)[0]
        if k == len(tables):
            tables.append(0)
        tables[k] += 1
        return k == len(tables) - 1 and tables[k] == 1

    def leave(tables):
        k = rng.choices(range(len(tables)), tables)[0]
        tables[k] -= 1
        if not tables[k]:
            tables.pop(k)
            return True
        return False

    def enter(u, w):
        if seat(inner[u][w], sum(map(len, inner[u].values())), p_word(w), discounts[0]):
            seat(outer[w], sum(map(len, outer.values())), 1 / (v + 1), discounts[1])

    pairs = [(u, w) for t in train for u, w in zip(["\t", *t], t)]
    for u, w in pairs:
        enter(u, w)
    wanted, kept = {(u, w) for _, t in texts for u, w in zip(["\t", *t], t)}, defaultdict(float)
    for k in range(rounds):
        for u, w in pairs:
            if leave(inner[u][w]):
                leave(outer[w])
            enter(u, w)
        if k >= burn:
            for u, w in wanted:
                n, t = sum(map(sum, inner[u].values())), sum(map(len, inner[u].values()))
                kept[u, w] += (sum(inner[u][w]) - discounts[0] * len(inner[u][w]) + (theta + discounts[0] * t) * p_word(w)) / (theta + n)
    return [sum(math.log10(kept[u, w] / (rounds - burn)) for u, w in zip(["\t", *t], t)) for _, t in texts]


def test_scores_against_a_sequential_sampler(spark):
    rng = random.Random(5)
    words = ["a", "b", "c", "d", "e", "f", "g"]
    rows = [(i, " ".join(rng.choices(words, [40, 20, 10, 5, 3, 2, 1])[0] + ("x" if k % 3 == 0 else "") for k in range(rng.randint(3, 9)))) for i in range(60)] + [(200, "never seen a b")]
    own = lm.id_and_text(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    asked = lm.requests(own, 4, 200).cache()
    seating = lm.fit(asked, 4, burn=4, samples=12)
    got = {r.doc_id: r.score for r in lm.score(seating, 4).collect()}
    # The discounts of the fit: of the contexts, and of the parent from its last state's customers.
    wanted = dict(zip([i for i, _ in rows], sequential(rows, (seating.discount, 0.5), 1.0)))
    assert all(got[i] == pytest.approx(wanted[i], rel=0.06, abs=0.15) for i in wanted)
    assert sum(got.values()) == pytest.approx(sum(wanted.values()), rel=0.02)


def test_predictions_are_a_distribution(spark):
    """Behind each word, the chances of all known tokens and of one unknown one sum up to one."""
    train = [i for i in range(100) if not is_held(i)][:6]
    texts = ["a b a c", "b a b", "c a", "a a a b", "b c", "a b c d"]
    known = ["a", "b", "c", "d"]
    probes = [(10_000 + k, f"{u} {w}") for k, (u, w) in enumerate((u, w) for u in known for w in (*known, "zzz"))]
    rows = spark.createDataFrame(list(zip(train, texts)) + [r for r in probes if is_held(r[0])], "doc_id long, text string")
    asked = lm.requests(lm.id_and_text(rows), 2, 10_000).cache()
    seating = lm.fit(asked, 2, burn=1, samples=2)
    h = lambda w: int(np.uint64(lm.xxhash.xxh64_intdigest(w)).view(np.int64))
    nodes, pairs, word = {}, {}, {}
    for r in seating.nodes.where(f"kind = {lm.NODE}").collect():
        names, c, _, _, _, *kept = lm.numbers(r.data)
        for k, name in enumerate(names.tolist()):
            word[2 * k + r.bucket] = name
            chances = [level.chance(kept[3 * s][k], kept[3 * s + 1][k]) for s, level in enumerate(seating.levels)]
            nodes[name] = (c[k], chances, [kept[3 * s + 2][k] for s in range(2)])
    for r in seating.pairs.where(f"kind = {lm.PAIR}").collect():
        names, first, second, _, t, t_sum = lm.pair_numbers(r.data)
        pairs |= {(word[names[a]], word[names[b]]): (x + y) / 2 for a, b, x, y in zip(first, second, t, t_sum)}
    c = Counter(x for t in texts for x in zip(["\t", *tokens(t)], tokens(t)))
    unknown = [chances for n, chances, _ in nodes.values() if n == 0 and chances[0] > 0]
    for s in range(2):
        assert sum(nodes[h(w)][1][s] for w in (*known, "\n")) + unknown[0][s] == pytest.approx(1, abs=1e-9)
    for u in known:
        guests = sum(n for (a, _), n in c.items() if a == u)
        worth = sum(n - seating.discount * (pairs[h(u), h(w)] if n > 1 else 1) for (a, w), n in c.items() if a == u)
        assert worth + seating.discount * np.mean(nodes[h(u)][2]) == pytest.approx(guests)


def test_held_out_perplexity_is_below_the_base(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    r = lm.report(docs).where("held_out").groupBy().sum("score", "base_score", "n_tokens").first()
    assert r["sum(score)"] > r["sum(base_score)"]


def test_packed_numbers_come_back():
    rng = np.random.default_rng(2)
    for most in (0, 1, 255, 256, 70_000, 1 << 40):
        x = rng.integers(0, most, 100, endpoint=True)
        assert (lm.unpack(lm.pack(x), np.int64) == x).all() and (lm.unpack_steps(lm.pack_steps(x)) == x).all()
    x = rng.integers(-(1 << 62), 1 << 62, 100)
    assert (lm.unpack(lm.pack(x), np.int64) == x).all() and len(lm.unpack(lm.pack(x[:0]), np.int64)) == 0
    f = rng.normal(size=(3, 50)).astype(np.float32)
    assert (lm.unpack(lm.pack(f), np.float32).reshape(3, -1) == f).all()
    key = rng.integers(0, 30, 500)
    keys, at, place, n = lm.summed(key, key + 1)
    assert (key[at] == keys).all() and (keys[place] == key).all() and (n == np.bincount(key, weights=key + 1)[keys]).all()
    for bound in (31, 100_000):
        assert all((a == b).all() for a, b in zip(lm.distinct(key, bound), np.unique(key, return_inverse=True)))

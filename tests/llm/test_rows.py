"""Ids that stand on several texts, and columns whose names clash with the operators' own."""

import random

import numpy as np

from glyphshift.llm import lines, simhash, substrings

from .test_operators import brute_runs, sha

PASSAGE = " ".join(f"p{i}" for i in range(60))
OTHER = " ".join(f"q{i}" for i in range(70))


def frame(spark, rows):
    """The rows, with columns of every name that the operators use themselves."""
    names = "key cut_starts cut_id cut_key starts row own_id own_key gone_id fp n use first h f pos w1 w2 kept n_chars".split()
    return spark.createDataFrame([(i, t, *(k for k, _ in enumerate(names))) for i, t in rows], "doc_id long, text string, " + ", ".join(f"{n} long" for n in names))


def brute_words(rows, length=50):
    """n_words, n_removed and digest of each row: windows that start in a text of a smaller id go."""
    first = {}
    for i, t in rows:
        words = (t or "").split()
        for k in range(len(words) - length + 1):
            if i is not None:
                w = tuple(words[k : k + length])
                first[w] = min(first.get(w, i), i)
    out = []
    for i, t in rows:
        words = (t or "").split()
        gone = {k + d for k in range(len(words) - length + 1) if i is not None and first[tuple(words[k : k + length])] < i for d in range(length)}
        out.append((i, len(words), len(gone), sha(" ".join(w for k, w in enumerate(words) if k not in gone))))
    return sorted(out, key=repr)


def test_substrings_tell_rows_apart_by_text(spark):
    rows = [(1, PASSAGE), (2, "x " + PASSAGE), (2, OTHER), (None, PASSAGE), (None, OTHER), (3, OTHER + " end"), (3, PASSAGE), (2, "x " + PASSAGE), (4, None), (4, PASSAGE[:-1])]
    docs = frame(spark, rows)
    assert sorted((tuple(r) for r in substrings.report(docs).collect()), key=repr) == brute_words(rows)
    cut = substrings.remove_repeats(docs)
    assert cut.schema == docs.schema
    want = [(1, PASSAGE), (2, "x"), (2, "x"), (2, OTHER), (None, PASSAGE), (None, OTHER), (3, "end"), (3, ""), (4, None), (4, "p5")]
    assert sorted(((r.doc_id, r.text) for r in cut.collect()), key=repr) == sorted(want, key=repr)


def test_lines_tell_rows_apart_by_text(spark):
    block = "\n".join(f"line {k} of the block" for k in range(5))
    own = "\n".join(f"own line {k}" for k in range(6))
    rows = [(1, block), (2, "new\n" + block), (2, own), (None, block), (3, own + "\nmore"), (2, own), (4, None)]
    docs = frame(spark, rows)
    got = sorted((r.doc_id, r.n_removed) for r in lines.report(docs, words=lines.WORDS).collect() if r.doc_id is not None)
    assert got == [(1, 0), (2, 0), (2, 0), (2, 5), (3, 6), (4, 0)]
    kept = lines.dedup_lines(docs, words=lines.WORDS)
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == sorted([(1, block), (2, "new"), (2, own), (2, own), (None, block), (3, "more"), (4, None)], key=repr)


def test_winnowing_selects_fewer_lines_than_windows(spark):
    docs = [(i, "\n".join(f"line {(i * 7919 + k * 104729) % 9973}" for k in range(40))) for i in range(50)]
    selected = lines.fingerprints(spark.createDataFrame(docs, "doc_id long, text string"))
    assert 0.4 < selected.count() / (50 * 38) < 0.65
    got = {r.doc_id: (r.n_lines, r.n_removed, r.kept_sha256) for r in lines.report(spark.createDataFrame(docs, "doc_id long, text string"), words=lines.WORDS).collect()}
    assert got == brute_runs(docs, lines.SIZE, lines.WORDS)


def test_pivots_enumerate_fewer_pairs_and_lose_no_link():
    rng = random.Random(13)
    for size in (2, 50, 700):
        values = sorted({c ^ sum(1 << rng.randrange(64) for _ in range(rng.randint(0, 5))) & (2**64 - 1) for c in [rng.getrandbits(64) for _ in range(5)] for _ in range(size // 5 + 1)} | {rng.getrandbits(64) for _ in range(size)})
        fps = np.asarray(values, dtype=np.uint64)
        group = np.sort(np.asarray([rng.randrange(3) for _ in values]))
        found, (pairs, enumerated, passed, verified) = simhash.group_links(group, fps)
        want = [(i, j) for i in range(len(fps)) for j in range(i + 1, len(fps)) if group[i] == group[j] and (values[i] ^ values[j]).bit_count() <= 3]
        assert connected(len(fps), found) == connected(len(fps), want)
        assert pairs == sum(n * (n - 1) // 2 for n in np.bincount(group)) and pairs >= enumerated >= passed >= verified >= len(found)
        assert enumerated < 0.7 * pairs or size < 50


def connected(n, pairs):
    root = list(range(n))
    for a, b in pairs:
        while root[a] != a:
            a = root[a]
        while root[b] != b:
            b = root[b]
        root[max(a, b)] = min(a, b)
    out = []
    for i in range(n):
        while root[i] != i:
            i = root[i]
        out.append(i)
    return out


def test_fingerprints_that_many_rows_share(spark):
    rows = [(k, "") for k in range(400)] + [(1000 + k, "one and the same text of a hot group") for k in range(400)] + [(2000, "another text altogether that is on its own here"), (None, None)]
    got = {(r.component_id, r.fingerprint == "0" * 16): 0 for r in simhash.report(frame(spark, rows)).collect()}
    assert set(got) == {(0, True), (1000, False), (2000, False)}
    kept = simhash.keep_one(frame(spark, rows))
    assert kept.columns == frame(spark, rows).columns and sorted(str(r.doc_id) for r in kept.collect()) == sorted(["0", "1000", "2000", "None"])
    counts = simhash.pair_counts(frame(spark, rows)).first()
    assert counts.pairs >= counts.enumerated >= counts.passed >= counts.verified

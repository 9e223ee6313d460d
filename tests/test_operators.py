"""Operators on hand-made rows and against plain Python."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from glyphshift import constants as K
from glyphshift.functions import text as T
from glyphshift.operators import audit, cleaning, context, decide, mixed, ngrams, scoring
from glyphshift.streaming import streams


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f("x")).first()[0]


def test_text_functions(spark):
    assert one(spark, "ab <pre>x<b>y</b></pre> <CODE a=1>q</code>c<i>d</i> ", T.strip_markup) == "ab  cd"
    assert one(spark, "&amp;lt;b&gt; &quot;&#39;", T.unescape_entities) == "&lt;b> \"'"
    assert one(spark, "[label](http://x.y) **bold** _it_ https://a.b/c @some-one  end", T.scrub) == "label bold it end"
    assert one(spark, "@me https://a.b", T.scrub) == ""
    assert one(spark, "Hello/'", T.shadow) == "יקךךם.,"
    assert one(spark, "/'ק", lambda c: T.shadow(c, "he_to_en")) == "QWE"
    assert one(spark, "שלום", T.strict_shadow) == "akuo" and one(spark, "תל", T.strict_shadow) == ""
    assert [one(spark, str(x), lambda c: T.gap_category(F.col(c).cast("double"))) for x in (3.0, 3.1, -2.5, 1.0)] == ["3 > |x| > 2", "|x| > 3", "3 > |x| > 2", "1 > |x|"]
    assert one(spark, "a b\u001cc d", T.split_words) == ["a", "b", "c", "d"]


def test_budget_cut_keeps_the_crossing_row(spark):
    rows = spark.createDataFrame([(i, "x" * 9) for i in range(200)], "id long, line string")
    for block in (7, 65536):
        assert [r.id for r in cleaning.budget_cut(rows, ["id"], "line", 25, 1000, block).orderBy("id").collect()] == [0, 1, 2]
        assert cleaning.budget_cut(rows, ["id"], "line", 10**6, 5, block).count() == 5


def test_samples(spark):
    said = spark.createDataFrame([(1, "[deleted]"), (2, None), (3, ""), (4, "short ש"), (5, "this is long enough ש"), (6, " this is long enough\nש"), (7, "[removed]")], "id long, body string")
    assert [(r.id, r.text) for r in cleaning.mixed_sample(said).collect()] == [(5, "this is long enough ש")]
    old = spark.createDataFrame([(9, "b"), (10, "c")], "id long, text string")
    new = spark.createDataFrame([(1, "a"), (2, "b")], "id long, text string")
    assert [(r.part, r.id, r.text) for r in cleaning.merge_samples(old, new, 10).collect()] == [(0, 9, "b"), (0, 10, "c"), (1, 1, "a")]


LINES = ["the quick brown fox", "hello hello world", "word with 12345 digits", "naïve accents here", "averyveryverylongword ok", "שלום עולם טוב", "עוד מילים כאן ושם"]


@pytest.fixture(scope="module")
def models(spark):
    rows = [("he" if "א" <= x[0] <= "ת" else "en", x) for x in LINES]
    return ngrams.train(spark.createDataFrame(rows, "model string, line string"))


def test_grams_of_hello(spark, models):
    lines = spark.createDataFrame([("en", "Hello"), ("en", "hello ‏")], "model string, line string")
    got = {(r.n, r.gram): r.cnt for r in ngrams.count_ngrams(ngrams.word_counts(lines)).collect()}
    padded = " hello "
    assert got == {(n, padded[i : i + n]): 2 * sum(padded[k : k + n] == padded[i : i + n] for k in range(8 - n)) for n in (2, 3, 4) for i in range(8 - n)}


def test_merge_of_halves_is_the_whole(spark, models):
    rows = [("he" if "א" <= x[0] <= "ת" else "en", x) for x in LINES]
    halves = [ngrams.train(spark.createDataFrame(rows[k::2], "model string, line string")) for k in (0, 1)]
    merged = {tuple(r) for r in ngrams.merge_counts(*(h.ngrams for h in halves)).collect()}
    assert merged == {tuple(r) for r in models.ngrams.collect()}
    assert {tuple(r) for r in ngrams.merge_chars(*(h.chars for h in halves)).collect()} == {tuple(r) for r in models.chars.collect()}


class Plain:
    """The model's formulas, written out."""

    def __init__(self, models, name):
        self.c = {(r.n, r.gram): r.cnt for r in models.ngrams.where(F.col("model") == name).collect()}
        self.v = {r.model: r.vocab_size for r in models.meta.collect()}[name]
        self.total = sum(c for (n, _), c in self.c.items() if n == 2)

    def score(self, text):
        text, c = text.lower(), lambda g: self.c.get((len(g), g), 0)
        if len(text) < 2:
            return 0.0
        if len(text) == 2:
            return math.log((c(text) + 1) / (sum(n for (k, g), n in self.c.items() if k == 2 and g[0] == text[0]) + self.v))
        if len(text) == 3:
            return math.log((c(text) + 1) / (c(text[:2]) + self.v))
        return math.log((c(text[:2]) + 1) / (self.total + self.v**2)) + sum(math.log((c(text[i : i + 4]) + 1) / (c(text[i : i + 3]) + self.v)) for i in range(len(text) - 3))


def test_scores_of_every_length(spark, models):
    own = Plain(models, "en")
    texts = ["", "h", "he", "Hel", "hell", "hello world", " the ", "zzzz", " שלום "]
    got = {r.text: r.score for r in scoring.score(spark.createDataFrame([(t,) for t in texts], "text string"), models, "en").collect()}
    assert all(abs(got[t] - own.score(t)) < 1e-9 for t in texts)


def test_prefix_scores_are_direct_scores(spark, models):
    own = Plain(models, "en")
    for r in scoring.prefix_scores(spark.createDataFrame([("Hello",), ("ab",), ("fox!",)], "word string"), models, "en").collect():
        text = f" {r.word} "[: r.j + 3]
        assert abs(r.score - own.score(text)) < 1e-9


def test_collisions_and_decisions(spark, models):
    en = spark.createDataFrame([("akuo",), ("hello",)], "word string")
    he = spark.createDataFrame([("שלום",), ("תל",), ("שלוםם",)], "word string")
    pairs = decide.collision_pairs(decide.lexicon_he(he), en)
    assert [tuple(r) for r in pairs.collect()] == [("שלום", "akuo")]
    lexicon = decide.collision_set(pairs)
    rows = [("hello", "יקךךם", "en", True), ("יקךךם", "hello", "he", True), ("Akuo", "שלום", "en", True), ("a", "ש", "en", False), ("ab", "שנ", "en", False)]
    e, h = Plain(models, "en"), Plain(models, "he")
    got = {(r.active, r.layout): r for r in decide.decide(spark.createDataFrame(rows, "active string, shadow string, layout string, on_delimiter boolean"), models, lexicon, 1.0).collect()}
    for active, shadow, layout, end in rows:
        r, pad = got[(active, layout)], lambda x: f" {x} " if end else f" {x}"
        if len(active) < 2:
            assert (r.should_switch, r.score_diff, r.is_colliding, r.is_ambiguous) == (False, 0.0, False, True)
            continue
        own, other = (e, h) if layout == "en" else (h, e)
        diff = other.score(pad(shadow)) - own.score(pad(active))
        coll = active.lower() in ("akuo", "שלום") or shadow.lower() in ("akuo", "שלום")
        assert abs(r.score_diff - diff) < 1e-9 and r.is_colliding == coll
        assert r.should_switch == (not coll and diff > 1.0) and r.is_ambiguous == (not coll and 0 < diff <= 1.0)


def replay_plainly(words, e, h, lexicon, wrong, params):
    """A line's replay, word by word and prefix by prefix: (word place, correct, k, tail, switched, idx)."""
    correct, k, history, out = not wrong, 0, [], []

    def judged(word, upto, end, delta):
        shadow = word.translate(str.maketrans(K.EN_FROM, K.EN_TO))
        a, s = (word, shadow) if correct else (shadow, word)
        a, s, own, other = a[:upto], s[:upto], *((e, h) if correct else (h, e))
        if len(a) < 2:
            return False, 0.0, True
        pad = lambda x: f" {x} " if end else f" {x}"
        diff, coll = round(other.score(pad(s)) - own.score(pad(a)), 9), a.lower() in lexicon or s.lower() in lexicon
        return not coll and diff > delta, diff, coll or 0 < diff

    for w, word in enumerate(words):
        delta, tail = params.baseline + params.alpha * k**params.p, 0
        for x in reversed(history):
            if not x:
                break
            tail += 1
        idx = None
        for i in range(2, len(word)):
            if judged(word, i + 1, False, delta)[0]:
                idx = i
                break
        switch, _, fixable = judged(word, len(word), True, delta)
        if idx is None and switch:
            idx = -1
        out.append((w, correct, k, tail, idx is not None, idx))
        if idx is not None:
            correct, k, history = not correct, 0, []
        else:
            k, history = k + 1, (history + [fixable])[-50:]
    return out


def test_replay_against_a_plain_loop(spark, models):
    rng = random.Random(4)
    pool = "the quick brown fox hello world ok a I word with akuo here, zz xq ab".split() + ["ugs", "gus", "nrh"]
    lines = [" ".join(rng.choice(pool) for _ in range(rng.randint(1, 12))) for _ in range(40)]
    frame = spark.createDataFrame([(i, "en", i % 3, x) for i, x in enumerate(lines)], "doc_id long, lang string, line_no int, line string")
    lexicon = spark.createDataFrame([("akuo",), ("שלום",)], "word string")
    scored = audit.evaluations(audit.forms(ngrams.words(frame).distinct()), models, lexicon).cache()
    e, h = Plain(models, "en"), Plain(models, "he")
    params = K.Params(0.5, 0.1, 1.0)
    for wrong in (False, True):
        done = audit.replay(frame, scored, "en", wrong, params)
        for r in done.collect():
            want = replay_plainly(lines[r.doc_id].split(), e, h, ("akuo", "שלום"), wrong, params)
            assert [(x.w, x.correct, x.k, x.tail, x.switched, x.idx) for x in r.events] == want
        n = {r.doc_id: r for r in audit.audit_fn(done).collect()}
        for i, line in enumerate(lines):
            words = line.split()
            events = replay_plainly(words, e, h, ("akuo", "שלום"), wrong, params)
            if any(s and not c for _, c, _, _, s, _ in events):
                late = sum(0 if c else (len(words[w]) + 1 if not s or idx == -1 else idx + 1) for w, c, _, _, s, idx in events)
                assert (n[i].line_switched, n[i].latency, n[i].words_not_switched) == (True, late, sum(max(0, w - t) for w, c, _, t, s, _ in events if s and not c))
            else:
                assert (n[i].line_switched, n[i].latency, n[i].words_not_switched) == (False, sum(map(len, words)) + len(words), len(words))
        fixed = {r.doc_id: r.repaired for r in audit.repair(done).collect()}
        for i, line in enumerate(lines):
            words, swap = line.split(), []
            for w, c, _, t, s, _ in replay_plainly(words, e, h, ("akuo", "שלום"), wrong, params):
                if s:
                    swap[len(swap) - t :] = [not x for x in swap[len(swap) - t :]]
                    swap.append(c)
                else:
                    swap.append(not c)
            assert fixed[i] == " ".join(x.translate(str.maketrans(K.EN_FROM, K.EN_TO)) if f else x for x, f in zip(words, swap))


def test_latency_percentiles(spark):
    values = [5, 1, 9, 9, 3, 7, 2, 2]
    r = audit.latency_summary(spark.createDataFrame([("en", v) for v in values], "lang string, latency long")).first()
    assert (r.n, r["mean"], r.median, r.p95) == (8, sum(values) / 8, 4.0, sorted(values)[min(int(8 * 0.95), 7)])


def test_script_runs(spark):
    texts = spark.createDataFrame([(1, "שלום hello, עולם"), (2, "ab 12"), (3, "")], "sample_id long, text string")
    assert [tuple(r) for r in mixed.script_runs(texts).orderBy("sample_id", "run").collect()] == [(1, 0, "en", 0, "ש"), (1, 1, "he", 1, "לום "), (1, 2, "en", 5, "hello, "), (1, 3, "he", 12, "עולם"), (2, 0, "en", 0, "ab 12")]
    assert mixed.script_runs(texts, lead_fix=True).where("sample_id = 1").count() == 3


def test_pruned_candidates_give_the_same_triggers(spark, models):
    rng = random.Random(9)
    pool = ["hello", "the", "fox", "שלום", "עולם", "מילים", "zzz", "qq", "a"]
    texts = spark.createDataFrame([(i, " ".join(rng.choice(pool) for _ in range(8))) for i in range(30)], "sample_id long, text string")
    runs = mixed.text_runs(texts).cache()
    grid = [K.Params(0.2, 0.0, 1.0), K.Params(0.5, 0.1, 1.0), K.Params(0.5, 0.1, 2.0), K.Params(1.0, 0.3, 2.0)]
    lexicon, found = spark.createDataFrame([("fox",)], "word string"), []
    for trap in (False, True):
        words = mixed.segment_words(mixed.segments(runs, trap)).cache()
        scored = audit.evaluations(words.select("en", "he"), models, lexicon).cache()
        kept, every = (mixed.candidates(words, scored, 0.0, prune).cache() for prune in (True, False))
        got = [[{tuple(r) for r in mixed.outcomes(x, setting).collect()} for setting in grid] for x in (kept, every)]
        assert got[0] == got[1] and any(got[0])
        found.append((kept, got[0]))
    # All settings at once, in one pass over the gathered candidates.
    places = {r.sample_id: r.trap_start for r in mixed.trap_places(runs).collect()}
    counts = {r.setting: (r.fps, r.tps, r.chars) for r in mixed.grid_counts(mixed.trap_places(runs), found[0][0], found[1][0], grid).collect()}
    for k in range(len(grid)):
        caught = [pos - places[i] for i, pos in found[1][1][k] if pos > places[i]]
        assert counts.get(k, (0, 0, 0)) == (len(found[0][1][k]), len(caught), sum(caught))


def test_first_passages_are_the_first_over_each_baseline():
    rng = np.random.default_rng(4)
    sample = np.sort(rng.integers(0, 20, 300))
    pos = np.arange(300)
    k, d, baselines = rng.integers(0, 6, 300), np.round(rng.normal(3, 3, 300), 2), [-1.0, 0.0, 2.0, 4.5]
    for alpha, p in ((0.0, 1.0), (0.3, 2.0), (-0.5, 1.5)):
        got = mixed.first_passages(pos, k, d, sample, 20, alpha, p, baselines)
        for row, baseline in enumerate(baselines):
            for s in range(20):
                want = [int(x) for x in pos[sample == s] if d[x] > baseline + alpha * float(k[x]) ** p]
                assert got[row, s] == (want[0] if want else mixed.NEVER)
    assert (mixed.first_passages(*(np.zeros(0),) * 3, np.zeros(0, dtype=int), 2, 0.1, 1.0, [1.0]) == mixed.NEVER).all()


def runs_plainly(text, lead_fix):
    """Character by character: a class is carried on until another one comes."""
    out, lang = [], "en"
    for i, c in enumerate(text):
        own = "he" if "\u0590" <= c <= "\u05ff" else "en" if c.isascii() and c.isalpha() else None
        lang = "en" if i == 0 and not lead_fix else own or lang
        if out and out[-1][0] == lang:
            out[-1][2] += c
        else:
            out.append([lang, i, c])
    return [tuple(x) for x in out]


@pytest.mark.parametrize("lead_fix", [False, True])
def test_runs_of_random_texts(spark, lead_fix):
    rng = random.Random(2)
    texts = ["".join(rng.choice("ab שלם,\n1é😀") for _ in range(rng.randint(1, 40))) for _ in range(80)] + ["aב" * 5_000, "", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "sample_id long, text string")
    got = {r.sample_id: [tuple(x) for x in r.runs] for r in mixed.text_runs(rows, lead_fix).collect()}
    assert got == {i: runs_plainly(t, lead_fix) for i, t in enumerate(texts) if t}


def test_segments(spark):
    rows = [(1, 1, 0, "view"), (2, 1, 15, "view"), (3, 1, 31, "view"), (4, 1, 32, "click"), (5, 2, 0, "view")]
    events = spark.createDataFrame([(i, u, e, s) for i, u, s, e in rows], "event_id long, user_id long, event_type string, s int").withColumn("ts", F.timestamp_seconds("s"))
    assert [r.segment for r in context.segment(events).orderBy("event_id").collect()] == [1, 1, 2, 3, 1]
    assert context.segment_stats(context.segment(events)).count() == 4


def test_a_repeated_batch_changes_nothing(spark, tmp_path):
    lines = spark.createDataFrame([("en", "hello world"), ("en", "hello")], "model string, line string")
    lines.write.parquet(str(tmp_path / "in"))
    for k in range(2):
        stream = spark.readStream.schema(lines.schema).parquet(str(tmp_path / "in"))
        streams.ngram_stream(stream, str(tmp_path / "store"), str(tmp_path / f"checkpoint{k}"))
    got = {tuple(r) for r in streams.stored_model(spark, str(tmp_path / "store")).ngrams.collect()}
    assert got == {tuple(r) for r in ngrams.count_ngrams(ngrams.word_counts(lines)).collect()}


def test_detector_keeps_its_state(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    hit = [{"j": 1, "d": 9.0, "coll": False}]
    lean = [{"j": 1, "d": 0.5, "coll": False}]
    rows = [(1, 1, 0, "word", "ab", lean), (1, 2, 1, "word", "cd", hit), (1, 3, 2, "word", "ef", hit), (1, 4, 3, "click", "", None), (1, 5, 40, "word", "gh", lean), (2, 1, 0, "word", "x", None)]
    schema = "session long, event_id long, s int, event_type string, word string, evals array<struct<j:int,d:double,coll:boolean>>"
    frame = spark.createDataFrame(rows, schema).withColumn("ts", F.timestamp_seconds(F.col("s") + 1_700_000_000)).drop("s")
    frame.write.parquet(str(tmp_path / "in"))
    stream = streams.detect_stream(spark.readStream.schema(frame.schema).parquet(str(tmp_path / "in")))
    streams.start_once(stream, str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    got = {(r.session, r.event_id): (r.switched, r.k, r.lookback, r.layout) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {(1, 1): (False, 0, 0, "en"), (1, 2): (True, 1, 1, "en"), (1, 3): (False, 0, 0, "he"), (1, 5): (False, 0, 0, "he"), (2, 1): (False, 0, 0, "en")}


def test_detector_over_batches_carries_and_frees_state(spark, tmp_path):
    """A session goes on in the next batch; one that stays silent is freed by its timer, and starts again."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    hit = [{"j": 1, "d": 9.0, "coll": False}]
    batches = [
        [(1, 1, 0, "word", "cd", hit), (3, 1, 0, "word", "cd", hit)],
        [(3, 2, 5, "word", "ef", None), (2, 1, 90_000, "word", "x", None)],
        [(2, 2, 90_010, "word", "x", None)],
        [(1, 2, 90_020, "word", "gh", None)],
    ]
    schema = "session long, event_id long, s int, event_type string, word string, evals array<struct<j:int,d:double,coll:boolean>>"
    for rows in batches:
        frame = spark.createDataFrame(rows, schema).withColumn("ts", F.timestamp_seconds(F.col("s") + 1_700_000_000)).drop("s")
        frame.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    streams.start_once(streams.detect_stream(source), str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    got = {(r.session, r.event_id): (r.switched, r.k, r.layout) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {(1, 1): (True, 0, "en"), (3, 1): (True, 0, "en"), (3, 2): (False, 0, "he"), (2, 1): (False, 0, "en"), (2, 2): (False, 1, "en"), (1, 2): (False, 0, "en")}

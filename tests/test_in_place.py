"""Lines and samples that are scored where they lie, against rows that are joined with their evaluations."""

import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from glyphshift import constants as K
from glyphshift.operators import audit, mixed, ngrams
from glyphshift.plans import fixtures as X
from glyphshift.sources.corpus import spread

PARAMS = K.Params(0.5, 0.1, 1.0)


@pytest.fixture(scope="module")
def basis(spark):
    rows = [("en", "the quick brown fox jumps over the lazy dog"), ("he", "שלום עולם טוב מאוד"), ("en", "hello world again")]
    return ngrams.train(spark.createDataFrame(rows, "model string, line string")), spark.createDataFrame([("akuo",), ("fox",), ("ab",)], "word string")


def test_lines_keep_their_rows(spark, basis):
    """No word is shuffled, and all counts and events are those of joined evaluations."""
    rng = random.Random(3)
    pool = "the quick brown fox hello World ok a I Akuo here, zz xq ab foxes ugs GUS".split()
    rows = [(i, "en", 0, rng.choice((" ", " ", " \t ")).join(rng.choice(pool) for _ in range(rng.choice((1, 2, 9, 70))))) for i in range(60)]
    lines = spark.createDataFrame(rows, "doc_id long, lang string, line_no int, line string")
    scored = audit.evaluations(audit.forms(ngrams.words(lines).distinct()), *basis).cache()
    for wrong in (False, True):
        done = audit.replay_states(lines, *basis, {"own": ("en",)}, {"state": (wrong, "own")}, params=PARAMS, fields=tuple(audit.EVENT), switches=False)
        assert "Exchange" not in done._jdf.queryExecution().executedPlan().toString()
        want = {r.doc_id: r.state for r in audit.replay(lines, scored, "en", wrong, PARAMS).collect()}
        got = {r.doc_id: r.state for r in done.collect()}
        assert got == want and len(got) == 60


def test_samples_keep_their_rows(spark, basis):
    rng = random.Random(5)
    pool = ["hello", "the", "fox", "שלום", "עולם", "מילים", "zzz", "qq", "a", "", "ab"]
    texts = spark.createDataFrame([(i, " ".join(rng.choice(pool) for _ in range(12))) for i in range(40)], "sample_id long, text string")
    runs, settings = mixed.text_runs(texts).cache(), [K.Params(0.2, 0.0, 1.0), PARAMS, K.Params(0.5, 0.1, 2.0)]
    typed = mixed.typed_samples(runs, *basis, settings).cache()
    for trap, name in ((False, "valid"), (True, "trap")):
        words = mixed.segment_words(mixed.segments(runs, trap)).cache()
        found = mixed.candidates(words, audit.evaluations(words.select("en", "he"), *basis), 0.2).cache()
        for setting in settings:
            got = {(r.sample_id, r.pos) for r in typed.select("sample_id", mixed.first_pos(name, setting).alias("pos")).where("pos is not null").collect()}
            assert got == {tuple(r) for r in mixed.outcomes(found, setting).collect()} and got


def test_samples_are_typed_in_their_task(spark, basis):
    """Both layouts' texts of a sample are made of its distinct words, not of each of its characters in the plan."""
    runs = mixed.text_runs(spark.createDataFrame([(1, "hello שלום"), (2, "one run")], "sample_id long, text string"))
    typed = mixed.typed_samples(runs, *basis, [PARAMS])
    assert "translate(" not in typed._jdf.queryExecution().optimizedPlan().toString()
    assert [(r.sample_id, r.trap_start, r.total) for r in typed.collect()] == [(1, 6, 10)]


def test_words_are_cut_at_blanks_newlines_and_tabs():
    chunks = ["", "a b", " x", "  ", "שלום\tעולם\n", "é\u00a0\u2003z \U0001f600"]
    for begin in (0, 2):
        n, words = mixed.cut_words(pa.array(["left out", *chunks]).slice(1 + begin))
        want = [re.split("[ \n\t]", c) for c in chunks[begin:]]
        assert n.tolist() == [len(w) for w in want] and words.to_pylist() == [w for each in want for w in each]


def test_lines_meet_the_modes_of_few_sources_where_they_lie(spark):
    rows = [(i, "en", f"src{i % 9}", 0, "a line") for i in range(50)]
    moded = X.with_mode(spark, spark.createDataFrame(rows, "doc_id long, lang string, source string, line_no int, line string"))
    assert "SortMergeJoin" not in moded._jdf.queryExecution().executedPlan().toString()
    assert {r.doc_id: r.mode for r in moded.collect()} == {i: "technical" if i % 4 == 1 or i % 4 in (0, 2) and i % 9 in (0, 3) else "standard" for i in range(50)}


def test_what_takes_long_stays_in_several_partitions_a_core(spark):
    """A shuffle that is merged by size leaves a task a core or two of different length."""
    few = spread(spark.range(100), "id")
    assert few.join(few.withColumn("x", F.col("id") * 2), "id").where("x >= 0").count() == 100
    few.collect()
    assert few.rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism


def test_words_find_their_triggers_where_they_lie(spark, basis):
    words = spark.createDataFrame([(w,) for w in "the quick Akuo akuo fox zz xq a ab foxes ugs zzzzqx hello hello".split()], "word string")
    scored = audit.evaluations(audit.forms(words), *basis)
    found = audit.word_triggers(words, *basis, 0.2)
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
    want = {tuple(r) for r in audit.first_trigger(words, scored, 0.2).collect()}
    assert {tuple(r) for r in found.collect()} == want and any(x[1] is not None for x in want) and found.count() == len(want)
    assert [tuple(r) for r in audit.word_triggers(words.where("word = 'a'"), *basis).collect()] == [("a", None, None)]


def test_a_detector_gets_three_evaluations_of_a_word_at_most(spark, basis):
    """The highest and the lowest that don't collide, and the last: the same decisions at any threshold."""
    lines = spark.createDataFrame([(1, "thequickbrownfoxjumps hello foxes akuo a ab zzzzzzzz")], "doc_id long, line string")
    got = audit.evaluated_lines(lines, *basis, ("doc_id",)).select(F.explode("words").alias("x")).select("x.*").collect()
    full = {r.en: r.evals for r in audit.evaluations(audit.forms(ngrams.words(lines.select("line"))), *basis).collect()}
    for r in got:
        every = full.get(r.word, [])
        free = [e.d for e in every if not e.coll]
        assert len(r.evals) <= 3 and set(r.evals) <= set(every) and list(r.evals[-1:]) == list(every[-1:])
        assert [f(e.d for e in r.evals if not e.coll) for f in (max, min) if free] == [f(free) for f in (max, min) if free]

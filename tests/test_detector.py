"""The detector takes packets of events, and sessions by groups."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

import __spark_entry__ as entry
from glyphshift import constants as K
from glyphshift.operators import audit, ngrams
from glyphshift.plans import fixtures as X
from glyphshift.plans import queries
from glyphshift.streaming import streams

SF = "/root/testdata/sf0.001"
EVENTS = "session long, event_id long, s double, event_type string, word string, evals array<struct<j:int,d:double,coll:boolean>>"
PARAMS = K.Params(0.5, 0.1, 1.0)


class Progress(StreamingQueryListener):
    def __init__(self):
        self.seen = []

    def onQueryStarted(self, event):
        pass

    def onQueryProgress(self, event):
        self.seen.append(event.progress)

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        pass


def use_rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def decided(spark, path, batches, start):
    """What `start` decides on batches of rows, one micro-batch each."""
    use_rocks(spark)
    for frame in batches:
        frame.coalesce(1).write.mode("append").parquet(f"{path}/in")
    source = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    streams.start_once(start(source), f"{path}/out", f"{path}/checkpoint")
    return sorted(map(tuple, spark.read.parquet(f"{path}/out").collect()), key=repr)


def timed(spark, rows):
    return spark.createDataFrame(rows, EVENTS).withColumn("ts", F.timestamp_seconds(F.col("s") + 1_700_000_000)).drop("s")


def plainly(batches, detector):
    """Every session event by event."""
    out, states = [], {}
    for rows in batches:
        for session, event_id, s, kind, word, evals in sorted(rows, key=lambda r: (repr(r[0]), r[2], r[1])):
            layout, k, tail, at = states.get(session, ("en", 0, 0, None))
            if kind in detector.breaks or (at is not None and s - at > detector.idle):
                k = tail = 0
            if kind == "word":
                sign, limit, evals = 1 if layout == "en" else -1, detector.params.baseline + detector.params.alpha * k**detector.params.p, evals or []
                switched = any(not coll and sign * d > limit for _, d, coll in evals)
                out.append((session, event_id, word, switched, k, tail if switched else 0, layout))
                fixable = len(word) < 2 or bool(evals) and (evals[-1][2] or sign * evals[-1][1] > 0)
                if switched:
                    layout, k, tail = ("he" if layout == "en" else "en"), 0, 0
                else:
                    k, tail = k + 1, min(tail + 1, K.HISTORY) if fixable else 0
            states[session] = layout, k, tail, s
    return sorted(out, key=repr)


@pytest.mark.parametrize("groups", [1, 3])
def test_sessions_of_a_group_are_told_apart(spark, tmp_path, groups):
    rng, batches, next_id, clock = random.Random(7), [], {}, {}
    for _ in range(3):
        rows = []
        for session in (1, 2, 3, 2**60 + 1, None):
            for _ in range(rng.choice((0, 3, 90))):
                clock[session] = clock.get(session, 0) + rng.choice((0, 1, 1.5, 1, 15, 16))
                next_id[session] = next_id.get(session, 0) + 1
                kind = rng.choice(["word"] * 8 + ["click", "view", "tab"])
                evals = rng.choice([None, [], [(1, round(rng.gauss(0, 2), 3), rng.random() < 0.3) for _ in range(rng.randint(1, 3))]])
                rows.append((session, next_id[session], float(clock[session]), kind, rng.choice(("a", "word", "😀")) if kind == "word" else None, evals if kind == "word" else None))
        clock = dict.fromkeys(clock, max(clock.values()))  # no session is behind the watermark
        rng.shuffle(rows)
        batches.append(rows)
    detector = streams.Detector(PARAMS, keep=1e6)
    one = streams.detect_packets
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(streams, "detect_packets", lambda packets, d, late: one(packets, d, late, groups))
        got = decided(spark, tmp_path, [timed(spark, rows) for rows in batches], lambda source: streams.detect_stream(source, detector))
    want = plainly(batches, detector)
    assert got == want and len({r[3:] for r in want}) > 20


def test_packets_of_lines_are_decided_as_single_words(spark, tmp_path):
    rows = [("en", "the quick brown fox jumps over the lazy dog"), ("he", "שלום עולם טוב מאוד"), ("en", "hello world again")]
    basis = ngrams.train(spark.createDataFrame(rows, "model string, line string")), spark.createDataFrame([("akuo",), ("fox",), ("ab",)], "word string")
    rng, pool, said, before = random.Random(3), "the quick brown fox hello World ok a I Akuo here, zz xq ab foxes ugs GUS".split(), [], {}
    for i in range(40):
        words, session = [rng.choice(pool) for _ in range(rng.choice((1, 2, 9, 70)))], i % 5
        said.append((session, before.get(session, 0), " ".join(words)))
        before[session] = before.get(session, 0) + len(words) + 1
    lines = spark.createDataFrame(said, "session long, before long, line string")
    click = F.array(F.struct(F.lit("click").alias("event_type"), F.lit(None).cast("string").alias("word"), F.lit(None).cast("array<struct<j:int,d:double,coll:boolean>>").alias("evals")))
    spoken = audit.evaluated_lines(lines, *basis, ("session", "before"))
    events = spoken.select("session", "before", F.posexplode(F.concat(click, F.transform("words", lambda x: F.struct(F.lit("word").alias("event_type"), x["word"].alias("word"), x["evals"].alias("evals"))))).alias("i", "e"))
    single = events.select("session", (F.col("before") + F.col("i") + 1).alias("event_id"), "e.*").withColumn("ts", F.timestamp_seconds(F.col("event_id") + 1_700_000_000))
    whole = lines.select("session", (F.col("before") + 1).alias("event_id"), F.timestamp_seconds(F.col("before") + 1 + 1_700_000_000).alias("ts"), "line")
    detector, shared = streams.Detector(PARAMS), audit.share(*basis, {"own": ("en",)})
    want = decided(spark, tmp_path / "words", [single], lambda source: streams.detect_stream(source, detector))
    got = decided(spark, tmp_path / "lines", [whole], lambda source: streams.detect_packets(streams.line_packets(source, shared), detector))
    assert got == want and len(got) == ngrams.words(lines).count() and {r[3] for r in got} == {True, False}


def test_a_detector_counts_seconds_not_the_clock(spark, tmp_path):
    """Where clocks are put forward by an hour, a word a second is no idle gap."""
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        forward = 1_710_054_000 - 1_700_000_000  # 2024-03-10 07:00 UTC
        rows = [(1, i, float(forward - 3 + i), "word", "ab", None) for i in range(6)]
        got = decided(spark, tmp_path, [timed(spark, rows)], streams.detect_stream)
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert [r[4] for r in sorted(got, key=lambda r: r[1])] == [0, 1, 2, 3, 4, 5]


def test_the_query_hands_lines_to_the_detector_not_words(spark):
    """Words and their evaluations are neither written nor shuffled a row each; states are those of groups, and are deleted."""
    heard = Progress()
    spark.streams.addListener(heard)
    try:
        words = entry.queries()["g5_detect_stream"](spark, SF).count()
        spark._jsc.sc().listenerBus().waitUntilEmpty()
    finally:
        spark.streams.removeListener(heard)
    lines = X.audit_lines(X.lines(spark, SF)).count()
    assert sum(p.numInputRows for p in heard.seen) == lines < words / 5
    assert max(p.stateOperators[0].numRowsTotal for p in heard.seen) <= streams.GROUPS


def test_batches_are_written_by_all_tasks(spark, tmp_path):
    """As wide as the rows lie, not by four; each batch arrives whole, in the order of its time."""
    rows, seen = spark.range(6_000).repartition(6).withColumn("ts", F.timestamp_seconds("id")), []

    def work(batch, number):
        seen.append((number, *batch.withColumn("file", F.input_file_name()).agg(F.count_distinct("file"), F.min("id"), F.max("id"), F.count("id")).first()))

    held = spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.openCostInBytes", "128m")  # a task a file
    try:
        queries.in_batches(spark, rows, lambda stream: streams.per_batch(stream, work, str(tmp_path / "checkpoint")), "ts")
    finally:
        spark.conf.set("spark.sql.files.openCostInBytes", held)
    assert seen == [(0, 6, 0, 1_999, 2_000), (1, 6, 2_000, 3_999, 2_000), (2, 6, 4_000, 5_999, 2_000)]

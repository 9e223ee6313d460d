"""Streaming operators: sessions, scoring, training, detection, logs, samples."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from glyphshift import constants as K
from glyphshift.functions import text as T
from glyphshift.operators.audit import deltas, words_of_lines
from glyphshift.operators.cleaning import drop_tombstones
from glyphshift.operators.decide import decide, decision_log
from glyphshift.operators.ngrams import Models, count_ngrams, merge_counts, model_chars, word_counts
from glyphshift.operators.tables import Shared, cells
from glyphshift.sources.batches import Batches, keep_last


def segment_stream(events: DataFrame, key: str = "user_id", idle: str = "15 seconds", late: str = "1 minute") -> DataFrame:
    """key, began, ended, n_events of sessions that an idle gap closes. Rows behind the watermark are dropped."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    sessions = timed.groupBy(key, F.session_window("ts", idle).alias("s")).agg(F.count(F.lit(1)).alias("n_events"))
    return sessions.select(key, F.col("s.start").alias("began"), F.col("s.end").alias("ended"), "n_events")


def start_once(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Runs a stream over all there is, into a table of files, and ends."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()


def per_batch(stream: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    stream.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def score_stream(pairs: DataFrame, models: Models, collisions: DataFrame, path: str, checkpoint: str, delta: float = K.DEFAULTS.baseline) -> None:
    """Decides each incoming pair. A batch replaces its own folder, so a repeated batch changes nothing."""

    def work(batch: DataFrame, number: int) -> None:
        decide(batch, models, collisions, delta).write.mode("overwrite").parquet(f"{path}/batch={number}")

    per_batch(pairs, work, checkpoint)


LOG = "time timestamp, active_word string, shadow_word string, layout string, on_delimiter boolean, is_colliding boolean, is_ambiguous boolean, score_diff double, delta double, category string, should_switch boolean"


def log_stream(pairs: DataFrame, models: Models, collisions: DataFrame, path: str, checkpoint: str, delta: float = K.DEFAULTS.baseline, keep: int | None = None, least_bytes: int = 10 * 1024 * 1024) -> None:
    """Appends the decision log of incoming pairs (with their `time`), a folder a batch. With `keep`, a log beyond `least_bytes` is
    cut to its last rows after a batch."""

    def work(batch: DataFrame, number: int) -> None:
        log = Batches(batch.sparkSession, path, LOG)
        log.write(decision_log(decide(batch, models, collisions, delta), delta), number)
        if keep is not None:
            keep_last(log, keep, least_bytes)

    per_batch(pairs, work, checkpoint)


GRAMS, CHARS = "model string, n int, gram string, cnt long", "model string, ch string"
#: Batches that a stream of counts leaves apart before it merges them.
LOOSE = 8


def ngram_stream(lines: DataFrame, path: str, checkpoint: str, loose: int = LOOSE) -> None:
    """Counts each batch of lines (model, line) into the store. Every `loose` batches are merged into the snapshot, so that reading
    the model doesn't grow with their number. A repeated batch changes nothing."""

    def work(batch: DataFrame, number: int) -> None:
        grams, chars = stored_batches(batch.sparkSession, path)
        counts = word_counts(batch)
        grams.write(count_ngrams(counts), number)
        chars.write(model_chars(counts), number)
        if len(grams.numbers()) >= loose:
            compact(batch.sparkSession, path)

    per_batch(lines, work, checkpoint)


def stored_batches(spark: SparkSession, path: str) -> tuple[Batches, Batches]:
    return Batches(spark, f"{path}/ngrams", GRAMS), Batches(spark, f"{path}/chars", CHARS)


def compact(spark: SparkSession, path: str) -> None:
    """Merges the store's batches: counts add up, characters are united."""
    grams, chars = stored_batches(spark, path)
    chars.swap(lambda rows: rows.distinct())
    grams.swap(lambda rows: merge_counts(rows))


def stored_model(spark: SparkSession, path: str) -> Models:
    grams, chars = stored_batches(spark, path)
    return Models(merge_counts(grams.read()), chars.read().distinct())


def mixed_stream(comments: DataFrame, late: str = "10 minutes") -> DataFrame:
    """id, ts, text of comments in both scripts, of equal ones the first within the watermark."""
    timed = drop_tombstones(comments, "body").withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    both = timed.where(T.has_hebrew("body") & T.has_english("body") & (F.length("body") > 20))
    return both.select("id", "ts", T.strip(F.replace("body", F.lit("\n"), F.lit(" "))).alias("text")).dropDuplicatesWithinWatermark(["text"])


#: Sessions are dealt to so many groups, as handing a key's rows and state to a task has a cost of its own. It must stay the same
#: while a checkpoint lasts.
GROUPS = 2_048
#: The states of a group's sessions.
STATE = "session array<long>, english array<boolean>, k array<int>, tail array<int>, at array<long>"
#: Decisions on consecutive words of a session, at most PAGE of them.
DECIDED = "session long, event_id array<long>, word array<string>, switched array<boolean>, k array<int>, lookback array<int>, english array<boolean>"
PAGE = 1_024
#: What an event is to the detector, as bits: a word, a break, and whether the word can be corrected later if it was typed on the
#: English or on the Hebrew layout.
WORD, BREAK, FIX_EN, FIX_HE = 1, 2, 4, 8


class Detector:
    """A session's state: layout, words since the last reset, correctable tail (at most 50), time of the last event in microseconds.
    A break event or an idle gap resets all but the layout. The state of a session that stays silent for `keep` seconds behind the
    watermark is deleted: it starts again on the English layout. A session's rows of one micro-batch are put in order together."""

    def __init__(self, params: K.Params = K.DEFAULTS, idle: float = K.IDLE_SECONDS, breaks: tuple[str, ...] = K.BREAKS, keep: float = 3_600.0):
        self.params, self.idle, self.breaks, self.keep = params, idle, breaks, keep

    def __call__(self, key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        """The decisions on the packets of a group of sessions, whose states are kept. Without any, some states are due for deletion."""
        held = {session: tuple(own) for session, *own in zip(*state.get)} if state.exists else {}
        if not state.hasTimedOut:
            yield self.decided(key[0], list(batches), held)
        watermark = state.getCurrentWatermarkMs()
        until = {session: at // 1_000 + int(self.keep * 1_000) + 1 for session, (*_, at) in held.items()}
        kept = [session for session in held if until[session] > watermark]
        if kept:
            state.update((kept, *(list(column) for column in zip(*(held[session] for session in kept)))))
            state.setTimeoutTimestamp(min(until[session] for session in kept) - 1)  # the watermark must be behind it
        elif state.exists:
            state.remove()

    def decided(self, group: int, parts: list[pd.DataFrame], held: dict[int, tuple]) -> pd.DataFrame:
        """Pages of decisions. `held` gets the sessions' states behind the last of their events."""
        column = lambda name: np.concatenate([part[name].to_numpy() for part in parts])
        flat = lambda name: np.concatenate(column(name))
        n = np.fromiter(map(len, column("code")), dtype=np.int64)
        of, place = cells(n)
        session, event_id, at = column("session")[of], column("event_id")[of] + place, column("at")[of] + place * column("every")[of]
        order = np.lexsort((event_id, at, session))
        session, event_id, at, code, high, low = (x[order] for x in (session, event_id, at, flat("code"), flat("high"), flat("low")))
        begins = np.flatnonzero(np.r_[True, session[1:] != session[:-1]])
        ends = np.r_[begins[1:], len(at)]
        gap = np.diff(at, prepend=at[0])
        gap[begins] = [t - held[s][-1] if s in held else 0 for s, t in zip(session[begins].tolist(), at[begins].tolist())]
        lost, words = ((code & BREAK > 0) | (gap > self.idle * 1_000_000)).tolist(), code & WORD > 0
        # By layout, the Hebrew one first. Of a word's evaluations one is over a threshold if the highest is, on the Hebrew layout the
        # lowest with the sign changed.
        tops, fixes = ((-low).tolist(), high.tolist()), ((code & FIX_HE > 0).tolist(), (code & FIX_EN > 0).tolist())
        is_word, limits, switched, ks, lookback, layout = words.tolist(), [], [], [], [], []
        for s, begin, end, last in zip(session[begins].tolist(), begins.tolist(), ends.tolist(), at[ends - 1].tolist()):
            english, k, tail, _ = held.get(s, (True, 0, 0, None))
            top, fix = tops[english], fixes[english]
            for i in range(begin, end):
                if lost[i]:
                    k = tail = 0
                if not is_word[i]:
                    continue
                if k >= len(limits):
                    limits = deltas(2 * k + 64, self.params).tolist()
                ks.append(k)
                layout.append(english)
                if top[i] > limits[k]:
                    switched.append(True)
                    lookback.append(tail)
                    english, k, tail = not english, 0, 0
                    top, fix = tops[english], fixes[english]
                else:
                    switched.append(False)
                    lookback.append(0)
                    k += 1
                    tail = 0 if not fix[i] else tail + 1 if tail < K.HISTORY else tail
            held[s] = english, k, tail, last
        upto = np.r_[0, np.cumsum(words)]
        pages = [(s, i, min(i + PAGE, end)) for s, begin, end in zip(session[begins].tolist(), upto[begins].tolist(), upto[ends].tolist()) for i in range(begin, end, PAGE)]
        every = event_id[words].tolist(), flat("word")[order][words].tolist(), switched, ks, lookback, layout
        return pd.DataFrame([(s if group >= 0 else None, *(values[i:j] for values in every)) for s, i, j in pages], columns=["session", "event_id", "word", "switched", "k", "lookback", "english"])


def detect_packets(packets: DataFrame, detector: Detector, late: str = "1 minute", groups: int = GROUPS) -> DataFrame:
    """Decisions, with the state kept by session. A packet (session, event_id, ts, every, word, code, high, low) is events that follow
    each other `every` so many microseconds, with consecutive ids: each with its word, if it is one, its bits, and the highest and
    the lowest evaluation that don't collide."""
    timed = packets.withWatermark("ts", late)
    # Events without a session are one, in a group of its own.
    group = F.when(F.col("session").isNull(), -1).otherwise(F.pmod(F.xxhash64("session"), F.lit(groups))).cast("int")
    rows = timed.select(group.alias("group"), F.coalesce("session", F.lit(0).cast("long")).alias("session"), "event_id", "ts", F.unix_micros("ts").alias("at"), "every", "word", "code", "high", "low")
    pages = rows.groupBy("group").applyInPandasWithState(detector, DECIDED, STATE, "append", GroupStateTimeout.EventTimeTimeout)
    layout = F.when(F.col("english"), "en").otherwise("he").alias("layout")
    return pages.select("session", F.inline(F.arrays_zip("event_id", "word", "switched", "k", "lookback", "english"))).select("session", "event_id", "word", "switched", "k", "lookback", layout)


def detect_stream(words: DataFrame, detector: Detector | None = None, late: str = "1 minute") -> DataFrame:
    """words (session, event_id, ts, event_type, word, evals): decisions, with the state kept by session."""
    detector = detector or Detector()
    free = F.transform(F.filter("evals", lambda e: ~F.coalesce(e["coll"], F.lit(False))), lambda e: e["d"])
    last = F.when(F.size("evals") > 0, F.element_at("evals", -1))
    fixed = (F.length("word") < 2) | last["coll"]
    bits = {WORD: F.col("event_type") == "word", BREAK: F.col("event_type").isin(*detector.breaks), FIX_EN: fixed | (last["d"] > 0), FIX_HE: fixed | (last["d"] < 0)}
    code = reduce(Column.__add__, (F.when(holds, bit).otherwise(0) for bit, holds in bits.items())).cast("byte")
    inf = F.lit(float("inf"))
    each = {"word": F.col("word"), "code": code, "high": F.coalesce(F.array_max(free), -inf), "low": F.coalesce(F.array_min(free), inf)}
    alone = words.select(F.col("session").cast("long"), F.col("event_id").cast("long"), F.col("ts").cast("timestamp"), F.lit(0).cast("long").alias("every"), *(F.array(c).alias(name) for name, c in each.items()))
    return detect_packets(alone, detector, late)


def line_packets(lines: DataFrame, shared: Shared, every: int = 1_000_000) -> DataFrame:
    """A packet for each line (session, event_id, ts, line) that has words: a break, and the words, evaluated by the models shared."""
    keys = ("session", "event_id", "ts")
    split = words_of_lines(shared, [("en",)], keys, "en")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own_keys, n, words, (ids, size, found) in split(batches):
            high, low, to_hebrew, to_english = found.leanings()
            short = size < 2
            code = (WORD + FIX_EN * (short | to_hebrew) + FIX_HE * (short | to_english)).astype(np.int8)
            limits = np.r_[0, np.cumsum(n + 1)]
            is_word = np.ones(limits[-1], dtype=bool)
            is_word[limits[:-1]] = False
            columns = [words.take(pa.array(np.cumsum(is_word) - 1, mask=~is_word))]
            for values, of_break in ((code, BREAK), (high, -np.inf), (low, np.inf)):
                column = np.full(limits[-1], of_break, dtype=values.dtype)
                column[is_word] = values[ids]
                columns.append(pa.array(column))
            lists = [pa.ListArray.from_arrays(pa.array(limits.astype(np.int32)), column) for column in columns]
            yield pa.RecordBatch.from_arrays([*own_keys, pa.repeat(pa.scalar(every, pa.int64()), len(n)), *lists], [*keys, "every", "word", "code", "high", "low"])

    return lines.select(*keys, "line").mapInArrow(run, "session long, event_id long, ts timestamp, every long, word array<string>, code array<tinyint>, high array<double>, low array<double>")

"""Batches with a snapshot: crashes, repeated batches, a writer beside a cut."""

import pytest
from pyspark.sql import functions as F

from glyphshift.operators import ngrams
from glyphshift.sources.batches import Batches, keep_last
from glyphshift.streaming import streams

SCHEMA = "time long, word string"


def rows(spark, first, n):
    return spark.range(first, first + n).select(F.col("id").alias("time"), F.concat(F.lit("w"), F.col("id").cast("string")).alias("word"))


def times(log):
    return sorted(r.time for r in log.read().collect())


def test_a_crash_at_any_step_changes_nothing(spark, tmp_path, monkeypatch):
    log = Batches(spark, str(tmp_path / "log"), SCHEMA)
    assert log.folders() == [] and log.read().count() == 0
    for k in range(3):
        log.write(rows(spark, 10 * k, 10), k)
    (tmp_path / "log/batch=3").mkdir()  # a batch that isn't finished
    want = list(range(30))
    for step in ("point", "clear"):
        with monkeypatch.context() as broken:
            broken.setattr(Batches, step, lambda *_: (_ for _ in ()).throw(OSError("crash")))
            with pytest.raises(OSError):
                log.swap(lambda df: df)
        assert times(log) == want
        assert len(log.folders()) == (3 if step == "point" else 1)
    log.write(rows(spark, 0, 10), 1)  # the snapshot holds it already
    assert times(log) == want
    log.write(rows(spark, 30, 5), 3)
    log.swap(lambda df: df)
    assert times(log) == list(range(35)) and len(log.folders()) == 1
    assert sum(p.is_dir() for p in (tmp_path / "log").iterdir()) == 1


def test_a_log_is_cut_beside_its_writer(spark, tmp_path, monkeypatch):
    log = Batches(spark, str(tmp_path / "log"), SCHEMA)
    for k in range(6):
        log.write(rows(spark, 100 * k, 100), k)
    assert not keep_last(log, 250, least_bytes=10**9) and len(log.folders()) == 6
    read, seen = Batches.read, []

    def spied(self, folders=None):
        seen.extend(folders or [])
        return read(self, folders)

    point = Batches.point

    def beside(self, *args):  # the writer appends while the log is cut
        Batches(spark, self.path, SCHEMA).write(rows(spark, 600, 10), 6)
        point(self, *args)

    with monkeypatch.context() as m:
        m.setattr(Batches, "read", spied)
        m.setattr(Batches, "point", beside)
        assert keep_last(log, 250, least_bytes=100)
    assert times(log) == list(range(350, 610))
    assert {f.rsplit("=", 1)[1] for f in seen} == {"3", "4", "5"}  # older ones aren't read
    assert len(log.folders()) == 2


def test_a_store_stays_small_and_equals_its_lines(spark, tmp_path):
    lines = [("en", f"hello world number {'abc' * (k % 4 + 1)}") for k in range(7)]
    for k, line in enumerate(lines):
        spark.createDataFrame([line], "model string, line string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("model string, line string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    store = str(tmp_path / "store")
    streams.ngram_stream(stream, store, str(tmp_path / "checkpoint"), loose=3)
    grams, chars = streams.stored_batches(spark, store)
    assert len(grams.folders()) <= 3 and len(chars.folders()) <= 3 and grams.snapshot()[0]
    want = ngrams.train(spark.createDataFrame(lines, "model string, line string"))
    got = streams.stored_model(spark, store)
    assert {tuple(r) for r in got.ngrams.collect()} == {tuple(r) for r in want.ngrams.collect()}
    assert {tuple(r) for r in got.chars.collect()} == {tuple(r) for r in want.chars.collect()}
    again = spark.readStream.schema("model string, line string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    streams.ngram_stream(again, store, str(tmp_path / "lost"), loose=3)  # the checkpoint is lost: batches come again
    assert {tuple(r) for r in streams.stored_model(spark, store).ngrams.collect()} == {tuple(r) for r in want.ngrams.collect()}

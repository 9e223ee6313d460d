"""Words and grams counted where their lines lie: a task adds up a slice at a time, and only the slices' counts are shuffled."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphshift import constants as K

#: Words that are counted at once.
WORDS = 1 << 20
#: Distinct words that are cut into grams at once: each takes about 800 bytes for the while.
GRAMMED = 1 << 18
#: White space of one byte, and that of more, as Python and `split_words` take it.
BLANKS = bytes([*range(9, 14), *range(28, 33)])
MARKED = bytes(b in BLANKS for b in range(256))
LONG = [c.encode() for c in K.SPACES if ord(c) > 127]
LEADS, LONGER = sorted({c[0] for c in LONG}), re.compile(b"|".join(LONG))


def cut_lines(lines: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """How many words each line has, and the words, cut out of the lines' bytes."""
    offsets = np.frombuffer(lines.buffers()[1], dtype=np.int32)[lines.offset : lines.offset + len(lines) + 1].astype(np.int64)
    raw = memoryview(lines.buffers()[2] or b"")[offsets[0] : offsets[-1]].tobytes()
    offsets -= offsets[0]
    data = np.frombuffer(raw, dtype=np.uint8)
    if any((data == lead).any() for lead in LEADS):
        raw = LONGER.sub(lambda found: b" " * len(found[0]), raw)
    blank = np.frombuffer(raw.translate(MARKED), dtype=bool)
    # A word begins where no blank is, behind a blank or at a line's begin; it ends likewise.
    cut = np.empty(len(raw) + 1, dtype=bool)
    cut[1:] = blank
    cut[offsets] = True
    begins = np.flatnonzero(cut[:-1] & ~blank)
    cut[:-1] = blank
    cut[offsets] = True
    ends = np.flatnonzero(cut[1:] & ~blank) + 1
    places = np.r_[0, np.cumsum(ends - begins)].astype(np.int32)
    words = pa.StringArray.from_buffers(len(begins), pa.py_buffer(places), pa.py_buffer(raw.translate(None, BLANKS)))
    return np.diff(np.searchsorted(begins, offsets)), words


def put_together(batches: Iterator[pa.RecordBatch], size=len, least: int = WORDS) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
    """Batches strung together until `size` of them reaches `least`."""
    held, much = [], 0
    for batch in batches:
        held.append(batch)
        much += size(batch)
        if much >= least:
            yield pa.concat_batches(held)
            held, much = [], 0
    if held:
        yield pa.concat_batches(held)


def counted(lines: DataFrame, *keys: str) -> DataFrame:
    """keys, word, cnt, in parts: the words between Unicode white space (Python's is the same) that a task's slices of lines hold."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, words = cut_lines(batch.column("line"))
            own = pa.array(np.repeat(np.arange(len(n)), n))
            yield pa.RecordBatch.from_arrays([*(batch.column(key).take(own) for key in keys), words], [*keys, "word"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in put_together(split(batches)):
            found = pa.Table.from_batches([batch]).group_by([*keys, "word"], use_threads=False).aggregate([([], "count_all")])
            yield from found.rename_columns([*keys, "word", "cnt"]).combine_chunks().to_batches()

    kinds = dict(lines.dtypes)
    schema = ", ".join([*(f"`{key}` {kinds[key]}" for key in keys), "word string, cnt long"])
    return lines.select(*keys, "line").where(F.col("line").isNotNull()).mapInArrow(run, schema)


def gram_counts(words: pa.Array, cnt: np.ndarray) -> Iterator[tuple[int, list[str], np.ndarray]]:
    """For two, three and four characters, the grams of words with a blank at either end, and their counts."""
    texts = words.to_pylist()
    long = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)) + 2
    points = np.frombuffer("".join(f" {text} " for text in texts).encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
    begin = np.cumsum(long) - long
    # Places of two characters are numbered, so that any two of them fit into a number.
    two, pair = np.unique(points[:-1] << 21 | points[1:], return_inverse=True)
    for n in (2, 3, 4):
        places = np.maximum(long - n + 1, 0)
        of = np.repeat(np.arange(len(texts)), places)
        at = begin[of] + np.arange(len(of)) - np.repeat(np.cumsum(places) - places, places)
        key = pair[at] if n == 2 else pair[at] << 32 | (points[at + 2] if n == 3 else pair[at + 2])
        order = np.argsort(key, kind="stable")
        first = np.flatnonzero(np.r_[True, key[order][1:] != key[order][:-1]]) if len(key) else order
        seen = at[order[first]]
        whole = points[seen[:, None] + np.arange(n)].astype(np.uint32).tobytes().decode("utf-32-le")
        yield n, [whole[i : i + n] for i in range(0, len(whole), n)], np.add.reduceat(cnt[of][order], first) if len(key) else cnt[:0]


def grams_of_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """model, n, gram, cnt of batches of counted words (model, word, cnt), added up over GRAMMED words."""
    for batch in put_together(batches, least=GRAMMED):
        for model in batch.column("model").unique():
            own = batch.filter(pc.equal(batch.column("model"), model))
            for n, grams, cnt in gram_counts(own.column("word"), own.column("cnt").to_numpy()):
                yield pa.RecordBatch.from_arrays([pa.repeat(model, len(grams)), pa.repeat(pa.scalar(n, pa.int32()), len(grams)), pa.array(grams, pa.string()), pa.array(cnt, pa.int64())], ["model", "n", "gram", "cnt"])


def counted_grams(counts: DataFrame) -> DataFrame:
    """model, n, gram, cnt, in parts, of counted words (model, word, cnt)."""
    return counts.select("model", "word", F.col("cnt").cast("long").alias("cnt")).mapInArrow(grams_of_words, "model string, n int, gram string, cnt long")

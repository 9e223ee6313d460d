"""Substring dedup by level-wise doubling: windows of words repeated at one length alone are extended to twice that length.

The first level's windows (about a quarter of `length`) are chosen by their content: in every window of `length` words,
those with the least hash. Two equal windows choose alike, so no repeat is lost and one window in about twenty goes to the
shuffle. Windows of the first level that stand in different texts are extended to half of `length`, to either side; of
these, the repeated ones are extended to all windows of `length` around them, and the first document of each is found.
Each level is a grouping with partial sums and a join back, in which very common windows meet a bounded broadcast table where
they lie; nothing is collected but what one document holds.

Documents with equal texts are one text up to the last step: all but the first are wholly covered.

A word is covered if it lies in a window of `length` words that also starts in a document with a smaller id. Windows are
compared by 64 bits on the lower levels and by 96 on the last. A null or empty text has no words, and texts shorter than
`length` words are never cut. A row without an id is neither cut nor a source. Rows are told apart by id and text: repeated
rows are cut alike, and other texts of the same id are judged by their own words, never against each other. Further columns,
whatever their names, are passed on.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphshift.llm._shared import hot_limit, join_back, keyed, map_batches, release, text_bytes, write_cut

LENGTH = 50
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
BYTE_BASE, WORD_BASES = 0x9E3779B97F4A7C15, (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


@lru_cache(maxsize=8)
def powers(base: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse, modulo 2**64."""
    inverse = pow(base, -1, 1 << 64)
    make = lambda b: np.concatenate([[np.uint64(1)], np.cumprod(np.full(size - 1, b, dtype=np.uint64))])
    return make(base), make(inverse)


def powers_for(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(16, int(n).bit_length())
    up, down = powers(base, size)
    return up[:n], down[:n]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def range_sums(values: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
    """What ranges of `values` are hashed from: prefix sums of values times powers, and the inverse powers."""
    up, down = powers_for(base, len(values) + 1)
    return np.concatenate([[np.uint64(0)], np.cumsum(values * up[:-1], dtype=np.uint64)]), down


class Words:
    """The words of several texts as hashes, one after the other, and the text of each."""

    def __init__(self, rows: list[bytes]):
        raw = np.frombuffer(b" ".join(rows) + b" ", dtype=np.uint8)
        inside = ~SPACE[raw]
        edge = np.diff(inside.astype(np.int8), prepend=0)
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        sums, down = range_sums(raw.astype(np.uint64) + np.uint64(1), BYTE_BASE)
        self.hash = mixed((sums[ends] - sums[starts]) * down[starts])
        begins = np.cumsum([0, *(len(r) + 1 for r in rows)])
        self.first = np.searchsorted(starts, begins)  # of each text, and the number of all words
        self.size = np.diff(self.first)
        self.text = np.repeat(np.arange(len(rows)), self.size)
        self.left = np.repeat(self.first[1:], self.size) - np.arange(len(self.hash))  # words from here to the end of the text
        self.sums: dict[int, tuple] = {}

    def windows(self, at: np.ndarray, length: int, base: int = WORD_BASES[0]) -> np.ndarray:
        """Hashes of the windows that start at `at`."""
        if base not in self.sums:
            self.sums[base] = range_sums(self.hash, base)
        sums, down = self.sums[base]
        return mixed((sums[at + length] - sums[at]) * down[at])


def sliding(pick, values: np.ndarray, width: int) -> np.ndarray:
    """`pick` (minimum or maximum) over each run of `width` values."""
    reach = 1
    while reach * 2 <= width:
        values, reach = pick(values[:-reach], values[reach:]), reach * 2
    more = width - reach
    return pick(values[: len(values) - more], values[more:]) if more else values


def anchors_of(words: Words, length: int) -> np.ndarray:
    """Places of the first level's windows: the least of those in some window of `length` words."""
    short = (length + 3) // 4
    width = length - short + 1
    n = len(words.hash) - short + 1
    if n < width:
        return np.zeros(0, dtype=np.int64)
    hashes = words.windows(np.arange(n), short)
    least = sliding(np.minimum, hashes, width)  # of the window of `length` words from each place
    least[words.left[: len(least)] < length] = 0  # it crosses into the next text
    pad = np.zeros(width - 1, dtype=np.uint64)
    most = sliding(np.maximum, np.concatenate([pad, least, pad]), width)
    return np.flatnonzero((most == hashes) & (most > 0))


ANCHORS = "doc_id long, key long, key2 int, pos int, h long, right long, left long"


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def find_anchors(docs: DataFrame, length: int) -> DataFrame:
    """First-level windows: place, hash, and the hashes of the windows of half of `length` to the right and left (or null)."""
    short, half = (length + 3) // 4, (length + 1) // 2

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        words = Words(text_bytes(batch))
        at = anchors_of(words, length)
        text = words.text[at]
        pos = at - words.first[text]
        to_right, to_left = words.left[at] >= half, pos >= half - short
        right, left = np.zeros(len(at), dtype=np.uint64), np.zeros(len(at), dtype=np.uint64)
        right[to_right] = words.windows(at[to_right], half)
        left[to_left] = words.windows(at[to_left] - (half - short), half)
        return pa.RecordBatch.from_arrays(
            [
                *(batch.column(name).take(pa.array(text)) for name in ("doc_id", "key", "key2")),
                pa.array(pos.astype(np.int32)),
                pa.array(signed(words.windows(at, short))),
                pa.array(signed(right), mask=~to_right),
                pa.array(signed(left), mask=~to_left),
            ],
            ["doc_id", "key", "key2", "pos", "h", "right", "left"],
        )

    return map_batches(keyed(docs).where("doc_id is not null").withColumn("key2", F.hash("text")), work, ANCHORS)


def repeated(windows: DataFrame, by: str, limit: int) -> DataFrame:
    """The rows whose window stands in different texts."""
    sums = windows.groupBy(by).agg(F.min("key").alias("low"), F.max("key").alias("high"), F.count(F.lit(1)).alias("n")).select(by, "n", (F.col("low") < F.col("high")).alias("use"))
    return join_back(windows, write_cut(sums.where(F.col("use") | (F.col("n") >= limit))), [by], limit, "left_semi")


def full_windows(docs: DataFrame, around: DataFrame, length: int) -> DataFrame:
    """doc_id, key, pos, w1, w2: all windows of `length` words around the half windows of `around` (doc_id, key, halves)."""
    half = (length + 1) // 2

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        words = Words(text_bytes(batch))
        mark = np.zeros(len(words.hash) + 1, dtype=np.int32)
        halves = batch.column("halves")
        at = halves.flatten().to_numpy() + np.repeat(words.first[:-1], np.asarray([len(h) for h in halves], dtype=np.int64))
        text = words.text[at]
        np.add.at(mark, np.maximum(at - (length - half), words.first[text]), 1)
        np.add.at(mark, at + 1, -1)
        at = np.flatnonzero((np.cumsum(mark[:-1]) > 0) & (words.left >= length))
        text = words.text[at]
        w2 = (words.windows(at, length, WORD_BASES[1]) >> np.uint64(32)).astype(np.uint32).view(np.int32)
        return pa.RecordBatch.from_arrays(
            [*(batch.column(name).take(pa.array(text)) for name in ("doc_id", "key")), pa.array((at - words.first[text]).astype(np.int32)), pa.array(signed(words.windows(at, length))), pa.array(w2)],
            ["doc_id", "key", "pos", "w1", "w2"],
        )

    return map_batches(keyed(docs).join(around, ["doc_id", "key"]).select("doc_id", "key", "text", "halves"), work, "doc_id long, key long, pos int, w1 long, w2 int")


def later_starts(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, key and starts: of each text with any, the places of windows that also start in a document with a smaller id.
    -1 stands for all of a text that repeats an earlier document's whole."""
    short, half = (length + 3) // 4, (length + 1) // 2
    anchors = write_cut(find_anchors(docs, length))
    limit = hot_limit(anchors.count())
    texts = write_cut(anchors.select("doc_id", "key", "key2").distinct())
    firsts = texts.groupBy("key", "key2").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n"), F.lit(True).alias("use")).where("n > 1")
    copies = write_cut(join_back(texts, firsts, ["key", "key2"], hot_limit(texts.count())).where("doc_id > first").select("doc_id", "key"))
    release(texts)
    sides = F.array(F.struct(F.col("right").alias("w"), F.col("pos").alias("half")), F.struct(F.col("left").alias("w"), (F.col("pos") - (half - short)).alias("half")))
    doubled = write_cut(repeated(anchors, "h", limit).select("doc_id", "key", F.explode(sides).alias("e")).select("doc_id", "key", "e.w", "e.half").where("w is not null"))
    release(anchors)
    around = repeated(doubled, "w", limit).groupBy("doc_id", "key").agg(F.collect_set("half").alias("halves")).join(copies, ["doc_id", "key"], "left_anti")
    windows = write_cut(full_windows(docs, around, length))
    release(doubled)
    limit = hot_limit(windows.count())
    first = windows.groupBy("w1", "w2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count(F.lit(1)).alias("n"))
    first = write_cut(first.select("w1", "w2", "first", "n", (F.col("first") < F.col("last")).alias("use")).where(F.col("use") | (F.col("n") >= limit)))
    later = join_back(windows, first, ["w1", "w2"], limit).where("doc_id > first").select("doc_id", "key", "pos")
    starts = write_cut(later.unionByName(copies.select("doc_id", "key", F.lit(-1).alias("pos"))).groupBy("doc_id", "key").agg(F.collect_set("pos").alias("starts")))
    release(windows, first, copies)
    return starts


def kept_words(words: list[bytes], starts: list[int] | None, length: int) -> list[bytes]:
    if not starts:
        return words
    if -1 in starts:
        return []
    out, end = [], 0
    for start in sorted(starts):
        if start > end:
            out += words[end:start]
        end = max(end, start + length)
    return out + words[end:]


def report(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every document row."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        total, gone, digests = [], [], []
        for text, starts in zip(text_bytes(batch), batch.column("starts").to_pylist()):
            words = text.split()
            kept = kept_words(words, starts, length)
            total.append(len(words))
            gone.append(len(words) - len(kept))
            digests.append(hashlib.sha256(b" ".join(kept)).hexdigest())
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(digests, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"]
        )

    joined = keyed(docs).join(later_starts(docs, length).hint("merge"), ["doc_id", "key"], "left").select("doc_id", "text", "starts")
    return map_batches(joined, work, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """`docs`, all columns, with covered words cut out of `text`; texts that lose none stay as they are, to the byte."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("key"), F.struct(*(docs[n] for n in docs.columns)).alias("row"))
    joined = own.join(later_starts(docs, length).hint("merge"), ["doc_id", "key"], "left").select("row", "starts")
    names, place = docs.columns, docs.columns.index("text")

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        columns = batch.column("row").flatten()
        cut = [b" ".join(kept_words(t.split(), starts, length)) if t and starts else t for t, starts in zip(columns[place].cast(pa.binary()).to_pylist(), batch.column("starts").to_pylist())]
        columns[place] = pa.array(cut, pa.binary()).cast(pa.string())
        return pa.RecordBatch.from_arrays(columns, names)

    return map_batches(joined, work, docs.schema)


ORACLE = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS t FROM documents),
w AS (SELECT doc_id, k, md5(array_to_string(t[k:k + 49], ' ')) AS g FROM d, unnest(range(1, len(t) - 48)) AS u(k)),
f AS (SELECT doc_id, k FROM (SELECT doc_id, k, min(doc_id) OVER (PARTITION BY g) AS first FROM w) WHERE doc_id > first),
gone AS (SELECT DISTINCT doc_id, k + e AS k FROM f, unnest(range(0, 50)) AS v(e)),
words AS (SELECT doc_id, unnest(t) AS word, unnest(range(1, len(t) + 1)) AS k FROM d),
rest AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY k) AS kept FROM words ANTI JOIN gone USING (doc_id, k) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(t) AS BIGINT) AS n_words, CAST(len(t) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN rest USING (doc_id)
"""

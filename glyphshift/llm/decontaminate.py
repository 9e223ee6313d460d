"""Benchmark decontamination: Wu-Manber multi-pattern search over words.

The windows of the benchmark are the patterns and a document's words are the text. For each pattern length, a shift
table over blocks of two words says how far the search may jump; where it may not jump, the bucket of patterns that end
in that block (by the same block's key) is compared word by word. Patterns of one length share their tables, so short
items don't shorten the jumps of the full windows. Words are numbers, a pattern is a place in the benchmark's words, and the
tables are arrays of numbers: a worker holds about 20 bytes a byte of benchmark text.

The benchmark is the stated query set. Its size is measured first; beyond `block_bytes` it is searched in blocks of
items, each of a bounded size: one block's tables are broadcast at a time, what it finds is written, and its broadcast is
deleted before the next. The blocks' finds are put together by document.

A null or empty text has no words and no hits; a null or empty item has no windows. Equal windows of several items count
for each item. Repeated document rows give a row each; further columns are ignored; an empty benchmark hits nothing.
"""

from __future__ import annotations

import hashlib
import math
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphshift.llm._shared import id_and_text, map_batches, release, text_bytes, write_cut

WINDOW = 10
#: Bytes of benchmark text that are searched, and so broadcast, at a time.
BLOCK_BYTES = 8_000_000
#: Spreads the numbers of a block's first word over the slots of the shift table.
MIX = 0x9E3779B1


def word_table() -> bytes:
    """A-Z to lower case; ASCII that is neither digit nor letter to space; bytes of other characters stay."""
    letters = b"abcdefghijklmnopqrstuvwxyz"
    table = bytearray(b" " * 128) + bytearray(range(128, 256))
    for c in letters + b"0123456789":
        table[c] = c
    for c in letters.upper():
        table[c] = c + 32
    return bytes(table)


WORD_TABLE = word_table()


def split_words(text: bytes) -> list[bytes]:
    return text.translate(WORD_TABLE).split()


class WuManber:
    """Tables for windows of one length over the benchmark's words, which are numbers strung together: a shift for each hash of a
    block, the windows in the order of their last block, and the places of equal ones. A pattern is a place, not a copy."""

    def __init__(self, stream: np.ndarray, starts: np.ndarray, owners: np.ndarray, length: int, n_words: int):
        self.stream, self.length, self.block, self.n_words = stream, length, min(2, length), n_words
        far = length - self.block + 1
        self.mask = (1 << max(8, int(starts.size * far).bit_length() + 1)) - 1
        shift = np.full(self.mask + 1, far, dtype=np.uint8 if far < 256 else np.uint32)
        for end in range(self.block, length + 1):  # later ends have smaller shifts
            shift[self.slots(stream[starts + end - self.block], stream[starts + end - 1])] = length - end
        self.shift = array("B" if far < 256 else "I", shift.tobytes())
        last = self.suffixes(stream[starts + length - self.block], stream[starts + length - 1])
        order = np.argsort(last, kind="stable")
        self.starts, self.owners = starts[order].astype(np.int32), owners[order].astype(np.int32)
        self.keys, first = np.unique(last[order], return_index=True)
        self.bounds = np.append(first, len(order)).astype(np.int32)
        # Which first and last blocks go together, by hash: what isn't marked needs no comparison.
        self.few = (1 << max(8, int(starts.size * 8).bit_length())) - 1
        marks = np.zeros(self.few + 1, dtype=np.uint8)
        if length >= 4:
            marks[self.ends(*(stream[starts + k] for k in (0, 1, length - 2, length - 1)))] = 1
        self.marks = marks.tobytes()

    def slots(self, first, second):
        return (first * MIX + second) & self.mask if self.block == 2 else second & self.mask

    def ends(self, a, b, c, d):
        return ((a * MIX + b) & self.few) ^ (((c * MIX + d) & self.few) * 31 & self.few)

    def suffixes(self, first, second):
        return first * self.n_words + second if self.block == 2 else second

    def find(self, words: list[int]) -> Iterator[tuple[int, np.ndarray]]:
        """(start, owners) of every occurrence, in order. Words that the benchmark doesn't hold are below zero."""
        at, n, length, mask, shift, two = self.length, len(words), self.length, self.mask, self.shift, self.block == 2
        few, marks = self.few, self.marks if self.length >= 4 else None
        whole = None
        while at <= n:
            last = words[at - 1]
            if last < 0:
                at += length
                continue
            before = words[at - 2] if two else 0
            if before < 0:
                at += length - 1
                continue
            jump = shift[(before * MIX + last) & mask if two else last & mask]
            if jump:
                at += jump
                continue
            if marks:
                first, second = words[at - length], words[at - length + 1]
                if first < 0 or second < 0 or not marks[((first * MIX + second) & few) ^ (((before * MIX + last) & few) * 31 & few)]:
                    at += 1
                    continue
            whole = np.asarray(words, dtype=np.int64) if whole is None else whole
            owners = self.confirmed(whole[at - length : at])
            if len(owners):
                yield at - length, owners
            at += 1

    def confirmed(self, candidate: np.ndarray) -> np.ndarray:
        """The owners of the windows that equal `candidate`, compared word by word in the bucket of its last block."""
        key = self.suffixes(candidate[-self.block], candidate[-1])
        k = np.searchsorted(self.keys, key)
        if k == len(self.keys) or self.keys[k] != key:
            return self.owners[:0]
        low, high = self.bounds[k], self.bounds[k + 1]
        same = np.arange(low, high)
        for place in range(self.length):
            same = same[self.stream[self.starts[same] + place] == candidate[place]]
        return self.owners[same]


class Benchmark:
    """The search tables of some benchmark items."""

    def __init__(self, items: list[tuple[int, bytes]], window: int = WINDOW):
        self.code: dict[bytes, int] = {}
        lists = [[self.code.setdefault(w, len(self.code)) for w in split_words(text)] for _, text in items]
        sizes = np.asarray([len(words) for words in lists], dtype=np.int64)
        stream = np.fromiter((w for words in lists for w in words), dtype=np.int64, count=int(sizes.sum()))
        begins = np.cumsum(sizes) - sizes
        self.ids = np.asarray([item for item, _ in items], dtype=np.int64)
        self.searches = []
        for length in np.unique(np.minimum(sizes[sizes > 0], window)).tolist():
            own = np.flatnonzero(np.minimum(sizes, window) == length)
            each = sizes[own] - length + 1
            starts = np.repeat(begins[own] - (np.cumsum(each) - each), each) + np.arange(each.sum())
            self.searches.append(WuManber(stream, starts, np.repeat(own, each), length, max(len(self.code), 1)))

    def search(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Merged word spans (start, end) that windows cover, and the items whose windows occur."""
        spans, owners, get = [], [], self.code.get
        known = [get(w, -1) for w in words]
        for search in self.searches:
            for start, found in search.find(known):
                spans.append((start, start + search.length))
                owners.append(found)
        return merged(spans), set(self.ids[np.unique(np.concatenate(owners))].tolist()) if owners else set()


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


FOUND = "doc_id long, n_words long, spans array<struct<start:int,end:int>>, items array<long>, text_sha256 string"


def items_of(benchmark: DataFrame) -> DataFrame:
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").cast("binary").alias("text"))
    return items.where("item_id is not null and text is not null")


def n_blocks(benchmark: DataFrame, block_bytes: int) -> int:
    size = items_of(benchmark).agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    return max(1, math.ceil(size / block_bytes))


def blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[list[tuple[int, bytes]]]:
    """The items in blocks of about `block_bytes`: one of them is on the driver at a time."""
    items, n = items_of(benchmark), n_blocks(benchmark, block_bytes)
    for k in range(n):
        part = items if n == 1 else items.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == k)
        yield [(r.item_id, bytes(r.text)) for r in part.toLocalIterator()]


def find_hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, spans (merged, in words) and items found of every document row."""
    docs, parts = id_and_text(docs), []
    several = n_blocks(benchmark, block_bytes) > 1
    for items in blocks(benchmark, block_bytes):
        sent = docs.sparkSession.sparkContext.broadcast(Benchmark(items, window))

        def work(batch: pa.RecordBatch, sent=sent) -> pa.RecordBatch:
            own = sent.value
            rows = [(split_words(t), hashlib.sha256(t).hexdigest()) for t in text_bytes(batch)]
            found = [own.search(words) for words, _ in rows]
            return pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([len(words) for words, _ in rows], pa.int64()),
                    pa.array([[{"start": a, "end": b} for a, b in spans] for spans, _ in found], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
                    pa.array([sorted(items) for _, items in found], pa.list_(pa.int64())),
                    pa.array([digest for _, digest in rows], pa.string()),
                ],
                ["doc_id", "n_words", "spans", "items", "text_sha256"],
            )

        found = map_batches(docs, work, FOUND)
        parts.append(write_cut(found) if several else found)
        if several:
            sent.destroy()
    if not several:
        return parts[0]
    # Equal rows (same id and text) are put together with the number of their copies, and dealt out again.
    together = parts[0]
    for part in parts[1:]:
        together = together.unionByName(part)
    return (
        together.groupBy("doc_id", "text_sha256")
        .agg(
            F.first("n_words").alias("n_words"),
            F.flatten(F.collect_list("spans")).alias("spans"),
            F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"),
            (F.count(F.lit(1)) / F.lit(len(parts))).cast("int").alias("copies"),
        )
        .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
        .select("doc_id", "n_words", "spans", "items", "text_sha256")
    )


def covered(spans) -> F.Column:
    """Words that the spans cover, overlaps counted once."""
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))

    def step(acc, span):
        start = F.greatest(acc["end"], span["start"])
        end = F.greatest(acc["end"], span["end"])
        return F.struct(end.alias("end"), (acc["n"] + F.greatest(span["end"] - start, F.lit(0))).alias("n"))

    return F.aggregate(F.array_sort(spans), zero, step, lambda acc: acc["n"])


def report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every document row."""
    names = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    hits = find_hits(docs, benchmark, window, block_bytes)
    return hits.select(
        "doc_id", "n_words", covered(F.col("spans")).alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(names, 256).alias("items_sha256")
    ).withColumn("contaminated", F.col("n_hit") > 0)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of `docs`, all columns, in which no window of the benchmark occurs. Filters in place: nothing is shuffled. Of
    several blocks each writes what it leaves for the next."""
    several, before = n_blocks(benchmark, block_bytes) > 1, None
    for items in blocks(benchmark, block_bytes):
        sent = docs.sparkSession.sparkContext.broadcast(Benchmark(items, window))

        def work(batch: pa.RecordBatch, sent=sent) -> pa.RecordBatch:
            own = sent.value
            return batch.filter(pa.array([not own.search(split_words(t))[0] for t in text_bytes(batch)], pa.bool_()))

        docs = map_batches(docs, work, docs.schema)
        if several:
            docs = write_cut(docs)
            sent.destroy()
            if before is not None:
                release(before)
            before = docs
    return docs


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS t FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS t FROM benchmark),
p AS (SELECT DISTINCT item_id, least(10, len(t)) AS size, array_to_string(t[k:k + least(10, len(t)) - 1], ' ') AS g FROM b, unnest(range(1, len(t) - least(10, len(t)) + 2)) AS u(k) WHERE len(t) > 0),
w AS (SELECT doc_id, k, size, array_to_string(t[k:k + size - 1], ' ') AS g FROM d, (SELECT DISTINCT size FROM p) s, unnest(range(1, len(t) - size + 2)) AS u(k)),
h AS (SELECT doc_id, item_id, k, size FROM w JOIN p USING (size, g)),
n AS (SELECT doc_id, count(DISTINCT k + e) AS n_hit FROM h, unnest(range(0, size)) AS v(e) GROUP BY doc_id),
i AS (SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS names FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(t) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN i USING (doc_id)
"""

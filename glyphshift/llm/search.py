"""Ranked lexical search of many items at once: shared parts of the items are summed up once.

Terms that stand in the same items, equally often in each, are one leaf. The leaves of every item are put in one order, and
pairs of neighbours that several items share are joined into nodes, again and again, until no pair is shared: items then stand
above a graph in which every node is the sum of two. For a slice of documents, each term's weighted value is added to its leaf,
a node's accumulator is made once of those of its two parts, and an item's score is the sum of the few nodes left in it.

The items are the stated query set. They are worked on in blocks of at most `block_bytes` of text, of which one at a time is
broadcast. Two passes over the documents follow: whole counts (documents, terms, and documents that hold a term of the items),
then scores. A task keeps its 20 best documents of each item, and those of all tasks are ranked in two steps, so that no
document is shuffled.

A null or empty text has no terms and is no document of the count; a null or empty item, or one without scores above 0, has
no rows. Items are distinct rows of item_id and text: of several texts under one id each has its own ranking. Repeated document
rows are ranked each, null ids behind others of the same score. Further columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glyphshift.llm._shared import id_and_text, release, slices, text_bytes, write_cut
from glyphshift.llm.decontaminate import split_words

TOP = 20
#: Bytes of items that are searched, and so broadcast, at a time.
BLOCK_BYTES = 1_000_000
#: Numbers that the accumulators of a slice of documents may hold.
CELLS = 4_000_000
#: Tasks' best documents are ranked in so many groups first.
GROUPS = 256
LAST = 2**63 - 1


class Plan:
    """The graph over some items. `leaf_of` has each term's leaf; levels are (first node, left parts, right parts); `tops` are
    the (item, node, times) left above it."""

    def __init__(self, items: list[bytes]):
        self.n_items = len(items)
        held = defaultdict(list)
        for k, text in enumerate(items):
            for term, times in Counter(split_words(text)).items():
                held[term].append((k, times))
        leaves: dict[tuple, int] = {}
        self.leaf_of = {term: leaves.setdefault(tuple(where), len(leaves)) for term, where in sorted(held.items())}
        self.n_leaves = self.n_nodes = len(leaves)
        # An item's parts are (node, times); the most shared leaves come first, so that neighbours are shared.
        parts: list[list[tuple[int, int]]] = [[] for _ in items]
        for where, leaf in sorted(leaves.items(), key=lambda x: (-len(x[0]), x[1])):
            for k, times in where:
                parts[k].append((leaf, times))
        self.levels: list[tuple[int, np.ndarray, np.ndarray]] = []
        while pairs := self.shared_pairs(parts):
            first, made = self.n_nodes, {}
            parts = [self.joined(own, pairs, made) for own in parts]
            self.n_nodes += len(made)
            left, right = zip(*made)
            self.levels.append((first, np.asarray(left), np.asarray(right)))
        flat = [(k, node, times) for k, own in enumerate(parts) for node, times in own]
        self.tops = np.asarray(flat, dtype=np.int64).reshape(-1, 3)

    @staticmethod
    def shared_pairs(parts) -> dict[tuple[int, int], int]:
        """Neighbours, of the same number of times, that two items or more share."""
        seen = Counter((a, b) for own in parts for (a, m), (b, n) in zip(own, own[1:]) if m == n == 1)
        return {pair: n for pair, n in seen.items() if n > 1}

    def joined(self, own, pairs, made):
        """`own` with the most shared of its pairs as nodes: a pair gives way to the next if that is shared by more."""
        count = lambda k: pairs.get((own[k][0], own[k + 1][0]), 0) if k + 1 < len(own) and own[k][1] == own[k + 1][1] == 1 else 0
        out, k = [], 0
        while k < len(own):
            if count(k) and count(k) >= count(k + 1):
                pair = own[k][0], own[k + 1][0]
                out.append((made.setdefault(pair, self.n_nodes + len(made)), 1))
                k += 2
            else:
                out.append(own[k])
                k += 1
        return out

    def scores(self, doc: np.ndarray, leaf: np.ndarray, value: np.ndarray, n_docs: int) -> np.ndarray:
        """items x documents: the values (by document and leaf) summed up through the graph."""
        acc = np.zeros((self.n_nodes, n_docs), dtype=np.int64)
        np.add.at(acc, (leaf, doc), value)
        for first, left, right in self.levels:
            acc[first : first + len(left)] = acc[left] + acc[right]
        out = np.zeros((self.n_items, n_docs), dtype=np.int64)
        item, node, times = self.tops.T
        if len(item):
            starts = np.flatnonzero(np.r_[True, item[1:] != item[:-1]])
            step = max(1, CELLS // max(n_docs, 1))
            for a, b in runs_of(starts, len(item), step):
                own = starts[(starts >= a) & (starts < b)]
                out[item[own]] = np.add.reduceat(acc[node[a:b]] * times[a:b, None], own - a, axis=0)
        return out


def runs_of(starts: np.ndarray, n: int, step: int) -> Iterator[tuple[int, int]]:
    """Whole groups of places, about `step` at a time."""
    a = 0
    while a < n:
        later = starts[starts >= a + step]
        b = int(later[0]) if len(later) else n
        yield a, b
        a = b


def items_of(benchmark: DataFrame) -> DataFrame:
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    return items.where("text is not null").distinct()


def blocks(items: DataFrame, block_bytes: int) -> Iterator[list[tuple[int, bytes]]]:
    """The items in blocks of about `block_bytes`: one of them is on the driver at a time."""
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = max(1, math.ceil(size / block_bytes))
    for k in range(n):
        part = items if n == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        yield sorted(((r.item_id, r.text.encode()) for r in part.toLocalIterator()), key=lambda x: (x[0] is None, x[0] or 0, x[1]))


def counts(docs: DataFrame, terms: list[bytes]) -> tuple[int, int, dict[bytes, int]]:
    """N, L, and df of the terms. Every task counts its own rows first."""
    sent = docs.sparkSession.sparkContext.broadcast(frozenset(terms))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, n, size, df = sent.value, 0, 0, Counter()
        for batch in batches:
            for text in text_bytes(batch):
                words = split_words(text)
                if words:
                    n, size = n + 1, size + len(words)
                    df.update(wanted.intersection(words))
        names = [None, *df]
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array([n, *df.values()], pa.int64()), pa.array([size] + [0] * len(df), pa.int64())], ["term", "df", "size"])

    found = docs.select("text").mapInArrow(run, "term binary, df long, size long").groupBy("term").agg(F.sum("df").alias("df"), F.sum("size").alias("size")).collect()
    sent.destroy()
    whole = next(((r.df, r["size"]) for r in found if r.term is None), (0, 0))
    return *whole, {bytes(r.term): r.df for r in found if r.term is not None}


def weight(n: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


def best_of_task(docs: DataFrame, plan: Plan, ids: list[int], n: int, size: int, df: dict[bytes, int], top: int) -> DataFrame:
    """item, item_id, doc_id, score: of each partition the best documents of each item."""
    weights = {term: (leaf, weight(n, df[term])) for term, leaf in plan.leaf_of.items() if term in df}
    sent = docs.sparkSession.sparkContext.broadcast((plan, weights, ids))
    rows = max(1, CELLS // max(plan.n_nodes, plan.n_items, 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, known, names = sent.value
        kept: list[list[tuple[int, int]]] = [[] for _ in range(own.n_items)]
        for batch in slices(batches, rows, 4_000_000):
            doc, leaf, value = [], [], []
            for k, text in enumerate(text_bytes(batch)):
                words = split_words(text)
                if not words:
                    continue
                norm = 12 * (75 + (25 * len(words) * n) // size)
                held = Counter(words)
                for term in known.keys() & held.keys():
                    where, w = known[term]
                    tf = 1000 * held[term]
                    doc.append(k)
                    leaf.append(where)
                    value.append(w * ((1_000_000 * tf) // (tf + norm)))
            if not doc:
                continue
            made = own.scores(np.asarray(doc), np.asarray(leaf), np.asarray(value, dtype=np.int64), batch.num_rows)
            doc_ids = [LAST if d is None else d for d in batch.column("doc_id").to_pylist()]
            few = min(top, batch.num_rows)
            least = np.partition(made, batch.num_rows - few, axis=1)[:, batch.num_rows - few]
            floor = np.asarray([heap[0][0] if len(heap) == top else 1 for heap in kept])
            item, at = np.nonzero((made >= np.maximum(least, 1)[:, None]) & (made >= floor[:, None]))
            for i, k, score in zip(item.tolist(), at.tolist(), made[item, at].tolist()):
                entry = (score, -doc_ids[k])
                if len(kept[i]) < top:
                    heapq.heappush(kept[i], entry)
                elif entry > kept[i][0]:
                    heapq.heapreplace(kept[i], entry)
        for start in range(0, own.n_items, 1_000):
            flat = [(i, names[i], None if d == -LAST else -d, s) for i in range(start, min(start + 1_000, own.n_items)) for s, d in kept[i]]
            if flat:
                item, item_id, doc_id, score = zip(*flat)
                yield pa.RecordBatch.from_arrays([pa.array(item, pa.int64()), pa.array(item_id, pa.int64()), pa.array(doc_id, pa.int64()), pa.array(score, pa.int64())], ["item", "item_id", "doc_id", "score"])

    return docs.mapInArrow(run, "item long, item_id long, doc_id long, score long")


def ranked(best: DataFrame, top: int) -> DataFrame:
    """The best of all tasks: first in groups of tasks, so that no item's rows are one task's."""
    order = (F.desc("score"), F.asc_nulls_last("doc_id"))
    grouped = best.withColumn("part", F.pmod(F.spark_partition_id(), F.lit(GROUPS)))
    near = grouped.withColumn("rank", F.row_number().over(Window.partitionBy("item", "part").orderBy(*order))).where(F.col("rank") <= top)
    return near.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= top).select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, benchmark: DataFrame, top: int = TOP, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """item_id, rank, doc_id, score: each item's best documents."""
    spark, docs, parts = docs.sparkSession, id_and_text(docs), []
    none = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for items in blocks(items_of(benchmark), block_bytes):
        plan = Plan([text for _, text in items])
        if not plan.leaf_of:
            continue
        n, size, df = counts(docs, list(plan.leaf_of))
        if n:
            best = write_cut(best_of_task(docs, plan, [i for i, _ in items], n, size, df, top))
            parts.append(write_cut(ranked(best, top)))
            release(best)
    return none if not parts else reduced(parts)


def reduced(parts: list[DataFrame]) -> DataFrame:
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    return every


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents),
s AS (SELECT count(*) AS n, sum(len(t))::BIGINT AS l FROM d WHERE len(t) > 0),
q AS (SELECT item_id, text, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM (SELECT DISTINCT item_id, text FROM benchmark WHERE text IS NOT NULL)),
qn AS (SELECT item_id, text, term, count(*) AS times FROM q GROUP BY ALL),
p AS (SELECT r, doc_id, len AS m, term, count(*) AS tf FROM (SELECT r, doc_id, len(t) AS len, unnest(t) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
v AS (SELECT p.r, p.doc_id, p.term, floor(1000 * ln((2 * n + 2)::DOUBLE / (2 * df + 1)))::BIGINT * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * m * n) // l))) AS v FROM p JOIN f USING (term), s),
x AS (SELECT item_id, text, r, doc_id, sum(times * v)::BIGINT AS score FROM qn JOIN v USING (term) GROUP BY ALL)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id, text ORDER BY score DESC, doc_id) AS rank FROM x WHERE score > 0) WHERE rank <= 20
"""

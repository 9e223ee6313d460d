"""SimHash near-duplicates: fingerprints, pivot distance tables, verification, components.

Equal fingerprints are put together first. Two fingerprints within three bits agree on at least two of five blocks of
bits, so each fingerprint is dealt to ten buckets, one for each pair of blocks, and no link is lost. In a bucket, the
distances to many fixed reference fingerprints (pivots) are tabulated once. They differ by no more than the distance of the
two fingerprints, so a bucket is put in order of the distances to one pivot, of a large bucket to that which leaves the fewest
pairs, and a pair is enumerated only if it stands within three there. Of these, a pair with any coordinate that differs by more
than three is discarded, and only survivors are verified. A bucket hands on links that join what was apart (a forest), never
all of its pairs.

Buckets above `chunk` fingerprints are split into chunks, and each pair of chunks is compared in a group of its own, so no
group holds more than two chunks, and all pairs are still judged. Very common fingerprints and very large buckets meet a
bounded broadcast table where they lie.

A null or empty text has fingerprint zero and is linked like any other. Repeated rows get a row each. A row without an id
is fingerprinted and links others, but is no smallest id; where a group has no id at all, component_id is null. Further
columns, whatever their names, are ignored or passed on.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphshift.llm._shared import hot_limit, id_and_text, join_back, map_batches, release, text_bytes, write_cut
from glyphshift.llm.components import components

SHINGLE = 3
DISTANCE = 3
#: Fingerprints of a bucket that are compared in one group; larger buckets are split.
CHUNK = 2048
#: Bits of the five blocks, from the lowest.
BLOCKS = (13, 13, 13, 13, 12)
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Reference fingerprints, from a rule.
PIVOTS = np.asarray([xxhash.xxh64_intdigest(f"pivot {i}") for i in range(16)], dtype=np.uint64)


def fingerprint(text: bytes, size: int = SHINGLE) -> int:
    """The signed 64-bit fingerprint of a UTF-8 text."""
    words = text.translate(LOWER).split()
    if not words:
        return 0
    shingles = list(map(b" ".join, zip(*(words[k:] for k in range(size))))) or [b" ".join(words)]
    hashes = np.frombuffer(b"".join([xxhash.xxh64_digest(s, 42) for s in shingles]), dtype=np.uint8).reshape(-1, 8)
    ones = np.zeros(64, dtype=np.int64)
    for start in range(0, len(hashes), 65536):
        ones += np.unpackbits(hashes[start : start + 65536], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes)).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """doc_id and fp of every document row."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([fingerprint(t, size) for t in text_bytes(batch)], pa.int64())], ["doc_id", "fp"])

    return map_batches(id_and_text(docs), work, "doc_id long, fp long")


def bucket_keys(fp: str = "fp"):
    """The buckets of a fingerprint: (pair of blocks, their bits) as one long."""
    starts = np.cumsum((0, *BLOCKS[:-1])).tolist()
    block = [F.shiftrightunsigned(F.col(fp), s).bitwiseAND((1 << n) - 1) for s, n in zip(starts, BLOCKS)]
    return F.array(*(F.lit(k).cast("long") * (1 << 26) + block[i] * (1 << 13) + block[j] for k, (i, j) in enumerate(combinations(range(len(BLOCKS)), 2))))


def pivot_table(fps: np.ndarray) -> np.ndarray:
    return np.bitwise_count(fps[:, None] ^ PIVOTS[None, :]).astype(np.int8)


#: Fingerprints from which on a group is ordered by a pivot of its own.
LARGE = 64


def best_pivot(table: np.ndarray, distance: int) -> int:
    """The pivot at which the fewest pairs stand within `distance`."""
    counts = np.stack([np.bincount(column, minlength=65) for column in table.T]).astype(np.float64)
    upto = np.cumsum(counts, axis=1)
    near = upto[:, np.minimum(np.arange(65) + distance, 64)] - upto
    return int(np.argmin((counts * (counts - 1) / 2 + counts * near).sum(axis=1)))


def group_links(group: np.ndarray, fps: np.ndarray, distance: int = DISTANCE) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Places of linked fingerprints, a forest for each group; and the pairs that are all of the groups', were enumerated,
    passed the pivots, and were verified. `group` is sorted; in its pivot's order, pairs are compared at growing offsets."""
    n, table = len(fps), pivot_table(fps)
    _, first, size = np.unique(group, return_index=True, return_counts=True)
    by = np.zeros(n, dtype=np.int64)
    for start, many in zip(first[size > LARGE], size[size > LARGE]):
        by[start : start + many] = best_pivot(table[start : start + many], distance)
    order = np.lexsort((table[np.arange(n), by], group))
    fps, table = fps[order], table[order]
    line = table[np.arange(n), by[order]]
    left = np.repeat(size, size) - (np.arange(n) - np.repeat(first, size))  # places from here to the end of the group
    root, out = np.arange(n), []
    counts = np.asarray([(size * (size - 1) // 2).sum(), 0, 0, 0], dtype=np.int64)
    at, offset = np.arange(n), 1
    while len(at := at[left[at] > offset]) and len(at := at[line[at + offset] - line[at] <= distance]):
        i = at[root[at] != root[at + offset]]
        counts[1] += len(i)
        i = i[np.abs(table[i] - table[i + offset]).max(axis=1, initial=0) <= distance]
        counts[2] += len(i)
        i = i[np.bitwise_count(fps[i] ^ fps[i + offset]) <= distance]
        counts[3] += len(i)
        for a in i.tolist():
            low, high = sorted((find(root, a), find(root, a + offset)))
            if low != high:
                root[high] = low
                out.append((int(order[a]), int(order[a + offset])))
        if len(i):
            while (root != (root := root[root])).any():
                pass
        offset += 1
    return out, counts


def find(root: np.ndarray, i: int) -> int:
    while root[i] != i:
        i = root[i]
    return i


def bucket_groups(distinct: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """fp, bucket, low, high: the groups in which the distinct fingerprints `fp` are compared, each sorted in one partition."""
    dealt = distinct.select("fp", F.explode(bucket_keys()).alias("bucket"))
    sizes = write_cut(dealt.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1").withColumns({"members": F.col("n"), "use": F.lit(True)}))
    total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    members = join_back(dealt, sizes, ["bucket"], hot_limit(total)).withColumn("chunks", F.ceil(F.col("members") / chunk).cast("int"))
    own = F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda k: F.struct(F.least(own, k).alias("low"), F.greatest(own, k).alias("high")))
    groups = members.select("fp", "bucket", F.explode(pairs).alias("pair")).select("fp", "bucket", "pair.low", "pair.high")
    return groups.repartition("bucket", "low", "high").sortWithinPartitions("bucket", "low", "high", "fp")


def links(distinct: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(a, b): enough links between the distinct fingerprints `fp` that all components come out; and a row with neither for
    each batch of groups: all pairs of its groups, those enumerated, those that passed the pivots, and those verified."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in chain_end(batches):
            if batch is None:
                ready, held = held, None
            else:
                both = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
                codes = group_codes(both)
                last = int(np.searchsorted(codes, codes[-1]))
                ready, held = both.slice(0, last), both.slice(last)
            if ready is None or not ready.num_rows:
                continue
            fps = ready.column("fp").to_numpy()
            found, counts = group_links(group_codes(ready), fps.view(np.uint64))
            a, b = np.asarray(found, dtype=np.int64).reshape(-1, 2).T
            none = pa.nulls(len(found), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(fps[a]), pa.array(fps[b]), none, none, none, none], COUNTED)
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), *(pa.array([c]) for c in counts.tolist())], COUNTED)

    return bucket_groups(distinct, chunk).mapInArrow(work, ", ".join(f"{n} long" for n in COUNTED))


COUNTED = ["a", "b", "pairs", "enumerated", "passed", "verified"]


def pair_counts(docs: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """One row: all pairs in the buckets, those enumerated in the pivots' order, those that passed all pivots, those verified."""
    found = links(fingerprints(docs).select("fp").distinct(), chunk)
    return found.agg(*(F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in COUNTED[2:]))


def chain_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    """The batches that have rows, and None at the end."""
    yield from (b for b in batches if b.num_rows)
    yield None


def group_codes(table: pa.Table) -> np.ndarray:
    """The number of each row's group, in order."""
    change = np.zeros(table.num_rows, dtype=bool)
    for name in ("bucket", "low", "high"):
        values = table.column(name).to_numpy()
        change[1:] |= values[1:] != values[:-1]
    return np.cumsum(change)


def classes(docs: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """doc_id, fp, component_id of every document row."""
    prints = write_cut(fingerprints(docs))
    distinct = write_cut(prints.groupBy("fp").agg(F.min("doc_id").alias("least_id"), F.count(F.lit(1)).alias("n")))
    found = components(links(distinct.select("fp"), chunk).where("a is not null").select("a", "b"))
    named = distinct.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least_id", "n", F.coalesce("least", "fp").alias("root"))
    ids = named.groupBy("root").agg(F.min("least_id").alias("component_id"))
    keyed = write_cut(named.join(ids, "root").select("fp", "component_id", "n", F.lit(True).alias("use")))
    total = prints.count()
    release(distinct, found)
    return join_back(prints, keyed, ["fp"], hot_limit(total)).select("doc_id", "fp", "component_id")


def report(docs: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """doc_id, fingerprint (16 lower-case hex digits), component_id of every document row."""
    return classes(docs, chunk).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """`docs`, all columns: of each component the document with the smallest id. Rows without an id, and repeated
    rows of the id that stays, stay."""
    gone = classes(docs, chunk).where("doc_id != component_id").select(F.col("doc_id").alias("gone_id")).distinct()
    own = docs.select(F.col("doc_id").cast("long").alias("own_id"), F.struct(*(docs[n] for n in docs.columns)).alias("row"))
    return own.join(gone, F.col("own_id") == F.col("gone_id"), "left_anti").select("row.*")

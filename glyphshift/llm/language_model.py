"""Language-model scoring by a hierarchical Pitman-Yor model of words.

Each word is drawn in the restaurant of the word before it (or of the beginning of a text), and all these share one parent, the
restaurant of words without context, above equal chances for the V training tokens and one unknown one. A customer who opens a
table in a context is a customer of the parent. The seating is sampled by Gibbs: given its parent's probability and the tables
of the rest of its restaurant, the number of tables of a dish is drawn anew; all dishes of a level at once, from the state
before. It is drawn from its conditional distribution, by generalised Stirling numbers: exact ones up to `EXACT` customers, beyond
by a series or the saddle point of their generating function. A dish of one customer has one table. Discounts follow from the dishes with one and with two
customers, the concentration is a parameter. After `burn` rounds, the predictive probabilities of `samples` states are averaged,
word by word, and a text's score is the sum of their logarithms.

Texts are worked on in slices. A slice first learns its words' numbers from the buckets of their hashes. Then it asks for what is
known of its words and of its pairs of words: packed lists of sorted numbers, dealt by the number of the word or the hash of the pair, meet the counts or the seating there and bring the answers back to their slice, so that no row a token is
ever shuffled. In the same way the pairs, packed by the bucket of their hash, tell their words' buckets their tables in each round, and get
back the state of the parent and of their contexts. A hot word or pair is one number a bucket. All that the driver gets are
totals. The seating is written after each round.

Words are told apart by their 64-bit hash. A null or empty text is its end alone; rows with a null id are never held out and
are learned from; repeated rows are learned from and scored each; further columns are ignored; an empty table gives no rows. If
nothing is learned from, all tokens have the chance of the unknown one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphshift.llm._shared import id_and_text, release, slices, write_cut

BURN, SAMPLES, CONCENTRATION = 2, 3, 1.0
EXACT, GRID, TERMS = 256, 192, 64
#: Bytes of text of a slice, and bytes of text whose words or pairs are counted together.
SLICE_BYTES, BUCKET_BYTES = 6_000_000, 8_000_000
#: Marks that no word can be, as a word has no white space.
END, START = b"\n", b"\t"
DOCS, WORDS, PAIRS = 0, 1, 2
SMOOTHING = 0.1


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 10 == 0, F.lit(False))


# Packed numbers


def pack(values: np.ndarray) -> bytes:
    """How many numbers, their bytes each, and their first bytes, then their second bytes and so on, compressed. Whole numbers that
    aren't negative take only the bytes that the largest needs."""
    flat = np.ascontiguousarray(values).reshape(-1)
    if not len(flat):
        return (0).to_bytes(9, "little")
    if flat.dtype.kind in "iu" and flat.min() >= 0:
        flat = flat.astype(np.min_scalar_type(flat.max()))
    raw = flat.view(np.uint8).reshape(len(flat), -1).T.tobytes() if flat.itemsize > 1 else flat.tobytes()
    return len(flat).to_bytes(8, "little") + bytes([flat.itemsize]) + pa.compress(raw, codec="zstd", asbytes=True)


def packed_size(data: bytes) -> int:
    return int.from_bytes(data[:8], "little")


def unpack(data: bytes, kind) -> np.ndarray:
    n, width, kind = packed_size(data), data[8], np.dtype(kind)
    if not n:
        return np.empty(0, dtype=kind)
    raw = np.frombuffer(pa.decompress(data[9:], n * width, codec="zstd", asbytes=True), dtype=np.uint8)
    own = kind if width == kind.itemsize else np.dtype(f"u{width}")
    return np.ascontiguousarray(raw.reshape(width, n).T).view(own).reshape(-1).astype(kind, copy=False)


def pack_steps(values: np.ndarray) -> bytes:
    """Numbers that mostly grow, by their steps."""
    return pack(np.diff(values, prepend=0))


def unpack_steps(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data, np.int64))


def mixed(h: np.ndarray) -> np.ndarray:
    """Spreads 64-bit numbers."""
    h = h.astype(np.uint64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    return h ^ (h >> np.uint64(31))


def pair_key(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return mixed(mixed(first.view(np.uint64)) + second.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def bucket_of(key: np.ndarray, buckets: int) -> np.ndarray:
    return (mixed(key.view(np.uint64)) % np.uint64(buckets)).astype(np.int64)


# Slices


def gathered(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.Table]:
    """Batches in slices of about `size` bytes, across the borders of batches."""
    held, n = [], 0
    for batch in slices(batches, 1 << 30, size):
        held.append(batch)
        n += batch.nbytes
        if n >= size:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if held:
        yield pa.Table.from_batches(held)


class Slice:
    """The tokens of some texts: `names` of the distinct words, the end and the beginning (their hashes, and once they are numbered
    their numbers, in order but for the last two); each token's and its context's place therein; each token's text."""

    def __init__(self, texts: pa.Array):
        split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
        flat = split.flatten()
        full = pc.not_equal(flat, "")
        owner = np.repeat(np.arange(len(split)), pc.list_value_length(split).to_numpy())[full.to_numpy(zero_copy_only=False)]
        known = flat.filter(full).dictionary_encode()
        words = known.dictionary.to_pylist()
        self.names = np.asarray([xxhash.xxh64_intdigest(w) for w in (*words, END, START)], dtype=np.uint64).view(np.int64)
        self.sizes = np.bincount(owner, minlength=len(split)).astype(np.int64) + 1
        self.place(known.indices.to_numpy())

    def place(self, codes: np.ndarray) -> None:
        """`codes` of the words, without ends, in order."""
        end, start = len(self.names) - 2, len(self.names) - 1
        last = np.cumsum(self.sizes) - 1
        self.doc = np.repeat(np.arange(len(self.sizes), dtype=np.int32), self.sizes)
        self.token = np.full(len(self.doc), end, dtype=np.int32)
        inner = np.ones(len(self.doc), dtype=bool)
        inner[last] = False
        self.token[inner] = codes
        self.context = np.roll(self.token, 1)
        self.context[:1] = start
        self.context[last[:-1] + 1] = start

    def pair_up(self) -> None:
        """The distinct pairs of contexts and tokens, and each token's place among them."""
        n = len(self.names)
        pairs, self.pair = np.unique(self.context.astype(np.int64) * n + self.token, return_inverse=True)
        self.first, self.second = pairs // n, pairs % n

    def codes(self) -> np.ndarray:
        return self.token[self.token != len(self.names) - 2]

    def pair_buckets(self, buckets: int) -> np.ndarray:
        return bucket_of(pair_key(self.names[self.first], self.names[self.second]), buckets)

    def learned(self, held: list[bool]) -> np.ndarray:
        """1 for each token of a training text."""
        return (~np.asarray(held, dtype=bool))[self.doc].astype(np.float64)

    @classmethod
    def packed(cls, data: list[bytes]) -> Slice:
        own = cls.__new__(cls)
        own.names, own.sizes = unpack_steps(data[0]), unpack(data[1], np.int64)
        own.place(unpack(data[2], np.int32))
        return own


def by_bucket(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each bucket with the places of its members, in order."""
    if len(bucket) and bucket.max() < 1 << 16:
        bucket = bucket.astype(np.uint16)  # sorted by digits
    order = np.argsort(bucket, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1):
        if len(part):
            yield int(bucket[part[0]]), part


def distinct(values: np.ndarray, bound: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values, which are below `bound`, in order, and each one's place among them: by marks if there are many of them."""
    if len(values) * 32 < bound:
        return np.unique(values, return_inverse=True)
    there = np.zeros(bound, dtype=bool)
    there[values] = True
    names = np.flatnonzero(there)
    place = np.empty(bound, dtype=np.int64)
    place[names] = np.arange(len(names))
    return names, place[values]


REQUESTS = "slice long, kind int, bucket long, ids array<long>, held array<boolean>, data array<binary>"


def request_table(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [[]] * 6
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.binary()))
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["slice", "kind", "bucket", "ids", "held", "data"])


def requests(docs: DataFrame, buckets: int, slice_bytes: int) -> DataFrame:
    """Of each slice its texts, as places of words with their buckets, and the words that it asks for, with how often each stands in
    training texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        for table in gathered(batches, slice_bytes):
            own = Slice(table.column("text").combine_chunks())
            held = table.column("held").to_pylist()
            dealt = bucket_of(own.names, buckets)
            rows = [(number, DOCS, 0, table.column("doc_id").to_pylist(), held, [pack(dealt.astype(np.int32)), pack(own.sizes), pack(own.codes())])]
            n = np.bincount(own.token, weights=own.learned(held), minlength=len(own.names)).astype(np.int64)
            rows += [(number, WORDS, bucket, None, None, [pack(own.names[at]), pack(n[at])]) for bucket, at in by_bucket(dealt)]
            number += 1
            yield request_table(rows)

    return docs.select("doc_id", "text", held_out().alias("held")).mapInArrow(run, REQUESTS)


def numbered(asked: DataFrame, words: DataFrame, buckets: int) -> DataFrame:
    """Of each slice its texts with the numbers of their words. A word's number is its place in its bucket times the buckets, and
    its bucket: neighbours in a sorted list are told in a byte, a hash takes eight."""

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.Table.from_batches([request_table([])])
        number, ids, held, data = (left.column(name)[0].as_py() for name in ("slice", "ids", "held", "data"))
        dealt, codes = unpack(data[0], np.int32), unpack(data[2], np.int32)
        told, names = dict(zip(right.column("source").to_pylist(), data_of(right))), np.empty(len(dealt), dtype=np.int64)
        for bucket, at in by_bucket(dealt):
            names[at] = unpack(told[bucket][0], np.uint32).astype(np.int64) * buckets + bucket
        order = np.argsort(names[:-2])
        place = np.empty(len(order), dtype=np.int32)
        place[order] = np.arange(len(order), dtype=np.int32)
        names = np.concatenate([names[order], names[-2:]])
        return pa.Table.from_batches([request_table([(number, DOCS, 0, ids, held, [pack_steps(names), data[1], pack(place[codes])])])])

    texts = asked.where(F.col("kind") == DOCS).groupBy("slice")
    return texts.cogroup(by_kind(words, NUMBERS)).applyInArrow(work, REQUESTS)


def word_requests(docs: DataFrame, buckets: int) -> DataFrame:
    """Of each slice its words' places in their buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                names = unpack_steps(batch.column("data")[k].as_py()[0])
                yield request_table([(batch.column("slice")[k].as_py(), WORDS, bucket, None, None, [pack_steps(names[at] // buckets)]) for bucket, at in by_bucket(names % buckets)])

    return docs.select("slice", "data").mapInArrow(run, REQUESTS)


def pair_requests(docs: DataFrame, buckets: int) -> DataFrame:
    """Of each slice the pairs that it asks for, with how often each stands in training texts, made anew from its places of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                number, held, data = (batch.column(name)[k].as_py() for name in ("slice", "held", "data"))
                own, rows = Slice.packed(data), []
                own.pair_up()
                n = np.bincount(own.pair, weights=own.learned(held), minlength=len(own.first)).astype(np.int64)
                for bucket, at in by_bucket(own.pair_buckets(buckets)):
                    # In order of their contexts, whose places are told by their steps.
                    names, place = distinct(np.concatenate([own.first[at], own.second[at]]), len(own.names))
                    steps = np.diff(place[: len(at)], prepend=0)
                    rows.append((number, PAIRS, bucket, None, None, [pack_steps(own.names[names]), pack(steps.astype(np.uint32)), pack(place[len(at) :].astype(np.uint32)), pack(n[at])]))
                yield request_table(rows)
                del own, rows, n
                pa.default_memory_pool().release_unused()

    return docs.select("slice", "held", "data").mapInArrow(run, REQUESTS)


# Counts


def asked_words(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, training counts and the row of every word that the rows of `table` ask for."""
    data = [(unpack(d[0], np.int64), unpack(d[1], np.int64)) for d in table.column("data").to_pylist()]
    owner = np.repeat(np.arange(len(data)), [len(h) for h, _ in data])
    return np.concatenate([h for h, _ in data]), np.concatenate([n for _, n in data]), owner


def asked_pairs(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Contexts, words, training counts and the row of every pair that the rows of `table` ask for."""
    sizes = [packed_size(d[3]) for d in table.column("data").to_pylist()]
    first, second, counts = (np.empty(sum(sizes), dtype=np.int64) for _ in range(3))
    for k, at in enumerate(np.cumsum(sizes) - sizes):
        d, part = table.column("data")[k].as_py(), slice(at, at + sizes[k])
        names = unpack_steps(d[0])
        counts[part] = unpack(d[3], np.int64)
        first[part] = names[np.cumsum(unpack(d[1], np.uint32))]
        second[part] = names[unpack(d[2], np.uint32)]
    return first, second, counts, np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)


def summed(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, a place of each, all keys' places among them, and the sums of n."""
    order = np.argsort(key)
    new = np.diff(key[order], prepend=0) != 0
    new[:1] = True
    place = np.empty(len(key), dtype=np.int64)
    place[order] = np.cumsum(new) - 1
    at = order[new]
    keys = key[at]
    return keys, at, place, np.bincount(place, weights=n, minlength=len(keys)).astype(np.int64)


#: Rows between words (nodes) and pairs, dealt by bucket: where they come from, whole numbers to be added up, and packed numbers.
ROW = "source long, kind int, bucket long, a long, b long, one long, two long, data array<binary>"
NODE, PAIR, ASKED, ANSWER, NUMBERS = range(5)


def row_table(rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows)) or [[]] * 8
    kinds = (pa.int64(), pa.int32(), *[pa.int64()] * 5, pa.list_(pa.binary()))
    return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], ["source", "kind", "bucket", "a", "b", "one", "two", "data"])


def data_of(table: pa.Table) -> list[list[bytes]]:
    return table.column("data").to_pylist()


def numbers(data: list[bytes]) -> list[np.ndarray]:
    return [unpack(d, np.int64) for d in data]


def pair_numbers(data: list[bytes]) -> list[np.ndarray]:
    return [unpack_steps(data[0]), *numbers(data[1:])]


def by_kind(rows: DataFrame, kind: int):
    return rows.where(F.col("kind") == kind).groupBy("bucket")


def count_words(asked: DataFrame) -> DataFrame:
    """A row a bucket: its distinct words, how often each stands in training texts, and their sums; and for each slice its words'
    places among them."""

    def work(table: pa.Table) -> pa.Table:
        h, n, owner = asked_words(table)
        keys, _, place, c = summed(h, n)
        bucket, slices_ = table.column("bucket")[0].as_py(), table.column("slice").to_pylist()
        told = [(bucket, NUMBERS, s, 0, 0, 0, 0, [pack(place[a:b].astype(np.uint32))]) for s, (a, b) in zip(slices_, parts_of(owner, len(slices_)))]
        return row_table([(bucket, NODE, bucket, int(c.sum()), int((c > 0).sum()), 0, 0, [pack(keys), pack(c)]), *told])

    return by_kind(asked, WORDS).applyInArrow(work, ROW)


def asks(source: int, buckets: int, names: np.ndarray, *values: np.ndarray) -> list[tuple]:
    """Rows that ask the buckets of `names`, by their places there, and tell `values`."""
    return [(source, ASKED, bucket, 0, 0, 0, 0, [pack_steps(names[at] // buckets), *(pack(v[at].astype(np.int64)) for v in values)]) for bucket, at in by_bucket(names % buckets)]


def told(first: np.ndarray, second: np.ndarray, tables: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The tables in each name's own restaurant, and those that are its customers in the parent."""
    return np.bincount(first, weights=tables, minlength=n), np.bincount(second, weights=tables, minlength=n)


def count_pairs(docs: DataFrame, buckets: int) -> DataFrame:
    """Of each bucket the pairs that stand twice or more in training texts, with one table each, and what all its pairs tell their
    words: those that stand once have one table for ever, and aren't looked at again."""

    def work(table: pa.Table) -> pa.Table:
        u, w, n, _ = asked_pairs(table)
        _, at, _, c = summed(pair_key(u, w), n)
        at, c = at[c > 0], c[c > 0]
        names, place = np.unique(np.concatenate([u[at], w[at]]), return_inverse=True)
        first, second = place[: len(at)], place[len(at) :]
        one, many = c == 1, np.flatnonzero(c > 1)
        once = told(first[one], second[one], np.ones(one.sum()), len(names))
        bucket, ones = table.column("bucket")[0].as_py(), np.ones(len(many), dtype=np.int64)
        kept, place = np.unique(np.concatenate([first[many], second[many]]), return_inverse=True)
        first, second = place[: len(many)], place[len(many) :]
        pair = [pack_steps(names[kept]), *(pack(v.astype(np.int64)) for v in (first, second, c[many], ones, 0 * ones))]
        fixed = [(s, ASKED, b, 0, 0, 1, 0, d) for s, _, b, *_, d in asks(bucket, buckets, names, *once)]
        return row_table([(bucket, PAIR, bucket, 0, 0, int(one.sum()), int((c == 2).sum()), pair), *fixed, *asks(bucket, buckets, names[kept], *told(first, second, ones, len(kept)))])

    return pair_requests(docs, buckets).groupBy("bucket").applyInArrow(work, ROW)


# Seating


def stirling(discount: float, most: int) -> np.ndarray:
    """Logarithms of generalised Stirling numbers: row c, column t - 1."""
    out = np.full((most + 1, most), -np.inf)
    out[1, 0] = 0.0
    t = np.arange(1, most + 1)
    for c in range(1, most):
        with np.errstate(divide="ignore", invalid="ignore"):
            stay = np.where(t <= c, np.log(np.maximum(c - discount * t, 1e-300)), -np.inf) + out[c]
        out[c + 1] = np.logaddexp(stay, np.r_[-np.inf, out[c, :-1]])
    return out


def few_tables(c: np.ndarray, rest: np.ndarray, p: np.ndarray, discount: float, table: np.ndarray, uniform: np.ndarray) -> np.ndarray:
    """The tables of dishes of c customers, each from its exact distribution: `rest` is the weight of a new table but for p."""
    out = np.ones(len(c), dtype=np.int64)
    edges = [1, *(e for e in (4, 16, 64, 256, 1024) if e < len(table) - 1), len(table) - 1]
    for low, high in zip(edges, edges[1:]):
        for at in np.array_split(np.flatnonzero((c > low) & (c <= high)), max(1, len(c) * high // 4_000_000)):
            if len(at):
                t = np.arange(high)
                new = np.cumsum(np.log(rest[at, None] + discount * t), axis=1) + (t + 1) * np.log(p[at, None])
                weight = table[c[at], :high] + new
                weight = np.cumsum(np.exp(weight - weight.max(axis=1, keepdims=True)), axis=1)
                out[at] = 1 + (weight < uniform[at, None] * weight[:, -1:]).sum(axis=1)
    return np.minimum(out, c)


def log_gamma(x: np.ndarray) -> np.ndarray:
    """For x > 0, by its asymptotic series eight steps on."""
    back, x = np.log(np.prod(x[..., None] + np.arange(8), axis=-1)), x + 8
    return (x - 0.5) * np.log(x) - x + 0.9189385332046727 + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5) - back


def saddle(c: np.ndarray, t: np.ndarray, discount: float) -> np.ndarray:
    """The logarithm z of 1 - x, where x is the saddle point of (1 - (1 - x)^d)^t / x^c, for 1 < t < c."""
    low, high = np.full(t.shape, np.log(1e-14)), np.full(t.shape, np.log(700.0))
    for _ in range(45):
        mid = (low + high) / 2
        less = slope(-np.exp(mid), discount) < np.log(c / t)
        low, high = np.where(less, mid, low), np.where(less, high, mid)
    return -np.exp((low + high) / 2)


def slope(z: np.ndarray, discount: float) -> np.ndarray:
    """The logarithm of x f'(x) / f(x), with f(x) = (1 - (1 - x)^d) / d, at x = 1 - e^z."""
    return np.log(discount) + (discount - 1) * z + np.log(-np.expm1(z)) - np.log(-np.expm1(discount * z))


def log_series(c: np.ndarray, t: np.ndarray, discount: float) -> np.ndarray:
    """The same by the alternating sum over the powers of f, which is exact; its terms fall fast where t is small beside c^d.
    `c` is the same along a row."""
    j = np.arange(1, TERMS + 1)
    one = c[:, :1]
    power = np.exp(log_gamma(1 + discount * j) + log_gamma(one - discount * j) - log_gamma(one - discount)) * np.sin(np.pi * discount * j) / np.pi
    total, choose = np.zeros(t.shape), np.ones(t.shape)
    for k in range(TERMS):
        choose = choose * (t - k) / (k + 1)
        total += (1 if k % 2 == 0 else -1) * choose * power[:, k : k + 1]
    return log_gamma(one - discount) + np.log(np.maximum(total, 1e-300)) - t * np.log(discount) - log_gamma(t + 1.0)


def log_stirling(c: np.ndarray, t: np.ndarray, discount: float) -> np.ndarray:
    """Logarithms of generalised Stirling numbers for large c: by the series where t is small, else by the saddle point of
    their generating function, f(x)^t / t!."""
    inner = np.clip(t, 2, np.maximum(c - 1, 2))
    z = saddle(c, inner, discount)
    y, power = np.exp(z), np.exp(discount * z)
    bend = (1 - discount) + y / -np.expm1(z) - discount * power / -np.expm1(discount * z)
    spread = np.log(inner) + np.log(-np.expm1(z)) - z + slope(z, discount) + np.log(bend)
    value = log_gamma(c + 1.0) - log_gamma(inner + 1.0) + inner * np.log(-np.expm1(discount * z) / discount) - c * np.log(-np.expm1(z)) - 0.5 * (np.log(2 * np.pi) + spread)
    near = np.maximum(1.0, c**discount * (1.0 if discount <= 0.8 else 0.5))
    return np.where(t >= c, 0.0, np.where(t <= near, log_series(c, np.minimum(t, near), discount), value))


def many_tables(c: np.ndarray, rest: np.ndarray, p: np.ndarray, discount: float, uniform: np.ndarray) -> np.ndarray:
    """The tables of dishes of many customers, each from the same distribution as few_tables has, on a grid around its mode."""
    c, whole = c.astype(np.float64), rest / discount
    low, high = np.full(len(c), np.log(1e-14)), np.full(len(c), np.log(700.0))
    tables = lambda z: np.clip(c * np.exp(-slope(z, discount)), 1, c)
    gain = lambda z, t: np.log(-np.expm1(discount * z) / discount) + np.log(p) + np.log(rest + discount * t) - np.log(t)
    for _ in range(45):  # the mode: there one table more changes nothing; with more tables z rises
        mid = (low + high) / 2
        z = -np.exp(mid)
        more = gain(z, tables(z)) > 0
        low, high = np.where(more, low, mid), np.where(more, mid, high)
    mode = tables(-np.exp((low + high) / 2))
    around = lambda t: log_stirling(c[:, None] + 0 * t, t, discount) + t * np.log(discount * p)[:, None] + log_gamma(whole[:, None] + t) - log_gamma(whole)[:, None]
    # The spread, from the curvature about the mode.
    step = np.maximum(np.minimum(np.minimum(mode - 1, c - mode), np.sqrt(mode)) / 2, 0.5)
    three = around(np.clip(mode[:, None] + step[:, None] * np.array([-1.0, 0.0, 1.0]), 1, c[:, None]))
    curve = (three[:, 0] + three[:, 2] - 2 * three[:, 1]) / step**2
    reach = np.ceil(8 * np.clip(1 / np.sqrt(np.maximum(-curve, 1e-12)), 1, np.sqrt(mode) + 1)) + 2
    first, last = np.maximum(np.floor(mode - reach), 1), np.minimum(np.ceil(mode + reach), c)
    stride = np.ceil((last - first + 1) / GRID)
    t = first[:, None] + stride[:, None] * np.arange(GRID)
    weight = np.where(t <= last[:, None], around(np.minimum(t, c[:, None])), -np.inf)
    weight = np.cumsum(np.exp(weight - weight.max(axis=1, keepdims=True)), axis=1)
    target = uniform * weight[:, -1]
    at = np.minimum((weight < target[:, None]).sum(axis=1), GRID - 1)
    rows = np.arange(len(c))
    before = np.where(at > 0, weight[rows, at - 1], 0.0)
    share = (target - before) / np.maximum(weight[rows, at] - before, 1e-300)
    return np.clip(t[rows, at] + np.floor(stride * np.clip(share, 0, 1 - 1e-12)), 1, c).astype(np.int64)


def draw_tables(c: np.ndarray, t: np.ndarray, whole: np.ndarray, p: np.ndarray, discount: float, theta: float, mark: np.ndarray, exact: int = EXACT) -> np.ndarray:
    """Tables of dishes of c customers, drawn anew given the t of now, those of the whole restaurant, and the parent's chance p.
    `mark` is a number of each dish and round that the draw follows from."""
    rest, uniform = theta + discount * np.maximum(whole - t, 0).astype(np.float64), (mixed(mark) >> np.uint64(11)).astype(np.float64) / 2.0**53
    out = few_tables(c, rest, p, discount, stirling(discount, exact), uniform)
    large = np.flatnonzero(c > exact)
    for at in np.array_split(large, 1 + len(large) // 4_096):
        if len(at):
            out[at] = many_tables(c[at], rest[at], p[at], discount, uniform[at])
    out[c == 0] = 0
    return out


def discount_of(one: int, two: int) -> float:
    """From how many dishes have one and two customers."""
    return float(np.clip(one / (one + 2 * two), 0.05, 0.95)) if one + two else 0.5


@dataclass
class Level:
    """The parent's state: its customers and tables in all, its discount, the concentration and the equal chance above it."""

    customers: int
    tables: int
    discount: float
    theta: float
    base: float

    def chance(self, customers: np.ndarray, tables: np.ndarray) -> np.ndarray:
        backed = (self.theta + self.discount * self.tables) * self.base
        return np.maximum((customers - self.discount * tables + backed) / (self.theta + self.customers), 1e-300)


@dataclass
class Seating:
    """What a fit leaves: docs (the slices' texts with their words' numbers), nodes (of each bucket the words, their training counts, and of each sample their customers and tables in
    the parent and the tables of their own restaurants), pairs (with tables added up over the samples), the samples' parents, and
    the totals."""

    docs: DataFrame
    nodes: DataFrame
    pairs: DataFrame
    levels: list[Level]
    n: int
    v: int
    discount: float
    theta: float


def seat_words(nodes: DataFrame, told_rows: DataFrame, level: Level, seed: int, record: bool) -> DataFrame:
    """A round for the parent: words add up what their pairs tell, draw their tables, and answer those who asked."""

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return row_table([])
        bucket = left.column("bucket")[0].as_py()
        h, c, fixed_own, fixed_up, root, *kept = numbers(data_of(left)[0])
        own, up = fixed_own.copy(), fixed_up.copy()
        asked = [(s, fixed, unpack_steps(d[0]), *numbers(d[1:])) for s, fixed, d in zip(right.column("source").to_pylist(), right.column("one").to_pylist(), data_of(right))]
        places = [a[2] for a in asked]
        for (_, fixed, _, told_own, told_up), at in zip(asked, places):
            own[at] += told_own  # the names of one row are distinct
            up[at] += told_up
            if fixed:
                fixed_own, fixed_up = fixed_own.copy(), fixed_up.copy()
                fixed_own[at] += told_own
                fixed_up[at] += told_up
        root = draw_tables(up, root, np.full(len(h), level.tables), np.full(len(h), level.base), level.discount, level.theta, h.view(np.uint64) + np.uint64(seed))
        kept = [*kept, up, root, own] if record else kept
        rows = [(bucket, NODE, bucket, int(up.sum()), int(root.sum()), int((up == 1).sum()), int((up == 2).sum()), [pack(x) for x in (h, c, fixed_own, fixed_up, root, *kept)])]
        rows += [(bucket, ANSWER, a[0], 0, 0, 0, 0, [pack(x[at]) for x in (up, root, own)]) for a, at in zip(asked, places) if not a[1]]
        return row_table(rows)

    return by_kind(nodes, NODE).cogroup(by_kind(told_rows, ASKED)).applyInArrow(work, ROW)


def seat_pairs(pairs: DataFrame, answers: DataFrame, level: Level, discount: float, buckets: int, seed: int, record: bool) -> DataFrame:
    """A round for the contexts: pairs draw their tables, given the parent's chances, and tell their words."""

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return row_table([])
        bucket = left.column("bucket")[0].as_py()
        names, first, second, c, t, t_sum = pair_numbers(data_of(left)[0])
        up, root, own = (np.zeros(len(names), dtype=np.int64) for _ in range(3))
        got = dict(zip(right.column("source").to_pylist(), data_of(right)))
        for source, at in by_bucket(names % buckets):
            up[at], root[at], own[at] = numbers(got[source])
        t_sum = t_sum + t if record else t_sum
        mark = pair_key(names[first], names[second]) + np.uint64(seed)
        t = draw_tables(c, t, own[first], level.chance(up, root)[second], discount, level.theta, mark)
        pair = (bucket, PAIR, bucket, 0, 0, 0, 0, [pack_steps(names), *(pack(x) for x in (first, second, c, t, t_sum))])
        return row_table([pair, *asks(bucket, buckets, names, *told(first, second, t, len(names)))])

    return by_kind(pairs, PAIR).cogroup(by_kind(answers, ANSWER)).applyInArrow(work, ROW)


def fit(asked: DataFrame, buckets: int, burn: int = BURN, samples: int = SAMPLES, theta: float = CONCENTRATION) -> Seating:
    total = lambda df, kind: df.where(F.col("kind") == kind).agg(*(F.coalesce(F.sum(name), F.lit(0)) for name in ("a", "b", "one", "two"))).first()
    words = write_cut(count_words(asked))
    n, v, *_ = total(words, NODE)

    def begin(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        h, c = numbers(data_of(table)[0])
        return row_table([(bucket, NODE, bucket, 0, 0, 0, 0, [pack(x) for x in (h, c, 0 * c, 0 * c, (c > 0).astype(np.int64))])])

    docs = write_cut(numbered(asked, words, buckets))
    nodes, pairs = by_kind(words, NODE).applyInArrow(begin, ROW), write_cut(count_pairs(docs, buckets))
    *_, one, two = total(pairs, PAIR)
    discount, level, levels, held = discount_of(one, two), Level(0, v, 0.5, theta, 1 / (v + 1)), [], [words]
    for k in range(burn + samples):
        nodes = write_cut(seat_words(nodes, pairs, level, 2 * k, k >= burn))
        customers, tables, one, two = total(nodes, NODE)
        level = Level(customers, tables, level.discount, theta, level.base)
        levels += [level] if k >= burn else []
        release(*held)
        if k == burn + samples - 1:
            break
        fresh = write_cut(seat_pairs(pairs, nodes, level, discount, buckets, 2 * k + 1, k >= burn))
        held, pairs = [nodes, pairs], fresh
        level = Level(customers, tables, discount_of(one, two), theta, level.base)
    return Seating(docs, nodes, pairs, levels, n, v, discount, theta)


# Scores

def answer_table(slice_: list[int], kind: int, bucket: int, data: list[list[bytes]]) -> pa.Table:
    n = len(data)
    return pa.table(
        {
            "slice": pa.array(slice_, pa.int64()), "kind": pa.array([kind] * n, pa.int32()), "bucket": pa.array([bucket] * n, pa.int64()),
            "ids": pa.nulls(n, pa.list_(pa.int64())), "held": pa.nulls(n, pa.list_(pa.bool_())), "data": pa.array(data, pa.list_(pa.binary())),
        }
    )


def parts_of(owner: np.ndarray, n: int) -> list[tuple[int, int]]:
    edges = np.searchsorted(owner, np.arange(n + 1))
    return list(zip(edges, edges[1:]))


def answer_words(seating: Seating, buckets: int) -> DataFrame:
    """Of each slice's words the training counts, and the samples' chances and tables."""
    levels = seating.levels

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return answer_table([], WORDS, 0, [])
        _, c, _, _, _, *kept = numbers(data_of(right)[0])
        asked = [unpack_steps(d[0]) for d in left.column("data").to_pylist()]
        at, owner = np.concatenate(asked), np.repeat(np.arange(len(asked)), [len(a) for a in asked])
        p = np.stack([level.chance(up, root) for level, up, root in zip(levels, kept[::3], kept[1::3])]).astype(np.float32)[:, at]
        c, tables = c[at], np.stack(kept[2::3]).astype(np.float32)[:, at]
        data = [[pack(c[a:b]), pack(p[:, a:b]), pack(tables[:, a:b])] for a, b in parts_of(owner, left.num_rows)]
        return answer_table(left.column("slice").to_pylist(), WORDS, left.column("bucket")[0].as_py(), data)

    return word_requests(seating.docs, buckets).groupBy("bucket").cogroup(by_kind(seating.nodes, NODE)).applyInArrow(work, REQUESTS)


def answer_pairs(seating: Seating, buckets: int) -> DataFrame:
    """Of each slice's pairs the customers less the discounts of their tables, averaged over the samples; 0 if never learned."""
    discount, samples = seating.discount, len(seating.levels)

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return answer_table([], PAIRS, 0, [])
        u, w, n, owner = asked_pairs(left)
        keys, _, place, c = summed(pair_key(u, w), n)
        worth = np.where(c > 0, c - discount, 0.0)
        for data in data_of(right):
            names, first, second, customers, t, t_sum = pair_numbers(data)
            worth[np.searchsorted(keys, pair_key(names[first], names[second]))] = customers - discount * (t_sum + t) / samples
        worth = worth[place].astype(np.float32)
        data = [[pack(worth[a:b])] for a, b in parts_of(owner, left.num_rows)]
        return answer_table(left.column("slice").to_pylist(), PAIRS, left.column("bucket")[0].as_py(), data)

    return pair_requests(seating.docs, buckets).groupBy("bucket").cogroup(by_kind(seating.pairs, PAIR)).applyInArrow(work, REQUESTS)


#: What is known of each text.
SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def score(seating: Seating, buckets: int) -> DataFrame:
    """The columns of SCORES, of every text."""
    n, v, discount, theta, samples = seating.n, seating.v, seating.discount, seating.theta, len(seating.levels)
    rows = seating.docs.unionByName(answer_words(seating, buckets)).unionByName(answer_pairs(seating, buckets))

    def work(table: pa.Table) -> pa.Table:
        kinds, at, data = table.column("kind").to_pylist(), table.column("bucket").to_pylist(), table.column("data").to_pylist()
        k = kinds.index(DOCS)
        own = Slice.packed(data[k])
        own.pair_up()
        answers = {(kind, bucket): d for kind, bucket, d in zip(kinds, at, data)}
        c = np.zeros(len(own.names), dtype=np.int64)
        p, tables = np.zeros((samples, len(c)), dtype=np.float32), np.zeros((samples, len(c)), dtype=np.float32)
        for bucket, where in by_bucket(own.names % buckets):
            got = answers[WORDS, bucket]
            c[where] = unpack(got[0], np.int64)
            p[:, where], tables[:, where] = (unpack(d, np.float32).reshape(samples, -1) for d in got[1:])
        worth = np.zeros(len(own.first))
        for bucket, where in by_bucket(own.pair_buckets(buckets)):
            worth[where] = unpack(answers[PAIRS, bucket][0], np.float32)
        guests = c.astype(np.float64)
        guests[-1] = c[-2]  # every training text has a beginning, as it has an end
        backed = np.zeros(len(worth))
        for s in range(samples):
            backed += (theta + discount * tables[s, own.first].astype(np.float64)) * p[s, own.second]
        logs = np.log10(np.maximum((worth + backed / samples) / (theta + guests[own.first]), 1e-300))
        plain = np.log10((c + SMOOTHING) / (n + SMOOTHING * (v + 1)))
        total = lambda values: np.bincount(own.doc, weights=values, minlength=len(own.sizes))
        return pa.table(
            {
                "doc_id": pa.array(table.column("ids")[k].as_py(), pa.int64()), "held_out": pa.array(table.column("held")[k].as_py(), pa.bool_()), "n_tokens": own.sizes,
                "n_known": total((c > 0)[own.token]).astype(np.int64), "base_score": total(plain[own.token]), "score": total(logs[own.pair]),
            }
        )

    return rows.groupBy("slice").applyInArrow(work, SCORES)


def report(docs: DataFrame, burn: int = BURN, samples: int = SAMPLES, theta: float = CONCENTRATION, slice_bytes: int = SLICE_BYTES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document row."""
    docs = id_and_text(docs)
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    buckets = 1 + size // bucket_bytes
    asked = write_cut(requests(docs, buckets, slice_bytes))
    seating = fit(asked, buckets, burn, samples, theta)
    release(asked)
    return score(seating, buckets).select("doc_id", "held_out", "n_tokens", "n_known", F.lit(seating.n).cast("long").alias("train_tokens"), "base_score", "score")

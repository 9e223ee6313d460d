"""Embedding whitening by weighted multiplicity covariance.

Vectors become whole numbers, x = floor(64 c) + 1,000,000, and identical ones are grouped first: what follows is done once for
each distinct vector, with the number of its rows as weight (or one, if asked for). Two passes over the distinct vectors make
the fit: whole sums per dimension, then a weighted matrix product of the vectors less the mean, which every task adds up for
its own rows, so that a partition gives one matrix. Only sums and the covariance, whose size is that of the dimensions, reach
the driver, which finds the components. A third pass whitens each distinct vector; the rows are joined back to them by a
128-bit hash of x, very common ones where they lie.

Rows whose vector is null, or holds a null or an entry that is no finite number, go, and so do vectors of another length than
most rows have (of equally common lengths the longer counts). Entries beyond 2^46 count as 2^46. Components whose eigenvalue is
below 1e-12 of the largest say nothing and aren't returned, so that one row, equal rows, empty vectors and an empty table give
no rows. Repeated rows and repeated or null ids give their rows each; further columns are ignored. A deviation beyond 64 bits
is null.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphshift.llm._shared import hot_limit, join_back, release, slices, write_cut

COMPONENTS = 32
#: The scale and the offset of whole entries.
SCALE, OFFSET = 64, 1_000_000
LARGEST = float(2**52)
LEAST_SHARE = 1e-12
#: Rows and bytes of the slices that are multiplied at a time.
ROWS, BYTES = 8_192, 8_000_000
SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whole_vectors(embeddings: DataFrame, vector: str = "embedding") -> DataFrame:
    """vec_id and x of the rows whose vector is whole."""
    entries = F.col(vector).cast("array<double>")
    finite = F.forall(entries, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)))
    x = F.transform(entries, lambda c: F.floor(F.least(F.greatest(c * SCALE, F.lit(-LARGEST)), F.lit(LARGEST))) + F.lit(OFFSET).cast("long"))
    return embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(finite, x).alias("x")).where("x is not null")


def with_key(df: DataFrame) -> DataFrame:
    return df.withColumns({"k1": F.xxhash64("x"), "k2": F.xxhash64(F.lit(1), "x")})


def matrix_of(batch: pa.RecordBatch, name: str, kind) -> np.ndarray:
    column = batch.column(name)
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(len(column), -1)


def added_up(df: DataFrame, part: Callable[[pa.RecordBatch], np.ndarray], kind: str) -> DataFrame:
    """i, j, value: the sum of the matrices that `part` makes of each slice. A partition adds up its own before it gives it away."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in slices(batches, ROWS, BYTES):
            if batch.num_rows:
                own = part(batch)
                total = own if total is None else total + own
        if total is not None:
            for i, row in enumerate(total):
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([row], pa.list_(pa.int64() if kind == "long" else pa.float64()))], ["i", "row"])

    every = df.mapInArrow(run, f"i int, row array<{kind}>")
    return every.select("i", F.posexplode("row").alias("j", "value")).groupBy("i", "j").agg(F.sum("value").alias("value"))


def collected(sums: DataFrame, kind) -> np.ndarray:
    """A matrix of sums, whose size is that of the dimensions, on the driver."""
    rows = sums.collect()
    out = np.zeros((1 + max(r.i for r in rows), 1 + max(r.j for r in rows)), dtype=kind)
    for r in rows:
        out[r.i, r.j] = r.value
    return out


def gaps(x: np.ndarray, sums: np.ndarray, n: int) -> np.ndarray:
    """n x - S, exactly: as 64-bit numbers where they fit, else as Python's."""
    if float(n) * float(np.abs(x).max(initial=0)) < 2.0**62:
        return n * x - sums.astype(np.int64)
    return n * x.astype(object) - sums.astype(object)


def deviations(gap: np.ndarray) -> list[int | None]:
    if gap.dtype == np.int64 and float(np.abs(gap).max(initial=0)) ** 2 * gap.shape[1] < 2.0**62:
        return (gap * gap).sum(axis=1).tolist()
    exact = [sum(int(g) * int(g) for g in row) for row in gap]
    return [value if value < 2**63 else None for value in exact]


class Whitening:
    """A fit: n, the sums per dimension, the components as columns, their eigenvalues, and the trace."""

    def __init__(self, n: int, sums: np.ndarray, covariance: np.ndarray, components: int = COMPONENTS):
        self.n, self.sums = n, sums
        values, vectors = np.linalg.eigh(covariance)
        order = np.argsort(-values, kind="stable")[:components]
        order = order[values[order] > LEAST_SHARE * max(values.max(initial=0.0), 0.0)]
        self.values, self.vectors, self.trace = values[order], vectors[:, order], float(np.trace(covariance))

    def whiten(self, gap: np.ndarray) -> np.ndarray:
        return (gap.astype(np.float64) / self.n) @ (self.vectors / np.sqrt(self.values))


def weights_of(batch: pa.RecordBatch, weights: str) -> np.ndarray:
    return batch.column("copies").to_numpy().astype(np.int64) if weights == "count" else np.ones(batch.num_rows, dtype=np.int64)


def fit(distinct: DataFrame, weights: str = "count", components: int = COMPONENTS) -> Whitening | None:
    """The fit over `distinct` (x, copies): every distinct vector weighs as many rows as it has (`count`), or one (`one`)."""

    def sums_of(batch: pa.RecordBatch) -> np.ndarray:
        w = weights_of(batch, weights)[:, None]
        return np.concatenate([w, w * matrix_of(batch, "x", np.int64)], axis=1).sum(axis=0, keepdims=True)

    rows = added_up(distinct.select("x", "copies"), sums_of, "long")
    if rows.isEmpty():
        return None
    totals = collected(rows, np.int64)[0]
    n, sums = int(totals[0]), totals[1:]
    if not len(sums):
        return None

    def products(batch: pa.RecordBatch) -> np.ndarray:
        centred = gaps(matrix_of(batch, "x", np.int64), sums, n).astype(np.float64) / n
        return centred.T @ (weights_of(batch, weights)[:, None] * centred)

    return Whitening(n, sums, collected(added_up(distinct.select("x", "copies"), products, "double"), np.float64) / n, components)


def whiten_distinct(distinct: DataFrame, model: Whitening) -> DataFrame:
    """k1, k2, copies, deviation, whitened of each distinct vector."""
    sent = distinct.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in slices(batches, ROWS, BYTES):
            if batch.num_rows:
                gap = gaps(matrix_of(batch, "x", np.int64), own.sums, own.n)
                out = own.whiten(gap)
                ends = pa.array(np.arange(0, out.size + 1, out.shape[1], dtype=np.int32))
                made = pa.ListArray.from_arrays(ends, pa.array(out.reshape(-1)))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("k1", "k2", "copies")), pa.array(deviations(gap), pa.int64()), made], ["k1", "k2", "copies", "deviation", "whitened"])

    return with_key(distinct).mapInArrow(run, "k1 long, k2 long, copies long, deviation long, whitened array<double>")


def identity_error(white: DataFrame, n: int, weights: str = "count") -> float:
    """The largest entry of the whitened vectors' covariance less the identity, measured on the vectors themselves."""

    def products(batch: pa.RecordBatch) -> np.ndarray:
        y = matrix_of(batch, "whitened", np.float64)
        y = np.concatenate([np.ones((len(y), 1)), y], axis=1)
        return y.T @ (weights_of(batch, weights)[:, None] * y)

    total = collected(added_up(white.select("copies", "whitened"), products, "double"), np.float64) / n
    return float(np.abs(total[1:, 1:] - np.outer(total[0, 1:], total[0, 1:]) - np.eye(len(total) - 1)).max())


def whiten(embeddings: DataFrame, vector: str = "embedding", weights: str = "count", components: int = COMPONENTS) -> DataFrame:
    """vec_id, n, deviation, whitened (array), explained (array), identity_error of each row with a whole vector."""
    spark, rows = embeddings.sparkSession, whole_vectors(embeddings, vector)
    every = write_cut(rows.groupBy("x").agg(F.count(F.lit(1)).alias("copies")))
    common = every.groupBy(F.size("x").alias("size")).agg(F.sum("copies").alias("rows")).orderBy(F.desc("rows"), F.desc("size")).first()
    distinct = every.where(F.size("x") == (common["size"] if common else 0))
    model = fit(distinct, weights, components) if common else None
    if model is None or not len(model.values):
        release(every)
        return spark.createDataFrame([], "vec_id long, n long, deviation long, whitened array<double>, explained array<double>, identity_error double")
    white = write_cut(whiten_distinct(distinct, model))
    release(every)
    error = identity_error(white, model.n, weights)
    keyed = white.select("k1", "k2", "deviation", "whitened", F.col("copies").alias("n"), F.lit(True).alias("use"))
    placed = join_back(with_key(rows).select("vec_id", "k1", "k2"), keyed, ["k1", "k2"], hot_limit(common["rows"]))
    explained = F.array(*(F.lit(float(v / model.trace)) for v in model.values))
    return placed.select("vec_id", F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", explained.alias("explained"), F.lit(error).alias("identity_error"))


def report(embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """A row for each row with a whole vector and each component: the columns of SCHEMA."""
    white = whiten(embeddings, components=components)
    every = white.select("vec_id", "n", "deviation", "identity_error", F.posexplode(F.arrays_zip("whitened", "explained")).alias("at", "c"))
    return every.select("vec_id", (F.col("at") + 1).cast("int").alias("component"), "n", "deviation", F.col("c.whitened").alias("whitened"), F.col("c.explained").alias("explained"), "identity_error")

"""Quality classifier: random-indexing word vectors pooled per document, then a two-layer network with a calibrated temperature.

Every word has a sparse random index vector that follows from its spelling. A word's vector is put together from those of
its parts, the runs of three characters of the lower-case word between a begin and an end mark; a part's vector is the sum
of the index vectors of the words that stand near words with this part, over the labelled sample, scaled to length 1 and
weighted by the part's inverse document frequency. So each word has a vector, also one that the sample doesn't hold, and no
part of the sample's words is dropped. A document is the mean of its words' vectors beside the mean of the products, place by
place, of the vectors of neighbours, which tells how words follow each other. A network with one hidden layer scores it. The
temperature that divides the network's output is fitted on the sample's out-of-fold outputs.

The sample is bounded by `sample_rows` labelled rows, which are chosen by a hash of the id; labels of held-out rows, whose
crc32 of the id as text leaves 2 by 4, are never read. Vectors are summed by Spark, documents are pooled where they lie, and
only the parts' vectors and the sample's pooled rows reach the driver. All documents are scored.

A null or empty text pools to zeros and is scored like any other. Rows with a null id are scored and never held out; ids are
whole numbers. Repeated rows are scored each for itself; further columns, whatever their names, are ignored or passed on. Of
several texts of one labelled id that with the least hash is learned from, and of several labels the larger. Without labels
of both kinds, every score is the share of label 1 among the labels, or 0.5 if there are none. The temperature stays 1 where
a fold's rest lacks a label.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphshift.llm._shared import documents, id_and_text, keyed, map_batches, release, write_cut

SAMPLE_ROWS = 4_000
THRESHOLD = 0.7
DIM, NONZERO, REACH, PART = 64, 6, 2, 3
FOLDS = 5
ROWS, BYTES = 10_000, 4_000_000
#: Words that are put together from their parts at a time.
STEP = 16_384
#: Marks of a word's begin and end among code points: no character has these.
BEGIN, END = 0x110000, 0x110001
#: Finished word vectors that a worker keeps from slice to slice.
KEPT_WORDS = 100_000


def held_out(id_column: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_column).cast("string")) % 4 == 2, F.lit(False))


def index_vectors(words: list[str]) -> np.ndarray:
    """A row for each word: signs at places that follow from its spelling."""
    h = np.asarray([xxhash.xxh64_intdigest(w) for w in words], dtype=np.uint64)
    out, rows = np.zeros((len(words), DIM), dtype=np.float32), np.arange(len(words))
    for _ in range(NONZERO):
        np.add.at(out, (rows, (h >> np.uint64(1)) % np.uint64(DIM)), np.where(h & np.uint64(1), np.float32(1), np.float32(-1)))
        h >>= np.uint64(10)
    return out


@dataclass
class Words:
    """The words of a slice: distinct ones in lower case, the codes of all, their documents, and each document's number of words."""

    distinct: list[str]
    codes: np.ndarray
    doc: np.ndarray
    sizes: np.ndarray


def words_of(column: pa.Array) -> Words:
    split = pc.utf8_split_whitespace(pc.utf8_lower(pc.fill_null(column.cast(pa.string()), "")))
    flat = split.flatten()
    sizes, full = pc.list_value_length(split).to_numpy(), pc.not_equal(flat, "")
    doc = np.repeat(np.arange(len(sizes)), sizes)[full.to_numpy(zero_copy_only=False)]
    known = flat.filter(full).dictionary_encode()
    return Words(known.dictionary.to_pylist(), known.indices.to_numpy(), doc, np.bincount(doc, minlength=len(sizes)))


def parts_of(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The parts of all words, as numbers, strung together, and the number of each word's: as many as it has characters."""
    sizes = np.asarray([len(w) for w in words], dtype=np.int64)
    raw = np.frombuffer((" " + "  ".join(words) + " ").encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
    ends = np.cumsum(sizes + 2)
    raw[ends - sizes - 2], raw[ends - 1] = BEGIN, END
    inside = np.ones(len(raw), dtype=bool)
    inside[ends - sizes - 2] = inside[ends - 1] = False
    code = (raw[:-2] << 42) | (raw[1:-1] << 21) | raw[2:]
    return code[inside[1:-1]], sizes  # a part is named by its middle, so none crosses words


def part_sums(sample: DataFrame) -> DataFrame:
    """part, df and v0 .. : the documents of the sample that hold a part, and the sum of its words' neighbours' index vectors."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        words = words_of(batch.column("text"))
        vectors = index_vectors(words.distinct)
        near = np.zeros_like(vectors)
        for step in range(1, REACH + 1):
            beside = words.doc[step:] == words.doc[:-step]
            left, right = words.codes[:-step][beside], words.codes[step:][beside]
            for k in range(DIM):
                near[:, k] += np.bincount(left, weights=vectors[right, k], minlength=len(near))
                near[:, k] += np.bincount(right, weights=vectors[left, k], minlength=len(near))
        parts, sizes = parts_of(words.distinct) if words.distinct else (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))
        every, place = np.unique(parts, return_inverse=True)
        owner = np.repeat(np.arange(len(sizes)), sizes)
        sums = [np.bincount(place, weights=near[owner, k], minlength=len(every)).astype(np.float32) for k in range(DIM)]
        # Documents with a part: distinct (document, word), then distinct (document, part).
        first = np.cumsum(sizes) - sizes
        seen = np.unique(words.doc.astype(np.int64) * max(len(sizes), 1) + words.codes)
        doc, word = seen // max(len(sizes), 1), seen % max(len(sizes), 1)
        at = np.repeat(first[word] - (np.cumsum(sizes[word]) - sizes[word]), sizes[word]) + np.arange(sizes[word].sum())
        held = np.unique(np.repeat(doc, sizes[word]) * max(len(every), 1) + place[at])
        df = np.bincount(held % max(len(every), 1), minlength=len(every)).astype(np.int64) if len(every) else np.zeros(0, dtype=np.int64)
        return pa.RecordBatch.from_arrays([pa.array(every), pa.array(df), *map(pa.array, sums)], ["part", "df", *(f"v{k}" for k in range(DIM))])

    schema = "part long, df long, " + ", ".join(f"v{k} float" for k in range(DIM))
    parts = map_batches(sample.select("text"), work, schema, ROWS, BYTES)
    return parts.groupBy("part").agg(F.sum("df").alias("df"), *(F.sum(f"v{k}").cast("float").alias(f"v{k}") for k in range(DIM)))


@dataclass
class Model:
    """The parts in order, their vectors, and the network; `base` is the score where there is no network."""

    parts: np.ndarray
    vectors: np.ndarray
    base: float = 0.5
    mean: np.ndarray | None = None
    scale: np.ndarray | None = None
    layers: tuple | None = None
    temperature: float = 1.0

    def __getstate__(self) -> dict:
        return {name: value for name, value in self.__dict__.items() if name not in ("known", "kept")}

    def word_vectors(self, words: list[str]) -> np.ndarray:
        """A row of length 1 for each word: the sum of its parts' vectors. Unknown parts count as zeros. The first `KEPT_WORDS`
        words that a worker meets are put together once."""
        if not hasattr(self, "known"):
            self.known, self.kept = {}, np.zeros((KEPT_WORDS, DIM), dtype=np.float32)
        at = np.asarray([self.known.get(w, -1) for w in words], dtype=np.int64)
        out, missing = self.kept[at], np.flatnonzero(at < 0)
        fresh = [words[k] for k in missing]
        out[missing] = self.put_together(fresh)
        few = KEPT_WORDS - len(self.known)
        self.kept[len(self.known) : len(self.known) + len(fresh[:few])] = out[missing[:few]]
        self.known.update({w: len(self.known) + k for k, w in enumerate(fresh[:few])})
        return out

    def put_together(self, words: list[str]) -> np.ndarray:
        out = np.zeros((len(words), DIM), dtype=np.float32)
        for start in range(0, len(words), STEP):
            parts, sizes = parts_of(words[start : start + STEP])
            at = np.minimum(np.searchsorted(self.parts, parts), len(self.parts) - 1)
            at[self.parts[at] != parts] = len(self.parts)  # the row of zeros
            sums = np.add.reduceat(self.vectors[at], np.cumsum(sizes) - sizes, axis=0)
            out[start : start + STEP] = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)
        return out

    def pool(self, column: pa.Array) -> np.ndarray:
        """A row for each text: the mean vector of its words, and the mean product of neighbours' vectors."""
        words = words_of(column)
        out = np.zeros((len(words.sizes), 2 * DIM))
        if len(words.codes) and len(self.parts):
            columns = np.ascontiguousarray(self.word_vectors(words.distinct).T)
            beside = words.doc[1:] == words.doc[:-1]
            doc, left, right = words.doc[1:][beside], words.codes[:-1][beside], words.codes[1:][beside]
            for k in range(DIM):
                out[:, k] = np.bincount(words.doc, weights=columns[k][words.codes], minlength=len(out))
                out[:, DIM + k] = np.bincount(doc, weights=columns[k][left] * columns[k][right], minlength=len(out))
        out[:, :DIM] /= np.maximum(words.sizes, 1)[:, None]
        out[:, DIM:] /= np.maximum(words.sizes - 1, 1)[:, None]
        return out

    def logits(self, pooled: np.ndarray) -> np.ndarray:
        return network((pooled - self.mean) / self.scale, self.layers)

    def score(self, pooled: np.ndarray) -> np.ndarray:
        if self.layers is None:
            return np.full(len(pooled), self.base)
        return sigmoid(self.logits(pooled) / self.temperature)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def network(x: np.ndarray, layers: tuple) -> np.ndarray:
    return np.tanh(x @ layers[0] + layers[1]) @ layers[2] + layers[3]


def train_network(x: np.ndarray, y: np.ndarray, hidden: int = 16, steps: int = 600, rate: float = 0.01, decay: float = 1e-3, seed: int = 7):
    """Two layers by full-batch Adam on the log loss."""
    rng = np.random.default_rng(seed)
    params = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, 1 / np.sqrt(hidden), hidden), np.zeros(())]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for t in range(1, steps + 1):
        h = np.tanh(x @ params[0] + params[1])
        gap = (sigmoid(h @ params[2] + params[3]) - y) / len(y)
        back = np.outer(gap, params[2]) * (1 - h**2)
        grads = [x.T @ back, back.sum(0), h.T @ gap, gap.sum()]
        for k, g in enumerate(grads):
            g = g + decay * params[k]
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.999 * second[k] + 0.001 * g**2
            params[k] = params[k] - rate * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.999**t)) + 1e-8)
    return tuple(params)


def fit_temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature with the least log loss. The labels count as frequencies with one row more of either kind, so that
    the least is never at zero, however well the outputs part them."""
    n = y.sum()
    target = np.where(y == 1, (n + 1) / (n + 2), 1 / (len(y) - n + 2))
    loss = lambda t: -(target * np.log(np.clip(sigmoid(logits / t), 1e-12, 1)) + (1 - target) * np.log(np.clip(1 - sigmoid(logits / t), 1e-12, 1))).mean()
    low, high = np.log(1e-3), np.log(1e3)
    for _ in range(6):
        grid = np.linspace(low, high, 41)
        best = int(np.argmin([loss(np.exp(g)) for g in grid]))
        low, high = grid[max(best - 1, 0)], grid[min(best + 1, 40)]
    return float(np.exp((low + high) / 2))


def out_of_fold(x: np.ndarray, y: np.ndarray, fold: np.ndarray) -> np.ndarray | None:
    """Each row's output of a network that hasn't seen its fold, or None where the other folds lack a label."""
    out = np.zeros(len(y))
    for k in range(FOLDS):
        rest = y[fold != k]
        if not 0 < rest.sum() < len(rest):
            return None
        out[fold == k] = network(x[fold == k], train_network(x[fold != k], rest))
    return out


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    labels = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("doc_id is not null and quality is not null")
    chosen = labels.where(~held_out()).groupBy("doc_id").agg(F.max("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    texts = keyed(docs).join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min(F.struct("key", "text")).alias("t"), F.max("quality").alias("quality"))
    sample = write_cut(texts.select("doc_id", "t.text", "quality"))
    sums = part_sums(sample).orderBy("part").toPandas()
    rows = sample.count()
    vectors = sums[[f"v{k}" for k in range(DIM)]].to_numpy(dtype=np.float32).reshape(-1, DIM)
    df = sums["df"].to_numpy(dtype=np.float64)
    vectors = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
    if len(df):  # what all parts have in common says nothing
        vectors = vectors - (vectors * df[:, None]).sum(0) / df.sum()
    vectors = vectors * np.log(1 + rows / (1 + df))[:, None]
    model = Model(sums["part"].to_numpy(dtype=np.int64), np.concatenate([vectors, np.zeros((1, DIM))]).astype(np.float32))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        pooled = sent.value.pool(batch.column("text"))
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("quality"), pa.array(list(pooled), pa.list_(pa.float64()))], ["doc_id", "quality", "pooled"]
        )

    known = map_batches(sample, work, "doc_id long, quality int, pooled array<double>", ROWS, BYTES).toPandas().sort_values("doc_id")
    release(sample)
    y = (known["quality"].to_numpy(dtype=np.int64) == 1).astype(np.float64)
    if len(y):
        model.base = float(y.mean())
    if 0 < y.sum() < len(y):
        x = np.stack(known["pooled"].to_numpy())
        model.mean, model.scale = x.mean(0), x.std(0) + 1e-6
        x = (x - model.mean) / model.scale
        model.layers = train_network(x, y)
        apart = out_of_fold(x, y, np.asarray([xxhash.xxh64_intdigest(str(i)) % FOLDS for i in known["doc_id"]]))
        if apart is not None:
            model.temperature = fit_temperature(apart, y)
    return model


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every document row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = sent.value
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(own.score(own.pool(batch.column("text"))))], ["doc_id", "score"])

    scored = map_batches(id_and_text(docs), work, "doc_id long, score double", ROWS, BYTES)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of `docs`, all columns, that the model doesn't reject. Filters in place: nothing is shuffled."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = sent.value
        return batch.filter(pa.array(own.score(own.pool(batch.column("text"))) >= threshold))

    return map_batches(docs, work, docs.schema, ROWS, BYTES)


def report(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return score(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))

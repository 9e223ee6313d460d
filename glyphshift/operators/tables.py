"""Models as tables of numbers, by which tasks score texts where they lie.

Words of a model are made of an alphabet of at most 60 characters (`ngrams.kept`), so that there are never more than 60^4 grams,
however large the corpus: their counts go to the tasks as arrays. A batch's texts are strung together, and running scores of texts
of similar length are rows of one matrix.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from glyphshift import constants as K
from glyphshift.operators.ngrams import Models

#: Words that are scored at once.
SLICE = 1 << 18


def packed(models: Models, names: tuple[str, ...]) -> dict[str, dict]:
    """The counts of the named models, those that are missing left out. They are kept with the models."""
    held = models.__dict__.setdefault("_packed", {})
    if wanted := [name for name in names if name not in held]:
        sizes = {r.model: (r.vocab_size, r.total_bigrams) for r in models.meta.collect()}
        rows = models.ngrams.where(F.col("model").isin(*wanted)).select("model", "n", "gram", "cnt").toArrow()
        for name in wanted:
            own = rows.filter(pc.equal(rows.column("model"), name))
            orders = {}
            for n in (2, 3, 4):
                part = own.filter(pc.equal(own.column("n"), n))
                grams = np.frombuffer("".join(part.column("gram").to_pylist()).encode("utf-32-le"), dtype=np.uint32).reshape(-1, n)
                orders[n] = grams, part.column("cnt").to_numpy().astype(np.int64)
            held[name] = {"sizes": sizes[name], "grams": orders} if name in sizes else None
    return {name: held[name] for name in names if held[name]}


class Table:
    """One model: what each four, three and two characters count and score. Unknown characters have a code of their own."""

    def __init__(self, model: dict):
        self.v, self.total = model["sizes"]
        alphabet = np.unique(np.concatenate([grams.ravel() for grams, _ in model["grams"].values()]))
        self.base = base = len(alphabet) + 1
        self.codes = np.full(0x110000, len(alphabet), dtype=np.int32)
        self.codes[alphabet] = np.arange(len(alphabet))
        coded = {n: (self.codes[grams].astype(np.int64), counts) for n, (grams, counts) in model["grams"].items()}
        key = lambda q: (q[:, 0] * base + q[:, 1]) * base + q[:, 2]
        contexts = np.unique(np.concatenate([key(coded[3][0]), key(coded[4][0])]))
        self.row = np.zeros(base**3, dtype=np.int32)
        self.row[contexts] = np.arange(1, len(contexts) + 1)
        self.c3 = np.zeros(len(contexts) + 1, dtype=np.int64)
        self.c3[self.row[key(coded[3][0])]] = coded[3][1]
        self.c4 = np.zeros((len(contexts) + 1, base), dtype=np.int64)
        self.c4[self.row[key(coded[4][0])], coded[4][0][:, 3]] = coded[4][1]
        self.c2 = np.zeros(base * base, dtype=np.int64)
        self.c2[coded[2][0][:, 0] * base + coded[2][0][:, 1]] = coded[2][1]
        self.firsts = self.c2.reshape(base, base).sum(axis=1)
        self.step = np.log((self.c4 + 1) / (self.c3[:, None] + self.v))
        self.head = np.log((self.c2 + 1) / (self.total + self.v * self.v))

    def places(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of coded fours (a column each) the row of their contexts, and the place of the first two."""
        two = q[0] * self.base + q[1]
        return self.row[two * self.base + q[2]], two


BUILT: dict[str, dict[str, Table]] = {}


class Shared:
    """Tables and a lexicon on their way to the tasks; each worker builds them once."""

    def __init__(self, spark: SparkSession, models: Models, names: tuple[str, ...], lexicon: DataFrame | None = None):
        self.names, self.key = names, uuid.uuid4().hex
        words = [] if lexicon is None else [r.word for r in lexicon.select("word").distinct().collect()]
        self.sent = spark.sparkContext.broadcast((packed(models, names), words))

    def tables(self) -> dict[str, Table]:
        if self.key not in BUILT:
            BUILT.clear()
            BUILT[self.key] = {name: Table(model) for name, model in self.sent.value[0].items()}
        return BUILT[self.key]

    def lexicon(self) -> dict[int, pa.Array]:
        """The words of the lexicon by length."""
        by_size: dict[int, list[str]] = {}
        for word in self.sent.value[1]:
            by_size.setdefault(len(word), []).append(word)
        return {size: pa.array(words, pa.string()) for size, words in by_size.items()}

    def complete(self) -> bool:
        return all(name in self.sent.value[0] for name in self.names)


class Texts:
    """Texts strung together with a blank before, between and behind them: text i has size[i] characters from start[i] on."""

    def __init__(self, texts: pa.Array):
        self.size = pc.utf8_length(texts).to_numpy().astype(np.int64)
        self.start = np.cumsum(self.size + 1) - self.size
        self.points = np.frombuffer(f" {strung(texts, ' ')} ".encode("utf-32-le"), dtype=np.uint32)


def strung(texts: pa.Array, between: str) -> str:
    return pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(texts)], pa.int32()), texts), between)[0].as_py()


@cache
def keys(english: bool) -> np.ndarray:
    """By code point, what the key of a character gives on the layout other than the English or the Hebrew one."""
    source, target = (K.EN_FROM, K.EN_TO) if english else (K.HE_FROM, K.HE_TO)
    out = np.arange(0x110000, dtype=np.uint32)
    out[[ord(c) for c in source]] = [ord(c) for c in target]
    return out


def other_layout(text: str, english: bool) -> str:
    """`text` of a layout as the same keys give it on the other one."""
    return keys(english)[np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)].tobytes().decode("utf-32-le")


def classes(n: np.ndarray) -> Iterator[tuple[np.ndarray, int]]:
    """Texts of n places each (those without any left out), by powers of two: which, and the most places of one."""
    power = np.ceil(np.log2(np.maximum(n, 1))).astype(np.int64)
    for p in np.unique(power[n > 0]):
        of = np.flatnonzero((power == p) & (n > 0))
        yield of, int(n[of].max())


def cells(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of each of n[i] places of row i."""
    rows = np.repeat(np.arange(len(n)), n)
    return rows, np.arange(len(rows)) - np.repeat(np.cumsum(n) - n, n)


def fours(table: Table, texts: Texts, of: np.ndarray, rows: np.ndarray, cols: np.ndarray, pad: int) -> list[np.ndarray]:
    """The codes of the four characters from each place on, of texts with `pad` blanks before and behind. Beyond a text's end
    there are none that a model knows."""
    at = (texts.start[of] - pad)[rows] + cols
    codes = table.codes[texts.points]
    long = (texts.size[of] + 2 * pad)[rows]
    last = len(codes) - 1
    out = []
    for i in range(4):
        q = codes[np.minimum(at + i, last)].astype(np.int64)
        out.append(np.where(cols + i < long, q, table.base - 1))
    return out


def steps(table: Table, texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """At each place of the strung texts what the four characters from there on add to a score, and the place of the first two."""
    codes = table.codes[texts.points]
    two = codes[:-3] * table.base + codes[1:-2]
    return table.step.ravel()[table.row[two * table.base + codes[2:-1]] * table.base + codes[3:]], two


def running(table: Table, texts: Texts, of: np.ndarray, n: np.ndarray, width: int, pad: int = 1, known: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """The scores of the texts `of` after each of their n places, of which the last ends with the text and its `pad` blanks: a row a
    text. `known` is what `steps` says of the texts."""
    step, two = steps(table, texts) if known is None else known
    rows, cols = cells(n)
    begins = texts.start[of] - pad
    out = np.zeros((len(of), width))
    out[rows, cols] = step[begins[rows] + cols]
    out[:, 0] += table.head[two[begins]]
    return np.cumsum(out, axis=1, out=out)


def colliding(en: pa.Array, he: pa.Array, n: np.ndarray, width: int, lexicon: dict[int, pa.Array]) -> np.ndarray:
    """For each of n places of a row, whether either text up to there is in the lexicon: at j + 2 characters, in the last place (the
    delimiter's) the whole. What is behind the last place counts as colliding."""
    cols = np.arange(width)
    out = cols[None, :] >= n[:, None]
    for size, words in lexicon.items():
        begins = np.zeros(len(n), dtype=bool)
        for side in (en, he):
            begins |= pc.is_in(pc.utf8_slice_codeunits(side, 0, size), value_set=words).to_numpy(zero_copy_only=False)
        hit = np.flatnonzero(begins)
        upto = np.minimum(cols[None, :] + 3, n[hit][:, None] + 1)
        out[hit] |= upto == size
    return out


class Judged:
    """Distinct pairs of texts, evaluated: `words` of one class of lengths with d (a matrix for each way) and coll."""

    def __init__(self, count: int, parts: list[tuple[np.ndarray, np.ndarray, list[np.ndarray], np.ndarray]]):
        self.count, self.parts = count, parts  # of: which texts, n: their places, d by way, coll

    def summary(self, way: int, sign: float) -> tuple[np.ndarray, np.ndarray]:
        """The highest evaluation of each text that doesn't collide, and whether the last one leans to the other layout or collides."""
        top, fix = np.full(self.count, -np.inf), np.zeros(self.count, dtype=bool)
        for of, n, d, coll in self.parts:
            x = np.where(coll, -np.inf, sign * d[way])
            top[of] = x.max(axis=1)
            last = np.arange(len(of)), n - 1
            fix[of] = coll[last] | (sign * d[way][last] > 0)
        return top, fix

    def first_over(self, texts: np.ndarray, ways: np.ndarray, sign: np.ndarray, threshold: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """j and value of the first evaluation of each text over its threshold: there is one."""
        j, value = np.zeros(len(texts), dtype=np.int64), np.zeros(len(texts))
        part, row = np.zeros(self.count, dtype=np.int64), np.zeros(self.count, dtype=np.int64)
        for p, (of, *_) in enumerate(self.parts):
            part[of], row[of] = p, np.arange(len(of))
        for p, (_, _, d, coll) in enumerate(self.parts):
            for way in range(len(d)):
                mine = np.flatnonzero((part[texts] == p) & (ways == way))
                r = row[texts[mine]]
                x = np.where(coll[r], -np.inf, sign[mine][:, None] * d[way][r])
                at = (x > threshold[mine][:, None]).argmax(axis=1)
                j[mine], value[mine] = at + 1, x[np.arange(len(mine)), at]
        return j, value

    def records(self, sign: float, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Evaluations that can be the first over some threshold of `least` or more, each higher than all before it: how many each
        text has, and j and value of them, text by text."""
        n, texts, js, ds = np.zeros(self.count, dtype=np.int64), [], [], []
        for of, _, d, coll in self.parts:
            x = np.where(coll, -np.inf, sign * d[0])
            top = np.maximum.accumulate(np.c_[np.full(len(of), least), x], axis=1)[:, :-1]
            rows, cols = np.nonzero(x > top)
            n[of] = np.bincount(rows, minlength=len(of))
            texts.append(of[rows])
            js.append(cols + 1)
            ds.append(x[rows, cols])
        whole = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, dtype=kind)
        order = np.argsort(whole(texts, np.int64), kind="stable")
        return n, whole(js, np.int64)[order], whole(ds, np.float64)[order]

    def extremes(self) -> pa.Array:
        """Of each text's evaluations the highest and the lowest that don't collide, and the last: what a detector needs of them."""
        n, texts, js, ds, colls = np.zeros(self.count, dtype=np.int64), [], [], [], []
        for of, own, d, coll in self.parts:
            every, kept = np.arange(len(of)), np.zeros(coll.shape, dtype=bool)
            for end in (np.where(coll, -np.inf, d[0]).argmax(axis=1), np.where(coll, np.inf, d[0]).argmin(axis=1)):
                kept[every, end] = ~coll[every, end]
            kept[every, own - 1] = True
            rows, cols = np.nonzero(kept)
            n[of] = np.bincount(rows, minlength=len(of))
            for column, part in zip((texts, js, ds, colls), (of[rows], cols + 1, d[0][rows, cols], coll[rows, cols])):
                column.append(part)
        whole = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, dtype=kind)
        order = np.argsort(whole(texts, np.int64), kind="stable")
        columns = [pa.array(whole(part, kind)[order].astype(kind)) for part, kind in ((js, np.int32), (ds, np.float64), (colls, bool))]
        return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n)].astype(np.int32)), pa.StructArray.from_arrays(columns, ["j", "d", "coll"]))

    def leanings(self) -> tuple[np.ndarray, ...]:
        """Of each text's evaluations the highest and the lowest that don't collide (infinite if all do), and whether the last one
        leans to Hebrew or collides, and to English or collides."""
        (high, to_hebrew), (low, to_english) = self.summary(0, 1.0), self.summary(0, -1.0)
        return high, -low, to_hebrew, to_english

    def lists(self) -> tuple[np.ndarray, list[pa.Array]]:
        """How many evaluations each text has, and for each way the evaluations (j, d, coll) as lists."""
        n = np.zeros(self.count, dtype=np.int64)
        for of, own, *_ in self.parts:
            n[of] = own
        offsets = np.r_[0, np.cumsum(n)]
        ways = len(self.parts[0][2]) if self.parts else 0
        d, coll, j = np.zeros((ways, offsets[-1])), np.zeros(offsets[-1], dtype=bool), cells(n)[1] + 1
        for of, own, each, hits in self.parts:
            rows, cols = cells(own)
            at = offsets[of][rows] + cols
            coll[at] = hits[rows, cols]
            for way in range(ways):
                d[way, at] = each[way][rows, cols]
        limits = pa.array(offsets.astype(np.int32))
        return n, [pa.ListArray.from_arrays(limits, pa.StructArray.from_arrays([pa.array(j.astype(np.int32)), pa.array(d[way]), pa.array(coll)], ["j", "d", "coll"])) for way in range(ways)]


def judged(shared: Shared, en: pa.Array, he: pa.Array, size: np.ndarray, ways: list[tuple[str, ...]]) -> Judged:
    """The evaluations of pairs in small letters, those of fewer than two characters (`size`, before) without any: d is the Hebrew
    score less the best English one, to nine decimals."""
    tables, lexicon = shared.tables(), shared.lexicon()
    english, hebrew = Texts(en), Texts(he)
    n = np.where((size >= 2) & shared.complete(), english.size - 1, 0)
    parts, known = [], {}
    if n.any():
        known = {name: steps(tables[name], hebrew if name == "he" else english) for name in ("he", *{name for names in ways for name in names})}
    for of, width in classes(n):
        he_score = running(tables["he"], hebrew, of, n[of], width, known=known["he"])
        scores = {name: running(tables[name], english, of, n[of], width, known=known[name]) for name in known if name != "he"}
        best = [scores[names[0]] if len(names) == 1 else np.maximum.reduce([scores[name] for name in names]) for names in ways]
        picked = pa.array(of)
        parts.append((of, n[of], [np.round(he_score - b, 9) for b in best], colliding(en.take(picked), he.take(picked), n[of], width, lexicon)))
    return Judged(len(n), parts)


def scores(table: Table, texts: pa.Array) -> np.ndarray:
    """The score of each text in small letters; those of fewer than four characters have formulas of their own."""
    own, out = Texts(texts), np.zeros(len(texts))
    known = steps(table, own) if (own.size > 3).any() else None
    for of, width in classes(np.maximum(own.size - 3, 0)):
        out[of] = running(table, own, of, own.size[of] - 3, width, 0, known)[np.arange(len(of)), own.size[of] - 4]
    few = np.flatnonzero((own.size == 2) | (own.size == 3))
    rows = np.arange(len(few))
    context, two = table.places(q := fours(table, own, few, rows, np.zeros_like(rows), 0))
    pair = own.size[few] == 2
    out[few] = np.log((np.where(pair, table.c2[two], table.c3[context]) + 1) / (np.where(pair, table.firsts[q[0]], table.c2[two]) + table.v))
    return out


def with_scores(df: DataFrame, wanted: dict[str, tuple[str, str]], models: Models) -> DataFrame:
    """`df` with more columns, each the score of a text column under a model: name -> (model, text). Null if there is none."""
    shared = Shared(df.sparkSession, models, tuple(dict.fromkeys(model for model, _ in wanted.values())))
    sides, columns = list(dict.fromkeys(side for _, side in wanted.values())), df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [batch.column(name) for name in columns]
            for model, side in wanted.values():
                texts, table = batch.column(f"low {side}"), shared.tables().get(model)
                none = np.ones(len(texts), dtype=bool) if table is None else texts.is_null().to_numpy(zero_copy_only=False)
                value = np.zeros(len(texts)) if table is None else scores(table, texts.fill_null(""))
                out.append(pa.array(value, mask=none))
            yield pa.RecordBatch.from_arrays(out, [*columns, *wanted])

    schema = StructType([*df.schema.fields, *(StructField(name, DoubleType()) for name in wanted)])
    return df.select("*", *(F.lower(side).alias(f"low {side}") for side in sides)).mapInArrow(run, schema)


TRACE = "array<struct<j:int,gram:string,c4:long,c3:long,step:double,total:double>>"


def traces(texts: DataFrame, models: Models, model: str) -> DataFrame:
    """text, steps from text and low, the text in small letters: j, gram, c4, c3, step and the running total of each step; the first
    one, j = 0, is the first two characters'."""
    shared = Shared(texts.sparkSession, models, (model,))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not shared.complete():
                return
            table, low = shared.tables()[model], batch.column("low")
            plain, own = low.to_pylist(), Texts(low)
            n = np.maximum(own.size - 3, 0) + 1
            limits = np.r_[0, np.cumsum(n)]
            rows, j = cells(n)
            head, cols = j == 0, np.maximum(j - 1, 0)
            context, two = table.places(q := fours(table, own, np.arange(len(low)), rows, cols, 0))
            step = np.where(head, table.head[two], table.step[context, q[3]])
            total = np.empty(len(step))
            for of, width in classes(n):
                r, c = cells(n[of])
                at = limits[of][r] + c
                m = np.zeros((len(of), width))
                m[r, c] = step[at]
                total[at] = np.cumsum(m, axis=1)[r, c]
            grams = [g for text, m in zip(plain, n.tolist()) for g in (text[:2], *(text[i : i + 4] for i in range(m - 1)))]
            columns = [pa.array(j.astype(np.int32)), pa.array(grams, pa.string()), pa.array(np.where(head, table.c2[two], table.c4[context, q[3]])), pa.array(np.where(head, 0, table.c3[context])), pa.array(step), pa.array(total)]
            steps = pa.ListArray.from_arrays(pa.array(limits.astype(np.int32)), pa.StructArray.from_arrays(columns, ["j", "gram", "c4", "c3", "step", "total"]))
            yield pa.RecordBatch.from_arrays([batch.column("text"), steps], ["text", "steps"])

    return texts.mapInArrow(run, f"text string, steps {TRACE}")

"""Audits of the decision rule over a corpus: every distinct word is scored once, a line is a fold over its words.

On the other layout active text and shadow change places, so the difference of scores only changes its sign and collisions
stay: the state of a replay is (layout, words since the last reset, correctable tail), and no model is needed in it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphshift import constants as K
from glyphshift.functions import text as T
from glyphshift.operators.counting import cut_lines, put_together
from glyphshift.operators.ngrams import Models
from glyphshift.operators.tables import SLICE, Judged, Shared, cells, classes, judged, other_layout, strung

LINE = ("doc_id", "lang", "line_no")
#: Bytes of lines that are put together before they are cut into words: about a slice of these.
BYTES = 8 * SLICE


def forms(words: DataFrame, lang: str = "en", *keys: str) -> DataFrame:
    """keys, word, en, he: a word of either language as both layouts give it."""
    other = T.shadow("word", "en_to_he" if lang == "en" else "he_to_en")
    return words.select(*keys, "word", *((F.col("word").alias("en"), other.alias("he")) if lang == "en" else (other.alias("en"), F.col("word").alias("he"))))


def word_buffers(words: DataFrame, lang: str = "en", *keys: str) -> DataFrame:
    """keys, word, layout, active, shadow: what a word's keys give on either layout."""
    both = forms(words, lang, *keys)
    sides = F.array(F.struct(F.lit("en").alias("layout"), F.col("en").alias("active"), F.col("he").alias("shadow")), F.struct(F.lit("he").alias("layout"), F.col("he").alias("active"), F.col("en").alias("shadow")))
    return both.select(*keys, "word", F.explode(sides).alias("b")).select(*keys, "word", "b.*")


def evaluations(pairs: DataFrame, models: Models, collisions: DataFrame, english: tuple[str, ...] = ("en",)) -> DataFrame:
    """en, he, evals: of each distinct pair of texts of equal length, the evaluations (j, d, coll) in order. j counts from 1:
    the last is that on the delimiter, those before are at j + 2 characters. d is the Hebrew score less the best English one,
    to nine decimals; coll is whether either text up to there is in the collision set."""
    return evaluations_by_way(pairs, models, collisions, {"own": english}).withColumnRenamed("evals_own", "evals")


def evaluations_by_way(pairs: DataFrame, models: Models, collisions: DataFrame, ways: dict[str, tuple[str, ...]]) -> DataFrame:
    """en, he, and evals_<way> for each of several sets of English models, place by place the best of the way's."""
    shared = share(models, collisions, ways)
    distinct = pairs.select("en", "he").where("length(en) >= 2").distinct()
    each = list(ways.values())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            en, he = batch.column("low_en"), batch.column("low_he")
            found = judged(shared, en, he, np.full(batch.num_rows, 2), each)
            n, lists = found.lists()
            if n.any():
                yield pa.RecordBatch.from_arrays([batch.column("en"), batch.column("he"), *lists], ["en", "he", *(f"evals_{way}" for way in ways)]).filter(pa.array(n > 0))

    schema = ", ".join(("en string, he string", *(f"evals_{way} array<struct<j:int,d:double,coll:boolean>>" for way in ways)))
    return distinct.withColumns({"low_en": F.lower("en"), "low_he": F.lower("he")}).mapInArrow(run, schema)


def share(models: Models, collisions: DataFrame, ways: dict[str, tuple[str, ...]]) -> Shared:
    """What the tasks need to evaluate words under the models of the ways."""
    return Shared(collisions.sparkSession, models, ("he", *sorted({name for names in ways.values() for name in names})), collisions)


def first_over(evals: Column, sign: Column, threshold: Column) -> Column:
    """The first evaluation that triggers, or null."""
    return F.get(F.filter(evals, lambda e: ~e["coll"] & (sign * e["d"] > threshold)), 0)


def first_trigger(words: DataFrame, scored: DataFrame, delta: float = K.DEFAULTS.baseline, lang: str = "en") -> DataFrame:
    """word, idx (place of the character that triggers, -1 on the delimiter, null if none), diff: on the word's own layout."""
    return first_triggers(forms(words.select("word").distinct(), lang).join(scored, ["en", "he"], "left"), delta, lang)


def word_triggers(words: DataFrame, models: Models, collisions: DataFrame, delta: float = K.DEFAULTS.baseline, lang: str = "en") -> DataFrame:
    """The same, of words that are evaluated where they lie: evaluations aren't shuffled."""
    shared = share(models, collisions, {"own": ("en",)})
    both = forms(words.select("word").distinct(), lang).select("word", F.length("en").alias("size"), F.lower("en").alias("en"), F.lower("he").alias("he"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, lists = judged(shared, batch.column("en"), batch.column("he"), batch.column("size").to_numpy(), [("en",)]).lists()
            if n.any():
                yield pa.RecordBatch.from_arrays([batch.column("word"), *lists], ["word", "evals"])
            else:
                yield pa.RecordBatch.from_arrays([batch.column("word"), pa.nulls(len(n), EVALS)], ["word", "evals"])

    return first_triggers(both.mapInArrow(run, "word string, evals array<struct<j:int,d:double,coll:boolean>>"), delta, lang)


EVALS = pa.list_(pa.struct([("j", pa.int32()), ("d", pa.float64()), ("coll", pa.bool_())]))


def first_triggers(evaluated: DataFrame, delta: float, lang: str) -> DataFrame:
    hit = first_over(F.col("evals"), F.lit(1.0 if lang == "en" else -1.0), F.lit(float(delta)))
    return evaluated.withColumn("hit", hit).select("word", trigger_place(F.col("hit"), F.length("word")).alias("idx"), F.col("hit.d").alias("diff"))


def trigger_place(hit: Column, size: Column) -> Column:
    return F.when(hit["j"] == size - 1, F.lit(-1)).otherwise(hit["j"] + 1)


def line_words(lines: DataFrame) -> DataFrame:
    """doc_id, lang, line_no, w, word: the words of each line by place."""
    return lines.select(*LINE, F.posexplode(T.split_words("line")).alias("w", "word"))


RECORDS = "array<struct<j:int,d:double>>"


def records(evals: Column, sign: float, least: float) -> Column:
    """Of a word's evaluations those that can be the first over some threshold of `least` or more: each is higher than all
    before it."""
    zero = F.struct(F.lit(least).alias("top"), F.array().cast(RECORDS).alias("kept"))

    def step(acc: Column, e: Column) -> Column:
        d = F.lit(sign) * e["d"]
        higher = F.struct(d.alias("top"), F.concat(acc["kept"], F.array(F.struct(e["j"].alias("j"), d.alias("d")))).alias("kept"))
        return F.when(~e["coll"] & (d > acc["top"]), higher).otherwise(acc)

    return F.aggregate(evals, zero, step, lambda acc: acc["kept"])


#: The way of a state that takes each line's own: that of the line's `mode`, if it has one of the ways' names, else the first.
BY_MODE = "by mode"
#: What is told of an event: the state before the word (on the right layout or not, k, correctable tail), what came of it, and
#: whether a repair shows the word as the other layout gives it.
EVENT = {
    "w": pa.int32(), "word": pa.string(), "size": pa.int32(), "correct": pa.bool_(), "k": pa.int32(), "tail": pa.int32(),
    "switched": pa.bool_(), "idx": pa.int32(), "diff": pa.float64(), "swap": pa.bool_(),
}
DDL = {pa.int32(): "int", pa.string(): "string", pa.bool_(): "boolean", pa.float64(): "double"}
COUNTS = {"n_words": "long", "fp_count": "long", "recovery_count": "long", "line_switched": "boolean", "latency": "long", "words_not_switched": "long"}


def replay(lines: DataFrame, scored: DataFrame, lang: str = "en", wrong: bool = False, params: K.Params = K.DEFAULTS) -> DataFrame:
    """doc_id, lang, line_no, events, state: each line's words in order, as typed by someone who starts on the right or the wrong
    layout, judged by the evaluations `scored` (en, he, evals)."""
    placed = lines.select(*LINE, F.posexplode(T.split_words("line")).alias("w", "word"))
    met = placed.join(forms(placed.select("word").distinct(), lang).join(scored, ["en", "he"]), "word", "left")
    gathered = met.groupBy(*LINE).agg(F.array_sort(F.collect_list(F.struct("w", "word", "evals"))).alias("x")).select(*LINE, F.col("x.word").alias("words"), F.col("x.evals").alias("evals"))
    done = folded(gathered, LINE, gathered_words, ("own",), {"state": (wrong, "own")}, lang, params, tuple(EVENT), False)
    return done.select(*LINE, F.col("state.events").alias("events"), "state")


def replay_states(
    lines: DataFrame, models: Models, collisions: DataFrame, ways: dict[str, tuple[str, ...]], states: dict[str, tuple[bool, str]], lang: str = "en",
    params: K.Params = K.DEFAULTS, fields: tuple[str, ...] = (), switches: bool = True,
) -> DataFrame:
    """doc_id, lang, line_no (and mode, if lines have one), and for each state its counts and, of `fields`, its events (or only the
    switches): a state begins on the right or the wrong layout and judges by a way, English models by name. Lines stay in their
    rows: a task scores the distinct words of a slice and holds the lines against them."""
    keys = (*LINE, "mode") if "mode" in lines.columns else LINE
    split = words_of_lines(share(models, collisions, ways), list(ways.values()), keys, lang)
    return folded(lines.select(*keys, "line"), keys, split, tuple(ways), states, lang, params, fields, switches)


def words_of_lines(shared: Shared, ways: list[tuple[str, ...]], keys: tuple[str, ...], lang: str):  # noqa: ANN201
    """What splits batches of lines: keys, numbers of words, words, and these as numbers of distinct words with their sizes and
    evaluations, a slice at a time. White space is that of `split_words`."""

    def distinct(words: pa.Array) -> tuple[np.ndarray, np.ndarray, Judged]:
        coded = words.dictionary_encode()
        whole = strung(coded.dictionary, "\n")
        own, shown = (pa.array(side.lower().split("\n"), pa.string()) for side in (whole, other_layout(whole, lang == "en")))
        size = pc.utf8_length(coded.dictionary).to_numpy().astype(np.int64)
        return coded.indices.to_numpy().astype(np.int64), size, judged(shared, *((own, shown) if lang == "en" else (shown, own)), size, ways)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[pa.Array], np.ndarray, pa.Array, tuple]]:
        for batch in put_together(batches, lambda batch: batch.column("line").nbytes, BYTES):
            n, words = cut_lines(batch.column("line").fill_null(""))
            upto = np.r_[0, np.cumsum(n)]
            for begin, end in slices(n):
                own = np.flatnonzero(n[begin:end]) + begin
                if len(own):
                    flat = words.slice(upto[begin], upto[end] - upto[begin])
                    yield [batch.column(name).take(pa.array(own)) for name in keys], n[own], flat, distinct(flat)

    return split


def evaluated_lines(lines: DataFrame, models: Models, collisions: DataFrame, keys: tuple[str, ...], lang: str = "en") -> DataFrame:
    """keys, words (word, evals): each line's words in order, with the evaluations that a detector needs (`Judged.extremes`)."""
    split = words_of_lines(share(models, collisions, {"own": ("en",)}), [("en",)], keys, lang)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own_keys, n, words, (ids, _, found) in split(batches):
            pairs = pa.StructArray.from_arrays([words, found.extremes().take(pa.array(ids))], ["word", "evals"])
            yield pa.RecordBatch.from_arrays([*own_keys, pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n)].astype(np.int32)), pairs)], [*keys, "words"])

    kinds = dict(lines.dtypes)
    return lines.select(*keys, "line").mapInArrow(run, ", ".join([*(f"{name} {kinds[name]}" for name in keys), "words array<struct<word:string,evals:array<struct<j:int,d:double,coll:boolean>>>>"]))


def gathered_words(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[pa.Array], np.ndarray, pa.Array, tuple]]:
    """Lines that carry their words and the words' evaluations."""
    for batch in batches:
        words = batch.column("words").flatten()
        n = pc.list_value_length(batch.column("words")).to_numpy().astype(np.int64)
        yield [batch.column(name) for name in LINE], n, words, carried(words, batch.column("evals").flatten())


def carried(words: pa.Array, evals: pa.Array) -> tuple[np.ndarray, np.ndarray, Judged]:
    """Words by place, as numbers of themselves, with the evaluations given."""
    n = np.nan_to_num(pc.list_value_length(evals).to_numpy(zero_copy_only=False)).astype(np.int64)
    flat = evals.flatten()
    d, coll = flat.field("d").to_numpy(zero_copy_only=False), flat.field("coll").to_numpy(zero_copy_only=False)
    begins, parts = np.cumsum(n) - n, []
    for of, width in classes(n):
        rows, cols = cells(n[of])
        ds, colls = np.zeros((len(of), width)), np.ones((len(of), width), dtype=bool)
        ds[rows, cols], colls[rows, cols] = d[begins[of][rows] + cols], coll[begins[of][rows] + cols]
        parts.append((of, n[of], [ds], colls))
    return np.arange(len(words)), pc.utf8_length(words).to_numpy().astype(np.int64), Judged(len(words), parts)


def slices(n: np.ndarray) -> Iterator[tuple[int, int]]:
    """Lines of n words each, about SLICE words at a time."""
    upto, at = np.cumsum(n), 0
    while at < len(n):
        before = upto[at - 1] if at else 0
        end = max(int(np.searchsorted(upto, before + SLICE, side="right")), at + 1)
        yield at, end
        at = end


def folded(lines: DataFrame, keys: tuple[str, ...], split, ways: tuple[str, ...], states: dict[str, tuple[bool, str]], lang: str, params: K.Params, fields: tuple[str, ...], switches: bool) -> DataFrame:  # noqa: ANN001
    """Lines held against the evaluations of their words. `split` makes of batches keys, numbers of words, words, and these as numbers of
    distinct words with their sizes and evaluations."""
    sign = 1.0 if lang == "en" else -1.0
    events = [f"events:array<struct<{','.join(f'{name}:{DDL[EVENT[name]]}' for name in fields)}>>"] if fields else []
    state = f"struct<{','.join([*(f'{name}:{kind}' for name, kind in COUNTS.items()), *events])}>"
    kept = {field.name: field.dataType.simpleString() for field in lines.schema if field.name in keys}
    schema = ", ".join([*(f"{name} {kept[name]}" for name in keys), *(f"`{name}` {state}" for name in states)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own_keys, n, words, (ids, size, found) in split(batches):
            short = size < 2
            tops, fixes = np.empty((len(ways), 2, len(size))), np.empty((len(ways), 2, len(size)), dtype=bool)
            for way in range(len(ways)):
                for own in (0, 1):
                    tops[way, own], fix = found.summary(way, sign if own else -sign)
                    fixes[way, own] = short | fix
            own_way, modes = {}, {name: place for place, name in enumerate(ways)}
            for way in {way for _, way in states.values()}:
                own_way[way] = np.array([modes.get(mode, 0) for mode in own_keys[keys.index("mode")].to_pylist()], dtype=np.int64) if way == BY_MODE else np.full(len(n), ways.index(way))
            # The lines in all states are held at once.
            mine, times = [own_way[way] for _, way in states.values()], len(states)
            begun = np.repeat([wrong for wrong, _ in states.values()], len(n))
            held = [np.split(column, times) for column in hold(np.tile(n, times), np.tile(ids, times), np.concatenate(mine), begun, tops, fixes, params)]
            out = [told(words, n, ids, size, found, mine[i], tuple(column[i] for column in held), sign, params, fields, switches) for i in range(times)]
            yield pa.RecordBatch.from_arrays([*own_keys, *out], [*keys, *states])

    return lines.mapInArrow(run, schema)


def deltas(upto: int, params: K.Params) -> np.ndarray:
    """The thresholds after 0 to `upto` words."""
    return params.baseline + params.alpha * np.power(np.arange(upto + 1, dtype=np.float64), params.p)


def hold(n: np.ndarray, ids: np.ndarray, way: np.ndarray, wrong: np.ndarray, tops: np.ndarray, fixes: np.ndarray, params: K.Params) -> tuple[np.ndarray, ...]:
    """correct, k, tail and switched at each word of lines of n words, all lines a word at a time, each begun on the right or the wrong
    layout. tops and fixes are by way, by layout (the other one, the own) and by word."""
    order = np.argsort(-n, kind="stable")
    active = np.searchsorted(-n[order], -np.arange(int(n.max(initial=0))), side="left")
    # Words lie by their place in a line, so that a step reads and writes what lies together.
    rank = np.empty(len(n), dtype=np.int64)
    rank[order] = np.arange(len(n))
    line, w = cells(n)
    place = (np.cumsum(active) - active)[w] + rank[line]
    own = np.empty(len(ids), dtype=np.int64)
    own[place] = ids + (way * 2 * tops.shape[2])[line]
    tops, fixes, width, limits = tops.ravel(), fixes.ravel(), tops.shape[2], deltas(int(n.max(initial=0)), params)
    correct, k, tail = ~wrong[order], np.zeros(len(n), dtype=np.int32), np.zeros(len(n), dtype=np.int32)
    out = np.empty(len(ids), dtype=bool), np.empty(len(ids), dtype=np.int32), np.empty(len(ids), dtype=np.int32), np.empty(len(ids), dtype=bool)
    begin = 0
    for m in active:
        at = own[begin : begin + m] + width * correct[:m]
        switched = tops[at] > limits[k[:m]]
        for column, value in zip(out, (correct[:m], k[:m], tail[:m], switched)):
            column[begin : begin + m] = value
        correct[:m] ^= switched
        k[:m] = np.where(switched, 0, k[:m] + 1)
        tail[:m] = np.where(fixes[at] & ~switched, np.minimum(tail[:m] + 1, K.HISTORY), 0)
        begin += m
    return tuple(column[place] for column in out)


def told(words: pa.Array, n: np.ndarray, ids: np.ndarray, size: np.ndarray, found: Judged, way: np.ndarray, held: tuple[np.ndarray, ...], sign: float, params: K.Params, fields: tuple[str, ...], switches: bool) -> pa.Array:
    """A state's counts (of a line typed on the right layout, and of one on the wrong layout) and events."""
    correct, k, tail, switched = held
    line, w = cells(n)
    begin, long = np.cumsum(n) - n, size[ids]
    hit = np.flatnonzero(switched)
    j, value = found.first_over(ids[hit], way[line[hit]], np.where(correct[hit], sign, -sign), deltas(int(n.max(initial=0)), params)[k[hit]])
    idx = np.full(len(ids), -1)
    idx[hit] = np.where(j == long[hit] - 1, -1, j + 1)
    total = lambda x: np.add.reduceat(x.astype(np.int64), begin) if len(begin) else np.zeros(0, dtype=np.int64)
    back = switched & ~correct
    some = total(back) > 0
    late = np.where(correct, 0, np.where(idx == -1, long + 1, idx + 1))
    missed = np.where(back, np.maximum(w - tail, 0), 0)
    counts = n, total(switched & correct), total(back), some, np.where(some, total(late), total(long + 1)), np.where(some, total(missed), n)
    out, names = [pa.array(c) for c in counts], list(COUNTS)
    if fields:
        of = hit if switches else np.arange(len(ids))
        made = {
            "w": lambda: w[of], "size": lambda: long[of], "correct": lambda: correct[of], "k": lambda: k[of], "tail": lambda: tail[of], "switched": lambda: switched[of],
            "swap": lambda: shown_swapped(correct, tail, switched)[of],
        }
        columns = []
        for name in fields:
            if name == "word":
                columns.append(words.take(pa.array(of)))
            elif name in ("idx", "diff"):
                values = np.zeros(len(ids))
                values[hit] = idx[hit] if name == "idx" else value
                columns.append(pa.array(values[of], mask=~switched[of]).cast(EVENT[name]))
            else:
                columns.append(pa.array(made[name]()).cast(EVENT[name]))
        limits = np.r_[0, np.cumsum(total(switched) if switches else n)].astype(np.int32)
        out.append(pa.ListArray.from_arrays(pa.array(limits), pa.StructArray.from_arrays(columns, list(fields))))
        names.append("events")
    return pa.StructArray.from_arrays(out, names)


def shown_swapped(correct: np.ndarray, tail: np.ndarray, switched: np.ndarray) -> np.ndarray:
    """Whether a repair shows a word as the other layout gives it: it was typed there, but for the words that a switch corrects. No
    word is corrected twice, as a tail begins behind the switch before."""
    at = np.flatnonzero(switched)
    turns = np.zeros(len(switched) + 1, dtype=np.int64)
    np.add.at(turns, at - tail[at], 1)
    np.add.at(turns, at, -1)
    out = ~correct ^ (np.cumsum(turns)[:-1] > 0)
    out[at] = correct[at]
    return out


def fp_counts(state: str = "state") -> list[Column]:
    """n_words, fp_count, recovery_count of a line typed on the right layout."""
    return [F.col(f"{state}.{name}") for name in ("n_words", "fp_count", "recovery_count")]


def fn_counts(state: str = "state") -> list[Column]:
    """n_words, line_switched, latency, words_not_switched of a line typed on the wrong layout."""
    return [F.col(f"{state}.{name}") for name in ("n_words", "line_switched", "latency", "words_not_switched")]


def fp_sums(of: str = "") -> list[Column]:
    return [
        F.count(F.lit(1)).alias("lines_tested"), F.sum(f"{of}n_words").alias("words_tested"), F.sum(f"{of}fp_count").alias("fp_count"), F.sum(f"{of}recovery_count").alias("recovery_count"), F.count_if(F.col(f"{of}fp_count") > 0).alias("lines_with_fp"),
    ]


def fn_sums(of: str = "") -> list[Column]:
    return [F.count_if(F.col(f"{of}line_switched")).alias("lines_switched"), F.sum(f"{of}words_not_switched").alias("words_not_switched"), F.sum(f"{of}latency").alias("total_latency_chars")]


def audit_fp(replayed: DataFrame) -> DataFrame:
    """doc_id, lang, line_no, n_words, fp_count, recovery_count of lines typed on the right layout."""
    return replayed.select(*LINE, *fp_counts())


def fp_report(audited: DataFrame) -> DataFrame:
    return audited.groupBy("lang").agg(*fp_sums())


def audit_fn(replayed: DataFrame) -> DataFrame:
    """doc_id, lang, line_no, n_words, line_switched, latency, words_not_switched of lines typed on the wrong layout."""
    return replayed.select(*LINE, *fn_counts())


def fn_report(audited: DataFrame) -> DataFrame:
    return audited.groupBy("lang").agg(F.count(F.lit(1)).alias("lines_tested"), F.sum("n_words").alias("words_tested"), *fn_sums())


def reports(replayed: DataFrame, versions: list[str], *keys: str) -> DataFrame:
    """version, keys and the columns of both reports, from the states <version>_fp and <version>_fn, in one grouping."""
    lines = replayed.select(*keys, *(part for v in versions for part in (F.struct(*fp_counts(f"{v}_fp")).alias(f"{v}_fp"), F.struct(*fn_counts(f"{v}_fn")).alias(f"{v}_fn"))))
    sums = [column for v in versions for column in (*(c.alias(f"{v} {name}") for c, name in zip(fp_sums(f"{v}_fp."), FP_REPORT)), *(c.alias(f"{v} {name}") for c, name in zip(fn_sums(f"{v}_fn."), FN_REPORT)))]
    totals = lines.groupBy(*keys).agg(*sums)
    each = F.array(*(F.struct(F.lit(v).alias("version"), *(F.col(f"`{v} {name}`").alias(name) for name in (*FP_REPORT, *FN_REPORT))) for v in versions))
    return totals.select(*keys, F.explode(each).alias("r")).select("r.version", *keys, *(f"r.{name}" for name in (*FP_REPORT, *FN_REPORT)))


FP_REPORT = ("lines_tested", "words_tested", "fp_count", "recovery_count", "lines_with_fp")
FN_REPORT = ("lines_switched", "words_not_switched", "total_latency_chars")


def both_starts(*ways: str) -> dict[str, tuple[bool, str]]:
    """The states of both reports for each way: begun on the right layout, and on the wrong one."""
    return {f"{way}_{kind}": (wrong, way) for way in ways for kind, wrong in (("fp", False), ("fn", True))}


def latency_summary(audited: DataFrame) -> DataFrame:
    """lang, n, mean, median, p95. The 95th percentile is the value at place min(int(0.95 n), n - 1): the values are counted
    first, so that what is ordered is distinct values, not lines."""
    counts = audited.groupBy("lang", "latency").agg(F.count(F.lit(1)).alias("m"))
    order = Window.partitionBy("lang").orderBy("latency").rowsBetween(Window.unboundedPreceding, 0)
    placed = counts.withColumns({"upto": F.sum("m").over(order), "n": F.sum("m").over(Window.partitionBy("lang"))})
    at = lambda place: F.min(F.when(F.col("upto") > place, F.col("latency")))
    p95 = F.least(F.floor(F.col("n") * 0.95), F.col("n") - 1)
    return placed.groupBy("lang", "n").agg(
        F.round(F.sum(F.col("latency") * F.col("m")) / F.col("n"), 6).alias("mean"),
        ((at(F.floor((F.col("n") - 1) / 2)) + at(F.floor(F.col("n") / 2))) / 2).alias("median"),
        at(p95).alias("p95"),
    )


def percent(a: str, b: str) -> Column:
    return F.round(F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0)) * 100, 6)


def fp_percents() -> list[Column]:
    return [percent("fp_count", "words_tested").alias("fp_percent"), percent("lines_with_fp", "lines_tested").alias("lines_with_fp_percent")]


def fn_percents() -> list[Column]:
    return [percent("lines_switched", "lines_tested").alias("lines_switched_percent"), percent("words_not_switched", "words_tested").alias("words_not_switched_percent")]


def fp_rates(report: DataFrame) -> DataFrame:
    return report.select("lang", *fp_percents())


def fn_rates(report: DataFrame) -> DataFrame:
    return report.select("lang", *fn_percents())


def fp_details(state: str, params: K.Params = K.DEFAULTS) -> Column:
    """For each switch its word and lookback, for false ones also the signed difference and the threshold."""
    gap = lambda e: F.concat_ws(" ", F.concat(F.lit("diff="), F.format_string("%+.2f", e["diff"])), F.concat(F.lit("delta="), F.format_string("%.2f", T.delta(e["k"], params))))
    details = F.transform(
        F.col(f"{state}.events"),
        lambda e: F.concat_ws(" ", F.when(e["correct"], "FP").otherwise("Recovery"), (e["w"] + 1).cast("string"), e["word"], F.when(e["correct"], gap(e)), F.concat(F.lit("lookback="), e["tail"].cast("string"))),
    )
    return F.array_join(details, "; ")


def fn_details(state: str) -> Column:
    """The word of the first switch, the latency and the uncorrected words, or that there was no switch and the characters lost."""
    counts = F.col(state)
    first = F.get(F.filter(counts["events"], lambda e: ~e["correct"]), 0)
    mark = lambda name, c: F.concat(F.lit(f"{name}="), c.cast("string"))
    late = F.concat_ws(" ", F.lit("switch"), (first["w"] + 1).cast("string"), first["word"], mark("latency", counts["latency"]), mark("uncorrected", counts["words_not_switched"]))
    return F.when(counts["line_switched"], late).otherwise(F.concat_ws(" ", F.lit("no switch"), mark("lost", counts["latency"])))


def flagged(replayed: DataFrame, lines: DataFrame, n: int = 30, params: K.Params = K.DEFAULTS, fp: str = "own_fp", fn: str = "own_fn") -> DataFrame:
    """kind, doc_id, line_no, excerpt, details: the first n lines with a false positive (`fp`), and the first n typed on the wrong
    layout that never switch or leave words uncorrected (`fn`). Both are ranked in one pass; each task sends n at most."""
    missed = F.col(fn)
    bad = F.array_compact(F.array(
        F.when(F.col(f"{fp}.fp_count") > 0, F.struct(F.lit("fp").alias("kind"), fp_details(fp, params).alias("details"))),
        F.when(~missed["line_switched"] | (missed["words_not_switched"] > 0), F.struct(F.lit("fn").alias("kind"), fn_details(fn).alias("details"))),
    ))
    every = replayed.select("doc_id", "line_no", F.explode(bad).alias("x")).select("x.kind", "doc_id", "line_no", "x.details")
    order = Window.partitionBy("kind").orderBy("doc_id", "line_no")
    first = every.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)
    return lines.select("doc_id", "line_no", F.substring("line", 1, 100).alias("excerpt")).join(F.broadcast(first), ["doc_id", "line_no"]).select("kind", "doc_id", "line_no", "excerpt", "details")


def lookback(replayed: DataFrame) -> DataFrame:
    """doc_id, lang, line_no, w, lookback: the words that a switch at word w corrects with it, from a replay's switches."""
    return replayed.select(*LINE, F.explode("state.events").alias("e")).select(*LINE, "e.w", F.col("e.tail").alias("lookback"))


def repair(replayed: DataFrame, lang: str = "en") -> DataFrame:
    """doc_id, lang, line_no, repaired: words as the layout of the time gives them, and where a switch triggers, it and the
    correctable words before it as they were meant on the layout switched to. From all events of a replay."""
    direction = "en_to_he" if lang == "en" else "he_to_en"
    return replayed.select(*LINE, F.array_join(F.transform("state.events", lambda e: F.when(e["swap"], T.shadow(e["word"], direction)).otherwise(e["word"])), " ").alias("repaired"))


def audit_compare(lines: DataFrame, models: Models, collisions: DataFrame, ways: dict[str, tuple[str, ...]], lang: str = "en", params: K.Params = K.DEFAULTS) -> DataFrame:
    """Both reports under several sets of English models, the ways: version, lang and the columns of the false-positive and
    false-negative reports. All are replayed over the lines at once."""
    return reports(replay_states(lines, models, collisions, ways, both_starts(*ways), lang, params), list(ways), "lang")

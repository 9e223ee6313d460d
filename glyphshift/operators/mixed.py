"""Mixed-language audits: script runs, valid typing, the trap at the last run, and the parameter grid.

Runs, segments and words stay in the row of their text: a task scores the distinct words of a slice of samples and leaves of each
sample the few evaluations that can trigger. All settings of the grid are held against them in the same pass, in which a task adds
up a counter for each setting.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphshift import constants as K
from glyphshift.functions import text as T
from glyphshift.operators.audit import records, share
from glyphshift.operators.joins import hot_limit, join_back
from glyphshift.operators.ngrams import Models
from glyphshift.operators.tables import Shared, cells, classes, judged, other_layout, strung
from glyphshift.session import stored

HEBREW = "\\u0590-\\u05FF"
RUN = "struct<lang:string,start:int,chunk:string>"


def text_runs(texts: DataFrame, lead_fix: bool = False) -> DataFrame:
    """sample_id, runs (lang, start, chunk): maximal runs of one script; other characters go with what is before them. The
    first character counts as English, whatever it is, unless `lead_fix`. A Hebrew run goes on to the next English letter, and
    an English one to the next Hebrew character."""
    lead = "" if lead_fix else f"\\A(?s:.)[^{HEBREW}]*|"
    chunks = texts.where("length(text) > 0").select("sample_id", F.regexp_extract_all("text", F.lit(f"{lead}[{HEBREW}][^A-Za-z]*|[^{HEBREW}]+"), F.lit(0)).alias("chunks"))
    state = F.struct(F.lit(0).alias("at"), F.lit(not lead_fix).alias("forced"))

    def step(state, chunk):
        lang = F.when(~state["forced"] & chunk.rlike(f"^[{HEBREW}]"), "he").otherwise("en")
        return F.struct((state["at"] + F.length(chunk)).alias("at"), F.lit(False).alias("forced")), F.struct(lang.alias("lang"), state["at"].alias("start"), chunk.alias("chunk"))

    return chunks.select("sample_id", T.running("chunks", state, step, RUN).alias("runs"))


def script_runs(texts: DataFrame, lead_fix: bool = False) -> DataFrame:
    """sample_id, run, lang, start, chunk: a row a run."""
    return text_runs(texts, lead_fix).select("sample_id", F.posexplode("runs").alias("run", "r")).select("sample_id", "run", "r.lang", "r.start", "r.chunk")


def segments(runs: DataFrame, trap: bool) -> DataFrame:
    """sample_id, seg, layout, start, trap_at, en, he: a row a segment of `segment_lists`."""
    return segment_lists(runs, trap).select("sample_id", F.posexplode("segs").alias("seg", "s")).select("sample_id", "seg", "s.*")


def segment_lists(runs: DataFrame, trap: bool, *kept: str) -> DataFrame:
    """sample_id, segs (layout, start, trap_at, en, he): what is typed between resets, as both layouts have it, from `text_runs`. In
    the trap the last run is typed on the layout of the run before, without a reset: the two are one segment. Samples of one run
    go."""

    def typed(r):
        english = r["lang"] == "en"
        en, he = F.when(english, r["chunk"]).otherwise(T.shadow(r["chunk"], "he_to_en")), F.when(english, T.shadow(r["chunk"])).otherwise(r["chunk"])
        return F.struct(r["lang"].alias("layout"), r["start"].alias("start"), F.lit(None).cast("int").alias("trap_at"), en.alias("en"), he.alias("he"))

    segs = runs.where("size(runs) > 1").select("sample_id", *kept, F.transform("runs", typed).alias("segs"))
    if trap:
        a, b = F.try_element_at("segs", F.lit(-2)), F.try_element_at("segs", F.lit(-1))
        fused = F.struct(a["layout"].alias("layout"), a["start"].alias("start"), b["start"].alias("trap_at"), F.concat(a["en"], b["en"]).alias("en"), F.concat(a["he"], b["he"]).alias("he"))
        segs = segs.select("sample_id", *kept, F.concat(F.slice("segs", F.lit(1), F.greatest(F.size("segs") - 2, F.lit(0))), F.array(fused)).alias("segs"))
    return segs


#: A word's delimiters.
CUT = "[ \\n\\t]"


def segment_words(segs: DataFrame) -> DataFrame:
    """sample_id, seg, layout, trap_at, k, at, ended, en, he: the words of a segment between blanks, newlines and tabs. k counts
    the words before, at is the place of the first character in the sample, ended is whether a delimiter follows."""
    cut = lambda c: F.split(c, CUT)
    pairs = F.arrays_zip(cut("en").alias("en"), cut("he").alias("he"))

    def step(state, x):
        after = F.struct((state["at"] + F.length(x["en"]) + 1).alias("at"), F.when(x["en"] != "", state["k"] + 1).otherwise(state["k"]).alias("k"))
        return after, F.struct(state["k"].alias("k"), state["at"].alias("at"), x["en"].alias("en"), x["he"].alias("he"))

    words = T.running(pairs, F.struct(F.col("start").alias("at"), F.lit(0).alias("k")), step, "struct<k:int,at:int,en:string,he:string>")
    folded = segs.select("sample_id", "seg", "layout", "trap_at", words.alias("words"))
    every = folded.select("sample_id", "seg", "layout", "trap_at", F.size("words").alias("n"), F.posexplode("words").alias("i", "w"))
    return every.select("sample_id", "seg", "layout", "trap_at", "w.k", "w.at", (F.col("i") < F.col("n") - 1).alias("ended"), "w.en", "w.he").where("en != ''")


def candidates(words: DataFrame, scored: DataFrame, least: float = 0.0, prune: bool = True) -> DataFrame:
    """sample_id, pos, k, d: evaluations that could trigger over a threshold of `least` or more. pos is the number of characters
    typed by then. A threshold stays the same within a word, so only those above all before them in it can be the first
    (`prune`). Words without any go before they are joined; very common ones meet theirs where they lie."""
    every = lambda sign: F.transform(F.filter("evals", lambda e: ~e["coll"] & (F.lit(sign) * e["d"] > least)), lambda e: F.struct(e["j"].alias("j"), (F.lit(sign) * e["d"]).alias("d")))
    own = (lambda sign: records(F.col("evals"), sign, least)) if prune else every
    counted = words.groupBy("en", "he").agg(F.count(F.lit(1)).alias("n"))
    known = stored(counted.join(scored, ["en", "he"]).select("en", "he", "n", own(1.0).alias("as_en"), own(-1.0).alias("as_he")).withColumn("use", (F.size("as_en") > 0) | (F.size("as_he") > 0)))
    total = known.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    met = join_back(words, known, ["en", "he"], hot_limit(total)).withColumn("e", F.explode(F.when(F.col("layout") == "en", F.col("as_en")).otherwise(F.col("as_he"))))
    end = F.col("e.j") == F.length("en") - 1
    pos = F.col("at") + F.when(end, F.length("en") + 1).otherwise(F.col("e.j") + 2)
    return met.where(~end | F.col("ended")).select("sample_id", pos.alias("pos"), "k", "e.d")


FOUND = "array<struct<pos:int,k:int,d:double>>"


def typed_samples(runs: DataFrame, models: Models, collisions: DataFrame, params: list[K.Params]) -> DataFrame:
    """sample_id, trap_start, total (of `trap_places`), valid, trap: each sample of several runs, and what could trigger under
    `params` (pos, k, d, in order) in valid typing and in the trap."""
    rising = all(s.alpha >= 0 and s.p >= 0 for s in params)
    least = min(s.baseline for s in params) if rising else float("-inf")
    shared = share(models, collisions, {"own": ("en",)})
    last = F.element_at("runs", -1)
    rows = runs.where("size(runs) > 1").select("sample_id", last["start"].alias("trap_start"), (last["start"] + F.length(last["chunk"])).cast("long").alias("total"), "runs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in parts(whole):
                found = could_trigger(batch.column("runs"), shared, least, rising)
                yield pa.RecordBatch.from_arrays([*(batch.column(name) for name in ("sample_id", "trap_start", "total")), *found], ["sample_id", "trap_start", "total", "valid", "trap"])

    return rows.mapInArrow(run, f"sample_id {dict(rows.dtypes)['sample_id']}, trap_start int, total long, valid {FOUND}, trap {FOUND}")


#: Characters of the samples that are held against their words' evaluations at once.
SAMPLES = 1 << 21


def parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch's samples, about SAMPLES characters at a time."""
    upto, at = np.cumsum(batch.column("total").to_numpy()), 0
    while at < batch.num_rows:
        end = max(int(np.searchsorted(upto, (upto[at - 1] if at else 0) + SAMPLES, side="right")), at + 1)
        yield batch.slice(at, end - at)
        at = end


def cut_words(chunks: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """How many words each chunk has between its delimiters, empty ones included, and the words. A delimiter is one byte of UTF-8."""
    offsets = np.frombuffer(chunks.buffers()[1], dtype=np.int32)[chunks.offset : chunks.offset + len(chunks) + 1].astype(np.int64)
    data = np.frombuffer(chunks.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]]
    limits, cut = offsets - offsets[0], (data == 0x20) | (data == 0x0A) | (data == 0x09)
    cuts = np.flatnonzero(cut)
    n = np.diff(np.searchsorted(cuts, limits)) + 1
    # A word ends at a delimiter or with its chunk; bytes behind it are counted without the delimiters.
    ends, inner = np.empty(n.sum(), dtype=np.int64), np.ones(n.sum(), dtype=bool)
    last = np.cumsum(n) - 1
    inner[last] = False
    ends[last], ends[inner] = limits[1:] - np.searchsorted(cuts, limits[1:]), cuts - np.arange(len(cuts))
    return n, pa.StringArray.from_buffers(len(ends), pa.py_buffer(np.r_[0, ends].astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data[~cut])))


def could_trigger(samples: pa.Array, shared: Shared, least: float, rising: bool) -> tuple[pa.Array, pa.Array]:
    """FOUND in valid typing and in the trap of samples, which are lists of two or more runs: evaluations over `least`. Each distinct
    word is judged once for both; the trap's last segment has the same words but that the last of one run and the first of the next
    are one."""
    runs, n_runs = samples.flatten(), pc.list_value_length(samples).to_numpy().astype(np.int64)
    n, words = cut_words(runs.field("chunk"))
    english = pc.equal(runs.field("lang"), "en").to_numpy(zero_copy_only=False)
    begins, starts = np.cumsum(n) - n, runs.field("start").to_numpy().astype(np.int64)
    run = np.repeat(np.arange(len(n)), n)
    # Distinct words of either script, as both layouts have them.
    ids, forms, count = np.empty(len(words), dtype=np.int64), ([], []), 0
    for side in (True, False):
        coded = words.filter(pa.array(english[run] == side)).dictionary_encode()
        ids[english[run] == side] = coded.indices.to_numpy() + count
        whole = strung(coded.dictionary, "\n")
        own, shown = (text.split("\n")[: len(coded.dictionary)] for text in (whole, other_layout(whole, side)))
        forms[0].extend(own if side else shown)
        forms[1].extend(shown if side else own)
        count += len(coded.dictionary)
    # Words of the trap that begin in one run and end in the next.
    later = np.cumsum(n_runs) - 1
    first, second = begins[later] - 1, begins[later]
    empty = pc.equal(pc.binary_length(words), 0).to_numpy(zero_copy_only=False)
    both = ~empty[first] & ~empty[second]
    pairs, place = np.unique(ids[first[both]] * count + ids[second[both]], return_inverse=True)
    for side in forms:
        side.extend([side[a] + side[b] for a, b in zip((pairs // max(count, 1)).tolist(), (pairs % max(count, 1)).tolist())])
    low_en, low_he = (pa.array("\n".join(side).lower().split("\n"), pa.string()) for side in forms)
    size = np.fromiter(map(len, forms[0]), dtype=np.int64, count=len(forms[0]))
    known = judged(shared, low_en, low_he, size, [("en",)])
    own = [known.records(sign, least) for sign in (-1.0, 1.0)]
    valid = in_segments(ids, run, english, starts, size, own, rising)
    merged, segment = ids.copy(), np.arange(len(n))
    merged[first] = np.where(empty[first], ids[second], ids[first])
    merged[first[both]] = count + place
    segment[later] = later - 1
    left = np.ones(len(ids), dtype=bool)
    left[second] = False
    trap = in_segments(merged[left], segment[run[left]], english, starts, size, own, rising)
    sample = np.repeat(np.arange(len(samples)), n_runs)
    return tuple(found_lists(sample, len(samples), *found) for found in (valid, trap))


def in_segments(ids: np.ndarray, seg: np.ndarray, english: np.ndarray, starts: np.ndarray, size: np.ndarray, own: list[tuple[np.ndarray, ...]], rising: bool) -> tuple[np.ndarray, ...]:
    """Segment, pos, k and d of what could trigger where words (numbers) are typed in segments, which have a layout and a start: `own`
    has each word's records on the Hebrew and the English layout. Thresholds are the same within a word, so only those above all
    before them in it can be the first; where they rise with the words of a segment, only those above all before them in the
    segment."""
    n, long = np.bincount(seg, minlength=len(starts)), size[ids]
    begins = (np.cumsum(n) - n)[seg]

    def before(x: np.ndarray) -> np.ndarray:
        upto = np.cumsum(x) - x
        return upto - upto[begins]

    (n_he, j_he, d_he), (n_en, j_en, d_en) = own
    side = english[seg]
    many = np.where(side, n_en[ids], n_he[ids])
    at = np.where(side, (np.cumsum(n_en) - n_en)[ids] + len(j_he), (np.cumsum(n_he) - n_he)[ids])
    word, c = cells(many)
    place = at[word] + c
    j, d = np.r_[j_he, j_en][place], np.r_[d_he, d_en][place]
    end = j == long[word] - 1
    real = ~end | (word - begins[word] < n[seg[word]] - 1)  # the last word of a segment has no delimiter behind it
    word, j, d, end = word[real], j[real], d[real], end[real]
    if rising:
        new = above_before(d, np.bincount(seg[word], minlength=len(starts)))
        word, j, d, end = word[new], j[new], d[new], end[new]
    # k counts the words before that aren't empty.
    pos = (starts[seg] + before(long + 1))[word] + np.where(end, long[word] + 1, j + 2)
    return seg[word], pos, before((long > 0).astype(np.int64))[word], d


def found_lists(sample: np.ndarray, count: int, seg: np.ndarray, pos: np.ndarray, k: np.ndarray, d: np.ndarray) -> pa.Array:
    """FOUND of each of `count` samples, of which a segment's is known."""
    limits = pa.array(np.r_[0, np.cumsum(np.bincount(sample[seg], minlength=count))].astype(np.int32))
    return pa.ListArray.from_arrays(limits, pa.StructArray.from_arrays([pa.array(pos.astype(np.int32)), pa.array(k.astype(np.int32)), pa.array(d)], ["pos", "k", "d"]))


def above_before(d: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Which values are above all before them in their group, of groups of n values each."""
    out, begin = np.zeros(len(d), dtype=bool), np.cumsum(n) - n
    for of, width in classes(n):
        rows, cols = cells(n[of])
        m = np.full((len(of), width + 1), -np.inf)
        m[rows, cols + 1] = d[begin[of][rows] + cols]
        out[begin[of][rows] + cols] = m[rows, cols + 1] > np.maximum.accumulate(m, axis=1)[rows, cols]
    return out


def outcomes(found: DataFrame, params: K.Params = K.DEFAULTS) -> DataFrame:
    """sample_id, pos of the first trigger; none, no row."""
    return found.where(F.col("d") > T.delta("k", params)).groupBy("sample_id").agg(F.min("pos").alias("pos"))


def trap_places(runs: DataFrame) -> DataFrame:
    """sample_id, trap_start, total: where the last run begins, and the number of characters; samples of several runs."""
    last = F.element_at("runs", -1)
    return runs.where("size(runs) > 1").select("sample_id", last["start"].alias("trap_start"), (last["start"] + F.length(last["chunk"])).cast("long").alias("total"))


def grid() -> list[K.Params]:
    return [K.Params(d, a, p) for d in K.GRID_BASELINES for a in K.GRID_ALPHAS for p in K.GRID_POWERS]


def first_pos(found: str, params: K.Params) -> Column:
    """pos of the first trigger among what could trigger, or null."""
    return F.get(F.filter(found, lambda e: e["d"] > T.delta(e["k"], params)), 0)["pos"]


def audit_mixed_valid(typed: DataFrame, params: K.Params = K.DEFAULTS) -> DataFrame:
    """sample_id, status (fp_early, no_switch), chars: each sample of several runs (`typed_samples`), typed on the right layout."""
    joined = typed.select("sample_id", "total", first_pos("valid", params).alias("pos"))
    return joined.select("sample_id", F.when(F.col("pos").isNull(), "no_switch").otherwise("fp_early").alias("status"), F.coalesce("pos", "total").cast("long").alias("chars"))


def audit_mixed_trap(typed: DataFrame, params: K.Params = K.DEFAULTS) -> DataFrame:
    """sample_id, status (caught_trap, fp_early, no_switch), chars, chars_since_trap."""
    joined = typed.select("sample_id", "trap_start", "total", first_pos("trap", params).alias("pos"))
    chars = F.coalesce("pos", "total")
    return joined.select(
        "sample_id",
        F.when(F.col("pos").isNull(), "no_switch").when(F.col("pos") > F.col("trap_start"), "caught_trap").otherwise("fp_early").alias("status"),
        chars.cast("long").alias("chars"),
        F.greatest(chars - F.col("trap_start"), F.lit(0)).cast("long").alias("chars_since_trap"),
    )


NEVER = 2**62


Padded = list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]


def padded(n: np.ndarray, pos: np.ndarray, k: np.ndarray, d: np.ndarray) -> Padded:
    """What could trigger, by samples of similar numbers n of it: which samples, and a row a sample of pos, k and d."""
    begins, out = np.cumsum(n) - n, []
    for of, width in classes(n):
        r, c = cells(n[of])
        at = begins[of][r] + c
        wide = np.full((len(of), width), NEVER), np.zeros((len(of), width)), np.full((len(of), width), -np.inf)
        for m, x in zip(wide, (pos, k, d)):
            m[r, c] = x[at]
        out.append((of, *wide))
    return out


def padded_lists(column: pa.Array) -> Padded:
    n, rows = np.nan_to_num(pc.list_value_length(column).to_numpy(zero_copy_only=False)).astype(np.int64), column.flatten()
    return padded(n, *(rows.field(name).to_numpy(zero_copy_only=False) for name in ("pos", "k", "d")))


def first_passages(pos: np.ndarray, k: np.ndarray, d: np.ndarray, sample: np.ndarray, n: int, alpha: float, p: float, baselines: list[float]) -> np.ndarray:
    """baselines x samples: where d less alpha k^p first exceeds each baseline. Candidates come by sample and place."""
    parts = padded(np.bincount(sample, minlength=n), pos, k, d)
    return passages(parts, [np.power(k, p) for _, _, k, _ in parts], n, alpha, baselines)


def passages(parts: Padded, powers: list[np.ndarray], n: int, alpha: float, baselines: list[float]) -> np.ndarray:
    """The same, with each part's k raised to the power."""
    out = np.full((len(baselines), n), NEVER, dtype=np.int64)
    for (of, pos, _, d), power in zip(parts, powers):
        rise, rows = alpha * power, np.arange(len(of))
        for row, baseline in enumerate(baselines):
            hit = d > baseline + rise
            first = hit.argmax(axis=1)
            out[row, of] = np.where(hit[rows, first], pos[rows, first], NEVER)
    return out


COUNTS = "setting int, fps long, tps long, chars long"


#: The setting under which the samples themselves are counted, in `fps`.
ALL = -1


def grid_counts(places: DataFrame, valid: DataFrame, trap: DataFrame, params: list[K.Params]) -> DataFrame:
    """COUNTS of each setting with any, from rows of what could trigger (sample_id, pos, k, d)."""
    gathered = lambda df, name: df.groupBy("sample_id").agg(F.array_sort(F.collect_list(F.struct("pos", "k", "d"))).alias(name))
    every = gathered(valid, "valid").join(gathered(trap, "trap"), "sample_id", "full").join(places.select("sample_id", "trap_start"), "sample_id")
    return typed_counts(every, params).where(F.col("setting") != ALL)


def typed_counts(typed: DataFrame, params: list[K.Params]) -> DataFrame:
    """COUNTS of each setting with any: samples with a false trigger, with a caught trap, and the characters up to it; and ALL."""
    every = typed.select("trap_start", "valid", "trap")
    groups: dict[float, dict[float, list[int]]] = {}
    for place, setting in enumerate(params):
        groups.setdefault(setting.p, {}).setdefault(setting.alpha, []).append(place)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals, samples = np.zeros((3, len(params)), dtype=np.int64), 0
        for batch in batches:
            start, n = batch.column("trap_start").to_numpy(), batch.num_rows
            samples += n
            typed = [padded_lists(batch.column(name)) for name in ("valid", "trap")]
            for p, by_alpha in groups.items():
                powers = [[np.power(k, p) for _, _, k, _ in parts] for parts in typed]
                for alpha, places in by_alpha.items():
                    own = [params[place].baseline for place in places]
                    early, late = (passages(parts, of, n, alpha, own) for parts, of in zip(typed, powers))
                    caught = (late != NEVER) & (late > start)
                    totals[0, places] += (early != NEVER).sum(axis=1)
                    totals[1, places] += caught.sum(axis=1)
                    totals[2, places] += np.where(caught, late - start, 0).sum(axis=1)
        some = np.flatnonzero(totals.any(axis=0))
        counts = zip((np.r_[some, ALL], *(np.r_[t[some], more] for t, more in zip(totals, (samples, 0, 0)))), (np.int32, *[np.int64] * 3))
        yield pa.RecordBatch.from_arrays([pa.array(c.astype(kind)) for c, kind in counts], ["setting", "fps", "tps", "chars"])

    counted = every.mapInArrow(run, COUNTS)
    return counted.groupBy("setting").agg(*(F.sum(c).alias(c) for c in ("fps", "tps", "chars")))


def mixed_metrics(typed: DataFrame, params: list[K.Params]) -> DataFrame:
    """d0, a, p, fpr, recall, lat of each setting: shares of the samples of several runs, and the mean number of characters from
    the trap to its detection."""
    counts = stored(typed_counts(typed, params))
    n = counts.agg(F.coalesce(F.sum(F.when(F.col("setting") == ALL, F.col("fps"))), F.lit(0)).alias("n"))
    table = typed.sparkSession.createDataFrame([(i, s.baseline, s.alpha, s.p) for i, s in enumerate(params)], "setting int, d0 double, a double, p double")
    joined = table.join(counts, "setting", "left").join(F.broadcast(n), F.lit(True))
    share = lambda c, of: F.round(F.coalesce(F.try_divide(F.col(c), F.col(of)), F.lit(0.0)), 6)
    return joined.select("d0", "a", "p", share("fps", "n").alias("fpr"), share("tps", "n").alias("recall"), share("chars", "tps").alias("lat"))


def leaderboard(metrics: DataFrame, n: int = 10) -> DataFrame:
    return metrics.orderBy("fpr", F.desc("recall"), "lat", "d0", "a", "p").limit(n)

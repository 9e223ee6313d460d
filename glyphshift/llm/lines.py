"""Line dedup by winnowing: window minima of line hashes are fingerprints; repeated ones are extended, later runs deleted.

A document is the sequence of its lines that hold a word, each hashed without the white space at its ends. Of every window of
`size` lines the place of the least hash (of equal ones the last) is selected, about every second line of a text. Equal
windows select alike, so a run of `size` lines or more that stands twice shares a selected hash for certain. Places are
joined by their hash: what stands at one place alone goes. The others are extended both ways, by the neighbours' hashes that
they carry, to the windows that selected them, and windows that stand earlier are deleted; runs of any length are unions of
such windows.

With `words`, runs are measured by words as well: windows of fewer lines count if they have `words` words or more, and so
does a whole document of fewer lines, against whole documents. These are fingerprints by their first line.

Everything is DataFrame functions; groupings have partial sums, and rows of very common lines are joined back where they lie.

Lines are judged on the input, so what was deleted can still be the earlier run; earlier is by (doc_id, line). A null or empty
text has no lines and stays as it is. Texts of any length are cut whole. A row without an id is neither cut nor a source. Rows
are told apart by id and text: repeated rows are cut alike and aren't repeats of each other, and other texts of the same id
are judged by their own lines. Columns beside `doc_id` and `text` are passed on, whatever their names; `n_chars` is counted anew.
"""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphshift.llm._shared import hot_limit, join_back, keyed, release, write_cut
from glyphshift.llm.rules import bound

#: Lines of a window: shorter runs are deleted only by their words, or as whole documents.
SIZE = 3
#: Words from which on a run of fewer lines counts.
WORDS = 50
WHITE = " \t\n\x0b\f\r"


def split_lines(text: Column) -> Column:
    return F.split(text, "\n")


def trimmed(line: Column) -> Column:
    return F.btrim(line, F.lit(WHITE))


def content(lines: Column) -> Column:
    """Places of the lines that hold a word."""
    return F.filter(F.transform(lines, lambda x, i: F.when(trimmed(x) != "", i)), lambda i: i.isNotNull())


def words_by_spaces(line: Column) -> Column:
    """Words of a trimmed line, where they are parted by single spaces."""
    return F.octet_length(line) - F.octet_length(F.replace(line, F.lit(" "), F.lit(""))) + 1


def words_by_white(line: Column) -> Column:
    """Words of any trimmed line."""
    return F.size(F.split(line, "[\\x20\\x09-\\x0D]+"))


def hashed_lines(docs: DataFrame, words: int | None) -> DataFrame:
    """doc_id, key, l: the content lines of each text as (h, n), hash and number of words."""
    own = keyed(docs).where("doc_id is not null and text is not null")
    lines = F.filter(F.transform(split_lines(F.col("text")), trimmed), lambda x: x != "")
    if words is None:
        return own.select("doc_id", "key", F.transform(lines, lambda x: F.struct(F.xxhash64(x).alias("h"), F.lit(0).alias("n"))).alias("l"))
    odd = reduce(or_, (F.contains("text", F.lit(white)) for white in ("  ", "\t", "\x0b", "\f", "\r")))
    counted = lambda n: F.transform(lines, lambda x: F.struct(F.xxhash64(x).alias("h"), n(x).alias("n")))
    return own.select("doc_id", "key", F.when(odd, counted(words_by_white)).otherwise(counted(words_by_spaces)).alias("l"))


def selected_by(offset: int, size: int) -> Column:
    """Whether a line is the last least one of the window of `size` lines in which it has this place."""
    lower = [F.col("f") <= F.col(f"l{k}") for k in range(1, offset + 1)] + [F.col("f") < F.col(f"r{k}") for k in range(1, size - offset)]
    return F.coalesce(reduce(and_, lower, F.lit(True)), F.lit(False))


def fingerprints(docs: DataFrame, size: int = SIZE, words: int | None = None) -> DataFrame:
    """doc_id, key, pos, kind, f, and the hashes of the neighbours l1.. and r1..: of kind 0 the selected lines; of kind n the
    first lines of windows of n lines that have enough words; of kind size + n that of a whole document of n lines."""
    reach = range(1, size)
    item = lambda x, i: F.struct(
        i.alias("pos"), x["h"].alias("f"), x["n"].alias("n"), *(F.get("l", i - k)["h"].alias(f"l{k}") for k in reach), *(F.get("l", i + k)["h"].alias(f"r{k}") for k in reach), *(F.get("l", i + k)["n"].alias(f"n{k}") for k in reach)
    )
    placed = hashed_lines(docs, words).select("doc_id", "key", F.size("l").alias("total"), F.explode(F.transform("l", item)).alias("i")).select("doc_id", "key", "total", "i.*")
    kinds = [F.when(reduce(or_, (selected_by(k, size) for k in range(size))), 0)]
    if words is not None:
        rich = lambda n: sum((F.col(f"n{k}") for k in range(1, n)), F.col("n")) >= words
        kinds += [F.when(rich(n), n) for n in reach] + [F.when((F.col("total") == n) & (F.col("pos") == 0), size + n) for n in reach]
    of_kind = placed.withColumn("kind", F.explode(F.array_remove(F.array(*(F.coalesce(k, F.lit(-1)) for k in kinds)), -1)))
    # Shorter runs carry only the lines after their first.
    left = [F.when(F.col("kind") == 0, F.col(f"l{k}")).alias(f"l{k}") for k in reach]
    right = [F.when((F.col("kind") == 0) | (F.pmod("kind", F.lit(size)) > k), F.col(f"r{k}")).alias(f"r{k}") for k in reach]
    return of_kind.select("doc_id", "key", "pos", "kind", "f", *left, *right)


def extended(selected: DataFrame, size: int) -> DataFrame:
    """doc_id, key, start, lines, w1, w2: the windows that each fingerprint stands for, from its neighbours on both sides."""

    def window(start: Column, n: int, kind: Column, hashes: list[Column]) -> Column:
        return F.struct(start.alias("start"), F.lit(n).alias("lines"), F.xxhash64(*hashes).alias("w1"), F.hash(kind, *hashes).alias("w2"))

    left = lambda n: [F.col(f"l{k}") for k in range(n, 0, -1)]
    right = lambda n: [F.col(f"r{k}") for k in range(1, n + 1)]
    around = [F.when((F.col("kind") == 0) & selected_by(o, size), window(F.col("pos") - o, size, F.col("kind"), [*left(o), F.col("f"), *right(size - 1 - o)])) for o in range(size)]
    own = [F.when((F.col("kind") > 0) & (F.pmod("kind", F.lit(size)) == n), window(F.col("pos"), n, F.col("kind"), [F.col("f"), *right(n - 1)])) for n in range(1, size)]
    return selected.select("doc_id", "key", F.explode(F.array(*around, *own)).alias("w")).where("w is not null").select("doc_id", "key", "w.*")


def later_windows(docs: DataFrame, size: int = SIZE, words: int | None = None) -> DataFrame:
    """doc_id, key, starts: of each text with any, the windows (start, by content line, and lines) that also start earlier."""
    selected = write_cut(fingerprints(docs, size, words))
    limit = hot_limit(selected.count())

    def groups(df: DataFrame, by: list[str], place: list[str]) -> DataFrame:
        """Of each group the first place and the number of rows, and whether it has another place."""
        own = df.groupBy(*by).agg(F.min(F.struct(*place)).alias("first"), F.max(F.struct(*place)).alias("last"), F.count(F.lit(1)).alias("n"))
        return write_cut(own.withColumn("use", F.col("first") != F.col("last")).drop("last").where(F.col("use") | (F.col("n") >= limit)))

    repeated = groups(selected, ["f"], ["doc_id", "key", "pos"])
    windows = write_cut(extended(join_back(selected, repeated.drop("first"), ["f"], limit, "left_semi"), size))
    release(selected, repeated)
    first = groups(windows, ["w1", "w2"], ["doc_id", "start"])
    later = join_back(windows, first, ["w1", "w2"], limit).where(F.struct("doc_id", "start") > F.col("first"))
    starts = write_cut(later.groupBy("doc_id", "key").agg(F.collect_set(F.struct("start", "lines")).alias("starts")))
    release(windows, first)
    return starts


def cut_lines(docs: DataFrame, size: int = SIZE, words: int | None = None) -> DataFrame:
    """The columns of `docs` as the struct `row`, and kept, n_lines, n_removed: the text that is left, its content lines before, and those deleted."""
    starts = later_windows(docs, size, words).select(F.col("doc_id").alias("cut_id"), F.col("key").alias("cut_key"), F.col("starts").alias("cut_starts"))
    own = docs.select(F.col("doc_id").cast("long").alias("own_id"), F.xxhash64(F.col("text").cast("string")).alias("own_key"), F.struct(*(docs[n] for n in docs.columns)).alias("row"))
    # By merge at every size: a broadcast of the few starts of a small table would tell nothing about a large one.
    joined = own.join(starts.hint("merge"), (F.col("own_id") == F.col("cut_id")) & (F.col("own_key") == F.col("cut_key")), "left")
    text = F.coalesce(F.col("row.text"), F.lit(""))
    lines = split_lines(text)

    def rebuilt(found: Column) -> Column:
        gone = F.array_distinct(F.flatten(F.transform("cut_starts", lambda s: F.slice(found["places"], s["start"] + 1, s["lines"]))))
        left = F.array_except(F.sequence(F.lit(0), F.size(found["lines"]) - 1), gone)
        return F.struct(F.array_join(F.transform(left, lambda i: F.get(found["lines"], i)), "\n").alias("kept"), F.size(gone).cast("long").alias("n"))

    cut = F.when(F.col("cut_starts").isNotNull(), bound(F.struct(lines.alias("lines"), content(lines).alias("places")), rebuilt))
    n_lines = F.size(F.filter(lines, lambda x: trimmed(x) != "")).cast("long")
    return joined.select("row", n_lines.alias("n_lines"), cut.alias("cut")).select(
        "row", "n_lines", F.coalesce("cut.kept", "row.text").alias("kept"), F.coalesce("cut.n", F.lit(0).cast("long")).alias("n_removed")
    )


def dedup_lines(docs: DataFrame, size: int = SIZE, words: int | None = None) -> DataFrame:
    """`docs`, all columns, without the deleted lines; documents of which no line is left go."""
    cut = cut_lines(docs, size, words).where("n_removed = 0 or n_removed < n_lines")
    fresh = {"text": F.col("kept"), "n_chars": F.length("kept").cast("long")}
    return cut.select(*(F.when(F.col("n_removed") > 0, fresh[n]).otherwise(F.col("row")[n]).cast(docs.schema[n].dataType).alias(n) if n in fresh else F.col("row")[n].alias(n) for n in docs.columns))


def report(docs: DataFrame, size: int = SIZE, words: int | None = None) -> DataFrame:
    """doc_id, n_lines, n_removed, kept_sha256 of every document row; null text counts as empty."""
    cut = cut_lines(docs.select("doc_id", "text"), size, words)
    return cut.select(F.col("row.doc_id").alias("doc_id"), "n_lines", "n_removed", F.sha2(F.coalesce("kept", F.lit("")), 256).alias("kept_sha256"))


ORACLE = r"""
WITH l AS (SELECT doc_id, i, string_split(text, chr(10))[i] AS line FROM documents, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS u(i)),
c AS (SELECT *, len(list_filter(regexp_split_to_array(s, '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS n, count(*) OVER (PARTITION BY doc_id) AS total
      FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS k, regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS s
            FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]'))),
r AS (SELECT *, lead(s) OVER o AS s2, lead(s, 2) OVER o AS s3, lead(n) OVER o AS n2 FROM c WINDOW o AS (PARTITION BY doc_id ORDER BY k)),
w AS (SELECT doc_id, k, 3 AS size, '3' || s || chr(10) || s2 || chr(10) || s3 AS g FROM r WHERE s3 IS NOT NULL
      UNION ALL SELECT doc_id, k, 1, '1' || s FROM r WHERE n >= 50
      UNION ALL SELECT doc_id, k, 2, '2' || s || chr(10) || s2 FROM r WHERE n + n2 >= 50
      UNION ALL SELECT doc_id, k, 1, 'one' || s FROM r WHERE total = 1
      UNION ALL SELECT doc_id, k, 2, 'two' || s || chr(10) || s2 FROM r WHERE total = 2 AND k = 0),
f AS (SELECT doc_id, k, size, min(doc_id * 1000000 + k) OVER (PARTITION BY g) AS first FROM w),
gone AS (SELECT DISTINCT doc_id, k + d AS k FROM f, unnest(range(0, size)) AS v(d) WHERE doc_id * 1000000 + k > first),
rest AS (SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.i) AS kept FROM l LEFT JOIN c ON l.doc_id = c.doc_id AND l.i = c.i
         LEFT JOIN gone ON c.doc_id = gone.doc_id AND c.k = gone.k WHERE gone.k IS NULL GROUP BY l.doc_id)
SELECT d.doc_id, CAST(coalesce(a.n, 0) AS BIGINT) AS n_lines, CAST(coalesce(b.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(rest.kept, '')) AS kept_sha256
FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS n FROM c GROUP BY doc_id) a ON d.doc_id = a.doc_id
LEFT JOIN (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id) b ON d.doc_id = b.doc_id LEFT JOIN rest ON d.doc_id = rest.doc_id
"""

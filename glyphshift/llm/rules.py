"""Quality rules: a ledger of failure bits and measurements, versioned policies over it, and their ablations.

Every rule is evaluated once, in DataFrame functions on the row: its measurement is kept and its failure is one bit of a
mask. A policy is a version's mask of rules that reject, so applying it is one bitwise and, policies change without a scan
of the texts, and ablations (what would a policy keep without one of its rules) are bitwise counts over the ledger.

Words are runs without ASCII white space. A null or empty text has no words and no lines; it fails the rule on the number
of words. Texts of any length are measured whole, in time n log n. Repeated rows are judged each for itself; further
columns are ignored; an empty table gives an empty ledger. Measurements in percent of nothing are 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphshift.llm._shared import id_and_text

WHITE = "[\\x20\\x09-\\x0D]+"
SYMBOLS = "[#*$%&|<>]"
WINDOW = 5


def bound(value: Column, use) -> Column:
    """`use` of `value`, which is computed once for the row however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, WHITE), "")


def repeated_words(tokens: Column, size: int = WINDOW) -> Column:
    """Words in windows of `size` words that stand twice or more in the text: equal windows are neighbours once sorted."""
    count = F.size(tokens) - size + 1
    hashes = F.when(count > 0, F.transform(F.sequence(F.lit(0), F.greatest(count, F.lit(1)) - 1), lambda i: F.xxhash64(*(F.get(tokens, i + k) for k in range(size)))))
    hashes = F.coalesce(hashes, F.array().cast("array<bigint>"))

    def covered(own: Column) -> Column:
        ordered = F.array_sort(F.transform(own, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def places(s: Column) -> Column:
            twice = F.filter(s, lambda x, k: (x["h"] == F.get(s, k - 1)["h"]).eqNullSafe(True) | (x["h"] == F.get(s, k + 1)["h"]).eqNullSafe(True))
            return F.array_sort(F.transform(twice, lambda x: x["i"]))

        zero = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
        step = lambda acc, p: F.struct((p + size).alias("end"), (acc["n"] + p + size - F.greatest(acc["end"], p)).alias("n"))
        return F.aggregate(bound(ordered, places), zero, step, lambda acc: acc["n"])

    return bound(hashes, lambda own: F.when(F.size(F.array_distinct(own)) == F.size(own), F.lit(0).cast("long")).otherwise(covered(own)))


def measured(docs: DataFrame) -> DataFrame:
    """doc_id and the measurements of every document row."""
    own = id_and_text(docs).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    tokens = words(F.col("text"))
    lines = F.filter(F.split("text", "\n"), lambda line: line.rlike("[^\\x20\\x09-\\x0D]"))
    letters = F.length(F.regexp_replace("text", "[^\\p{L}]+", ""))
    return own.select(
        "doc_id",
        bound(
            tokens,
            lambda t: F.struct(
                F.size(t).cast("long").alias("n_words"),
                repeated_words(t).alias("n_repeat_words"),
                F.aggregate(t, F.lit(0), lambda a, w: F.greatest(a, F.length(w))).cast("long").alias("longest_word"),
            ),
        ).alias("of_words"),
        F.length(F.regexp_replace("text", WHITE, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.regexp_replace("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        bound(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))).alias("of_lines"),
        letters.cast("long").alias("n_letters"),
        F.length(F.regexp_replace("text", "[^\\p{Lu}]+", "")).cast("long").alias("n_capitals"),
    ).select("doc_id", "of_words.*", "word_chars", "n_symbols", "of_lines.*", "n_letters", "n_capitals")


#: Rules in the order of their bits: name and the failing condition over the measurements, in whole numbers.
RULES: list[tuple[str, str]] = [
    ("too_few_words", "n_words < 10"),
    ("repeated_windows", "100 * n_repeat_words > 20 * n_words"),
    ("symbols", "100 * n_symbols > 10 * word_chars"),
    ("duplicate_lines", "100 * n_dup_lines > 50 * n_lines"),
    ("short_words", "word_chars < 2 * n_words"),
    ("long_words", "word_chars > 15 * n_words"),
    ("few_letters", "100 * n_letters < 50 * word_chars"),
    ("capitals", "100 * n_capitals > 60 * n_letters"),
    ("tables", "100 * n_symbols > 40 * n_words"),
]
BIT = {name: 1 << k for k, (name, _) in enumerate(RULES)}
BASE = BIT["too_few_words"] | BIT["repeated_windows"]
#: Versions of the policy: the mask of rules that reject.
POLICIES = {
    "v1": BASE,
    "v2": BASE | BIT["symbols"] | BIT["capitals"],
    "v3": BASE | BIT["symbols"] | BIT["capitals"] | BIT["duplicate_lines"] | BIT["short_words"] | BIT["long_words"] | BIT["few_letters"] | BIT["tables"],
}
CURRENT = "v3"


def ledger(docs: DataFrame) -> DataFrame:
    """The measurements of every document row, and `failed`: the bits of the rules that it fails."""
    mask = sum((F.when(F.expr(condition), F.lit(BIT[name])).otherwise(F.lit(0)).cast("long") for name, condition in RULES[1:]), F.when(F.expr(RULES[0][1]), F.lit(1)).otherwise(F.lit(0)).cast("long"))
    return measured(docs).withColumn("failed", mask)


def apply_policy(of: DataFrame, mask: int) -> DataFrame:
    """The ledger with `kept`: no rule of the mask failed."""
    return of.withColumn("kept", F.col("failed").bitwiseAND(mask) == 0)


def ablation(of: DataFrame, policies: dict[str, int] | None = None) -> DataFrame:
    """For each policy and each of its rules: rows rejected, rows that fail the rule, and rows that the policy would keep
    without it. One pass: the ledger is first counted by mask, of which there are at most 2 ** rules."""
    masks = of.groupBy("failed").agg(F.count(F.lit(1)).alias("n"))
    rows = [(policy, mask, name, BIT[name]) for policy, mask in (policies or POLICIES).items() for name in BIT if mask & BIT[name]]
    table = F.broadcast(of.sparkSession.createDataFrame(rows, "policy string, mask long, rule string, bit long"))
    hit = F.col("failed").bitwiseAND(F.col("mask"))
    count = lambda condition: F.sum(F.when(condition, F.col("n")).otherwise(0)).alias
    return (
        masks.join(table, F.lit(True))
        .groupBy("policy", "rule")
        .agg(count(hit != 0)("rejected"), count(F.col("failed").bitwiseAND(F.col("bit")) != 0)("failing"), count(hit == F.col("bit"))("only_this"))
    )


def report(docs: DataFrame, policy: str = CURRENT) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, failed of every document row."""
    judged = apply_policy(ledger(docs), POLICIES[policy] | BASE)
    base = F.col("failed").bitwiseAND(BASE) != 0
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), "kept", "failed")


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS t,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
win AS (SELECT doc_id, i, array_to_string(t[i:i+4], ' ') AS g FROM w, unnest(range(1, len(t) - 3)) AS u(i)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM win) WHERE n > 1),
cov AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, unnest(range(0, 5)) AS v(k) GROUP BY doc_id),
m AS (SELECT w.doc_id, len(t) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
             length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
             len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words,
             length(regexp_replace(text, '[^\p{L}]+', '', 'g')) AS n_letters, length(regexp_replace(text, '[^\p{Lu}]+', '', 'g')) AS n_capitals
      FROM w LEFT JOIN cov ON w.doc_id = cov.doc_id),
f AS (SELECT *, (CASE WHEN n_words < 10 THEN 1 ELSE 0 END) + (CASE WHEN 100 * n_repeat_words > 20 * n_words THEN 2 ELSE 0 END)
             + (CASE WHEN 100 * n_symbols > 10 * word_chars THEN 4 ELSE 0 END) + (CASE WHEN 100 * n_dup_lines > 50 * n_lines THEN 8 ELSE 0 END)
             + (CASE WHEN word_chars < 2 * n_words THEN 16 ELSE 0 END) + (CASE WHEN word_chars > 15 * n_words THEN 32 ELSE 0 END)
             + (CASE WHEN 100 * n_letters < 50 * word_chars THEN 64 ELSE 0 END) + (CASE WHEN 100 * n_capitals > 60 * n_letters THEN 128 ELSE 0 END)
             + (CASE WHEN 100 * n_symbols > 40 * n_words THEN 256 ELSE 0 END) AS failed FROM m)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
       CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, (failed & 3) <> 0 AS base_failed,
       failed = 0 AS kept, CAST(failed AS BIGINT) AS failed
FROM f
"""

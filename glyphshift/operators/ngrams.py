"""Training of character n-gram models as aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphshift import constants as K
from glyphshift.functions import text as T
from glyphshift.operators.counting import counted, counted_grams


def normalise(lines: DataFrame) -> DataFrame:
    """Small letters, stripped, without direction marks; empty lines go."""
    plain = F.replace(F.replace(T.strip(F.lower("line")), F.lit("\u200e"), F.lit("")), F.lit("\u200f"), F.lit(""))
    return lines.withColumn("line", plain).where("line != ''")


def words(lines: DataFrame, *keys: str) -> DataFrame:
    return lines.select(*keys, F.explode(T.split_words("line")).alias("word"))


def is_pure(word: Column, alphabet: str) -> Column:
    return F.translate(word, alphabet, "") == ""


def kept(model: Column, word: Column) -> Column:
    """Whether a model counts a word: all characters in its alphabet, not vocalised, not too long."""
    pure = F.when(model == "he", is_pure(word, K.HE_ALLOWED)).otherwise(is_pure(word, K.EN_ALLOWED))
    return pure & ~T.has_nikud(word) & (F.length(word) <= K.MAX_WORD)


def raw_counts(lines: DataFrame, *keys: str) -> DataFrame:
    """keys, word, cnt: words as they stand in the lines."""
    return counted(lines, *keys).groupBy(*keys, "word").agg(F.sum("cnt").alias("cnt"))


def distinct_words(lines: DataFrame, *keys: str) -> DataFrame:
    return counted(lines, *keys).select(*keys, "word").distinct()


def word_counts(lines: DataFrame) -> DataFrame:
    """model, word, cnt from lines with a model: words are counted before they are cut into grams."""
    return kept_counts(raw_counts(lines, "model"))


def kept_counts(counts: DataFrame) -> DataFrame:
    """model, word, cnt of counted words (model, word, cnt), normalised, of those that a model counts: each distinct word is looked
    at once. A line's words are those of the normalised line."""
    plain = normalise(counts.withColumnRenamed("word", "line")).withColumnRenamed("line", "word")
    return plain.where(kept(F.col("model"), F.col("word"))).groupBy("model", "word").agg(F.sum("cnt").alias("cnt"))


def grams_of(word: Column, orders=(2, 3, 4)) -> Column:
    """(n, gram) of the word with a blank at either end."""
    padded = F.concat(F.lit(" "), word, F.lit(" "))
    size = F.length(word) + 2

    def of(n: int) -> Column:
        at = F.sequence(F.lit(1), F.greatest(size - n + 1, F.lit(1)))
        found = F.transform(at, lambda i: F.struct(F.lit(n).alias("n"), F.substring(padded, i, F.lit(n)).alias("gram")))
        return F.when(size >= n, found).otherwise(F.array().cast("array<struct<n:int,gram:string>>"))

    return F.concat(*(of(n) for n in orders))


def count_ngrams(counts: DataFrame) -> DataFrame:
    """model, n, gram, cnt."""
    return counted_grams(counts).groupBy("model", "n", "gram").agg(F.sum("cnt").alias("cnt"))


def model_chars(counts: DataFrame) -> DataFrame:
    """model, ch: the characters of the kept words; they merge, as the size alone wouldn't."""
    return counts.select("model", F.explode(F.array_distinct(F.split("word", ""))).alias("ch")).where("ch != ''").distinct()


def vocab_size(chars: DataFrame) -> DataFrame:
    """model, vocab_size: distinct characters, and the blank."""
    return chars.where("ch != ' '").groupBy("model").agg((F.count(F.lit(1)) + 1).alias("vocab_size"))


def total_bigrams(ngrams: DataFrame) -> DataFrame:
    return ngrams.where("n = 2").groupBy("model").agg(F.sum("cnt").alias("total_bigrams"))


def first_totals(ngrams: DataFrame) -> DataFrame:
    return ngrams.where("n = 2").groupBy("model", F.substring("gram", 1, 1).alias("ch")).agg(F.sum("cnt").alias("total"))


def model_meta(ngrams: DataFrame, chars: DataFrame) -> DataFrame:
    return vocab_size(chars).join(total_bigrams(ngrams), "model")


def merge_counts(*parts: DataFrame) -> DataFrame:
    """The model of several shards: counts add up. A shard that fails fails the job."""
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    return every.groupBy("model", "n", "gram").agg(F.sum("cnt").alias("cnt"))


def merge_chars(*parts: DataFrame) -> DataFrame:
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    return every.distinct()


class Models:
    """Trained tables: ngrams (model, n, gram, cnt), meta (model, vocab_size, total_bigrams), firsts (model, ch, total)."""

    def __init__(self, ngrams: DataFrame, chars: DataFrame):
        self.ngrams, self.chars = ngrams, chars
        self.meta, self.firsts = model_meta(ngrams, chars), first_totals(ngrams)


def train(lines: DataFrame) -> Models:
    """All models of `lines` (model, line) in one pass."""
    counts = word_counts(lines)
    return Models(count_ngrams(counts), model_chars(counts))

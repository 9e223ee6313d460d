"""Scores of texts under n-gram models. Tasks score texts where they lie, by tables of the models' counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphshift.functions import text as T
from glyphshift.operators.ngrams import Models
from glyphshift.operators.tables import traces, with_scores

#: Characters of a block.
BLOCK = 64


def grams(texts: DataFrame, *sides: str) -> DataFrame:
    """id, j, first, and of each side (columns of `texts`) the four characters from place j on; the first side has four at least."""
    cut = texts.select("id", *(F.regexp_extract_all(side, F.lit(f"(?s)(?=(.{{1,{BLOCK + 3}}})).{{1,{BLOCK}}}"), F.lit(1)).alias(side) for side in sides))
    blocks = cut.select("id", F.posexplode(F.arrays_zip(*sides)).alias("b", "piece")).select("id", "b", *(F.coalesce(F.col(f"piece.{side}"), F.lit("")).alias(side) for side in sides))
    width = F.least(F.lit(BLOCK), F.length(sides[0]) - 3)
    every = blocks.where(F.length(sides[0]) >= 4).select("id", "b", *sides, F.explode(F.sequence(F.lit(1), width)).alias("i"))
    j = (F.col("b") * BLOCK + F.col("i")).alias("j")
    return every.select("id", j, (j == 1).alias("first"), *(F.substring(side, F.col("i"), F.lit(4)).alias(side) for side in sides))


def score(texts: DataFrame, models: Models, model: str) -> DataFrame:
    """text, score of each distinct `text`."""
    return with_scores(texts.select("text").where("text is not null").distinct(), {"score": (model, "text")}, models)


def score_trace(texts: DataFrame, models: Models, model: str) -> DataFrame:
    """text, j, gram, c4, c3, step, total: one row a step, step 0 the first bigram's; the long formula for any length."""
    distinct = texts.select("text").where("text is not null").distinct()
    return traces(distinct.select("text", F.lower("text").alias("low")), models, model).select("text", F.explode("steps").alias("s")).select("text", "s.*")


def prefix_scores(words: DataFrame, models: Models, model: str) -> DataFrame:
    """word, j, score: of the word behind a blank, the score after its first j + 2 characters (small letters), and of the
    last j with the delimiter behind it. The word has two characters at least."""
    distinct = words.select(F.col("word").alias("text")).where("length(text) >= 2").distinct()
    padded = distinct.select("text", F.concat(F.lit(" "), F.lower("text"), F.lit(" ")).alias("low"))
    return traces(padded, models, model).select(F.col("text").alias("word"), F.explode("steps").alias("s")).where("s.j > 0").select("word", "s.j", F.col("s.total").alias("score"))


def best_english(words: DataFrame, models: Models, names: list[str]) -> DataFrame:
    """Prefix scores under several English models: the best of them, prefix by prefix."""
    every = None
    for name in names:
        part = prefix_scores(words, models, name)
        every = part if every is None else every.unionByName(part)
    return every.groupBy("word", "j").agg(F.max("score").alias("score"))


def score_english(texts: DataFrame, models: Models, mode: str) -> DataFrame:
    """text, score: under the standard model, or in technical mode the better of the standard and the technical one."""
    distinct = texts.select("text").where("text is not null").distinct()
    if mode != "technical":
        return with_scores(distinct, {"score": ("en", "text")}, models)
    both = with_scores(distinct, {"standard": ("en", "text"), "technical": ("so", "text")}, models)
    return both.where("standard is not null and technical is not null").select("text", F.greatest("standard", "technical").alias("score"))


def compare_layouts(words: DataFrame, models: Models) -> DataFrame:
    """word, score_en, score_he, diff_if_en, diff_if_he, verdict: the word as English keys and as their Hebrew shadow."""
    pairs = words.select("word").distinct().select("word", F.concat(F.lit(" "), F.lower("word"), F.lit(" ")).alias("en"), F.concat(F.lit(" "), T.shadow("word"), F.lit(" ")).alias("he"))
    out = with_scores(pairs, {"score_en": ("en", "en"), "score_he": ("he", "he")}, models).where("score_en is not null and score_he is not null")
    diff = F.col("score_he") - F.col("score_en")
    return out.select("word", "score_en", "score_he", diff.alias("diff_if_en"), (-diff).alias("diff_if_he"), F.when(diff > 0, "he").otherwise("en").alias("verdict"))

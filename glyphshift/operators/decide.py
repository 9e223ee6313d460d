"""Collision lexicon and decisions on pairs of an active text and its shadow."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphshift import constants as K
from glyphshift.functions import text as T
from glyphshift.operators.ngrams import Models
from glyphshift.operators.tables import with_scores


def lexicon_en(words: DataFrame, n: int = K.LEXICON_WORDS) -> DataFrame:
    """word, freq: the n most frequent words (small letters), of these the alphabetic ones of 2 to 6 letters. Words may be counted
    already (cnt)."""
    each = F.col("cnt") if "cnt" in words.columns else F.lit(1)
    top = words.select(F.lower("word").alias("word"), each.alias("cnt")).groupBy("word").agg(F.sum("cnt").cast("long").alias("freq")).orderBy(F.desc("freq"), "word").limit(n)
    return top.where(F.col("word").rlike(f"^[a-z]{{{K.LEXICON_SHORT},{K.LEXICON_LONG}}}$"))


def lexicon_he(words: DataFrame) -> DataFrame:
    return words.select(T.strip("word").alias("word")).where(F.col("word").rlike(f"^[\\u05D0-\\u05EA]{{{K.LEXICON_SHORT},{K.LEXICON_LONG}}}$")).distinct()


def collision_pairs(he: DataFrame, en: DataFrame) -> DataFrame:
    """he_word, en_word: Hebrew words whose strict shadow is an English word."""
    shadows = he.select(F.col("word").alias("he_word"), T.strict_shadow("word").alias("en_word")).where("en_word != ''")
    return shadows.join(en.select(F.col("word").alias("en_word")).distinct(), "en_word").select("he_word", "en_word")


def collision_set(pairs: DataFrame) -> DataFrame:
    """word: both sides of the pairs, distinct, sorted."""
    return pairs.select(F.col("he_word").alias("word")).union(pairs.select("en_word")).distinct().orderBy("word")


def flag_collisions(df: DataFrame, collisions: DataFrame, active: str = "active", shadow: str = "shadow") -> DataFrame:
    """`is_colliding`: whether either text, in small letters, is in the set."""
    a, s = (collisions.select(F.col("word").alias(name)) for name in ("in_active", "in_shadow"))
    joined = df.join(a, F.lower(df[active]) == F.col("in_active"), "left").join(s, F.lower(df[shadow]) == F.col("in_shadow"), "left")
    return joined.withColumn("is_colliding", F.col("in_active").isNotNull() | F.col("in_shadow").isNotNull()).drop("in_active", "in_shadow")


def without_collisions(df: DataFrame, collisions: DataFrame, column: str = "word") -> DataFrame:
    return df.join(collisions.select(F.col("word").alias("colliding")), F.lower(df[column]) == F.col("colliding"), "left_anti")


#: The English models that a mode judges by; modes that aren't named judge by the standard one.
MODES = {"standard": ("en",), "technical": ("en", "so")}


def decide(pairs: DataFrame, models: Models, collisions: DataFrame, delta: float = K.DEFAULTS.baseline) -> DataFrame:
    """pairs (active, shadow, layout, on_delimiter, ...) with score_diff, is_colliding, is_ambiguous, should_switch. A column `mode`
    says by which English models a row is judged; without it, by the standard one. Rows are scored where they lie, under all
    models, and a row takes the best of its own."""
    english, short = F.col("layout") == "en", F.length("active") < 2
    own = flag_collisions(pairs, collisions).withColumns({"en": F.when(english, F.col("active")).otherwise(F.col("shadow")), "he": F.when(english, F.col("shadow")).otherwise(F.col("active"))})
    ways = MODES if "mode" in pairs.columns else {"standard": MODES["standard"]}
    names = ["he", *dict.fromkeys(name for way in ways.values() for name in way)]
    # What was typed: behind a blank, and with the delimiter that has ended it.
    typed = own.withColumns({f"{side}_typed": F.when(~short, F.concat(F.lit(" "), F.lower(side), F.when(F.col("on_delimiter"), " ").otherwise(""))) for side in ("en", "he")})
    scored = with_scores(typed, {f"score_{name}": (name, "he_typed" if name == "he" else "en_typed") for name in names}, models)
    score = lambda name: F.col(f"score_{name}")
    best = score("en")
    if "mode" in pairs.columns:
        best = F.when(F.col("mode") == "technical", F.greatest(*map(score, MODES["technical"]))).otherwise(best)
    gap = score("he") - best
    diff = F.when(short, F.lit(0.0)).when(english, gap).otherwise(-gap)
    scored = scored.withColumn("score_diff", diff).withColumn("is_colliding", ~short & F.col("is_colliding"))
    switch = ~short & ~F.col("is_colliding") & (F.col("score_diff") > delta)
    ambiguous = short | (~F.col("is_colliding") & ~switch & (F.col("score_diff") > 0))
    return scored.select(*pairs.columns, "score_diff", "is_colliding", ambiguous.alias("is_ambiguous"), switch.alias("should_switch"))


def decision_log(decisions: DataFrame, delta: float = K.DEFAULTS.baseline, time: str = "time") -> DataFrame:
    """The log's eleven columns; pairs of less than two characters aren't logged."""
    logged = decisions.where("length(active) >= 2")
    return logged.select(
        F.col(time).alias("time"),
        F.col("active").alias("active_word"),
        F.col("shadow").alias("shadow_word"),
        "layout",
        "on_delimiter",
        "is_colliding",
        "is_ambiguous",
        F.round("score_diff", 3).alias("score_diff"),
        F.round(F.lit(float(delta)), 2).alias("delta"),
        T.gap_category("score_diff").alias("category"),
        "should_switch",
    )

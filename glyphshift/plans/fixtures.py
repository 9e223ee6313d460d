"""What the registered queries work on, derived from the given tables. The tables hold no Hebrew, so German words are shadowed
into a pseudo-Hebrew corpus; its figures say nothing about real Hebrew."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphshift import constants as K
from glyphshift.functions import text as T
from glyphshift.operators import audit, cleaning, decide, mixed, ngrams
from glyphshift.operators.ngrams import Models
from glyphshift.session import stored
from glyphshift.sources.corpus import dealt, read_corpus, spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_corpus(spark, f"{sf_dir}/{name}.parquet")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.explode_lines(dealt(table(spark, sf_dir, "documents")))


def hebrew_lines(every: DataFrame) -> DataFrame:
    """German lines as their plain words' shadows, without the words that aren't plain."""
    plain = F.filter(T.split_words(F.lower("line")), lambda w: w.rlike("^[a-z]+$"))
    shadowed = F.array_join(F.transform(plain, lambda w: T.shadow(w)), " ")
    return every.where("lang = 'de'").withColumns({"lang": F.lit("he"), "line": shadowed}).where("line != ''")


def technical_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = table(spark, sf_dir, "conversations").where("role in ('user', 'assistant')")
    part = said.select("conv_id", "turn", F.explode(F.split("text", "\n")).alias("line"))
    return part.select(T.strip("line").alias("line")).where("line != ''")


def training_lines(spark: SparkSession, sf_dir: str, names: tuple[str, ...] = ("en", "he", "so")) -> DataFrame:
    """model, line of the named models."""
    every = lines(spark, sf_dir)
    parts = {"en": lambda: every.where("lang = 'en'"), "he": lambda: hebrew_lines(every), "so": lambda: technical_lines(spark, sf_dir)}
    named = [parts[name]().select(F.lit(name).alias("model"), "line") for name in names]
    return reduce(DataFrame.unionByName, named)


def counted_words(spark: SparkSession, sf_dir: str, every: DataFrame | None = None, langs: tuple[str, ...] = ("en", "de")) -> DataFrame:
    """lang, word, cnt of the lines of some languages, stored: models and collisions are made of the English and German ones."""
    every = lines(spark, sf_dir) if every is None else every
    return stored(ngrams.raw_counts(every.where(F.col("lang").isin(*langs)), "lang"))


def judged_words(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The distinct words of the audited lines, and the counted words that models and collisions are made of: lines are read once."""
    counted = counted_words(spark, sf_dir, langs=("en", "de", *AUDITED))
    return counted.where(F.col("lang").isin(*AUDITED)).select("word").distinct(), counted


def hebrew_words(counted: DataFrame) -> DataFrame:
    """word, cnt of `hebrew_lines`, from the counted German words."""
    plain = counted.where("lang = 'de'").select(F.lower("word").alias("word"), "cnt").where(F.col("word").rlike("^[a-z]+$"))
    return plain.select(T.shadow("word").alias("word"), "cnt")


def models(spark: SparkSession, sf_dir: str, counted: DataFrame | None = None, names: tuple[str, ...] = ("en", "he", "so")) -> Models:
    """The trained models, stored, as every score reads them several times."""
    counted = counted_words(spark, sf_dir) if counted is None else counted
    parts = {"en": lambda: counted.where("lang = 'en'"), "he": lambda: hebrew_words(counted), "so": lambda: ngrams.raw_counts(technical_lines(spark, sf_dir))}
    counts = stored(ngrams.kept_counts(reduce(DataFrame.unionByName, [parts[name]().select(F.lit(name).alias("model"), "word", "cnt") for name in names])))
    return Models(stored(ngrams.count_ngrams(counts)), stored(ngrams.model_chars(counts)))


def collisions(spark: SparkSession, sf_dir: str, counted: DataFrame | None = None) -> DataFrame:
    return decide.collision_set(counted_pairs(counted_words(spark, sf_dir) if counted is None else counted))


def collision_pairs(every: DataFrame) -> DataFrame:
    return counted_pairs(ngrams.raw_counts(every.where("lang in ('en', 'de')"), "lang"))


def counted_pairs(counted: DataFrame) -> DataFrame:
    return decide.collision_pairs(decide.lexicon_he(hebrew_words(counted)), decide.lexicon_en(counted.where("lang = 'en'")))


#: The languages of lines that are taken as typed on the English layout.
AUDITED = ("en", "es", "fr")


def audit_lines(every: DataFrame) -> DataFrame:
    """English, Spanish and French lines, all taken as typed on the English layout."""
    return every.where(F.col("lang").isin(*AUDITED))


def audit_models(spark: SparkSession, sf_dir: str, every: DataFrame, ways: dict[str, tuple[str, ...]]) -> tuple[Models, DataFrame]:
    """The models of the ways and the Hebrew one, and the collision set."""
    return basis(spark, sf_dir, every, tuple(dict.fromkeys(name for names in (*ways.values(), ("he",)) for name in names)))


def basis(spark: SparkSession, sf_dir: str, every: DataFrame | None = None, names: tuple[str, ...] = ("en", "he", "so"), counted: DataFrame | None = None) -> tuple[Models, DataFrame]:
    """Models and the collision set, from words counted once."""
    counted = counted_words(spark, sf_dir, every) if counted is None else counted
    return models(spark, sf_dir, counted, names), stored(collisions(spark, sf_dir, counted))


def audit_scores(spark: SparkSession, sf_dir: str, every: DataFrame) -> DataFrame:
    """en, he, evals of the audited words."""
    words = ngrams.distinct_words(audit_lines(every))
    return audit.evaluations(audit.forms(words), *audit_models(spark, sf_dir, every, {"own": ("en",)}))


def replayed(spark: SparkSession, sf_dir: str, states: dict[str, tuple[bool, str]], ways: dict[str, tuple[str, ...]] | None = None, of=audit_lines, every: DataFrame | None = None, **wanted) -> DataFrame:  # noqa: ANN001
    """The audited lines, replayed."""
    every, ways = lines(spark, sf_dir) if every is None else every, ways or {"own": ("en",)}
    return audit.replay_states(of(every), *audit_models(spark, sf_dir, every, ways), ways, states, **wanted)


def with_mode(spark: SparkSession, every: DataFrame) -> DataFrame:
    """Lines with the mode that they are judged by: documents ask for each mode in turn, and two sources are technical."""
    asked = F.element_at(F.array(*map(F.lit, ("smart", "technical", "odd", "standard"))), (F.col("doc_id") % 4 + 1).cast("int"))
    technical = F.broadcast(spark.createDataFrame([("src0",), ("SRC3",)], "name string"))
    return cleaning.resolve_mode(every.withColumn("mode", asked), technical).drop("mode", "technical").withColumnRenamed("resolved", "mode")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, html: every fifth page as a dump holds it, escaped once more."""
    escaped = F.col("html")
    for char, reference in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&#34;"), ("'", "&#x27;")):
        escaped = F.replace(escaped, F.lit(char), F.lit(reference))
    return table(spark, sf_dir, "pages").select("page_id", F.when(F.col("page_id") % 5 == 0, escaped).otherwise(F.col("html")).alias("html"))


def vocalised_lines(every: DataFrame) -> DataFrame:
    """`every` and the pseudo-Hebrew lines, of which those of every third document end in a vowel sign."""
    hebrew = hebrew_lines(every)
    return every.unionByName(hebrew.withColumn("line", F.when(F.col("doc_id") % 3 == 0, F.concat("line", F.lit("\u05b0"))).otherwise(F.col("line"))))


def comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, body, channel: conversation turns, some of them deleted, removed, empty, or followed by a Hebrew line."""
    said = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("text").alias("body"), F.col("role").alias("channel"))
    body = F.when(F.col("id") % 17 == 0, "[deleted]").when(F.col("id") % 19 == 0, "[removed]").when(F.col("id") % 23 == 0, "").when(F.col("id") % 3 == 0, F.concat("body", F.lit(" "), T.shadow(F.lower("body")))).otherwise(F.col("body"))
    return said.withColumn("body", body)


def mixed_texts(spark: SparkSession, sf_dir: str, every: DataFrame | None = None) -> DataFrame:
    """sample_id, text: the n-th English line before the n-th pseudo-Hebrew one, by (doc_id, line_no). The language with fewer
    lines begins again when it ends, so that every line of both takes part."""
    every = stored(lines(spark, sf_dir)) if every is None else every
    ranked = lambda df: stored(cleaning.running_totals(df.select("doc_id", "line_no", "line"), F.floor(F.col("doc_id") / 4_096), ["doc_id", "line_no"], {"n": F.lit(1)}).select("n", "line"))
    english, hebrew = ranked(every.where("lang = 'en'")), ranked(hebrew_lines(every))
    sizes = english.agg(F.count(F.lit(1)).alias("en")).join(hebrew.agg(F.count(F.lit(1)).alias("he")), F.lit(True))

    def placed(df: DataFrame, own: str, name: str) -> DataFrame:
        again = F.sequence("n", F.greatest("en", "he") - 1, F.col(own))
        return df.join(F.broadcast(sizes), F.lit(True)).select(F.explode(again).alias("sample_id"), F.col("line").alias(name))

    both = [spread(placed(*side), "sample_id") for side in ((english, "en", "line"), (hebrew, "he", "other"))]
    return both[0].join(both[1], "sample_id").select("sample_id", F.concat("line", F.lit(" "), "other").alias("text"))


def mixed_parts(spark: SparkSession, sf_dir: str, params: list[K.Params]) -> tuple[DataFrame]:
    """The mixed samples, and what could trigger under `params` in valid typing and in the trap."""
    every = stored(lines(spark, sf_dir))
    runs = mixed.text_runs(mixed_texts(spark, sf_dir, every))
    return (mixed.typed_samples(runs, *basis(spark, sf_dir, every, ("en", "he")), params),)


def pairs(every: DataFrame) -> DataFrame:
    """time, active, shadow, layout, on_delimiter: distinct words of the audited lines, on either layout."""
    return word_pairs(ngrams.distinct_words(audit_lines(every)))


def word_pairs(words: DataFrame) -> DataFrame:
    return pairs_of(audit.word_buffers(words))


def mode_pairs(spark: SparkSession, every: DataFrame) -> DataFrame:
    """The same, with `mode`: distinct words by the modes of the documents that hold them."""
    return pairs_of(audit.word_buffers(ngrams.distinct_words(with_mode(spark, audit_lines(every)), "mode"), "en", "mode"), "mode")


def pairs_of(buffers: DataFrame, *keys: str) -> DataFrame:
    return buffers.select(*keys, F.timestamp_seconds(F.lit(1_704_067_200) + 60 * F.length("active")).alias("time"), "active", "shadow", "layout", (F.length("active") % 2 == 0).alias("on_delimiter"))

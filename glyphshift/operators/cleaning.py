"""Cleaning and sampling of corpora."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphshift.functions import text as T


def explode_lines(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, line_no, line: stripped lines that aren't empty."""
    lines = docs.select("doc_id", "lang", "source", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return lines.withColumn("line", T.strip("line")).where("line != ''")


def cap_lines(lines: DataFrame, n: int) -> DataFrame:
    """The first n lines of each language. The rank limit is pushed below the shuffle, so a language sends n lines a task."""
    order = Window.partitionBy("lang").orderBy("doc_id", "line_no")
    return lines.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n).drop("rank")


def sample_mod(df: DataFrame, column: str, rate: int) -> DataFrame:
    return df.where(F.pmod(F.col(column), F.lit(rate)) == 0)


def running_totals(df: DataFrame, block: Column, order: list[str], columns: dict[str, Column]) -> DataFrame:
    """Running sums before each row over a whole ordered table, without taking it through one task: sums within blocks of
    consecutive rows, and the sums of the blocks before, of which there are few."""
    blocked = df.withColumn("block", block)
    sums = blocked.groupBy("block").agg(*(F.sum(c).alias(f"{name}_all") for name, c in columns.items()))
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("block", *(F.coalesce(F.sum(f"{name}_all").over(before), F.lit(0)).alias(f"{name}_off") for name in columns))
    within = Window.partitionBy("block").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = blocked.join(offsets, "block")
    for name, c in columns.items():
        out = out.withColumn(name, F.coalesce(F.sum(c).over(within), F.lit(0)) + F.col(f"{name}_off"))
    return out.drop("block", *(f"{name}_off" for name in columns))


def budget_cut(df: DataFrame, order: list[str], column: str, max_bytes: int = 60_000_000, max_lines: int = 2_000_000, block_rows: int = 65_536) -> DataFrame:
    """Rows until the bytes before (a newline each) reach the budget, or the lines do. The first order column is a number."""
    block = F.floor(F.col(order[0]) / block_rows)
    sized = running_totals(df, block, order, {"bytes_before": F.octet_length(column) + 1, "lines_before": F.lit(1)})
    return sized.where((F.col("bytes_before") < max_bytes) & (F.col("lines_before") < max_lines))


def drop_tombstones(df: DataFrame, column: str) -> DataFrame:
    return df.where(~T.is_tombstone(column))


def script_flags(df: DataFrame, column: str) -> DataFrame:
    return df.withColumns({"has_hebrew": T.has_hebrew(column), "has_english": T.has_english(column), "has_nikud": T.has_nikud(column)})


def pure_lines(lines: DataFrame, lang: str, n: int = 50_000) -> DataFrame:
    """The first n lines of one script only."""
    hebrew, english, nikud = T.has_hebrew("line"), T.has_english("line"), T.has_nikud("line")
    pure = hebrew & ~english & ~nikud if lang == "he" else english & ~hebrew
    return lines.where(pure).orderBy("doc_id", "line_no").limit(n)


def mixed_sample(comments: DataFrame, n: int = 1_000) -> DataFrame:
    """id and text of the first n distinct comments in both scripts, over 20 characters as they came."""
    both = drop_tombstones(comments, "body").where(T.has_hebrew("body") & T.has_english("body") & (F.length("body") > 20))
    clean = both.select("id", T.strip(F.replace("body", F.lit("\n"), F.lit(" "))).alias("text"))
    return clean.groupBy("text").agg(F.min("id").alias("id")).orderBy("id").limit(n).select("id", "text")


def merge_samples(old: DataFrame, new: DataFrame, n: int = 1_000) -> DataFrame:
    """Old samples, then new ones; of equal texts the first; n at most."""
    ranked = old.select(F.lit(0).alias("part"), "id", "text").unionByName(new.select(F.lit(1).alias("part"), "id", "text"))
    first = ranked.groupBy("text").agg(F.min(F.struct("part", "id")).alias("at"))
    return first.orderBy("at").limit(n).select(F.col("at.part").alias("part"), F.col("at.id").alias("id"), "text")


def exclude_sources(df: DataFrame, names: DataFrame, column: str = "source") -> DataFrame:
    """Rows whose source, in small letters, isn't among `names` (name)."""
    return df.join(names.select(F.lower("name").alias("excluded")).distinct(), F.lower(df[column]) == F.col("excluded"), "left_anti")


def flag_technical(df: DataFrame, names: DataFrame, column: str = "source") -> DataFrame:
    """`technical`: whether the source is among `names`."""
    known = names.select(F.lower("name").alias("known")).distinct()
    return df.join(known, F.lower(df[column]) == F.col("known"), "left").withColumn("technical", F.col("known").isNotNull()).drop("known")


def resolve_mode(df: DataFrame, names: DataFrame, default: str = "smart", column: str = "source", mode: str = "mode") -> DataFrame:
    """`resolved`: a row's own mode if it is valid, else the default; `smart` is technical for technical sources."""
    valid = ("smart", "technical", "standard")
    flagged = flag_technical(df, names, column)
    own = F.when(F.col(mode).isin(*valid), F.col(mode)).otherwise(default)
    return flagged.withColumn("resolved", F.when(own != "smart", own).when(F.col("technical"), "technical").otherwise("standard"))


def retain_last(log: DataFrame, n: int = 10_000, order: str = "time", *ties: str) -> DataFrame:
    """The last n rows."""
    return log.orderBy(F.desc(order), *(F.desc(t) for t in ties)).limit(n)

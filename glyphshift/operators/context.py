"""Context segments: a key's events between resets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glyphshift import constants as K


def segment(events: DataFrame, key: str = "user_id", idle: int = K.IDLE_SECONDS, breaks: tuple[str, ...] = K.BREAKS, attribute: str | None = None) -> DataFrame:
    """`events` with `segment`: a new one for each key at the first event, after a gap of more than `idle` seconds, at an event
    of a break type, or where `attribute` changes."""
    order = Window.partitionBy(key).orderBy("ts", "event_id")
    before = F.lag("ts").over(order)
    gap = (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(before.cast("timestamp"))) > idle * 1_000_000
    new = before.isNull() | gap | F.col("event_type").isin(*breaks)
    if attribute:
        new = new | ~F.col(attribute).eqNullSafe(F.lag(attribute).over(order))
    marked = events.withColumn("begins", F.when(new, 1).otherwise(0))
    return marked.withColumn("segment", F.sum("begins").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("begins")


def segment_stats(segmented: DataFrame, key: str = "user_id") -> DataFrame:
    return segmented.groupBy(key, "segment").agg(F.count(F.lit(1)).alias("n_events"), F.min("ts").alias("began"), F.max("ts").alias("ended"))

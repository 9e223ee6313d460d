"""Joins that treat very common keys apart."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key counts as hot if it holds more than this part of all rows, so there are never more hot keys than this.
HOT_KEYS = 10_000


def hot_limit(total: int) -> int:
    """Rows from which on a key of a table of `total` rows is hot."""
    return max(100, total // HOT_KEYS)


def join_back(rows: DataFrame, keyed: DataFrame, keys: list[str], limit: int, how: str = "inner") -> DataFrame:
    """`rows` joined with `keyed`, which has a row for each key: n, the key's rows, and `use`, whether they are wanted. Rows of
    hot keys (n >= limit, a bounded number of keys) meet a broadcast table where they lie; only the others are shuffled."""
    hot, cold = keyed.where(F.col("n") >= limit), keyed.where((F.col("n") < limit) & F.col("use")).drop("n", "use").hint("merge")
    near = rows.join(F.broadcast(hot.where("use").drop("n", "use")), keys, how)
    far = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(cold, keys, how)
    return near.unionByName(far)

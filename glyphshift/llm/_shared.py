"""What the operators of this subpackage have in common."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphshift.operators.joins import hot_limit, join_back  # noqa: F401, shared by the operators here
from glyphshift.session import delete_folder, scratch, shared_folder

#: Rows, and bytes, of the slices of an Arrow batch that are worked on at a time; they bound what a worker holds beside it.
SLICE_ROWS, SLICE_BYTES = 512, 4_000_000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def cut(df: DataFrame) -> DataFrame:
    """`df` computed once and cut from its lineage by a checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


#: Whether Spark deletes a finished query's shuffle files at once, not when the driver next collects its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def write_cut(df: DataFrame) -> DataFrame:
    """Like `cut`, for tables of many rows: written compressed and by column, beside the checkpoints, and read again. The
    shuffle files that the table came from go when it is written; the table goes with `release`."""
    spark = df.sparkSession
    path, before = scratch(spark), spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    table = spark.read.schema(df.schema).parquet(path)
    table.written_at = path
    return table


def release(*tables: DataFrame) -> None:
    """Deletes tables of `write_cut` that no later step reads."""
    for table in tables:
        delete_folder(table.sparkSession, table.written_at)


def texts(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """The text column as Python strings; null is empty."""
    return [t or "" for t in batch.column(name).to_pylist()]


def text_bytes(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """The text column as UTF-8; null is empty."""
    return [t or b"" for t in batch.column(name).cast(pa.binary()).to_pylist()]


def slices(batches: Iterator[pa.RecordBatch], rows: int, size: int) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most `rows` rows and about `size` bytes, one row at least."""
    for batch in batches:
        step = max(1, min(rows, batch.num_rows * size // max(batch.nbytes, 1)))
        for start in range(0, batch.num_rows, step):
            yield batch.slice(start, step)


def map_batches(df: DataFrame, work: Callable[[pa.RecordBatch], pa.RecordBatch], schema, rows: int = SLICE_ROWS, size: int = SLICE_BYTES) -> DataFrame:
    """`work` on each slice of the Arrow batches of `df`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, rows, size):
            out = work(part)
            if out.num_rows:
                yield out

    return df.mapInArrow(run, schema)


def id_and_text(docs: DataFrame) -> DataFrame:
    """Only what an operator reads: further columns, whatever their names, are pruned at the scan."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text, and `key`, a hash of the text: rows that share an id but no text are told apart by it."""
    return id_and_text(docs).withColumn("key", F.xxhash64("text"))

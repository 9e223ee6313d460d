"""Tables that a stream writes batch by batch, and a snapshot that stands for the older batches.

A table is a folder of `batch=<number>` folders. A pointer file names the snapshot and the last batch that is in it; it is replaced
by a rename, so that a reader sees the old state or the new one. Batches that aren't finished, and folders that no pointer names,
are read by nobody: a crash between the steps changes nothing, and the next swap deletes what it left. A stream that repeats a
batch that a snapshot holds already writes nothing.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

POINTER = "_snapshot"


class Batches:
    """The batches of a table at `path`, whose rows have `schema`."""

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path, schema
        self.Path = spark._jvm.org.apache.hadoop.fs.Path
        self.files = self.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def snapshot(self) -> tuple[str | None, int]:
        """The snapshot's folder, if there is one, and the last batch in it."""
        place = self.Path(f"{self.path}/{POINTER}")
        if not self.files.exists(place):
            return None, -1
        stream = self.files.open(place)
        try:
            name, upto = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").split()
        finally:
            stream.close()
        return name, int(upto)

    def numbers(self) -> list[int]:
        """The finished batches that no snapshot holds, in order."""
        upto, place = self.snapshot()[1], self.Path(self.path)
        if not self.files.exists(place):
            return []
        names = [f.getPath().getName() for f in self.files.listStatus(place) if f.isDirectory()]
        every = sorted(int(name.removeprefix("batch=")) for name in names if name.startswith("batch="))
        return [k for k in every if k > upto and self.files.exists(self.Path(f"{self.path}/batch={k}/_SUCCESS"))]

    def folders(self) -> list[str]:
        """What the table is made of, oldest first."""
        name, _ = self.snapshot()
        return [*([f"{self.path}/{name}"] if name else []), *(f"{self.path}/batch={k}" for k in self.numbers())]

    def bytes(self) -> int:
        return sum(self.files.getContentSummary(self.Path(folder)).getLength() for folder in self.folders())

    def read(self, folders: list[str] | None = None) -> DataFrame:
        folders = self.folders() if folders is None else folders
        return self.spark.read.schema(self.schema).parquet(*folders) if folders else self.spark.createDataFrame([], self.schema)

    def write(self, df: DataFrame, number: int) -> None:
        """A batch's rows. A repeated batch replaces its own, or is nothing new if a snapshot holds it."""
        if number > self.snapshot()[1]:
            df.write.mode("overwrite").parquet(f"{self.path}/batch={number}")

    def swap(self, make: Callable[[DataFrame], DataFrame], folders: list[str] | None = None) -> None:
        """Puts what `make` makes of the rows of today's batches (or of those in `folders`) in the place of all of today's batches.
        Batches that are written meanwhile stay."""
        old, numbers = self.snapshot(), self.numbers()
        upto, name = (numbers[-1] if numbers else old[1]), f"_rows-{uuid.uuid4().hex}"
        make(self.read(folders)).write.parquet(f"{self.path}/{name}")
        self.point(name, upto)
        self.clear()

    def point(self, name: str, upto: int) -> None:
        place, fresh = self.Path(f"{self.path}/{POINTER}"), self.Path(f"{self.path}/{POINTER}-{uuid.uuid4().hex}")
        out = self.files.create(fresh, True)
        try:
            out.write(bytearray(f"{name} {upto}".encode()))
        finally:
            out.close()
        jvm = self.spark._jvm
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.files.getUri(), self.spark._jsc.hadoopConfiguration())
        rename = jvm.org.apache.hadoop.fs.Options.Rename
        options = self.spark.sparkContext._gateway.new_array(rename, 1)
        options[0] = rename.OVERWRITE
        context.rename(fresh, place, options)

    def clear(self) -> None:
        """Deletes what the pointer has left behind."""
        name, upto = self.snapshot()
        for status in self.files.listStatus(self.Path(self.path)):
            own = status.getPath().getName()
            past = own.startswith("batch=") and int(own.removeprefix("batch=")) <= upto
            if past or (own.startswith(("_rows-", f"{POINTER}-")) and own != name):
                self.files.delete(status.getPath(), True)


def keep_last(log: Batches, n: int = 10_000, least_bytes: int = 10 * 1024 * 1024, order: str = "time") -> bool:
    """Cuts a log that is larger than `least_bytes` to its last n rows, those of the newest batches and of one batch the latest by
    `order`, beside a writer that goes on. Only the newest batches that hold n rows are read. Whether it was cut."""
    if log.bytes() <= least_bytes:
        return False
    held, rows = [], 0
    for folder in reversed(log.folders()):
        size = log.read([folder]).count()  # from the files' statistics
        held.append((folder, size))
        rows += size
        if rows >= n:
            break
    newer, (oldest, size) = [folder for folder, _ in held[:-1]], held[-1]
    wanted = n - (rows - size)

    def last(_: DataFrame) -> DataFrame:
        part = log.read([oldest])
        if wanted < size:
            part = part.orderBy(part[order].desc()).limit(wanted)
        return part.unionByName(log.read(newer)) if newer else part

    log.swap(last, [oldest])
    return True

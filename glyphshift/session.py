"""Sessions, and the package on the executors."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = Path(__file__).resolve().parent.parent


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A session on this machine, for tests and the benchmark."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.driver.memory", os.environ.get("GLYPHSHIFT_DRIVER_MEMORY", "8g"))
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship_package(spark: SparkSession) -> None:
    """Sends the package's modules to the executors, once a context, so that functions that run there can import them. Stateful
    streams also start a Python worker beside the driver, which doesn't get what is sent: it finds them by its path."""
    context = spark.sparkContext
    if getattr(context, "_glyphshift_shipped", False):
        return
    with tempfile.NamedTemporaryFile(prefix="glyphshift-", suffix=".zip", delete=False) as file:
        with zipfile.ZipFile(file, "w", zipfile.ZIP_DEFLATED) as archive:
            for path in sorted((ROOT / "glyphshift").rglob("*.py")):
                archive.write(path, path.relative_to(ROOT).as_posix())
    context.addPyFile(file.name)
    context.environment["PYTHONPATH"] = os.pathsep.join(filter(None, (str(ROOT), context.environment.get("PYTHONPATH"))))
    context._glyphshift_shipped = True


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. One of our own only where it is unset on a single machine, as in tests."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-"))
    return context.getCheckpointDir()


def delete_folder(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared file system, if it is there."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def move_folder(spark: SparkSession, path: str, to: str) -> None:
    """Puts a folder of the shared file system in another place, whole."""
    jvm = spark._jvm
    old, new = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(to)
    files = old.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(new.getParent())
    if not files.rename(old, new):
        raise OSError(f"{path} can't be moved to {to}")


def scratch(spark: SparkSession) -> str:
    """A path of its own in the shared folder."""
    return f"{shared_folder(spark)}/scratch-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """`df` computed once: written by column in the shared folder and read again."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

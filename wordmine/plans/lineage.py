"""Cutting lineage with tables in the folder that all executors share, and taking bounded lists to the driver."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, Row, SparkSession

#: Most rows of a list, such as a lexicon, that the driver holds and the tasks are sent.
LIST_ROWS = 1_000_000

_stored: list = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; where that is unset a temporary one is set, in local mode alone.

    On a cluster a folder of one machine would lose what other machines write, so there the setting is needed.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="wordmine-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def scratch(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder, removed with all in it when the driver ends, or by ``release``."""
    path = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex[:12]}"
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    _stored.append((place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())))
    return path


def store(df: DataFrame, label: str, by: list[str] | None = None, folder: str | None = None) -> str:
    """Write ``df`` as a new table below ``folder``; its path. ``by`` writes a directory for each value of these columns.

    Without ``folder`` it goes below the shared one and is removed when the driver ends, or by ``release``.
    """
    path = f"{folder.rstrip('/')}/{label}-{uuid.uuid4().hex[:12]}" if folder else scratch(df.sparkSession, label)
    writer = df.write.mode("errorifexists")
    (writer.partitionBy(*by) if by else writer).parquet(path)
    return path


def materialize(df: DataFrame, label: str, by: list[str] | None = None) -> DataFrame:
    """Write ``df`` below the shared folder and read it back.

    Unlike a local checkpoint the files survive the loss of any executor, and later stages start from them instead
    of repeating the work before.
    """
    return df.sparkSession.read.schema(df.schema).parquet(store(df, label, by))


def release() -> int:
    """Remove all tables that ``materialize`` wrote so far; the number of them. What still reads them fails afterwards."""
    n = 0
    while _stored:
        place, files = _stored.pop()
        try:
            n += bool(files.delete(place, True))
        except Exception:  # the JVM or the file system is gone; the folder's owner has to clean up
            _stored.clear()
    return n


atexit.register(release)


def listed(df: DataFrame, what: str, most: int = LIST_ROWS) -> list[Row]:
    """The rows of a list of bounded size; an error if it has more than ``most``."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"{what} has more than {most} rows, which is too many to send to every task")
    return rows

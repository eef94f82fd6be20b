"""Scratch tables in the folder that the driver and all executors share.

They are Parquet files below ``spark.checkpoint.dir``, so a lost executor never takes a step's
result with it. Only local sessions without that setting get a folder of their own, removed at exit.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_folder: str | None = None
_bases: set[str] = set()


def shared_folder(spark: SparkSession) -> str:
    """The shared folder named by the session; a temporary one only where none is set and the master is local."""
    global _own_folder
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if _own_folder is None:
        holder = tempfile.TemporaryDirectory(prefix="quarrymark-")
        atexit.register(holder.cleanup)
        _own_folder = holder.name
    return f"file://{_own_folder}"


def file_system(spark: SparkSession, name: str):
    """The Hadoop path of a name and its file system."""
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def delete(spark: SparkSession, name: str) -> None:
    path, files = file_system(spark, name)
    files.delete(path, True)


def clean_scratch(spark: SparkSession) -> None:
    """Removes all scratch tables of this driver's operators; for when their results have been read."""
    while _bases:
        delete(spark, _bases.pop())


class Scratch:
    """Tables written for one run of one operator; ``drop`` removes those no longer needed.

    What a lazy result still reads stays until ``clean_scratch``.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        _bases.add(self.base)

    def write(self, df: DataFrame, name: str, share: int = 1, **options: str) -> DataFrame:
        """Writes and rereads a table, by as many tasks as its plan has. Rows that are small beside the
        operator's input (ids, links) can be dealt by a shuffle to a ``share``-th of the shuffle's tasks, so that they
        aren't thousands of tiny files; the work before that shuffle keeps its own tasks."""
        path = f"{self.base}/{name}"
        if share > 1:
            df = df.repartition(max(4, int(self.spark.conf.get("spark.sql.shuffle.partitions")) // share))
        df.write.mode("overwrite").options(**options).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            delete(self.spark, f"{self.base}/{name}")

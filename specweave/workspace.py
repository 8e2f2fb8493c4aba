"""Tables that are written once and read again, in the folder all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_OPEN: dict[str, Workspace] = {}


def shared_root(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; where it is unset, a temporary folder of a local session alone."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is unset: executors need a folder that all of them share")
        root = "file://" + tempfile.mkdtemp(prefix="specweave-")
        spark.sparkContext.setCheckpointDir(root)
    # a path without a scheme is one of the default file system, for every reader of it
    path = spark._jvm.org.apache.hadoop.fs.Path(root.rstrip("/"))
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()


class Workspace:
    """A folder of staged tables under :func:`shared_root`.

    ``stage`` cuts lineage with a written table (it survives lost executors);
    ``drop`` removes a staged table once nothing reads it any more, ``close`` all
    of them. What is left, as results read it, goes when the driver's process ends
    or, in a long session, with :func:`close_all` once its results are read.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
        _OPEN[self.path] = self

    def close(self) -> None:
        """Removes the folder; frames that still read it fail."""
        if _OPEN.pop(self.path, None) is not None and self.spark.sparkContext._jsc is not None:
            self.drop("")

    def __enter__(self) -> Workspace:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def stage(self, df: DataFrame, name: str, by: str | None = None) -> DataFrame:
        """Writes a table, in folders by a column where one is given, and returns it as read again."""
        to = f"{self.path}/{name}"
        writer = df.write.mode("overwrite")
        (writer.partitionBy(by) if by else writer).parquet(to)
        return self.spark.read.schema(df.schema).parquet(to)

    def drop(self, *names: str) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}".rstrip("/"))
            path.getFileSystem(conf).delete(path, True)


@atexit.register
def close_all() -> None:
    """Closes every workspace of this process."""
    for ws in list(_OPEN.values()):
        ws.close()


def size_of(spark: SparkSession, *paths: str) -> int:
    """Bytes of files and folders."""
    total = 0
    for p in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        total += path.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(path).getLength()
    return total


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")

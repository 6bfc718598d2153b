"""Tables written between stages.

A plan is cut by writing a table into the folder named in ``spark.checkpoint.dir``, which all executors share; a lost
executor then costs a re-read, never a recomputation from the sources. Nothing here uses localCheckpoint.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder for written intermediate tables.

    ``spark.checkpoint.dir`` wins. Where it is unset, a local master gets a temporary folder and a cluster gets a folder
    below the home directory of its default file system; a cluster whose default file system is node-local is refused.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/") + "/tallyloom"
    app = spark.sparkContext.applicationId
    if app not in _own:
        if spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local":
            _own[app] = "file://" + tempfile.mkdtemp(prefix="tallyloom-")
        else:
            jvm = spark.sparkContext._jvm
            fs = jvm.org.apache.hadoop.fs.FileSystem.get(spark.sparkContext._jsc.hadoopConfiguration())
            if fs.getUri().getScheme() == "file":
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            _own[app] = fs.getHomeDirectory().toString() + f"/.tallyloom/{app}"
    return _own[app]


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session may be gone already
        pass


def written(df: DataFrame, tag: str, partition_by: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back; the files go when the driver ends."""
    spark = df.sparkSession
    path = scratch(spark, tag)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def scratch(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder; what is written there goes when the driver ends."""
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex[:12]}"
    atexit.register(_delete, spark, path)
    return path


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists in its file system."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def is_folder(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


class Batches:
    """A table below one folder of a shared file system that grows by numbered batches, each written once.

    A batch that failed on its way is overwritten; of two writers that want the same number one takes the next.
    """

    #: Appends that may run at the same time before one of them gives up.
    TRIES = 20

    def __init__(self, spark: SparkSession, path: str, schema: str) -> None:
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema

    def count(self) -> int:
        """How many finished batches there are."""
        n = 0
        while exists(self.spark, f"{self.path}/batch={n}/_SUCCESS"):
            n += 1
        return n

    def read(self) -> DataFrame:
        """All rows, with the number of their ``batch``."""
        n, schema = self.count(), f"{self.schema}, batch int"
        return self.spark.read.schema(schema).option("basePath", self.path).parquet(*[f"{self.path}/batch={i}" for i in range(n)]) if n else self.spark.createDataFrame([], schema)

    def append(self, rows: DataFrame) -> None:
        for _ in range(self.TRIES):
            at = f"{self.path}/batch={self.count()}"
            try:
                rows.write.mode("error" if exists(self.spark, at + "/_SUCCESS") else "overwrite").option("compression", "zstd").parquet(at)
                return
            except AnalysisException:  # another writer was faster
                continue
        raise RuntimeError(f"no batch of {self.path} could be written")

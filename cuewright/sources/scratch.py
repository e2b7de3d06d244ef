"""Tables in the folder that the cluster shares: they cut lineage and survive a lost executor."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. Where it isn't set, a local folder, which only a local master can share."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def delete(spark: SparkSession, path: str) -> None:
    """Delete a file or folder of any store that Spark reaches."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


class Scratch:
    """Tables written to the shared folder. ``keep`` writes a frame and reads it back; ``drop`` deletes
    tables that no later frame reads, and all of them if none is named.

    What a returned frame still reads stays until the session's folder is cleared.
    """

    def __init__(self, spark: SparkSession, tag: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{tag}-{uuid.uuid4().hex}"
        self.n = 0

    def path(self) -> str:
        """A new path of this scratch's folder."""
        self.n += 1
        return f"{self.root}/{self.n:04d}"

    def keep(self, df: DataFrame) -> DataFrame:
        path = self.path()
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        paths = [getattr(df, "_scratch_path", None) for df in frames] if frames else [self.root]
        for path in paths:
            if path:
                delete(self.spark, path)

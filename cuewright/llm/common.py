"""Helpers shared by the corpus operators: table reads, shared-folder tables, sizes."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuewright.sources.scratch import shared_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Scratch:
    """Tables written to the shared folder to cut lineage; a later read survives a lost executor.

    ``keep`` writes a frame and reads it back. ``drop`` deletes tables that no later frame reads.
    What a returned frame still reads stays until the session's folder is cleared.
    """

    def __init__(self, spark: SparkSession, tag: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{tag}-{uuid.uuid4().hex}"
        self.n = 0

    def keep(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n:04d}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        jvm = self.spark.sparkContext._jvm
        for df in frames:
            path = getattr(df, "_scratch_path", None)
            if path:
                p = jvm.org.apache.hadoop.fs.Path(path)
                p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def bounded_sample(df: DataFrame, key: str, most: int) -> DataFrame:
    """At most about ``most`` rows, by hash of ``key``: the same rows for the same table, in any order.

    Used only to fit models and to balance trees; never for what is returned.
    """
    n = df.count()
    if n <= most:
        return df
    share = int(most / n * (1 << 30))
    return df.where(F.pmod(F.xxhash64(F.lit("sample"), F.col(key)), F.lit(1 << 30)) < share)


def fresh(name: str, columns: list[str]) -> str:
    """``name``, with underscores after it until no column has it, whatever the case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def slices(texts: list, chars: int):
    """(first index, texts): runs of whole texts of about ``chars`` characters, one longer text alone."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= chars:
            yield start, texts[start : i + 1]
            start, size = i + 1, 0
    if start < len(texts):
        yield start, texts[start:]

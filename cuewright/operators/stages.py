"""Stages of a preparation job, addressed by content: a stage runs again only if its recipe or what it reads has changed.

Files give a digest each, a source the digest of its files' digests, a stage's table the digest of its rows. A stage's
folder is named by the hash of its own recipe and of its inputs' digests, so a run finds the tables of
equal work, whoever made them, and never another's.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Table = Callable[[dict[str, DataFrame]], DataFrame]


@dataclass
class Stage:
    """``run`` gets the tables named in ``reads``: earlier stages and sources. ``recipe`` is what else decides its rows."""

    name: str
    run: Table
    reads: list[str]
    recipe: dict = field(default_factory=dict)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def _sha(*parts) -> str:
    return hashlib.sha256(json.dumps(parts, sort_keys=True).encode()).hexdigest()


def rows_digest(df: DataFrame) -> str:
    """A digest of a table's rows in any order: count, and sum and xor of two hashes a row, in one pass."""
    cols = [F.to_json(F.struct(c)) if t.startswith("map") else F.col(c) for c, t in sorted(df.dtypes)]
    a, b = F.xxhash64(F.lit("sum"), *cols), F.xxhash64(F.lit("xor"), *cols)
    row = df.agg(F.count("*"), F.sum(a.cast("decimal(38,0)")).cast("string"), F.bit_xor(b)).first()
    return _sha(sorted(df.dtypes), *row)


def roll_up(digests: DataFrame, keys: list[str], name: str, digest: str) -> DataFrame:
    """(keys, digest): each group's digest from its members' (name, digest) in any order, one level of a tree.

    Members are not gathered: their SHA-256 of name and digest are added as four 60-bit numbers, and the sums hashed.
    """
    h = F.sha2(F.concat_ws("=", F.col(name).cast("string"), F.col(digest)), 256)
    part = [F.sum(F.conv(F.substring(h, 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)")) for i in range(4)]
    g = digests.groupBy(*keys).agg(F.count("*").alias("__n"), *(p.alias(f"__p{i}") for i, p in enumerate(part)))
    return g.select(*keys, F.sha2(F.concat_ws(":", "__n", *(F.col(f"__p{i}").cast("string") for i in range(4))), 256).alias("digest"))


def source_digest(spark: SparkSession, path: str) -> str:
    """The digest of all files under ``path``: names and contents, read by Spark."""
    from cuewright.sources.records import file_hashes

    base = path.rstrip("/").rsplit("/", 1)[-1]
    files = file_hashes(spark, path, recursive=True).select(F.element_at(F.split("path", f"/{base}(?=/|$)"), -1).alias("name"), "sha256")
    row = roll_up(files, [], "name", "sha256").first()
    return row["digest"] if row else _sha("nothing")


@dataclass
class Run:
    """Tables and digests by stage, and the stages that ran."""

    tables: dict[str, DataFrame]
    digests: dict[str, str]
    ran: list[str]


def prepare(spark: SparkSession, root: str, sources: dict[str, tuple[DataFrame, str]], stages: list[Stage]) -> Run:
    """Run the stages in order, or take up what an equal run has committed.

    ``sources`` has a table and its digest by name. A table counts as committed once Spark's writer has marked it; its digest is
    written after that, so a run that broke off in between counts the rows anew. A stage that reran
    but gave the same rows leaves the stages after it as they are.
    """
    out = Run({n: t for n, (t, _) in sources.items()}, {n: d for n, (_, d) in sources.items()}, [])
    for s in stages:
        path = f"{root}/{s.name}-{_sha(s.name, s.recipe, [out.digests[r] for r in s.reads])[:20]}"
        if not exists(spark, f"{path}/_SUCCESS"):
            s.run({r: out.tables[r] for r in s.reads}).write.mode("overwrite").parquet(path)
            out.ran.append(s.name)
        table = spark.read.parquet(path)
        if not exists(spark, f"{path}.digest/_SUCCESS"):
            spark.createDataFrame([(rows_digest(table),)], "digest string").coalesce(1).write.mode("overwrite").json(f"{path}.digest")
        out.tables[s.name], out.digests[s.name] = table, spark.read.schema("digest string").json(f"{path}.digest").first()["digest"]
    return out

"""JSON-lines and JSON documents, reports, hashes of files, task lists and unit counts."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cuewright.functions.hashing import json_text
from cuewright.operators.layout import numbered
from cuewright.sources.scratch import Scratch, shared_folder


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects): each non-blank line must be a JSON object of ``schema``.

    Rejects have the line and its file. Blank lines are skipped.
    """
    lines = spark.read.text(path).select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("path")).where(F.trim("line") != "")
    full = T.StructType([*schema.fields, T.StructField("__bad", T.StringType())])
    x = lines.withColumn("r", F.from_json("line", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__bad"}))
    ok = F.col("r.__bad").isNull() & F.col("r").isNotNull() & F.ltrim("line").startswith("{")
    return x.where(ok).select(*(F.col(f"r.{f.name}") for f in schema.fields)), x.where(~F.coalesce(ok, F.lit(False))).select("path", "line")


def read_document(spark: SparkSession, path: str, schema: T.StructType, items: str) -> DataFrame:
    """One row per entry of the list ``items`` of JSON documents."""
    return spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode(items).alias("x")).select("x.*")


def canonical_lines(df: DataFrame) -> Column:
    """Each row as compact JSON with sorted keys, ASCII only, nulls kept."""
    return json_text(F.struct(*sorted(df.columns)))


def write_jsonl(df: DataFrame, path: str, split: str | None = None) -> None:
    """Canonical lines, one folder per value of ``split`` if one is given. The commit is atomic by job."""
    cols = [canonical_lines(df.drop(split) if split else df).alias("value")] + ([F.col(split)] if split else [])
    w = df.select(*cols).write.mode("overwrite")
    (w.partitionBy(split) if split else w).text(path)


def write_report(df: DataFrame, path: str) -> None:
    """A small aggregate as one JSON file."""
    df.coalesce(1).write.mode("overwrite").json(path)


def file_hashes(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """(path, length, sha256) of files; one file is one row, so under 2 GB each."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(path)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"))


def task_ids(spark: SparkSession, path: str) -> DataFrame:
    """Task ids of a list whose lines are JSON strings or objects with ``task_id``."""
    v = F.trim("value")
    name = F.coalesce(F.get_json_object(v, "$.task_id"), F.when(v.startswith('"'), F.get_json_object(F.concat(F.lit('{"a":'), v, F.lit("}")), "$.a")))
    return spark.read.text(path).where(v != "").select(name.alias("task_id"))


def unit_total(spark: SparkSession, path: str) -> DataFrame:
    """Sum of ``units``, else ``unit_count``, else 0 over lines; lines that are no JSON count nothing."""
    schema = T.StructType([T.StructField("units", T.LongType()), T.StructField("unit_count", T.LongType())])
    rows, _ = read_jsonl(spark, path, schema)
    return rows.agg(F.coalesce(F.sum(F.coalesce("units", "unit_count", F.lit(0))), F.lit(0)).alias("units"))


def turns_of_spans(df: DataFrame, starts: str, ends: str, speakers: str, most: int = 70, least_s: float = 0.3) -> DataFrame:
    """One row per turn of timestamp arrays: the last entry is left out, at most ``most``, bounds kept, short ones dropped."""
    n = F.least(F.size(starts) - 1, F.lit(most))
    x = df.select("*", F.posexplode(F.slice(F.arrays_zip(F.col(starts).alias("s"), F.col(ends).alias("e"), F.col(speakers).alias("who")), F.lit(1), F.greatest(n, F.lit(0)))).alias("turn", "z"))
    s, e = F.greatest(F.col("z.s"), F.lit(0.0)), F.least(F.col("z.e"), F.col("seconds"))
    return x.select(*[c for c in df.columns if c not in (starts, ends, speakers)], "turn", s.alias("start"), e.alias("end"), F.col("z.who").alias("speaker")).where(F.col("end") - F.col("start") >= least_s)


def transcripts(spark: SparkSession, path: str) -> DataFrame:
    """(utterance_id, text): the first word of a line and the rest without spaces; empty texts dropped."""
    v = F.trim("value")
    x = spark.read.text(path).select(F.regexp_extract(v, r"^(\S+)", 1).alias("utterance_id"), F.regexp_replace(F.regexp_extract(v, r"^\S+\s+(.*)$", 1), r"\s", "").alias("text"))
    return x.where((F.col("utterance_id") != "") & (F.col("text") != ""))


def generated_units(episodes: DataFrame, key: str, units: int, frames: int = 2, codebooks: int = 8, size: int = 2048) -> DataFrame:
    """Deterministic units of each episode: speech_codes[frame][codebook] = (key mod 5 * 7 + unit * 3 + frame + codebook) mod size."""
    x = episodes.select(F.col(key).alias("episode_id"), F.explode(F.sequence(F.lit(0), F.lit(units - 1))).alias("unit_index"))
    start = F.pmod(F.col("episode_id"), F.lit(5)) * 7 + F.col("unit_index") * 3
    code = F.transform(F.sequence(F.lit(0), F.lit(frames - 1)), lambda f: F.transform(F.sequence(F.lit(0), F.lit(codebooks - 1)), lambda q: ((start + f + q) % size).cast("int")))
    return x.select("episode_id", "unit_index", code.alias("speech_codes"), (F.col("unit_index") % 4 == 2).alias("click"), (F.col("unit_index") % 3 != 1).alias("screen_valid"))


def write_manifests(df: DataFrame, split: str, order: list[str], folder: str, splits: list[str]) -> None:
    """Canonical lines in order: ``folder/by/split=<name>/`` for each split, with its ordinals, and ``folder/all/`` for all, with places.

    The whole manifest has the splits in the order of ``splits``, each in its own. Lines go to files by ranges of their place,
    each sorted, so files read by name give the order; no task holds a split.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    scratch = Scratch(spark, "manifests")
    rank = F.array_position(F.array(*map(F.lit, splits)), F.col(split))
    x = numbered(numbered(df, [split], order, "ordinal").withColumn("__rank", rank), [], ["__rank", "ordinal"], "place").drop("__rank")
    x = scratch.keep(x)
    cut = x.repartitionByRange(n, "place").sortWithinPartitions("place")
    cut.select(canonical_lines(x).alias("value")).write.mode("overwrite").text(f"{folder}/all")
    # rows come sorted by a split that is never null, as the writer wants them: a sort of its own would lose their order where it spills
    by = x.withColumn("__split", F.coalesce(F.col(split).cast("string"), F.lit(""))).repartitionByRange(n, "place").sortWithinPartitions("__split", "place")
    by.select(canonical_lines(x.drop("place")).alias("value"), F.col("__split").alias("split")).write.mode("overwrite").partitionBy("split").text(f"{folder}/by")
    scratch.drop()


def audio_rows(df: DataFrame, audio: str = "audio") -> tuple[DataFrame, DataFrame]:
    """(rows with ``bytes``, ``path`` and ``sha256``, rejects) of a table with embedded audio: struct of bytes and path.

    Rows whose bytes are missing or empty are rejects. Parquet is read a row group at a time by Spark.
    """
    raw, rest = F.col(f"{audio}.bytes"), [c for c in df.columns if c != audio]
    ok = F.coalesce(F.octet_length(raw) > 0, F.lit(False))
    good = df.where(ok).select(*rest, raw.alias("bytes"), F.col(f"{audio}.path").alias("path"), F.sha2(raw, 256).alias("sha256"))
    return good, df.where(~ok).select(*rest, F.col(f"{audio}.path").alias("path"))


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the cluster shares."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def latest_by_name(df: DataFrame, key: str, path: str) -> DataFrame:
    """(key, path): the checkpoint whose name comes last."""
    return df.groupBy(key).agg(F.max(path).alias(path))

"""Tar shards of episodes: reading and writing them, unit rows, array members and content hashes."""

from __future__ import annotations

import io
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pyspark.sql.pandas.types import to_arrow_schema

from cuewright.operators.layout import numbered
from cuewright.sources.tars import BATCH_BYTES, BATCH_ROWS, MAX_BYTES, MAX_SAMPLES, TarShards


def read_members(spark: SparkSession, path: str, members: tuple[str, ...] = ()) -> DataFrame:
    """Members of all shards that match ``path`` (braces and wildcards): shard, shard_index, sample_index, sample_key, member, data.

    Shards are ordered by path; samples are numbered in their order in a shard, whose members must stand together.
    Folders and links give nothing. Members that neither ``members`` nor a filter on ``member`` asks for are not read;
    for the filter this enables the session's ``spark.sql.python.filterPushdown.enabled``.
    """
    spark.dataSource.register(TarShards)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    r = spark.read.format("tar_shards").option("pushdown", "true")
    return (r.option("members", ",".join(members)) if members else r).load(path)


def write_samples(members: DataFrame, folder: str, max_bytes: int = MAX_BYTES, max_samples: int = MAX_SAMPLES, tasks: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Write members (sample_key, member, data, and columns for the manifest) as tar shards; returns (manifest, shards).

    A shard is closed once it has reached ``max_bytes`` of data or ``max_samples``. The manifest has a row a sample, with
    the further columns of its first member, its shard, place, size and content_sha256: SHA-256 of names and
    bytes of the members in order. ``shards`` has shard, samples, bytes. A job that fails leaves no file.
    """
    spark = members.sparkSession
    spark.dataSource.register(TarShards)
    n = tasks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    x = members.drop("shard").repartition(n, "sample_key").sortWithinPartitions("sample_key", "member")
    x.write.format("tar_shards").option("max_bytes", max_bytes).option("max_samples", max_samples).mode("append").save(folder)
    return spark.read.json(f"{folder}/manifest-*.jsonl"), committed(spark, folder)


def with_position(members: DataFrame) -> DataFrame:
    """``shard_index``: rank of the shard's path among the distinct ones, for members of several reads."""
    rank = numbered(members.select("shard").distinct(), [], ["shard"], "shard_index").withColumn("shard_index", F.col("shard_index").cast("int"))
    return members.drop("shard_index").join(rank, "shard")


#: Columns of a unit: the member, the array in it (none for an .npy member) and the Spark type of one unit's entry.
TIMELINE = {
    "timestamp_ms": ("timeline.json", "timestamp_ms", "long"), "delta_ms": ("timeline.json", "delta_ms", "int"), "speech_mode": ("timeline.json", "speech_mode", "int"),
    "speech_codes": ("timeline.json", "speech_codes", "array<int>"), "action_tokens": ("timeline.json", "action_tokens", "array<int>"),
}


def _loaded(member: str, data: bytes) -> dict:
    if member.endswith("json"):
        return json.loads(data)
    x = np.load(io.BytesIO(data), allow_pickle=False)
    return {None: x} if isinstance(x, np.ndarray) else dict(x)


def _column(x, kind: pa.DataType) -> pa.Array:
    """An Arrow column of a list or array whose first axis are the units; further axes become lists."""
    if not isinstance(x, np.ndarray):
        return pa.array(x, kind)
    if x.ndim == 1:
        return pa.array(x).cast(kind)
    inner = _column(x.reshape(-1, *x.shape[2:]), kind.value_type)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), inner)


def decode_units(members: DataFrame, columns: dict[str, tuple[str, str | None, str]] = TIMELINE) -> DataFrame:
    """One row per unit: sample_key, unit_index, ``columns`` from array members (.json, .npz, .npy), and error.

    ``members`` as ``read_members`` gives them, a sample's members together: arrays are taken as whole Arrow
    columns, without a shuffle. A sample that lacks an array or whose arrays differ in length gives one row with its error.
    """
    spec = ", ".join(f"`{c}` {t}" for c, (_, _, t) in columns.items())
    schema = f"sample_key string, unit_index int, {spec}, error string"
    kinds = to_arrow_schema(T._parse_datatype_string(schema))
    wanted = {m for m, _, _ in columns.values()}

    def rows(key, got):
        why, out, n = None, [], 0
        try:
            found = {m: _loaded(m, d) for m, d in got.items()}
            out = [_column(found[m][a], kinds.field(c).type) for c, (m, a, _) in columns.items()]
            n = len(out[0])
            if any(len(c) != n for c in out):
                why = "arrays of different lengths: " + ", ".join(f"{c} {len(x)}" for c, x in zip(columns, out))
        except (KeyError, ValueError, TypeError, pa.ArrowException) as e:
            why = f"{type(e).__name__}: {e}"
        if why:
            out, n = [pa.nulls(1, kinds.field(c).type) for c in columns], 1
        index = pa.nulls(1, pa.int32()) if why else pa.array(np.arange(n, dtype=np.int32))
        return pa.RecordBatch.from_arrays([pa.array([key] * n), index, *out, pa.array([why] * n, pa.string())], schema=kinds)

    def decoded(batches):
        key, got = None, {}
        for b in batches:
            for shard, k, m, d in zip(*(b.column(c) for c in ("shard", "sample_key", "member", "data"))):
                at = (shard.as_py(), k.as_py())
                if at != key:
                    if key is not None:
                        yield rows(key[1], got)
                    key, got = at, {}
                got[m.as_py()] = d.as_py()
        if key is not None:
            yield rows(key[1], got)

    def run(batches):
        held, n = [], 0
        for b in decoded(batches):
            held.append(b)
            n += len(b)
            if n >= BATCH_ROWS:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, n = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    return members.where(F.col("member").isin(*wanted)).select("shard", "sample_key", "member", "data").mapInArrow(run, schema)


def pack_units(units: DataFrame, key: str, order: str, arrays: list[str], member: str = "timeline.npz") -> DataFrame:
    """(sample_key, member, data): unit rows of each ``key`` as one member of numeric arrays, units in ``order``.

    Lists must have one length within a sample. An episode's units fit in a task. Units are dealt by key and sorted; a task
    reads its episodes as a stream of Arrow slices, one call for all of them.
    """

    def episodes(batches):
        """(key, slices) of runs of one key, which may go on from one batch into the next."""
        now, parts = None, []
        for b in batches:
            keys = b.column("key")
            code = keys.dictionary_encode().indices.fill_null(-1).to_numpy()
            cuts = np.r_[0, np.flatnonzero(code[1:] != code[:-1]) + 1, len(code)]
            for start, end in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                if start == end:
                    continue
                k = keys[start].as_py()
                if parts and k != now:
                    yield now, parts
                    parts = []
                now = k
                parts.append(b.slice(start, end - start))
        if parts:
            yield now, parts

    def stacked(parts, c):
        x = [p.column(c) for p in parts]
        if not pa.types.is_list(x[0].type):
            return np.concatenate([v.to_numpy(zero_copy_only=False) for v in x])
        size = np.unique(np.concatenate([v.value_lengths().to_numpy(zero_copy_only=False) for v in x]))
        if len(size) != 1 or size[0] != size[0]:
            raise ValueError(f"{c}: lists of different lengths")
        return np.concatenate([v.flatten().to_numpy(zero_copy_only=False) for v in x]).reshape(-1, int(size[0])) if size[0] else np.zeros((sum(map(len, x)), 0))

    def run(batches):
        rows, size = [], 0
        batch = lambda: pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([member] * len(rows), pa.string()), pa.array([r[1] for r in rows], pa.binary())], ["sample_key", "member", "data"])
        for key, parts in episodes(batches):
            out = io.BytesIO()
            np.savez_compressed(out, **{c: stacked(parts, c) for c in arrays})
            rows.append((str(key), out.getvalue()))
            size += len(rows[-1][1])
            if len(rows) >= BATCH_ROWS or size >= BATCH_BYTES:
                yield batch()
                rows, size = [], 0
        if rows:
            yield batch()

    n = int(units.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    x = units.select(F.col(key).cast("string").alias("key"), F.col(order).alias("order"), *arrays).repartition(n, "key").sortWithinPartitions("key", F.col("order").asc_nulls_last())
    return x.select("key", *arrays).mapInArrow(run, "sample_key string, member string, data binary")


def identity_faults(hashes: DataFrame, manifest: DataFrame) -> DataFrame:
    """(sample_key, fault): samples of shards that are repeated, not in the manifest, missing from it, or of other content.

    Both sides have sample_key and content_sha256. Keys are counted on either side in one pass over their union.
    """
    side = lambda df, a, b: df.select("sample_key", "content_sha256", F.lit(a).alias("in_shard"), F.lit(b).alias("in_list"))
    x = side(hashes, 1, 0).unionByName(side(manifest, 0, 1))
    x = x.groupBy("sample_key").agg(F.sum("in_shard").alias("a"), F.sum("in_list").alias("b"), F.min("content_sha256").alias("lo"), F.max("content_sha256").alias("hi"))
    fault = F.when((F.col("a") > 1) | (F.col("b") > 1), "repeated").when(F.col("b") == 0, "extra").when(F.col("a") == 0, "missing").when(F.col("lo") != F.col("hi"), "different")
    return x.select("sample_key", fault.alias("fault")).where("fault is not null")


def content_hashes(members: DataFrame) -> DataFrame:
    """(sample_key, content_sha256): SHA-256 of key and bytes of all members in order of their names."""
    x = members.groupBy("sample_key").agg(F.sort_array(F.collect_list(F.struct("member", "data"))).alias("m"))
    joined = F.aggregate("m", F.lit(b"").cast("binary"), lambda s, p: F.concat(s, F.encode(p["member"], "UTF-8"), p["data"]))
    return x.select("sample_key", F.sha2(joined, 256).alias("content_sha256"))


def write_shards(members: DataFrame, shard: str, folder: str) -> DataFrame:
    """Write members (``shard`` number, sample_key, member, data) as one tar file a number; returns (path, samples, bytes).

    Shard 7 is ``folder/000007.tar``. A shard is streamed by one task, so it may be larger than the task's memory.
    """
    spark = members.sparkSession
    spark.dataSource.register(TarShards)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    x = members.select(F.col(shard).cast("long").alias("shard"), "sample_key", "member", "data").repartition(n, "shard").sortWithinPartitions("shard", "sample_key", "member")
    x.write.format("tar_shards").mode("append").save(folder)
    return committed(spark, folder).select(F.concat(F.lit(f"{folder}/"), "shard").alias("path"), "samples", "bytes")


def committed(spark: SparkSession, folder: str) -> DataFrame:
    """(shard, samples, bytes) of the shards that finished jobs have left in ``folder``."""
    entry = T.StructType([T.StructField("shard", T.StringType()), T.StructField("samples", T.LongType()), T.StructField("bytes", T.LongType())])
    return spark.read.schema(entry).option("multiLine", True).option("pathGlobFilter", "committed-*.json").json(f"{folder}/committed-*.json")


def archive_utterances(members: DataFrame, transcripts: DataFrame) -> DataFrame:
    """(utterance_id, text, data): sounds of an archive that have a transcript; others on either side give nothing."""
    sounds = members.where("member = 'wav'").select(F.element_at(F.split("sample_key", "/"), -1).alias("utterance_id"), "data")
    return transcripts.join(sounds, "utterance_id")

"""Joins of plans, receipts, voices, segments, ticks and lineage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def with_receipts(turns: DataFrame, receipts: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(turns with their receipt, turns that have none)."""
    return turns.join(receipts, keys), turns.join(receipts, keys, "left_anti")


def exclude_overlapping(items: DataFrame, used: DataFrame, id_col: str, ids_col: str, used_col: str) -> DataFrame:
    """Items none of whose ids (an array) was used before; items with no ids stay."""
    hit = items.select(id_col, F.explode(ids_col).alias("__one")).join(used.select(F.col(used_col).alias("__one")).distinct(), "__one", "left_semi")
    return items.join(hit.select(id_col).distinct(), id_col, "left_anti")


def pick_by_position(rows: DataFrame, pool: DataFrame, keys: list[str], index_col: str, order_col: str) -> DataFrame:
    """Each row gets the pool entry of its keys at ``index % size``, in the order of ``order_col``."""
    w = W.partitionBy(*keys)
    ranked = pool.withColumn("__pos", F.row_number().over(w.orderBy(order_col)) - 1)
    sizes = pool.groupBy(*keys).agg(F.count("*").alias("__size"))
    x = rows.join(sizes, keys).withColumn("__pos", F.col(index_col) % F.col("__size"))
    return x.join(ranked, [*keys, "__pos"]).drop("__pos", "__size")


def pick_voices(turns: DataFrame, voices: DataFrame, index: str, splits: list[str], assistant: str = "assistant") -> DataFrame:
    """``turns`` with ``voice`` and ``fault``: of the voices of a turn's role, language and split the one at ``index % size``.

    ``voices`` has voice, language, role and split. A multilingual voice serves every language of the turns, a voice without
    split every split, an assistant voice every language. Pools are ranked by voice once, and both joins are by
    pool and place. A turn whose pool is empty keeps its row, with the fault ``no voice``.
    """
    spoken = turns.select(F.col("language").alias("__l")).distinct()
    any_language = (F.col("language") == "multilingual") | (F.col("role") == assistant)
    own = voices.where(~any_language).withColumn("__l", F.col("language"))
    pool = own.unionByName(voices.where(any_language).crossJoin(spoken))  # languages are few
    pool = pool.select("voice", "role", F.col("__l").alias("language"), F.explode(F.when(F.col("split").isNull(), F.array(*map(F.lit, splits))).otherwise(F.array("split"))).alias("split"))
    keys = ["role", "language", "split"]
    w = W.partitionBy(*keys)
    ranked = pool.distinct().withColumn("__at", F.row_number().over(w.orderBy("voice")) - 1)
    x = turns.join(ranked.groupBy(*keys).agg(F.count("*").alias("__size")), keys, "left").withColumn("__at", F.col(index) % F.col("__size"))
    x = x.join(ranked, [*keys, "__at"], "left")
    return x.withColumn("fault", F.when(F.col("__size").isNull(), "no voice")).drop("__at", "__size")


def compare_keyed(a: DataFrame, b: DataFrame, key: str, values: list[str]) -> DataFrame:
    """Rows (key, status) for keys missing on a side or with unequal values; equal keys give none."""
    x = a.select(key, *(F.col(v).alias(f"a_{v}") for v in values), F.lit(1).alias("__a"))
    y = b.select(key, *(F.col(v).alias(f"b_{v}") for v in values), F.lit(1).alias("__b"))
    j = x.join(y, key, "full_outer")
    differs = F.lit(False)
    for v in values:
        differs = differs | ~F.col(f"a_{v}").eqNullSafe(F.col(f"b_{v}"))
    status = F.when(F.col("__b").isNull(), "missing").when(F.col("__a").isNull(), "extra").when(differs, "different")
    return j.select(key, status.alias("status")).where("status is not null")


def segment_ticks(segments: DataFrame, frame: int, start: str = "start_sample", end: str = "end_sample") -> DataFrame:
    """One row per tick a segment touches: from start div frame to (end - 1) div frame."""
    lo, hi = F.floor(F.col(start) / frame), F.floor((F.col(end) - 1) / frame)
    return segments.withColumn("tick", F.explode(F.when(hi >= lo, F.sequence(lo, hi)).otherwise(F.array().cast("array<long>"))))


def tick_spine(episodes: DataFrame, n_ticks: str) -> DataFrame:
    n = F.col(n_ticks)
    return episodes.withColumn("tick", F.explode(F.when(n > 0, F.sequence(F.lit(0).cast("long"), n.cast("long") - 1)).otherwise(F.array().cast("array<long>"))))


def active_ticks(spine: DataFrame, segments: DataFrame, key: str, frame: int) -> DataFrame:
    """The spine with ``active``: whether a segment of its episode covers the tick. An equi-join."""
    on = segment_ticks(segments, frame).select(key, "tick").distinct().withColumn("active", F.lit(True))
    return spine.join(on, [key, "tick"], "left").withColumn("active", F.coalesce("active", F.lit(False)))


def cache_lookup(wanted: DataFrame, cache: DataFrame, key: str, digest: str, actual: str) -> tuple[DataFrame, DataFrame]:
    """(hits, misses): an entry counts only while its artifact still has the recorded digest."""
    good = cache.where(F.col(digest) == F.col(actual))
    return wanted.join(good.drop(digest, actual), key), wanted.join(good, key, "left_anti")


def lineage_breaks(stages: DataFrame, previous: dict[str, str]) -> DataFrame:
    """Checkpoints whose parent is not a checkpoint of the stage that must come before theirs."""
    need = F.lit(None).cast("string")
    for stage, before in previous.items():
        need = F.when(F.col("stage") == stage, F.lit(before)).otherwise(need)
    p = stages.select(F.col("sha256").alias("__sha"), F.col("stage").alias("__stage"))
    j = stages.withColumn("__need", need).join(p, F.col("parent_sha256") == F.col("__sha"), "left")
    return j.where(~F.col("__need").eqNullSafe(F.col("__stage"))).select(*stages.columns)


def unequal_fields(a: DataFrame, b: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, mismatched): names of fields that differ, null-safe, for keys on both sides."""
    y = b.select(key, *(F.col(f).alias(f"__{f}") for f in fields))
    names = F.array_compact(F.array(*(F.when(~F.col(f).eqNullSafe(F.col(f"__{f}")), F.lit(f)) for f in fields)))
    return a.join(y, key).select(key, names.alias("mismatched")).where(F.size("mismatched") > 0)


def update_from(df: DataFrame, fresh: DataFrame, key: str, column: str) -> DataFrame:
    """``column`` from ``fresh`` where it has the key, else unchanged; ``changed`` tells which."""
    y = fresh.select(key, F.col(column).alias("__new"))
    x = df.join(y, key, "left").withColumn("changed", F.col("__new").isNotNull() & ~F.col("__new").eqNullSafe(F.col(column)))
    return x.withColumn(column, F.coalesce("__new", column)).drop("__new")


def first_per(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def lock_faults(catalog: DataFrame, lock: DataFrame, key: str, version: str, digest: str) -> DataFrame:
    """(key, fault) where a source lock differs from its catalog: keys of one side only, another version, no hash."""
    a = catalog.select(key, F.col(version).alias("__a"), F.lit(1).alias("__in_a"))
    b = lock.select(key, F.col(version).alias("__b"), F.col(digest).alias("__h"), F.lit(1).alias("__in_b"))
    j = a.join(b, key, "full_outer")
    why = (
        F.when(F.col("__in_b").isNull(), "not locked").when(F.col("__in_a").isNull(), "not in catalog")
        .when(~F.col("__a").eqNullSafe(F.col("__b")), "version").when(F.coalesce(F.col("__h"), F.lit("")) == "", "no hash")
    )
    return j.select(key, why.alias("fault")).where("fault is not null")


def lock_archives(lock: DataFrame, key: str, archives: str, own: str) -> DataFrame:
    """One row per archive of a lock's records; a record without archives is its own."""
    each = F.when(F.size(F.coalesce(F.col(archives), F.array().cast("array<string>"))) > 0, F.col(archives)).otherwise(F.array(F.col(own)))
    return lock.select(key, F.posexplode(each).alias("archive_no", "archive"))


def hash_faults(lock: DataFrame, found: DataFrame, key: str, expected: str, actual: str) -> DataFrame:
    """(key, fault) of archives that weren't found or whose hash isn't the expected one."""
    j = lock.select(key, expected).join(found.select(key, actual), key, "left")
    why = F.when(F.col(actual).isNull(), "missing").when(~F.lower(actual).eqNullSafe(F.lower(expected)), "different")
    return j.select(key, why.alias("fault")).where("fault is not null")


def receipt_faults(receipts: DataFrame, metrics: DataFrame, key: str, loudness: str, digest: str, low: float = -24.0, high: float = -22.0) -> DataFrame:
    """(key, fault) of loudness receipts: no metrics, metrics of another hash, or loudness outside the bounds."""
    j = receipts.select(key, F.col(digest).alias("__want"), loudness).join(metrics.select(key, F.col(digest).alias("__have")), key, "left")
    why = F.when(F.col("__have").isNull(), "no metrics").when(~F.col("__have").eqNullSafe(F.col("__want")), "hash").when(~F.coalesce(F.col(loudness).between(low, high), F.lit(False)), "loudness")
    return j.select(key, why.alias("fault")).where("fault is not null")

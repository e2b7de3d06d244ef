"""Calls to injected scorers and encoders: one factory call a partition, failures as rows, cached results."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuewright.functions.hashing import json_text
from cuewright.sources.scratch import Scratch

ERROR_CHARS = 1000


def call_rows(df: DataFrame, factory: Callable, key: str, text: str) -> DataFrame:
    """(key, output, score, error): ``factory()`` gives a function of a text that returns (output, score).

    A call that raises gives a row with the last 1,000 characters of its message instead.
    """

    def run(batches):
        call = factory()
        for b in batches:
            rows = []
            for k, t in zip(b[key], b[text]):
                try:
                    out, s = call(t)
                    rows.append((k, out, float(s), None))
                except Exception as e:
                    rows.append((k, None, None, str(e)[-ERROR_CHARS:]))
            yield pd.DataFrame(rows, columns=[key, "output", "score", "error"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text).mapInPandas(run, f"{key} {kind}, output string, score double, error string")


def attempts(df: DataFrame, factory: Callable, key: str, text: str, best: float, most: int = 2) -> DataFrame:
    """(key, output, score, error, attempts): each row's first good call, else its last, of at most ``most``.

    All attempts of a row are made by one task, one after the other; ``factory`` is called once a partition.
    """

    def run(batches):
        call = factory()
        for b in batches:
            rows = []
            for k, t in zip(b[key], b[text]):
                for n in range(1, most + 1):
                    try:
                        out, s = call(t)
                        row = (k, out, float(s), None, n)
                    except Exception as e:
                        row = (k, None, None, str(e)[-ERROR_CHARS:], n)
                    if row[2] is not None and row[2] <= best:
                        break
                rows.append(row)
            yield pd.DataFrame(rows, columns=[key, "output", "score", "error", "attempts"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text).mapInPandas(run, f"`{key}` {kind}, output string, score double, error string, attempts int")


def generate(df: DataFrame, cache: DataFrame, factory: Callable, key: str, text: str, best: float = 0.20, scratch: Scratch | None = None) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) rows (key, output, score, attempts; rejected with error too) of at most two attempts per content.

    Content already in ``cache`` (key, output, score) isn't called; equal content is called once;
    a first score above ``best`` or an error gets a second try. The calls' results are written to a table, and both
    results read that: no use of them calls a model again, and a key is in one of them only.
    """
    scratch = scratch or Scratch(df.sparkSession, "generate")
    wanted = df.select(key, text).dropDuplicates([key])
    hits = wanted.join(cache, key).select(key, "output", "score", F.lit(None).cast("string").alias("error"), F.lit(0).alias("attempts"))
    misses = wanted.join(cache, key, "left_anti")
    rows = hits.unionByName(scratch.keep(attempts(misses, factory, key, text, best)))
    good = F.coalesce(F.col("score") <= best, F.lit(False))
    return rows.where(good).drop("error"), rows.where(~good)


def generation_job(turns: DataFrame, plans: DataFrame, receipts: DataFrame, recipe: dict[str, str], factory: Callable, best: float = 0.20, seconds: tuple[float, float] = (0.3, 15.0)) -> tuple[DataFrame, DataFrame]:
    """(receipts, rejects): one row a turn that has an output of the present recipe, and one a turn without.

    ``turns`` has plan_id, turn_id and the columns of ``recipe``'s values, ``plans`` plan_id and recipe_sha256. A turn's
    recipe is the canonical JSON of ``recipe`` (name to column) and its plan's hash; its content is the same without plan and turn.
    An old receipt (plan_id, turn_id, recipe_sha256, output, score, seconds, attempts) with the turn's recipe hash is kept as it is. Other
    turns are generated, one content once, by ``factory()``: a function of the recipe's JSON that returns
    (output, score, seconds). Durations outside the bounds and scores above ``best`` are tried again once and then rejected,
    with the reason. Turns whose plan is gone are rejected as stale.
    """
    scratch = Scratch(turns.sparkSession, "generation")
    text = json_text(F.struct(*(F.col(c).alias(name) for name, c in sorted(recipe.items()))))
    x = turns.join(plans.select("plan_id", F.col("recipe_sha256").alias("plan_sha256")), "plan_id", "left").withColumn("recipe", text)
    x = x.withColumn("content", F.sha2("recipe", 256)).withColumn("recipe_sha256", F.sha2(F.concat_ws("\n", "plan_id", "plan_sha256", "turn_id", "recipe"), 256))
    x = scratch.keep(x.select("plan_id", "turn_id", "plan_sha256", "recipe", "content", "recipe_sha256"))
    live = x.where("plan_sha256 is not null")
    same = ["plan_id", "turn_id", "recipe_sha256"]
    kept = receipts.join(live.select(*same), same, "left_semi").select(*same, "output", "score", "seconds", "attempts")
    todo = live.join(receipts.select(*same), same, "left_anti")

    def checked():
        call = factory()

        def one(recipe):
            out, score, length = call(recipe)
            if not seconds[0] <= length <= seconds[1]:
                raise ValueError(f"duration {length:g} s")
            return f"{length:.6f}\n{out}", score

        return one

    made = scratch.keep(attempts(todo.select("content", "recipe").dropDuplicates(["content"]), checked, "content", "recipe", best))
    made = made.withColumn("seconds", F.substring_index("output", "\n", 1).cast("double")).withColumn("output", F.expr("substring(output, instr(output, '\n') + 1)"))
    y = todo.join(made, "content")
    good = F.coalesce(F.col("score") <= best, F.lit(False))
    fresh = y.where(good).select(*same, "output", "score", "seconds", "attempts")
    why = F.coalesce("error", F.concat(F.lit("score "), F.round("score", 6).cast("string")))
    stale = x.where("plan_sha256 is null").select("plan_id", "turn_id", F.lit("stale plan").alias("reason"))
    return kept.unionByName(fresh), y.where(~good).select("plan_id", "turn_id", why.alias("reason")).unionByName(stale)


def encode_episodes(frames: DataFrame, factory: Callable, key: str, order: str, wave: str, frame: int, most: int | None = None) -> DataFrame:
    """(key, codes, error): each episode's chunks in order through an injected encoder, failures alone.

    The last chunk is padded with zeros to a whole frame. Episodes are dealt by key and sorted, and each task reads its
    rows as a stream with one encoder (``factory`` is called once a partition), so an episode's waves are never held together. An
    episode of more than ``most`` codes is given up with an error.
    """
    kind = frames.schema[key].dataType.simpleString()

    def run(batches):
        call, now, codes, error = factory(), None, [], None
        for b in batches:
            out = []
            for k, w in zip(b[key], b[wave]):
                if now is not None and k != now[0]:
                    out.append((now[0], None if error else codes, error))
                    codes, error = [], None
                now = (k,)
                if error:
                    continue
                try:
                    w = list(w) + [0.0] * (-len(w) % frame)
                    codes.extend(int(c) for i in range(0, len(w), frame) for c in call(w[i : i + frame]))
                    if most is not None and len(codes) > most:
                        raise ValueError(f"more than {most} codes")
                except Exception as e:
                    codes, error = [], str(e)[-ERROR_CHARS:]
            yield pd.DataFrame(out, columns=[key, "codes", "error"])
        if now is not None:
            yield pd.DataFrame([(now[0], None if error else codes, error)], columns=[key, "codes", "error"])

    n = int(frames.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    x = frames.select(key, order, wave).where(F.col(key).isNotNull()).repartition(n, key).sortWithinPartitions(key, order)
    return x.mapInPandas(run, f"`{key}` {kind}, codes array<int>, error string")


def response_faults(language: str = "language", metric: str = "metric", score: str = "score"):
    """Rules of a scoring response: the metric fits the language and the score is in [0, 1]."""
    from cuewright.functions.checks import failed

    fits = F.col(metric) == F.when(F.col(language) == "zh", "cer").otherwise("wer")
    return failed(metric=fits, score=F.col(score).between(0, 1))


def migrate_metadata(df: DataFrame, defaults: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """(version 5 rows, rejects): version 4 rows get defaults for missing identity and a nested copy of it."""
    good, bad = df.where("schema_version = 4"), df.where("schema_version IS NULL OR schema_version <> 4")
    for c, v in defaults.items():
        good = good.withColumn(c, F.coalesce(F.col(c), F.lit(v)))
    return good.withColumn("runtime_identity", F.struct(*defaults)).withColumn("schema_version", F.lit(5)), bad

"""Audits and roll-ups: duplicates, leaks, licences, accuracies, losses and latency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def duplicate_keys(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def leaks(df: DataFrame, dims: list[str], split: str) -> DataFrame:
    """(dimension, value, splits): values seen in more than one split, all dimensions in one pass.

    Values are compared as text; nulls of a dimension are one value.
    """
    pairs = F.explode(F.array(*(F.struct(F.lit(d).alias("dimension"), F.coalesce(F.col(d).cast("string"), F.lit("null")).alias("value")) for d in dims)))
    x = df.select(F.col(split).alias("__s"), pairs.alias("p")).select("p.*", "__s").distinct()
    return x.groupBy("dimension", "value").agg(F.sort_array(F.collect_set("__s")).alias("splits")).where(F.size("splits") > 1)


def session_leaks(df: DataFrame, device: str, session: str, split: str) -> DataFrame:
    """(device, session) in more than one split; rows with an empty one are ignored, no split is ''."""
    x = df.where((F.coalesce(device, F.lit("")) != "") & (F.coalesce(session, F.lit("")) != ""))
    return x.groupBy(device, session).agg(F.count_distinct(F.coalesce(split, F.lit(""))).alias("n_splits")).where("n_splits > 1")


def last_record(df: DataFrame, keys: list[str], ordinal: str, values: list[str]) -> DataFrame:
    """Per key the values of the record with the largest ordinal."""
    return df.groupBy(*keys).agg(F.max_by(F.struct(*values), ordinal).alias("s")).select(*keys, "s.*")


def masked_accuracy(df: DataFrame, hit: Column, mask: Column, *keys: str) -> DataFrame:
    g = df.groupBy(*keys) if keys else df.groupBy()
    n = F.sum(mask.cast("int"))
    return g.agg(F.sum((hit & mask).cast("int")).alias("hits"), n.alias("total"), (F.sum((hit & mask).cast("int")) / F.greatest(n, F.lit(1))).alias("accuracy"))


def codebook_accuracy(df: DataFrame, predicted: str, target: str, mask: str) -> DataFrame:
    """Accuracy by codebook over arrays of codes and masks."""
    x = df.select(F.posexplode(F.arrays_zip(F.col(predicted).alias("p"), F.col(target).alias("t"), F.col(mask).alias("m"))).alias("codebook", "z"))
    return masked_accuracy(x, F.col("z.p") == F.col("z.t"), F.col("z.m"), "codebook")


def precision_recall(df: DataFrame, predicted: Column, actual: Column) -> DataFrame:
    tp = F.sum((predicted & actual).cast("int"))
    return df.agg(
        (tp / F.greatest(F.sum(predicted.cast("int")), F.lit(1))).alias("precision"),
        (tp / F.greatest(F.sum(actual.cast("int")), F.lit(1))).alias("recall"),
    )


def ratio_of_sums(df: DataFrame, key: str, parts: dict[str, tuple[str, str]], nan_if_empty: set[str] = frozenset()) -> DataFrame:
    """Per key, sum of numerators over sum of denominators; an empty one is NaN or over 1."""
    out = []
    for name, (num, den) in parts.items():
        d = F.sum(den)
        empty = F.lit(float("nan")) if name in nan_if_empty else F.sum(num).cast("double")
        out.append(F.when(d == 0, empty).otherwise(F.sum(num) / d).alias(name))
    return df.groupBy(key).agg(*out)


def set_marks(df: DataFrame, keys: list[str], member: str) -> DataFrame:
    """(keys, n, mark_sum, mark_xor) of each key's members: equal for equal multisets in any order, one row a key.

    Two 64-bit hashes a member, one summed, one xored, so that no list of members is ever gathered.
    """
    h = F.xxhash64(F.lit("sum"), member).cast("decimal(38,0)")
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(h).alias("mark_sum"), F.bit_xor(F.xxhash64(F.lit("xor"), member)).alias("mark_xor"))


def set_differences(left: DataFrame, right: DataFrame, keys: list[str], member: str) -> DataFrame:
    """(keys, member, status): members on one side only, ``missing`` on the right or ``extra`` there.

    Members are joined only for keys whose marks differ. Keys must not be null.
    """
    a, b = set_marks(left, keys, member), set_marks(right, keys, member)
    same = a.join(b, [*keys, "n", "mark_sum", "mark_xor"]).select(*keys)
    x, y = (df.select(*keys, member).join(same, keys, "left_anti") for df in (left, right))
    lost = x.join(y, [*keys, member], "left_anti").withColumn("status", F.lit("missing"))
    return lost.unionByName(y.join(x, [*keys, member], "left_anti").withColumn("status", F.lit("extra")))


def rows_of_leaks(df: DataFrame, session: list[str], split: str) -> DataFrame:
    """Rows whose session, all its parts given and not empty, stands in more than one split."""
    whole = F.lit(True)
    for c in session:
        whole = whole & F.coalesce(F.col(c) != "", F.lit(False))
    bad = df.where(whole).groupBy(*session).agg(F.min(split).alias("__a"), F.max(split).alias("__b")).where("__a <> __b").select(*session)
    return df.join(bad, session, "left_semi")


def with_recipe(df: DataFrame, fields: list[str], out: str) -> DataFrame:
    """``out``: SHA-256 of the canonical JSON of a plan's fields."""
    from cuewright.functions.hashing import json_text

    return df.withColumn(out, F.sha2(json_text(F.struct(*sorted(fields))), 256))


def plan_faults(plans: DataFrame, fields: list[str], recipe: str = "recipe_sha256", plan: str = "plan_id", status: str = "status") -> DataFrame:
    """Plans with ``faults``: not generated, a recipe hash that is not that of its fields (stale), an empty or a repeated id."""
    from cuewright.functions.checks import failed

    x = with_recipe(plans, fields, "__now").join(duplicate_keys(plans, plan).select(plan, F.lit(True).alias("__twice")), plan, "left")
    why = failed(status=F.col(status) == "generated", stale=F.col(recipe) == F.col("__now"), empty=F.trim(plan) != "", repeated=F.col("__twice").isNull())
    return x.withColumn("faults", why).where(F.size("faults") > 0).drop("__now", "__twice")


def manifest_report(manifest: DataFrame, stored: DataFrame, key: str, session: list[str], split: str) -> DataFrame:
    """(fault, n): rows of a manifest with a licence fault, a repeated key or a session in several splits, and keys that are
    ``missing`` among the stored ones or ``extra`` there, one row a kind that occurs.

    ``manifest`` has the columns that ``checks.licensed`` reads. Id sets are compared by marks of hash buckets first, so
    that equal sets cost two sums and no join of ids.
    """
    from cuewright.functions.checks import licensed

    twice = duplicate_keys(manifest, key).select(key)
    named = lambda df, fault: df.select(F.lit(fault).alias("fault"))
    bucket = lambda df: df.select(key, F.pmod(F.xxhash64(key), F.lit(4096)).alias("bucket"))
    sets = set_differences(bucket(manifest), bucket(stored), ["bucket"], key).select(F.col("status").alias("fault"))
    x = named(manifest.where(~licensed(manifest)), "license").unionByName(named(manifest.join(twice, key, "left_semi"), "duplicate"))
    x = x.unionByName(named(rows_of_leaks(manifest, session, split), "session")).unionByName(sets)
    return x.groupBy("fault").agg(F.count("*").alias("n"))


def exact_quantiles(df: DataFrame, keys: list[str], value: str, shares: dict[str, float], accuracy: int = 1000) -> DataFrame:
    """(keys, n, a column a share): interpolated quantiles, exact, without all values of a key in one buffer.

    A first pass keeps a mergeable sketch a key, whose ranks are off by at most 1 / ``accuracy``, and so gives bounds
    between which the wanted places lie. A second pass counts what lies below and keeps only the distinct values between,
    about 6 / ``accuracy`` of them. Nulls are left out; keys may be null.
    """
    margin, few = 3 / accuracy, F.col("n") < accuracy  # of few values all are kept: the margin is under a place
    at = [(name, p, max(0.0, p - margin), min(1.0, p + margin)) for name, p in shares.items()]
    x = df.select(*keys, F.col(value).cast("double").alias("__v")).where("__v is not null")
    marks = F.percentile_approx("__v", [q for _, _, lo, hi in at for q in (lo, hi)], accuracy)
    first = x.groupBy(*keys).agg(F.count("*").alias("n"), F.min("__v").alias("__lo"), F.max("__v").alias("__hi"), marks.alias("__q"))
    bound = [
        F.struct(
            F.lit(name).alias("name"), F.lit(float(p)).alias("p"),
            (F.col("__lo") if lo == 0.0 else F.when(few, F.col("__lo")).otherwise(F.least(F.get("__q", F.lit(2 * i)), F.get("__q", F.lit(2 * i + 1))))).alias("lo"),
            (F.col("__hi") if hi == 1.0 else F.when(few, F.col("__hi")).otherwise(F.greatest(F.get("__q", F.lit(2 * i)), F.get("__q", F.lit(2 * i + 1))))).alias("hi"),
        )
        for i, (name, p, lo, hi) in enumerate(at)
    ]
    first = first.select("n", F.explode(F.array(*bound)).alias("b"), *(F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)))
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    y = x.join(first, same).where(F.col("__v") <= F.col("b.hi"))
    kept = [f"__k{i}" for i in range(len(keys))]
    y = y.groupBy(*kept, "b.name", "b.p", "n", F.when(F.col("__v") >= F.col("b.lo"), F.col("__v")).alias("__v")).agg(F.count("*").alias("__c"))
    w = W.partitionBy(*kept, "name").orderBy(F.col("__v").asc_nulls_first()).rowsBetween(W.unboundedPreceding, W.currentRow)
    place = F.col("p") * (F.col("n") - 1)
    y = y.withColumn("__to", F.sum("__c").over(w)).groupBy(*kept, "name", "p", "n")
    y = y.agg(*(F.min(F.when(F.col("__to") > F.least(r, F.col("n") - 1), F.col("__v"))).alias(c) for c, r in (("__a", F.floor(place)), ("__b", F.floor(place) + 1))))
    y = y.withColumn("__out", F.col("__a") + (F.col("__b") - F.col("__a")) * (place - F.floor(place)))
    return y.groupBy(*kept, "n").agg(*(F.max(F.when(F.col("name") == name, F.col("__out"))).alias(name) for name in shares)).withColumnsRenamed(dict(zip(kept, keys)))


def latency(df: DataFrame, ms: str, *keys: str) -> DataFrame:
    """(keys, n, mean_ms, p95_ms, max_ms): n counts all rows, the others those with a number."""
    g = df.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(ms).alias("mean_ms"), F.max(ms).alias("max_ms"))
    q = exact_quantiles(df, list(keys), ms, {"p95_ms": 0.95}).select("p95_ms", *(F.col(k).alias(f"__j{i}") for i, k in enumerate(keys)))
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__j{i}"))
    return g.join(q, same, "left").select(*keys, "n", "mean_ms", "p95_ms", "max_ms")


def score_gate(df: DataFrame, metric: str, score: str, metrics: list[str], row_most: float = 0.20, mean_most: float = 0.08) -> DataFrame:
    """Per metric: rows, mean score and whether each row and the mean pass; an absent metric scores 1."""
    have = df.groupBy(metric).agg(F.count("*").alias("n"), F.avg(score).alias("mean"), F.max(score).alias("worst"))
    want = df.sparkSession.createDataFrame([(m,) for m in metrics], f"{metric} string")
    x = want.join(have, metric, "left").select(metric, F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("mean", F.lit(1.0)).alias("mean"), F.coalesce("worst", F.lit(1.0)).alias("worst"))
    return x.withColumn("passed", (F.col("worst") <= row_most) & (F.col("mean") <= mean_most))


def voice_isolation(voices: DataFrame, voice: str, role: str, split: str, language: str, languages: list[str]) -> DataFrame:
    """(gate, n, passed): one assistant voice in all, no user voice in two splits, every language with a user voice."""
    said = voices.where(F.col(role) == "assistant").agg(F.count_distinct(voice).alias("n"))
    users = voices.where(F.col(role) != "assistant")
    shared = users.groupBy(voice).agg(F.count_distinct(split).alias("k")).where("k > 1").agg(F.count("*").alias("n"))
    heard = users.where(F.col(language).isin(*languages)).agg((F.lit(len(languages)) - F.count_distinct(language)).alias("n"))
    row = lambda df, gate, ok: df.select(F.lit(gate).alias("gate"), F.col("n").cast("long").alias("n"), ok.alias("passed"))
    n = F.col("n")
    return row(said, "assistant voices", n == 1).unionByName(row(shared, "shared user voices", n == 0)).unionByName(row(heard, "languages without a voice", n == 0))


def tally(df: DataFrame, ok: Column, *keys: str, least: int = 100) -> DataFrame:
    """(keys, checked, failed, passed): passed if at least ``least`` rows were checked and none failed. Null is a failure."""
    bad = F.count_if(~F.coalesce(ok, F.lit(False)))
    return df.groupBy(*keys).agg(F.count("*").alias("checked"), bad.alias("failed"), ((F.count("*") >= least) & (bad == 0)).alias("passed"))


def streaks(df: DataFrame, key: str, order: list[str], idle: str, most: int = 100) -> DataFrame:
    """(key, longest, passed): the longest run of rows in order where ``idle`` holds, and whether it stays under ``most``."""
    from cuewright.operators.layout import mode_runs

    runs = mode_runs(df, key, order, idle).where(idle).groupBy(key, "run").agg(F.count("*").alias("k"))
    x = df.select(key).distinct().join(runs.groupBy(key).agg(F.max("k").alias("k")), key, "left")
    return x.select(key, F.coalesce("k", F.lit(0)).alias("longest"), (F.coalesce("k", F.lit(0)) < most).alias("passed"))

"""Dialogue timelines, run segmentation, bursts and other ordered work, as windows within a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cuewright.functions.clock import FRAME, RATE, align_up
from cuewright.functions.hashing import positional_split
from cuewright.sources.scratch import Scratch


def running(df: DataFrame, keys: list[str], order: list[str], value: Column, out: str, down: bool = False) -> DataFrame:
    """``out``: the sum of ``value`` over the rows of the same keys that come before in ``order``.

    Keys and order may have any type that Spark sorts, and any number of rows a key: rows are cut into
    ranges of keys and order and kept with the number of their range, so that sums and windows
    see the same cut. At most one key continues from one range into the next, so what has to be added
    is at most a row a range, and is broadcast. ``down`` turns the first order column round. Rows whose first
    order column is null come last. Rows that are equal in all order columns share a range and
    follow each other in no fixed order.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    first = F.col(order[0]).desc_nulls_last() if down else F.col(order[0]).asc_nulls_last()
    cut = df.withColumn("__run_v", value).repartitionByRange(n, *(F.col(k) for k in keys), first, *(F.col(c) for c in order[1:]))
    x = Scratch(df.sparkSession, "running").keep(cut.withColumn("__run_b", F.spark_partition_id()))
    sums = x.groupBy(*keys, "__run_b").agg(F.sum("__run_v").alias("__run_s"))
    w = W.partitionBy(*keys).orderBy("__run_b").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.withColumn("__run_before", F.sum("__run_s").over(w)).where("__run_before is not null")
    small = sums.select("__run_before", *(F.col(k).alias(f"__run_k{i}") for i, k in enumerate([*keys, "__run_b"])))
    same = F.lit(True)
    for i, k in enumerate([*keys, "__run_b"]):
        same = same & F.col(k).eqNullSafe(F.col(f"__run_k{i}"))
    y = x.join(F.broadcast(small), same, "left").drop(*(c for c in small.columns if c != "__run_before"))
    w = W.partitionBy(*keys, "__run_b").orderBy(first, *order[1:]).rowsBetween(W.unboundedPreceding, -1)
    zero = F.lit(0)
    return y.withColumn(out, F.coalesce("__run_before", zero) + F.coalesce(F.sum("__run_v").over(w), zero)).drop("__run_v", "__run_b", "__run_before")


def numbered(df: DataFrame, keys: list[str], order: list[str], out: str) -> DataFrame:
    """``out``: the place of each row among those of its keys, from 0. The order must have no ties."""
    return running(df, keys, order, F.lit(1).cast("long"), out)


def split_by_place(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """``split``: 80/10/10 by the place of each row among those of its keys, which must not be null."""
    x = numbered(df, keys, order, "__place").join(df.groupBy(*keys).agg(F.count("*").alias("__n")), keys)
    return x.withColumn("split", positional_split(F.col("__place"), F.col("__n"))).drop("__place", "__n")


def dialogue_timeline(turns: DataFrame, plan: str = "plan_id", turn: str = "turn", role: str = "role", samples: str = "samples", frame: int = FRAME) -> DataFrame:
    """start_sample and end_sample of every turn.

    Speech starts after two frames; each turn starts on a frame after the one before, an assistant
    turn three frames later. As a sum: 2F + aligned lengths of earlier turns + 3F per assistant turn so far.
    """
    w = W.partitionBy(plan).orderBy(turn)
    before = F.coalesce(F.sum(align_up(F.col(samples), frame)).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    waits = F.sum(F.when(F.col(role) == "assistant", 1).otherwise(0)).over(w.rowsBetween(W.unboundedPreceding, W.currentRow))
    start = (2 * frame + before + 3 * frame * waits).cast("long")
    return turns.withColumn("start_sample", start).withColumn("end_sample", (F.col("start_sample") + F.col(samples)).cast("long"))


def timeline_length(laid: DataFrame, seconds: Column, plan: str = "plan_id", frame: int = FRAME) -> DataFrame:
    """Samples of each plan: its target length or its last turn and three frames, whichever is later."""
    last = laid.groupBy(plan).agg(F.max("end_sample").alias("last_end"), F.first(seconds).alias("seconds"))
    return last.select(plan, "last_end", F.greatest(align_up((F.col("seconds") * RATE).cast("long"), frame), align_up(F.col("last_end"), frame) + 3 * frame).cast("long").alias("timeline_samples"))


def source_layout(items: DataFrame, samples: str, reply: str | None = None, frame: int = FRAME) -> DataFrame:
    """Two frames of lead, the utterance, a reply after four more frames if there is one, four frames of tail."""
    lead = F.lit(2 * frame)
    x = items.withColumn("speech_start", lead.cast("long")).withColumn("speech_end", (lead + F.col(samples)).cast("long"))
    if reply is None:
        return x.withColumn("timeline_samples", (align_up(F.col("speech_end"), frame) + 4 * frame).cast("long"))
    x = x.withColumn("reply_start", align_up(F.col("speech_end") + 4 * frame, frame).cast("long"))
    return x.withColumn("timeline_samples", (align_up(F.col("reply_start") + F.col(reply), frame) + 4 * frame).cast("long"))


def segment_faults(segments: DataFrame, key: str, gap: int, frame: int = FRAME) -> DataFrame:
    """Segments that are empty, off the frame grid, or start before ``gap`` free frames have passed."""
    w = W.partitionBy(key).orderBy("start_sample", "end_sample")
    stop = F.floor((F.col("end_sample") - 1) / frame)
    last = F.max(stop).over(w.rowsBetween(W.unboundedPreceding, -1))
    why = (
        F.when(F.col("end_sample") <= F.col("start_sample"), "empty")
        .when(F.col("start_sample") % frame != 0, "unaligned")
        .when(F.floor(F.col("start_sample") / frame) <= last + gap, "overlap")
    )
    return segments.withColumn("fault", why).where("fault is not null")


def not_increasing(df: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    w = W.partitionBy(key).orderBy(*order)
    return df.withColumn("previous", F.lag(value).over(w)).where(F.col(value) <= F.col("previous"))


def sparse_index(df: DataFrame, key: str, order: list[str], valid: str) -> DataFrame:
    """``screen_index``: how many valid rows came before, -1 where this one isn't; ``revision``: how many so far."""
    w = W.partitionBy(key).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    n = F.sum(F.col(valid).cast("int")).over(w)
    return df.withColumn("revision", n).withColumn("screen_index", F.when(F.col(valid), n - 1).otherwise(-1))


def interleave(df: DataFrame, split: str, category: str, order: list[str], known: list[str]) -> DataFrame:
    """``ordinal`` within each split: one of each known category in turn, unknown ones last in input order."""
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, known)), F.col(category)), F.lit(0))
    x = df.withColumn("__rank", rank)
    # unknown categories count as one
    x = numbered(x.withColumn("__one", F.when(F.col("__rank") > 0, F.col("__rank")).otherwise(0)), [split, "__one"], order, "__n")
    sizes = x.groupBy(split).agg(*(F.count_if(F.col("__one") == k).alias(f"__c{k}") for k in range(len(known) + 1)))
    x = x.join(sizes, split)
    # of each known category come the rows of earlier turns, and of this turn those of smaller rank
    before = [F.least(F.col(f"__c{k}"), F.col("__n") + F.when(F.lit(k) < F.col("__rank"), 1).otherwise(0)) for k in range(1, len(known) + 1)]
    total = lambda cols: sum(cols, F.lit(0).cast("long"))
    known_rows = total([F.col(f"__c{k}") for k in range(1, len(known) + 1)])
    ordinal = F.when(F.col("__rank") > 0, total(before)).otherwise(known_rows + F.col("__n"))
    return x.withColumn("ordinal", ordinal).drop("__rank", "__one", "__n", *(f"__c{k}" for k in range(len(known) + 1)))


def capped(df: DataFrame, keys: list[str], order: list[str], most: int) -> DataFrame:
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= most).drop("__n")


def mode_runs(df: DataFrame, key: str, order: list[str], active: str) -> DataFrame:
    """``reset``: silence turned to speech here; ``run``: number of the stretch of equal mode."""
    w = W.partitionBy(key).orderBy(*order)
    was = F.lag(active).over(w)
    x = df.withColumn("reset", F.col(active) & ~F.coalesce(was, F.lit(False))).withColumn("__edge", (was.isNull() | (was != F.col(active))).cast("int"))
    return x.withColumn("run", F.sum("__edge").over(w.rowsBetween(W.unboundedPreceding, W.currentRow))).drop("__edge")


def assemble_bursts(tokens: DataFrame, key: str, order: list[str], token: str, end: int = 1) -> DataFrame:
    """One row per finished event: (key, event, tokens) in order. What has no end yet gives nothing."""
    w = W.partitionBy(key).orderBy(*order)
    ends = F.coalesce(F.sum((F.col(token) == end).cast("int")).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    x = tokens.withColumn("event", ends).withColumn("__at", F.row_number().over(w))
    g = x.groupBy(key, "event").agg(F.sort_array(F.collect_list(F.struct("__at", F.col(token).alias("t")))).alias("s"))
    g = g.select(key, "event", F.transform("s", lambda p: p["t"]).alias("tokens"))
    return g.where(F.element_at("tokens", -1) == end)


def shard_ids(df: DataFrame, split: str, order: list[str], size: str, most: int) -> DataFrame:
    """``shard``: total size of the rows before, in order, divided by the most a shard holds."""
    return running(df, [split], order, F.col(size), "__sum").withColumn("shard", F.floor(F.col("__sum") / most)).drop("__sum")


def next_cursor(df: DataFrame, shard: str, sample: str, unit: str) -> DataFrame:
    """Where to resume after each unit: the next unit of the sample, or the next sample at unit 0."""
    w = W.partitionBy(shard, sample).orderBy(unit)
    more = F.lead(unit).over(w)
    return df.withColumn("next_sample", F.when(more.isNull(), F.col(sample) + 1).otherwise(F.col(sample))).withColumn("next_unit", F.coalesce(more, F.lit(0)))


def normalised_advantage(df: DataFrame, group: str, reward: str, eps: float = 1e-6) -> DataFrame:
    """(reward - mean) / (population deviation + eps); 0 and inactive where the deviation is at most eps."""
    w = W.partitionBy(group)
    x = df.withColumn("group_size", F.count("*").over(w)).withColumn("mu", F.avg(reward).over(w)).withColumn("sigma", F.stddev_pop(reward).over(w))
    live = (F.col("sigma") > eps) & (F.col("group_size") >= 2)
    return x.withColumn("active", live).withColumn("advantage", F.when(live, (F.col(reward) - F.col("mu")) / (F.col("sigma") + eps)).otherwise(0.0))


def boundary_jump(df: DataFrame, key: str, order: str, wave: str) -> DataFrame:
    """Step between neighbouring chunks in dB against the 95th percentile of both chunks' inner steps.

    Chunks of one key follow each other by ``order``; the last has no next chunk and gives no row.
    """
    x = numbered(df.select(key, order), [key], [order], "__n").join(df.select(key, order, F.transform(wave, lambda v: v.cast("double")).alias("a")), [key, order])
    nxt = x.select(key, (F.col("__n") - 1).alias("__n"), F.col("a").alias("b"))
    x = x.join(nxt, [key, "__n"]).drop("__n")
    steps = lambda c: F.zip_with(F.slice(c, F.lit(2), F.greatest(F.size(c) - 1, F.lit(0))), F.slice(c, F.lit(1), F.greatest(F.size(c) - 1, F.lit(0))), lambda p, q: F.abs(p - q))
    s = F.array_sort(F.concat(steps(F.col("a")), steps(F.col("b"))))
    pos = (F.size("s") - 1) * F.lit(0.95)
    lo = F.floor(pos).cast("int")
    p95 = F.get("s", lo) + (F.get("s", F.least(lo + 1, F.size("s") - 1)) - F.get("s", lo)) * (pos - lo)
    jump = F.abs(F.element_at("b", 1) - F.element_at("a", -1))
    x = x.withColumn("s", s)
    return x.select(key, order, (20 * F.log10(F.greatest(jump, F.lit(1e-8)) / F.greatest(p95, F.lit(1e-8)))).alias("jump_db"))


def screen_faults(df: DataFrame, key: str, ticks: str, frames: str, n_ticks: str) -> DataFrame:
    """(key, faults) of sparse screens: repeated ticks, ticks and frames of unequal length, ticks outside the episode."""
    from cuewright.functions.checks import failed

    t = F.col(ticks)
    why = failed(unique=F.size(F.array_distinct(t)) == F.size(t), length=F.size(t) == F.size(frames), range=F.forall(t, lambda x: x.between(0, F.col(n_ticks) - 1)))
    return df.select(key, why.alias("faults")).where(F.size("faults") > 0)


def assign_tasks(groups: DataFrame, tasks: DataFrame, order: list[str], update: str, group: str, per_update: int, seed: int) -> DataFrame:
    """``groups`` with the columns of their task and ``seed``: the tasks in ``order`` go round over updates and groups.

    Group g of update u gets task (u * per_update + g) mod the number of tasks, and the seed seed + 1000 u + g. Tasks may be many: they
    are numbered in ranges and joined by their place.
    """
    listed = numbered(tasks, [], order, "__task")
    n = tasks.agg(F.count("*").alias("__n"))  # one row
    x = groups.crossJoin(F.broadcast(n)).withColumn("__task", (F.col(update) * per_update + F.col(group)) % F.col("__n"))
    return x.join(listed, "__task").withColumn("seed", seed + F.col(update) * 1000 + F.col(group)).drop("__task", "__n")


def in_global_order(df: DataFrame, *order: str) -> DataFrame:
    """Rows in one order over all files: range partitions, each sorted."""
    return df.orderBy(*order)


def assemble_plans(ids: DataFrame, index: str, templates: DataFrame, intents: int) -> DataFrame:
    """One row per turn of a text plan: plan_id, turn, role, language, duration_class, text.

    Plan i speaks English if i is a multiple of five, else Chinese; i mod 20 gives its duration class
    and six turns from twelve on, else two; intents go round. ``templates`` has (language, intent,
    text), a small table.
    """
    i, k = F.col(index), F.col(index) % 20
    x = ids.select(
        i.alias("i"), F.concat(F.lit("plan-"), F.lpad(i.cast("string"), F.greatest(F.length(i.cast("string")), F.lit(6)), F.lit("0"))).alias("plan_id"),
        F.when(i % 5 == 0, "en").otherwise("zh").alias("language"), (i % intents).cast("int").alias("intent"),
        F.when(k < 8, "short").when(k < 16, "medium").otherwise("long").alias("duration_class"), F.when(k >= 12, 6).otherwise(2).alias("n_turns"),
    )
    x = x.join(templates, ["language", "intent"]).withColumn("turn", F.explode(F.sequence(F.lit(0), F.col("n_turns") - 1)))
    role = F.when(F.col("turn") % 2 == 0, "user").otherwise("assistant")
    return x.select("plan_id", "turn", role.alias("role"), "language", "duration_class", F.concat_ws(" ", "text", (F.col("turn") + 1).cast("string"), F.col("i").cast("string")).alias("text"))


def seeded_order(df: DataFrame, ordinal: str, seed: int, out: str) -> DataFrame:
    """``out``: the place of each row in a shuffle fixed by the seed: the order of the hash of seed and ordinal."""
    h = F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col(ordinal).cast("string")), 256)
    return numbered(df.withColumn("__h", h), [], ["__h", ordinal], out).drop("__h")

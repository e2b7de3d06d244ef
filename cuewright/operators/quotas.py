"""Duration quotas: roll-ups, dense reports, tolerances, allocation, waterfills and quota-fitting jobs."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cuewright.operators.layout import numbered, running

DIMS = ["category", "language", "split"]


def roll_up(df: DataFrame, value: str, dims: list[str] = DIMS) -> DataFrame:
    """Sums by all dimensions, by each one and in total, in one pass of grouping sets."""
    sets = [[F.col(d) for d in dims], *([F.col(d)] for d in dims), []]
    g = df.groupingSets(sets, *(F.col(d) for d in dims))
    return g.agg(F.grouping_id(*dims).alias("level"), F.sum(value).alias("seconds"), F.count("*").alias("n"))


def dense_report(df: DataFrame, targets: DataFrame, value: str, dims: list[str] = DIMS) -> DataFrame:
    """One row per target cell, zero where nothing was found."""
    have = df.groupBy(*dims).agg(F.sum(value).alias("actual_seconds"), F.count("*").alias("episodes"))
    return targets.join(have, dims, "left").select(*dims, "target_seconds", F.coalesce("actual_seconds", F.lit(0.0)).alias("actual_seconds"), F.coalesce("episodes", F.lit(0)).alias("episodes"))


def quota_targets(spark, total: float, categories: dict[str, float], languages: dict[str, float], splits: dict[str, float]) -> DataFrame:
    """The dense product of three small domains with their shares."""
    side = lambda name, d: spark.createDataFrame([(k, float(v)) for k, v in d.items()], f"{name} string, {name}_share double").coalesce(1)
    x = side("category", categories).crossJoin(side("language", languages)).crossJoin(side("split", splits))
    return x.select("category", "language", "split", (F.lit(total) * F.col("category_share") * F.col("language_share") * F.col("split_share")).alias("target_seconds"))


def relative_error(actual: Column, target: Column) -> Column:
    return F.when(target == 0, F.when(actual == 0, 0.0).otherwise(1.0)).otherwise(F.abs(actual - target) / target)


def allocate(df: DataFrame, group: list[str], order: str, low: str, high: str, target: Column) -> DataFrame:
    """Each row gets its low plus a share of the rest by capacity; the last row takes the residue.

    ``feasible`` is false where the target lies outside the group's bounds; such groups get null.
    """
    x = df.withColumn("__t", target).withColumn("__cap", F.col(high) - F.col(low))
    sums = x.groupBy(*group).agg(F.sum(low).alias("__lo"), F.sum(high).alias("__hi"), F.sum("__cap").alias("__all"), F.max(order).alias("__end"))
    x = x.join(sums, group)
    share = F.col(low) + F.when(F.col("__all") > 0, (F.col("__t") - F.col("__lo")) * F.col("__cap") / F.col("__all")).otherwise(0.0)
    x = x.withColumn("__share", share).withColumn("__last", F.col(order) == F.col("__end"))
    x = x.join(x.groupBy(*group).agg(F.sum("__share").alias("__given")), group)
    ok = F.col("__t").between(F.col("__lo"), F.col("__hi"))
    seconds = F.round(F.col("__share") + F.when(F.col("__last"), F.col("__t") - F.col("__given")).otherwise(0.0), 6)
    x = x.withColumn("seconds", seconds).withColumn("feasible", ok)
    return x.withColumn("seconds", F.when(F.col("feasible"), F.col("seconds"))).drop("__t", "__cap", "__lo", "__hi", "__all", "__end", "__share", "__last", "__given")


def waterfill(df: DataFrame, group: list[str], order: list[str], capacity: str, amount: Column, down: bool = False) -> DataFrame:
    """``taken``: the amount is poured into rows in order, each up to its capacity; ``short`` is what is left.

    ``down`` turns the first order column round. Groups may be of any size.
    """
    x = running(df.withColumn("__amount", amount), group, order, F.col(capacity), "__before", down)
    x = x.withColumn("taken", F.least(F.col(capacity), F.greatest(F.lit(0), F.col("__amount") - F.col("__before"))))
    x = x.join(df.groupBy(*group).agg(F.sum(capacity).alias("__all")), group)
    return x.withColumn("short", F.greatest(F.lit(0), F.col("__amount") - F.col("__all"))).drop("__amount", "__before", "__all")


def transfer(rows: DataFrame, group: list[str], order: list[str], give: str, room: str) -> DataFrame:
    """``given`` and ``received``: what rows of a group have over goes to those with room, first come first filled.

    The amount moved in a group is the smaller of all it can give and all it has room for; both sides
    are filled in order. What a group has left over or open is in ``over`` and ``open``.
    """
    sums = rows.groupBy(*group).agg(F.sum(give).alias("__give"), F.sum(room).alias("__room"))
    moved = F.least("__give", "__room")
    x = rows.join(sums, group)
    x = running(x, group, order, F.col(give), "__g")
    x = running(x, group, order, F.col(room), "__r")
    part = lambda cap, before: F.least(F.col(cap), F.greatest(F.lit(0), moved - F.col(before)))
    x = x.withColumn("given", part(give, "__g")).withColumn("received", part(room, "__r"))
    x = x.withColumn("over", F.col("__give") - moved).withColumn("open", F.col("__room") - moved)
    return x.drop("__give", "__room", "__g", "__r")


#: Largest number of ticks that a subset search keeps apart; beyond it ticks are measured in larger steps.
MOST_TICKS = 100_000_000


def _reach(parts: list[tuple[int, int]], top: int) -> int:
    """Bit set of the totals up to ``top`` that some of the parts (size, place) make."""
    seen, mask = 1, (1 << (top + 1)) - 1
    for size, _ in parts:
        if size <= top:
            seen |= (seen << size) & mask
    return seen


def _bits(seen: int, top: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(seen.to_bytes(top // 8 + 1, "little"), np.uint8), bitorder="little")[: top + 1]


def _chosen(parts: list[tuple[int, int]], total: int) -> list[int]:
    """Places of parts that make exactly ``total``, which they can: the halves' bit sets tell how much either half gives."""
    if total == 0:
        return []
    if len(parts) == 1:
        return [parts[0][1]]
    half = len(parts) // 2
    left, right = (_bits(_reach(x, total), total) for x in (parts[:half], parts[half:]))
    give = int(np.argmax(left & right[::-1]))
    del left, right
    return _chosen(parts[:half], give) + _chosen(parts[half:], total - give)


def best_subset(hist: list[tuple[int, int]], target: int, tolerance: float = 0.02, most_ticks: int = MOST_TICKS) -> dict[int, int] | None:
    """How many of each tick value to take so that the total is nearest to the target, ties to the smaller.

    ``hist`` has (ticks, count). Counts are split in powers of two, reachable totals are bit sets, two at a time: the choice
    is found by halving the parts, so memory doesn't grow with their number. None if no reachable total is
    within the tolerance. Where the totals looked at exceed ``most_ticks``, values are rounded to steps of so many ticks that they
    don't; the total is then nearest up to half a step a row taken.
    """
    top = int(target * (1 + tolerance))
    step = max(1, -(-top // most_ticks))
    items: list[tuple[int, int]] = []
    value = {}
    for ticks, n in sorted(hist):
        small, k = (ticks + step // 2) // step, 1
        while n > 0 and small > 0:
            take = min(k, n)
            value[len(items)] = ticks
            items.append((small, take))
            n -= take
            k *= 2
    goal, top, least = target / step, top // step, -(-int(np.ceil(target * (1 - tolerance))) // step)
    parts = [(small * k, i) for i, (small, k) in enumerate(items)]
    seen = _bits(_reach(parts, top), top)
    ok = np.flatnonzero(seen[least:]) + least
    if not len(ok):
        return None
    best = int(ok[np.lexsort((ok, np.abs(ok - goal)))[0]])
    del seen, ok
    out: dict[int, int] = {}
    for i in _chosen(parts, best):
        out[value[i]] = out.get(value[i], 0) + items[i][1]
    return out


def fit_buckets(rows: DataFrame, targets: DataFrame, bucket: str, ticks: str, order: str, tolerance: float = 0.02) -> DataFrame:
    """Rows chosen so that each bucket's ticks come nearest to its ``target`` within the tolerance.

    Only a histogram of tick values per bucket enters Python, one group per bucket; rows are then
    taken by order. Buckets that can't be met give no row.
    """
    hist = rows.groupBy(bucket, ticks).agg(F.count("*").alias("n")).join(targets.select(bucket, "target"), bucket)

    def solve(g: pd.DataFrame) -> pd.DataFrame:
        take = best_subset(list(zip(g[ticks].tolist(), g["n"].tolist())), int(g["target"].iloc[0]), tolerance) or {}
        return pd.DataFrame({"bucket": [str(g[bucket].iloc[0])] * len(take), "ticks": list(take), "take": list(take.values())}).astype({"ticks": "int64", "take": "int64"})

    picks = hist.groupBy(bucket).applyInPandas(solve, "bucket string, ticks long, take long")
    x = rows.withColumn("__n", F.row_number().over(W.partitionBy(bucket, ticks).orderBy(order)))
    x = x.withColumn("__b", F.col(bucket).cast("string")).withColumn("__t", F.col(ticks).cast("long"))
    x = x.join(picks.withColumnsRenamed({"bucket": "__b", "ticks": "__t"}), ["__b", "__t"])
    return x.where(F.col("__n") <= F.col("take")).drop("__n", "__b", "__t", "take")


#: fixed values: seconds that a plan of each class may last
CLASS_BOUNDS = {"short": (4, 16), "medium": (16, 32), "long": (32, 60)}


#: Short counts that are looked at together by one call
STRETCH = 16_384
BEST = "gap double, off long, middle double, count long, short long, medium long, long long, attainable double"


def _best_counts(short: np.ndarray, n_medium: int, n_long: int, n: int, goal: int, above: int, below: int, wish: int, unit: int) -> tuple | None:
    """The best (gap, off, middle, count, short, medium, long, attainable) with one of these short counts; None if there is none.

    Times are whole numbers of ``unit`` a second; ``above`` and ``below`` is what the group has over all lows and lacks to all highs.
    For a count c = 7 q + r and a short count, the medium counts that keep the gap within g run from the largest of
    four numbers to the least of four others, all linear in q: so the q with any are an interval, and no pair is spelled out.
    """
    lows, highs = (np.array([b[i] for b in CLASS_BOUNDS.values()]) for i in (0, 1))
    (ls, lm, ll), (hs, hm, hl) = lows * unit, highs * unit
    ceil = lambda a, b: -(-a // b)

    def mediums(c, s, g):
        """Bounds of the medium count: (lower ones), (upper ones)."""
        low, high = ll * c - (ll - ls) * s, hl * c - (hl - hs) * s  # seconds without a medium one; each in a long one's place takes some off
        zero = np.zeros_like(low)
        return (
            (ceil(low - goal - g, ll - lm), ceil(high - below - goal - g, hl - hm), zero, zero + c - s - n_long),
            ((low + above - goal + g) // (ll - lm), (high - goal + g) // (hl - hm), zero + n_medium, zero + c - s),
        )

    r, period = np.arange(7)[:, None], 7
    slopes = (ll * period // (ll - lm), hl * period // (hl - hm), 0, period)  # of both kinds of bounds

    def periods(g):
        """Least and greatest q by r and short count."""
        lower, upper = mediums(r, short, g)
        least, most = np.broadcast_to(ceil(1 - r, period), lower[0].shape).copy(), np.broadcast_to((n - 1 - r) // period, lower[0].shape).copy()
        for i, a in zip(slopes, lower):
            for k, b in zip(slopes, upper):
                if i > k:
                    np.minimum(most, (b - a) // (i - k), out=most)
                elif i < k:
                    np.maximum(least, ceil(a - b, k - i), out=least)
                else:
                    most[a > b] = least[a > b] - 1
        return least, most

    def meets(g):
        least, most = periods(g)
        return bool((least <= most).any())

    gap, most_gap = 0, 0 if meets(0) else int(abs(goal) + above + below + hl * n)
    if not meets(most_gap):
        return None
    while gap < most_gap:
        g = (gap + most_gap) // 2
        gap, most_gap = (gap, g) if meets(g) else (g + 1, most_gap)
    least, most = periods(gap)
    near = np.stack([np.clip((wish - r) // period + i, least, most) for i in (0, 1)]) * period + r
    off = np.where(least <= most, np.abs(near - wish), np.iinfo(np.int64).max)
    at = off == off.min()
    c, s = near[at], np.broadcast_to(short, near.shape)[at]
    lower, upper = mediums(c, s, gap)
    first, last = np.maximum.reduce(lower), np.minimum.reduce(upper)

    def ends(c, s, m):
        low, high = ll * c - (ll - ls) * s - (ll - lm) * m, hl * c - (hl - hs) * s - (hl - hm) * m
        return np.maximum(low, high - below), np.minimum(high, low + above)

    # the sum of both ends falls with the medium count, so the best is next to where one of its four linear pieces meets the goal
    low, high = ll * c - (ll - ls) * s, hl * c - (hl - hs) * s
    dl, dh = ll - lm, hl - hm
    roots = ((low + high - 2 * goal) // (dl + dh), (2 * low + above - 2 * goal) // (2 * dl), (2 * high - below - 2 * goal) // (2 * dh), (low + high + above - below - 2 * goal) // (dl + dh))
    m = np.stack([np.clip(x + i, first, last) for x in roots for i in (0, 1)])
    c, s = np.broadcast_to(c, m.shape), np.broadcast_to(s, m.shape)
    down, up = ends(c, s, m)
    middle = np.abs(down + up - 2 * goal)
    at = middle == middle.min()
    c, s, m, down, up = (x[at] for x in (c, s, m, down, up))
    k = np.lexsort((m, s, c))[0]
    attainable = min(max(goal, int(down[k])), int(up[k]))
    return gap / unit, int(off.min()), int(middle.min()) / 2 / unit, int(c[k]), int(s[k]), int(m[k]), int(c[k] - s[k] - m[k]), attainable / unit


def choose_counts(groups: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, short, medium, long, attainable): how many plans of each class show screens, one row a feasible group.

    ``groups`` has keys, n_short, n_medium, n_long, screen_target and group_target (seconds; fractions to a millionth). The chosen
    plans' seconds must leave the others able to fill the group. Best is the least distance of what can be attained from the target,
    then of the count from a wished one, then of the middle of what can be attained; ties go to the least count, short and medium
    count. Rows are stretches of short counts; each finds its best at once, so work grows with a group's plans, not with their pairs.
    """
    n = {c: F.col(f"n_{c}").cast("long") for c in CLASS_BOUNDS}
    whole_numbers = all(groups.schema[c].dataType.typeName() in ("byte", "short", "integer", "long") for c in ("screen_target", "group_target"))
    unit = 1 if whole_numbers else 1_000_000
    total = lambda i: sum((n[c] * b[i] for c, b in CLASS_BOUNDS.items()), F.lit(0))
    goal, whole = (F.round(F.col(c) * unit).cast("long") for c in ("screen_target", "group_target"))
    x = groups.select(*keys, *(n[c].alias(f"n_{c}") for c in CLASS_BOUNDS), (n["short"] + n["medium"] + n["long"]).alias("n"), goal.alias("goal"), (whole - total(0) * unit).alias("above"), (total(1) * unit - whole).alias("below"))
    x = x.where("above >= 0 and below >= 0 and goal is not null")
    x = x.withColumn("wish", F.greatest(F.lit(1), F.bround(F.col("n") / 11).cast("long"), F.ceil(F.col("goal") / (60 * unit))))
    x = x.withColumn("start", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_short"), F.lit(STRETCH).cast("long"))))
    # groups are few: their stretches are dealt out
    x = x.repartition(int(groups.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys, "start")
    columns = ("start", "n_short", "n_medium", "n_long", "n", "goal", "above", "below", "wish")

    @F.pandas_udf(BEST)
    def best(*series: pd.Series) -> pd.DataFrame:
        out = []
        for start, n_short, *rest in zip(*(c.tolist() for c in series)):
            out.append(_best_counts(np.arange(start, min(start + STRETCH, n_short + 1)), *rest, unit) or (None,) * 8)
        return pd.DataFrame(out, columns=["gap", "off", "middle", "count", *CLASS_BOUNDS, "attainable"])

    x = x.select(*keys, best(*columns).alias("best"))
    x = x.groupBy(*keys).agg(F.min(F.when(F.col("best.gap").isNotNull(), F.col("best"))).alias("best")).where("best is not null")
    return x.select(*keys, *(f"best.{c}" for c in CLASS_BOUNDS), "best.attainable")


def screen_plans(plans: DataFrame, targets: DataFrame, keys: list[str], plan: str = "plan_id", cls: str = "duration_class") -> DataFrame:
    """``plans`` with ``screen``: true for those of each group and class that come first by hash of their id.

    ``targets`` has keys, screen_target and group_target. Plans of a group without feasible counts get null.
    """
    have = plans.groupBy(*keys).agg(*(F.count_if(F.col(cls) == c).alias(f"n_{c}") for c in CLASS_BOUNDS))
    chosen = choose_counts(have.join(targets, keys), keys)
    x = numbered(plans.withColumn("__h", F.sha2(F.col(plan).cast("string"), 256)), [*keys, cls], ["__h", plan], "__at")
    take = F.element_at(F.create_map(*(v for c in CLASS_BOUNDS for v in (F.lit(c), F.col(c)))), F.col(cls))
    return x.join(chosen, keys, "left").withColumn("screen", F.col("__at") < take).drop("__h", "__at", *CLASS_BOUNDS, "attainable")


def trim_splits(cells: DataFrame, splits: list[str]) -> DataFrame:
    """(category, language, split, cut): ticks to trim from each cell so that splits come down to their targets.

    ``cells`` has category, language, split, ticks, target and capacity, one row a cell; only this
    small table enters Python. Splits are taken in order. Each tick goes to the cell of the split
    where the summed squared relative error of cell, category and language falls most (what is
    trimmed from earlier splits counts), ties to the lesser names. A split without enough capacity
    is trimmed as far as it goes. Time grows with the ticks trimmed, one step over the split's cells each.
    """

    def solve(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["category", "language", "split"]).reset_index(drop=True)
        now, want, room = (g[c].to_numpy(float) for c in ("ticks", "target", "capacity"))
        cut = np.zeros(len(g), np.int64)
        sides = [np.arange(len(g)), *(g[c].factorize()[0] for c in ("category", "language"))]
        have, goal = [np.bincount(s, now) for s in sides], [np.bincount(s, want) for s in sides]
        for split in splits:
            at = np.flatnonzero(g["split"] == split)
            for _ in range(max(0, int(now[at].sum() - want[at].sum()))):
                free = at[cut[at] < room[at]]
                if not len(free):
                    break
                # (h - 1 - w)^2 - (h - w)^2 = 1 - 2 (h - w)
                gain = sum((1 - 2 * (h[s[free]] - w[s[free]])) / np.maximum(w[s[free]], 1.0) ** 2 for s, h, w in zip(sides, have, goal))
                k = free[np.argmin(gain)]
                cut[k] += 1
                for s, h in zip(sides, have):
                    h[s[k]] -= 1
        return g[["category", "language", "split"]].assign(cut=cut)

    x = cells.select("category", "language", "split", "ticks", "target", "capacity", F.lit(0).alias("all"))
    return x.groupBy("all").applyInPandas(solve, "category string, language string, split string, cut long")

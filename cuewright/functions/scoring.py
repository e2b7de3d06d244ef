"""Transcript error rates, rewards and log-probability terms as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def cer(target: Column, heard: Column) -> Column:
    """Character error rate over letters, digits and CJK: distance over the target's length, at most 1."""
    clean = lambda c: F.regexp_replace(c, "[^一-鿿A-Za-z0-9]", "")
    a, b = clean(target), clean(heard)
    return F.least(F.lit(1.0), F.levenshtein(a, b) / F.greatest(F.length(a), F.lit(1)))


def wer(target: Column, heard: Column) -> Column:
    """Word error rate: a pair's words become characters above the base plane, so levenshtein counts words.

    Null for a pair of more than 983,040 different words, which have no characters left.
    """
    words = lambda c: F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9']+"), F.lit(0))
    # bound once: what stands in an inner lambda is evaluated for every word
    pair = F.struct(words(target).alias("a"), words(heard).alias("b"))
    with_all = F.transform(F.array(pair), lambda p: F.struct(p["a"].alias("a"), p["b"].alias("b"), F.array_distinct(F.concat(p["a"], p["b"])).alias("all")))

    def rate(p):
        code = lambda w: F.decode(F.unhex(F.lpad(F.hex((F.array_position(p["all"], w) + 0x1FFFF).cast("long")), 8, "0")), "UTF-32")
        as_text = lambda x: F.array_join(F.transform(x, code), "")
        r = F.least(F.lit(1.0), F.levenshtein(as_text(p["a"]), as_text(p["b"])) / F.greatest(F.size(p["a"]), F.lit(1)))
        return F.when(F.size(p["all"]) <= 983_040, r)

    return F.get(F.transform(with_all, rate), F.lit(0))


def interaction(speech: Column, latency: Column, efficiency: Column) -> Column:
    return 0.4 * speech + 0.3 * latency + 0.3 * efficiency


def reward_total(task: Column, speech: Column, latency: Column, efficiency: Column, safety: Column) -> Column:
    return task + 0.2 * interaction(speech, latency, efficiency) + safety


def clipped_objective(current: Column, old: Column, advantage: Column, clip: float = 0.2) -> Column:
    r = F.exp(F.greatest(F.lit(-30.0), F.least(F.lit(30.0), current - old)))
    return F.least(r * advantage, F.greatest(F.lit(1 - clip), F.least(F.lit(1 + clip), r)) * advantage)


def sampled_kl(current: Column, reference: Column) -> Column:
    d = F.greatest(F.lit(-30.0), F.least(F.lit(30.0), reference - current))
    return F.expm1(d) - d

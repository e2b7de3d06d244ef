"""Row checks: missing fields, quarantine, strictness, identity and range predicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def missing_fields(df: DataFrame, required: list[str]) -> Column:
    """array<string> of required fields that are null or, for strings, blank."""
    kinds = dict(df.dtypes)
    blank = lambda c: F.col(c).isNull() | (F.trim(F.col(c)) == "") if kinds[c] == "string" else F.col(c).isNull()
    return F.array_compact(F.array(*(F.when(blank(c), F.lit(c)) for c in required)))


def failed(**rules: Column) -> Column:
    """Names of the rules that do not hold, in order; an unknown outcome fails."""
    return F.array_compact(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(n)) for n, ok in rules.items())))


def quarantine(df: DataFrame, reasons: Column, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """(good, rejects with ``reasons``). ``strict`` raises if there is any reject."""
    marked = df.withColumn("reasons", reasons)
    bad = marked.where(F.size("reasons") > 0)
    if strict and (n := bad.limit(3).collect()):
        raise ValueError(f"rejected rows: {[r.reasons for r in n]}")
    return marked.where(F.size("reasons") == 0).drop("reasons"), bad


def identity_mismatch(df: DataFrame, expected: dict[str, object]) -> Column:
    """Names of identity columns that differ from their expected values, null-safe."""
    return F.array_compact(F.array(*(F.when(~F.col(c).eqNullSafe(F.lit(v)), F.lit(c)) for c, v in expected.items())))


def licensed(df: DataFrame) -> Column:
    """A licence is named and redistribution allowed, unless the source is synthetic."""
    return (F.col("source") == "synthetic") | (F.col("redistribution_allowed") & (F.trim("source_license") != ""))


def cursor_start(shard: Column, sample: Column, unit: Column, at: tuple[int, int, int]) -> Column:
    """True for units at or after a resume position (shard, sample, unit)."""
    s, a, u = at
    return (F.struct(shard, sample) > F.struct(F.lit(s), F.lit(a))) | ((shard == s) & (sample == a) & (unit >= u))


def reroot(path: Column, prefixes: dict[str, str]) -> Column:
    """The longest prefix at a slash boundary is replaced; else the first one found inside is."""
    out = path
    ordered = sorted(prefixes.items(), key=lambda p: (len(p[0]), p[0]))
    for old, new in ordered:
        inside = path.contains(old + "/")
        out = F.when(inside & ~_starts_any(path, prefixes), F.replace(path, F.lit(old + "/"), F.lit(new + "/"))).otherwise(out)
    for old, new in ordered:
        out = F.when((path == old) | path.startswith(old + "/"), F.concat(F.lit(new), F.substr(path, F.lit(len(old) + 1)))).otherwise(out)
    return out


def _starts_any(path: Column, prefixes: dict[str, str]) -> Column:
    hit = F.lit(False)
    for old in prefixes:
        hit = hit | (path == old) | path.startswith(old + "/")
    return hit


def unsafe_member(path: Column) -> Column:
    """An archive member that would leave its folder: absolute, or with a step up too many."""
    steps = F.filter(F.split(path, "/"), lambda s: (s != "") & (s != "."))
    low = F.aggregate(steps, F.struct(F.lit(0).alias("at"), F.lit(0).alias("low")), lambda a, s: F.struct((a["at"] + F.when(s == "..", -1).otherwise(1)).alias("at"), F.least(a["low"], a["at"] + F.when(s == "..", -1).otherwise(1)).alias("low")))
    return path.startswith("/") | (low["low"] < 0)


def filled(c: Column) -> Column:
    """True for a string that is not null and not blank."""
    return F.coalesce(F.trim(c) != "", F.lit(False))


def trajectory_faults(version: Column, known: str, *names: Column, labels: tuple[str, ...] = ("scale", "kind", "task")) -> Column:
    """Faults of a trajectory's identity: another version, or one of its names missing."""
    return failed(version=version == known, **{n: filled(c) for n, c in zip(labels, names)})


def masked_range(values: Column, mask: Column, below: int) -> Column:
    """True if every value whose mask is set lies in [0, below); unset ones may be anything. Lengths must agree."""
    pairs = F.arrays_zip(values.alias("v"), mask.alias("m"))
    inside = F.forall(pairs, lambda p: ~p["m"] | p["v"].between(0, below - 1))
    return (F.size(values) == F.size(mask)) & F.coalesce(inside, F.lit(False))


def unit_faults(mode: Column, codes: Column, code_mask: Column, tokens: Column, token_mask: Column, delta: Column, codebook: int = 2048, vocabulary: int = 940) -> Column:
    """Faults of a unit: mode, codes and tokens in range where masked, a positive step in time."""
    return failed(mode=mode.isin(0, 1), codes=masked_range(codes, code_mask, codebook), tokens=masked_range(tokens, token_mask, vocabulary), delta=delta > 0)


def voice_faults(voice_id: Column, path: Column, actual: Column, recorded: Column) -> Column:
    """Faults of a voice record: an id and a FLAC or WAV prompt are needed; a recorded hash must be the prompt's."""
    suffix = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    return failed(id=filled(voice_id), suffix=suffix.isin("flac", "wav"), hash=recorded.isNull() | (recorded == actual))


def stored_voice_name(voice_id: Column, path: Column, actual: Column) -> Column:
    """``id-hash12.ext`` of a prompt's file."""
    return F.concat(voice_id, F.lit("-"), F.substring(actual, 1, 12), F.lower(F.regexp_extract(path, r"(\.[A-Za-z0-9]+)$", 1)))

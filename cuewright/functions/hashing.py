"""Canonical hashes and split rules as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ascii_json(c: Column) -> Column:
    """Escape the delete character and all above ASCII as JSON's lower-case unicode escapes (pairs above the plane)."""
    parts = F.split(c, "")

    def one(ch):
        units = F.lower(F.hex(F.encode(ch, "UTF-16BE")))
        said = F.concat(F.lit("\\u"), F.substring(units, 1, 4), F.when(F.length(units) > 4, F.concat(F.lit("\\u"), F.substring(units, 5, 4))).otherwise(""))
        return F.when((F.octet_length(ch) > 1) | (ch == "\x7f"), said).otherwise(ch)

    return F.when(c.rlike(r"[^\x00-\x7e]"), F.array_join(F.transform(parts, one), "")).otherwise(c)


def canonical_json(**fields: Column) -> Column:
    """Compact JSON with sorted keys, ASCII only, nulls kept. Use strings, longs and booleans."""
    s = F.struct(*(fields[k].alias(k) for k in sorted(fields)))
    return json_text(s)


def json_text(s: Column) -> Column:
    """A struct as compact ASCII JSON; Spark's upper-case control escapes become lower-case ones."""
    text = F.to_json(s, {"ignoreNullFields": "false"})
    low = text
    for code in (0x0B, 0x0E, 0x0F, *range(0x1A, 0x20)):
        # an even run of backslashes before it: a real escape, not the text of one
        low = F.regexp_replace(low, rf"(?<=(?<!\\)(?:\\\\){{0,99}})\\u{code:04X}", rf"\\u{code:04x}")
    return ascii_json(F.when(text.contains("\\u0"), low).otherwise(text))


def stable_hash(**fields: Column) -> Column:
    return F.sha2(canonical_json(**fields), 256)


def hash_bucket(group: Column, seed: int = 17, buckets: int = 10) -> Column:
    """First eight hex digits of the canonical hash of group and seed, modulo ``buckets``."""
    h = stable_hash(group=group.cast("string"), seed=F.lit(seed))
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("long") % buckets


def hash_split(group: Column, seed: int = 17) -> Column:
    b = hash_bucket(group, seed)
    return F.when(b < 8, "train").when(b == 8, "validation").otherwise("test")


def positional_split(index: Column, count: Column) -> Column:
    """80/10/10 by position; integer division."""
    return F.when(index < F.floor(count * 8 / 10), "train").when(index < F.floor(count * 9 / 10), "validation").otherwise("test")


def valid_sha256(c: Column) -> Column:
    """Lower-cased digest, null where it isn't 64 hex digits."""
    return F.when(c.rlike("^[0-9A-Fa-f]{64}$"), F.lower(c))

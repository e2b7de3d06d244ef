"""Secrets: fixed patterns, and windows of high Shannon entropy in strings of one character class.

A candidate is a maximal run of key characters. In each class its characters are read in windows of fixed length; a window's
entropy is log2(length) minus the mean of c * log2(c) over its counts c, and both counts and sum
are changed by the letter that comes and the one that goes. The sum is kept in whole numbers, so the order of
steps changes nothing. Windows that reach their class's entropy and mix of letters and digits are joined to
spans. Words, paths, versions, placeholders and what the caller allows are suppressed.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections.abc import Iterable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex")
ADDED = "entropy"

# fixed values: the base patterns
ASSIGN = re.compile(
    r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
KEYWORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")

WINDOW = 20
#: Characters from which on a text is searched without a look at its words' lengths, with the same result.
WHOLE = 1 << 20
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_.=-])[A-Za-z0-9+/_.=-]{20,}")


@dataclass(frozen=True)
class CharClass:
    """Letters of a class, the least entropy of a window in bits, and the least numbers of its digits, capitals and small letters."""

    name: str
    letters: str
    bits: float
    digits: int
    capitals: int = 0
    small: int = 0


_UP, _LOW, _NUM = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
#: Random windows of these classes have about 3.4, 3.9, 3.9 and 4.1 bits.
CLASSES = (
    CharClass("hex", _NUM + "abcdefABCDEF", 3.0, 3),
    CharClass("base36", _NUM + _LOW, 3.5, 4, small=4),
    CharClass("BASE36", _NUM + _UP, 3.5, 4, capitals=4),
    CharClass("base64", _NUM + _UP + _LOW + "+/_-", 3.75, 2, 2, 2),
)
#: 0 digits, 1 capitals, 2 small letters, 3 the others of the classes.
KIND = {x: 0 if x in _NUM else 1 if x in _UP else 2 if x in _LOW else 3 for c in CLASSES for x in c.letters}
SCALE = 1 << 30
WEIGHT = [0, *(round(c * math.log2(c) * SCALE) for c in range(1, WINDOW + 1))]


def most_repeated(bits: float) -> int:
    """The largest scaled sum of c * log2(c) at which a window has at least ``bits`` of entropy."""
    return math.floor((math.log2(WINDOW) - bits) * WINDOW * SCALE)


def high_windows(s: str, c: CharClass) -> list[tuple[int, int]]:
    """Union of the windows of ``s``, all of its letters in the class, that count as random: (start, end)s."""
    counts, total, out, most = dict.fromkeys(s, 0), 0, [], most_repeated(c.bits)
    kinds = [0, 0, 0, 0]
    for i, x in enumerate(s):
        n = counts[x]
        total += WEIGHT[n + 1] - WEIGHT[n]
        counts[x] = n + 1
        kinds[KIND[x]] += 1
        if i + 1 < WINDOW:
            continue
        j = i + 1 - WINDOW
        if total <= most and kinds[0] >= c.digits and kinds[1] >= c.capitals and kinds[2] >= c.small and kinds[1] + kinds[2] > 2:
            if out and j <= out[-1][1]:
                out[-1] = (out[-1][0], i + 1)
            else:
                out.append((j, i + 1))
        x = s[j]
        n = counts[x]
        total += WEIGHT[n - 1] - WEIGHT[n]
        counts[x] = n - 1
        kinds[KIND[x]] -= 1
    return out


_RUNS = {c.name: re.compile(f"[{re.escape(c.letters)}]{{{WINDOW},}}") for c in CLASSES}
#: What is no secret however mixed its letters: placeholders, paths and names whose parts are all words or numbers, ids of fixed shape.
PLAIN = (
    re.compile(r"(?i)example|placeholder|changeme|dummy|your[_-]?(?:[a-z]{1,12}[_-]){0,3}(?:key|token|secret|password)|x{6}|123456789|abcdefgh"),
    re.compile(r"(?:[A-Z]?[a-z]+|[A-Z]+|[0-9]+)(?:[/_.=+-]+(?:[A-Z]?[a-z]+|[A-Z]+|[0-9]+))*[/_.=+-]*\Z"),
    re.compile(r"[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}\Z"),
)


def harmless(candidate: str, allow: frozenset[str]) -> bool:
    """Whether the caller or a rule names the candidate harmless."""
    return candidate in allow or bool(PLAIN[0].search(candidate)) or any(p.match(candidate) for p in PLAIN[1:])


def union(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def entropy_spans(text: str, start: int, end: int, allow: frozenset[str]) -> list[tuple[int, int]]:
    """Spans of the candidate text[start : end] whose windows are random in some class, joined where they touch."""
    cand, found = text[start:end], []
    for c in CLASSES:
        for run in _RUNS[c.name].finditer(cand):
            found += [(run.start() + a, run.start() + b) for a, b in high_windows(run[0], c)]
    if not found or harmless(cand, allow):
        return []
    return [(start + a, start + b) for a, b in union(found) if cand[a:b] not in allow]


def _assigned(text: str) -> list[tuple[int, int]]:
    low = text.lower()
    if len(low) != len(text):  # a letter whose small form is longer: places differ, so search all
        at = [m.start() for m in re.finditer(r"(?i)password|passwd|secret|token|api_?key", text)]
    else:
        at = []
        for k in KEYWORDS:
            i = low.find(k)
            while i >= 0:
                at.append(i)
                i = low.find(k, i + 1)
        at.sort()
    out, last = [], 0
    for i in at:
        m = ASSIGN.match(text, i) if i >= last else None
        if m:
            last = m.end()
            if len(m[2]) >= 6:
                out.append((i, last))
    return out


def secret_spans(text: str | None, allow: frozenset[str] = frozenset()) -> list[tuple[int, str, int]]:
    """(start, kind, end) by start, then kind as listed, the added kind last."""
    text = text or ""
    out = [(a, 0, b) for a, b in _assigned(text)]
    # every other span lies in a long candidate, and that in a long word; a huge text isn't split for that
    if len(text) > WHOLE or max(map(len, text.split()), default=0) >= WINDOW:
        more = []
        for m in CANDIDATE.finditer(text):
            out += [(h.start(), 1, h.end()) for h in ACCESS.finditer(text, m.start(), m.end())]
            out += [(h.start(), 2, h.end()) for h in HEX.finditer(text, m.start(), m.end())]
            more += entropy_spans(text, m.start(), m.end(), allow)
        base = union((a, b) for a, _, b in out) if more else []
        for a, b in more:
            i = bisect_left(base, (b,))  # of the base spans before b the last one ends last
            if i == 0 or base[i - 1][1] <= a:
                out.append((a, 3, b))
    return [(a, (*KINDS, ADDED)[k], b) for a, k, b in sorted(out)]


SPANS = "array<struct<kind: string, start: int, end: int>>"


def find_secrets(docs: DataFrame, text_col: str = "text", out: str = "spans", allow: Iterable[str] = ()) -> DataFrame:
    """``docs`` with ``out``: kind, start and end (code points, end exclusive) of the secrets of each whole text.

    The fixed patterns' spans always stay; an entropy span is added where it touches none of them and isn't
    suppressed. ``allow`` lists further harmless strings, a small set. Null and empty texts have no spans; repeated
    rows and empty tables are fine; an input column named ``out`` is replaced. One row at a time, so memory
    is bounded by the longest text; time is linear in it.
    """
    names = frozenset(allow)

    @F.pandas_udf(SPANS)
    def run(t: pd.Series) -> pd.Series:
        return pd.Series([[{"kind": k, "start": a, "end": b} for a, k, b in secret_spans(x, names)] for x in t], dtype=object)

    return docs.withColumn(out, run(F.col(text_col).cast("string")))


def redact(docs: DataFrame, text_col: str = "text", allow: Iterable[str] = ()) -> DataFrame:
    """``docs`` with every secret in the text replaced by its kind in brackets; overlapping spans as one, named by the first."""
    names = frozenset(allow)

    def clean(text: str | None) -> str | None:
        parts, last, end = [], 0, -1
        for a, kind, b in secret_spans(text, names):
            if a >= end:
                parts += [text[last:a], f"[{kind.upper()}]"]
            end = max(end, b)
            last = end
        return text if not parts else "".join(parts) + text[last:]

    @F.pandas_udf("string")
    def run(t: pd.Series) -> pd.Series:
        return pd.Series([clean(x) for x in t], dtype=object)

    return docs.withColumn(text_col, run(F.col(text_col).cast("string")))


def digest(docs: DataFrame, allow: Iterable[str] = ()) -> DataFrame:
    """The contract's columns from ``find_secrets``, and n_added."""
    x = find_secrets(docs.select("doc_id", "text"), allow=allow)
    say = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["kind"] != ADDED)
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    return x.select("doc_id", *(count(k).alias(f"n_{k}") for k in KINDS), F.sha2(say(base), 256).alias("base_sha256"), say(F.col("spans")).alias("spans"), count(ADDED).alias("n_added"))


def _oracle() -> str:
    """DuckDB SQL for ``digest``: places from the pieces between matches, every window counted afresh."""

    def found(source: str, keys: str, text: str, pattern: str, group: str = "0") -> str:
        q = pattern.replace("'", "''")
        return f"""(SELECT {keys}, m[i + 1] AS hit, g[i + 1] AS part, coalesce(list_sum(list_transform(s[1:i + 1], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(m[1:i], lambda x: length(x))), 0) AS place
FROM (SELECT *, unnest(range(len(m))) AS i FROM (SELECT {keys}, regexp_extract_all({text}, '{q}') AS m, regexp_extract_all({text}, '{q}', {group}) AS g, string_split_regex({text}, '{q}') AS s FROM {source})))"""

    assign = ASSIGN.pattern.replace("([Pp]", "(?:[Pp]", 1)
    kinds = " UNION ALL ".join(
        f"SELECT doc_id, {k} AS kind, place::BIGINT AS a, (place + length(hit))::BIGINT AS b FROM {found('d', 'doc_id', 'text', p, g)} WHERE {ok}"
        for k, (p, g, ok) in enumerate(((assign, "1", "length(part) >= 6"), (ACCESS.pattern, "0", "true"), (HEX.pattern, "0", "true")))
    )
    only = lambda c: f"length(regexp_replace(w, '[^{c}]', '', 'g'))"
    high = " UNION ALL ".join(
        f"""SELECT doc_id, c, a, r + j AS x FROM (SELECT *, substr(run, j + 1, {WINDOW}) AS w FROM (SELECT doc_id, c, a, place::BIGINT AS r, hit AS run, unnest(range(length(hit) - {WINDOW - 1})) AS j FROM {found('cand', 'doc_id, c, a', 'c', f'[{re.escape(k.letters)}]{{{WINDOW},}}')}))
WHERE list_sum(list_transform(map_values(list_aggregate(string_split(w, ''), 'histogram')), lambda n: {WEIGHT}[n::BIGINT + 1])) <= {most_repeated(k.bits)} AND {only('0-9')} >= {k.digits} AND {only('A-Z')} >= {k.capitals} AND {only('a-z')} >= {k.small} AND {only('A-Za-z')} > 2"""
        for k in CLASSES
    )
    harmless_sql = " OR ".join(f"regexp_matches(c, '{p}')" for p in (PLAIN[0].pattern, *(f"^(?:{p.pattern.removesuffix(chr(92) + 'Z')})$" for p in PLAIN[1:])))
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), base AS MATERIALIZED ({kinds}),
cand AS (SELECT doc_id, hit AS c, place::BIGINT AS a FROM {found('d', 'doc_id', 'text', '[A-Za-z0-9+/_.=-]{20,}')}),
high AS (SELECT DISTINCT doc_id, c, a, x FROM ({high}) WHERE NOT ({harmless_sql})),
edge AS (SELECT *, x > lag(x) OVER (PARTITION BY doc_id, a ORDER BY x) + {WINDOW} IS NOT FALSE AS fresh FROM high),
isle AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY doc_id, a ORDER BY x) AS isle FROM edge),
added AS (SELECT doc_id, 3 AS kind, (a + min(x))::BIGINT AS a, (a + max(x) + {WINDOW})::BIGINT AS b FROM isle GROUP BY doc_id, isle.a, isle),
every AS (SELECT * FROM base UNION ALL SELECT * FROM added e WHERE NOT EXISTS (SELECT 1 FROM base s WHERE s.doc_id = e.doc_id AND s.a < e.b AND e.a < s.b)),
told AS (SELECT *, ['assign', 'access', 'hex', 'entropy'][kind + 1] || ':' || a || ':' || b AS said FROM every)
SELECT d.doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex, sha256(coalesce(string_agg(said, ',' ORDER BY a, kind) FILTER (kind < 3), '')) AS base_sha256,
coalesce(string_agg(said, ',' ORDER BY a, kind), '') AS spans, count(*) FILTER (kind = 3) AS n_added FROM d LEFT JOIN told USING (doc_id) GROUP BY d.doc_id"""


ORACLE_SQL = _oracle()

"""Substring dedup: paragraph MinHash banding, exact Jaccard checks, removals by component.

Paragraphs are of two sorts. Lines of MIN_WORDS or more words are banded by MinHash over their
five-word shingles; lines that share a band are compared by exact Jaccard and linked at 0.8. To
find passages that stand in the middle of longer lines, texts are also cut into small pieces at
words whose hash is the least within REACH words on both sides: the cut depends on nothing
further away, so a shared passage is cut alike wherever it stands; pieces are matched as they are.
Classes are exact groups joined by the components of line links. The first document of a class
keeps its paragraph, the others lose it. Neighbouring repeated pieces and lines of a document grow
together to passages; passages under MIN_WORDS words are left alone.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, fresh, partitions, slices
from .components import connected_components

WORD = re.compile(r"\w+")
NEWLINE = re.compile("\n")
SHINGLE = 5
JACCARD = 0.8
MIN_WORDS = 15
REACH = 4
#: 1 - (1 - 0.8**2)**6: a pair of lines at the threshold shares a band 99.8 times in 100.
BANDS, ROWS = 6, 2
#: Lines of a bucket that one task compares; larger buckets are compared block against block.
BUCKET = 20_000
#: Groups of up to this size are compared pair by pair, without an index.
FEW = 24
SLICE_CHARS = 1_000_000

_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_SEEDS = np.random.default_rng(2024).integers(1, 2**63, BANDS * ROWS).astype(np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _word_hashes(words: list[str]) -> np.ndarray:
    if not words:
        return np.zeros(0, np.uint64)
    coded = pa.array(words).dictionary_encode()
    unique = [xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) for w in coded.dictionary.to_pylist()]
    return np.array(unique, dtype=np.uint64)[coded.indices.to_numpy()]


def _run_hash(h: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit hash of each run of word hashes [start, end): order counts."""
    powers = np.cumprod(np.full(len(h) + 1, _M1, dtype=np.uint64))
    total = np.r_[np.uint64(0), np.cumsum(h * powers[:-1], dtype=np.uint64)]
    # the sum is scaled to a start of zero by the inverse power
    inverse = np.uint64(pow(int(_M1), -1, 1 << 64))
    down = np.cumprod(np.full(len(h) + 1, inverse, dtype=np.uint64))
    return _mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64) * _M2 + np.uint64(seed))


def _shingle_hashes(h: np.ndarray) -> np.ndarray:
    n = len(h) - SHINGLE + 1
    out = np.zeros(max(n, 0), np.uint64)
    for k in range(SHINGLE):
        out = _mix(out * _M2 + h[k : k + n] + np.uint64(k + 1)) if n > 0 else out
    return out


def cuts(h: np.ndarray) -> np.ndarray:
    """Starts of pieces: positions whose hash is below all REACH before and none of REACH after."""
    n = len(h)
    if not n:
        return np.zeros(0, np.int64)
    big = np.full(REACH, np.uint64(2**64 - 1))
    p = np.concatenate([big, h, big])
    low = np.ones(n, bool)
    for k in range(1, REACH + 1):
        low &= (h < p[REACH - k : REACH - k + n]) & (h <= p[REACH + k : REACH + k + n])
    low[0] = True
    return np.flatnonzero(low)


def paragraphs(texts: list[str | None]) -> tuple[np.ndarray, ...]:
    """Lines and pieces of whole texts: (text number, is_line, first word, words, start, end, hash, bands).

    Offsets are code points. ``bands`` has a row for each line, in order. Texts without words give
    nothing. Texts lie side by side, REACH empty places apart, so none sees its neighbours.
    """
    spans, words, count, breaks = [], [], [], []
    seen = 0
    for t in texts:
        t = t or ""
        at = [m.span() for m in WORD.finditer(t)]
        spans += at
        words += [t[a:b].lower() for a, b in at]
        count.append(len(at))
        nl = [m.start() for m in NEWLINE.finditer(t)]
        if at and nl:
            breaks.append(seen + np.searchsorted(np.array(at)[:, 0], nl))
        seen += len(at)
    n = np.array(count, dtype=np.int64)
    first = np.cumsum(n) - n
    span = np.array(spans, dtype=np.int64).reshape(-1, 2)
    h = _word_hashes(words)
    doc = np.repeat(np.arange(len(n)), n)
    spread = np.full(len(h) + len(n) * REACH, np.uint64(2**64 - 1))
    place = np.arange(len(h)) + doc * REACH
    spread[place] = h
    low = np.zeros(len(spread), bool)
    low[cuts(spread)] = True
    own = first[n > 0]
    ends = np.r_[own, len(h)]
    piece = np.union1d(np.flatnonzero(low[place]), own)
    line = np.unique(np.concatenate([own, *breaks])) if len(own) else own
    line = line[line < len(h)]
    piece_end, line_end = np.r_[piece[1:], len(h)][: len(piece)], np.r_[line[1:], len(h)][: len(line)]
    long = line_end - line >= MIN_WORDS
    line, line_end = line[long], line_end[long]
    start, end = np.r_[line, piece], np.r_[line_end, piece_end]
    is_line = np.r_[np.ones(len(line), bool), np.zeros(len(piece), bool)]
    keys = np.r_[_run_hash(h, line, line_end, 1), _run_hash(h, piece, piece_end, 2)]
    bands = np.zeros((len(line), BANDS), np.uint64)
    if len(line):
        s = _shingle_hashes(h)
        edge = np.c_[line, line_end - SHINGLE + 1].ravel()
        for k, seed in enumerate(_SEEDS):
            m = np.r_[_mix(s ^ seed), np.uint64(0)]
            bands[:, k // ROWS] = _mix(bands[:, k // ROWS] * _M1 + np.minimum.reduceat(m, edge)[::2])
        bands = _mix(bands + np.arange(1, BANDS + 1, dtype=np.uint64))
    at = doc[start] if len(start) else start
    return at, is_line, start - first[at], end - start, span[start, 0], span[end - 1, 1], keys.view(np.int64), bands.view(np.int64)


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(1, len(a) + len(b) - both)


UNIT = "doc_id long, is_line boolean, word int, n_words int, start int, end int, h long, bands array<long>"


def units(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    def run(batches):
        for b in batches:
            ids = b["id"].to_numpy()
            for at, part in slices(b["text"].tolist(), SLICE_CHARS):
                doc, line, word, n, start, end, h, bands = paragraphs(part)
                if len(doc):
                    nums = {k: v.astype(np.int32) for k, v in (("word", word), ("n_words", n), ("start", start), ("end", end))}
                    yield pd.DataFrame({"doc_id": ids[at : at + len(part)][doc], "is_line": line} | nums | {"h": h, "bands": [*bands] + [None] * (len(doc) - len(bands))})

    src = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return src.mapInPandas(run, UNIT)


def line_links(u: DataFrame, docs: DataFrame, id_col: str, text_col: str, s: Scratch, used: list[DataFrame] | None = None) -> DataFrame:
    """Edges (a, b) of line hashes that keep the components of the Jaccard >= 0.8 graph.

    Lines that share a band with a different line are read again for their shingles. Buckets are
    cut to blocks of about BUCKET lines and every pair of blocks is compared, so large buckets
    spread. Within a task pairs meet through their rarest shingles, and lines that are joined
    already aren't compared again, so no bucket lists its pairs. Scratch tables that the edges are
    read from are added to ``used``.
    """
    lines = s.keep(u.where("is_line").groupBy("h").agg(F.min(F.struct("doc_id", "start", "end")).alias("at"), F.first("bands").alias("bands")))
    banded = lines.select("h", F.explode("bands").alias("band"))
    full = banded.groupBy("band").agg(F.count("*").alias("n")).where("n > 1")
    hits = s.keep(banded.join(full, "band"))
    wanted = lines.join(hits.select("h").distinct(), "h").select("h", "at.*")
    text = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    # of repeated ids any row may hold the line: hashing the span again keeps the right one
    span = wanted.join(text, "doc_id").select("h", F.substring(F.col("text"), F.col("start") + 1, F.col("end") - F.col("start")).alias("line"))

    def shingle(batches):
        for b in batches:
            keep, out = [], []
            for h, t in zip(b["h"], b["line"]):
                x = _word_hashes([w.lower() for w in WORD.findall(t or "")])
                ok = len(x) and int(_run_hash(x, np.array([0]), np.array([len(x)]), 1).view(np.int64)[0]) == h
                if ok:
                    keep.append(h)
                    out.append(np.unique(_shingle_hashes(x)).view(np.int64))
            yield pd.DataFrame({"h": pd.array(keep, dtype="int64"), "shingles": out})

    sh = s.keep(span.mapInPandas(shingle, "h long, shingles array<long>").dropDuplicates(["h"]))
    if used is not None:
        used += [lines, hits, sh]
    x = hits.join(sh, "h").withColumn("blocks", F.ceil(F.col("n") / BUCKET).cast("int"))
    x = x.withColumn("own", F.pmod(F.xxhash64("h"), F.col("blocks")).cast("int"))
    x = x.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    x = x.select("band", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "h", "shingles")

    keys = ["band", "i", "j"]
    dealt = x.repartition(partitions(u.sparkSession), *keys).sortWithinPartitions(*keys)
    return dealt.mapInPandas(_linked, "a long, b long")


def prefixes(sets: list[np.ndarray]) -> list[np.ndarray]:
    """The rarest shingles of each set, so many that two sets at the threshold share one of them."""
    flat = np.concatenate(sets)
    size = np.array([len(x) for x in sets])
    _, inv, count = np.unique(flat, return_inverse=True, return_counts=True)
    order = np.lexsort((inv, count[inv], np.repeat(np.arange(len(sets)), size)))
    rare = inv[order]
    first = np.cumsum(size) - size
    keep = size - np.ceil(JACCARD * size - 1e-9).astype(np.int64) + 1
    return [rare[a : a + k] for a, k in zip(first, keep)]


def block_links(hs: list[int], own: list[int], sets: list[np.ndarray], one: bool) -> tuple[list[int], list[int]]:
    """Links that join all lines of a block (``one``) or across two blocks as Jaccard at the threshold does.

    A line is compared with those before it that share one of its rarest shingles, component by
    component, and with no more of a component once it is joined to it: alike lines cost one
    comparison each, and no link that would join two components is missed.
    """
    left, right = [], []
    root = list(range(len(hs)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    def alike(x: int, y: int) -> bool:
        n, m = len(sets[x]), len(sets[y])
        return min(n, m) >= JACCARD * max(n, m) and jaccard(sets[x], sets[y]) >= JACCARD

    def join(x: int, y: int):
        left.append(hs[x])
        right.append(hs[y])
        root[find(x)] = find(y)

    if len(hs) <= FEW:
        for x in range(len(hs)):
            for y in range(x):
                if (one or own[x] != own[y]) and find(x) != find(y) and alike(x, y):
                    join(x, y)
        return left, right
    full = [k for k in range(len(hs)) if len(sets[k])]
    keys = dict(zip(full, prefixes([sets[k] for k in full]))) if full else {}
    # per shingle and block, members by component; a component's root is looked up when it is read
    seen: dict[tuple[int, int], dict[int, list[int]]] = {}
    sides = sorted(set(own))
    other = {a: b for a, b in zip(sides, sides[::-1])}
    for x in full:
        tried: set[int] = set()
        for key in keys[x].tolist():
            place = (key, 0 if one else other[own[x]])
            held = seen.get(place)
            if not held:
                continue
            if any(find(r) != r for r in held):
                merged: dict[int, list[int]] = {}
                for r, members in held.items():
                    merged.setdefault(find(r), []).extend(members)
                held = seen[place] = merged
            for r, members in held.items():
                if find(r) == find(x):
                    continue
                for y in members:
                    if y not in tried:
                        tried.add(y)
                        if alike(x, y):
                            join(x, y)
                            break
        for key in keys[x].tolist():
            held = seen.setdefault((key, 0 if one else own[x]), {})
            held.setdefault(find(x), []).append(x)
    return left, right


def _linked(batches):
    """Spanning edges of whole (band, i, j) groups of a sorted partition; one open group is carried on."""
    rest = None
    for b in _and_end(batches):
        last = b is None
        if not last:
            rest = b if rest is None or not len(rest) else pd.concat([rest, b], ignore_index=True)
        if rest is None or not len(rest):
            continue
        k = rest[["band", "i", "j"]].to_numpy()
        cut = np.r_[0, np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1, len(k)]
        done = len(cut) - 1 if last else len(cut) - 2
        hs, own, sets = rest["h"].tolist(), rest["own"].tolist(), [np.asarray(v, dtype=np.int64) for v in rest["shingles"][: cut[done]]]
        left, right = [], []
        for lo, hi in zip(cut[:done].tolist(), cut[1 : done + 1].tolist()):
            one = k[lo, 1] == k[lo, 2]
            if hi - lo == 2 and one:  # most groups are pairs
                x, y = sets[lo], sets[lo + 1]
                if min(len(x), len(y)) >= JACCARD * max(len(x), len(y)) and jaccard(x, y) >= JACCARD:
                    left.append(hs[lo])
                    right.append(hs[lo + 1])
            elif hi - lo >= 2:
                p, q = block_links(hs[lo:hi], own[lo:hi], sets[lo:hi], one)
                left += p
                right += q
        rest = rest.iloc[cut[done] :]
        yield pd.DataFrame({"a": np.array(left, np.int64), "b": np.array(right, np.int64)})


def _and_end(batches):
    yield from batches
    yield None


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, start, end, n_words, first_doc_id, removed), one per repeated passage.

    A passage is a run of at least MIN_WORDS words of a document whose paragraphs all stand in
    another document too; offsets are code points of the whole text, ends exclusive.
    ``first_doc_id`` is the smallest document id that holds part of it, and ``removed`` tells
    whether this document is not the first, so the passage goes. Repeats within one document
    alone are left. Null and empty texts and rows with a null id have no passages; rows that
    repeat an id count as one document. An empty table gives an empty one.
    """
    spark = docs.sparkSession
    s = Scratch(spark, "passages")
    u = s.keep(units(docs, id_col, text_col))
    used: list[DataFrame] = []
    roots = s.keep(connected_components(line_links(u, docs, id_col, text_col, s, used), "a", "b", s))
    s.drop(*used)
    groups = u.groupBy("h").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"))
    linked = groups.join(roots.withColumnsRenamed({"node": "h"}), "h").groupBy("root").agg(F.min("lo").alias("rlo"), F.max("hi").alias("rhi"))
    member = roots.join(linked, "root").select(F.col("node").alias("h"), F.col("rlo").alias("lo"), F.col("rhi").alias("hi"))
    plain = groups.where(F.col("lo") < F.col("hi"))
    classes = plain.unionByName(member.where(F.col("lo") < F.col("hi"))).groupBy("h").agg(F.min("lo").alias("lo"))
    hit = u.select("doc_id", "word", "n_words", "start", "end", "h").join(s.keep(classes), "h")
    hit = hit.select("doc_id", (F.col("doc_id") != F.col("lo")).alias("removed"), "lo", "word", "n_words", "start", "end")
    w = W.partitionBy("doc_id", "removed").orderBy("word", F.desc("n_words"))
    before = F.max(F.col("word") + F.col("n_words")).over(w.rowsBetween(W.unboundedPreceding, -1))
    hit = hit.withColumn("new", F.when(F.col("word") <= before, 0).otherwise(1))
    hit = hit.withColumn("run", F.sum("new").over(w.rowsBetween(W.unboundedPreceding, W.currentRow)))
    runs = hit.groupBy("doc_id", "removed", "run").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), (F.max(F.col("word") + F.col("n_words")) - F.min("word")).alias("n_words"), F.min("lo").alias("first_doc_id")
    )
    return runs.where(F.col("n_words") >= MIN_WORDS).select(F.col("doc_id").alias(id_col), "start", "end", "n_words", "first_doc_id", "removed")


def remove_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the passages that an earlier document holds, all columns kept; null texts stay null."""
    gone = repeated_passages(docs, id_col, text_col).where("removed").groupBy(id_col).agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("gone"))
    key, cuts_ = fresh("__id", docs.columns), fresh("__gone", docs.columns)
    gone = gone.select(F.col(id_col).alias(key), F.col("gone").alias(cuts_))
    x = docs.join(gone, F.col(id_col) == F.col(key), "left")
    t = F.col(text_col)
    cut = F.aggregate(
        cuts_,
        F.struct(F.lit("").alias("out"), F.lit(0).alias("at")),
        lambda s, g: F.struct(F.concat(s["out"], F.substring(t, s["at"] + 1, g["start"] - s["at"])).alias("out"), g["end"].alias("at")),
        lambda s: F.concat(s["out"], F.substring(t, s["at"] + 1, F.length(t))),
    )
    return x.withColumn(text_col, F.when(F.col(cuts_).isNull(), t).otherwise(cut)).select(*docs.columns)

"""Toxicity scores from class-conditional Kneser-Ney models that share their backoff counts.

A word is a path of units: its prefixes of three to eight letters, the word, then the word after
its predecessor. For each class k a unit's probability below its parent is
(max(c_k(u) - D, 0) + D T_k(parent) P(u | parent)) / c_k(parent), where T_k counts the parent's
distinct children in the class and P is the class-free share: from the first prefix to the
word by continuation counts (distinct predecessors of the words below a unit), at the highest order, the word
after its predecessor, by pooled counts. Rare expressions lean on what both classes share, and units new to a parent say
nothing.

A toxic text is ordinary but for some expressions at places not known. So its likelihood against
the ordinary one is normalised by length as the mean over its words of the ratio of the two
models, and the score is the logarithm of that mean under a calibration of two numbers. The mean
of logarithms instead dilutes a few strong words in a long text until nothing is left of them, and the
best passage's mean lets one rare word decide (README).

Counts and ratios are Spark tables by the full 64-bit unit and grow with the input. To score,
texts are read in windows, which are written once (``score_all``, where learning rows and texts are one
table, makes no such tables): a window asks the ratio table for each of its different
units, and the answers meet the window's words, kept as places in its word list. Only class totals and
calibration rows reach the driver.
"""

from __future__ import annotations

import pickle
import tempfile
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, bounded_sample, slices

DISCOUNT = 0.9
PREFIXES = (3, 4, 5, 6, 8)
LEVELS = len(PREFIXES) + 2
PAIR = LEVELS - 1
#: Most labelled rows that fit the last, calibration over a few numbers a row.
CALIBRATE_ROWS = 20_000
#: Characters whose units are summed at once, and that a window of texts to score holds; a longer text stands alone.
COUNT_CHARS, WINDOW_CHARS = 1_000_000, 4_000_000

_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M2
    return x ^ (x >> np.uint64(27))


def _hash_words(words: list[str]) -> np.ndarray:
    """Per word and level 64-bit keys of its prefixes and itself, shape (n, len(PREFIXES) + 1)."""
    n = len(words)
    width = max(PREFIXES)
    flat = "".join(w[:width].ljust(width, "\0") for w in words)
    x = np.frombuffer(flat.encode("utf-32-le", "surrogatepass"), dtype="<u4").reshape(n, width).astype(np.uint64)
    out, h = np.empty((n, len(PREFIXES) + 1), dtype=np.uint64), np.full(n, 17, dtype=np.uint64)
    for i in range(width):
        h = _mix(h * _M1 + x[:, i] + np.uint64(1))
        if i + 1 in PREFIXES:
            out[:, PREFIXES.index(i + 1)] = h + np.uint64(i + 1)
    tail = np.fromiter((xxhash.xxh3_64_intdigest(w[width:].encode("utf-8", "surrogatepass")) for w in words), dtype=np.uint64, count=n)
    out[:, -1] = _mix(h * _M1 ^ tail) + np.uint64(99)
    return out


def words_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """(text number, place in the list, list of different words) of all words of whole texts.

    Words are lower-cased runs of letters, digits and underscores.
    """
    arr = pc.utf8_lower(pa.array([t or "" for t in texts], pa.string()))
    parts = pc.split_pattern_regex(arr, r"[^\pL\pM\pN_]+")
    d = pc.list_parent_indices(parts).to_numpy()
    flat = pc.list_flatten(parts)
    keep = pc.not_equal(pc.binary_length(flat), 0)
    flat, d = flat.filter(keep), d[keep.to_numpy(zero_copy_only=False)]
    if not len(flat):
        return d, np.zeros(0, np.int64), []
    coded = flat.dictionary_encode()
    return d, coded.indices.to_numpy(), coded.dictionary.to_pylist()


def pair_units(d: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The units of words after their predecessors. A first word has none: its unit is the word after nothing."""
    before = np.r_[np.uint64(5), word[:-1]]
    before[np.r_[True, d[1:] != d[:-1]]] = np.uint64(5)
    return _mix(before * _M1 + word) + np.uint64(7)


def units(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, units, parents) of all words of whole texts; 64-bit keys by word and level."""
    d, code, listed = words_of(texts)
    if not listed:
        return d, np.zeros((0, LEVELS), np.int64), np.zeros((0, LEVELS), np.int64)
    keys = _hash_words(listed)[code]
    slot = np.concatenate([keys, pair_units(d, keys[:, -1])[:, None]], axis=1).view(np.int64)
    parent = np.empty_like(slot)
    parent[:, 0] = -1
    parent[:, 1:] = slot[:, :-1]
    return d, slot, parent


@dataclass
class Ratios:
    """Table (unit, ratio): the log-likelihood ratio of every counted unit that has one."""

    table: DataFrame

    def __getitem__(self, unit) -> float:
        row = self.table.where(F.col("unit") == int(unit)).first()
        return row.ratio if row else 0.0


@dataclass
class Model:
    """Ratios of units, the class word counts, and the calibration: factor and constant."""

    ratio: Ratios
    words: np.ndarray
    coef: np.ndarray

    def calibrated(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x * self.coef[0] + self.coef[1], -40, 40)))


def windows(batches, chars: int):
    """(window, ids, texts): runs of whole texts of a task of about ``chars`` characters, numbered over all tasks."""
    no = TaskContext.get().partitionId() << 32
    ids, texts, size = [], [], 0
    for b in batches:
        for i, t in zip(b["id"].tolist(), b["text"]):
            ids.append(i)
            texts.append(t)
            size += len(t or "")
            if size >= chars:
                yield no, ids, texts
                no, ids, texts, size = no + 1, [], [], 0
    if ids:
        yield no, ids, texts


def log_mean_ratio(r: np.ndarray, d: np.ndarray, n: int) -> np.ndarray:
    """Per text the logarithm of its words' mean likelihood ratio; 0 without words."""
    size = np.bincount(d, minlength=n)
    return np.where(size > 0, np.log(np.maximum(np.bincount(d, weights=np.exp(r), minlength=n), 1e-300) / np.maximum(size, 1)), 0.0)


def _codes(n: int, bodies: list) -> tuple[np.ndarray, np.ndarray]:
    """(text number, place in the window's word list) of all words of a window."""
    u = zstandard.ZstdDecompressor()
    seq = [np.frombuffer(u.decompress(z), np.uint16 if n <= 1 << 16 else np.uint32) for z in bodies]
    return np.repeat(np.arange(len(seq)), [len(x) for x in seq]), np.concatenate(seq).astype(np.int64) if seq else np.zeros(0, np.int64)


def _keys(n: int, names: bytes) -> np.ndarray:
    return _hash_words(zstandard.ZstdDecompressor().decompress(names).decode("utf-8", "surrogatepass").split("\n")) if n else np.zeros((0, PAIR), np.uint64)


def read_windows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(window, n, names, ids, bodies): a row a window of texts, with its n different words and each text as places among them."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        z = zstandard.ZstdCompressor(level=3)
        for no, ids, texts in windows(batches, WINDOW_CHARS):
            d, code, listed = words_of(texts)
            wide = np.uint16 if len(listed) <= 1 << 16 else np.uint32
            cut = np.searchsorted(d, np.arange(len(texts) + 1))
            body = [z.compress(code[a:e].astype(wide).tobytes()) for a, e in zip(cut, cut[1:])]
            names = z.compress("\n".join(listed).encode("utf-8", "surrogatepass"))
            yield pd.DataFrame({"window": [no], "n": [len(listed)], "names": [names], "ids": [ids], "bodies": [body]})

    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return src.mapInPandas(run, f"window long, n int, names binary, ids array<{kind}>, bodies array<binary>")


def evidence(docs: DataFrame, ratio: Ratios, id_col: str, text_col: str) -> DataFrame:
    """(id, x), one row per input row: the log of the mean over the text's words of toxic over ordinary likelihood.

    Windows are cut once and written; questions and texts both come from that table, so neither the
    input's partitions, nor its order, nor a task that runs again can part them.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    held = Scratch(docs.sparkSession, "toxicity").keep(read_windows(docs, id_col, text_col))

    def asked(batches):
        for b in batches:
            for no, n, names, bodies in zip(b["window"], b["n"], b["names"], b["bodies"]):
                if n:
                    key, (d, code) = _keys(n, names), _codes(n, bodies)
                    unit = np.unique(np.r_[key.ravel(), pair_units(d, key[code, -1])])
                    yield pd.DataFrame({"window": no, "unit": unit.view(np.int64)})

    def answered(texts: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        if len(texts) != 1:
            raise ValueError(f"{len(texts)} rows of one window and {len(answers)} answers")
        n, bodies, ids = int(texts["n"].iloc[0]), list(texts["bodies"].iloc[0]), texts["ids"].iloc[0]
        d, code = _codes(n, bodies)
        r = np.zeros(len(d))
        if len(d) and len(answers):
            order = np.argsort(answers["unit"].to_numpy())
            unit, value = answers["unit"].to_numpy()[order], answers["ratio"].to_numpy(float)[order]

            def get(k):
                at = np.minimum(np.searchsorted(unit, k), len(unit) - 1)
                return np.where(unit[at] == k, value[at], 0.0)

            key = _keys(n, texts["names"].iloc[0])
            path = sum(get(key[:, j].view(np.int64)) for j in range(PAIR))
            r = path[code] + get(pair_units(d, key[code, -1]).view(np.int64))
        return pd.DataFrame({"id": pd.Series(list(ids), dtype=object), "x": log_mean_ratio(r, d, len(bodies))})

    ask = held.select("window", "n", "names", "bodies").mapInPandas(asked, "window long, unit long")
    answers = ask.join(ratio.table, "unit").select("window", "unit", F.col("ratio").cast("float").alias("ratio"))
    return held.groupBy("window").cogroup(answers.groupBy("window")).applyInPandas(answered, f"id {kind}, x double")


def packed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id_col, z): whole texts compressed, so that the one shuffle of texts moves a third of them."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        c = zstandard.ZstdCompressor(level=3)
        for b in batches:
            yield pd.DataFrame({"id": b["id"], "z": [c.compress((t or "").encode("utf-8", "surrogatepass")) for t in b["text"]]})

    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return src.mapInPandas(run, f"id {kind}, z binary").withColumnsRenamed({"id": id_col})


COUNTS = ("toxic", "plain", "side_toxic", "side_plain")


def count_units(marked: DataFrame) -> DataFrame:
    """Rows (unit, parent, level, four counts): units by class and side over all rows of (z, y, side).

    Each map task sums the units of a slice of texts first, so a hot word costs it one row a
    slice; Spark sums again before the shuffle.
    """

    def run(batches):
        d_ = zstandard.ZstdDecompressor()
        for b in batches:
            kind = (1 - b["y"].to_numpy().astype(np.int64)) + 2 * b["side"].to_numpy().astype(np.int64)  # place in COUNTS
            for start, part in slices([d_.decompress(z).decode("utf-8", "surrogatepass") for z in b["z"]], COUNT_CHARS):
                d, slot, parent = units(part)
                if not len(d):
                    continue
                key, first, inv = np.unique(slot.ravel(), return_index=True, return_inverse=True)
                at = inv * 4 + np.repeat(kind[start : start + len(part)][d], LEVELS)
                n = np.bincount(at, minlength=4 * len(key)).reshape(-1, 4)
                cols = {"unit": key, "parent": parent.ravel()[first], "level": (first % LEVELS).astype(np.int8)} | {c: n[:, i].astype(np.int32) for i, c in enumerate(COUNTS)}
                del slot, parent, at, inv
                yield pd.DataFrame(cols)

    rows = marked.select("z", "y", "side").mapInPandas(run, "unit long, parent long, level byte, toxic int, plain int, side_toxic int, side_plain int")
    return rows.groupBy("unit", "parent", "level").agg(*(F.sum(c).alias(c) for c in COUNTS))


def continuations(counts: DataFrame) -> DataFrame:
    """(unit, cont): distinct predecessors of the words below each unit from the first prefix to the word."""
    up = counts.where(F.col("level") == PAIR).groupBy(F.col("parent").alias("unit")).agg(F.count("*").alias("cont"))
    out = up
    for level in range(PAIR - 1, 0, -1):
        rows = counts.where(F.col("level") == level).select("unit", "parent")
        up = rows.join(up, "unit").groupBy(F.col("parent").alias("unit")).agg(F.sum("cont").alias("cont"))
        out = out.unionByName(up)
    return out


def ratios(counts: DataFrame, without: str = "side") -> tuple[Ratios, np.ndarray]:
    """Unit log-likelihood ratios and the two word counts, from all counts or from those off the side.

    Two numbers reach the driver.
    """
    take = (lambda k: F.col(k)) if without else (lambda k: F.col(k) + F.col(f"side_{k}"))
    c = counts.select("unit", "parent", "level", *(take(k).cast("double").alias(k) for k in ("toxic", "plain"))).where(F.col("toxic") + F.col("plain") > 0)
    inner = F.col("level") < PAIR
    m = c.where(inner).join(continuations(c), "unit").unionByName(c.where(~inner).withColumn("cont", F.col("toxic") + F.col("plain")))
    sums = [F.sum(k).alias(f"{k}_n") for k in ("toxic", "plain")] + [F.sum(F.least(F.col(k), F.lit(DISCOUNT))).alias(f"{k}_held") for k in ("toxic", "plain")]
    below = m.groupBy("parent").agg(*sums, F.sum("cont").alias("cont_n"))
    root = c.where(F.col("level") == 0).agg(F.sum("toxic"), F.sum("plain")).first()
    share = F.col("cont") / F.col("cont_n")

    def p(k):
        mass = F.greatest(F.col(k) - DISCOUNT, F.lit(0.0)) + F.col(f"{k}_held") * share
        return F.when(F.col(f"{k}_n") > 0, mass / F.col(f"{k}_n")).otherwise(share)

    r = F.least(F.greatest(F.log(p("toxic") / p("plain")), F.lit(-8.0)), F.lit(8.0))
    return Ratios(m.join(below, "parent").select("unit", r.alias("ratio"))), np.array([x or 0.0 for x in root])


def calibrate(x: np.ndarray, y: np.ndarray, l2: float = 1e-3) -> np.ndarray:
    """Factor and constant of a logistic curve by Newton steps; of one class or none, its share.

    The rarer class weighs more, by the root of the classes' ratio: half way between the classes'
    own odds and even ones.
    """
    coef = np.zeros(2)
    if len(set(y.tolist())) < 2:
        coef[1] = 0.0 if not len(y) else (4.0 if y[0] else -4.0)
        return coef
    z, w = np.c_[x, np.ones(len(x))], np.where(y > 0, np.sqrt((y == 0).sum() / (y > 0).sum()), 1.0)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ coef, -40, 40)))
        h = (z * (w * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ z / len(z) + l2 * np.eye(2)
        coef = coef - np.clip(np.linalg.solve(h, z.T @ (w * (p - y)) / len(z) + l2 * coef), -2, 2)
    return coef


def train(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", calibrate_rows: int = CALIBRATE_ROWS) -> Model:
    """Models from all rows with a label where ``learn`` holds.

    A quarter of them by id hash is left out of first counts and scored to fit the calibration (at
    most about ``calibrate_rows`` of that quarter, by hash); the final counts take all. Repeated
    ids are toxic if any label says so. Only class totals and a few numbers a calibration row reach
    the driver.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "toxicity")
    marks = labels.where(learn & F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(id_col).agg(F.max(label_col).cast("int").alias("y"))
    marks = scratch.keep(marks.withColumn("side", F.pmod(F.xxhash64(F.lit("calibrate"), F.col(id_col)), F.lit(4)) == 0))
    marked = packed(docs, id_col, text_col).join(marks, id_col)
    counts = scratch.keep(count_units(marked))
    first, last = (ratios(counts, w) for w in ("side", ""))
    r = Ratios(scratch.keep(first[0].table))
    aside = F.broadcast(bounded_sample(marks.where("side"), id_col, calibrate_rows))  # its size is bounded
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(aside.withColumnRenamed(id_col, "id"), "id")
    rows = rows.groupBy("id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.max("y").alias("y"))  # one text an id, however often it is repeated
    rows = evidence(rows.select("y", "text"), r, "y", "text").toPandas()
    model = Model(Ratios(scratch.keep(last[0].table)), last[1], calibrate(rows["x"].to_numpy(float), rows["id"].to_numpy(float)))
    scratch.drop(marks, counts, r.table)
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, score), one row per input row; null and empty texts get the score of no evidence."""
    fit, kind = Model(None, model.words, model.coef), docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for b in batches:
            yield pd.DataFrame({"id": b["id"], "score": fit.calibrated(b["x"].to_numpy(float))})

    return evidence(docs, model.ratio, id_col, text_col).mapInPandas(run, f"id {kind}, score double").withColumnsRenamed({"id": id_col})


# ---- one pass over a whole table: counts and texts meet in buckets of words

#: A bucket has all words of some first prefixes, with all units below them: so many at least, and one more for each so many characters.
LEAST_BUCKETS, BUCKET_CHARS = 12, 64_000_000
#: Characters of texts that share one word list on their way to the buckets; a longer text stands alone.
BLOCK_CHARS = 16_000_000
_NONE = np.uint64(5)  # stands for the predecessor of a first word, as in pair_units


def _squeeze(a: np.ndarray) -> bytes:
    """Whole numbers from 0 in as few bytes as the largest needs, byte by byte of all of them, compressed."""
    wide = next(w for w in (1, 2, 4) if not len(a) or int(a.max()) < 1 << 8 * w)
    planes = np.ascontiguousarray(a.astype(f"<u{wide}")).view(np.uint8).reshape(-1, wide).T
    return bytes([wide]) + zstandard.ZstdCompressor(level=3).compress(planes.tobytes())


def _expand(z: bytes) -> np.ndarray:
    wide = z[0]
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(z[1:]), np.uint8).reshape(wide, -1)
    return np.ascontiguousarray(planes.T).view(f"<u{wide}").ravel().astype(np.int64)


def _codes_of(place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(codes, places in the order of their codes): places that come once have code 0 and stand last, in the order they come in."""
    listed, first, inv, n = np.unique(place, return_index=True, return_inverse=True, return_counts=True)
    often = np.flatnonzero(n > 1)
    often = often[np.argsort(-n[often], kind="stable")]
    code = np.zeros(len(listed), np.int64)
    code[often] = np.arange(1, len(often) + 1)
    return code[inv], listed[np.r_[often, (once := np.flatnonzero(n == 1))[np.argsort(first[once])]]]


def _places_of(code: np.ndarray, n: int) -> np.ndarray:
    """Places in a list of ``n`` from codes."""
    once = np.flatnonzero(code == 0)
    place = code - 1
    place[once] = np.arange(n - len(once), n)
    return place


def _names(listed: list[str]) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress("\n".join(listed).encode("utf-8", "surrogatepass"))


def read_blocks(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(block, n, chars, ids, sizes, names, codes): a row a block of whole texts, their words as codes of its word list, frequent ones first."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for no, ids, texts in windows(batches, BLOCK_CHARS):
            d, code, listed = words_of(texts)
            code, order = _codes_of(code)
            row = {"block": no, "n": len(listed), "chars": sum(len(t or "") for t in texts), "ids": ids, "sizes": _squeeze(np.bincount(d, minlength=len(ids)))}
            yield pd.DataFrame([row | {"names": _names([listed[i] for i in order]), "codes": _squeeze(code)}])
            del d, code, listed, order, row
            pa.default_memory_pool().release_unused()  # workers go on to the buckets

    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return src.mapInPandas(run, f"block long, n int, chars long, ids array<{kind}>, sizes binary, names binary, codes binary")


#: Bytes of a predecessor's hash; the pairs of one word are told apart by them.
BEFORE_BYTES = 5
#: Bytes of a bucket's compressed parts that a task keeps in memory between counting and scoring; more go to its temp folder.
SPOOL = 128_000_000
_PARTS = "bucket int, block long, names binary, befores binary, word binary, before binary, sizes binary, marks binary"


def to_buckets(blocks: DataFrame, buckets: int) -> DataFrame:
    """Parts of blocks by bucket of their words, each bucket in one partition.

    A part has the names of its words, the hashes of the words before them, for each word of the texts its step from the text's last one in
    the list of names and the code of the one before it, how many words each text has in it, and the texts' marks: 0, or 1 and the bits of learning rows (toxic 1, side 2, calibration 4).
    ``blocks`` has ``marks``, (place of the text, bits) of learning rows.
    """

    def run(batches):
        for frame in batches:
            for r in frame.itertuples(index=False):
                if not r.n:
                    continue
                names = zstandard.ZstdDecompressor().decompress(r.names).decode("utf-8", "surrogatepass").split("\n")
                key, code, sizes = _hash_words(names), _places_of(_expand(r.codes), r.n), _expand(r.sizes)
                mark = np.zeros(len(sizes), np.int64)
                for m in r.marks if r.marks is not None else ():
                    mark[m["at"]] = 1 + m["bits"]
                marks = _squeeze(mark) if mark.any() else b""
                text = np.repeat(np.arange(len(sizes)), sizes)
                before = np.r_[r.n, code[:-1]]
                before[np.r_[True, text[1:] != text[:-1]]] = r.n
                hashes = np.r_[key[:, -1], _NONE].view(np.uint8).reshape(-1, 8)[:, :BEFORE_BYTES]
                mine = (key[:, 0] % np.uint64(buckets)).astype(np.int64)[code]
                order, out = np.lexsort((code, text, mine)), []  # sums don't hang on the order in a text: sorted words take less space
                cut = np.searchsorted(mine[order], np.arange(buckets + 1))
                for k in np.flatnonzero(np.diff(cut)).tolist():
                    x = order[cut[k] : cut[k + 1]]
                    w, word = np.unique(code[x], return_inverse=True)
                    new = np.r_[True, text[x][1:] != text[x][:-1]]
                    step = np.where(new, word, np.diff(word, prepend=0))
                    place, b = _codes_of(before[x])
                    out.append((k, r.block, _names([names[i] for i in w]), hashes[b].tobytes(), _squeeze(step), _squeeze(place), _squeeze(np.bincount(text[x], minlength=len(sizes))), marks))
                yield pd.DataFrame(out, columns=[c.split()[0] for c in _PARTS.split(", ")])

    rows = blocks.select("block", "n", "sizes", "names", "codes", "marks").mapInPandas(run, _PARTS)
    return rows.repartitionById(buckets, "bucket").sortWithinPartitions("bucket", "block")


def _words_and_pairs(row) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys of the part's words by level, place of the word, pair unit) of a part."""
    key = _hash_words(zstandard.ZstdDecompressor().decompress(row.names).decode("utf-8", "surrogatepass").split("\n"))
    hashes = np.frombuffer(row.befores, np.uint8).reshape(-1, BEFORE_BYTES)
    befores = np.pad(hashes, ((0, 0), (0, 8 - BEFORE_BYTES))).view(np.uint64).ravel()
    step, sizes = _expand(row.word), _expand(row.sizes)
    sizes = sizes[sizes > 0]
    run = np.cumsum(step)
    start = np.cumsum(sizes) - sizes
    word = run - np.repeat(run[start] - step[start], sizes)
    return key, word, _mix(befores[_places_of(_expand(row.before), len(befores))] * _M1 + key[word, -1]) + np.uint64(7)


class Bucket:
    """The counted units of a bucket: distinct pairs with their four counts, and the paths of their words."""

    def __init__(self):
        self.path, self.unit, self.word, self.n = np.zeros((0, PAIR), np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros((0, 4), np.int32)
        self.new: list[tuple] = []
        self.waiting = 0

    def add(self, row) -> None:
        """Count the words of a part's learning rows."""
        if not row.marks:
            return
        key, word, unit = _words_and_pairs(row)
        bits = np.repeat(_expand(row.marks), _expand(row.sizes)) - 1
        at = np.flatnonzero(bits >= 0)
        unit, first, inv = np.unique(unit[at], return_index=True, return_inverse=True)
        n = np.bincount(inv * 4 + (1 - (bits[at] & 1)) + (bits[at] & 2), minlength=4 * len(unit)).reshape(-1, 4).astype(np.int32)
        self.new.append((key[np.unique(word[at])], unit, key[word[at][first], -1], n))
        self.waiting += len(unit)
        if self.waiting > max(250_000, len(self.unit) // 2):
            self.merge()

    def merge(self) -> None:
        parts = [(self.path, self.unit, self.word, self.n), *self.new]
        self.new, self.waiting = [], 0
        path, unit, word, n = (np.concatenate([p[i] for p in parts]) for i in range(4))
        self.path = path[np.unique(path[:, -1], return_index=True)[1]]
        self.unit, first, inv = np.unique(unit, return_index=True, return_inverse=True)
        self.word = word[first]
        self.n = np.stack([np.bincount(inv, n[:, i], minlength=len(first)).astype(np.int32) for i in range(4)], axis=1)

    def _live(self, side: bool) -> tuple[np.ndarray, ...]:
        """(pair units, their class counts, place of their words, paths) of what is counted, with or without the side."""
        n = (self.n[:, :2] + self.n[:, 2:] if side else self.n[:, :2]).astype(float)
        live = n.sum(axis=1) > 0
        word, at = np.unique(self.word[live], return_inverse=True)
        return self.unit[live], n[live], at, self.path[np.searchsorted(self.path[:, -1], word)]

    def root(self, side: bool) -> np.ndarray:
        """What the bucket adds to the root: words of both classes, first prefixes with words of each, continuations of all."""
        unit, n, at, path = self._live(side)
        first, inv = np.unique(path[at, 0], return_inverse=True)
        have = [np.count_nonzero(np.bincount(inv, n[:, k], minlength=len(first))) for k in (0, 1)]
        return np.array([*n.sum(axis=0), *have, len(unit)], float)

    def ratios(self, side: bool, root: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """(units in order, ratios) by level, the pairs last, as in the table of all ratios; ``root`` sums all buckets."""

        def level(n, cont, sums, held, cont_n):
            share = (cont / cont_n)[:, None]
            p = np.where(sums > 0, (np.maximum(n - DISCOUNT, 0) + held * share) / np.maximum(sums, 1), share)
            return np.clip(np.log(p[:, 0] / p[:, 1]), -8, 8)

        def below(inv, size, n, cont):
            """Sums over the units below each of ``size`` parents."""
            each = lambda v: np.stack([np.bincount(inv, v[:, k], minlength=size) for k in (0, 1)], axis=1)
            return each(n), each(np.minimum(n, DISCOUNT)), np.bincount(inv, cont, minlength=size)

        unit, n, at, path = self._live(side)
        sums, held, total = below(at, len(path), n, n.sum(axis=1))
        out = [(unit, level(n, n.sum(axis=1), sums[at], held[at], total[at]))]
        n, cont = sums, np.bincount(at, minlength=len(path)).astype(float)
        for j in range(PAIR - 1, 0, -1):
            parent, first, inv = np.unique(path[:, j - 1], return_index=True, return_inverse=True)
            sums, held, total = below(inv, len(parent), n, cont)
            order = np.argsort(path[:, j])
            out.append((path[order, j], level(n, cont, sums[inv], held[inv], total[inv])[order]))
            n, cont, path = sums, total, path[first]
        out.append((path[:, 0], level(n, cont, root[:2], DISCOUNT * root[2:4], root[4])))
        return out[::-1]


def _look_up(table: tuple[np.ndarray, np.ndarray], key: np.ndarray) -> np.ndarray:
    unit, ratio = table
    if not len(unit):
        return np.zeros(len(key))
    at = np.minimum(np.searchsorted(unit, key), len(unit) - 1)
    return np.where(unit[at] == key, ratio[at], 0.0)


def _likelihoods(levels: list, row) -> np.ndarray:
    """Likelihood ratio of each word of a part."""
    key, word, unit = _words_and_pairs(row)
    path = sum(_look_up(levels[j], key[:, j]) for j in range(PAIR))
    different, inv = np.unique(unit, return_inverse=True)
    return np.exp(path[word] + _look_up(levels[PAIR], different)[inv])


def score_all(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", calibrate_rows: int = CALIBRATE_ROWS) -> DataFrame:
    """(id_col, score), one row per row of ``docs``: what ``score`` gives with the model that ``train`` gives for the same rows.

    No table of units is made. Texts are read once, into blocks that are written; all units below a first prefix meet in one bucket, so a
    bucket's task counts what its learning rows hold, computes their ratios, and sums likelihood ratios over the words of every text.
    What ratios of first prefixes need of all buckets is summed by a job before. A task keeps the distinct counted pairs of its bucket
    in memory; buckets grow in number with the input. Sums of a text over buckets, 4 bytes each, are added up by block.
    """
    spark, kind = docs.sparkSession, docs.schema[id_col].dataType.simpleString()
    scratch = Scratch(spark, "toxicity")
    held = scratch.keep(read_blocks(docs, id_col, text_col))
    chars = held.agg(F.sum("chars")).first()[0] or 0
    buckets = max(LEAST_BUCKETS, -(-chars // BUCKET_CHARS))

    marks = labels.where(learn & F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("y"))
    marks = scratch.keep(marks.withColumn("side", F.pmod(F.xxhash64(F.lit("calibrate"), F.col("id")), F.lit(4)) == 0))
    aside = scratch.keep(bounded_sample(marks.where("side"), "id", calibrate_rows).select("id", F.lit(4).alias("aside")))
    bits = F.col("y") + F.when(F.col("side"), 2).otherwise(0) + F.coalesce("aside", F.lit(0))
    bits = marks.join(F.broadcast(aside), "id", "left").select("id", bits.cast("byte").alias("bits"))  # the calibration rows are bounded
    by_block = held.select("block", F.posexplode("ids").alias("at", "id")).join(bits, "id").groupBy("block").agg(F.collect_list(F.struct("at", "bits")).alias("marks"))
    by_block = scratch.keep(by_block)
    marked = held.join(by_block, "block", "left")

    # one shuffle for both jobs: the second finds the files of the first
    parts = to_buckets(held.join(by_block, "block", "left"), buckets).rdd

    def roots(rows):
        for _, part in groupby(rows, lambda r: r.bucket):
            bucket = Bucket()
            for row in part:
                bucket.add(row)
            bucket.merge()
            yield np.r_[bucket.root(False), bucket.root(True)].tolist()

    root = np.sum([np.zeros(10), *parts.mapPartitions(roots).collect()], axis=0).reshape(2, 5)

    def sums(rows):
        for no, part in groupby(rows, lambda r: r.bucket):
            bucket, n = Bucket(), 0
            with tempfile.SpooledTemporaryFile(max_size=SPOOL) as spool:
                for row in part:
                    bucket.add(row)
                    pickle.dump(row, spool)
                    n += 1
                bucket.merge()
                first, last = (bucket.ratios(side, root[int(side)]) for side in (False, True))
                bucket = None
                spool.seek(0)
                for _ in range(n):
                    row = pickle.load(spool)
                    sizes = _expand(row.sizes)
                    text, some = np.repeat(np.arange(len(sizes)), sizes), np.flatnonzero(sizes)
                    mean = np.bincount(text, _likelihoods(last, row), minlength=len(sizes))[some].astype(np.float32)
                    before = b""
                    if row.marks and (aside := _expand(row.marks) > 4).any():
                        x = np.bincount(text, _likelihoods(first, row), minlength=len(sizes))[some] * aside[some]
                        before = zstandard.ZstdCompressor(level=3).compress(x.astype(np.float32).tobytes())
                    yield row.block, no, _squeeze(np.diff(some, prepend=0)), mean.tobytes(), before

    parts = spark.createDataFrame(parts.mapPartitions(sums), "block long, bucket int, some binary, last binary, first binary", verifySchema=False)

    def whole(blocks: pd.DataFrame, parts: pd.DataFrame) -> pd.DataFrame:
        if len(blocks) != 1:
            raise ValueError(f"{len(blocks)} rows of one block and {len(parts)} parts")
        sizes = _expand(blocks["sizes"].iloc[0])
        total, marked = np.zeros((2, len(sizes))), np.zeros(len(sizes), bool)
        for r in parts.sort_values("bucket").itertuples(index=False):
            at = np.cumsum(_expand(r.some))
            total[1, at] += np.frombuffer(r.last, np.float32)
            if r.first:
                total[0, at] += np.frombuffer(zstandard.ZstdDecompressor().decompress(r.first), np.float32)
        x = np.where(sizes > 0, np.log(np.maximum(total, 1e-300) / np.maximum(sizes, 1)), 0.0)
        return pd.DataFrame({"id": pd.Series(list(blocks["ids"].iloc[0]), dtype=object), "x": x[1], "before": x[0]})

    x = held.select("block", "ids", "sizes").groupBy("block").cogroup(parts.groupBy("block")).applyInPandas(whole, f"id {kind}, x double, before double")
    x = scratch.keep(x)
    fit = x.join(F.broadcast(marks.join(F.broadcast(aside), "id").select("id", "y")), "id").groupBy("id").agg(F.min("before").alias("x"), F.max("y").alias("y")).toPandas()
    coef = [float(v) for v in calibrate(fit["x"].to_numpy(float), fit["y"].to_numpy(float))]
    scratch.drop(held, marks, aside, by_block)
    z = F.least(F.greatest(F.col("x") * coef[0] + coef[1], F.lit(-40.0)), F.lit(40.0))
    return x.select(F.col("id").alias(id_col), (1 / (1 + F.exp(-z))).alias("score"))

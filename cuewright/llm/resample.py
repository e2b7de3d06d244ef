"""Target-distribution importance resampling over hashed word n-grams, with repeated lines counted once.

Newlines cut texts into lines. Equal lines are grouped first: the features inside a line are hashed once for each distinct
line and their counts multiplied by its occurrences. N-grams that go over a line's end belong to no line; they are taken
from the words round the ends, document by document. Both parts give bucket counts, the buckets' gains,
and then, the same way, each document's weight: the sum of its lines' weights and of its crossing n-grams.

Features are hashed in numpy by joining CRC32 values: the sum of ``a b`` follows from that of ``a``, that of
``b`` and b's length, so every word's bytes are read once whatever the length of the n-gram.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuewright.operators.layout import numbered

from .common import Scratch

BUCKETS = 10_000
#: A line with more than this share of all lines is joined by broadcast; there are at most 1 / HOT of them.
HOT = 1 / 5_000
SEED = 42

# ---- CRC32 of words and of words joined

#: fixed value: CRC32's polynomial, lowest bit first
POLYNOMIAL = np.uint32(0xEDB88320)


def _byte_table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> np.uint32(1)) ^ POLYNOMIAL, c >> np.uint32(1))
    return c


TABLE = _byte_table()
LONG = 64


def _shifts() -> np.ndarray:
    """[k, i, b]: what byte i of a checksum, holding b, becomes when k more bytes follow."""
    out = np.empty((LONG + 1, 4, 256), np.uint32)
    for i in range(4):
        out[0, i] = np.arange(256, dtype=np.uint32) << np.uint32(8 * i)
    for k in range(LONG):
        out[k + 1] = (out[k] >> np.uint32(8)) ^ TABLE[out[k] & np.uint32(255)]
    return out


SHIFT = _shifts()


def shifted(c: np.ndarray, by: np.ndarray) -> np.ndarray:
    """Checksums after ``by`` more bytes, without those bytes' own part."""
    c, by = c.copy(), by.copy()
    while (far := np.flatnonzero(by > LONG)).size:
        c[far] = shifted(c[far], np.full(len(far), LONG, by.dtype))
        by[far] -= LONG
    b = [(c >> np.uint32(8 * i)) & np.uint32(255) for i in range(4)]
    return SHIFT[by, 0, b[0]] ^ SHIFT[by, 1, b[1]] ^ SHIFT[by, 2, b[2]] ^ SHIFT[by, 3, b[3]]


def word_sums(buf: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """CRC32 of each word buf[start : start + size]."""
    c = np.full(len(start), 0xFFFFFFFF, np.uint32)
    order = np.argsort(np.minimum(size, LONG + 1).astype(np.uint8), kind="stable")[::-1]
    at, left = start[order], np.minimum(size, LONG + 1)[order]
    ends = np.searchsorted(-left, -np.arange(1, LONG + 1), side="right")  # words of at least 1, 2, .. bytes
    run = c[order]
    for p in range(LONG):
        n = ends[p]
        if n == 0:
            break
        run[:n] = TABLE[(run[:n] ^ buf[at[:n] + p]) & np.uint32(255)] ^ (run[:n] >> np.uint32(8))
    c[order] = run ^ np.uint32(0xFFFFFFFF)
    for i in np.flatnonzero(size > LONG):
        c[i] = zlib.crc32(buf[start[i] : start[i] + size[i]])
    return c


# ---- words and n-grams of many texts in one buffer

_LOW = np.arange(256, dtype=np.uint8)
_LOW[65:91] += 32
WORD = np.zeros(256, bool)
WORD[48:58] = WORD[97:123] = WORD[128:] = True
_SPACE = np.uint32(zlib.crc32(b" "))


def words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(buffer, start, size, text number, line number) of all words; line numbers go on through all texts.

    Bytes decide: all bytes of a character beyond ASCII are word bytes.
    """
    buf = _LOW[np.frombuffer(b"\n".join([*texts, b""]), np.uint8)]
    edge = np.diff(np.concatenate([[False], WORD[buf], [False]]).astype(np.int8))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    ends = np.cumsum([len(t) + 1 for t in texts]) if texts else np.zeros(0, int)
    return buf, start, end - start, np.searchsorted(ends, start, side="right"), np.searchsorted(np.flatnonzero(buf == 10), start)


def features(texts: list[bytes], crossing: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, text number, words a text) of the features inside the texts' lines, or of those that cross a line's end."""
    buf, start, size, text, line = words(texts)
    n_words = np.bincount(text, minlength=len(texts))
    two, three = text[1:] == text[:-1], text[2:] == text[:-2]
    over2, over3 = line[1:] != line[:-1], line[2:] != line[:-2]
    two, three = two & (over2 if crossing else ~over2), three & (over3 if crossing else ~over3)
    need = np.full(len(start), not crossing)
    if crossing:  # words in no crossing n-gram aren't hashed
        for k, ok in ((2, two), (3, three)):
            for j in range(k):
                need[j : j + len(ok)] |= ok
        place = np.cumsum(need) - 1
        i2, i3 = place[np.flatnonzero(two)], place[np.flatnonzero(three)]
        start, size, text = start[need], size[need], text[need]
    else:
        i2, i3 = np.flatnonzero(two), np.flatnonzero(three)
    one = word_sums(buf, start, size)
    after = shifted(np.full(len(one), _SPACE, np.uint32), size) ^ one  # of a space and the word
    join = lambda c, i: shifted(c, size[i] + 1) ^ after[i]
    pair = join(one[i2], i2 + 1)
    triple = join(join(one[i3], i3 + 1), i3 + 2)
    parts = [(pair, text[i2]), (triple, text[i3])] + ([] if crossing else [(one, text)])
    return np.concatenate([p[0] for p in parts]) % np.uint32(BUCKETS), np.concatenate([p[1] for p in parts]), n_words


CHARS = 1 << 22


def _pieces(batch: pa.RecordBatch):
    """(first row, texts as bytes) of about CHARS bytes; a longer text alone."""
    rows, first, held = [], 0, 0
    for i, t in enumerate(batch.column(batch.schema.get_field_index("text")).cast(pa.binary())):
        rows.append(t.as_py() or b"")
        held += len(rows[-1])
        if held >= CHARS or len(rows) >= 50_000:
            yield first, rows
            rows, first, held = [], i + 1, 0
    if rows:
        yield first, rows


def bucket_counts(df: DataFrame, crossing: bool) -> DataFrame:
    """(bucket, s): one row a bucket and task, from ``text`` and its number of occurrences ``n``."""

    def run(batches):
        s = np.zeros(BUCKETS, np.int64)
        for b in batches:
            n = b.column("n").to_numpy()
            for first, texts in _pieces(b):
                bucket, text, _ = features(texts, crossing)
                s += np.bincount(bucket, weights=n[first + text], minlength=BUCKETS).astype(np.int64)
        hit = np.flatnonzero(s)
        yield pa.RecordBatch.from_arrays([pa.array(hit, pa.int32()), pa.array(s[hit])], ["bucket", "s"])

    return df.select("text", F.col("n").cast("long")).mapInArrow(run, "bucket int, s long")


def weights(df: DataFrame, gains: np.ndarray, crossing: bool) -> DataFrame:
    """``df`` without ``text``, with n_features, weight and n_words of each row's features of that kind."""
    rest = [f for f in df.schema.fields if f.name != "text"]
    table = df.sparkSession.sparkContext.broadcast(gains)
    names = [f.name for f in rest]

    def run(batches):
        for b in batches:
            m = b.num_rows
            n, w, k = np.zeros(m, np.int64), np.zeros(m, np.int64), np.zeros(m, np.int64)
            for first, texts in _pieces(b):
                bucket, text, n_words = features(texts, crossing)
                part = slice(first, first + len(texts))
                k[part] = n_words
                n[part] = np.bincount(text, minlength=len(texts))
                w[part] = np.bincount(text, weights=table.value[bucket], minlength=len(texts)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(n), pa.array(w), pa.array(k)], [*names, "n_features", "weight", "n_words"])

    spec = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest)
    return df.mapInArrow(run, f"{spec}, n_features long, weight long, n_words long")


def _key(name: str, of: str) -> list:
    return [F.xxhash64(of).alias(f"{name}1"), F.xxhash64(F.lit(name), of).alias(f"{name}2")]


def _lines(texts: DataFrame, *cols) -> DataFrame:
    return texts.select(*cols, F.explode(F.split("text", "\n")).alias("line"))


def distinct_lines(texts: DataFrame) -> DataFrame:
    """(text, n): the distinct lines of ``text`` and how often each occurs."""
    return _lines(texts).groupBy("line").agg(F.count("*").alias("n")).withColumnRenamed("line", "text")


def counts(texts: DataFrame, lines: DataFrame) -> DataFrame:
    """(bucket, s) of all features of ``texts``, whose distinct lines are ``lines``: at most BUCKETS rows."""
    both = bucket_counts(lines, False).unionByName(bucket_counts(texts.withColumn("n", F.lit(1)), True))
    return both.groupBy("bucket").agg(F.sum("s").alias("s"))


def bucket_gains(source: DataFrame, target: DataFrame) -> np.ndarray:
    """Gains by bucket from two (bucket, s) tables: a bounded table of BUCKETS numbers, kept as doubles."""
    side = lambda df, c: df.select("bucket", F.col("s").alias(c))
    rows = side(source, "s").join(side(target, "t"), "bucket", "full").na.fill(0).toPandas()
    s, t = np.zeros(BUCKETS), np.zeros(BUCKETS)
    s[rows["bucket"]], t[rows["bucket"]] = rows["s"], rows["t"]
    return np.floor(1000 * np.log((t + 1) * (s.sum() + BUCKETS) / ((s + 1) * (t.sum() + BUCKETS))))


def document_weights(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text") -> DataFrame:
    """(id, t1, t2, copies, n_features, weight, n_words): one row per distinct id and text, t1 and t2 its hashes.

    Lines are joined by a hash of 128 bits. Those that make up more than HOT of all lines, at most 1 / HOT,
    are broadcast, so no key of the other join holds more than that share.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "resample")
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    aim = target.select(F.coalesce(F.col(target_text).cast("string"), F.lit("")).alias("text"))
    lines = scratch.keep(distinct_lines(texts))
    gains = bucket_gains(counts(texts.select("text"), lines), counts(aim, distinct_lines(aim)))
    scored = scratch.keep(weights(lines.select(*_key("l", "text"), "n", "text"), gains, False))
    total = scored.agg(F.sum("n")).first()[0] or 0
    scratch.drop(lines)
    hot, cold = (scored.where(c).drop("n") for c in (F.col("n") > total * HOT, F.col("n") <= total * HOT))
    mine = _lines(texts, "id", *_key("t", "text")).select("id", "t1", "t2", *_key("l", "line"))
    by = ["l1", "l2"]
    hot_part = mine.join(F.broadcast(hot), by)
    cold_part = mine.join(F.broadcast(hot.select(*by)), by, "left_anti").join(cold.hint("merge"), by)
    cols = ["id", "t1", "t2", "n_features", "weight", "n_words"]
    part = lambda df, copies, words: df.select(*cols[:-1], words.alias("n_words"), F.lit(copies).alias("copies"))
    over = weights(texts.select("id", *_key("t", "text"), "text"), gains, True)
    rows = part(hot_part, 0, F.col("n_words")).unionByName(part(cold_part, 0, F.col("n_words"))).unionByName(part(over, 1, F.lit(0).cast("long")))
    rows = rows.groupBy("id", "t1", "t2").agg(*(F.sum(c).alias(c) for c in ("copies", "n_features", "weight", "n_words")))
    share = lambda c: F.expr(f"{c} div copies").alias(c)
    return rows.select("id", "t1", "t2", "copies", share("n_features"), share("weight"), share("n_words"))


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text") -> DataFrame:
    """(id_col, n_features, weight, score, rank) of every row of ``docs``; ``rank`` is null where it isn't drawn.

    A document's weight is the sum over its features of the log ratio of target and source shares of their
    bucket, its score the weight and Gumbel noise seeded by its id, so that the highest scores are a sample without
    replacement in proportion to the ratios. Null and empty texts have no features and weight 0; a null id's
    noise is that of the empty string, and it comes last among ties. Equal scores go by id, then by a hash of
    the text. Repeated rows each count and can each be drawn. Empty tables give no row; an empty target is
    smoothed like any other. Further columns are left out: join by id, or use ``drawn``.
    """
    x = document_weights(docs, target, id_col, text_col, target_text)
    x = Scratch(docs.sparkSession, "resample").keep(x)
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{SEED}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    x = x.withColumn("score", F.col("weight") + noise).select("*", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy"))
    able = F.col("n_words") >= least_words
    n = x.where(able).count()
    last = F.col("id").isNull()
    top = numbered(x.where(able).select("score", "id", "t1", "t2", "copy", last.alias("last"), (-F.col("score")).alias("down")), [], ["down", "last", "id", "t1", "t2", "copy"], "place")
    top = top.where(F.col("place") < percent * n // 100).select((F.col("place") + 1).alias("rank"), *(F.col(c).alias(f"r_{c}") for c in ("id", "t1", "t2", "copy")))
    same = F.col("r_id").eqNullSafe(F.col("id")) & (F.col("r_t1") == F.col("t1")) & (F.col("r_t2") == F.col("t2")) & (F.col("r_copy") == F.col("copy"))
    return x.join(top, same, "left").select(F.col("id").alias(id_col), "n_features", "weight", "score", "rank")


def drawn(docs: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20, id_col: str = "doc_id", **names) -> DataFrame:
    """The rows of ``docs`` whose id is drawn, with all their columns."""
    ids = resample(docs, target, percent, least_words, id_col, **names).where("rank is not null").select(F.col(id_col).alias("__id")).distinct()
    return docs.join(ids, docs[id_col].eqNullSafe(F.col("__id")), "left_semi")


#: The contract's columns without any grouping of lines; CRC32 byte by byte from a table of 256 entries.
ORACLE_SQL = r"""
WITH tab AS MATERIALIZED (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i::BIGINT, range(8)::BIGINT[]), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END) AS c FROM range(256) r(i))),
texts AS (SELECT 0 AS side, doc_id AS id, text FROM documents UNION ALL SELECT 1, item_id, text FROM benchmark),
w AS MATERIALIZED (SELECT side, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM texts),
f AS MATERIALIZED (SELECT side, id, unnest(list_concat(ws, list_concat(
  list_transform(range(1, greatest(len(ws), 1)), lambda i: ws[i] || ' ' || ws[i + 1]),
  list_transform(range(1, greatest(len(ws) - 1, 1)), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])))) AS f FROM w),
d AS (SELECT f, hex(encode(f)) AS hx FROM (SELECT DISTINCT f FROM f)),
b AS MATERIALIZED (SELECT f, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(length(hx) // 2), lambda j: ('0x' || substr(hx, (2 * j + 1)::BIGINT, 2))::BIGINT)), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295::BIGINT) % 10000 AS bucket FROM d, tab),
n AS (SELECT bucket, count(*) FILTER (side = 0) AS s, count(*) FILTER (side = 1) AS t FROM f JOIN b USING (f) GROUP BY bucket),
total AS (SELECT sum(s)::DOUBLE AS s, sum(t)::DOUBLE AS t FROM n),
g AS (SELECT bucket, floor(1000 * ln((n.t + 1)::DOUBLE * (total.s + 10000) / ((n.s + 1)::DOUBLE * (total.t + 10000))))::BIGINT AS gain FROM n, total),
weighed AS (SELECT id, count(*) AS n_features, sum(gain)::BIGINT AS weight FROM f JOIN b USING (f) JOIN g USING (bucket) WHERE side = 0 GROUP BY id),
scored AS (SELECT w.id AS doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, len(ws) >= 20 AS able,
  coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || w.id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE)))::BIGINT AS score FROM w LEFT JOIN weighed USING (id) WHERE side = 0),
placed AS (SELECT *, CASE WHEN able THEN row_number() OVER (PARTITION BY able ORDER BY score DESC, doc_id) END AS place FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 5 * (SELECT count(*) FROM scored WHERE able) // 100 THEN place END AS rank FROM placed
"""

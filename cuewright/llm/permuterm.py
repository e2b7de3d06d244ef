"""Spelling variants: words one edit apart, found by the sorted rotations of terminator-marked words.

A word is marked with a terminator and turned: ``abc`` has the rotations ``abc$ bc$a c$ab $abc``.
Turned so that position i comes last, a word shares all before that last letter, its stem, with the words
that have another letter at i; and the stem itself is a whole rotation of the word without position i. So
all words in a stem's prefix range, skipping the edited letter, are neighbours: a replacement for two that
go one letter beyond the stem, an indel for one that goes beyond it and the one that ends there.
Spark sorts the rotations by stem and windows scan the ranges. A range has at most one word
a letter and one that ends, whatever the number of words, so no range is large. In a run of
equal letters each deletion gives the same word; only the run's last letter counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LETTERS = r"[A-Za-zÀ-ÿ]"
#: Not a letter, so it stands for the end of a word only.
END = "$"
#: A form has at least so many times the occurrences of the word; one in DROP words loses a letter.
TIMES, DROP = 10, 31


def occurrences(docs: DataFrame, least: int = 7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word): every occurrence of at least ``least`` letters, after the contract's seeded slips.

    A null text has none; a null id counts as an empty string. Runs are whole, whatever their length.
    """
    runs = F.regexp_extract_all(F.col(text_col).cast("string"), F.lit(f"{LETTERS}{{{least},}}"), 0)
    x = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run"))
    x = x.select("id", F.translate("run", UPPER, LOWER).alias("run"))
    h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    at = (h % F.length("run")).cast("int")
    slip = F.concat(F.col("run").substr(F.lit(1), at), F.expr("substring(run, cast(h % length(run) as int) + 2)"))
    word = F.when(F.col("h") % DROP == 0, slip).otherwise(F.col("run"))
    return x.withColumn("h", h).select(word.alias("word")).where(F.length("word") >= least)


def vocabulary(docs: DataFrame, least: int = 7, times: int = 2) -> DataFrame:
    """(word, n): distinct words that occur at least ``times`` times."""
    return occurrences(docs, least).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= times)


def rotations(words: DataFrame) -> DataFrame:
    """(stem, kind, word, n): 0 where the stem is a whole rotation, else the rotation goes one letter
    beyond it: 2 where that letter is the last of a run of equal ones, 1 elsewhere."""
    size = F.length("word")
    x = words.select("word", "n", F.explode(F.sequence(F.lit(0), size)).alias("i"))
    at = lambda start: F.substring("word", start, F.lit(1))
    turned = F.concat(F.substring("word", F.col("i") + 1, size), F.lit(END), F.substring("word", F.lit(1), F.col("i")))
    # the letter at i comes last; at i = size there is none but the terminator
    skipped = F.concat(F.substring("word", F.col("i") + 2, size), F.lit(END), F.substring("word", F.lit(1), F.col("i")))
    last = F.when((F.col("i") + 1 < size) & (at(F.col("i") + 1) == at(F.col("i") + 2)), 1).otherwise(2)
    whole = F.struct(turned.alias("stem"), F.lit(0).alias("kind"))
    more = F.struct(skipped.alias("stem"), last.alias("kind"))
    both = F.when(F.col("i") < size, F.array(whole, more)).otherwise(F.array(whole))
    return x.select("word", "n", F.explode(both).alias("r")).select("r.stem", "r.kind", "word", "n")


def _best(n: Column, word: Column) -> Column:
    """Ordered so that the smallest has the largest n, then the smallest word in code-point order."""
    return F.struct((-n).alias("neg"), word.alias("word"))


def neighbours(words: DataFrame) -> DataFrame:
    """(word, n_near, best): of words with a near one; ``best`` is (neg, word) of the near word of largest n.

    ``words`` has distinct (word, n). One row a word and range is emitted, never the pairs of a range.
    """
    stem = W.partitionBy("stem")
    inside = stem.orderBy(F.col("beyond").desc(), "me.neg", "me.word").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    x = rotations(words).select("stem", "kind", (F.col("kind") > 0).alias("beyond"), _best(F.col("n"), F.col("word")).alias("me"))
    me, kind = F.col("me"), F.col("kind")
    x = x.select(
        "kind", "me",
        F.count_if(kind > 0).over(inside).alias("n_beyond"), F.count_if(kind == 2).over(inside).alias("n_last"),
        F.first(F.when(kind > 0, me), ignorenulls=True).over(inside).alias("b1"), F.nth_value(F.when(kind > 0, me), 2, ignoreNulls=True).over(inside).alias("b2"),
        F.first(F.when(kind == 2, me), ignorenulls=True).over(inside).alias("last1"), F.first(F.when(kind == 0, me), ignorenulls=True).over(inside).alias("whole"),
    )
    other = F.when(F.col("b1.word") == F.col("me.word"), F.col("b2")).otherwise(F.col("b1"))
    short = F.when(kind == 2, F.col("whole"))
    near = F.when(kind == 0, F.col("n_last")).otherwise(F.col("n_beyond") - 1 + short.isNotNull().cast("long"))
    best = F.when(kind == 0, F.col("last1")).when(other.isNull(), short).when(short.isNull(), other).otherwise(F.least(other, short))
    x = x.select(F.col("me.word").alias("word"), near.alias("near"), best.alias("best")).where("near > 0")
    return x.groupBy("word").agg(F.sum("near").alias("n_near"), F.min("best").alias("best"))


def roots(forms: DataFrame, scratch: Scratch) -> DataFrame:
    """(word, root): where the chain of forms ends, by doubling: each round joins every pointer with its target's.

    n grows ten times a step, so chains are short: 64-bit counts allow 19 steps, five rounds.
    """
    now = scratch.keep(forms.select("word", F.col("form").alias("root")))
    while True:
        hop = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        x = scratch.keep(now.join(hop, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        moved = not x.where("moved").isEmpty()
        scratch.drop(now)
        now = x.drop("moved")
        now._scratch_path = x._scratch_path
        if not moved:
            return now


def variants(docs: DataFrame, least: int = 7, times: int = 2, factor: int = TIMES) -> DataFrame:
    """(word, form, root, n, n_near, form_n): the words of ``docs`` with their neighbours by one edit.

    A word is a distinct run of letters of at least ``least`` letters with at least ``times``
    occurrences; near are two that differ by one inserted, deleted or replaced letter. The form is the near
    word of largest n (ties: smallest in code-point order) if that is at least ``factor`` times the word's
    n, else null. An empty table, null, empty and very long texts, repeated rows and further columns are fine: all
    rows count, texts are read whole.
    """
    scratch = Scratch(docs.sparkSession, "permuterm")
    words = scratch.keep(vocabulary(docs, least, times))
    x = words.join(neighbours(words), "word", "left")
    ok = -F.col("best.neg") >= factor * F.col("n")
    x = scratch.keep(x.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(ok, F.col("best.word")).alias("form"), F.when(ok, -F.col("best.neg")).alias("form_n")))
    scratch.drop(words)
    end = roots(x.where("form is not null"), scratch)
    return x.join(end, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


#: Near words by deletion: equal without one letter at the same place, or one equal to the other without a letter.
ORACLE_SQL = r"""
WITH RECURSIVE tab AS MATERIALIZED (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i::BIGINT, range(8)::BIGINT[]), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END) AS c FROM range(256) r(i))),
runs AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]{7,}')) AS run FROM documents),
low AS (SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM runs),
keys AS (SELECT *, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS hx FROM low),
hashed AS (SELECT run, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(length(hx) // 2), lambda j: ('0x' || substr(hx, (2 * j + 1)::BIGINT, 2))::BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295::BIGINT) AS h FROM keys, tab),
words AS MATERIALIZED (SELECT word, count(*) AS n FROM (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word FROM hashed) WHERE length(word) >= 7 GROUP BY 1 HAVING count(*) >= 2),
cut AS MATERIALIZED (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)),
near AS MATERIALIZED (
  SELECT a.word, b.word AS other, b.n AS m FROM cut a JOIN cut b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT c.word, w.word, w.n FROM cut c JOIN words w ON c.rest = w.word
  UNION SELECT w.word, c.word, c.n FROM cut c JOIN words w ON c.rest = w.word),
best AS (SELECT word, count(*) AS n_near, max(m) AS m FROM near GROUP BY word),
pick AS MATERIALIZED (SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.m >= 10 * w.n THEN b.m END AS form_n,
  CASE WHEN b.m >= 10 * w.n THEN (SELECT min(other) FROM near x WHERE x.word = w.word AND x.m = b.m) END AS form FROM words w LEFT JOIN best b USING (word)),
path(word, tip) AS (SELECT word, word FROM pick UNION ALL SELECT p.word, k.form FROM path p JOIN pick k ON k.word = p.tip WHERE k.form IS NOT NULL)
SELECT p.word, p.form, e.tip AS root, p.n, p.n_near, p.form_n FROM pick p JOIN (SELECT path.word, path.tip FROM path JOIN pick k ON k.word = path.tip WHERE k.form IS NULL) e ON e.word = p.word
"""

"""Mixing sources to target weights by Poisson replication, in DataFrame functions only.

Each document gets a uniform number from a hash of its id and the seed; the inverse of the Poisson
distribution with its source's mean repetition rate turns it into a number of copies. A rate above
MAX_RATE is split evenly over several such draws, each with its own hash, which are summed. The
draw of a document depends on nothing but its id, source rate and seed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, partitions

#: Bits of a hash used for a uniform number; a double holds them exactly.
BITS = 52
#: Above this many sources the rates are joined by shuffle, not broadcast (a row is under 1 KB).
BROADCAST_SOURCES = 10_000
#: Higher rates are drawn as sums of draws of at most this rate.
MAX_RATE = 200.0


def uniform(key: Column, seed: int, draw: Column | None = None) -> Column:
    """A double in [0, 1) from the first 52 bits of md5("seed:key"), or md5("seed.draw:key")."""
    head = F.lit(f"{seed}:") if draw is None else F.concat(F.lit(f"{seed}."), draw.cast("string"), F.lit(":"))
    return F.conv(F.substring(F.md5(F.concat(head, key)), 1, BITS // 4), 16, 10).cast("double") / F.lit(float(1 << BITS))


def poisson_cdf(rate: Column) -> Column:
    """P(X <= k) for k = 0.. far enough that the rest is below 2**-53 for rates up to MAX_RATE."""
    top = F.ceil(rate + 12 * F.sqrt(rate) + 30).cast("int")
    terms = F.aggregate(
        F.sequence(F.lit(1), top),
        F.struct(F.exp(-rate).alias("p"), F.array(F.exp(-rate)).alias("cdf")),
        lambda s, k: F.struct((s["p"] * rate / k).alias("p"), F.concat(s["cdf"], F.array(F.element_at(s["cdf"], -1) + s["p"] * rate / k)).alias("cdf")),
    )
    return terms["cdf"]


def source_rates(docs: DataFrame, weights: dict[str, float] | None = None, source_col: str = "source", size: float = 1.0, temperature: float = 0.5) -> DataFrame:
    """Rows (source, n, weight, rate): the mean copies per document that bring each source to its weight.

    ``weights`` names target shares; sources it leaves out get 0, and shares are scaled to sum to 1
    over the sources that are there. Without it a source's share is its row count to the power
    ``temperature``. The mixture has ``size`` times as many rows as ``docs`` in expectation.
    """
    n = docs.groupBy(F.col(source_col).alias("source")).agg(F.count("*").alias("n"))
    if weights is None:
        n = n.withColumn("raw", F.pow(F.col("n").cast("double"), F.lit(temperature)))
    else:
        pick = F.lit(0.0)
        for name, share in sorted(weights.items()):
            pick = F.when(F.col("source") == name, F.lit(float(share))).otherwise(pick)
        n = n.withColumn("raw", pick)
    total = n.agg(F.sum("n").alias("all_n"), F.sum("raw").alias("all_raw"))
    rate = F.lit(size) * F.col("weight") * F.col("all_n") / F.col("n")
    r = n.crossJoin(F.broadcast(total)).withColumn("weight", F.coalesce(F.col("raw") / F.nullif("all_raw", F.lit(0.0)), F.lit(0.0)))
    return r.withColumn("rate", rate).select("source", "n", "weight", "rate")


def mix_sources(docs: DataFrame, weights: dict[str, float] | None = None, id_col: str = "doc_id", source_col: str = "source", size: float = 1.0, temperature: float = 0.5, seed: int = 17) -> DataFrame:
    """The rows of ``docs``, each as often as its Poisson draw says, with copy_no and shuffle_key.

    ``copy_no`` counts a row's copies from 0; ``shuffle_key`` (md5 of seed, id and copy) is the
    global order: partitions are ranges of it and sorted by it. Null ids hash as the text "null",
    null sources are one source. Rows repeated with one id get the same draw. An empty table gives
    an empty one. Columns of ``docs`` named copy_no or shuffle_key are replaced.
    """
    docs = docs.drop("copy_no", "shuffle_key")
    u, cdf, src, draws = (fresh(c, docs.columns) for c in ("__u", "__cdf", "__source", "__draws"))
    rates = source_rates(docs, weights, source_col, size, temperature)
    # a sum of Poisson draws is a Poisson draw of the summed rate
    times = F.greatest(F.ceil(F.col("rate") / MAX_RATE), F.lit(1)).cast("int")
    table = rates.select(F.col("source").alias(src), times.alias(draws), poisson_cdf(F.col("rate") / times).alias(cdf))
    if rates.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES:
        table = F.broadcast(table)
    key = F.coalesce(F.col(id_col).cast("string"), F.lit("null"))
    x = docs.withColumn(u, uniform(key, seed)).join(table, F.col(source_col).eqNullSafe(F.col(src)))
    more = F.aggregate(F.sequence(F.lit(1), F.col(draws) - 1), F.lit(0), lambda n, k: n + F.size(F.filter(cdf, lambda c: c <= uniform(key, seed, k))))
    copies = F.size(F.filter(cdf, lambda c: c <= F.col(u))) + F.when(F.col(draws) > 1, more).otherwise(0)
    x = x.withColumn("copy_no", F.explode(F.when(copies > 0, F.sequence(F.lit(0), copies - 1)).otherwise(F.array().cast("array<int>"))))
    x = x.withColumn("shuffle_key", F.md5(F.concat(F.lit(f"{seed}/"), key, F.lit("/"), F.col("copy_no").cast("string")))).drop(u, cdf, src, draws)
    return x.repartitionByRange(partitions(docs.sparkSession), "shuffle_key").sortWithinPartitions("shuffle_key")


#: DuckDB SQL for the default call on ``documents``: doc_id, source, copy_no, shuffle_key, text_sha256.
ORACLE_SQL = """
WITH RECURSIVE n AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
w AS (SELECT source, n, pow(n::DOUBLE, 0.5) AS raw FROM n),
a AS (SELECT source, 1.0::DOUBLE * (raw / (SELECT sum(raw) FROM w)) * (SELECT sum(n) FROM w)::DOUBLE / n AS rate FROM w),
r AS (SELECT source, greatest(ceil(rate / 200), 1)::BIGINT AS draws, rate / greatest(ceil(rate / 200), 1) AS rate FROM a),
cdf(source, rate, k, p, c) AS (
  SELECT source, rate, 0, exp(-rate), exp(-rate) FROM r
  UNION ALL
  SELECT source, rate, k + 1, p * rate / (k + 1), c + p * rate / (k + 1) FROM cdf WHERE k < ceil(rate + 12 * sqrt(rate) + 30)),
t AS (SELECT r.source, any_value(draws) AS draws, list(c) AS cs FROM r JOIN cdf ON r.source IS NOT DISTINCT FROM cdf.source GROUP BY r.source),
d AS (SELECT row_number() OVER () AS row, doc_id, source, text, coalesce(doc_id::VARCHAR, 'null') AS key FROM documents),
u AS (SELECT row, key, source, cs, unnest(range(draws)) AS draw FROM d JOIN t USING (source) UNION ALL SELECT row, key, d.source, cs, unnest(range(draws)) FROM d, t WHERE d.source IS NULL AND t.source IS NULL),
m AS (SELECT row, sum(len(list_filter(cs, lambda c: c <= ('0x' || substr(md5('17' || CASE WHEN draw > 0 THEN '.' || draw ELSE '' END || ':' || key), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0)))::BIGINT AS copies FROM u GROUP BY row),
x AS (SELECT doc_id, source, text, key, unnest(range(copies)) AS copy_no FROM d JOIN m USING (row))
SELECT doc_id, source, copy_no::INTEGER AS copy_no, md5('17/' || key || '/' || copy_no::VARCHAR) AS shuffle_key, sha256(text) AS text_sha256 FROM x
"""


def query(docs: DataFrame) -> DataFrame:
    return mix_sources(docs).select("doc_id", "source", "copy_no", "shuffle_key", F.sha2("text", 256).alias("text_sha256"))

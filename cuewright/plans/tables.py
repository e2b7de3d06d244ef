"""Domain tables derived from the given tables, and the same as SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cuewright.functions.clock import speech_samples
from cuewright.functions.hashing import hash_split, positional_split


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def plan_turns(spark, d) -> DataFrame:
    c = table(spark, d, "conversations")
    return c.select(
        F.col("conv_id").alias("plan_id"), "turn", "role", "text",
        F.when(F.col("conv_id") % 5 == 0, "en").otherwise("zh").alias("language"),
        speech_samples(F.length("text")).alias("samples"),
        hash_split(F.col("conv_id")).alias("split"),
    )


TURNS_SQL = """turns AS (SELECT conv_id AS plan_id, turn, role, text, CASE WHEN conv_id % 5 = 0 THEN 'en' ELSE 'zh' END AS language,
  greatest(trunc(least(1.2::DOUBLE, greatest(0.32::DOUBLE, length(text) * 0.035::DOUBLE)) * 24000)::BIGINT, 7200) AS samples,
  CASE WHEN b < 8 THEN 'train' WHEN b = 8 THEN 'validation' ELSE 'test' END AS split
  FROM (SELECT *, ('0x' || substr(sha256('{"group":"' || conv_id || '","seed":17}'), 1, 8))::BIGINT % 10 AS b FROM conversations))"""


def source_items(spark, d) -> DataFrame:
    """documents as source items; the split is by position, so sources lie across splits."""
    x = table(spark, d, "documents")
    x = x.crossJoin(F.broadcast(x.agg(F.count("*").alias("n"))))  # one row; the table's ids are positions
    return x.select(
        F.col("doc_id").alias("item_id"), F.col("source").alias("session"), F.col("lang").alias("language"), "text", "n_chars",
        F.element_at(F.array(*map(F.lit, ("public_speech", "adjacent_turns", "screen_task"))), (F.col("doc_id") % 3 + 1).cast("int")).alias("category"),
        (F.col("n_chars") / 15.0).alias("seconds"), positional_split(F.col("doc_id"), F.col("n")).alias("split"),
    )


ITEMS_SQL = """items AS (SELECT doc_id AS item_id, source AS session, lang AS language, text, n_chars,
  CASE doc_id % 3 WHEN 0 THEN 'public_speech' WHEN 1 THEN 'adjacent_turns' ELSE 'screen_task' END AS category, n_chars / 15.0::DOUBLE AS seconds,
  CASE WHEN doc_id < (n * 8) // 10 THEN 'train' WHEN doc_id < (n * 9) // 10 THEN 'validation' ELSE 'test' END AS split
  FROM documents, (SELECT count(*) AS n FROM documents))"""


def units(spark, d) -> DataFrame:
    """events as session units: a unit index, a speech mode and a screen revision."""
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    run = w.rowsBetween(W.unboundedPreceding, W.currentRow)
    e = table(spark, d, "events")
    return e.select(
        F.col("user_id").alias("session_id"), "event_id", "ts", "event_type", "value", "props",
        (F.row_number().over(w) - 1).alias("unit_index"),
        (F.col("event_type") == "purchase").alias("speech"),
        F.sum((F.col("event_type") == "view").cast("int")).over(run).alias("revision"),
    )


UNITS_SQL = """units AS (SELECT user_id AS session_id, event_id, ts, event_type, value, props,
  row_number() OVER w - 1 AS unit_index, event_type = 'purchase' AS speech,
  sum((event_type = 'view')::INT) OVER w AS revision FROM events
  WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))"""


def action_events(spark, d) -> DataFrame:
    """events as actions: view NOOP, click CLICK, signup TYPE, purchase WAIT, other CANCEL."""
    e = table(spark, d, "events")
    v = F.abs(F.col("value"))
    frac = v - F.floor(v)
    kind = F.when(F.col("event_type") == "view", "NOOP").when(F.col("event_type") == "click", "CLICK").when(F.col("event_type") == "signup", "TYPE").when(F.col("event_type") == "purchase", "WAIT").otherwise("CANCEL")
    none = F.lit(None)
    return e.select(
        "event_id", "user_id", "ts", kind.alias("kind"),
        F.when(kind == "CLICK", F.array(frac, 1 - frac)).alias("coordinates"), none.cast("array<double>").alias("scroll"),
        F.when(kind == "WAIT", frac * 10_000).alias("duration_ms"), F.when(kind == "TYPE", F.col("props")).alias("text"), none.cast("array<int>").alias("keys"),
    )


ACTIONS_SQL = """actions AS (SELECT *, CASE event_type WHEN 'view' THEN 'NOOP' WHEN 'click' THEN 'CLICK' WHEN 'signup' THEN 'TYPE' WHEN 'purchase' THEN 'WAIT' ELSE 'CANCEL' END AS kind,
  abs(value) - floor(abs(value)) AS frac FROM events),
tokens AS (SELECT event_id, user_id, ts, kind, CASE kind
  WHEN 'NOOP' THEN [2, 1] WHEN 'CANCEL' THEN [11, 1]
  WHEN 'CLICK' THEN [3, 12 + round_even(frac * 255, 0)::INT, 12 + round_even((1 - frac) * 255, 0)::INT, 1]
  WHEN 'WAIT' THEN [10, 524 + round_even(frac * 10000 / 10000.0::DOUBLE * 127, 0)::INT, 1]
  ELSE list_concat(list_concat([8], list_transform(range(1, strlen(props) + 1), lambda i: 652 + ('0x' || substr(hex(props::BLOB), (2 * i - 1)::BIGINT, 2))::INT)), [1]) END AS tokens, props FROM actions)"""


def rollouts(spark, d) -> DataFrame:
    """lineitem as rollouts: an order is a group, its lines are rollouts with reward parts."""
    x = table(spark, d, "lineitem")
    return x.select(
        F.col("l_orderkey").alias("group_id"), F.col("l_linenumber").alias("rollout_id"), F.col("l_suppkey").alias("update_id"),
        (F.col("l_quantity") / 50.0).alias("task"), F.col("l_discount").alias("speech"), F.col("l_tax").alias("latency"), (F.col("l_discount") + F.col("l_tax")).alias("efficiency"),
        F.when(F.col("l_returnflag") == "R", -0.1).otherwise(0.0).alias("safety"),
        (-F.log(F.col("l_extendedprice")) / 10).alias("current_logprob"), (-F.log(F.col("l_extendedprice") + F.col("l_quantity") * 100) / 10).alias("old_logprob"), (-F.log(F.col("l_extendedprice") + 1000) / 10).alias("reference_logprob"),
        (F.col("l_linestatus") == "O").alias("mask"), F.col("l_returnflag").alias("head_kind"),
    )


ROLLOUTS_SQL = """rollouts AS (SELECT l_orderkey AS group_id, l_linenumber AS rollout_id, l_suppkey AS update_id, l_quantity / 50.0::DOUBLE AS task, l_discount AS speech, l_tax AS latency,
  l_discount + l_tax AS efficiency, CASE WHEN l_returnflag = 'R' THEN -0.1::DOUBLE ELSE 0.0::DOUBLE END AS safety,
  -ln(l_extendedprice) / 10 AS current_logprob, -ln(l_extendedprice + l_quantity * 100) / 10 AS old_logprob, -ln(l_extendedprice + 1000) / 10 AS reference_logprob,
  l_linestatus = 'O' AS mask, l_returnflag AS head_kind FROM lineitem)"""

"""Audit and report queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from cuewright.operators import aggregates, joins
from cuewright.plans.tables import ITEMS_SQL, TURNS_SQL, plan_turns, source_items, table
from cuewright.queries import query


@query("SELECT user_id, ts, count(*) AS n FROM events GROUP BY ALL HAVING count(*) > 1 UNION ALL SELECT source_id, NULL, n FROM (SELECT length(source) AS source_id, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1)")
def a1_duplicate_keys(spark, d):
    a = aggregates.duplicate_keys(table(spark, d, "events"), "user_id", "ts")
    b = aggregates.duplicate_keys(table(spark, d, "documents").select(F.length("source").cast("long").alias("user_id")), "user_id")
    return a.unionByName(b, allowMissingColumns=True)


@query(f"WITH {TURNS_SQL} SELECT role, split, count(*) AS labels, count(*) >= 20 AS enough FROM turns GROUP BY ALL")
def a8_label_counts(spark, d):
    return plan_turns(spark, d).groupBy("role", "split").agg(F.count("*").alias("labels"), (F.count("*") >= 20).alias("enough"))


@query("SELECT source, lang, arg_max(n_chars, doc_id) AS n_chars, max(doc_id) AS doc_id FROM documents GROUP BY ALL")
def a10_license_roll_up(spark, d):
    return aggregates.last_record(table(spark, d, "documents"), ["source", "lang"], "doc_id", ["n_chars", "doc_id"])


@query(f"WITH {TURNS_SQL}, p AS (SELECT plan_id, language, count(*) AS n, count(*) FILTER (trim(text, ' ') = '') AS empty FROM turns GROUP BY ALL) SELECT count(*) AS plans, count(*) FILTER (language = 'zh') AS zh, count(*) FILTER (n > 2) AS long_plans, sum(empty)::BIGINT AS empty_turns, count(*) FILTER (language = 'zh') * 5 = count(*) * 4 AS mix_ok FROM p")
def a11_plan_set(spark, d):
    p = plan_turns(spark, d).groupBy("plan_id", "language").agg(F.count("*").alias("n"), F.count_if(F.trim("text") == "").alias("empty"))
    zh = F.count_if(F.col("language") == "zh")
    return p.agg(F.count("*").alias("plans"), zh.alias("zh"), F.count_if(F.col("n") > 2).alias("long_plans"), F.sum("empty").alias("empty_turns"), (zh * 5 == F.count("*") * 4).alias("mix_ok"))


@query("""WITH p AS (SELECT doc_id, CASE WHEN doc_id % 19 = 4 THEN ' ' WHEN doc_id % 23 = 5 THEN 'plan-' || (doc_id - 1) ELSE 'plan-' || doc_id END AS plan_id, CASE WHEN doc_id % 13 = 2 THEN 'draft' ELSE 'generated' END AS status, doc_id % 7 = 3 AS edited FROM documents),
n AS (SELECT plan_id, count(*) AS n FROM p GROUP BY plan_id)
SELECT doc_id, array_to_string(list_filter([CASE WHEN status <> 'generated' THEN 'status' END, CASE WHEN edited THEN 'stale' END, CASE WHEN trim(plan_id, ' ') = '' THEN 'empty' END, CASE WHEN n > 1 THEN 'repeated' END], lambda x: x IS NOT NULL), ',') AS faults
FROM p JOIN n USING (plan_id) WHERE status <> 'generated' OR edited OR trim(plan_id, ' ') = '' OR n > 1""")
def a11_plan_faults(spark, d):
    """Plans whose recipe was changed after it was hashed, that are drafts, or whose id is empty or not their own."""
    k = F.col("doc_id")
    x = table(spark, d, "documents").select(
        "doc_id", F.when(k % 19 == 4, " ").when(k % 23 == 5, F.concat(F.lit("plan-"), k - 1)).otherwise(F.concat(F.lit("plan-"), k)).alias("plan_id"),
        F.when(k % 13 == 2, "draft").otherwise("generated").alias("status"), "lang", "source", "n_chars",
    )
    x = aggregates.with_recipe(x, ["lang", "source", "n_chars"], "recipe_sha256")
    x = x.withColumn("n_chars", F.when(k % 7 == 3, F.col("n_chars") + 1).otherwise(F.col("n_chars")))
    return aggregates.plan_faults(x, ["lang", "source", "n_chars"]).select("doc_id", F.array_join("faults", ",").alias("faults"))


@query(f"WITH {TURNS_SQL} SELECT language, count(DISTINCT plan_id) AS plans, count(*) FILTER (role = 'assistant') AS replies FROM turns GROUP BY language")
def a12_text_report(spark, d):
    return plan_turns(spark, d).groupBy("language").agg(F.count_distinct("plan_id").alias("plans"), F.count_if(F.col("role") == "assistant").alias("replies"))


@query("SELECT count(*) FILTER (quality = 1 AND toxic = 0) AS accepted, count(*) FILTER (NOT (quality = 1 AND toxic = 0)) AS rejected FROM labels")
def a13_synthesis_report(spark, d):
    ok = (F.col("quality") == 1) & (F.col("toxic") == 0)
    return table(spark, d, "labels").agg(F.count_if(ok).alias("accepted"), F.count_if(~ok).alias("rejected"))


@query(f"WITH {ITEMS_SQL} SELECT split, count(*) AS episodes, sum(n_chars // 80)::BIGINT AS units FROM items GROUP BY split")
def a14_shard_summary(spark, d):
    return source_items(spark, d).groupBy("split").agg(F.count("*").alias("episodes"), F.sum(F.floor(F.col("n_chars") / 80)).alias("units"))


@query("SELECT user_id, count(*) AS units, (epoch_us(max(ts)) - epoch_us(min(ts)))::BIGINT AS duration_us FROM events GROUP BY user_id")
def a15_episode_stats(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("units"), (F.unix_micros(F.max("ts").cast("timestamp")) - F.unix_micros(F.min("ts").cast("timestamp"))).alias("duration_us"))


@query("SELECT source, bool_or(doc_id % 97 = 0) AS old_version, bool_or(lang IS NULL) AS no_identity, count(*) FILTER (doc_id % 97 = 0) AS n_old FROM documents GROUP BY source")
def a16_readiness(spark, d):
    x = table(spark, d, "documents").withColumn("v", F.when(F.col("doc_id") % 97 == 0, 4).otherwise(5))
    return x.groupBy("source").agg(F.bool_or(F.col("v") != 5).alias("old_version"), F.bool_or(F.col("lang").isNull()).alias("no_identity"), F.count_if(F.col("v") != 5).alias("n_old"))


@query(f"WITH {ITEMS_SQL} SELECT category, count(*) AS n, count(*) FILTER (split = 'test') AS held, round(sum(seconds), 4) AS checked_seconds FROM items GROUP BY category")
def a25_audit_counts(spark, d):
    return source_items(spark, d).groupBy("category").agg(F.count("*").alias("n"), F.count_if(F.col("split") == "test").alias("held"), F.round(F.sum("seconds"), 4).alias("checked_seconds"))


@query("SELECT p_brand AS run, count(DISTINCT l_suppkey) AS sources, count(*) AS archives, round(sum(l_quantity) / 60, 4) AS minutes FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1")
def a26_report_roll_up(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("run"))
    return table(spark, d, "lineitem").join(p, "l_partkey").groupBy("run").agg(F.count_distinct("l_suppkey").alias("sources"), F.count("*").alias("archives"), F.round(F.sum("l_quantity") / 60, 4).alias("minutes"))


@query("SELECT d.doc_id, CASE WHEN l.quality <> 1 AND l.toxic <> 0 THEN 'quality,toxic' WHEN l.quality <> 1 THEN 'quality' ELSE 'toxic' END AS mismatched FROM documents d JOIN labels l USING (doc_id) WHERE l.quality <> 1 OR l.toxic <> 0")
def j16_unequal_fields(spark, d):
    want = table(spark, d, "documents").select("doc_id", F.lit(1).alias("quality"), F.lit(0).alias("toxic"))
    return joins.unequal_fields(want, table(spark, d, "labels"), "doc_id", ["quality", "toxic"]).select("doc_id", F.array_join("mismatched", ",").alias("mismatched"))

"""Queries over rollouts, rewards, losses and waveforms."""

from __future__ import annotations

from pyspark.sql import functions as F

from cuewright.functions import audio, scoring
from cuewright.operators import aggregates, joins, layout
from cuewright.plans.tables import ROLLOUTS_SQL, rollouts, table
from cuewright.queries import query

TOTAL_SQL = "task + 0.2::DOUBLE * (0.4::DOUBLE * speech + 0.3::DOUBLE * latency + 0.3::DOUBLE * efficiency) + safety"


def rewarded(spark, d):
    return rollouts(spark, d).withColumn("reward", scoring.reward_total(*(F.col(c) for c in ("task", "speech", "latency", "efficiency", "safety"))))


@query(f"WITH {ROLLOUTS_SQL} SELECT group_id, rollout_id, round({TOTAL_SQL}, 6) AS reward FROM rollouts")
def p24_reward_total(spark, d):
    return rewarded(spark, d).select("group_id", "rollout_id", F.round("reward", 6).alias("reward"))


@query(f"""WITH {ROLLOUTS_SQL}, r AS (SELECT group_id, rollout_id, {TOTAL_SQL} AS reward FROM rollouts), w AS (SELECT *, avg(reward) OVER g AS mu, stddev_pop(reward) OVER g AS sigma, count(*) OVER g AS n FROM r WINDOW g AS (PARTITION BY group_id))
SELECT group_id, rollout_id, sigma > 1e-6 AND n >= 2 AS active, CASE WHEN sigma > 1e-6 AND n >= 2 THEN round((reward - mu) / (sigma + 1e-6), 4) ELSE 0 END AS advantage FROM w""")
def w11_group_advantage(spark, d):
    x = layout.normalised_advantage(rewarded(spark, d), "group_id", "reward")
    return x.select("group_id", "rollout_id", "active", F.round("advantage", 4).alias("advantage"))


OBJECTIVE_SQL = ROLLOUTS_SQL + """, t AS (SELECT *, task - 0.5::DOUBLE AS adv, exp(greatest(-30::DOUBLE, least(30::DOUBLE, current_logprob - old_logprob))) AS r, greatest(-30::DOUBLE, least(30::DOUBLE, reference_logprob - current_logprob)) AS dd FROM rollouts),
o AS (SELECT *, least(r * adv, greatest(0.8::DOUBLE, least(1.2::DOUBLE, r)) * adv) AS obj, exp(dd) - 1 - dd AS kl FROM t)"""


def _objective(spark, d):
    x = rollouts(spark, d)
    return x.withColumn("obj", scoring.clipped_objective(F.col("current_logprob"), F.col("old_logprob"), F.col("task") - 0.5)).withColumn("kl", scoring.sampled_kl(F.col("current_logprob"), F.col("reference_logprob")))


@query(f"WITH {OBJECTIVE_SQL} SELECT update_id, round(-coalesce(sum(obj) FILTER (mask), 0) / greatest(count(*) FILTER (mask), 1), 6) AS policy_loss FROM o GROUP BY update_id")
def a21_clipped_objective(spark, d):
    m = F.col("mask").cast("int")
    return _objective(spark, d).groupBy("update_id").agg(F.round(-F.sum(F.col("obj") * m) / F.greatest(F.sum(m), F.lit(1)), 6).alias("policy_loss"))


@query(f"WITH {OBJECTIVE_SQL} SELECT head_kind, round(coalesce(sum(kl) FILTER (mask), 0) / greatest(count(*) FILTER (mask), 1), 6) AS kl, round((coalesce(sum(0.1::DOUBLE * kl - obj) FILTER (mask), 0)) / greatest(count(*) FILTER (mask), 1), 6) AS loss FROM o GROUP BY head_kind")
def a22_reference_kl(spark, d):
    m, n = F.col("mask").cast("int"), F.greatest(F.sum(F.col("mask").cast("int")), F.lit(1))
    return _objective(spark, d).groupBy("head_kind").agg(F.round(F.sum(F.col("kl") * m) / n, 6).alias("kl"), F.round(F.sum((0.1 * F.col("kl") - F.col("obj")) * m) / n, 6).alias("loss"))


@query(f"WITH {ROLLOUTS_SQL}, g AS (SELECT group_id, min(update_id) AS update_id, avg({TOTAL_SQL}) AS m, stddev_pop({TOTAL_SQL}) AS s, count(*) AS n FROM rollouts GROUP BY group_id) SELECT update_id, round(sum(m * n) / sum(n), 9) AS mean_reward, count(*) AS groups, count(*) FILTER (s <= 1e-6) AS skipped FROM g GROUP BY update_id")
def a23_reward_summary(spark, d):
    g = rewarded(spark, d).groupBy("group_id").agg(F.min("update_id").alias("update_id"), F.avg("reward").alias("m"), F.stddev_pop("reward").alias("s"), F.count("*").alias("n"))
    return g.groupBy("update_id").agg(F.round(F.sum(F.col("m") * F.col("n")) / F.sum("n"), 9).alias("mean_reward"), F.count("*").alias("groups"), F.count_if(F.col("s") <= 1e-6).alias("skipped"))


@query("SELECT l_linenumber AS head, count(*) FILTER (l_linestatus = 'O' AND l_returnflag = 'N') AS hits, count(*) FILTER (l_linestatus = 'O') AS total, count(*) FILTER (l_linestatus = 'O' AND l_returnflag = 'N') / greatest(count(*) FILTER (l_linestatus = 'O'), 1)::DOUBLE AS accuracy FROM lineitem GROUP BY 1")
def a17_masked_accuracy(spark, d):
    x = table(spark, d, "lineitem").withColumn("head", F.col("l_linenumber"))
    return aggregates.masked_accuracy(x, F.col("l_returnflag") == "N", F.col("l_linestatus") == "O", "head")


@query("SELECT k AS codebook, sum((q % 7 = p % 7 AND m)::INT)::BIGINT AS hits, sum(m::INT)::BIGINT AS total, sum((q % 7 = p % 7 AND m)::INT) / greatest(sum(m::INT), 1)::DOUBLE AS accuracy FROM (SELECT unnest([0, 1, 2]) AS k, unnest([l_partkey, l_suppkey, l_linenumber]) AS q, unnest([l_suppkey, l_linenumber, l_partkey]) AS p, unnest([true, l_linestatus = 'O', l_returnflag = 'N']) AS m FROM lineitem) GROUP BY k")
def a17_codebook_accuracy(spark, d):
    x = table(spark, d, "lineitem")
    mod = lambda *c: F.array(*(F.col(i).cast("long") % 7 for i in c))
    x = x.select(mod("l_suppkey", "l_linenumber", "l_partkey").alias("pred"), mod("l_partkey", "l_suppkey", "l_linenumber").alias("want"), F.array(F.lit(True), F.col("l_linestatus") == "O", F.col("l_returnflag") == "N").alias("ok"))
    return aggregates.codebook_accuracy(x, "pred", "want", "ok")


@query("SELECT count(*) FILTER (l_returnflag = 'N' AND l_linestatus = 'O') / greatest(count(*) FILTER (l_returnflag = 'N'), 1)::DOUBLE AS precision, count(*) FILTER (l_returnflag = 'N' AND l_linestatus = 'O') / greatest(count(*) FILTER (l_linestatus = 'O'), 1)::DOUBLE AS recall FROM lineitem")
def a18_precision_recall(spark, d):
    return aggregates.precision_recall(table(spark, d, "lineitem"), F.col("l_returnflag") == "N", F.col("l_linestatus") == "O")


@query("SELECT l_suppkey AS update_id, round(sum(l_extendedprice) / sum(l_quantity), 4) AS loss, round(CASE WHEN sum(l_discount) = 0 THEN 'nan'::DOUBLE ELSE sum(l_tax) / sum(l_discount) END, 4) AS codec FROM lineitem GROUP BY 1")
def a19_ratio_of_sums(spark, d):
    x = aggregates.ratio_of_sums(table(spark, d, "lineitem").withColumnRenamed("l_suppkey", "update_id"), "update_id", {"loss": ("l_extendedprice", "l_quantity"), "codec": ("l_tax", "l_discount")}, {"codec"})
    return x.select("update_id", F.round("loss", 4).alias("loss"), F.round("codec", 4).alias("codec"))


@query("WITH a AS (SELECT l_linenumber, count(*) FILTER (l_returnflag = 'N') / count(*)::DOUBLE AS acc FROM lineitem GROUP BY 1) SELECT coalesce(min(acc), 0.0) AS worst, coalesce(min(acc), 0.0) >= 0.45 AS passed FROM a")
def a20_quality_gate(spark, d):
    x = aggregates.masked_accuracy(table(spark, d, "lineitem"), F.col("l_returnflag") == "N", F.lit(True), "l_linenumber")
    worst = F.coalesce(F.min("accuracy"), F.lit(0.0))
    return x.agg(worst.alias("worst"), (worst >= 0.45).alias("passed"))


@query("SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean_ms, round(quantile_cont(value, 0.95), 6) AS p95_ms, round(max(value), 6) AS max_ms FROM events GROUP BY event_type")
def a24_latency_report(spark, d):
    x = aggregates.latency(table(spark, d, "events"), "value", "event_type")
    return x.select("event_type", "n", *(F.round(c, 6).alias(c) for c in ("mean_ms", "p95_ms", "max_ms")))


@query("WITH r AS (SELECT event_type, quantile_cont(value, 0.95) AS p, max(value) AS m FROM events GROUP BY 1) SELECT event_type, p < 80 AS in_time, m < 7.5 * 1024 AS in_memory, p < 80 AND m < 7.5 * 1024 AS passed FROM r")
def a29_pass_flags(spark, d):
    x = aggregates.latency(table(spark, d, "events"), "value", "event_type")
    a, b = F.col("p95_ms") < 80, F.col("max_ms") < 7.5 * 1024
    return x.select("event_type", a.alias("in_time"), b.alias("in_memory"), (a & b).alias("passed"))


@query("SELECT sum(l_quantity) / (SELECT sum(o_orderkey % 50) FROM orders)::DOUBLE AS epochs FROM lineitem")
def a28_epoch_estimate(spark, d):
    used = table(spark, d, "lineitem").agg(F.sum("l_quantity").alias("used"))
    return used.crossJoin(table(spark, d, "orders").agg(F.sum(F.col("o_orderkey") % 50).alias("have"))).select((F.col("used") / F.col("have")).alias("epochs"))


WAVE_SQL = "w AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings)"


@query(f"""WITH {WAVE_SQL}, m AS (SELECT vec_id, len(v) AS samples, list_max(list_transform(v, lambda x: abs(x))) AS p, list_sum(list_transform(v, lambda x: x * x)) / len(v) AS ms, len(list_filter(v, lambda x: abs(x) >= 0.3::DOUBLE)) / len(v)::DOUBLE AS clip FROM w)
SELECT vec_id, samples::INT AS samples, round(20 * log10(greatest(p, 1e-12)), 4) AS peak_dbfs, round(20 * log10(greatest(sqrt(ms), 1e-12)), 4) AS rms_dbfs, clip FROM m""")
def p28_audio_metrics(spark, d):
    w = F.col("embedding")
    return table(spark, d, "embeddings").select("vec_id", F.size(w).alias("samples"), F.round(audio.dbfs(audio.peak(w)), 4).alias("peak_dbfs"), F.round(audio.dbfs(F.sqrt(audio.mean_square(w))), 4).alias("rms_dbfs"), audio.clipping(w, 0.3).alias("clip"))


@query(f"""WITH {WAVE_SQL}, m AS (SELECT vec_id, list_max(list_transform(v, lambda x: abs(x))) AS p, sqrt(list_sum(list_transform(v, lambda x: x * x)) / len(v)) AS r FROM w)
SELECT vec_id, round(least(10 ** (-23.0::DOUBLE / 20) / r, 10 ** (-1.0::DOUBLE / 20) / p), 6) AS gain FROM m""")
def p26_normalisation_gain(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.round(audio.gain_to(F.col("embedding")), 6).alias("gain"))


@query(f"""WITH {WAVE_SQL}, c AS (SELECT vec_id, CASE vec_id % 3 WHEN 0 THEN 16000 WHEN 1 THEN 48000 ELSE 24000 END AS rate, CASE WHEN vec_id % 10 = 3 THEN list_transform(v, lambda x: 0.0::DOUBLE) WHEN vec_id % 4 = 0 THEN list_transform(range(len(v) // 2), lambda i: (v[2 * i + 1] + v[2 * i + 2]) / 2) ELSE v END AS m FROM w),
r AS (SELECT vec_id, m, rate, round_even(len(m) * 24000 / rate::DOUBLE, 0)::BIGINT AS n FROM c),
i AS (SELECT vec_id, list_transform(range(least(n, 80)), lambda t: m[least(t * rate // 24000, len(m) - 1) + 1] + (t * rate / 24000::DOUBLE - t * rate // 24000) * (m[least(t * rate // 24000 + 1, len(m) - 1) + 1] - m[least(t * rate // 24000, len(m) - 1) + 1])) AS x FROM r),
g AS (SELECT vec_id, x, sqrt(list_sum(list_transform(x, lambda a: a * a)) / len(x)) AS level, list_max(list_transform(x, lambda a: abs(a))) AS top FROM i)
SELECT vec_id, CASE WHEN level > 1e-7 THEN len(x)::DOUBLE END AS samples, CASE WHEN level > 1e-7 THEN round(list_sum(x) * least(10 ** (-23.0::DOUBLE / 20) / level, 10 ** (-1.0::DOUBLE / 20) / top), 5) END AS total,
CASE WHEN level > 1e-7 THEN round(top * least(10 ** (-23.0::DOUBLE / 20) / level, 10 ** (-1.0::DOUBLE / 20) / top), 5) END AS peak, CASE WHEN level <= 1e-7 THEN 'silent' END AS reason FROM g""")
def p26_normalised_audio(spark, d):
    """Vectors as waves at three rates, some in two channels, some silent, cut to 80 samples."""
    k = F.col("vec_id")
    x = table(spark, d, "embeddings").select("vec_id", F.when(k % 10 == 3, F.transform("embedding", lambda v: v * 0)).otherwise(F.col("embedding")).alias("wave"), F.when(k % 3 == 0, 16_000).when(k % 3 == 1, 48_000).otherwise(24_000).alias("rate"), F.when((k % 4 == 0) & (k % 10 != 3), 2).otherwise(1).alias("channels"))
    good, bad = audio.normalise(x, "wave", "rate", "channels", seconds=80 / 24_000, kind="double")
    w = F.col("normal")
    good = good.select("vec_id", F.size(w).cast("double").alias("samples"), F.round(F.aggregate(w, F.lit(0.0), lambda a, b: a + b), 5).alias("total"), F.round(audio.peak(w), 5).alias("peak"), F.lit(None).cast("string").alias("reason"))
    none = F.lit(None).cast("double")
    return good.unionByName(bad.select("vec_id", none.alias("samples"), none.alias("total"), none.alias("peak"), "reason"))


@query(f"""WITH {WAVE_SQL}, a AS (SELECT vec_id, list_max(list_transform(v, lambda x: abs(x))) AS p FROM w) SELECT a.vec_id, round(least(1.0::DOUBLE, 0.3::DOUBLE / greatest(a.p, b.p)), 6) AS factor FROM a JOIN a b ON b.vec_id = a.vec_id + 1""")
def p27_joint_peak(spark, d):
    x = table(spark, d, "embeddings").select("vec_id", audio.peak(F.col("embedding")).alias("p"))
    y = x.select((F.col("vec_id") - 1).alias("vec_id"), F.col("p").alias("q"))
    return x.join(y, "vec_id").select("vec_id", F.round(F.least(F.lit(1.0), 0.3 / F.greatest("p", "q")), 6).alias("factor"))


@query(f"WITH {WAVE_SQL}, m AS (SELECT vec_id, list_max(list_transform(v, lambda x: abs(x))) AS p, len(v) AS n FROM w) SELECT vec_id, array_to_string(list_filter([CASE WHEN p > 0.35::DOUBLE THEN 'peak' END, CASE WHEN vec_id % 7 = 0 THEN 'length' END], lambda x: x IS NOT NULL), ',') AS failed FROM m")
def p29_audio_gates(spark, d):
    from cuewright.functions.checks import failed

    x = table(spark, d, "embeddings")
    n = F.size("embedding") + F.when(F.col("vec_id") % 7 == 0, 1).otherwise(0)
    return x.select("vec_id", F.array_join(failed(peak=audio.peak(F.col("embedding")) <= 0.35, length=n % 16 == 0), ",").alias("failed"))


@query(f"WITH {WAVE_SQL}, f AS (SELECT vec_id, unnest(range(4)) AS k, v FROM w) SELECT vec_id, sum((list_sum(list_transform(v[k * 16 + 1:k * 16 + 16], lambda x: x * x)) / 16 > 0.015::DOUBLE)::INT)::BIGINT AS active FROM f GROUP BY vec_id")
def p30_frame_activity(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.size(F.filter(audio.frame_active(F.col("embedding"), 16, 0.015), lambda a: a)).cast("long").alias("active"))


@query(f"""WITH {WAVE_SQL}, n AS (SELECT label, vec_id, v AS a, lead(v) OVER (PARTITION BY label ORDER BY vec_id) AS b FROM w),
s AS (SELECT label, vec_id, abs(b[1] - a[64]) AS j, list_concat(list_transform(range(1, 64), lambda i: abs(a[i + 1] - a[i])), list_transform(range(1, 64), lambda i: abs(b[i + 1] - b[i]))) AS d FROM n WHERE b IS NOT NULL)
SELECT label, vec_id, round(20 * log10(greatest(j, 1e-8) / greatest(list_aggregate(d, 'quantile_cont', 0.95), 1e-8)), 4) AS jump_db FROM s""")
def w13_boundary_jump(spark, d):
    x = layout.boundary_jump(table(spark, d, "embeddings"), "label", "vec_id", "embedding")
    return x.select("label", "vec_id", F.round("jump_db", 4).alias("jump_db"))


@query("""WITH x AS (SELECT conv_id, turn, regexp_replace(text, '[^一-鿿A-Za-z0-9]', '', 'g') AS a, regexp_replace(replace(text, 'e', 'a'), '[^一-鿿A-Za-z0-9]', '', 'g') AS b FROM conversations)
SELECT conv_id, turn, round(least(1.0::DOUBLE, levenshtein(a, b) / greatest(length(a), 1)::DOUBLE), 6) AS cer FROM x""")
def p25_character_errors(spark, d):
    """Whole turns as utterances; what is heard has each e for an a."""
    a = F.col("text")
    return table(spark, d, "conversations").select("conv_id", "turn", F.round(scoring.cer(a, F.replace(a, F.lit("e"), F.lit("a"))), 6).alias("cer"))


@query("""WITH x AS (SELECT conv_id, turn, regexp_extract_all(lower(text), '[a-z0-9'']+') AS w FROM conversations)
SELECT conv_id, turn, round(least(1.0::DOUBLE, len(list_filter(w, lambda y: y = 'the')) / greatest(len(w), 1)::DOUBLE), 6) AS wer FROM x""")
def p25_word_errors(spark, d):
    """Whole turns; what is heard has lost every ``the``, so each one is an error."""
    heard = F.regexp_replace(F.lower("text"), r"(?<![a-z0-9'])the(?![a-z0-9'])", " ")
    return table(spark, d, "conversations").select("conv_id", "turn", F.round(scoring.wer(F.col("text"), heard), 6).alias("wer"))


@query("WITH s AS (SELECT l_shipdate::DATE::VARCHAR AS metric, l_discount AS score FROM lineitem WHERE l_orderkey % 2 = 0), m(metric) AS (VALUES ('R'), ('N'), ('Z')), h AS (SELECT l_returnflag AS metric, count(*) AS n, avg(l_discount) AS mean, max(l_discount) AS worst FROM lineitem GROUP BY 1) SELECT metric, coalesce(n, 0) AS n, round(coalesce(mean, 1.0), 6) AS mean, coalesce(worst, 1.0) AS worst, coalesce(worst, 1.0) <= 0.2 AND coalesce(mean, 1.0) <= 0.08 AS passed FROM m LEFT JOIN h USING (metric)")
def a9_score_gate(spark, d):
    x = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("metric"), F.col("l_discount").alias("score"))
    return aggregates.score_gate(x, "metric", "score", ["R", "N", "Z"]).withColumn("mean", F.round("mean", 6))


@query("SELECT o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderkey % 4 = 0 AND c_custkey % 2 = 0")
def j15_lineage_breaks(spark, d):
    """Orders as later stages, customers as their parents; every second parent of some is of a wrong stage."""
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    kids = o.select(F.concat(F.lit("o"), "o_orderkey").alias("sha256"), F.concat(F.lit("c"), "o_custkey", F.when(F.col("o_orderkey") % 4 == 0, "x").otherwise("")).alias("parent_sha256"), F.lit("second").alias("stage"), "o_orderkey")
    first = c.select(F.concat(F.lit("c"), "c_custkey").alias("sha256"), F.lit(None).cast("string").alias("parent_sha256"), F.lit("first").alias("stage"), F.lit(None).cast("long").alias("o_orderkey"))
    odd = first.select(F.concat("sha256", F.lit("x")).alias("sha256"), "parent_sha256", F.when(F.expr("cast(substring(sha256, 2) as long) % 2 = 0"), "third").otherwise("first").alias("stage"), "o_orderkey")
    x = joins.lineage_breaks(kids.unionByName(first).unionByName(odd), {"second": "first"})
    return x.where("stage = 'second'").select("o_orderkey")

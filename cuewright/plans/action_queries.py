"""Queries over actions, controls, session units and clocks."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cuewright.functions import actions
from cuewright.operators import aggregates, layout
from cuewright.plans.tables import ACTIONS_SQL, UNITS_SQL, action_events, table, units
from cuewright.queries import query
from cuewright.streaming import sessions

COLS = ["kind", "coordinates", "scroll", "duration_ms", "text", "keys"]


def tokens(spark, d):
    e = action_events(spark, d)
    return e.select("event_id", "user_id", "ts", "kind", "text", actions.encode(*(F.col(c) for c in COLS)).alias("tokens"))


def _text(c):
    return F.array_join(F.transform(c, lambda t: t.cast("string")), " ")


@query(f"WITH {ACTIONS_SQL} SELECT event_id, array_to_string(tokens, ' ') AS tokens FROM tokens")
def p17_action_tokens(spark, d):
    return tokens(spark, d).select("event_id", _text(F.col("tokens")).alias("tokens"))


@query(f"""WITH {ACTIONS_SQL} SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE kind END AS kind, CASE WHEN event_id % 5 <> 0 AND kind = 'TYPE' THEN props END AS text,
  CASE WHEN event_id % 5 <> 0 AND kind = 'WAIT' THEN round((tokens[2] - 524) / 127.0::DOUBLE * 10000, 6) END AS duration_ms, CASE WHEN event_id % 5 = 0 THEN 'no end' END AS error FROM tokens""")
def p18_decode_tokens(spark, d):
    x = tokens(spark, d)
    x = x.withColumn("t", F.when(F.col("event_id") % 5 == 0, F.slice("tokens", F.lit(1), F.size("tokens") - 1)).otherwise(F.col("tokens")))
    x = x.withColumn("a", actions.decode(F.col("t")))
    return x.select("event_id", "a.kind", "a.text", F.round("a.duration_ms", 6).alias("duration_ms"), actions.grammar_error(F.col("t")).alias("error"))


@query(f"WITH {ACTIONS_SQL}, b AS (SELECT event_id, tokens, unnest(range((len(tokens) - 1) // 16 + 1)) AS burst FROM tokens) SELECT event_id, burst::INT AS burst, array_to_string(tokens[burst * 16 + 1:burst * 16 + 16], ' ') AS tokens FROM b")
def p19_bursts(spark, d):
    x = tokens(spark, d).select("event_id", F.posexplode(actions.bursts(F.col("tokens"))).alias("burst", "t"))
    return x.select("event_id", "burst", _text(F.col("t")).alias("tokens"))


@query(f"""WITH {ACTIONS_SQL} SELECT event_id, CASE kind WHEN 'CLICK' THEN 'POINTER_BUTTON' WHEN 'TYPE' THEN 'TEXT_INPUT' ELSE kind END AS control,
  CASE WHEN kind = 'CLICK' THEN round((tokens[2] - 12) / 255.0::DOUBLE, 6) END AS x, CASE WHEN kind = 'CLICK' THEN round((tokens[3] - 12) / 255.0::DOUBLE, 6) END AS y,
  CASE WHEN kind = 'WAIT' THEN round_even((tokens[2] - 524) / 127.0::DOUBLE * 10000, 0)::DOUBLE END AS duration_ms, CASE WHEN kind = 'TYPE' THEN props END AS text FROM tokens""")
def p20_controls(spark, d):
    x = tokens(spark, d).select(F.col("event_id").alias("e"), F.explode(actions.controls(F.col("tokens"), F.col("event_id").cast("string"))).alias("c"))
    return x.select(F.col("e").alias("event_id"), "c.control", F.round("c.x", 6).alias("x"), F.round("c.y", 6).alias("y"), F.col("c.duration_ms").cast("double").alias("duration_ms"), "c.text")


@query(f"""WITH {ACTIONS_SQL}, k AS (SELECT *, count(*) OVER (PARTITION BY user_id, event_id // 3) AS n FROM tokens) SELECT event_id, CASE WHEN n > 1 THEN 'two actions in a tick' WHEN len(tokens) > 16 THEN 'too long' END AS reason FROM k WHERE n > 1 OR len(tokens) > 16""")
def p21_expert_import(spark, d):
    x = tokens(spark, d).withColumn("tick", F.floor(F.col("event_id") / 3))
    twice = aggregates.duplicate_keys(x, "user_id", "tick").select("user_id", "tick", F.lit(True).alias("twice"))
    why = F.when(F.col("twice"), "two actions in a tick").when(F.size("tokens") > actions.BURST, "too long")
    return x.join(twice, ["user_id", "tick"], "left").select("event_id", why.alias("reason")).where("reason is not null")


@query("""SELECT event_id, CASE WHEN abs(value) > 100 THEN 'coordinates out of range' END AS reason FROM events WHERE event_type = 'click' AND abs(value) > 100""")
def p22_control_ranges(spark, d):
    e = table(spark, d, "events").where("event_type = 'click'")
    none = F.lit(None)
    why = actions.reject_reason(F.lit("CLICK"), F.array(F.abs("value") / 100, F.lit(0.5)), none.cast("array<double>"), none.cast("double"), none.cast("string"), none.cast("array<int>"), 10_000.0)
    return e.select("event_id", why.alias("reason")).where("reason is not null")


@query("""SELECT event_id, CASE WHEN user_id % 4 = 1 THEN 'stale revision' WHEN event_type = 'purchase' AND abs(value) * 200 > 10000 THEN 'duration over limit' WHEN event_type = 'error' AND event_id % 2 = 0 THEN 'approval required' WHEN event_type = 'signup' AND event_id % 3 = 0 THEN 'text missing' END AS violation FROM events""")
def p23_safety_gate(spark, d):
    e = table(spark, d, "events")
    kind = F.when(F.col("event_type") == "purchase", "WAIT").when(F.col("event_type") == "error", "CANCEL").when(F.col("event_type") == "signup", "TEXT_INPUT").otherwise("NOOP")
    text = F.when(F.col("event_id") % 3 != 0, F.col("props"))
    v = actions.safety_violation(F.col("user_id") % 4, F.when(F.col("user_id") % 4 == 1, 0).otherwise(F.col("user_id") % 4), F.when(kind == "WAIT", F.abs("value") * 200), kind, F.col("event_id") % 2 == 1, text, F.lit(None).cast("int"), ("CANCEL",))
    return e.select("event_id", v.alias("violation"))


@query(f"""WITH {UNITS_SQL}, x AS (SELECT event_id, hour, lag(hour) OVER (PARTITION BY session_id ORDER BY event_id) AS p FROM (SELECT *, date_trunc('hour', ts) AS hour FROM units)) SELECT event_id FROM x WHERE hour <= p""")
def w4_increasing_time(spark, d):
    """Units whose hour is not later than that of the unit before."""
    x = units(spark, d).withColumn("hour", F.date_trunc("hour", "ts"))
    return layout.not_increasing(x, "session_id", ["event_id"], "hour").select("event_id")


@query(f"WITH {UNITS_SQL} SELECT event_id, revision::BIGINT AS revision, CASE WHEN event_type = 'view' THEN revision - 1 ELSE -1 END::BIGINT AS screen_index FROM units")
def w5_sparse_index(spark, d):
    x = units(spark, d).drop("revision").withColumn("valid", F.col("event_type") == "view")
    return layout.sparse_index(x, "session_id", ["unit_index"], "valid").select("event_id", "revision", F.col("screen_index").cast("long").alias("screen_index"))


@query(f"""WITH {UNITS_SQL}, x AS (SELECT *, lag(speech) OVER (PARTITION BY session_id ORDER BY unit_index) AS p FROM units),
y AS (SELECT *, sum((p IS NULL OR p <> speech)::INT) OVER (PARTITION BY session_id ORDER BY unit_index ROWS UNBOUNDED PRECEDING) AS run FROM x)
SELECT session_id, run::BIGINT AS run, speech, count(*) AS units, count(*) FILTER (speech AND NOT coalesce(p, false)) AS resets FROM y GROUP BY ALL""")
def w10_mode_runs(spark, d):
    x = layout.mode_runs(units(spark, d), "session_id", ["unit_index"], "speech")
    return x.groupBy("session_id", "run", "speech").agg(F.count("*").alias("units"), F.count_if("reset").alias("resets"))


@query(f"""WITH {ACTIONS_SQL}, t AS (SELECT user_id, event_id, unnest(tokens) AS tok, generate_subscripts(tokens, 1) AS pos FROM tokens),
f AS (SELECT * FROM t WHERE NOT (user_id % 3 = 0 AND tok = 1 AND event_id = (SELECT max(event_id) FROM events e WHERE e.user_id = t.user_id))),
e AS (SELECT *, coalesce(sum((tok = 1)::INT) OVER (PARTITION BY user_id ORDER BY event_id, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ev FROM f)
SELECT user_id, ev::BIGINT AS event, array_to_string(list(tok ORDER BY event_id, pos), ' ') AS tokens FROM e GROUP BY user_id, ev HAVING list_contains(list(tok), 1)""")
def w12_burst_assembly(spark, d):
    t = tokens(spark, d)
    last = F.max("event_id").over(W.partitionBy("user_id"))
    x = t.withColumn("last", last).select("user_id", "event_id", "last", F.posexplode("tokens").alias("pos", "tok"))
    x = x.where(~((F.col("user_id") % 3 == 0) & (F.col("tok") == 1) & (F.col("event_id") == F.col("last"))))
    x = layout.assemble_bursts(x, "user_id", ["event_id", "pos"], "tok")
    return x.select("user_id", "event", _text(F.col("tokens")).alias("tokens"))


@query(f"""WITH {UNITS_SQL}, x AS (SELECT session_id, unit_index // 8 AS sample, unit_index % 8 AS unit FROM units), y AS (SELECT *, lead(unit) OVER (PARTITION BY session_id, sample ORDER BY unit) AS nx FROM x)
SELECT session_id, sample, unit, CASE WHEN nx IS NULL THEN sample + 1 ELSE sample END AS next_sample, coalesce(nx, 0) AS next_unit FROM y""")
def w15_next_cursor(spark, d):
    x = units(spark, d).select("session_id", F.floor(F.col("unit_index") / 8).alias("sample"), (F.col("unit_index") % 8).alias("unit"))
    x = layout.next_cursor(x, "session_id", "sample", "unit")
    return x.select("session_id", "sample", F.col("unit").cast("long").alias("unit"), "next_sample", F.col("next_unit").cast("long").alias("next_unit"))


@query(f"WITH {UNITS_SQL} SELECT session_id, unit_index // 20 AS chunk, count(*) AS units FROM units GROUP BY ALL")
def p35_memory_chunks(spark, d):
    return units(spark, d).groupBy("session_id", F.floor(F.col("unit_index") / 20).alias("chunk")).agg(F.count("*").alias("units"))


@query("""WITH t AS (SELECT p_name AS task, row_number() OVER (ORDER BY p_name, p_partkey) - 1 AS at, count(*) OVER () AS n FROM part WHERE p_partkey % 5 = 0)
SELECT event_id, task, 7 + (event_id // 10) * 1000 + event_id % 10 AS seed FROM events JOIN t ON t.at = ((event_id // 10) * 10 + event_id % 10) % t.n""")
def p36_task_assignment(spark, d):
    """Ten groups an update; tasks go round, in the order of their names."""
    tasks = table(spark, d, "part").where("p_partkey % 5 = 0").select(F.col("p_name").alias("task"), "p_partkey")
    x = table(spark, d, "events").select("event_id", F.floor(F.col("event_id") / 10).alias("update"), (F.col("event_id") % 10).alias("group"))
    return layout.assign_tasks(x, tasks, ["task", "p_partkey"], "update", "group", 10, 7).select("event_id", "task", "seed")


@query(f"""WITH {UNITS_SQL} SELECT event_id, array_to_string(list_filter([CASE WHEN NOT value > 0 OR value IS NULL THEN 'delta' END, CASE WHEN revision < 1 THEN 'revision' END, CASE WHEN coalesce(props, '') = '' THEN 'props' END], lambda x: x IS NOT NULL), ',') AS failed FROM units""")
def p37_observation_checks(spark, d):
    from cuewright.functions.checks import failed

    u = units(spark, d)
    return u.select("event_id", F.array_join(failed(delta=F.col("value") > 0, revision=F.col("revision") >= 1, props=F.coalesce("props", F.lit("")) != ""), ",").alias("failed"))


@query("""SELECT event_id, array_to_string(list_filter([CASE WHEN event_id % 3 = 0 THEN 'protocol' END, CASE WHEN event_id % 5 = 0 THEN 'environment' END], lambda x: x IS NOT NULL), ',') AS mismatched FROM events WHERE event_id % 3 = 0 OR event_id % 5 = 0""")
def p42_identity(spark, d):
    from cuewright.functions.checks import identity_mismatch

    e = table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 3 != 0, "p1").alias("protocol"), F.when(F.col("event_id") % 5 == 0, "old").otherwise("e1").alias("environment"))
    return e.select("event_id", F.array_join(identity_mismatch(e, {"protocol": "p1", "environment": "e1"}), ",").alias("mismatched")).where("mismatched <> ''")


@query(f"""WITH {UNITS_SQL}, x AS (SELECT event_id, unnest([{{'head': 'mode', 'valid': true}}, {{'head': 'codec', 'valid': speech}}, {{'head': 'action', 'valid': event_type <> 'error'}}]) AS t, value FROM units)
SELECT event_id, t.head AS head_kind, t.valid AS mask, CASE WHEN t.valid THEN round(value, 6) ELSE 0 END AS logprob FROM x""")
def p43_head_tokens(spark, d):
    one = lambda head, ok: F.struct(F.lit(head).alias("head_kind"), ok.alias("mask"))
    x = units(spark, d).select("event_id", "value", F.explode(F.array(one("mode", F.lit(True)), one("codec", F.col("speech")), one("action", F.col("event_type") != "error"))).alias("t"))
    return x.select("event_id", "t.head_kind", "t.mask", F.when(F.col("t.mask"), F.round("value", 6)).otherwise(0.0).alias("logprob"))


@query("SELECT date_trunc('hour', ts) AS tick, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def st4_clock_buckets(spark, d):
    x = table(spark, d, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return x.select(F.col("w.start").alias("tick"), "event_type", "n", "total")


@query(f"WITH {UNITS_SQL} SELECT event_id, unit_index AS next_index, true AS accepted FROM units")
def st1_ordered_gate(spark, d):
    """All units are in order, so the gate must accept each one."""
    u = units(spark, d).select("session_id", "unit_index", "revision", "event_id")
    x = sessions.gate_batch(u)
    return x.select("event_id", F.col("unit_index").alias("next_index"), "accepted")


@query(f"""WITH RECURSIVE {UNITS_SQL}, u AS (SELECT session_id, event_id, revision, unit_index + (event_id % 9 = 0)::INT AS unit_index, row_number() OVER (PARTITION BY session_id ORDER BY event_id) AS k FROM units),
r(session_id, k, want, rev) AS (SELECT DISTINCT session_id, 0::BIGINT, 0::BIGINT, 0::BIGINT FROM u
  UNION ALL SELECT r.session_id, u.k, CASE WHEN unit_index = want AND revision >= rev THEN want + 1 ELSE want END, CASE WHEN unit_index = want AND revision >= rev THEN revision ELSE rev END::BIGINT FROM r JOIN u ON u.session_id = r.session_id AND u.k = r.k + 1)
SELECT u.session_id, unit_index::BIGINT AS unit_index, revision::BIGINT AS revision, event_id, unit_index = want AND revision >= rev AS accepted FROM u JOIN r ON r.session_id = u.session_id AND r.k = u.k - 1""")
def st1_ordered_gate_rejects(spark, d):
    """Every ninth event has lost its place: what follows it is refused until the place comes."""
    u = units(spark, d).select("session_id", "unit_index", "revision", "event_id").withColumn("unit_index", F.when(F.col("event_id") % 9 == 0, F.col("unit_index") + 1).otherwise(F.col("unit_index")))
    return sessions.gate_batch(u)


@query("""WITH r AS (SELECT l_orderkey AS group_id, l_linenumber AS rollout_id, l_quantity / 50.0::DOUBLE AS task FROM lineitem WHERE l_returnflag <> 'R' AND l_discount > 0),
g AS (SELECT *, count(*) OVER w AS n, avg(task) OVER w AS mu, stddev_pop(task) OVER w AS sd FROM r WINDOW w AS (PARTITION BY group_id))
SELECT group_id, rollout_id, n::BIGINT AS group_size, round(CASE WHEN n >= 2 AND sd > 1e-6 THEN (task - mu) / (sd + 1e-6) ELSE 0 END, 4) AS advantage FROM g""")
def st7_complete_rollouts(spark, d):
    """Rollouts with a refused unit (no discount, or returned) are left out, not scored low; the others' advantages."""
    x = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("group_id"), F.col("l_linenumber").alias("rollout_id"), (F.col("l_quantity") / 50.0).alias("task"), ((F.col("l_returnflag") != "R") & (F.col("l_discount") > 0)).alias("complete"))
    x = layout.normalised_advantage(x.where("complete"), "group_id", "task")
    return x.select("group_id", "rollout_id", "group_size", F.round("advantage", 4).alias("advantage"))


@query("SELECT date_trunc('day', ts) AS day, count(*) AS n, round(quantile_cont(value, 0.95), 6) AS p95, count(*) FILTER (event_type = 'error') AS dropped FROM events GROUP BY ALL")
def st8_latency_windows(spark, d):
    e = table(spark, d, "events").withColumn("day", F.window("ts", "1 day")["start"])
    x = e.groupBy("day").agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("dropped"))
    q = aggregates.exact_quantiles(e, ["day"], "value", {"p95": 0.95}).select("day", F.round("p95", 6).alias("p95"))
    return x.join(q, "day", "left").select("day", "n", "p95", "dropped")

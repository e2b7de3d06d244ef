"""Queries over records that must hold rules: units, voices, locks, receipts, screens, plans, and files written and read again."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from cuewright.functions import actions, audio, checks
from cuewright.operators import adapters, aggregates, joins, layout, quotas
from cuewright.plans.action_queries import tokens
from cuewright.plans.curation_queries import INTENTS, LAYOUT_SQL, laid
from cuewright.plans.tables import ACTIONS_SQL, ITEMS_SQL, ROLLOUTS_SQL, UNITS_SQL, rollouts, source_items, table, units
from cuewright.queries import query
from cuewright.sources import records
from cuewright.streaming import sessions

NAMED = "array_to_string(list_filter([{}], lambda x: x IS NOT NULL), ',')"


def named(*rules: tuple[str, str]) -> str:
    return NAMED.format(", ".join(f"CASE WHEN {bad} THEN '{name}' END" for name, bad in rules))


@query(f"""WITH x AS (SELECT event_id, {named(('version', 'event_id % 11 = 3'), ('scale', "event_type = 'error'"), ('kind', "trim(props, ' ') = '' OR props IS NULL"), ('task', 'value > 150'))} AS faults FROM events) SELECT * FROM x WHERE faults <> ''""")
def p10_trajectory_identity(spark, d):
    e = table(spark, d, "events")
    scale = F.when(F.col("event_type") == "error", " ").otherwise(F.col("event_type"))
    why = checks.trajectory_faults(F.when(F.col("event_id") % 11 == 3, "4").otherwise("5"), "5", scale, F.col("props"), F.when(F.col("value") <= 150, F.col("value").cast("string")))
    return e.select("event_id", F.array_join(why, ",").alias("faults")).where("faults <> ''")


TEXTS = ["hello", "plan it", "mend it", "read it", "stop"]


@query(f"""WITH t(language, intent, text) AS (VALUES {", ".join(f"('{g}', {i}, '{g}: {x}')" for g in ("en", "zh") for i, x in enumerate(TEXTS))}),
p AS (SELECT doc_id AS i, CASE WHEN doc_id % 5 = 0 THEN 'en' ELSE 'zh' END AS language, doc_id % 5 AS intent, CASE WHEN doc_id % 20 < 8 THEN 'short' WHEN doc_id % 20 < 16 THEN 'medium' ELSE 'long' END AS duration_class, CASE WHEN doc_id % 20 >= 12 THEN 6 ELSE 2 END AS n FROM documents),
u AS (SELECT *, unnest(range(n)) AS turn FROM p)
SELECT 'plan-' || lpad(i::VARCHAR, greatest(length(i::VARCHAR), 6)::INT, '0') AS plan_id, turn::INT AS turn, CASE WHEN turn % 2 = 0 THEN 'user' ELSE 'assistant' END AS role, language, duration_class, text || ' ' || (turn + 1) || ' ' || i AS text FROM u JOIN t USING (language, intent)""")
def p15_text_plans(spark, d):
    t = spark.createDataFrame([(g, i, f"{g}: {x}") for g in ("en", "zh") for i, x in enumerate(TEXTS)], "language string, intent int, text string")
    return layout.assemble_plans(table(spark, d, "documents"), "doc_id", t, len(INTENTS))


@query("SELECT doc_id, row_number() OVER (ORDER BY ('0x' || substr(h, 1, 13))::BIGINT, h, doc_id) - 1 AS place FROM (SELECT doc_id, sha256('23:' || doc_id) AS h FROM documents)")
def p16_seeded_shuffle(spark, d):
    return layout.seeded_order(table(spark, d, "documents").select("doc_id"), "doc_id", 23, "place")


WAVE = "list_transform(embedding, lambda x: x::DOUBLE * 2.5::DOUBLE)"


@query(f"""SELECT vec_id, {named(('rate', 'vec_id % 13 = 4'), ('channels', 'vec_id % 17 = 2'), ('encoding', 'vec_id % 7 = 1'), ('length', 'vec_id % 19 = 5'), ('range', f'list_max(list_transform({WAVE}, lambda x: abs(x))) > 1'))} AS faults FROM embeddings""")
def p31_pcm_units(spark, d):
    """Frames of 64 samples, amplified; some have another rate, channels, encoding or a sample more."""
    v = F.col("vec_id")
    wave = F.transform("embedding", lambda a: a.cast("double") * 2.5)
    wave = F.when(v % 19 == 5, F.concat(wave, F.array(F.lit(0.0)))).otherwise(wave)
    why = audio.pcm_faults(wave, F.when(v % 13 == 4, 16_000).otherwise(24_000), F.when(v % 17 == 2, 2).otherwise(1), F.when(v % 7 == 1, "mp3").otherwise("f32"), samples=64)
    return table(spark, d, "embeddings").select("vec_id", F.array_join(why, ",").alias("faults"))


@query(f"""WITH {ACTIONS_SQL}, {UNITS_SQL}, x AS (SELECT event_id, CASE WHEN event_id % 29 = 1 THEN 2 ELSE speech::INT END AS mode, event_id * 7 % 2200 AS code, speech AS m, t.tokens, value FROM units JOIN tokens t USING (event_id))
SELECT event_id, {named(('mode', 'mode NOT IN (0, 1)'), ('codes', 'm AND code >= 2048'), ('tokens', 'event_id % 23 = 6'), ('delta', 'NOT value::BIGINT > 0'))} AS faults FROM x""")
def p38_unit_tensors(spark, d):
    """Codes count only where the unit speaks; some units have a token past the vocabulary or no step in time."""
    t = tokens(spark, d).select("event_id", "tokens")
    u = units(spark, d).join(t, "event_id")
    e = F.col("event_id")
    codes, mask = F.array(e * 7 % 2200, F.lit(5000).cast("long")), F.array(F.col("speech"), F.lit(False))
    tok = F.when(e % 23 == 6, F.concat(F.array(F.lit(940)), "tokens")).otherwise(F.col("tokens"))
    why = checks.unit_faults(F.when(e % 29 == 1, 2).otherwise(F.col("speech").cast("int")), codes, mask, tok, F.transform(tok, lambda x: F.lit(True)), F.bround("value").cast("long"))
    return u.select("event_id", F.array_join(why, ",").alias("faults"))


@query(f"""WITH v AS (SELECT c_custkey, sha256(c_name) AS h, c_name || CASE c_custkey % 4 WHEN 0 THEN '.flac' WHEN 1 THEN '.WAV' WHEN 2 THEN '.mp3' ELSE '' END AS path FROM customer)
SELECT c_custkey, {named(('id', 'c_custkey % 31 = 7'), ('suffix', 'c_custkey % 4 > 1'), ('hash', 'c_custkey % 5 = 2 AND c_custkey % 3 <> 0'))} AS faults,
CASE WHEN c_custkey % 4 < 2 AND c_custkey % 31 <> 7 THEN 'v' || c_custkey || '-' || substr(h, 1, 12) || CASE c_custkey % 4 WHEN 0 THEN '.flac' ELSE '.wav' END END AS stored FROM v""")
def p40_voice_records(spark, d):
    k = F.col("c_custkey")
    path = F.concat("c_name", F.when(k % 4 == 0, ".flac").when(k % 4 == 1, ".WAV").when(k % 4 == 2, ".mp3").otherwise(""))
    voice, actual = F.when(k % 31 == 7, " ").otherwise(F.concat(F.lit("v"), k)), F.sha2("c_name", 256)
    why = checks.voice_faults(voice, path, actual, F.when(k % 3 != 0, F.when(k % 5 == 2, "0").otherwise(actual)))
    name = F.when((k % 4 < 2) & (k % 31 != 7), checks.stored_voice_name(voice, path, actual))
    return table(spark, d, "customer").select("c_custkey", F.array_join(why, ",").alias("faults"), name.alias("stored"))


@query("""WITH m AS (SELECT vec_id, round(20 * log10(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)) / 64)), 4) - 4.9 AS loud FROM embeddings)
SELECT vec_id, CASE WHEN vec_id % 11 = 0 THEN 'no metrics' WHEN vec_id % 7 = 3 THEN 'hash' ELSE 'loudness' END AS fault FROM m WHERE vec_id % 11 = 0 OR vec_id % 7 = 3 OR NOT loud BETWEEN -24 AND -22""")
def p41_loudness_receipts(spark, d):
    x = table(spark, d, "embeddings").select("vec_id", (F.round(audio.dbfs(F.sqrt(audio.mean_square(F.col("embedding")))), 4) - 4.9).alias("loud"))
    h = F.sha2(F.col("vec_id").cast("string"), 256)
    receipts = x.select("vec_id", "loud", F.when(F.col("vec_id") % 7 == 3, "stale").otherwise(h).alias("metrics_sha256"))
    return joins.receipt_faults(receipts, x.where("vec_id % 11 <> 0").select("vec_id", h.alias("metrics_sha256")), "vec_id", "loud", "metrics_sha256")


@query("""SELECT s_suppkey, CASE WHEN s_suppkey % 7 = 3 THEN 'not locked' WHEN s_suppkey % 5 = 1 THEN 'version' ELSE 'no hash' END AS fault FROM supplier WHERE s_suppkey % 7 = 3 OR s_suppkey % 5 = 1 OR s_suppkey % 9 = 4
UNION ALL SELECT s_suppkey + 1000000000, 'not in catalog' FROM supplier WHERE s_suppkey % 8 = 2 AND s_suppkey % 7 <> 3""")
def j7_source_lock(spark, d):
    """Suppliers as a catalog of sources; its lock lacks some, has some more, and has old versions and empty hashes."""
    s = table(spark, d, "supplier")
    k = F.col("s_suppkey")
    lock = s.where(k % 7 != 3).select("s_suppkey", F.when(k % 5 == 1, -1).otherwise(F.col("s_nationkey")).alias("s_nationkey"), F.when(k % 9 == 4, "").otherwise(F.sha2("s_name", 256)).alias("sha256"))
    more = lock.where(k % 8 == 2).withColumn("s_suppkey", k + 1_000_000_000)
    return joins.lock_faults(s, lock.unionByName(more), "s_suppkey", "s_nationkey", "sha256")


@query("""SELECT s_suppkey, unnest(range(CASE WHEN s_suppkey % 3 = 0 THEN 1 ELSE s_suppkey % 3 END))::INT AS archive_no, CASE WHEN s_suppkey % 3 = 0 THEN s_name ELSE 'archive ' || unnest(range(CASE WHEN s_suppkey % 3 = 0 THEN 1 ELSE s_suppkey % 3 END)) END AS archive FROM supplier""")
def j7_lock_archives(spark, d):
    k = F.col("s_suppkey")
    n = (k % 3).cast("int")
    some = F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.concat(F.lit("archive "), i.cast("string"))))
    return joins.lock_archives(table(spark, d, "supplier").withColumn("archives", some), "s_suppkey", "archives", "s_name")


@query("SELECT page_id, CASE WHEN page_id % 13 = 5 THEN 'missing' ELSE 'different' END AS fault FROM pages WHERE page_id % 13 = 5 OR page_id % 9 = 2")
def j8_archive_hashes(spark, d):
    p = table(spark, d, "pages")
    k = F.col("page_id")
    lock = p.select("page_id", F.upper(F.sha2("html", 256)).alias("expected"))
    found = p.where(k % 13 != 5).select("page_id", F.sha2(F.when(k % 9 == 2, F.concat("html", F.lit(" "))).otherwise(F.col("html")), 256).alias("actual"))
    return joins.hash_faults(lock, found, "page_id", "expected", "actual")


@query(f"""WITH {ITEMS_SQL}, v AS (SELECT session, split, language, CASE WHEN session = 'src0' THEN 'assistant' ELSE 'user' END AS role FROM items),
a AS (SELECT count(DISTINCT session) AS n FROM v WHERE role = 'assistant'), s AS (SELECT count(*) AS n FROM (SELECT session FROM v WHERE role = 'user' GROUP BY session HAVING count(DISTINCT split) > 1)),
g AS (SELECT 5 - count(DISTINCT language) AS n FROM v WHERE role = 'user' AND language IN ('en', 'de', 'fr', 'es', 'zh'))
SELECT 'assistant voices' AS gate, n, n = 1 AS passed FROM a UNION ALL SELECT 'shared user voices', n, n = 0 FROM s UNION ALL SELECT 'languages without a voice', n, n = 0 FROM g""")
def a4_voice_isolation(spark, d):
    v = source_items(spark, d).withColumn("role", F.when(F.col("session") == "src0", "assistant").otherwise("user"))
    return aggregates.voice_isolation(v, "session", "role", "split", "language", ["en", "de", "fr", "es", "zh"])


@query(f"""WITH {ROLLOUTS_SQL}, g AS (SELECT update_id, group_id, stddev_pop(task) <= 0.2 AS idle FROM rollouts GROUP BY ALL),
x AS (SELECT *, row_number() OVER (PARTITION BY update_id ORDER BY group_id) - row_number() OVER (PARTITION BY update_id, idle ORDER BY group_id) AS run FROM g),
r AS (SELECT update_id, idle, run, count(*) AS k FROM x GROUP BY ALL)
SELECT update_id, coalesce(max(k) FILTER (idle), 0) AS longest, coalesce(max(k) FILTER (idle), 0) < 4 AS passed FROM r GROUP BY update_id""")
def a23_idle_streaks(spark, d):
    """Runs of groups whose rewards hardly vary, by update."""
    g = rollouts(spark, d).groupBy("update_id", "group_id").agg((F.stddev_pop("task") <= 0.2).alias("idle"))
    return aggregates.streaks(g, "update_id", ["group_id"], "idle", 4)


@query(f"WITH {ACTIONS_SQL} SELECT kind, count(*) AS checked, count(*) FILTER (event_id % 5 = 0 AND kind = 'TYPE') AS failed, count(*) >= 100 AND count(*) FILTER (event_id % 5 = 0 AND kind = 'TYPE') = 0 AS passed FROM tokens GROUP BY kind")
def a27_decode_tally(spark, d):
    """Token sequences read back, some texts without their end; a kind passes with 100 checked and none failed."""
    x = tokens(spark, d)
    t = F.when((F.col("event_id") % 5 == 0) & (F.col("kind") == "TYPE"), F.slice("tokens", F.lit(1), F.size("tokens") - 1)).otherwise(F.col("tokens"))
    x = x.select("kind", actions.grammar_error(t).isNull().alias("ok"))
    return aggregates.tally(x, F.col("ok"), "kind")


@query("SELECT source || '/' || doc_id AS source_item_id, row_number() OVER (ORDER BY source || '/' || doc_id) - 1 AS place FROM documents")
def o1_inventory_order(spark, d):
    """The inventory in the order of its item ids, cut to ranges; the place is the count of the ranges before."""
    x = table(spark, d, "documents").select(F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("source_item_id"))
    x = layout.numbered(x, [], ["source_item_id"], "place")
    return layout.in_global_order(x.select("source_item_id", "place"), "source_item_id")


@query("SELECT o_custkey AS run, 'ckpt-' || lpad(max(o_orderkey)::VARCHAR, 12, '0') AS path FROM orders GROUP BY o_custkey")
def o4_latest_checkpoint(spark, d):
    x = table(spark, d, "orders").select(F.col("o_custkey").alias("run"), F.concat(F.lit("ckpt-"), F.lpad(F.col("o_orderkey").cast("string"), 12, "0")).alias("path"))
    return records.latest_by_name(x, "run", "path")


@query(f"""WITH {LAYOUT_SQL}, s AS (SELECT plan_id, (max(end_sample) + 1919) // 1920 AS n, list(start_sample // 1920 ORDER BY turn) FILTER (role = 'user') AS t FROM laid GROUP BY plan_id),
x AS (SELECT plan_id, n, len(t) AS frames, CASE WHEN plan_id % 4 = 1 THEN list_concat(t, [t[1]]) WHEN plan_id % 5 = 2 THEN list_concat(t, [n]) ELSE t END AS t FROM s),
f AS (SELECT plan_id, {named(('unique', 'len(list_distinct(t)) <> len(t)'), ('length', 'len(t) <> frames'), ('range', 'len(list_filter(t, lambda k: k < 0 OR k >= n)) > 0'))} AS faults FROM x) SELECT * FROM f WHERE faults <> ''""")
def s14_sparse_screens(spark, d):
    """Screens at the ticks of user turns; some plans name a tick twice, some one past their end."""
    g = laid(spark, d).groupBy("plan_id").agg(
        F.ceil(F.max("end_sample") / 1920).alias("n"),
        F.transform(F.sort_array(F.collect_list(F.when(F.col("role") == "user", F.struct("turn", F.floor(F.col("start_sample") / 1920).alias("tick"))))), lambda s: s["tick"]).alias("frames"),
    )
    p = F.col("plan_id")
    ticks = F.when(p % 4 == 1, F.concat("frames", F.slice("frames", 1, 1))).when(p % 5 == 2, F.concat("frames", F.array("n"))).otherwise(F.col("frames"))
    return layout.screen_faults(g.withColumn("ticks", ticks), "plan_id", "ticks", "frames", "n").select("plan_id", F.array_join("faults", ",").alias("faults"))


@query(f"""WITH {ITEMS_SQL}, c AS (SELECT item_id, language, split, CASE WHEN item_id % 3 = 0 THEN n_chars // 100 ELSE 0 END AS give, CASE WHEN item_id % 3 = 1 THEN n_chars // 50 ELSE 0 END AS room FROM items),
x AS (SELECT *, least(sum(give) OVER g, sum(room) OVER g) AS moved, coalesce(sum(give) OVER w, 0) AS bg, coalesce(sum(room) OVER w, 0) AS br FROM c WINDOW g AS (PARTITION BY language, split), w AS (PARTITION BY language, split ORDER BY item_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT item_id, least(give, greatest(0, moved - bg))::BIGINT AS given, least(room, greatest(0, moved - br))::BIGINT AS received FROM x""")
def w9_transfer(spark, d):
    """What every third item has over goes to others with room in its language and split, first come first filled."""
    k, n = F.col("item_id") % 3, F.col("n_chars")
    x = source_items(spark, d).select("item_id", "language", "split", F.when(k == 0, F.floor(n / 100)).otherwise(0).alias("give"), F.when(k == 1, F.floor(n / 50)).otherwise(0).alias("room"))
    return quotas.transfer(x, ["language", "split"], ["item_id"], "give", "room").select("item_id", F.col("given").cast("long").alias("given"), F.col("received").cast("long").alias("received"))


# ---- files written to the shared folder and read again


@query("SELECT doc_id, lang, n_chars FROM documents WHERE doc_id % 8 <> 3")
def s1_json_lines(spark, d):
    """Documents as JSON lines, some of them broken: the good ones come back."""
    x, path = table(spark, d, "documents").select("doc_id", "lang", "n_chars"), records.shared_path(spark, "lines")
    line = records.canonical_lines(x)
    x.select(F.when(F.col("doc_id") % 8 == 3, F.substring(line, 2, 9)).otherwise(line).alias("value")).write.text(path)
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("lang", T.StringType()), T.StructField("n_chars", T.LongType())])
    return records.read_jsonl(spark, path, schema)[0]


@query("SELECT vec_id, sha256(encode(repeat('ab', (vec_id % 50)::INT))) AS sha256, NULL::VARCHAR AS rejected FROM embeddings WHERE vec_id % 50 > 0 UNION ALL SELECT vec_id, NULL, 'clip-' || vec_id FROM embeddings WHERE vec_id % 50 = 0")
def s3_embedded_audio(spark, d):
    """Parquet with audio bytes in a struct; empty ones are rejects."""
    v = F.col("vec_id")
    raw = F.encode(F.repeat(F.lit("ab"), (v % 50).cast("int")), "UTF-8")
    path = records.shared_path(spark, "audio")
    table(spark, d, "embeddings").select("vec_id", F.struct(F.when(v % 100 != 0, raw).alias("bytes"), F.concat(F.lit("clip-"), v).alias("path")).alias("audio")).write.parquet(path)
    good, bad = records.audio_rows(spark.read.parquet(path))
    return good.select("vec_id", "sha256", F.lit(None).cast("string").alias("rejected")).unionByName(bad.select("vec_id", F.lit(None).cast("string").alias("sha256"), F.col("path").alias("rejected")))


@query("SELECT count(*) FILTER (conv_id % 3 = 0)::BIGINT * 2 + count(*) FILTER (conv_id % 3 = 1) AS units FROM conversations")
def s16_unit_total(spark, d):
    """Report lines name units, unit_count or nothing."""
    k, path = F.col("conv_id") % 3, records.shared_path(spark, "units")
    line = F.when(k == 0, F.lit('{"units":2}')).when(k == 1, F.lit('{"unit_count":1}')).otherwise(F.lit('{"other":1}'))
    table(spark, d, "conversations").select(line.alias("value")).write.text(path)
    return records.unit_total(spark, path)


@query("SELECT DISTINCT 'task-' || user_id AS task_id FROM events")
def s15_task_list(spark, d):
    """Task ids as JSON strings or objects, one a line."""
    x, path = table(spark, d, "events").select("user_id").distinct(), records.shared_path(spark, "tasks")
    name = F.concat(F.lit('"task-'), F.col("user_id"), F.lit('"'))
    x.select(F.when(F.col("user_id") % 2 == 0, name).otherwise(F.concat(F.lit('{"task_id":'), name, F.lit("}"))).alias("value")).write.text(path)
    return records.task_ids(spark, path)


@query("SELECT page_id, url, CASE WHEN page_id % 6 = 1 THEN 'old' ELSE 'e1' END AS environment_id, 5 AS schema_version FROM pages WHERE page_id % 10 <> 7")
def p9_migration(spark, d):
    """Version 4 rows get defaults and version 5; other versions are rejects."""
    k = F.col("page_id")
    x = table(spark, d, "pages").select("page_id", "url", F.when(k % 6 == 1, "old").alias("environment_id"), F.when(k % 10 == 7, 3).otherwise(4).alias("schema_version"))
    good, _ = adapters.migrate_metadata(x, {"environment_id": "e1"})
    return good.select("page_id", "url", F.col("runtime_identity.environment_id").alias("environment_id"), "schema_version")


@query("SELECT event_id, row_number() OVER (PARTITION BY user_id, event_type, hour(ts) ORDER BY event_id) = 1 AS accepted FROM events")
def st5_repeated_units(spark, d):
    """The first unit of a user, type and hour of the day is accepted, later ones are refused."""
    x = table(spark, d, "events").withColumn("h", F.hour("ts"))
    return sessions.unit_receipt_rows(x, ["user_id", "event_type", "h"], "event_id").select("event_id", "accepted")


@query(f"""WITH {UNITS_SQL} SELECT session_id, unit_index // 4 AS unit, count(*) AS n_controls, arg_min(CASE WHEN event_type = 'error' THEN 'error' ELSE 'slow' END, unit_index) FILTER (event_type = 'error' OR value > 120) AS reason,
count(*) FILTER (event_type = 'error' OR value > 120) = 0 AS accepted FROM units GROUP BY ALL""")
def st6_unit_receipts(spark, d):
    """Four events make a unit; its first rule breach names the reason."""
    u = units(spark, d).withColumn("unit", F.floor(F.col("unit_index") / 4)).withColumn("v", F.when(F.col("event_type") == "error", "error").when(F.col("value") > 120, "slow"))
    return sessions.unit_receipts(u, "v", "unit_index", "session_id", "unit").select("session_id", "unit", "n_controls", "reason", "accepted")

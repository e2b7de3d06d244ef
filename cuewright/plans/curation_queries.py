"""Queries over plans and source items: splits, timelines, quotas, joins, sets and orders."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cuewright.functions import checks, clock, hashing
from cuewright.operators import aggregates, joins, layout, quotas, stages
from cuewright.plans.tables import ITEMS_SQL, TURNS_SQL, plan_turns, source_items, table
from cuewright.queries import query
from cuewright.sources import records

CATEGORIES = {"public_speech": 0.4, "adjacent_turns": 0.4, "screen_task": 0.2}
LANGUAGES = {"en": 0.5, "de": 0.2, "fr": 0.2, "es": 0.1}
SPLITS = {"train": 0.8, "validation": 0.1, "test": 0.1}
TARGETS_SQL = """targets AS (SELECT category, language, split, 1000000::DOUBLE * cs::DOUBLE * ls::DOUBLE * ss::DOUBLE AS target_seconds FROM
  (VALUES ('public_speech', 0.4::DOUBLE), ('adjacent_turns', 0.4::DOUBLE), ('screen_task', 0.2::DOUBLE)) a(category, cs),
  (VALUES ('en', 0.5::DOUBLE), ('de', 0.2::DOUBLE), ('fr', 0.2::DOUBLE), ('es', 0.1::DOUBLE)) b(language, ls),
  (VALUES ('train', 0.8::DOUBLE), ('validation', 0.1::DOUBLE), ('test', 0.1::DOUBLE)) c(split, ss))"""
LAYOUT_SQL = TURNS_SQL + """, laid AS (SELECT *, start_sample + samples AS end_sample FROM (SELECT *,
  (3840 + coalesce(sum((samples + 1919) // 1920 * 1920) OVER (PARTITION BY plan_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
  + 5760 * sum((role = 'assistant')::INT) OVER (PARTITION BY plan_id ORDER BY turn ROWS UNBOUNDED PRECEDING))::BIGINT AS start_sample FROM turns))"""


def laid(spark, d):
    return layout.dialogue_timeline(plan_turns(spark, d))


@query(f"WITH {LAYOUT_SQL}, s AS (SELECT split, language, role, sum(samples) / 24000.0::DOUBLE AS seconds, count(*) AS turns, count(DISTINCT plan_id) AS plans, max(end_sample) AS last_end FROM laid GROUP BY ALL) SELECT split, language, role, round(seconds, 6) AS seconds, turns, plans, last_end FROM s")
def episode_quota_report(spark, d):
    x = laid(spark, d)
    return x.groupBy("split", "language", "role").agg(F.round(F.sum("samples") / 24000.0, 6).alias("seconds"), F.count("*").alias("turns"), F.count_distinct("plan_id").alias("plans"), F.max("end_sample").alias("last_end"))


@query(f"WITH {TURNS_SQL} SELECT DISTINCT plan_id, split FROM turns")
def p4_hash_split(spark, d):
    return plan_turns(spark, d).select("plan_id", "split").distinct()


@query("""SELECT doc_id, sha256('{"lang":"' || lang || '","n":' || n_chars || ',"none":null,"source":"' || source || '"}') AS digest FROM documents""")
def p1_stable_hash(spark, d):
    x = table(spark, d, "documents")
    return x.select("doc_id", hashing.stable_hash(lang=F.col("lang"), source=F.col("source"), n=F.col("n_chars"), none=F.lit(None).cast("string")).alias("digest"))


@query("SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE sha256(text) END AS digest FROM documents")
def p3_valid_sha256(spark, d):
    raw = F.upper(F.sha2("text", 256))
    bad = F.when(F.col("doc_id") % 14 == 0, F.concat(F.lit("0x"), raw)).when(F.col("doc_id") % 7 == 0, F.lit("")).otherwise(raw)
    return table(spark, d, "documents").select("doc_id", hashing.valid_sha256(bad).alias("digest"))


@query("""SELECT doc_id, CASE WHEN i < n * 8 // 10 THEN 'train' WHEN i < n * 9 // 10 THEN 'validation' ELSE 'test' END AS split
FROM (SELECT doc_id, row_number() OVER (PARTITION BY lang ORDER BY source, doc_id) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM documents)""")
def p5_split_by_place(spark, d):
    """80/10/10 by place within each language, whatever the number of its documents."""
    x = layout.split_by_place(table(spark, d, "documents").select("doc_id", "lang", "source"), ["lang"], ["source", "doc_id"])
    return x.select("doc_id", "split")


@query(f"WITH {ITEMS_SQL} SELECT split, count(*) AS n, min(item_id) AS first_id, max(item_id) AS last_id FROM items GROUP BY split")
def p5_positional_split(spark, d):
    return source_items(spark, d).groupBy("split").agg(F.count("*").alias("n"), F.min("item_id").alias("first_id"), F.max("item_id").alias("last_id"))


@query("""WITH f AS (SELECT user_id, min(event_id) AS pos FROM events GROUP BY user_id), r AS (SELECT user_id, (row_number() OVER (ORDER BY pos) - 1) % 10 AS k FROM f)
SELECT event_id, CASE WHEN k < 8 THEN 'train' WHEN k = 8 THEN 'validation' ELSE 'test' END AS split FROM events JOIN r USING (user_id)""")
def p6_first_appearance_split(spark, d):
    e = table(spark, d, "events")
    first = e.groupBy("user_id").agg(F.min("event_id").alias("pos"))
    k = F.col("k") % 10
    split = layout.numbered(first, [], ["pos"], "k").select("user_id", F.when(k < 8, "train").when(k == 8, "validation").otherwise("test").alias("split"))
    return e.join(split, "user_id").select("event_id", "split")


@query("WITH s AS (SELECT source, (dense_rank() OVER (ORDER BY source) - 1) % 3 AS k FROM (SELECT DISTINCT source FROM documents)) SELECT doc_id, ['train', 'validation', 'test'][k + 1] AS split FROM documents JOIN s USING (source)")
def p7_file_order_split(spark, d):
    x = table(spark, d, "documents")
    names = layout.numbered(x.select("source").distinct(), [], ["source"], "k").withColumn("k", F.col("k") % 3)
    return x.join(names, "source").select("doc_id", F.element_at(F.array(F.lit("train"), F.lit("validation"), F.lit("test")), (F.col("k") + 1).cast("int")).alias("split"))


@query("""SELECT doc_id, array_to_string(list_filter([CASE WHEN doc_id % 7 = 0 THEN 'lang' END, CASE WHEN doc_id % 11 = 0 THEN 'source' END, CASE WHEN trim(text, ' ') = '' THEN 'text' END], lambda x: x IS NOT NULL), ',') AS missing
FROM documents WHERE doc_id % 7 = 0 OR doc_id % 11 = 0 OR trim(text, ' ') = ''""")
def p8_required_fields(spark, d):
    x = table(spark, d, "documents").withColumn("lang", F.when(F.col("doc_id") % 7 != 0, F.col("lang"))).withColumn("source", F.when(F.col("doc_id") % 11 == 0, " ").otherwise(F.col("source")))
    _, bad = checks.quarantine(x, checks.missing_fields(x, ["lang", "source", "text"]))
    return bad.select("doc_id", F.array_join("reasons", ",").alias("missing"))


@query("SELECT doc_id, (n_chars * 7 + 1919) // 1920 * 1920 AS aligned FROM documents")
def p11_align_up(spark, d):
    return table(spark, d, "documents").select("doc_id", clock.align_up(F.col("n_chars") * 7).alias("aligned"))


@query("SELECT doc_id, (doc_id + 1) * 500 * 75 // 1000 - doc_id * 500 * 75 // 1000 AS frames FROM documents")
def p12_codec_frames(spark, d):
    ms = F.col("doc_id") * 500
    return table(spark, d, "documents").select("doc_id", (clock.codec_frame(ms + 500) - clock.codec_frame(ms)).alias("frames"))


@query("""WITH c AS (SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id), k AS (SELECT conv_id, CASE WHEN n <= 3 THEN 'short' WHEN n <= 6 THEN 'medium' ELSE 'long' END AS duration_class FROM c)
SELECT conv_id, duration_class, CASE duration_class WHEN 'short' THEN 4.0::DOUBLE WHEN 'medium' THEN 16.0::DOUBLE ELSE 32.0::DOUBLE END AS low, CASE duration_class WHEN 'short' THEN 16.0::DOUBLE WHEN 'medium' THEN 32.0::DOUBLE ELSE 60.0::DOUBLE END AS high FROM k""")
def p13_duration_bounds(spark, d):
    n = F.col("n")
    c = table(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("n"))
    c = c.select("conv_id", F.when(n <= 3, "short").when(n <= 6, "medium").otherwise("long").alias("duration_class"))
    low, high = clock.duration_bounds(F.col("duration_class"))
    return c.select("conv_id", "duration_class", low.alias("low"), high.alias("high"))


@query("""SELECT page_id, CASE WHEN url LIKE 'https://%' THEN 'secure/' || substr(url, 9) WHEN url LIKE 'http://%' THEN 'plain/' || substr(url, 8) ELSE url END AS path FROM pages""")
def p32_reroot(spark, d):
    return table(spark, d, "pages").select("page_id", checks.reroot(F.col("url"), {"https:/": "secure", "http:/": "plain"}).alias("path"))


@query("SELECT doc_id FROM documents WHERE doc_id // 100 > 2 OR (doc_id // 100 = 2 AND (doc_id % 100 > 30 OR doc_id % 100 = 30))")
def p34_cursor_resume(spark, d):
    x = table(spark, d, "documents")
    shard, sample = F.floor(F.col("doc_id") / 100).cast("int"), (F.col("doc_id") % 100).cast("int")
    return x.where(checks.cursor_start(shard, sample, F.lit(5), (2, 30, 5))).select("doc_id")


@query(f"WITH {LAYOUT_SQL} SELECT plan_id, turn, start_sample, end_sample FROM laid")
def w1_dialogue_timeline(spark, d):
    return laid(spark, d).select("plan_id", "turn", "start_sample", "end_sample")


@query(f"WITH {LAYOUT_SQL} SELECT plan_id, max(end_sample) AS last_end, greatest((12 * 24000 + 1919) // 1920 * 1920, (max(end_sample) + 1919) // 1920 * 1920 + 5760)::BIGINT AS timeline_samples FROM laid GROUP BY plan_id")
def w1_timeline_length(spark, d):
    return layout.timeline_length(laid(spark, d), F.lit(12.0))


@query("SELECT doc_id, 3840::BIGINT AS speech_start, 3840 + n_chars * 100 AS speech_end, (3840 + n_chars * 100 + 7680 + 1919) // 1920 * 1920 AS reply_start, ((3840 + n_chars * 100 + 7680 + 1919) // 1920 * 1920 + n_chars * 50 + 1919) // 1920 * 1920 + 7680 AS timeline_samples FROM documents")
def w2_source_layout(spark, d):
    x = table(spark, d, "documents").select("doc_id", (F.col("n_chars") * 100).alias("s"), (F.col("n_chars") * 50).alias("r"))
    return layout.source_layout(x, "s", "r").select("doc_id", "speech_start", "speech_end", "reply_start", "timeline_samples")


@query(f"""WITH {LAYOUT_SQL}, m AS (SELECT plan_id, turn, (start_sample - CASE WHEN turn % 3 = 2 THEN 5760 ELSE 0 END) AS s, end_sample AS e FROM laid),
f AS (SELECT *, max((e - 1) // 1920) OVER (PARTITION BY plan_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM m)
SELECT plan_id, turn, 'overlap' AS fault FROM f WHERE s // 1920 <= last + 1""")
def w3_segment_faults(spark, d):
    x = laid(spark, d).withColumn("start_sample", F.col("start_sample") - F.when(F.col("turn") % 3 == 2, 5760).otherwise(0))
    return layout.segment_faults(x, "plan_id", 1).select("plan_id", "turn", "fault")


@query(f"""WITH {ITEMS_SQL}, r AS (SELECT *, CASE category WHEN 'screen_task' THEN 1 WHEN 'public_speech' THEN 2 ELSE 0 END AS k FROM items),
n AS (SELECT *, CASE WHEN k > 0 THEN row_number() OVER (PARTITION BY split, category ORDER BY item_id) END AS rn FROM r)
SELECT item_id, row_number() OVER (PARTITION BY split ORDER BY k = 0, rn, CASE WHEN k > 0 THEN k END, item_id) - 1 AS ordinal FROM n""")
def w6_interleave(spark, d):
    return layout.interleave(source_items(spark, d), "split", "category", ["item_id"], ["screen_task", "public_speech"]).select("item_id", "ordinal")


@query(f"WITH {ITEMS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY session, split ORDER BY item_id) AS n FROM items) SELECT item_id FROM r WHERE n <= 3")
def w7_group_caps(spark, d):
    return layout.capped(source_items(spark, d), ["session", "split"], ["item_id"], 3).select("item_id")


ALLOC_SQL = ITEMS_SQL + """, b AS (SELECT item_id, language, CASE item_id % 3 WHEN 0 THEN 4.0::DOUBLE WHEN 1 THEN 16.0::DOUBLE ELSE 32.0::DOUBLE END AS low,
  CASE item_id % 3 WHEN 0 THEN 16.0::DOUBLE WHEN 1 THEN 32.0::DOUBLE ELSE 60.0::DOUBLE END AS high FROM items)"""


def _bounded(spark, d):
    x = source_items(spark, d).withColumn("cls", F.element_at(F.array(F.lit("short"), F.lit("medium"), F.lit("long")), (F.col("item_id") % 3 + 1).cast("int")))
    low, high = clock.duration_bounds(F.col("cls"))
    return x.select("item_id", "language", low.alias("low"), high.alias("high"))


@query(f"WITH {ALLOC_SQL} SELECT item_id, round(low + (25.0::DOUBLE * count(*) OVER w - sum(low) OVER w) * (high - low) / sum(high - low) OVER w, 4) AS seconds FROM b WINDOW w AS (PARTITION BY language)")
def w8_allocate_durations(spark, d):
    x = _bounded(spark, d)
    x = x.join(x.groupBy("language").agg(F.count("*").alias("n")), "language")
    return quotas.allocate(x, ["language"], "item_id", "low", "high", 25.0 * F.col("n")).select("item_id", F.round("seconds", 4).alias("seconds"))


@query(f"WITH {ALLOC_SQL} SELECT item_id, least((high - low)::BIGINT, greatest(0, 700 - coalesce(sum((high - low)::BIGINT) OVER (PARTITION BY language ORDER BY item_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)))::BIGINT AS taken FROM b")
def w9_waterfill(spark, d):
    x = _bounded(spark, d).withColumn("cap", (F.col("high") - F.col("low")).cast("long"))
    return quotas.waterfill(x, ["language"], ["item_id"], "cap", F.lit(700)).select("item_id", F.col("taken").cast("long").alias("taken"))


@query(f"WITH {ITEMS_SQL}, c AS (SELECT item_id, category, language, split, n_chars // 100 AS cap FROM items) SELECT item_id, least(cap, greatest(0, 500 - coalesce(sum(cap) OVER (PARTITION BY category, language, split ORDER BY cap DESC, item_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)))::BIGINT AS taken FROM c")
def w16_tail_trim(spark, d):
    x = source_items(spark, d).withColumn("cap", F.floor(F.col("n_chars") / 100))
    return quotas.waterfill(x, ["category", "language", "split"], ["cap", "item_id"], "cap", F.lit(500), down=True).select("item_id", F.col("taken").cast("long").alias("taken"))


@query(f"WITH {LAYOUT_SQL} SELECT plan_id, max((end_sample + 1919) // 1920 + CASE WHEN role = 'assistant' THEN 1 ELSE 0 END)::BIGINT AS min_ticks FROM laid GROUP BY plan_id")
def w17_minimum_ticks(spark, d):
    return laid(spark, d).groupBy("plan_id").agg(F.max(F.ceil(F.col("end_sample") / 1920) + F.when(F.col("role") == "assistant", 1).otherwise(0)).alias("min_ticks"))


@query(f"WITH {ITEMS_SQL} SELECT item_id, coalesce(sum(n_chars) OVER (PARTITION BY split ORDER BY item_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT // 100000 AS shard FROM items")
def w14_shard_ids(spark, d):
    return layout.shard_ids(source_items(spark, d), "split", ["item_id"], "n_chars", 100_000).select("item_id", "shard")


@query(f"WITH {ITEMS_SQL} SELECT category, language, split, grouping(category, language, split)::BIGINT AS level, round(sum(seconds), 4) AS seconds, count(*) AS n FROM items GROUP BY GROUPING SETS ((category, language, split), (category), (language), (split), ())")
def a5_quota_roll_up(spark, d):
    return quotas.roll_up(source_items(spark, d), "seconds").withColumn("seconds", F.round("seconds", 4))


@query(f"WITH {ITEMS_SQL}, {TARGETS_SQL} SELECT category, language, split, round(target_seconds, 4) AS target_seconds, round(coalesce(sum(seconds), 0), 4) AS actual_seconds, count(item_id) AS episodes FROM targets LEFT JOIN items USING (category, language, split) GROUP BY category, language, split, target_seconds")
def a6_dense_quota_report(spark, d):
    t = quotas.quota_targets(spark, 1_000_000, CATEGORIES, LANGUAGES, SPLITS)
    x = quotas.dense_report(source_items(spark, d), t, "seconds")
    return x.select("category", "language", "split", F.round("target_seconds", 4).alias("target_seconds"), F.round("actual_seconds", 4).alias("actual_seconds"), "episodes")


@query(f"WITH {ITEMS_SQL}, {TARGETS_SQL}, a AS (SELECT category, language, split, target_seconds AS t, coalesce(sum(seconds), 0) AS s FROM targets LEFT JOIN items USING (category, language, split) GROUP BY ALL) SELECT category, language, split, round(abs(s - t) / t, 6) AS error, abs(s - t) / t <= 0.5::DOUBLE AS passed FROM a")
def a7_quota_tolerance(spark, d):
    x = quotas.dense_report(source_items(spark, d), quotas.quota_targets(spark, 1_000_000, CATEGORIES, LANGUAGES, SPLITS), "seconds")
    e = quotas.relative_error(F.col("actual_seconds"), F.col("target_seconds"))
    return x.select("category", "language", "split", F.round(e, 6).alias("error"), (e <= 0.5).alias("passed"))


RECEIPTS_SQL = "receipts AS (SELECT plan_id, turn, sha256(text) AS audio_sha256 FROM turns WHERE (plan_id * 31 + turn) % 9 <> 0)"


def _receipts(spark, d):
    t = plan_turns(spark, d)
    return t.where((F.col("plan_id") * 31 + F.col("turn")) % 9 != 0).select("plan_id", "turn", F.sha2("text", 256).alias("audio_sha256"))


@query(f"WITH {TURNS_SQL}, {RECEIPTS_SQL} SELECT plan_id, turn, audio_sha256, audio_sha256 IS NULL AS missing FROM turns LEFT JOIN receipts USING (plan_id, turn)")
def j1_turn_receipts(spark, d):
    good, bad = joins.with_receipts(plan_turns(spark, d), _receipts(spark, d), ["plan_id", "turn"])
    a = good.select("plan_id", "turn", "audio_sha256", F.lit(False).alias("missing"))
    return a.unionByName(bad.select("plan_id", "turn", F.lit(None).cast("string").alias("audio_sha256"), F.lit(True).alias("missing")))


@query(f"WITH {ITEMS_SQL} SELECT item_id FROM items WHERE category <> 'adjacent_turns' OR item_id IN (SELECT doc_id FROM labels)")
def j2_adjacent_with_reply(spark, d):
    x, have = source_items(spark, d), table(spark, d, "labels").select(F.col("doc_id").alias("item_id"))
    adjacent = F.col("category") == "adjacent_turns"
    return x.where(~adjacent).select("item_id").unionByName(x.where(adjacent).join(have, "item_id", "left_semi").select("item_id"))


@query("SELECT doc_id FROM documents WHERE doc_id % 10 <> 0 AND (doc_id + 3) % 10 <> 0")
def j3_holdout_exclusion(spark, d):
    x = table(spark, d, "documents").select("doc_id", F.array(F.col("doc_id"), F.col("doc_id") + 3).alias("ids"))
    used = table(spark, d, "documents").select("doc_id").unionByName(spark.range(1).select(F.lit(0).cast("long").alias("doc_id"))).select(F.explode(F.array(F.col("doc_id") * 10, F.col("doc_id") * 10)).alias("u"))
    return joins.exclude_overlapping(x, used, "doc_id", "ids", "u").select("doc_id")


@query(f"WITH {ITEMS_SQL} SELECT split, count(*) AS overlap FROM items WHERE item_id IN (SELECT doc_id FROM labels) GROUP BY split")
def j4_holdout_overlap(spark, d):
    x = source_items(spark, d)
    return x.join(table(spark, d, "labels").select(F.col("doc_id").alias("item_id")), "item_id", "left_semi").groupBy("split").agg(F.count("*").alias("overlap"))


@query(f"""WITH {TURNS_SQL}, p AS (SELECT * REPLACE (['train', 'validation', 'test'][plan_id % 3 + 1] AS split) FROM turns),
v AS (SELECT n_name AS voice, CASE WHEN n_nationkey % 5 = 4 THEN 'multilingual' WHEN n_nationkey % 2 = 0 THEN 'en' ELSE 'zh' END AS language, CASE WHEN n_nationkey = 7 THEN 'assistant' ELSE 'user' END AS role,
  CASE WHEN n_nationkey = 7 THEN NULL WHEN n_nationkey % 3 = 0 THEN 'train' ELSE 'test' END AS split FROM nation),
e AS (SELECT voice, role, l.language, s.split FROM v JOIN (SELECT DISTINCT language FROM turns) l ON v.language IN (l.language, 'multilingual') OR v.role = 'assistant' JOIN (VALUES ('train'), ('validation'), ('test')) s(split) ON v.split = s.split OR v.split IS NULL),
r AS (SELECT *, row_number() OVER w - 1 AS pos, count(*) OVER (PARTITION BY role, language, split) AS size FROM e WINDOW w AS (PARTITION BY role, language, split ORDER BY voice)),
k AS (SELECT DISTINCT role, language, split, size FROM r)
SELECT plan_id, turn, r.voice, CASE WHEN k.size IS NULL THEN 'no voice' END AS fault FROM p LEFT JOIN k USING (role, language, split) LEFT JOIN r ON r.role = p.role AND r.language = p.language AND r.split = p.split AND r.pos = p.plan_id % k.size""")
def j5_voice_pick(spark, d):
    """Voices of three languages, splits and roles, one of them the assistant; the validation split has no user voice."""
    n = F.col("n_nationkey")
    voices = table(spark, d, "nation").select(
        F.col("n_name").alias("voice"), F.when(n % 5 == 4, "multilingual").when(n % 2 == 0, "en").otherwise("zh").alias("language"),
        F.when(n == 7, "assistant").otherwise("user").alias("role"), F.when(n != 7, F.when(n % 3 == 0, "train").otherwise("test")).alias("split"),
    )
    turns = plan_turns(spark, d).withColumn("split", F.element_at(F.array(*map(F.lit, SPLITS)), (F.col("plan_id") % 3 + 1).cast("int")))
    return joins.pick_voices(turns, voices, "plan_id", list(SPLITS)).select("plan_id", "turn", "voice", "fault")


@query("SELECT l_suppkey AS item, l_linenumber AS line, l_orderkey AS ord, s_name AS license FROM lineitem JOIN supplier ON l_suppkey = s_suppkey")
def j6_license_lookup(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_name").alias("license"))
    return table(spark, d, "lineitem").join(s, "l_suppkey").select(F.col("l_suppkey").alias("item"), F.col("l_linenumber").alias("line"), F.col("l_orderkey").alias("ord"), "license")


MANIFEST_SQL = """a AS (SELECT doc_id, sha256(text) AS h FROM documents WHERE doc_id % 13 <> 0), b AS (SELECT doc_id, sha256(CASE WHEN doc_id % 17 = 0 THEN '' ELSE text END) AS h FROM documents WHERE doc_id % 19 <> 0)"""


@query(f"WITH {MANIFEST_SQL} SELECT doc_id, CASE WHEN b.h IS NULL THEN 'missing' WHEN a.h IS NULL THEN 'extra' ELSE 'different' END AS status FROM a FULL JOIN b USING (doc_id) WHERE a.h IS DISTINCT FROM b.h")
def j9_j10_manifest_vs_shards(spark, d):
    x = table(spark, d, "documents")
    a = x.where("doc_id % 13 <> 0").select("doc_id", F.sha2("text", 256).alias("h"))
    b = x.where("doc_id % 19 <> 0").select("doc_id", F.sha2(F.when(F.col("doc_id") % 17 == 0, "").otherwise(F.col("text")), 256).alias("h"))
    return joins.compare_keyed(a, b, "doc_id", ["h"])


@query(f"""WITH {LAYOUT_SQL}, n AS (SELECT plan_id, (max(end_sample) + 1919) // 1920 AS ticks FROM laid GROUP BY plan_id),
s AS (SELECT plan_id, unnest(range(ticks)) AS tick, ticks FROM n), g AS (SELECT * FROM laid WHERE role = 'assistant')
SELECT s.plan_id, count(*) AS ticks, count(*) FILTER (EXISTS (SELECT 1 FROM g WHERE g.plan_id = s.plan_id AND tick BETWEEN start_sample // 1920 AND (end_sample - 1) // 1920)) AS active FROM s GROUP BY s.plan_id""")
def j11_segment_ticks(spark, d):
    x = laid(spark, d)
    n = x.groupBy("plan_id").agg(F.ceil(F.max("end_sample") / 1920).alias("ticks"))
    on = joins.active_ticks(joins.tick_spine(n, "ticks"), x.where("role = 'assistant'"), "plan_id", 1920)
    return on.groupBy("plan_id").agg(F.count("*").alias("ticks"), F.count_if("active").alias("active"))


@query(f"WITH {LAYOUT_SQL} SELECT plan_id, turn, CASE WHEN turn % 5 = 4 THEN 'unknown turn' WHEN role <> 'assistant' THEN 'wrong role' WHEN turn % 4 = 3 THEN 'off boundary' END AS fault FROM laid WHERE turn % 5 = 4 OR role <> 'assistant' OR turn % 4 = 3")
def j12_segment_turns(spark, d):
    x = laid(spark, d)
    t = F.col("turn")
    seg = x.select("plan_id", "turn", F.when(t % 5 == 4, t + 1000).otherwise(t).alias("ref"), (F.col("start_sample") + F.when(t % 4 == 3, 4000).otherwise(100)).alias("s"))
    ref = x.select("plan_id", F.col("turn").alias("ref"), "role", "start_sample")
    why = F.when(F.col("role").isNull(), "unknown turn").when(F.col("role") != "assistant", "wrong role").when(F.abs(F.col("s") - F.col("start_sample")) > 1920, "off boundary")
    return seg.join(ref, ["plan_id", "ref"], "left").select("plan_id", "turn", why.alias("fault")).where("fault is not null")


@query("SELECT doc_id, doc_id % 4 <> 0 AND doc_id % 5 <> 0 AS hit FROM documents")
def j14_cache_lookup(spark, d):
    x = table(spark, d, "documents").select("doc_id", F.sha2(F.concat(F.col("doc_id").cast("string"), F.lit("/"), F.col("text")), 256).alias("key"))
    cache = x.where("doc_id % 4 <> 0").select("key", F.lit("a").alias("recorded"), F.when(F.col("doc_id") % 5 == 0, "b").otherwise("a").alias("actual"))
    hit, miss = joins.cache_lookup(x, cache, "key", "recorded", "actual")
    return hit.select("doc_id", F.lit(True).alias("hit")).unionByName(miss.select("doc_id", F.lit(False).alias("hit")))


@query("""SELECT source, bool_or(source IN ('src1', 'src4') AND doc_id % 6 = 0) AS changed FROM documents GROUP BY source
UNION ALL SELECT '*', bool_or(source IN ('src1', 'src4') AND doc_id % 6 = 0) FROM documents""")
def j18_digest_roll_up(spark, d):
    """Digests of texts rolled up to manifests by source and to one report, before and after some texts of two sources changed."""
    x = table(spark, d, "documents").select("source", "doc_id", "text")
    new = x.withColumn("text", F.when(F.col("source").isin("src1", "src4") & (F.col("doc_id") % 6 == 0), F.concat(F.coalesce("text", F.lit("")), F.lit("!"))).otherwise(F.col("text")))

    def levels(df):
        m = stages.roll_up(df.select("source", "doc_id", F.coalesce(F.sha2("text", 256), F.lit("")).alias("sha")), ["source"], "doc_id", "sha")
        return m.unionByName(stages.roll_up(m, [], "source", "digest").select(F.lit("*").alias("source"), "digest"))

    return levels(x).join(levels(new).withColumnRenamed("digest", "after"), "source").select("source", (F.col("digest") != F.col("after")).alias("changed"))


@query("SELECT doc_id, sha256(CASE WHEN doc_id % 6 = 0 THEN text || '!' ELSE text END) AS digest, doc_id % 6 = 0 AS changed FROM documents")
def j18_hash_propagation(spark, d):
    x = table(spark, d, "documents")
    new = x.where("doc_id % 3 = 0").select("doc_id", F.sha2(F.when(F.col("doc_id") % 6 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("digest"))
    return joins.update_from(x.select("doc_id", F.sha2("text", 256).alias("digest")), new, "doc_id", "digest")


@query("WITH x AS (SELECT doc_id, sha256(doc_id::VARCHAR) AS h, lang FROM documents), r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY h, doc_id) AS n FROM x) SELECT doc_id, lang FROM r WHERE n <= 25")
def o2_hash_ordered_sample(spark, d):
    x = table(spark, d, "documents").select("doc_id", "lang", F.sha2(F.col("doc_id").cast("string"), 256).alias("h"))
    return layout.capped(x, ["lang"], ["h", "doc_id"], 25).select("doc_id", "lang")


@query("SELECT source, n FROM (SELECT source, count(*) AS n FROM documents WHERE length(trim(text, ' ')) < 300 GROUP BY source) ORDER BY source LIMIT 3")
def o3_first_offenders(spark, d):
    """The first three sources with texts under 300 characters."""
    return table(spark, d, "documents").where(F.length(F.trim("text")) < 300).groupBy("source").agg(F.count("*").alias("n")).orderBy("source").limit(3)


@query(f"WITH {ITEMS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY language, split ORDER BY item_id) AS k FROM items WHERE trim(text, ' ') <> '') SELECT language, split, item_id FROM r WHERE k = 1")
def o5_first_prompt(spark, d):
    x = source_items(spark, d).where(F.trim("text") != "")
    return joins.first_per(x, ["language", "split"], F.col("item_id")).select("language", "split", "item_id")


@query("WITH r AS (SELECT url, page_id, row_number() OVER (PARTITION BY regexp_replace(url, '[?#].*', '') ORDER BY page_id DESC) AS k FROM pages) SELECT regexp_replace(url, '[?#].*', '') AS path, page_id FROM r WHERE k = 1")
def o6_upsert_by_path(spark, d):
    x = table(spark, d, "pages").select(F.regexp_replace("url", "[?#].*", "").alias("path"), "page_id")
    return joins.first_per(x, ["path"], F.desc("page_id"))


@query("SELECT 'plan' AS kind, conv_id AS id, count(*) AS turns, '' AS session FROM conversations GROUP BY conv_id UNION ALL SELECT 'source', doc_id, 0, source FROM documents")
def x1_union_episodes(spark, d):
    a = table(spark, d, "conversations").groupBy(F.col("conv_id").alias("id")).agg(F.count("*").alias("turns")).withColumn("kind", F.lit("plan"))
    b = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("session"), F.lit("source").alias("kind"))
    return a.unionByName(b, allowMissingColumns=True).select("kind", "id", F.coalesce("turns", F.lit(0)).alias("turns"), F.coalesce("session", F.lit("")).alias("session"))


@query("SELECT (SELECT count(*) FROM (SELECT doc_id FROM documents EXCEPT ALL SELECT doc_id FROM labels)) = 0 AND (SELECT count(*) FROM (SELECT doc_id FROM labels EXCEPT ALL SELECT doc_id FROM documents)) = 0 AS equal_sets")
def x2_set_equality(spark, d):
    a, b = table(spark, d, "documents").select("doc_id"), table(spark, d, "labels").select("doc_id")
    diff = a.exceptAll(b).withColumn("side", F.lit("a")).unionByName(b.exceptAll(a).withColumn("side", F.lit("b")))
    return diff.agg((F.count("*") == 0).alias("equal_sets"))


@query("SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels")
def x3_intersection(spark, d):
    return table(spark, d, "documents").select("doc_id").intersect(table(spark, d, "labels").select("doc_id"))


@query("SELECT doc_id, 'missing' AS side FROM (SELECT doc_id FROM documents WHERE doc_id % 13 <> 0 EXCEPT SELECT doc_id FROM documents WHERE doc_id % 19 <> 0) UNION ALL SELECT doc_id, 'extra' FROM (SELECT doc_id FROM documents WHERE doc_id % 19 <> 0 EXCEPT SELECT doc_id FROM documents WHERE doc_id % 13 <> 0)")
def x4_symmetric_difference(spark, d):
    x = table(spark, d, "documents").select("doc_id")
    a, b = x.where("doc_id % 13 <> 0"), x.where("doc_id % 19 <> 0")
    return a.subtract(b).withColumn("side", F.lit("missing")).unionByName(b.subtract(a).withColumn("side", F.lit("extra")))


@query("SELECT event_id, array_to_string(list_filter(['k', 'page', 'zone'], lambda x: NOT list_contains(json_keys(props), x)), ',') AS absent FROM events")
def x5_absent_keys(spark, d):
    keys = F.coalesce(F.json_object_keys("props"), F.array().cast("array<string>"))
    return table(spark, d, "events").select("event_id", F.array_join(F.array_except(F.array(F.lit("k"), F.lit("page"), F.lit("zone")), keys), ",").alias("absent"))


@query("SELECT DISTINCT regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS shard FROM pages ORDER BY 1")
def x6_distinct_shards(spark, d):
    return table(spark, d, "pages").select(F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1).alias("shard")).distinct().orderBy("shard")


@query(f"WITH {ITEMS_SQL} SELECT row_number() OVER (PARTITION BY split ORDER BY item_id) - 1 AS ordinal, split, item_id FROM items")
def s11_split_manifest(spark, d):
    return layout.numbered(source_items(spark, d).select("split", "item_id"), ["split"], ["item_id"], "ordinal")


@query(f"""WITH {ITEMS_SQL}, o AS (SELECT item_id, split, row_number() OVER (PARTITION BY split ORDER BY session, item_id) - 1 AS ordinal, row_number() OVER (ORDER BY CASE split WHEN 'train' THEN 0 WHEN 'validation' THEN 1 ELSE 2 END, session, item_id) - 1 AS place FROM items)
SELECT 'all' AS manifest, place AS at, item_id, true AS in_order FROM o UNION ALL SELECT split, ordinal, item_id, true FROM o""")
def s11_written_manifests(spark, d):
    """Lines of the split manifests and the whole one, read back: the place each one tells, and whether its file has it in order."""
    path = records.shared_path(spark, "manifests")
    records.write_manifests(source_items(spark, d).select("item_id", "session", "split", "n_chars"), "split", ["session", "item_id"], path, list(SPLITS))
    field = lambda c: F.get_json_object("value", f"$.{c}").cast("long")
    lines = lambda p, name, at: spark.read.text(p).select(name.alias("manifest"), field(at).alias("at"), field("item_id").alias("item_id"), F.col("_metadata.file_path").alias("f"), F.monotonically_increasing_id().alias("m"))
    x = lines(f"{path}/all", F.lit("all"), "place").unionByName(lines(f"{path}/by", F.col("split"), "ordinal"))
    before = F.lag("at").over(W.partitionBy("manifest", "f").orderBy("m"))
    return x.select("manifest", "at", "item_id", F.coalesce(before < F.col("at"), F.lit(True)).alias("in_order"))


@query(f"WITH {ITEMS_SQL} SELECT concat_ws(' ', count(*) || ' items,', count(DISTINCT session) || ' sessions,', count(DISTINCT language) || ' languages,', count(*) FILTER (split = 'train') || ' for training') AS card FROM items")
def s13_data_card(spark, d):
    x = source_items(spark, d).agg(F.count("*").alias("n"), F.count_distinct("session").alias("s"), F.count_distinct("language").alias("l"), F.count_if(F.col("split") == "train").alias("t"))
    return x.select(F.format_string("%d items, %d sessions, %d languages, %d for training", "n", "s", "l", "t").alias("card"))


@query("""WITH g AS (SELECT doc_id AS episode, unnest(range(4)) AS unit FROM documents) SELECT episode, unit, ((episode % 5) * 7 + unit * 3 + 2 * 1) % 32 AS code, unit % 4 = 2 AS click, unit % 3 <> 1 AS screen FROM g""")
def s17_generated_episodes(spark, d):
    x = records.generated_units(table(spark, d, "documents"), "doc_id", 4, size=32)
    return x.select(F.col("episode_id").alias("episode"), F.col("unit_index").cast("long").alias("unit"), F.col("speech_codes")[1][1].cast("long").alias("code"), "click", F.col("screen_valid").alias("screen"))


@query(f"""WITH {ITEMS_SQL}, l AS (SELECT 'language' AS dimension, language AS value, split FROM items UNION ALL SELECT 'session', session, split FROM items)
SELECT dimension, value, array_to_string(list_sort(list(DISTINCT split)), ',') AS splits FROM l GROUP BY ALL HAVING count(DISTINCT split) > 1""")
def a2_split_leaks(spark, d):
    x = aggregates.leaks(source_items(spark, d), ["language", "session"], "split")
    return x.select("dimension", "value", F.array_join("splits", ",").alias("splits"))


@query(f"WITH {ITEMS_SQL} SELECT language, session, count(DISTINCT split) AS n_splits FROM items WHERE session <> 'src0' GROUP BY ALL HAVING count(DISTINCT split) > 1")
def a3_session_leaks(spark, d):
    x = source_items(spark, d).withColumn("session", F.when(F.col("session") == "src0", "").otherwise(F.col("session")))
    return aggregates.session_leaks(x, "language", "session", "split")


@query("""WITH RECURSIVE x AS (SELECT lang, greatest(n_chars // 100, 1) AS ticks, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS k FROM documents),
g AS (SELECT lang, sum(ticks)::BIGINT // 4 AS target FROM x GROUP BY lang),
r(lang, k, total) AS (SELECT lang, 0::BIGINT, 0::BIGINT FROM g UNION SELECT * FROM (SELECT r.lang, x.k, unnest([r.total, r.total + x.ticks]) AS total FROM r JOIN x ON x.lang = r.lang AND x.k = r.k + 1) s WHERE total <= (SELECT floor(target * 1.02::DOUBLE) FROM g WHERE g.lang = s.lang))
SELECT lang, arg_min(total, (abs(total - target), total)) AS chosen, target FROM (SELECT DISTINCT lang, total FROM r) JOIN g USING (lang) WHERE total >= ceil(target * 0.98::DOUBLE) GROUP BY lang, target""")
def g1_quota_fit(spark, d):
    """The total nearest to a quarter of each bucket's ticks that a subset of its rows makes, within 2 %."""
    x = table(spark, d, "documents").select("doc_id", "lang", F.greatest(F.floor(F.col("n_chars") / 100), F.lit(1)).alias("ticks"))
    want = x.groupBy("lang").agg(F.floor(F.sum("ticks") / 4).alias("target"))
    got = quotas.fit_buckets(x, want, "lang", "ticks", "doc_id").groupBy("lang").agg(F.sum("ticks").alias("chosen"))
    return got.join(want, "lang").select("lang", "chosen", "target")


G2_SQL = ITEMS_SQL + """, c AS (SELECT language, split, count(*) FILTER (item_id % 3 = 0) AS ns, count(*) FILTER (item_id % 3 = 1) AS nm, count(*) FILTER (item_id % 3 = 2) AS nl, count(*) AS n FROM items GROUP BY ALL),
u AS (SELECT *, 4 * ns + 16 * nm + 32 * nl AS al, 16 * ns + 32 * nm + 60 * nl AS ah FROM c), v AS (SELECT *, (al + ah) // 2 AS whole, (al + ah) // 22 AS goal, greatest(1, round_even(n / 11.0::DOUBLE, 0)::BIGINT, ceil((al + ah) // 22 / 60.0::DOUBLE)::BIGINT) AS wish FROM u),
k AS (SELECT v.*, s, m, l, 4 * s + 16 * m + 32 * l AS lo, 16 * s + 32 * m + 60 * l AS hi FROM v, unnest(range(ns + 1)) a(s), unnest(range(nm + 1)) b(m), unnest(range(nl + 1)) e(l) WHERE s + m + l BETWEEN 1 AND n - 1),
f AS (SELECT *, greatest(lo, whole - ah + hi) AS down, least(hi, whole - al + lo) AS up FROM k), h AS (SELECT *, least(greatest(goal, down), up)::DOUBLE AS attainable FROM f WHERE down <= up),
best AS (SELECT language, split, s AS short, m AS medium, l AS long, attainable FROM h QUALIFY row_number() OVER (PARTITION BY language, split ORDER BY abs(attainable - goal), abs(s + m + l - wish), abs((down + up) / 2.0::DOUBLE - goal), s + m + l, s, m) = 1)"""


def _screen_groups(spark, d):
    """Items as plans of three classes; each group is to fill the middle of its bounds, an eleventh of it with screens."""
    x = source_items(spark, d).select("item_id", "language", "split", F.element_at(F.array(*map(F.lit, quotas.CLASS_BOUNDS)), (F.col("item_id") % 3 + 1).cast("int")).alias("duration_class"))
    ends = [F.sum(F.element_at(F.create_map(*(F.lit(v) for c, b in quotas.CLASS_BOUNDS.items() for v in (c, b[i]))), F.col("duration_class"))) for i in (0, 1)]
    t = x.groupBy("language", "split").agg((ends[0] + ends[1]).alias("both"))
    return x, t.select("language", "split", F.floor(F.col("both") / 22).alias("screen_target"), F.floor(F.col("both") / 2).alias("group_target"))


@query(f"WITH {G2_SQL} SELECT language, split, short, medium, long, attainable FROM best")
def g2_class_counts(spark, d):
    x, t = _screen_groups(spark, d)
    n = x.groupBy("language", "split").agg(*(F.count_if(F.col("duration_class") == c).alias(f"n_{c}") for c in quotas.CLASS_BOUNDS))
    return quotas.choose_counts(n.join(t, ["language", "split"]), ["language", "split"])


@query(f"""WITH {G2_SQL}, r AS (SELECT item_id, language, split, item_id % 3 AS cls, row_number() OVER (PARTITION BY language, split, item_id % 3 ORDER BY sha256(item_id::VARCHAR), item_id) AS place FROM items)
SELECT item_id, place <= CASE cls WHEN 0 THEN short WHEN 1 THEN medium ELSE long END AS screen FROM r LEFT JOIN best USING (language, split)""")
def g2_screen_plans(spark, d):
    return quotas.screen_plans(*_screen_groups(spark, d), ["language", "split"], "item_id").select("item_id", "screen")


INTENTS = {"greet": 30, "plan": 25, "fix": 20, "read": 15, "stop": 7}


@query("""WITH n AS (SELECT count(*) AS n FROM documents), w(intent, pct, rank) AS (VALUES ('greet', 30, 0), ('plan', 25, 1), ('fix', 20, 2), ('read', 15, 3), ('stop', 7, 4)),
b AS (SELECT intent, rank, n * pct // 100 AS k FROM w, n), s AS (SELECT sum(k) AS have FROM b),
p AS (SELECT (have + i) % 5 AS rank, count(*) AS extra FROM s, n, (SELECT unnest(range(n)) AS i FROM n) WHERE have + i < n GROUP BY 1)
SELECT intent, (k + coalesce(extra, 0))::BIGINT AS n FROM b LEFT JOIN p USING (rank)""")
def p14_intent_expansion(spark, d):
    """Shares of the plan count by intent, rounded down; the rest goes round the intents from where the list stands."""
    n = table(spark, d, "documents").agg(F.count("*").alias("n"))
    w = spark.createDataFrame([(k, v, i) for i, (k, v) in enumerate(INTENTS.items())], "intent string, pct int, rank int")
    x = w.crossJoin(F.broadcast(n)).withColumn("k", F.floor(F.col("n") * F.col("pct") / 100))
    x = x.crossJoin(F.broadcast(x.agg(F.sum("k").alias("have"))))
    first, left = F.pmod(F.col("rank") - F.col("have"), F.lit(5)), F.col("n") - F.col("have")
    extra = F.when(first < left, F.floor((left - first - 1) / 5) + 1).otherwise(0)
    return x.select("intent", (F.col("k") + extra).alias("n"))


@query(f"""WITH {LAYOUT_SQL}, n AS (SELECT plan_id, (max(end_sample) + 1919) // 1920 AS ticks FROM laid GROUP BY plan_id), s AS (SELECT plan_id, unnest(range(ticks)) AS tick FROM n),
f AS (SELECT plan_id, start_sample // 1920 AS tick, turn FROM laid WHERE role = 'user')
SELECT s.plan_id, count(*) AS ticks, count(f.turn) AS shown, max(f.turn)::DOUBLE AS last_turn FROM s LEFT JOIN f USING (plan_id, tick) GROUP BY s.plan_id""")
def j13_sparse_screens(spark, d):
    x = laid(spark, d)
    n = x.groupBy("plan_id").agg(F.ceil(F.max("end_sample") / 1920).alias("ticks"))
    frames = x.where("role = 'user'").select("plan_id", F.floor(F.col("start_sample") / 1920).alias("tick"), "turn")
    y = joins.tick_spine(n, "ticks").join(frames, ["plan_id", "tick"], "left")
    return y.groupBy("plan_id").agg(F.count("*").alias("ticks"), F.count("turn").alias("shown"), F.max("turn").cast("double").alias("last_turn"))


@query("""WITH m AS (SELECT source, md5(string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id)) AS h FROM documents GROUP BY source), r AS (SELECT source, CASE WHEN source = 'src3' THEN 'stale' ELSE h END AS h FROM m WHERE source <> 'src5')
SELECT source, CASE WHEN r.h IS NULL THEN 'missing' ELSE 'different' END AS status FROM m LEFT JOIN r USING (source) WHERE m.h IS DISTINCT FROM r.h""")
def j17_report_coverage(spark, d):
    """Sources whose ids differ from a report's, told by order-free sums of two hashes an id."""
    have = aggregates.set_marks(table(spark, d, "documents"), ["source"], "doc_id")
    report = have.where("source <> 'src5'").withColumn("n", F.when(F.col("source") == "src3", F.col("n") + 1).otherwise(F.col("n")))
    return joins.compare_keyed(have, report, "source", ["n", "mark_sum", "mark_xor"])


@query("""WITH a AS (SELECT source, doc_id FROM documents WHERE doc_id % 13 <> 0), b AS (SELECT source, CASE WHEN doc_id % 17 = 0 AND source <> 'src1' THEN doc_id + 1000000 ELSE doc_id END AS doc_id FROM documents WHERE doc_id % 13 <> 0)
SELECT coalesce(a.source, b.source) AS source, coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN b.doc_id IS NULL THEN 'missing' ELSE 'extra' END AS status FROM a FULL JOIN b ON a.source = b.source AND a.doc_id = b.doc_id WHERE a.doc_id IS NULL OR b.doc_id IS NULL""")
def a16_id_sets(spark, d):
    """Ids that a plan and a manifest do not share, looked up only in the sources whose marks differ."""
    x = table(spark, d, "documents").where(F.col("doc_id") % 13 != 0).select("source", "doc_id")
    other = x.withColumn("doc_id", F.when((F.col("doc_id") % 17 == 0) & (F.col("source") != "src1"), F.col("doc_id") + 1_000_000).otherwise(F.col("doc_id")))
    return aggregates.set_differences(x, other, ["source"], "doc_id")


@query("""WITH m AS (SELECT doc_id, CASE WHEN doc_id % 50 < 2 THEN doc_id // 50 ELSE doc_id + 1000000 END AS episode, source <> 'src1' AND doc_id % 6 = 0 AS unlicensed, 'd' || doc_id % 40 AS device, CASE WHEN doc_id % 9 = 0 THEN NULL ELSE 's' || doc_id % 70 END AS session, CASE WHEN doc_id % 280 < 210 THEN 'train' ELSE 'test' END AS split FROM documents),
b AS (SELECT device, session FROM m WHERE session IS NOT NULL GROUP BY ALL HAVING count(DISTINCT split) > 1), e AS (SELECT episode FROM m GROUP BY 1 HAVING count(*) > 1),
s AS (SELECT CASE WHEN doc_id % 11 = 0 THEN episode + 5000000 ELSE episode END AS episode FROM m WHERE doc_id % 50 > 1)
SELECT * FROM (SELECT 'license' AS fault, count(*) AS n FROM m WHERE unlicensed UNION ALL SELECT 'duplicate', count(*) FROM m JOIN e USING (episode) UNION ALL SELECT 'session', count(*) FROM m JOIN b USING (device, session)
UNION ALL SELECT 'missing', count(*) FROM m WHERE episode NOT IN (SELECT episode FROM s) UNION ALL SELECT 'extra', count(*) FROM s WHERE episode NOT IN (SELECT episode FROM m)) WHERE n > 0""")
def s6_manifest_report(spark, d):
    """A manifest's faults by kind: licences, repeated episodes, sessions across splits, and ids that its shards lack or have over."""
    k = F.col("doc_id")
    m = table(spark, d, "documents").select(
        "doc_id", F.when(F.col("source") == "src1", "synthetic").otherwise(F.col("source")).alias("source"), (k % 6 != 0).alias("redistribution_allowed"), F.lit("cc").alias("source_license"),
        F.when(k % 50 < 2, F.floor(k / 50)).otherwise(k + 1_000_000).alias("episode"), F.concat(F.lit("d"), k % 40).alias("device"), F.when(k % 9 != 0, F.concat(F.lit("s"), k % 70)).alias("session"), F.when(k % 280 < 210, "train").otherwise("test").alias("split"),
    )
    stored = m.where(k % 50 > 1).select(F.when(k % 11 == 0, F.col("episode") + 5_000_000).otherwise(F.col("episode")).alias("episode"))
    return aggregates.manifest_report(m, stored, "episode", ["device", "session"], "split")


@query("""WITH m AS (SELECT doc_id, 'd' || doc_id % 40 AS device, CASE WHEN doc_id % 9 = 0 THEN NULL ELSE 's' || doc_id % 70 END AS session, CASE WHEN doc_id % 280 < 210 THEN 'train' ELSE 'test' END AS split FROM documents),
b AS (SELECT device, session FROM m WHERE session IS NOT NULL GROUP BY ALL HAVING count(DISTINCT split) > 1) SELECT doc_id FROM m JOIN b USING (device, session)""")
def s6_session_leaks(spark, d):
    """Manifest rows whose device and session stand in more than one split; rows without a session count nowhere."""
    k = F.col("doc_id")
    m = table(spark, d, "documents").select("doc_id", F.concat(F.lit("d"), k % 40).alias("device"), F.when(k % 9 != 0, F.concat(F.lit("s"), k % 70)).alias("session"), F.when(k % 280 < 210, "train").otherwise("test").alias("split"))
    return aggregates.rows_of_leaks(m, ["device", "session"], "split").select("doc_id")


@query("""SELECT doc_id, array_to_string(list_filter([CASE WHEN source <> 'src1' AND doc_id % 6 = 0 THEN 'license' END, CASE WHEN doc_id % 50 < 2 THEN 'duplicate' END], lambda x: x IS NOT NULL), ',') AS faults
FROM documents WHERE (source <> 'src1' AND doc_id % 6 = 0) OR doc_id % 50 < 2""")
def s6_manifest_checks(spark, d):
    x = table(spark, d, "documents").select("doc_id", F.when(F.col("source") == "src1", "synthetic").otherwise(F.col("source")).alias("source"), (F.col("doc_id") % 6 != 0).alias("redistribution_allowed"), F.lit("cc").alias("source_license"), F.when(F.col("doc_id") % 50 < 2, F.floor(F.col("doc_id") / 50)).otherwise(F.col("doc_id") + 1_000_000).alias("episode"))
    twice = aggregates.duplicate_keys(x, "episode").select("episode", F.lit(True).alias("twice"))
    y = x.join(twice, "episode", "left")
    why = checks.failed(license=checks.licensed(y), duplicate=F.col("twice").isNull())
    return y.select("doc_id", F.array_join(why, ",").alias("faults")).where("faults <> ''")

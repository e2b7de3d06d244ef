"""Queries that write files to the shared folder, call injected models, run streams or whole preparation jobs."""

from __future__ import annotations

import json

from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cuewright.functions import checks
from cuewright.operators import adapters, aggregates, quotas, stages
from cuewright.plans.tables import ITEMS_SQL, UNITS_SQL, source_items, table, units
from cuewright.queries import query
from cuewright.sources import records, shards
from cuewright.streaming import sessions

# ---- documents, lines, reports and hashes of files


@query("SELECT 'voice-' || s_suppkey AS voice_id, s_nationkey::INT AS nation FROM supplier")
def s2_nested_documents(spark, d):
    """Suppliers as JSON documents of up to 50 voices each, read back entry by entry."""
    path = records.shared_path(spark, "voices")
    entry = F.struct(F.concat(F.lit("voice-"), F.col("s_suppkey")).alias("voice_id"), F.col("s_nationkey").cast("int").alias("nation"))
    x = table(spark, d, "supplier").groupBy(F.floor(F.col("s_suppkey") / 50).alias("k")).agg(F.collect_list(entry).alias("voices"))
    x.select("k", F.to_json(F.struct("voices")).alias("value")).write.partitionBy("k").text(path)
    item = T.StructType([T.StructField("voice_id", T.StringType()), T.StructField("nation", T.IntegerType())])
    return records.read_document(spark, path, T.StructType([T.StructField("voices", T.ArrayType(item))]), "voices")


@query("""WITH c AS (SELECT conv_id, role, row_number() OVER w - 1 AS turn, count(*) OVER (PARTITION BY conv_id) AS n, (row_number() OVER w - 1) * 2.0::DOUBLE - 0.5::DOUBLE AS s,
(row_number() OVER w - 1) * 2.0::DOUBLE + (coalesce(length(text), 0) % 20) / 10.0::DOUBLE AS e FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
t AS (SELECT conv_id, turn, greatest(s, 0.0::DOUBLE) AS start, least(e, n * 2.0::DOUBLE - 3.0::DOUBLE) AS "end", role AS speaker FROM c WHERE turn < least(n - 1, 70))
SELECT conv_id, turn::INT AS turn, start, "end", speaker FROM t WHERE "end" - start >= 0.3::DOUBLE""")
def s5_span_turns(spark, d):
    """Conversations as arrays of time stamps, back to one row a turn."""
    turn = F.struct("turn", F.coalesce(F.length("text"), F.lit(0)).alias("n"), "role")
    x = table(spark, d, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("t"))
    x = x.select(
        "conv_id", (F.size("t") * 2.0 - 3.0).alias("seconds"), F.transform("t", lambda t, i: i * 2.0 - 0.5).alias("starts"),
        F.transform("t", lambda t, i: i * 2.0 + (t["n"] % 20) / 10.0).alias("ends"), F.transform("t", lambda t: t["role"]).alias("who"),
    )
    return records.turns_of_spans(x, "starts", "ends", "who").select("conv_id", "turn", "start", "end", "speaker")


@query("""SELECT lang, '{"doc_id":' || doc_id || ',"n_chars":' || n_chars || ',"source":"' || source || '"}' AS value FROM documents""")
def s10_canonical_lines(spark, d):
    path = records.shared_path(spark, "canonical")
    records.write_jsonl(table(spark, d, "documents").select("doc_id", "n_chars", "source", "lang"), path, "lang")
    return spark.read.text(path).select("lang", "value")


@query(f"WITH {ITEMS_SQL} SELECT category, language, split, sum(n_chars)::BIGINT AS n_chars, count(*) AS n FROM items GROUP BY ALL")
def s12_quota_report_file(spark, d):
    path = records.shared_path(spark, "report")
    x = source_items(spark, d).groupBy("category", "language", "split").agg(F.sum("n_chars").alias("n_chars"), F.count("*").alias("n"))
    records.write_report(x, path)
    return spark.read.json(path)


@query("SELECT source, sha256(count(*)::VARCHAR || chr(10)) AS sha256, length(count(*)::VARCHAR) + 1 AS length FROM documents GROUP BY source")
def p2_file_hashes(spark, d):
    """One file a source, with its number of documents."""
    path = records.shared_path(spark, "counts")
    table(spark, d, "documents").groupBy("source").agg(F.count("*").cast("string").alias("value")).write.partitionBy("source").text(path)
    return records.file_hashes(spark, f"{path}/*/part-*").select(F.regexp_extract("path", "source=([^/]*)/", 1).alias("source"), "sha256", "length")


@query("""SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_linenumber IN (2, 3, 5)""")
def p33_unsafe_members(spark, d):
    """Archive members whose path leaves the destination, among listings of an archive an order."""
    k = F.col("l_linenumber")
    name = F.when(k == 2, "../out").when(k == 3, "/etc/out").when(k == 5, "a/../../out").when(k == 4, "a/../in").otherwise("a/./in")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", name.alias("name")).where(checks.unsafe_member(F.col("name"))).select("l_orderkey", "l_linenumber")


# ---- tar shards


def episode_members(spark, d):
    """conversations as samples of a timeline and a note, 100 to a shard."""
    t = F.struct("turn", F.coalesce(F.length("text"), F.lit(0)).alias("n"), (F.col("role") == "assistant").cast("int").alias("mode"))
    x = table(spark, d, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(t)).alias("t"))
    line = F.to_json(F.struct(
        F.transform("t", lambda t, i: i * 80).alias("timestamp_ms"), F.transform("t", lambda t: F.lit(80)).alias("delta_ms"), F.transform("t", lambda t: t["mode"]).alias("speech_mode"),
        F.transform("t", lambda t: F.array(t["n"] % 32, t["n"] % 7)).alias("speech_codes"), F.transform("t", lambda t, i: F.array(i + 8, F.lit(1))).alias("action_tokens"),
    ))
    m = F.explode(F.array(F.struct(F.lit("timeline.json").alias("member"), F.encode(line, "UTF-8").alias("data")), F.struct(F.lit("note").alias("member"), F.encode(F.concat(F.lit("note "), "conv_id"), "UTF-8").alias("data"))))
    return x.select(F.floor(F.col("conv_id") / 100).alias("shard"), F.concat(F.lit("ep"), "conv_id").alias("sample_key"), m.alias("m")).select("shard", "sample_key", "m.*")


def written(spark, members, name: str, only: tuple[str, ...] = (), max_bytes: int = 16_000):
    """Members written as small shards and read again."""
    path = records.shared_path(spark, name)
    shards.write_samples(members, path, max_bytes=max_bytes)
    return shards.read_members(spark, f"{path}/*.tar", only)


@query("""WITH c AS (SELECT DISTINCT conv_id, 'ep' || conv_id AS sample_key, conv_id // 100 AS shard FROM conversations)
SELECT sample_key, member, (dense_rank() OVER (ORDER BY shard) - 1)::INT AS shard_index, (dense_rank() OVER (PARTITION BY shard ORDER BY sample_key) - 1)::INT AS sample_index FROM c, (VALUES ('note'), ('timeline.json')) m(member)""")
def s7_shard_positions(spark, d):
    """Numbered shards, a braced pattern that names some twice: each is read once, at its place in the order of paths."""
    path = records.shared_path(spark, "tars")
    shards.write_shards(episode_members(spark, d), "shard", path)
    m = shards.read_members(spark, f"{path}/{{*.tar,0000*.tar}}")
    return m.select("sample_key", "member", "shard_index", "sample_index")


UNIT_ARRAYS = {
    "timestamp_ms": ("timeline.npz", "timestamp_ms", "long"), "delta_ms": ("timeline.npz", "delta_ms", "int"), "speech_mode": ("timeline.npz", "speech_mode", "int"),
    "speech_codes": ("codes.npz", "speech_codes", "array<int>"), "action_tokens": ("timeline.npz", "action_tokens", "array<int>"),
}


@query("""WITH c AS (SELECT conv_id, role, coalesce(length(text), 0) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i FROM conversations)
SELECT 'ep' || conv_id AS sample_key, i::INT AS unit_index, i * 80 AS timestamp_ms, 80 AS delta_ms, (role = 'assistant')::INT AS speech_mode, (n % 32) || ' ' || (n % 7) AS codes, (i + 8) || ' 1' AS tokens FROM c""")
def s8_unit_rows(spark, d):
    """Units packed into numeric array members, written as shards and decoded again."""
    at = W.partitionBy("conv_id").orderBy("turn")
    n, i = F.coalesce(F.length("text"), F.lit(0)), F.row_number().over(at) - 1
    u = table(spark, d, "conversations").select(
        F.concat(F.lit("ep"), "conv_id").alias("key"), i.alias("i"), (i * 80).cast("long").alias("timestamp_ms"), F.lit(80).alias("delta_ms"), (F.col("role") == "assistant").cast("int").alias("speech_mode"),
        F.array(n % 32, n % 7).alias("speech_codes"), F.array(i + 8, F.lit(1)).alias("action_tokens"),
    )
    m = shards.pack_units(u, "key", "i", ["timestamp_ms", "delta_ms", "speech_mode", "action_tokens"]).unionByName(shards.pack_units(u, "key", "i", ["speech_codes"], "codes.npz"))
    got = shards.decode_units(written(spark, m, "units"), UNIT_ARRAYS)
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), " ")
    return got.select("sample_key", "unit_index", "timestamp_ms", "delta_ms", "speech_mode", text("speech_codes").alias("codes"), text("action_tokens").alias("tokens"))


@query("""WITH c AS (SELECT conv_id, turn, role, coalesce(length(text), 0) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i FROM conversations),
j AS (SELECT conv_id, count(*) AS units, '{"timestamp_ms":[' || string_agg((i * 80)::VARCHAR, ',' ORDER BY turn) || '],"delta_ms":[' || string_agg('80', ',' ORDER BY turn) || '],"speech_mode":[' || string_agg((role = 'assistant')::INT::VARCHAR, ',' ORDER BY turn)
  || '],"speech_codes":[' || string_agg('[' || n % 32 || ',' || n % 7 || ']', ',' ORDER BY turn) || '],"action_tokens":[' || string_agg('[' || i + 8 || ',1]', ',' ORDER BY turn) || ']}' AS line FROM c GROUP BY conv_id)
SELECT 'ep' || conv_id AS sample_key, units, units * 80 AS duration_ms, 2 AS members, strlen('note ep' || conv_id) - 2 + strlen(line) AS bytes, sha256('notenote ' || conv_id || 'timeline.json' || line) AS content_sha256, true AS within FROM j""")
def s9_shard_manifest(spark, d):
    """Shards that roll at 4,000 bytes or three samples: their manifest, and whether every shard kept to that and lists its samples."""
    m = episode_members(spark, d).join(table(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("units")).select(F.concat(F.lit("ep"), "conv_id").alias("sample_key"), "units", (F.col("units") * 80).alias("duration_ms")), "sample_key")
    listed, files = shards.write_samples(m.drop("shard"), records.shared_path(spark, "rolled"), max_bytes=4_000, max_samples=3, tasks=2)
    per = listed.groupBy("shard").agg(F.count("*").alias("n"), F.sum("bytes").alias("total"), F.max_by("bytes", "sample_index").alias("last"))
    ok = (F.col("n") == F.col("samples")) & (F.col("n") <= 3) & (F.col("total") == F.col("bytes")) & (F.col("total") - F.col("last") < 4_000)
    shard_ok = files.join(per, "shard", "left").select("shard", F.coalesce(ok, F.lit(False)).alias("within"))
    return listed.join(shard_ok, "shard", "left").select("sample_key", "units", "duration_ms", F.col("members").cast("int").alias("members"), "bytes", "content_sha256", F.coalesce("within", F.lit(False)).alias("within"))


@query("""SELECT 'ep' || conv_id AS sample_key, CASE WHEN conv_id % 5 = 0 THEN 'repeated' WHEN conv_id % 5 = 1 THEN 'extra' WHEN conv_id % 5 = 2 THEN 'missing' ELSE 'different' END AS fault
FROM (SELECT DISTINCT conv_id FROM conversations) WHERE conv_id % 5 < 4""")
def s7_shard_identity(spark, d):
    """Samples of shards against a manifest that lists some twice, leaves some out, and has others' hashes or samples of no shard."""
    k = F.regexp_extract("sample_key", "([0-9]+)", 1).cast("long") % 5
    m = episode_members(spark, d)
    got = shards.content_hashes(written(spark, m.where(k != 2), "identity"))
    listed = shards.content_hashes(m).where(k != 1).withColumn("content_sha256", F.when(k == 3, "none").otherwise(F.col("content_sha256"))).withColumn("n", F.explode(F.sequence(F.lit(1), F.when(k == 0, 2).otherwise(1)))).drop("n")
    return shards.identity_faults(got, listed)


@query("SELECT 'note' || conv_id AS sample_key, sha256('notenote ' || conv_id) AS content_sha256 FROM (SELECT DISTINCT conv_id FROM conversations)")
def p39_content_identity(spark, d):
    """Hash of key and bytes of a sample's members, read back from shards."""
    m = episode_members(spark, d).where("member = 'note'").withColumn("sample_key", F.regexp_replace("sample_key", "^ep", "note"))
    return shards.content_hashes(written(spark, m, "notes"))


@query("SELECT 'part-' || p_partkey AS utterance_id, replace(p_name, ' ', '') AS text, p_type AS sound FROM part WHERE p_partkey % 6 <> 1 AND p_partkey % 7 <> 2 AND trim(p_name) <> ''")
def s4_archive_walk(spark, d):
    """Sounds in tars and a transcript list; some have no line, some lines no sound."""
    p, k, path = table(spark, d, "part"), F.col("p_partkey"), records.shared_path(spark, "transcripts")
    name = F.concat(F.lit("part-"), k)
    p.where(k % 7 != 2).select(F.concat_ws(" ", name, "p_name").alias("value")).write.text(path)
    m = p.where(k % 6 != 1).select(F.floor(k / 1000).alias("shard"), F.concat(F.lit("wav/"), name).alias("sample_key"), F.lit("wav").alias("member"), F.encode("p_type", "UTF-8").alias("data"))
    got = shards.archive_utterances(written(spark, m, "wavs", ("wav",)), records.transcripts(spark, path))
    return got.select("utterance_id", "text", F.decode("data", "UTF-8").alias("sound"))


# ---- injected models


def _scorer():
    def call(text):
        if len(text) % 11 == 0:
            raise ValueError(f"length {len(text)}")
        return str(len(text)), len(text) % 7 / 10

    return call


@query("""WITH x AS (SELECT doc_id, length(coalesce(text, ''))::BIGINT AS n FROM documents)
SELECT doc_id, CASE WHEN n % 11 > 0 THEN n::VARCHAR END AS output, CASE WHEN n % 11 > 0 THEN (n % 7) / 10::DOUBLE END AS score, CASE WHEN n % 11 = 0 THEN 'length ' || n END AS error FROM x""")
def u1_scored_rows(spark, d):
    """A scorer that fails on some texts: its message stands in the row."""
    return adapters.call_rows(table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text")), _scorer, "doc_id", "text")


def _speaker():
    return lambda text: (f"say {text}", 0.1 if int(text) % 3 else 0.5)


@query("""WITH c AS (SELECT DISTINCT n_chars::VARCHAR AS content, n_chars AS n FROM documents)
SELECT content, CASE WHEN n % 5 = 0 THEN 'kept' ELSE 'say ' || content END AS output, CASE WHEN n % 5 = 0 THEN 0 WHEN n % 3 = 0 THEN 2 ELSE 1 END AS attempts, n % 5 = 0 OR n % 3 <> 0 AS accepted FROM c""")
def u2_generation(spark, d):
    """Content by its length: cached, accepted at once, or refused after two attempts."""
    n = F.col("n_chars").cast("string")
    x = table(spark, d, "documents").select(n.alias("content"), n.alias("text"))
    cache = x.where(F.col("content").cast("long") % 5 == 0).select("content", F.lit("kept").alias("output"), F.lit(0.0).alias("score")).distinct()
    good, bad = adapters.generate(x, cache, _speaker, "content", "text")
    cols = ["content", "output", "attempts"]
    return good.select(*cols, F.lit(True).alias("accepted")).unionByName(bad.select(*cols, F.lit(False).alias("accepted")))


def _signs():
    return lambda frame: [sum(v > 0 for v in frame)]


@query("""WITH e AS (SELECT vec_id // 4 AS episode, vec_id, embedding AS v, unnest(range((len(embedding) + 23) // 24)) AS f FROM embeddings)
SELECT episode, string_agg(len(list_filter(v[f * 24 + 1:f * 24 + 24], lambda x: x > 0))::VARCHAR, ' ' ORDER BY vec_id, f) AS codes FROM e GROUP BY episode""")
def u3_encoded_episodes(spark, d):
    """Four vectors make an episode; its frames of 24 numbers, the last padded, through an encoder that counts signs."""
    x = table(spark, d, "embeddings").select(F.floor(F.col("vec_id") / 4).alias("episode"), "vec_id", "embedding")
    got = adapters.encode_episodes(x, _signs, "episode", "vec_id", "embedding", 24)
    return got.where("error IS NULL").select("episode", F.array_join(F.transform("codes", lambda c: c.cast("string")), " ").alias("codes"))


@query("""SELECT doc_id, array_to_string(list_filter([CASE WHEN (lang = 'zh') <> (doc_id % 3 = 0) THEN 'metric' END, CASE WHEN doc_id % 12 = 11 THEN 'score' END], lambda x: x IS NOT NULL), ',') AS faults
FROM documents WHERE (lang = 'zh') <> (doc_id % 3 = 0) OR doc_id % 12 = 11""")
def u4_response_faults(spark, d):
    k = F.col("doc_id")
    x = table(spark, d, "documents").select("doc_id", F.col("lang").alias("language"), F.when(k % 3 == 0, "cer").otherwise("wer").alias("metric"), (k % 12 / 10).alias("score"))
    return x.select("doc_id", F.array_join(adapters.response_faults(), ",").alias("faults")).where("faults <> ''")


# ---- streams run to their end


def streamed(spark, x, run, name: str):
    """``x`` written to files, read as a stream and written again by ``run``; what it has when the files are read."""
    path = records.shared_path(spark, name)
    x.write.parquet(f"{path}/in")
    out = run(spark.readStream.schema(x.schema).parquet(f"{path}/in"))
    q = out.writeStream.format("parquet").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start(f"{path}/out")
    q.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{path}/out")


@query("""WITH e AS (SELECT user_id AS session_id, event_id, event_type = 'purchase' AS speech FROM events)
SELECT session_id, event_id FROM (SELECT *, lag(speech, 1, false) OVER (PARTITION BY session_id ORDER BY event_id) AS was FROM e) WHERE speech AND NOT was""")
def st2_mode_stream(spark, d):
    x = table(spark, d, "events").select(F.col("user_id").alias("session_id"), "event_id", (F.col("event_type") == "purchase").alias("speech"))
    return streamed(spark, x, sessions.mode_stream, "mode")


@query("""WITH e AS (SELECT user_id AS session_id, event_id, CASE WHEN event_id % 3 = 0 THEN '5 1' ELSE '7 8' END AS t, event_id % 3 = 0 AS done FROM events),
g AS (SELECT *, coalesce(sum(done::INT) OVER (PARTITION BY session_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS k FROM e)
SELECT session_id, string_agg(t, ' ' ORDER BY event_id) AS tokens FROM g GROUP BY session_id, k HAVING bool_or(done)""")
def st3_burst_stream(spark, d):
    tokens = F.when(F.col("event_id") % 3 == 0, F.array(F.lit(5), F.lit(1))).otherwise(F.array(F.lit(7), F.lit(8)))
    x = table(spark, d, "events").select(F.col("user_id").alias("session_id"), "event_id", tokens.alias("tokens"))
    got = streamed(spark, x, sessions.burst_stream, "burst")
    return got.select("session_id", F.array_join(F.transform("tokens", lambda t: t.cast("string")), " ").alias("tokens"))


@query(f"""WITH RECURSIVE {UNITS_SQL}, u AS (SELECT session_id, event_id, revision, event_type <> 'error' AS actuated, unit_index - (event_id % 13 = 0)::INT + (event_id % 17 = 0)::INT AS unit_index, row_number() OVER (PARTITION BY session_id ORDER BY event_id) AS k FROM units),
r(session_id, k, want, rev) AS (SELECT DISTINCT session_id, 0::BIGINT, 0::BIGINT, 0::BIGINT FROM u
  UNION ALL SELECT r.session_id, u.k, CASE WHEN unit_index = want AND revision >= rev AND actuated THEN want + 1 ELSE want END, CASE WHEN unit_index = want AND revision >= rev AND actuated THEN revision ELSE rev END::BIGINT FROM r JOIN u ON u.session_id = r.session_id AND u.k = r.k + 1),
w AS (SELECT u.*, CASE WHEN unit_index > want THEN 'gap' WHEN unit_index < want THEN 'repeated' WHEN revision < rev THEN 'revision' WHEN NOT actuated THEN 'actuation' END AS reason FROM u JOIN r ON r.session_id = u.session_id AND r.k = u.k - 1)
SELECT session_id, event_id, unit_index::BIGINT AS unit_index, reason IS NULL AS accepted, reason FROM w""")
def st5_unit_receipts_stream(spark, d):
    """Units with repeated and lost places and failed actions, through the stateful stream: each leaves with its receipt."""
    k = F.col("event_id")
    u = units(spark, d).select("session_id", "event_id", (F.col("unit_index") - (k % 13 == 0).cast("int") + (k % 17 == 0).cast("int")).cast("long").alias("unit_index"), F.col("revision").cast("long").alias("revision"), (F.col("event_type") != "error").alias("actuated"), "ts")
    got = streamed(spark, u, lambda x: sessions.receipts_stream(x, "ts"), "receipts")
    return got.select("session_id", "event_id", "unit_index", "accepted", "reason")


# ---- quotas and the whole job


def trim_cells(spark, d):
    """Items by category, language and split: ticks, nine tenths as target, a fifth of the ticks to spare."""
    x = source_items(spark, d).groupBy("category", "language", "split").agg(F.sum(F.floor(F.col("n_chars") / 1000)).cast("long").alias("ticks"))
    return x.select("*", F.floor(F.col("ticks") * 0.9).alias("target"), F.floor(F.col("ticks") / 5).alias("capacity"))


@query(f"""WITH {ITEMS_SQL}, c AS (SELECT category, language, split, sum(n_chars // 1000)::BIGINT AS ticks FROM items GROUP BY ALL),
s AS (SELECT split, sum(ticks)::BIGINT AS ticks, sum(floor(ticks * 0.9::DOUBLE))::BIGINT AS target, sum(ticks // 5)::BIGINT AS room FROM c GROUP BY split)
SELECT split, least(ticks - target, room) AS trimmed, true AS within_capacity FROM s WHERE ticks > target""")
def g3_trim_totals(spark, d):
    """Ticks trimmed by split, splits in order; no bucket gives more than it can spare."""
    x = trim_cells(spark, d)
    got = quotas.trim_splits(x, ["train", "validation", "test"]).join(x, ["category", "language", "split"])
    return got.groupBy("split").agg(F.sum("cut").alias("trimmed"), F.bool_and(F.col("cut") <= F.col("capacity")).alias("within_capacity")).where("trimmed > 0")


def _narrator():
    """Speaks a recipe of n characters in 1 to 13 seconds; multiples of seven come out wrong."""

    def call(recipe):
        n = int(json.loads(recipe)["text"])
        return f"say {n}", 0.5 if n % 7 == 0 else 0.1, 1.0 + n % 13

    return call


RECEIPT = "plan_id string, turn_id string, recipe_sha256 string, output string, score double, seconds double, attempts int"


def turns_of(items):
    """A turn and a plan for each item: its text is its number of characters."""
    x = items.select(F.col("item_id").cast("string").alias("plan_id"), F.lit("t0").alias("turn_id"), F.col("n_chars").cast("string").alias("text"), "language")
    return x, x.select("plan_id", F.sha2("text", 256).alias("recipe_sha256"))


@query(f"""WITH {ITEMS_SQL}, x AS (SELECT item_id, n_chars AS n, item_id % 4 AS k FROM items)
SELECT item_id::VARCHAR AS plan_id, CASE WHEN k = 3 THEN 'stale plan' WHEN n % 7 = 0 THEN 'score 0.5' END AS reason, CASE WHEN k < 3 AND n % 7 > 0 THEN CASE WHEN k = 0 THEN 'kept' ELSE 'say ' || n END END AS output,
CASE WHEN k < 3 AND n % 7 > 0 THEN CASE WHEN k = 0 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE + n % 13 END END AS seconds FROM x WHERE NOT (k = 0 AND n % 7 = 0)
UNION ALL SELECT item_id::VARCHAR, 'score 0.5', NULL, NULL FROM x WHERE k = 0 AND n % 7 = 0""")
def u2_generation_job(spark, d):
    """Receipts with recipe hashes: valid ones are kept, some plans are gone, some contents fail twice."""
    t, plans = turns_of(source_items(spark, d))
    k = F.col("plan_id").cast("long") % 4
    none = spark.createDataFrame([], RECEIPT)
    recipe = {"text": "text", "language": "language"}
    old, _ = adapters.generation_job(t.where(k == 0), plans, none, recipe, _narrator)
    old = old.withColumn("output", F.lit("kept")).withColumn("seconds", F.lit(0.5))
    got, refused = adapters.generation_job(t, plans.where(k != 3), old, recipe, _narrator)
    null = lambda kind: F.lit(None).cast(kind)
    return got.select("plan_id", null("string").alias("reason"), "output", "seconds").unionByName(refused.select("plan_id", "reason", null("string").alias("output"), null("double").alias("seconds")))


@query(f"""WITH {ITEMS_SQL}, k AS (SELECT *, CASE WHEN split = 'train' THEN 'pilot' ELSE 'canary' END AS dataset FROM items WHERE n_chars >= 200 AND n_chars % 7 > 0),
v AS (SELECT CASE WHEN n_nationkey % 2 = 0 THEN 'en' ELSE 'zh' END AS language, count(*) AS voices FROM nation GROUP BY 1)
SELECT dataset, language, count(*) AS episodes, sum(n_chars)::BIGINT AS n_chars, sum(ceil((1 + n_chars % 13) / 0.08::DOUBLE))::BIGINT AS units, max(voices) AS voices, false AS ran_again FROM k JOIN v USING (language) GROUP BY dataset, language""")
def u5_prepare_job(spark, d):
    """Fetched sources, inventory, voices, and for the smaller set first text, synthesis, manifest, audit and encoding; a second run takes up all tables."""
    path = lambda n: f"{d}/{n}.parquet"
    sources = {"documents": (source_items(spark, d).drop("text"), stages.source_digest(spark, path("documents"))), "nation": (table(spark, d, "nation"), stages.source_digest(spark, path("nation")))}
    named = F.when(F.col("split") == "train", "pilot").otherwise("canary")
    spec = [
        stages.Stage("inventory", lambda t: t["documents"].where("n_chars >= 200").withColumn("dataset", named), ["documents"], {"least_chars": 200}),
        stages.Stage("voices", lambda t: t["nation"].groupBy(F.when(F.col("n_nationkey") % 2 == 0, "en").otherwise("zh").alias("language")).agg(F.count("*").alias("voices")), ["nation"]),
    ]

    def speak(items):
        turns, plans = turns_of(items)
        return adapters.generation_job(turns, plans, spark.createDataFrame([], RECEIPT), {"text": "text", "language": "language"}, _narrator)[0]

    for name in ("canary", "pilot"):
        text, heard, manifest, codes = (f"{x}_{name}" for x in ("text", "synthesis", "manifest", "encoded"))
        spec += [
            stages.Stage(text, lambda t, name=name: t["inventory"].where(F.col("dataset") == name), ["inventory"], {"dataset": name}),
            stages.Stage(heard, lambda t, text=text: speak(t[text]), [text], {"model": 1}),
            stages.Stage(manifest, lambda t, text=text, heard=heard: t[text].drop("seconds").join(t[heard].select(F.col("plan_id").cast("long").alias("item_id"), "seconds"), "item_id"), [text, heard]),
            stages.Stage(codes, lambda t, manifest=manifest: t[manifest].select("item_id", "language", F.ceil(F.col("seconds") / 0.08).alias("units")), [manifest], {"tick": 0.08}),
            stages.Stage(f"audit_{name}", lambda t, manifest=manifest, codes=codes, name=name: t[manifest].join(t[codes].select("item_id", "units"), "item_id").groupBy("language").agg(F.count("*").alias("episodes"), F.sum("n_chars").alias("n_chars"), F.sum("units").alias("units")).join(t["voices"], "language").withColumn("dataset", F.lit(name)), [manifest, codes, "voices"]),
        ]
    root = records.shared_path(spark, "prepare")
    stages.prepare(spark, root, sources, spec)
    run = stages.prepare(spark, root, sources, spec)
    return run.tables["audit_canary"].unionByName(run.tables["audit_pilot"]).withColumn("ran_again", F.lit(bool(run.ran)))

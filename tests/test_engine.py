"""Operators on small tables, sources, streams and adapters, and every query against its SQL."""

import hashlib
import itertools
import json
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

import __spark_entry__ as entry
from cuewright import queries
from cuewright.functions import actions, audio, checks, clock, hashing, scoring
from cuewright.operators import adapters, aggregates, joins, layout, quotas, stages
from cuewright.plans.tables import units
from cuewright.sources import records, shards, tars
from cuewright.streaming import sessions

SF = "/root/testdata/sf0.001"
LOADED = queries.load()


def plain(v):
    if isinstance(v, float):
        return "null" if v != v else repr(round(v, 6) + 0.0)
    return "null" if v is None or v is pd.NaT or v is pd.NA else str(v)


@pytest.fixture(scope="module")
def con():
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(LOADED[0]))
def test_query_equals_sql(spark, con, name):
    got = LOADED[0][name](spark, SF).toPandas()
    if name not in LOADED[1]:
        assert len(got)
        return
    want = con.execute(LOADED[1][name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    rows = lambda d: sorted(tuple(map(plain, r)) for r in d[sorted(d.columns)].itertuples(index=False))
    assert rows(got) == rows(want)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


# ---- hashing, clocks, checks


def test_canonical_hash_equals_json(spark):
    rows = [("a", 1, None), ("é中\U0001f600\"\\\n", 2, "x"), ("", -5, "\x7f\x1f"), ("\\u001F \\\\\x1f", 0, "\x0b\x0a")]
    got = spark.createDataFrame(rows, "b string, a long, c string").select(hashing.stable_hash(a=F.col("a"), b=F.col("b"), c=F.col("c")).alias("h")).collect()
    want = [hashlib.sha256(json.dumps({"a": a, "b": b, "c": c}, sort_keys=True, separators=(",", ":")).encode()).hexdigest() for b, a, c in rows]
    assert [r.h for r in got] == want


def test_codec_clock_has_no_drift(spark):
    ms = F.col("id") * 500
    n = [r.n for r in spark.range(20).select((clock.codec_frame(ms + 500) - clock.codec_frame(ms)).alias("n")).collect()]
    assert n == [37, 38] * 10


def test_quarantine(spark):
    df = spark.createDataFrame([("a", "x", True), (" ", None, None)], "id string, b string, ok boolean")
    good, bad = checks.quarantine(df, checks.missing_fields(df, ["id", "b", "ok"]))
    assert good.count() == 1 and bad.first().reasons == ["id", "b", "ok"]
    with pytest.raises(ValueError):
        checks.quarantine(df, checks.missing_fields(df, ["id"]), strict=True)


def test_paths(spark):
    df = spark.createDataFrame([("/a/b/c",), ("/a/bc",), ("/a",), ("x /a/b/q",), ("/z",)], "p string")
    got = [r.p for r in df.select(checks.reroot(F.col("p"), {"/a": "/n", "/a/b": "/m"}).alias("p")).collect()]
    assert got == ["/m/c", "/n/bc", "/n", "x /m/q", "/z"]
    names = [("a/b", False), ("../a", True), ("a/../../b", True), ("/a", True), ("a/../b", False), ("./a", False)]
    got = spark.createDataFrame(names, "p string, bad boolean").select((checks.unsafe_member(F.col("p")) == F.col("bad")).alias("ok")).collect()
    assert all(r.ok for r in got)


# ---- actions

EVENTS = [
    ("NOOP", None, None, None, None, None, [2, 1]),
    ("CLICK", [0.0, 1.0], None, None, None, None, [3, 12, 267, 1]),
    ("DOUBLE_CLICK", [0.5, 0.5], None, None, None, None, [4, 140, 140, 1]),
    ("RIGHT_CLICK", [1.0, 0.0], None, None, None, None, [5, 267, 12, 1]),
    ("DRAG", [0.0, 0.0, 1.0, 1.0], None, None, None, None, [6, 12, 12, 267, 267, 1]),
    ("SCROLL", None, [-1.0, 1.0], None, None, None, [7, 268, 523, 1]),
    ("TYPE", None, None, None, "é", None, [8, 652 + 0xC3, 652 + 0xA9, 1]),
    ("TYPE", None, None, None, "", None, [8, 1]),
    ("HOTKEY", None, None, None, None, [1, 7, 12], [9, 909, 915, 920, 1]),
    ("WAIT", None, None, 2500.0, None, None, [10, 524 + 32, 1]),
    ("CANCEL", None, None, None, None, None, [11, 1]),
    ("CLICK", [0.5], None, None, None, None, None),
    ("CLICK", [0.5, 1.5], None, None, None, None, None),
    ("HOTKEY", None, None, None, None, [32], None),
    ("WAIT", None, None, None, None, None, None),
    ("JUMP", None, None, None, None, None, None),
]


def test_tokens_round_trip(spark):
    df = spark.createDataFrame(EVENTS, "kind string, coordinates array<double>, scroll array<double>, duration_ms double, text string, keys array<int>, want array<int>")
    args = [F.col(c) for c in df.columns[:6]]
    rows = df.select("*", actions.encode(*args).alias("got"), actions.reject_reason(*args, 10_000.0).alias("why")).withColumn("back", actions.decode(F.col("got"))).collect()
    for r in rows:
        assert r.got == r.want and (r.want is None) == (r.why is not None), r
        if r.want:
            assert r.back.kind == r.kind and r.back.text == r.text and r.back["keys"] == r["keys"]
            if r.coordinates:
                assert max(abs(a - b) for a, b in zip(r.back.coordinates, r.coordinates)) <= 1 / 510


def test_grammar_and_controls(spark):
    bad = [([],), ([3, 12, 1],), ([3, 12, 268, 1],), ([2, 5, 1],), ([8, 652 + 0xFF, 1],), ([9, 1],), ([3, 12, 12],), ([1],), ([12, 1],)]
    df = spark.createDataFrame(bad, "t array<int>")
    assert all(r.e for r in df.select(actions.grammar_error(F.col("t")).alias("e")).collect())
    keys = spark.createDataFrame([([9, 909, 915, 1],)], "t array<int>").select(F.explode(actions.controls(F.col("t"), F.lit("e"))).alias("c")).select("c.*").collect()
    assert [(k.event_id, k.control, k["key"]) for k in keys] == [("e-0", "KEY_PRESS", 1), ("e-1", "KEY_PRESS", 7)]
    long = spark.createDataFrame([(list(range(40)),)], "t array<int>").select(actions.bursts(F.col("t")).alias("b")).first().b
    assert [len(x) for x in long] == [16, 16, 8] and sum(long, []) == list(range(40))


# ---- layout


def test_timeline_equals_the_recurrence(spark):
    rng = random.Random(1)
    rows = [(p, t, rng.choice(["user", "assistant", "system"]), rng.randint(1, 50_000)) for p in range(200) for t in range(rng.randint(1, 9))]
    got = {(r.plan_id, r.turn): r.start_sample for r in layout.dialogue_timeline(spark.createDataFrame(rows, "plan_id long, turn long, role string, samples long")).collect()}
    up = lambda n: -(-n // 1920) * 1920
    for p, turns in itertools.groupby(rows, key=lambda r: r[0]):
        cursor = 2 * 1920
        for _, t, role, n in turns:
            start = up(cursor + (3 * 1920 if role == "assistant" else 0))
            assert got[p, t] == start
            cursor = up(start + n)


def test_advantages(spark):
    rows = [(1, 1.0), (1, 2.0), (1, 3.0), (1, 2.0), (2, 5.0), (2, 5.0), (3, 1.0)]
    got = layout.normalised_advantage(spark.createDataFrame(rows, "g int, r double"), "g", "r").collect()
    one = [r.advantage for r in got if r.g == 1]
    assert abs(sum(one)) < 1e-9 and abs(sum(a * a for a in one) / 4 - 1) < 1e-4
    assert all(not r.active and r.advantage == 0 for r in got if r.g != 1)


def test_interleave_and_shards(spark):
    rows = [(i, "train", c) for i, c in enumerate("aabbbxa")]
    got = layout.interleave(spark.createDataFrame(rows, "i int, s string, c string"), "s", "c", ["i"], ["b", "a"]).orderBy("ordinal").collect()
    assert "".join(r.c for r in got) == "bababax"
    got = layout.shard_ids(spark.createDataFrame([(i, "s", 40) for i in range(6)], "i int, s string, b long"), "s", ["i"], "b", 100).orderBy("i").collect()
    assert [r.shard for r in got] == [0, 0, 0, 1, 1, 2]


# ---- quotas


def test_best_subset_is_optimal():
    rng = random.Random(2)
    for _ in range(200):
        items = [rng.randint(1, 30) for _ in range(rng.randint(1, 9))]
        target = rng.randint(1, sum(items))
        sums = {sum(c) for k in range(len(items) + 1) for c in itertools.combinations(items, k)}
        ok = [s for s in sums if abs(s - target) <= int(target * 0.3)]
        got = quotas.best_subset([(t, items.count(t)) for t in set(items)], target, 0.3)
        if not ok:
            assert got is None
        else:
            best = min(ok, key=lambda s: (abs(s - target), s))
            assert sum(t * n for t, n in got.items()) == best and all(items.count(t) >= n for t, n in got.items())
    assert quotas.best_subset([(56, 2), (48, 2)], 104) == {56: 1, 48: 1}


def test_allocation_and_waterfill(spark):
    df = spark.createDataFrame([(1, 4.0, 16.0), (2, 16.0, 32.0), (3, 32.0, 60.0)], "i int, lo double, hi double").withColumn("g", F.lit(1))
    got = [r.seconds for r in quotas.allocate(df, ["g"], "i", "lo", "hi", F.lit(80.0)).orderBy("i").collect()]
    assert abs(sum(got) - 80) < 1e-6 and got[0] == 10.0
    assert quotas.allocate(df, ["g"], "i", "lo", "hi", F.lit(500.0)).where("seconds is null").count() == 3
    got = quotas.waterfill(df.withColumn("c", F.lit(5)), ["g"], ["i"], "c", F.lit(8)).orderBy("i").collect()
    assert [r.taken for r in got] == [5, 3, 0] and got[0].short == 0


def test_subset_search_keeps_two_bit_sets():
    """A thousand parts and ten million totals: the total is the nearest one, and memory stays far under a set a part."""
    import resource

    rng = random.Random(8)
    hist = [(rng.randint(1_000, 200_000), rng.randint(1, 4)) for _ in range(400)]
    target = sum(t * n for t, n in hist) // 8
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    got = quotas.best_subset(hist, target)
    assert sum(t * n for t, n in got.items()) == target and all(n <= sum(m for x, m in hist if x == t) for t, n in got.items())
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 600_000
    rough = quotas.best_subset(hist, target, most_ticks=100_000)
    step = -(-int(target * 1.02) // 100_000)
    assert abs(sum(t * n for t, n in rough.items()) - target) <= step / 2 * (sum(rough.values()) + 1)


def plain_counts(n, goal, whole):
    low, high = (4, 16, 32), (16, 32, 60)
    sums = lambda by, k: sum(a * b for a, b in zip(by, k))
    best, wish = None, max(1, round(sum(n) / 11), -(-goal // 60))
    for k in itertools.product(*(range(x + 1) for x in n)):
        down, up = max(sums(low, k), whole - sums(high, n) + sums(high, k)), min(sums(high, k), whole - sums(low, n) + sums(low, k))
        if 1 <= sum(k) <= sum(n) - 1 and down <= up:
            at = min(max(goal, down), up)
            key = (abs(at - goal), abs(sum(k) - wish), abs((down + up) / 2 - goal), sum(k), k, at)
            best = key if best is None or key < best else best
    return None if best is None else (*best[4], float(best[5]))


def test_class_counts_against_all_triples(spark):
    rng, groups, want = random.Random(6), [], {}
    for i in range(120):
        n = tuple(rng.randrange(0, 9) for _ in range(3))
        lo, hi = sum(a * b for a, b in zip(n, (4, 16, 32))), sum(a * b for a, b in zip(n, (16, 32, 60)))
        whole, goal = rng.randint(lo - 5, hi + 5), rng.randint(0, hi + 20)
        groups.append((i, *n, goal, whole))
        if (best := plain_counts(n, goal, whole)) is not None:
            want[i] = best
    df = spark.createDataFrame(groups, "g int, n_short long, n_medium long, n_long long, screen_target long, group_target long")
    got = {r["g"]: (r["short"], r["medium"], r["long"], r["attainable"]) for r in quotas.choose_counts(df, ["g"]).collect()}
    assert got == want and len(want) > 60


def test_class_counts_of_large_groups(spark):
    """A million plans a class: pairs of counts can't be listed; stretches of short counts give what all triples give."""
    big = (1_000_000, 1_000_001, 999_999)
    lo, hi = sum(a * b for a, b in zip(big, (4, 16, 32))), sum(a * b for a, b in zip(big, (16, 32, 60)))
    rng, groups, want = random.Random(9), [(-1, *big, (lo + hi) / 22, (lo + hi) / 2)], {}
    for i in range(40):
        n = tuple(rng.randrange(0, 14) for _ in range(3))
        a, b = sum(a * b for a, b in zip(n, (4, 16, 32))), sum(a * b for a, b in zip(n, (16, 32, 60)))
        whole, goal = rng.choice([a, b, rng.randint(a, b), (a + b) / 2]), rng.choice([0, b // 11, rng.randint(0, b + 40)]) + rng.choice([0, 0.5])
        groups.append((i, *n, float(goal), float(whole)))
        if (best := plain_counts(n, goal, whole)) is not None:
            want[i] = best
    df = spark.createDataFrame(groups, "g int, n_short long, n_medium long, n_long long, screen_target double, group_target double")
    got = {r["g"]: (r["short"], r["medium"], r["long"], r["attainable"]) for r in quotas.choose_counts(df, ["g"]).collect()}
    *k, at = got.pop(-1)
    assert got == want and len(want) > 20
    low, high = sum(a * b for a, b in zip(k, (4, 16, 32))), sum(a * b for a, b in zip(k, (16, 32, 60)))
    down, up = max(low, (lo + hi) / 2 - hi + high), min(high, (lo + hi) / 2 - lo + low)
    assert abs(at - (lo + hi) / 22) < 1e-6 and sum(k) == round(sum(big) / 11) and abs((down + up) / 2 - (lo + hi) / 22) <= 3
    # short stretches of one group give the same as one
    args = (40, 30, 110, 300, 900, 700, 10, 1)
    whole = quotas._best_counts(np.arange(41), *args)
    assert min(x for i in range(0, 41, 3) if (x := quotas._best_counts(np.arange(i, min(i + 3, 41)), *args))) == whole


def test_screen_plans_of_a_large_group(spark):
    plans = spark.range(90_000).select(F.col("id").alias("plan_id"), F.lit("g").alias("g"), F.element_at(F.array(*map(F.lit, quotas.CLASS_BOUNDS)), (F.col("id") % 3 + 1).cast("int")).alias("duration_class"))
    low, high = 30_000 * 52, 30_000 * 108
    t = spark.createDataFrame([("g", (low + high) // 22, (low + high) // 2)], "g string, screen_target long, group_target long")
    got = quotas.screen_plans(plans, t, ["g"])
    counts = quotas.choose_counts(t.selectExpr("*", "30000L n_short", "30000L n_medium", "30000L n_long"), ["g"]).first()
    n = {r["duration_class"]: (r["n"], r["first"]) for r in got.where("screen").groupBy("duration_class").agg(F.count("*").alias("n"), F.max(F.sha2(F.col("plan_id").cast("string"), 256)).alias("first")).collect()}
    assert {c: n.get(c, (0,))[0] for c in quotas.CLASS_BOUNDS} == {c: counts[c] for c in quotas.CLASS_BOUNDS} and sum(x for x, _ in n.values()) == round(90_000 / 11)
    rest = got.where("not screen").groupBy("duration_class").agg(F.min(F.sha2(F.col("plan_id").cast("string"), 256)).alias("next")).collect()
    assert all(r["duration_class"] not in n or n[r["duration_class"]][1] < r["next"] for r in rest)


def test_exact_quantiles_against_sorted_values(spark):
    rng, rows = random.Random(3), []
    for key, n in (("a", 1), ("b", 2), ("c", 7), (None, 5_000), ("d", 20_000)):
        rows += [(key, rng.choice([rng.gauss(0, 1), float(rng.randrange(5)), None] if key == "c" else [rng.gauss(0, 1), float(rng.randrange(5))])) for _ in range(n)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(6)
    got = {r["k"]: r for r in aggregates.exact_quantiles(df, ["k"], "v", {"p0": 0.0, "p50": 0.5, "p95": 0.95, "p100": 1.0}).collect()}
    for key in {k for k, _ in rows}:
        v = sorted(x for k, x in rows if k == key and x is not None)
        for name, p in (("p0", 0.0), ("p50", 0.5), ("p95", 0.95), ("p100", 1.0)):
            at = p * (len(v) - 1)
            a, b = v[int(at)], v[min(int(at) + 1, len(v) - 1)]
            assert abs(got[key][name] - (a + (b - a) * (at - int(at)))) < 1e-12, (key, name)
    everything = aggregates.exact_quantiles(df.drop("k"), [], "v", {"m": 0.5}).first()
    v = sorted(x for _, x in rows if x is not None)
    assert everything["n"] == len(v) and abs(everything["m"] - (v[(len(v) - 1) // 2] + v[len(v) // 2]) / 2) < 1e-12


# ---- joins and aggregates


def test_lineage_and_cache(spark):
    s = spark.createDataFrame([("a", None, "one"), ("b", "a", "two"), ("c", "a", "three"), ("d", "zz", "two")], "sha256 string, parent_sha256 string, stage string")
    assert {r.sha256 for r in joins.lineage_breaks(s, {"two": "one", "three": "two"}).collect()} == {"c", "d"}
    spec = spark.createDataFrame([(1, "s", False, "l"), (2, "synthetic", False, ""), (3, "s", True, " ")], "i int, source string, redistribution_allowed boolean, source_license string")
    assert [r.i for r in spec.where(checks.licensed(spec)).collect()] == [2]


def test_word_error_rate(spark):
    rows = [("the cat sat", "the bat sat", 1 / 3), ("a b c d", "a c d", 0.25), ("", "x", 1.0), ("It's fine", "it's FINE", 0.0), ("a", "a b c", 1.0)]
    got = spark.createDataFrame(rows, "a string, b string, w double").select("w", scoring.wer(F.col("a"), F.col("b")).alias("g")).collect()
    assert all(abs(r.g - r.w) < 1e-9 for r in got)


def test_frames_and_silence(spark):
    f = 8
    df = spark.createDataFrame([(1, [0.0] * 12), (2, [0.25] * f + [0.0] * f + [0.25] * 3)], "i int, w array<double>")
    got = [r.a for r in df.select(audio.frame_active(F.col("w"), f).alias("a")).collect()]
    assert got == [[False, False], [True, False, True]]
    assert df.select(audio.gain_to(F.col("w")).alias("g")).first().g is None


def test_segment_faults(spark):
    seg = spark.createDataFrame([(1, 0, 1920), (1, 1920, 3840), (1, 7680, 7680), (1, 9601, 9700), (1, 13440, 15360)], "e int, start_sample long, end_sample long")
    kinds = lambda gap: {(r.start_sample, r.fault) for r in layout.segment_faults(seg, "e", gap).collect()}
    assert kinds(0) == {(7680, "empty"), (9601, "unaligned")}
    assert (1920, "overlap") in kinds(1)


def test_unit_checks_and_receipts(spark):
    c = spark.createDataFrame([(1, 0, None), (1, 1, "b"), (1, 2, "c"), (2, 0, None)], "u int, o int, v string")
    got = {r.u: (r.accepted, r.reason) for r in sessions.unit_receipts(c, "v", "o", "u").collect()}
    assert got == {1: (False, "b"), 2: (True, None)}
    assert {r.k for r in aggregates.duplicate_keys(c.withColumnRenamed("u", "k"), "k").collect()} == {1}


# ---- sources


def test_json_lines(spark, tmp_path):
    p = tmp_path / "x.jsonl"
    p.write_text('{"a": 1, "units": 3}\n\n[1]\nnot json\n{"a": 2, "unit_count": 4}\n"t9"\n{"task_id": "t1"}\n')
    schema = T.StructType([T.StructField("a", T.LongType())])
    good, bad = records.read_jsonl(spark, str(p), schema)
    assert sorted((r.a for r in good.collect()), key=str) == [1, 2, None]
    assert {r.line for r in bad.collect()} == {"[1]", "not json", '"t9"'}
    assert records.unit_total(spark, str(p)).first().units == 7
    assert {r.task_id for r in records.task_ids(spark, str(p)).collect()} == {"t9", "t1", None}
    out = str(tmp_path / "out")
    records.write_jsonl(spark.createDataFrame([("é", None, "s1")], "b string, a string, split string"), out, "split")
    assert [r.value for r in spark.read.text(out).collect()] == ['{"a":null,"b":"\\u00e9"}']
    h = records.file_hashes(spark, str(p)).first()
    assert h.sha256 == hashlib.sha256(p.read_bytes()).hexdigest()


def test_spans_and_transcripts(spark, tmp_path):
    df = spark.createDataFrame([(1, 10.0, [0.0, 2.0, 4.0], [1.0, 2.1, 12.0], ["a", "b", "c"])], "id int, seconds double, s array<double>, e array<double>, w array<string>")
    assert [(r.turn, r.speaker) for r in records.turns_of_spans(df, "s", "e", "w").collect()] == [(0, "a")]
    (tmp_path / "t.txt").write_text("u1 你 好\nu2\n\nu3 a b\n")
    assert {(r.utterance_id, r.text) for r in records.transcripts(spark, str(tmp_path / "t.txt")).collect()} == {("u1", "你好"), ("u3", "ab")}


def test_shards_round_trip(spark, tmp_path):
    timeline = lambda n: json.dumps({"timestamp_ms": [80 * i for i in range(n)], "delta_ms": [80] * n, "speech_mode": [0] * n, "speech_codes": [[1, 2]] * n, "action_tokens": [[2, 1]] * n}).encode()
    rows = [(i // 2, f"ep{i}", m, d) for i in range(5) for m, d in (("timeline.json", bytearray(timeline(i + 1))), ("note", bytearray(b"n")))]
    df = spark.createDataFrame(rows, "shard int, sample_key string, member string, data binary")
    wrote = shards.write_shards(df, "shard", str(tmp_path / "tars")).collect()
    assert sorted(r.samples for r in wrote) == [1, 2, 2]
    m = shards.with_position(shards.read_members(spark, str(tmp_path / "tars" / "*.tar")))
    assert {(r.shard_index, r.sample_index, r.sample_key) for r in m.collect()} == {(0, 0, "ep0"), (0, 1, "ep1"), (1, 0, "ep2"), (1, 1, "ep3"), (2, 0, "ep4")}
    assert shards.decode_units(m).count() == 15
    want = {f"ep{i}": hashlib.sha256(b"noten" + b"timeline.json" + timeline(i + 1)).hexdigest() for i in range(5)}
    assert {r.sample_key: r.content_sha256 for r in shards.content_hashes(m).collect()} == want


def test_shards_keep_any_bytes(spark, tmp_path):
    raw = bytes(range(256)) * 50 + b"\n\n"
    df = spark.createDataFrame([(i, f"a/k{i}", "wav", bytearray(raw[i:])) for i in range(3)], "shard int, sample_key string, member string, data binary")
    assert {r.bytes for r in shards.write_shards(df, "shard", str(tmp_path / "t")).collect()} == {len(raw) - i for i in range(3)}
    m = shards.read_members(spark, str(tmp_path / "t" / "*.tar"))
    assert {r.sample_key: bytes(r.data) for r in m.collect()} == {f"a/k{i}": raw[i:] for i in range(3)}
    lines = spark.createDataFrame([("k0", "x"), ("k9", "y")], "utterance_id string, text string")
    assert [(r.utterance_id, r.text) for r in shards.archive_utterances(m, lines).collect()] == [("k0", "x")]


def plain_trim(cells, splits):
    """One tick after the other, all errors summed anew."""
    now, cut = [c["ticks"] for c in cells], [0] * len(cells)

    def error():
        total = 0.0
        for dims in (("category", "language", "split"), ("category",), ("language",)):
            groups = {}
            for c, n in zip(cells, now):
                g = groups.setdefault(tuple(c[d] for d in dims), [0, 0])
                g[0], g[1] = g[0] + n, g[1] + c["target"]
            total += sum(((n - t) / max(t, 1.0)) ** 2 for n, t in groups.values())
        return total

    for split in splits:
        at = [i for i, c in enumerate(cells) if c["split"] == split]
        for _ in range(max(0, sum(now[i] - cells[i]["target"] for i in at))):
            best = None
            for i in (i for i in at if cut[i] < cells[i]["capacity"]):
                now[i] -= 1
                key = (round(error(), 12), *(cells[i][d] for d in ("category", "language")))
                now[i] += 1
                best = min(best, (key, i)) if best else (key, i)
            if best is None:
                break
            cut[best[1]] += 1
            now[best[1]] -= 1
    return cut


def test_trim_splits_against_plain_steps(spark):
    rng = random.Random(8)
    for _ in range(4):
        cells = [{"category": c, "language": g, "split": s, "ticks": rng.randint(20, 70), "target": rng.randint(15, 50), "capacity": rng.randint(0, 20)} for c in "abc" for g in ("en", "zh") for s in ("test", "train")]
        got = quotas.trim_splits(spark.createDataFrame(pd.DataFrame(cells)), ["train", "test"]).collect()
        have = {(r.category, r.language, r.split): r.cut for r in got}
        assert [have[c["category"], c["language"], c["split"]] for c in cells] == plain_trim(cells, ["train", "test"])


def test_stages_rerun_only_what_hangs_on_a_change(spark, tmp_path):
    """One changed file reruns the stages that read its source, and of those after them only the ones that get other rows."""
    files = tmp_path / "files"
    (files / "deep").mkdir(parents=True)
    (files / "a.txt").write_text("1\n2\n3\n")
    (files / "deep" / "b.txt").write_text("4\n")
    (tmp_path / "voices.txt").write_text("x\n")
    read = lambda p: spark.read.option("recursiveFileLookup", True).text(str(p)).select(F.trim("value").alias("v"))

    def job(least=2):
        sources = {n: (read(p), stages.source_digest(spark, str(p))) for n, p in (("items", files), ("voices", tmp_path / "voices.txt"))}
        spec = [
            stages.Stage("inventory", lambda t: t["items"].where(F.col("v") != ""), ["items"]),
            stages.Stage("large", lambda t: t["inventory"].where(F.col("v").cast("int") >= least), ["inventory"], {"least": least}),
            stages.Stage("voices_ready", lambda t: t["voices"].distinct(), ["voices"]),
            stages.Stage("manifest", lambda t: t["large"].crossJoin(t["voices_ready"].withColumnRenamed("v", "voice")), ["large", "voices_ready"]),
            stages.Stage("audit", lambda t: t["manifest"].agg(F.count("*").alias("n")), ["manifest"]),
        ]
        return stages.prepare(spark, str(tmp_path / "out"), sources, spec)

    every = ["inventory", "large", "voices_ready", "manifest", "audit"]
    first = job()
    assert first.ran == every and first.tables["audit"].first()["n"] == 3
    assert job().ran == []
    (files / "a.txt").write_text("1\n\n2\n3\n")  # another file, equal inventory rows
    assert job().ran == ["inventory"]
    (files / "deep" / "b.txt").write_text("0\n")
    assert job().ran == ["inventory", "large", "manifest", "audit"]
    (tmp_path / "voices.txt").write_text("x\ny\n")
    now = job()
    assert now.ran == ["voices_ready", "manifest", "audit"] and now.tables["audit"].first()["n"] == 4
    assert job(3).ran == ["large", "manifest", "audit"]
    assert job().ran == []  # the earlier recipe's tables are still there
    part = next(p for p in (tmp_path / "out").iterdir() if p.name.startswith("audit-") and not p.name.endswith(".digest"))
    for p in (tmp_path / "out").iterdir():
        if p.name.startswith("audit-") and (p / "_SUCCESS").exists() and not p.name.endswith(".digest"):
            (p / "_SUCCESS").unlink()  # as if the job had been lost half way
    assert job().ran == ["audit"] and part.exists()


def test_digests_do_not_hang_on_order(spark):
    df = spark.range(100).select("id", F.col("id").cast("string").alias("name"), F.sha2(F.col("id").cast("string"), 256).alias("digest"))
    assert stages.rows_digest(df) == stages.rows_digest(df.repartition(7).orderBy(F.rand(1))) != stages.rows_digest(df.where("id < 99"))
    assert stages.rows_digest(df.where("id > 5")) != stages.rows_digest(df.where("id > 5").unionByName(df.where("id = 9")))
    a, b = (stages.roll_up(x, [], "name", "digest").first()["digest"] for x in (df, df.orderBy(F.rand(2))))
    c = stages.roll_up(df.withColumn("name", F.when(F.col("id") == 3, "moved").otherwise(F.col("name"))), [], "name", "digest").first()["digest"]
    assert a == b != c


# ---- generation


def counting(path, refuse=(), fail=()):
    """A model that writes a line a call and a line a construction to ``path``."""

    def factory():
        with open(path, "a") as f:
            f.write("made\n")

        def call(text):
            with open(path, "a") as f:
                f.write(f"call {text}\n")
            if any(x in text for x in fail):
                raise ValueError(f"no {text}")
            return f"say {text}", 0.9 if any(x in text for x in refuse) else 0.1

        return call

    return factory


def test_generation_evaluates_each_content_once(spark, tmp_path):
    log = tmp_path / "calls"
    df = spark.createDataFrame([(f"k{i % 5}", f"t{i % 5}") for i in range(40)], "key string, text string").repartition(4)
    cache = spark.createDataFrame([("k4", "old", 0.0)], "key string, output string, score double")
    good, bad = adapters.generate(df, cache, counting(str(log), refuse=["t1"], fail=["t2"]), "key", "text")
    for _ in range(2):  # any number of uses
        assert {r["key"]: r["attempts"] for r in good.collect()} == {"k0": 1, "k3": 1, "k4": 0}
        assert {r["key"]: (r["attempts"], r["error"]) for r in bad.collect()} == {"k1": (2, None), "k2": (2, "no t2")}
        assert good.join(bad, "key").count() == 0
    calls = [x for x in log.read_text().split("\n") if x.startswith("call")]
    assert sorted(calls) == ["call t0", "call t1", "call t1", "call t2", "call t2", "call t3"]


def test_generation_job_keeps_receipts_and_refuses_stale_plans(spark, tmp_path):
    log = tmp_path / "calls"

    def factory():
        call = counting(str(log))()
        return lambda recipe: (*call(json.loads(recipe)["text"]), {"brief": 0.1, "endless": 99.0}.get(json.loads(recipe)["text"], 2.0))

    turns = spark.createDataFrame([("p1", "a", "hello", "v1"), ("p1", "b", "hello", "v1"), ("p2", "a", "brief", "v1"), ("p2", "b", "endless", "v2"), ("gone", "a", "hello", "v1"), ("p1", "c", "other", "v2")], "plan_id string, turn_id string, words string, voice string")
    plans = spark.createDataFrame([("p1", "h1"), ("p2", "h2")], "plan_id string, recipe_sha256 string")
    none = spark.createDataFrame([], "plan_id string, turn_id string, recipe_sha256 string, output string, score double, seconds double, attempts int")
    recipe = {"text": "words", "voice": "voice"}
    got, refused = adapters.generation_job(turns, plans, none, recipe, factory)
    rows = {(r["plan_id"], r["turn_id"]): r for r in got.collect()}
    assert set(rows) == {("p1", "a"), ("p1", "b"), ("p1", "c")} and rows["p1", "a"]["output"] == "say hello" and rows["p1", "a"]["seconds"] == 2.0
    assert {(r["plan_id"], r["turn_id"]): r["reason"] for r in refused.collect()} == {("p2", "a"): "duration 0.1 s", ("p2", "b"): "duration 99 s", ("gone", "a"): "stale plan"}
    assert log.read_text().count("call hello") == 1 and log.read_text().count("call brief") == 2
    log.write_text("")
    again, _ = adapters.generation_job(turns.where("plan_id = 'p1'"), plans, got, recipe, factory)
    assert again.count() == 3 and "call" not in log.read_text()
    changed, _ = adapters.generation_job(turns.where("plan_id = 'p1'"), plans.withColumn("recipe_sha256", F.lit("new")), got, recipe, factory)
    assert changed.count() == 3 and log.read_text().count("call") == 2  # hello once, other once


def test_encoder_is_made_once_a_partition(spark, tmp_path):
    log = tmp_path / "made"

    def factory():
        with open(str(log), "a") as f:
            f.write("made\n")
        return lambda frame: [len(frame)] * 3

    df = spark.createDataFrame([(e, i, [1.0] * 5) for e in range(50) for i in range(e % 4 + 1)], "e int, i int, w array<double>")
    got = {r["e"]: (r["codes"], r["error"]) for r in adapters.encode_episodes(df, factory, "e", "i", "w", 4, most=18).collect()}
    assert len(got) == 50 and got[0] == ([4] * 6, None) and got[3] == (None, "more than 18 codes")
    assert log.read_text().count("made") <= 8


# ---- streams


def drain(q, spark, name):
    q.processAllAvailable()
    q.stop()
    return spark.table(name)


def test_gate_refuses_without_moving_on(spark):
    rows = pd.DataFrame({"session_id": 1, "event_id": range(7), "unit_index": [0, 2, 1, 2, 2, 3, 4], "revision": [0, 0, 1, 0, 2, 1, 2]})
    assert sessions.gate_rows(rows, 0, 0)[0]["accepted"].tolist() == [True, False, True, False, True, False, False]


@pytest.mark.parametrize("kind", ["gate", "mode", "burst"])
def test_stream_equals_batch(spark, tmp_path, kind):
    u = units(spark, SF).select("session_id", "event_id", "unit_index", "revision", "speech").withColumn("unit_index", F.when(F.col("event_id") % 9 == 0, F.col("unit_index") + 1).otherwise(F.col("unit_index")))
    u = u.withColumn("tokens", F.when(F.col("event_id") % 3 == 0, F.array(F.lit(5), F.lit(1))).otherwise(F.array(F.lit(7), F.lit(8))))
    cut = u.agg(F.percentile_approx("event_id", 0.5)).first()[0]
    src = tmp_path / "in"
    for k, part in enumerate((u.where(F.col("event_id") <= cut), u.where(F.col("event_id") > cut))):
        part.coalesce(1).write.parquet(str(src / f"p{k}"))
    stream = spark.readStream.schema(u.schema).option("maxFilesPerTrigger", 1).parquet(str(src / "*"))
    run = {"gate": sessions.gate_stream, "mode": sessions.mode_stream, "burst": sessions.burst_stream}[kind]
    mode = "append"
    got = drain(run(stream).writeStream.format("memory").queryName(f"t_{kind}").outputMode(mode).option("checkpointLocation", str(tmp_path / "c")).start(), spark, f"t_{kind}")
    if kind == "gate":
        want = sessions.gate_batch(u)
    elif kind == "mode":
        want = layout.mode_runs(u, "session_id", ["event_id"], "speech").where("reset").select("session_id", "event_id")
    else:
        flat = u.select("session_id", "event_id", F.posexplode("tokens").alias("pos", "tok"))
        want = layout.assemble_bursts(flat, "session_id", ["event_id", "pos"], "tok").select("session_id", "tokens")
    key = lambda d: sorted(map(str, (tuple(r) for r in d.collect())))
    assert key(got) == key(want)


def test_repeated_units_and_buckets(spark, tmp_path):
    rows = [(1, 0, "2024-01-01 00:00:00"), (1, 0, "2024-01-01 00:00:01"), (1, 1, "2024-01-01 00:00:02")]
    df = spark.createDataFrame(rows, "s int, u int, t string").withColumn("t", F.to_timestamp("t"))
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    got = drain(sessions.first_units(stream, "t", ["s", "u"]).writeStream.format("memory").queryName("t_first").option("checkpointLocation", str(tmp_path / "c1")).start(), spark, "t_first")
    assert {(r.s, r.u) for r in got.collect()} == {(1, 0), (1, 1)} and got.count() == 2
    got = drain(sessions.clock_buckets(stream, "t", "2 seconds", "1 second", "s").writeStream.format("memory").outputMode("complete").queryName("t_tick").option("checkpointLocation", str(tmp_path / "c2")).start(), spark, "t_tick")
    assert sorted(r.n for r in got.collect()) == [1, 2]


# ---- adapters


def test_generation_calls_each_content_once(spark):
    def factory():
        seen = {}

        def call(t):
            if t == "boom":
                raise RuntimeError("x" * 2000)
            seen[t] = seen.get(t, 0) + 1
            return t.upper(), 0.1 if t != "bad" else 0.9

        return call

    df = spark.createDataFrame([("k1", "a"), ("k1", "a"), ("k2", "bad"), ("k3", "boom"), ("k4", "c")], "key string, text string")
    cache = spark.createDataFrame([("k4", "hit", 0.0)], "key string, output string, score double")
    good, bad = adapters.generate(df, cache, factory, "key", "text")
    assert {(r.key, r.output, r.attempts) for r in good.collect()} == {("k1", "A", 1), ("k4", "hit", 0)}
    assert {(r.key, r.attempts, len(r.error or "")) for r in bad.collect()} == {("k2", 2, 0), ("k3", 2, 1000)}


def test_encoding_isolates_failures(spark):
    def factory():
        def call(frame):
            if max(frame) > 1:
                raise ValueError("loud")
            return [len(frame)]

        return call

    df = spark.createDataFrame([(1, 0, [0.1] * 5), (1, 1, [0.1] * 4), (2, 0, [2.0])], "e int, i int, w array<double>")
    got = {r.e: (r.codes, r.error) for r in adapters.encode_episodes(df, factory, "e", "i", "w", 4).collect()}
    assert got == {1: ([4, 4, 4], None), 2: (None, "loud")}


def test_migration(spark):
    df = spark.createDataFrame([(4, None, "p"), (5, "e", "p"), (None, None, None)], "schema_version int, environment_id string, protocol_version string")
    good, bad = adapters.migrate_metadata(df, {"environment_id": "env", "protocol_version": "v"})
    r = good.first()
    assert (r.schema_version, r.environment_id, r.runtime_identity.protocol_version) == (5, "env", "p") and bad.count() == 2


def _two_files(rows, schema, spark, tmp_path):
    """The rows as a stream of one file a micro-batch, in the order of the list of lists."""
    for k, part in enumerate(rows):
        spark.createDataFrame(part, schema).withColumn("t", F.to_timestamp("t")).coalesce(1).write.parquet(str(tmp_path / "in" / f"p{k}"))
    kind = spark.read.parquet(str(tmp_path / "in" / "p0")).schema
    return spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))


def test_long_bursts_pass_whole(spark, tmp_path):
    rows = [[(1, 0, [8] * 5000, "2024-01-01 00:00:00")], [(1, 1, [9, 1, 7], "2024-01-01 00:00:01"), (2, 2, [2, 1], "2024-01-01 00:00:01")]]
    stream = _two_files(rows, "session_id long, event_id long, tokens array<int>, t string", spark, tmp_path)
    got = drain(sessions.burst_stream(stream, time_col="t").writeStream.format("memory").queryName("t_long").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start(), spark, "t_long")
    assert sorted((r.session_id, len(r.tokens)) for r in got.collect()) == [(1, 5002), (2, 2)]
    flat = spark.createDataFrame([x[:3] for part in rows for x in part], "session_id long, event_id long, tokens array<int>").select("session_id", "event_id", F.posexplode("tokens").alias("pos", "tok"))
    want = layout.assemble_bursts(flat, "session_id", ["event_id", "pos"], "tok")
    assert sorted((r.session_id, len(r.tokens)) for r in want.collect()) == [(1, 5002), (2, 2)]


def test_gate_state_expires_by_event_time(spark, tmp_path):
    day = lambda d: f"2024-01-{d:02d} 00:00:00"
    rows = [
        [(1, 0, 0, 0, day(1))],
        [(1, 1, 1, 1, day(1)), (2, 0, 0, 2, day(1))],
        [(9, 0, 0, 3, day(9))],  # moves the watermark a week on
        [(9, 1, 1, 4, day(9))],
        [(1, 2, 2, 5, day(1)), (1, 0, 0, 6, day(10))],  # a late row is dropped; the silent session starts anew
    ]
    stream = _two_files(rows, "session_id long, unit_index long, revision long, event_id long, t string", spark, tmp_path)
    got = drain(sessions.gate_stream(stream, "t").writeStream.format("memory").queryName("t_expire").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start(), spark, "t_expire")
    assert {r.event_id: r.accepted for r in got.collect()} == {0: True, 1: True, 2: True, 3: True, 4: True, 6: True}


def test_gate_over_batches_of_one_session(spark):
    df = spark.range(25_000).select((F.col("id") % 2).alias("session_id"), F.floor(F.col("id") / 2).alias("unit_index"), F.floor(F.col("id") / 2).alias("revision"), F.col("id").alias("event_id"))
    df = df.withColumn("unit_index", F.when(F.col("event_id") == 20_001, 0).otherwise(F.col("unit_index")))
    got = sessions.gate_batch(df).groupBy("session_id", "accepted").count().collect()
    assert {(r.session_id, r.accepted): r["count"] for r in got} == {(0, True): 12_500, (1, True): 10_000, (1, False): 2_500}


@pytest.mark.parametrize("down", [False, True])
def test_running_takes_any_sortable_key(spark, down):
    """Places equal those of a plain sort: 64-bit, string, decimal, time and mixed keys, nulls, ties in the first column."""
    import datetime
    import decimal

    rng = random.Random(5)
    rows = [
        (rng.choice(["a", "b", None]), (1 << 60) + i, "".join(rng.choice("abcé") for _ in range(3)) + str(i), decimal.Decimal((1 << 70) + i), datetime.datetime(2026, 1, 1) + datetime.timedelta(microseconds=i), rng.choice([None, 1, 2]))
        for i in range(200)
    ]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, big long, word string, dec decimal(38,0), at timestamp, tie int")
    for order in (["big"], ["word"], ["dec"], ["at"], ["tie", "word"]):
        got = {(r["k"], r["big"]): r["place"] for r in layout.running(df, ["k"], order, F.lit(1).cast("long"), "place", down).collect()}
        at = [df.columns.index(c) for c in order]
        for k in ("a", "b", None):
            mine = [r for r in rows if r[0] == k]
            mine.sort(key=lambda r: [r[i].encode() if isinstance(r[i], str) else r[i] for i in at[1:]])
            mine.sort(key=lambda r: r[at[0]].encode() if isinstance(r[at[0]], str) else r[at[0]] if r[at[0]] is not None else 0, reverse=down)
            mine.sort(key=lambda r: r[at[0]] is None)
            assert [got[k, r[1]] for r in mine] == list(range(len(mine))), order
    everything = layout.numbered(df, [], ["big"], "place").collect()
    assert all(r["place"] == r["big"] - (1 << 60) for r in everything)
    assert layout.numbered(df.limit(0), ["k"], ["big"], "place").count() == 0


def test_shards_roll_and_leave_nothing_behind_on_failure(spark, tmp_path):
    rows = [(f"s{i:03d}", m, bytearray(bytes([i]) * (10 + i)), i) for i in range(60) for m in ("a.bin", "b.bin")]
    df = spark.createDataFrame(rows, "sample_key string, member string, data binary, units int").repartition(3)
    path = str(tmp_path / "t")
    listed, files = shards.write_samples(df, path, max_bytes=300, max_samples=4, tasks=3)
    got = {r["sample_key"]: r for r in listed.collect()}
    for i in range(60):
        r = got[f"s{i:03d}"]
        assert r["units"] == i and r["bytes"] == 2 * (10 + i) and r["content_sha256"] == hashlib.sha256(b"a.bin" + bytes([i]) * (10 + i) + b"b.bin" + bytes([i]) * (10 + i)).hexdigest()
    sizes = {r["shard"]: (r["samples"], r["bytes"]) for r in files.collect()}
    assert len(sizes) >= 15 and sum(n for n, _ in sizes.values()) == 60 and all(n <= 4 for n, _ in sizes.values())
    assert sorted(p.name for p in (tmp_path / "t").glob("*.tar")) == sorted(sizes) and not (tmp_path / "t" / "_temporary").exists()
    shards.write_samples(df.withColumn("sample_key", F.concat(F.lit("more"), "sample_key")), path)  # a second job adds to the first
    assert shards.read_members(spark, f"{path}/*.tar").select("sample_key").distinct().count() == 120
    wrong = spark.createDataFrame([*rows, (None, "a.bin", bytearray(b"x"), 0)], df.schema)
    with pytest.raises(Exception, match="needs a sample key"):
        shards.write_samples(wrong, str(tmp_path / "u"), tasks=2)
    assert not (tmp_path / "u").exists() or not [p for p in (tmp_path / "u").rglob("*") if p.is_file()]


def test_reader_projects_members_and_expands_braces(spark, tmp_path):
    assert tars.braces("a{1,2}-{08..10}.tar") == [f"a{i}-{j}.tar" for i in (1, 2) for j in ("08", "09", "10")]
    assert tars.braces("{q}/{x,{y,z}}") == ["{q}/x", "{q}/y", "{q}/z"] and tars.braces("plain") == ["plain"]
    df = spark.createDataFrame([(i, f"k{i}", m, bytearray(b"d")) for i in range(4) for m in ("a", "b")], "shard int, sample_key string, member string, data binary")
    path = str(tmp_path / "t")
    shards.write_shards(df, "shard", path)
    some = shards.read_members(spark, f"{path}/{{000000,000001,00000*}}.tar")
    assert some.select("shard").distinct().count() == 4 and some.rdd.getNumPartitions() == 4
    assert {(r["sample_key"], r["shard_index"]) for r in shards.read_members(spark, f"{path}/00000{{2..3}}.tar", ("a",)).collect()} == {("k2", 0), ("k3", 1)}
    x = shards.read_members(spark, f"{path}/*.tar").where("member = 'a'")
    assert x.count() == 4 and "(member#" in (plan := x._jdf.queryExecution().executedPlan().toString()) and "= a" not in plan  # the reader answers it
    assert spark.read.format("tar_shards").load(f"{path}/*.tar").where("member = 'a'").count() == 4
    with pytest.raises(Exception, match="no shard matches"):
        shards.read_members(spark, f"{path}/none*.tar").count()


def test_array_members_decode_by_column(spark, tmp_path):
    import io

    import numpy as np

    def npz(**a):
        out = io.BytesIO()
        np.savez(out, **a)
        return bytearray(out.getvalue())

    def npy(a):
        out = io.BytesIO()
        np.save(out, a)
        return bytearray(out.getvalue())

    codes = np.arange(24, dtype=np.uint16).reshape(3, 4, 2)
    rows = [("good", "timeline.npz", npz(t=np.array([0, 80, 160]), mask=np.array([[True, False]] * 3))), ("good", "codes.npy", npy(codes)), ("good", "mic.flac", bytearray(b"...")),
            ("short", "timeline.npz", npz(t=np.array([0, 80]), mask=np.ones((2, 2), bool))), ("short", "codes.npy", npy(codes)), ("lacks", "timeline.npz", npz(t=np.array([0])))]
    m = spark.createDataFrame(rows, "sample_key string, member string, data binary")
    spec = {"t": ("timeline.npz", "t", "long"), "mask": ("timeline.npz", "mask", "array<boolean>"), "codes": ("codes.npy", None, "array<array<int>>")}
    shards.write_samples(m, str(tmp_path / "t"), tasks=1)
    got = shards.decode_units(shards.read_members(spark, str(tmp_path / "t" / "*.tar")), spec).collect()
    good = sorted((r for r in got if r["error"] is None), key=lambda r: r["unit_index"])
    assert [(r["t"], r["mask"], r["codes"]) for r in good] == [(80 * i, [True, False], codes[i].tolist()) for i in range(3)]
    assert {r["sample_key"]: r["error"].split(":")[0] for r in got if r["error"]} == {"short": "arrays of different lengths", "lacks": "KeyError"}


def test_receipts_of_late_repeated_and_expired_rows(spark, tmp_path):
    """Batches of a stream: repeats and gaps leave with their reason, late rows not at all, a silent session starts anew."""
    import datetime

    at = lambda h, m=0: datetime.datetime(2026, 1, 1) + datetime.timedelta(hours=h, minutes=m)
    cols = "session_id long, event_id long, unit_index long, revision long, actuated boolean, ts timestamp"
    batches = [
        [(1, 1, 0, 0, True, at(0)), (1, 2, 0, 0, True, at(0, 1)), (1, 3, 2, 0, True, at(0, 2)), (2, 4, 0, 5, True, at(0))],
        [(1, 5, 1, 0, False, at(0, 3)), (1, 6, 1, 0, True, at(0, 4)), (2, 7, 1, 4, True, at(0, 5)), (2, 8, None, 4, True, at(0, 6))],
        [(3, 9, 0, 0, True, at(60))],  # moves the watermark past the first sessions' silence
        [(1, 10, 2, 0, True, at(1))],  # too late
        [(1, 11, 2, 0, True, at(61)), (1, 12, 0, 0, True, at(61, 1))],
    ]
    src = tmp_path / "in"
    src.mkdir()
    run = sessions.receipts_stream(spark.readStream.schema(cols).parquet(str(src)), "ts", keep_ms=3600 * 1000)
    q = run.writeStream.format("memory").queryName("t_receipts").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        for i, b in enumerate(batches):
            spark.createDataFrame(b, cols).coalesce(1).write.parquet(str(tmp_path / f"b{i}"))
            for f in (tmp_path / f"b{i}").glob("part-*"):
                f.rename(src / f"{i}.parquet")
            q.processAllAvailable()
        got = {r["event_id"]: r["reason"] for r in spark.table("t_receipts").collect()}
    finally:
        q.stop()
    assert got == {1: None, 2: "repeated", 3: "gap", 4: None, 5: "actuation", 6: None, 7: "revision", 8: "gap", 9: None, 11: "gap", 12: None}


def test_receipts_stream_equals_batch(spark, tmp_path):
    u = units(spark, SF).select("session_id", "event_id", (F.col("unit_index") - (F.col("event_id") % 13 == 0).cast("int")).cast("long").alias("unit_index"), F.col("revision").cast("long").alias("revision"), (F.col("event_type") != "error").alias("actuated"), "ts")
    u.repartition(4).write.parquet(str(tmp_path / "in"))
    run = sessions.receipts_stream(spark.readStream.schema(u.schema).parquet(str(tmp_path / "in")), "ts")
    got = drain(run.writeStream.format("memory").queryName("t_receipts_all").option("checkpointLocation", str(tmp_path / "c")).start(), spark, "t_receipts_all")
    key = lambda d: sorted(map(str, (tuple(r) for r in d.collect())))
    assert key(got) == key(sessions.receipts_batch(u))


def test_normalised_waves_and_rejects(spark):
    import math

    import numpy as np

    tone = [math.sin(i / 7) for i in range(480)]
    rows = [(1, tone, 48_000, 1), (2, [x for v in tone for x in (v, -v)], 24_000, 2), (3, [x for v in tone for x in (v, v)], 24_000, 2), (4, [0.0] * 10, 24_000, 1), (5, [], 24_000, 1), (6, None, 24_000, 1), (7, [float("nan")], 24_000, 1), (8, tone, 0, 1), (9, tone[:3], 24_000, 2), (10, [1.0] + [0.0] * 9999, 24_000, 1), (11, tone, 8_000, 1)]
    df = spark.createDataFrame(rows, "i int, w array<double>, r int, c int")
    good, bad = audio.normalise(df, "w", "r", "c", seconds=0.05, kind="double")
    got = {r["i"]: np.array(r["normal"]) for r in good.collect()}
    assert {r["i"]: r["reason"] for r in bad.collect()} == {2: "silent", 4: "silent", 5: "empty", 6: "empty", 7: "not finite", 8: "rate or channels", 9: "rate or channels"}
    assert {i: len(w) for i, w in got.items()} == {1: 240, 3: 480, 10: 1200, 11: 1200}
    assert abs(np.sqrt(np.mean(got[3] ** 2)) - 10 ** (-23 / 20)) < 1e-9 and abs(np.abs(got[10]).max() - 10 ** (-1 / 20)) < 1e-9
    assert np.allclose(got[1] / got[1][1], np.array(tone)[::2] / tone[2]) and np.allclose(got[11][3::3] / got[11][3], np.array(tone)[1:400] / tone[1])


def test_voices_by_language_split_and_role(spark):
    voices = spark.createDataFrame([("a", "en", "user", "train"), ("b", "multilingual", "user", "train"), ("c", "zh", "user", None), ("z", "en", "assistant", None)], "voice string, language string, role string, split string")
    turns = spark.createDataFrame([(i, r, lang, s) for i in range(3) for r in ("user", "assistant") for lang in ("en", "zh") for s in ("train", "test")], "i int, role string, language string, split string")
    got = {(r["i"], r["role"], r["language"], r["split"]): (r["voice"], r["fault"]) for r in joins.pick_voices(turns, voices, "i", ["train", "test"]).collect()}
    assert len(got) == 24
    for (i, role, language, split), (voice, fault) in got.items():
        pool = ["z"] if role == "assistant" else {("en", "train"): ["a", "b"], ("zh", "train"): ["b", "c"], ("zh", "test"): ["c"], ("en", "test"): []}[language, split]
        assert (voice, fault) == ((pool[i % len(pool)], None) if pool else (None, "no voice"))


def test_id_sets_by_marks(spark):
    a = spark.createDataFrame([("x", i) for i in range(50)] + [("y", i) for i in range(9)] + [("y", 3)], "k string, v int")
    assert aggregates.set_differences(a, a.orderBy(F.rand(1)), ["k"], "v").count() == 0
    b = a.where("not (k = 'x' and v = 7)").unionByName(spark.createDataFrame([("z", 1)], a.schema))
    assert {tuple(r) for r in aggregates.set_differences(a, b, ["k"], "v").collect()} == {("x", 7, "missing"), ("z", 1, "extra")}


def test_written_manifests_are_in_order(spark, tmp_path):
    rows = [(f"i{i:04d}", ["train", "test"][i % 3 == 0], i * 7 % 101) for i in range(300)]
    df = spark.createDataFrame(rows, "item string, split string, size int").repartition(5)
    records.write_manifests(df, "split", ["size", "item"], str(tmp_path / "m"), ["train", "test"])
    read = lambda p: [json.loads(x) for f in sorted(p.glob("part-*")) for x in f.read_text().splitlines()]
    want = {s: [i for i, _, _ in sorted((r for r in rows if r[1] == s), key=lambda r: (r[2], r[0]))] for s in ("train", "test")}
    for s in want:
        got = read(tmp_path / "m" / "by" / f"split={s}")
        assert [x["item"] for x in got] == want[s] and [x["ordinal"] for x in got] == list(range(len(got)))
    got = read(tmp_path / "m" / "all")
    assert [x["item"] for x in got] == want["train"] + want["test"] and [x["place"] for x in got] == list(range(300))


def test_split_manifests_keep_their_order_where_sorts_spill(spark, tmp_path):
    conf, name = spark._jsc.sc().conf(), "spark.shuffle.spill.numElementsForceSpillThreshold"
    df = spark.range(6_000).select(F.col("id").alias("item"), F.element_at(F.array(F.lit("train"), F.lit("test")), (F.col("id") % 2 + 1).cast("int")).alias("split"))
    try:
        conf.set(name, "100")
        records.write_manifests(df, "split", ["item"], str(tmp_path / "m"), ["train", "test"])
    finally:
        conf.remove(name)
    for s in ("train", "test"):
        got = [json.loads(x)["ordinal"] for f in sorted((tmp_path / "m" / "by" / f"split={s}").glob("part-*")) for x in f.read_text().splitlines()]
        assert got == list(range(3_000)), s


def test_unit_rows_have_all_columns_of_a_timeline(spark):
    got = LOADED[0]["s8_unit_rows"](spark, SF)
    assert got.columns == ["sample_key", "unit_index", "timestamp_ms", "delta_ms", "speech_mode", "codes", "tokens"]
    assert {r["delta_ms"] for r in got.select("delta_ms").distinct().collect()} == {80}


def test_small_shards_share_tasks(spark, tmp_path):
    """300 shards of a sample each, read by few tasks, at the places they have alone; units packed over small batches."""
    units = spark.range(1_500).selectExpr("concat('k', lpad(cast(id % 300 as string), 3, '0')) key", "cast(-id as int) i", "cast(id as int) a", "array(cast(id as int), 7) b")
    have = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
        m = shards.pack_units(units, "key", "i", ["a", "b"]).select("*", F.substring("sample_key", 2, 3).cast("long").alias("shard"))
        shards.write_shards(m, "shard", str(tmp_path / "t"))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", have)
    x = shards.read_members(spark, str(tmp_path / "t" / "*.tar"))
    assert x.rdd.getNumPartitions() <= 40
    assert {(r["sample_key"], r["shard_index"], r["sample_index"]) for r in x.select("sample_key", "shard_index", "sample_index").collect()} == {(f"k{i:03d}", i, 0) for i in range(300)}
    got = shards.decode_units(x, {"a": ("timeline.npz", "a", "int"), "b": ("timeline.npz", "b", "array<int>")}).collect()
    assert sorted((r["sample_key"], r["unit_index"], r["a"], tuple(r["b"]), r["error"]) for r in got) == [(f"k{k:03d}", u, v, (v, 7), None) for k in range(300) for u, v in enumerate(range(1_200 + k, -1, -300))]


def test_patterns_name_files_once(tmp_path):
    for x in ("a/1.tar", "a/2.tar", "b/1.tar", "b/c/3.tar", "x.tar"):
        (tmp_path / x).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / x).touch()
    d = str(tmp_path)
    named = lambda p: [x.replace(d, "") for x in tars.expand(p)]
    assert named(f"{d}/*.tar") == ["/x.tar"] and named(f"{d}/*/*.tar") == ["/a/1.tar", "/a/2.tar", "/b/1.tar"]
    assert named(f"file://{d}/{{a,b}}/[12].tar") == ["file:///a/1.tar", "file:///a/2.tar", "file:///b/1.tar"]
    assert named(f"{d}/{{x,x}}.tar") == ["/x.tar"] and named(f"{d}/none/*.tar") == []

"""Private data, passages, quality, toxicity, SimHash and decontamination against plain versions."""

import hashlib
import random
import re
import time
import zlib
from pathlib import Path

import numpy as np
import pandas as pd
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cuewright.llm import decontam, passages, pii, quality, queries, simhash, toxicity
from cuewright.llm.common import table

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "the of erin thonti anor blehe ingst reed ontion hathe winter orly shend thing eredan".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(WORDS) for _ in range(n))


def docs_frame(spark, texts, extra=""):
    rows = [(i if i is None else int(i), t, "en", "src0", None if t is None else len(t)) for i, t in texts]
    return spark.createDataFrame(rows, DOCS)


def odd_rows(rng):
    """Nulls, empty, white space, a very long text, repeated rows, controls and wide characters."""
    long = prose(rng, 6000)
    return [(1, None), (2, ""), (3, " \n\t "), (4, long), (4, long), (5, "short"), (None, prose(rng, 30)), (6, "a\x00b \U0001f600 é" + prose(rng, 20)), (7, prose(rng, 40))]


# ---- private data

PLAIN = {
    0: r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    1: r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    2: r"[0-9]([\x20-]?[0-9])+",
    3: r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    out = []
    for k, p in PLAIN.items():
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            ok = {0: lambda: True, 1: lambda: all(int(x) <= 255 for x in m[0].split(".")), 2: lambda: 16 <= len(d) <= 19 and pii.luhn(d), 3: lambda: 8 <= len(d) <= 15}[k]()
            if ok:
                out.append((k, m.start(), m.end()))
    return out


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab.-@+ ()0159%é_", max_size=60))
def test_rules_equal_the_plain_patterns(text):
    assert pii.rule_spans(text) == plain_spans(text)


def test_luhn():
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")


def test_pruned_decoding_is_the_full_path():
    r = np.random.default_rng(1)
    a = r.normal(0, 2, (pii.TAGS, pii.TAGS)).astype(np.float32)
    a[0, 0] += 2
    for _ in range(200):
        e = r.normal(0, 3, (int(r.integers(1, 30)), pii.TAGS)).astype(np.float32)
        e[:, 0] += r.uniform(0, 5)
        path = pii.viterbi(e, a, None, None)
        cut = np.flatnonzero(np.r_[True, path[1:] != path[:-1], True])
        assert pii.decode(e, a) == [(int(path[x]) - 1, int(x), int(y)) for x, y in zip(cut, cut[1:]) if path[x]]


def test_gradients():
    net = pii.Net.new(1)
    for name, p in zip("xuwba", net.params()):
        setattr(net, name, p.astype(np.float64))
    r = np.random.default_rng(0)
    ids, tags = r.integers(1, 130, (6, 3)).astype(np.int32), r.integers(0, pii.TAGS, (6, 3))
    _, grads = pii.loss_and_grads(net, ids, tags)
    for name, g in zip("xuwba", grads):
        p, j = getattr(net, name), np.unravel_index(np.abs(g).argmax(), g.shape)
        was = p[j]
        p[j] = was + 1e-4
        up = pii.loss_and_grads(net, ids, tags)[0]
        p[j] = was - 1e-4
        down = pii.loss_and_grads(net, ids, tags)[0]
        p[j] = was
        assert abs((up - down) / 2e-4 - g[j]) < 1e-3 * max(1, abs(g[j]))


def test_private_data_end_to_end(spark):
    docs = table(spark, SF, "documents")
    rng = random.Random(4)
    odd = docs_frame(spark, odd_rows(rng) + [(8, "mail jo.do@x-y.example.com or 10.0.0.255, 300.1.1.1; +1 (555) 010-0199; 4111 1111 1111 1111")])
    net = pii.fit(docs)
    for frame in (docs, odd, docs.limit(0)):
        got = pii.digest(frame, net).toPandas()
        want = frame.toPandas()
        assert sorted(got["base_sha256"]) == sorted(pii.digest_of(t) for t in want["text"])
        by_id = dict(zip(want["doc_id"], want["text"]))
        for r in got.itertuples():
            if pd.isna(r.doc_id):
                continue
            base = plain_spans(by_id[r.doc_id])
            said = [tuple(x.split(":")) for x in r.spans.split(",") if x]
            assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == k for s in base) for k in range(4)]
            assert {(pii.KINDS[k], str(a), str(b)) for k, a, b in base} <= set(said) and len(said) == len(base) + r.n_added
    made = np.random.default_rng(9)
    spelled = [pii.generated(made) for _ in range(200)]
    found = pii.model_spans(net, [f"the of and {s} that erin" for _, s in spelled])
    assert sum((k, 11, 11 + len(s)) in f for (k, s), f in zip(spelled, found)) >= 150
    masked = pii.redact(odd, net=net).where("doc_id = 8").first().text
    assert masked == "mail <email> or <ip>, 300.1.1.1; <phone>; <card>"


def test_windows_cover_every_character():
    for n in (0, 1, 511, 512, 513, 5000):
        s = pii.window_starts(n)
        assert (n == 0) == (not s)
        seen = np.zeros(n, bool)
        for a in s:
            seen[a : a + pii.WINDOW] = True
        assert seen.all()


# ---- passages


def test_passages_against_brute_force(spark):
    rng = random.Random(7)
    shared = [prose(rng, 60) for _ in range(4)]
    texts = []
    for i in range(30):
        own = [prose(rng, rng.randint(20, 90)) for _ in range(3)]
        if i < 12:
            own.insert(rng.randint(0, 3), shared[i % 4])
        texts.append((i, " ".join(own) if i % 2 else "\n".join(own)))
    base = prose(rng, 80).split()
    near = list(base)
    near[40] = "changed"
    texts += [(100, " ".join(base)), (101, " ".join(near)), (102, None), (103, ""), (104, shared[0]), (104, shared[0])]
    got = passages.repeated_passages(docs_frame(spark, texts)).toPandas()
    flagged = set(got["doc_id"])
    assert flagged == set(range(12)) | {100, 101, 104}
    assert set(got[got["removed"]]["doc_id"]) == {i for i in range(4, 12)} | {101, 104}
    by_id = dict(texts)
    for r in got.itertuples():
        part = by_id[r.doc_id][r.start : r.end]
        assert len(passages.WORD.findall(part)) == r.n_words >= passages.MIN_WORDS
    line = got[got["doc_id"] == 101].iloc[0]
    assert (line.start, line.end, line.first_doc_id) == (0, len(" ".join(near)), 100)
    kept = {r.doc_id: r.text for r in passages.remove_passages(docs_frame(spark, texts)).collect()}
    assert kept[101] == "" and kept[102] is None and kept[0] == by_id[0]
    assert passages.repeated_passages(docs_frame(spark, texts).limit(0)).count() == 0


def test_passages_survive_odd_rows_and_crowded_buckets(spark):
    rng = random.Random(3)
    base = prose(rng, 40).split()
    crowd = []
    for i in range(400):
        w = list(base)
        w[rng.randrange(40)] = f"x{i}"
        crowd.append((1000 + i, " ".join(w)))
    got = passages.repeated_passages(docs_frame(spark, odd_rows(rng) + crowd)).toPandas()
    assert set(got["doc_id"]) == {i for i, _ in crowd}
    assert got["first_doc_id"].min() == 1000


def test_piece_cuts_do_not_depend_on_neighbours():
    rng = random.Random(5)
    body = prose(rng, 80)
    keys = []
    for left, right in (("", ""), (prose(rng, 33), prose(rng, 7)), (prose(rng, 4), prose(rng, 50))):
        p = passages.paragraphs([prose(rng, 9), f"{left} {body} {right}".strip()])
        keys.append(set(p[6][(p[0] == 1) & ~p[1]].tolist()))
    assert len(keys[0] & keys[1] & keys[2]) >= 4


# ---- SimHash


def plain_fingerprint(text):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = [x for x in re.split("[\x20\x09-\x0d]+", t) if x]
    if not w:
        return 0
    s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def plain_components(ids, fps):
    root = list(range(len(ids)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                root[find(i)] = find(j)
    low = {}
    for i, d in enumerate(ids):
        low[find(i)] = min(low.get(find(i), d), d)
    return [low[find(i)] for i in range(len(ids))]


def test_simhash_against_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in table(spark, SF, "documents").collect()]
    rows += [(10_000, None), (10_001, ""), (10_002, " \n"), (10_003, "One"), (10_004, "one"), (10_005, "A b\tC"), (10_006, "a\nB\x0bc")]
    got = simhash.near_duplicates(docs_frame(spark, rows)).toPandas().sort_values("doc_id")
    ids, fps = zip(*sorted((d, plain_fingerprint(t)) for d, t in rows))
    assert [x % 2**64 for x in got["fp"]] == list(fps)
    assert got["component_id"].tolist() == plain_components(ids, fps)


def test_vantage_shards_find_every_pair():
    r = np.random.default_rng(2)
    base = r.integers(0, 2**63, 150).astype(np.uint64)
    more = [b ^ np.uint64(1 << int(i)) ^ np.uint64(1 << int(j)) for b in base[:60] for i, j in r.integers(0, 64, (4, 2))]
    fps = np.unique(np.r_[base, np.array(more, np.uint64)])
    nodes = simhash.build_tree(fps, 16)
    assert len(nodes) > 3
    row, leaf, home = simhash.route(fps, nodes, 2)
    assert (np.bincount(row, weights=home) == 1).all()
    found = set()
    for k in np.unique(leaf):
        a, b = simhash.leaf_pairs(fps[row[leaf == k]], home[leaf == k], 2)
        for x, y in zip(a.tolist(), b.tolist()):
            assert (x, y) not in found
            found.add((x, y))
    want = {(int(x), int(y)) for x in fps for y in fps if x > y and (int(x) ^ int(y)).bit_count() <= 2}
    assert found == want


def test_keep_first_keeps_columns_and_null_ids(spark):
    rows = [(3, "a b c d"), (2, "a b c d"), (2, "a b c d"), (None, "a b c d"), (9, "other words here now")]
    df = docs_frame(spark, rows).withColumn("fp", F.lit("mine")).withColumn("component_id", F.lit(1))
    got = simhash.keep_first(df)
    assert got.columns == df.columns
    assert sorted((r.doc_id or -1) for r in got.collect()) == [-1, 2, 9]
    assert simhash.keep_first(df.limit(0)).count() == 0


# ---- decontamination


def plain_share(part, have):
    """Share of a part's five-word shingles in a list of words; fewer than five words stand there together or not."""
    n = min(5, len(part))
    runs = lambda w: {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
    return len(runs(part) & runs(have)) / len(runs(part)) if part else 0.0


def plain_hit(have, item, step):
    """The largest share of an item in windows of three steps that hold 0.8 of it and half of its question, or None."""
    w, (question, _) = decontam.words(item), decontam.split_item(item)
    windows = [have[a : a + 3 * step] for a in range(0, max(1, len(have)), step)]
    ok = [plain_share(w, x) for x in windows if w and plain_share(w, x) >= 0.8 and plain_share(question, x) >= 0.5]
    return max(ok, default=None)


def test_decontamination_against_brute_force(spark):
    rng = random.Random(11)
    items = [(i, f"{prose(rng, rng.randint(4, 50))}\n{prose(rng, rng.randint(1, 9))}") for i in range(40)] + [(40, None), (41, ""), (42, "two words"), (43, "two words")]
    texts = []
    for i in range(60):
        parts = [prose(rng, rng.randint(5, 120))]
        if i % 3 == 0:
            w = items[rng.randrange(40)][1].split()
            drop = rng.choice([0, 0, 1, len(w) // 4, len(w) // 2])
            parts.append(" ".join(w[drop:]).upper())
        parts.append(prose(rng, rng.randint(1, 300)))
        texts.append((i, " ".join(parts)))
    # an item of under five words counts wherever it stands as a whole: before, only a document that was the item itself did
    texts += [(90, "just two words here"), (91, None), (92, ""), (93, "two other words"), (None, items[3][1])]
    got = decontam.contaminated(docs_frame(spark, texts), spark.createDataFrame(items, "item_id long, text string")).toPandas()
    want = {}
    for d, t in texts:
        have = decontam.words(t)
        for i, x in items:
            best = plain_hit(have, x, max(len(decontam.words(y)) for _, y in items))
            if best is not None:
                want[d, i] = best
    assert {(None if pd.isna(r.doc_id) else r.doc_id, r.item_id): round(r.overlap, 9) for r in got.itertuples()} == {k: round(v, 9) for k, v in want.items()}
    assert len(want) > 10
    kept = decontam.drop_contaminated(docs_frame(spark, texts), spark.createDataFrame(items, "item_id long, text string"))
    assert {r.doc_id for r in kept.collect()} == {d for d, _ in texts} - {d for d, _ in want if d is not None}


def test_decontamination_slices_and_empty_benchmark(spark, monkeypatch):
    docs, items = table(spark, SF, "documents"), table(spark, SF, "benchmark")
    one = sorted(map(tuple, decontam.contaminated(docs, items).select("doc_id", "item_id").collect()))
    monkeypatch.setattr(decontam, "SLICE_ITEMS", 7)
    many = sorted(map(tuple, decontam.contaminated(docs, items).select("doc_id", "item_id").collect()))
    assert one == many and one
    assert decontam.contaminated(docs, items.limit(0)).count() == 0


def test_scores_do_not_hang_on_slices(spark, monkeypatch):
    docs, items = table(spark, SF, "documents"), table(spark, SF, "benchmark")
    read = lambda: sorted(map(tuple, decontam.contaminated(docs, items).drop("verified").collect()))
    one = read()
    monkeypatch.setattr(decontam, "SLICE_ITEMS", 5)
    many = read()
    assert len(one) == len(many) and one and np.allclose([r[2:] for r in one], [r[2:] for r in many]) and [r[:2] for r in one] == [r[:2] for r in many]


def test_short_items_count_inside_sentences(spark):
    items = [(1, "capital of france"), (2, "yes"), (3, "Name the river?\nThe Loire")]
    texts = [(1, "Paris is the capital of France, as all know"), (2, "of france the capital"), (3, "name the river? the loire it is"), (4, "the loire alone"), (5, "yes"), (6, "name the river please")]
    got = decontam.contaminated(docs_frame(spark, texts), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in got.collect()} == {(1, 1), (3, 3), (5, 2)}


def test_short_questions_and_answers_overlap(spark):
    rng = random.Random(12)
    q = prose(rng, 30)
    items = [(1, f"{q}\nforty two"), (2, f"why so\n{q}"), (3, f"{q}\nnot there")]
    texts = [(1, f"{prose(rng, 40)} why so {q} forty two {prose(rng, 40)}"), (2, f"{q} two forty not")]
    got = decontam.contaminated(docs_frame(spark, texts), spark.createDataFrame(items, "item_id long, text string"))
    have = {(r.doc_id, r.item_id): (r.question_overlap, r.answer_overlap) for r in got.collect()}
    assert have == {(1, 1): (1.0, 1.0), (1, 2): (1.0, 1.0), (1, 3): (1.0, 0.0), (2, 1): (1.0, 0.0), (2, 3): (1.0, 0.0)}  # (2, 2) has the answer without its question


# ---- learned scores


def auc(score, y):
    a, b = score[y == 1], score[y == 0]
    return float(np.mean((a[:, None] > b[None]) + 0.5 * (a[:, None] == b[None])))


def held(spark, sf, label, folds, fold, run):
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    got = run(docs, labels).toPandas().merge(labels.toPandas(), on="doc_id")
    out = np.array([zlib.crc32(str(d).encode()) % folds == fold for d in got["doc_id"]])
    return got["score"].to_numpy()[out], got[label].to_numpy()[out]


def test_quality_on_held_out_rows(spark):
    s, y = held(spark, "/root/testdata/sf0.1", "quality", 4, 2, lambda d, l: quality.score(d, quality.train(d, l, ~quality.held_out("doc_id", 4, 2))))
    assert auc(s, y) > 0.97 and (s[y == 1] >= 0.7).mean() > 0.95 and (s[y == 0] >= 0.7).mean() < 0.15


def test_toxicity_on_held_out_rows(spark):
    s, y = held(spark, "/root/testdata/sf0.1", "toxic", 5, 0, lambda d, l: toxicity.score(d, toxicity.train(d, l, ~quality.held_out("doc_id", 5, 0))))
    assert auc(s, y) > 0.85 and (s[y == 0] >= 0.5).mean() < 0.05


def test_risk_and_its_gradient_against_a_plain_version():
    """The unbiased risk by its formula, its gradient by differences, and the step back where the second part is negative."""
    r, seen = np.random.default_rng(2), set()
    for k in range(30):
        xp, xu = r.normal(k % 3, 1, (40, 5)), r.normal(0, 1, (60, 5))
        w, b, prior = r.normal(0, 0.3 * (1 + k % 4), 5), r.normal(), 0.3 + 0.6 * r.random()
        p, u = 1 / (1 + np.exp(-(xp @ w + b))), 1 / (1 + np.exp(-(xu @ w + b)))
        first, second = prior * np.mean(-np.log(p)), np.mean(-np.log(1 - u)) - prior * np.mean(-np.log(1 - p))
        got = quality.risk(xp, xu, w, b, prior)
        assert np.allclose(got, (first, second), atol=1e-6)
        part = (lambda v: sum(quality.risk(xp, xu, v[:-1], v[-1], prior))) if second >= 0 else (lambda v: -quality.risk(xp, xu, v[:-1], v[-1], prior)[1])
        at, eye = np.r_[w, b], np.eye(6) * 1e-5
        want = [(part(at + e) - part(at - e)) / 2e-5 for e in eye]
        assert np.allclose(quality.risk_gradient(xp, xu, w, b, prior), want, atol=1e-5)
        seen.add(second >= 0)
    assert seen == {True, False}


def test_quality_whatever_share_is_labelled(spark):
    """All, half or few rows labelled: held-out rows are told apart each time, and labels outside the learning rows change nothing."""
    docs, labels = table(spark, "/root/testdata/sf0.1", "documents"), table(spark, "/root/testdata/sf0.1", "labels")
    out = quality.held_out("doc_id", 4, 2)
    full = docs.join(labels.select("doc_id"), "doc_id", "left_semi")
    half = full.unionByName(docs.join(labels, "doc_id", "left_anti").where(F.col("doc_id") % 3 == 0))
    for d in (full, half, docs):
        x = quality.score(d, quality.train(d, labels, ~out)).join(labels, "doc_id").where(out).toPandas()
        s, y = x["score"].to_numpy(), x["quality"].to_numpy()
        assert auc(s, y) > 0.98 and (s[y == 1] >= 0.7).mean() > 0.9 and (s[y == 0] >= 0.7).mean() < 0.05
    a = quality.train(docs, labels, ~out)
    b = quality.train(docs, labels.withColumn("quality", F.when(out, 1 - F.col("quality")).otherwise(F.col("quality"))).where(~out | (F.col("doc_id") % 2 == 0)), ~out)
    assert np.array_equal(a.weights, b.weights) and a.prior == b.prior
    many = full.limit(50).unionByName(full.limit(1).withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(5000)))).drop("n").withColumn("text", F.concat("text", F.rand(1).cast("string"))))
    assert quality.train(many, labels, F.lit(True)).weights is not None


def test_prior_estimate():
    r = np.random.default_rng(0)
    assert abs(quality.estimate_prior(r.normal(2, 1, 4000), np.r_[r.normal(2, 1, 3200), r.normal(-2, 1, 800)]) - 0.8) < 0.03


def test_unit_ratios_by_hand(spark):
    rows = [("bad words here bad", 1), ("good words here", 0), ("good good", 0)]
    packed = toxicity.packed(spark.createDataFrame([(i, *x) for i, x in enumerate(rows)], "id long, text string, y int"), "id", "text")
    marks = spark.createDataFrame([(i, y, False) for i, (_, y) in enumerate(rows)], "id long, y int, side boolean")
    r, n = toxicity.ratios(toxicity.count_units(packed.join(marks, "id")), "")
    assert n.tolist() == [4, 5]
    _, slot, parent = toxicity.units(["bad good words"])
    assert (parent[:, 0] == -1).all() and (parent[:, 1:] == slot[:, :-1]).all()
    # "bad": toxic 2 of 4; children: bad, wor, her | goo, wor, her; distinct predecessors: bad 2, words 2, here 1, good 2
    c, t, p = np.array([2.0, 0.0]), np.array([3.0, 3.0]), 2 / 7
    want = np.log(((c - 0.9).clip(0) + 0.9 * t * p) / n)
    assert abs(r[slot[0, 0]] - (want[0] - want[1])) < 1e-5
    assert r[slot[0, 0]] > 0 > r[slot[1, 0]] and abs(r[slot[2, 0]]) < 0.5


def test_units_never_share_counts(spark):
    long = "x" * 20_000
    _, unit, _ = toxicity.units([long + "a " + long + "b"])
    assert unit[0, toxicity.PAIR - 1] != unit[1, toxicity.PAIR - 1]
    rng = random.Random(4)
    rows = [(i, prose(rng, 1200) + " " + " ".join(f"{rng.random():.12f}"[2:] for _ in range(30_000)), i % 2) for i in range(10)]
    packed = toxicity.packed(spark.createDataFrame(rows, "id long, text string, y int"), "id", "text")
    counts = toxicity.count_units(packed.join(spark.createDataFrame([(i, y, False) for i, _, y in rows], "id long, y int, side boolean"), "id"))
    words = [re.findall(r"\w+", t) for _, t, _ in rows]
    n = {r.level: r["count"] for r in counts.groupBy("level").count().collect()}
    assert n[toxicity.PAIR] == len({p for w in words for p in zip([None, *w], w)}) > 1 << 18
    assert n[toxicity.PAIR - 1] == len({x for w in words for x in w})


def test_continuations_by_hand(spark):
    rows = [(0, "abcd xy abcd xy abce", 1), (1, "pq abcd xy abcf", 0)]
    packed = toxicity.packed(spark.createDataFrame(rows, "id long, text string, y int"), "id", "text")
    counts = toxicity.count_units(packed.join(spark.createDataFrame([(i, y, False) for i, _, y in rows], "id long, y int, side boolean"), "id"))
    cont = {r.unit: r.cont for r in toxicity.continuations(counts).collect()}
    _, unit, _ = toxicity.units(["abcd abce abcf"])
    for level in range(toxicity.PAIR):  # abcd follows nothing, xy and pq; abce and abcf follow xy
        assert [cont[u] for u in unit[:, level].tolist()] == ([3, 1, 1] if level else [5, 5, 5])  # all begin with abc


@pytest.mark.parametrize("which", [quality, toxicity])
def test_scores_on_odd_and_empty_tables(spark, which):
    rng = random.Random(2)
    docs = docs_frame(spark, odd_rows(rng)).withColumn("score", F.lit("x")).withColumn("y", F.lit(0))
    labels = spark.createDataFrame([(1, 1, 0), (4, 1, 1), (4, 0, 0), (7, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    for l in (labels, labels.limit(0)):
        model = which.train(docs, l, F.lit(True))
        got = which.score(docs, model).toPandas()
        assert len(got) == docs.count() and got["score"].between(0, 1).all()
    assert which.score(docs.limit(0), which.train(docs.limit(0), labels, F.lit(True))).count() == 0


def test_digest_of_nothing():
    assert pii.digest_of(None) == hashlib.sha256(b"").hexdigest()


@pytest.mark.parametrize("text,want", [("1" * 1_000_000, []), ("1.2.3." + "0" * 5000 + "4", [(1, 0, 5007)]), ("+1" + "(" * 1_000_000, []), ("1.1 " * 250_000, []), ("a@" * 500_000, [])])
def test_rules_on_very_long_runs(text, want):
    start = time.monotonic()
    assert pii.rule_spans(text) == want
    assert time.monotonic() - start < 2


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="012.a ", max_size=40))
def test_address_pattern_equals_the_plain_one(text):
    assert [m.span() for m in pii.IP.finditer(text)] == [m.span() for m in re.finditer(PLAIN[1], text)]


def test_model_adds_disguised_spans_in_real_texts(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    net = pii.fit(docs)
    rng, made, planted = random.Random(6), np.random.default_rng(21), []
    texts = [r.text for r in docs.where("lang = 'en' and n_chars between 300 and 3000").orderBy("doc_id").limit(300).collect()]
    for t in texts:
        while True:
            k, s = pii.generated(made)
            if not pii.rule_spans(s):
                break
        gaps = [i for i, c in enumerate(t) if c == " "]
        at = rng.choice(gaps) + 1
        planted.append((t[:at] + s + " " + t[at:], k, at, at + len(s)))
    found = [set(more) for _, more in pii.all_spans([p[0] for p in planted], net)]
    hit = sum((k, a, b) in f for (_, k, a, b), f in zip(planted, found))
    plain = sum(len(more) for _, more in pii.all_spans(texts, net))
    print("disguised spans added:", hit, "of", len(planted), "; spans added to the texts as they are:", plain)
    assert hit >= 0.6 * len(planted) and plain <= 3


def test_toxicity_recall_on_held_out_rows(spark):
    s, y = held(spark, "/root/testdata/sf0.1", "toxic", 5, 0, lambda d, l: toxicity.score(d, toxicity.train(d, l, ~quality.held_out("doc_id", 5, 0))))
    print("toxicity: AUC", auc(s, y), "found", (s[y == 1] >= 0.5).mean(), "false", (s[y == 0] >= 0.5).mean())
    assert auc(s, y) > 0.96 and (s[y == 1] >= 0.5).mean() > 0.85 and (s[y == 0] >= 0.5).mean() < 0.02


def test_toxicity_score_equals_the_plain_formula(spark, monkeypatch):
    """Windows, word lists and joins give what a dictionary of all ratios gives, text by text."""
    monkeypatch.setattr(toxicity, "WINDOW_CHARS", 3000)
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    model = toxicity.train(docs, labels, F.lit(True))
    ratio = {r.unit: r.ratio for r in model.ratio.table.collect()}
    got = {r.id: r.x for r in toxicity.evidence(docs, model.ratio, "doc_id", "text").collect()}
    for r in docs.collect():
        _, unit, _ = toxicity.units([r.text])
        each = [sum(ratio.get(int(u), 0.0) for u in row) for row in unit]
        want = float(np.log(np.mean(np.exp(each)))) if each else 0.0
        assert abs(got[r.doc_id] - want) < 1e-4, r.doc_id
    assert set(got) == {r.doc_id for r in docs.collect()}


def test_toxicity_scores_do_not_hang_on_partitions(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "WINDOW_CHARS", 5000)
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    model = toxicity.train(docs, labels, F.lit(True))
    want = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    joined = docs.join(labels.select("doc_id"), "doc_id", "left")
    for other in (docs.repartition(7), docs.repartition(5, "lang"), docs.orderBy(F.rand(3)), joined):
        got = {r.doc_id: r.score for r in toxicity.score(other, model).collect()}
        assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-6 for i in want)


def test_toxicity_in_one_pass_scores_as_the_tables_do(spark, monkeypatch):
    """Buckets give what tables of all units give, whatever the blocks, buckets and partitions; rows of one id keep a score each."""
    monkeypatch.setattr(toxicity, "BLOCK_CHARS", 20_000)
    monkeypatch.setattr(toxicity, "SPOOL", 10_000)
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    odd = spark.createDataFrame([(-1, None), (-2, ""), (-3, "..."), (-4, "word"), (None, "word word"), (-5, "word " * 3000)], "doc_id long, text string")
    docs = docs.select("doc_id", "text").unionByName(odd)
    learn = F.col("doc_id") % 5 != 0
    want = {(r.doc_id): r.score for r in toxicity.score(docs, toxicity.train(docs, labels, learn)).collect()}
    for buckets, other in ((12, docs), (3, docs.repartition(7)), (40, docs.orderBy(F.rand(3)))):
        monkeypatch.setattr(toxicity, "LEAST_BUCKETS", buckets)
        got = toxicity.score_all(other, labels, learn).collect()
        assert len(got) == docs.count() and {r.doc_id for r in got} == want.keys()
        assert max(abs(r.score - want[r.doc_id]) for r in got) < 1e-4
    assert len({round(v, 3) for v in want.values()}) > 50
    twice = toxicity.score_all(docs.unionByName(docs), labels, learn)
    assert twice.count() == 2 * docs.count() and twice.where("score is null").count() == 0
    for l in (labels.limit(0), labels.where("toxic = 0")):
        assert toxicity.score_all(docs, l, learn).where("score between 0 and 1").count() == docs.count()
    assert toxicity.score_all(docs.limit(0), labels, learn).count() == 0


def test_toxicity_query_makes_no_table_of_units(spark, tmp_path):
    """What the query moves and writes stays under 1.5 times its texts, though most of their word pairs are new."""
    rng = random.Random(8)
    rows = [(i, " ".join(f"w{rng.randrange(20_000)}" for _ in range(4000)), i % 2) for i in range(120)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    written, keep = [], toxicity.Scratch.keep

    def kept(self, df):
        out = keep(self, df)
        written.append(sum(f.stat().st_size for f in Path(out._scratch_path.removeprefix("file:")).iterdir()))
        return out

    with pytest.MonkeyPatch.context() as m:
        m.setattr(toxicity.Scratch, "keep", kept)
        docs.write.parquet(str(tmp_path / "documents.parquet"))
        labels.write.parquet(str(tmp_path / "labels.parquet"))
        assert queries.op5_toxicity(spark, str(tmp_path)).count() == 120
    assert sum(written) < 0.75 * sum(len(t) for _, t, _ in rows)


def plain_passages(texts, items):
    """All items against all passages of their own length."""
    want = {}
    for d, t in texts:
        have = decontam.words(t)
        for i, x in items:
            w = decontam.words(x)
            s = decontam.shingles(w)
            last = max(-(-len(have) // len(w)) - 3, 0) if w else -1
            best = max((len(s & decontam.shingles(have[a * len(w) : (a + 3) * len(w)])) / len(s) for a in range(last + 1)), default=0) if s and have else 0
            if best >= 0.8:
                want[d, i] = round(best, 9)
    return want


@pytest.mark.parametrize("slice_items", [1, 7, 20_000])
def test_passages_depend_on_the_item_alone(spark, monkeypatch, slice_items):
    monkeypatch.setattr(decontam, "SLICE_ITEMS", slice_items)
    rng = random.Random(31)
    items = [(i, prose(rng, rng.choice([5, 6, 9, 20, 60, 150]))) for i in range(24)]
    texts = []
    for i in range(50):
        w = []
        for _ in range(rng.randint(0, 3)):
            got = items[rng.randrange(24)][1].split()
            for at in range(rng.randrange(3)):  # foreign words mixed in
                got.insert(rng.randrange(len(got)), "foreign")
            w += prose(rng, rng.randint(1, 200)).split() + got
        texts.append((i, " ".join(w + prose(rng, rng.randint(1, 60)).split())))
    docs = docs_frame(spark, texts).withColumn("item_id", F.lit("mine")).withColumn("item", F.lit(0)).withColumn("score", F.lit("s"))
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1)).withColumn("id", F.lit(2))
    if slice_items == 1:
        docs, texts, bench, items = docs.where("doc_id < 20"), texts[:20], bench.where("item_id < 4"), items[:4]
    got = {(r.doc_id, r.item_id): round(r.overlap, 9) for r in decontam.contaminated(docs, bench).collect()}
    assert got == plain_passages(texts, items) and got
    assert decontam.drop_contaminated(docs, bench).columns == docs.columns


def test_index_of_many_items_is_sparse():
    rng = random.Random(8)
    letters = "abcdefghijklmnopqrstuvwxyz"
    vocabulary = ["".join(rng.choice(letters) for _ in range(6)) for _ in range(40_000)]
    index = decontam.Index([(i, " ".join(rng.choice(vocabulary) for _ in range(40))) for i in range(20_000)])
    assert index.size() < 20_000 * 40 * 20
    assert [x[1] for x in index.search([" ".join(index.words[123]), "nothing of it"])] == [index.ids[123]]


def joined_groups(n, pairs):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in pairs:
        root[find(a)] = find(b)
    groups = {}
    for x in range(n):
        groups.setdefault(find(x), []).append(x)
    return sorted(map(sorted, groups.values()))


@pytest.mark.parametrize("one", [True, False])
def test_block_links_join_what_all_pairs_join(one):
    r = np.random.default_rng(14)
    for _ in range(25):
        sets, own = [], []
        for c in range(6):
            base = r.choice(80, int(r.integers(10, 40)), replace=False)
            for _ in range(int(r.integers(1, 15))):
                s = set(base.tolist())
                for _ in range(int(r.integers(0, 5))):
                    s.discard(int(r.choice(base)))
                    s.add(int(r.integers(0, 90)))
                sets.append(np.array(sorted(s), dtype=np.int64))
                own.append(int(r.integers(3, 5)))
        order = r.permutation(len(sets))
        sets, own = [sets[k] for k in order], [own[k] for k in order]
        want = [(a, b) for a in range(len(sets)) for b in range(a) if (one or own[a] != own[b]) and passages.jaccard(sets[a], sets[b]) >= 0.8]
        a, b = passages.block_links(list(range(len(sets))), own, sets, one)
        assert joined_groups(len(sets), zip(a, b)) == joined_groups(len(sets), want)
        assert all(passages.jaccard(sets[x], sets[y]) >= 0.8 for x, y in zip(a, b)) and len(a) < len(sets)


@pytest.mark.parametrize("words", [20, 60])
def test_a_bucket_of_template_lines_takes_about_linear_time(words):
    """Lines that differ in a number: apart at 20 words, all alike at 60; either way no pair list."""
    r = np.random.default_rng(2)
    common = r.integers(0, 2**62, words - 4 - 5)
    sets = [np.unique(np.r_[common, r.integers(0, 2**62, 5)]) for _ in range(20_000)]
    start = time.monotonic()
    a, b = passages.block_links(list(range(len(sets))), [0] * len(sets), sets, True)
    assert len(a) == (0 if words == 20 else len(sets) - 1)
    assert time.monotonic() - start < 20


def test_line_links_against_all_pairs(spark):
    """Components of lines by banding equal those of every pair of lines at the threshold."""
    rng = random.Random(17)
    lines = []
    for _ in range(25):
        base = prose(rng, rng.randint(16, 60)).split()
        for _ in range(rng.randint(1, 5)):
            w = list(base)
            for _ in range(rng.randint(0, 2)):
                w[rng.randrange(len(w))] = prose(rng, 1)
            lines.append(" ".join(w))
    docs = docs_frame(spark, [(i, t) for i, t in enumerate(lines)])
    u = passages.units(docs, "doc_id", "text")
    from cuewright.llm.common import Scratch

    at = {r.h: r.doc_id for r in u.where("is_line").collect()}
    got = [(at[r.a], at[r.b]) for r in passages.line_links(u, docs, "doc_id", "text", Scratch(spark, "test")).collect()]
    sets = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in lines]
    same = [(a, b) for a in range(len(lines)) for b in range(a) if lines[a] == lines[b]]
    want = [(a, b) for a in range(len(lines)) for b in range(a) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    assert joined_groups(len(lines), got + same) == joined_groups(len(lines), want)

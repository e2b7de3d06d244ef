"""HTML extraction, near vectors, mixing, chat and the pipeline against plain versions."""

import hashlib
import html
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cuewright.llm import chat, common, components, decontam, html_text, mixing, pii, queries, quality, simhash, vectors
from cuewright.llm.common import table

SF = "/root/testdata/sf0.001"


# ---- HTML


def test_articles_against_a_plain_reading(spark):
    rows = table(spark, SF, "pages").collect()
    got = {r.page_id: r for r in queries.op6_html_text(spark, SF).collect()}
    for r in rows:
        body = r.html[r.html.index("<article>") + 9 : r.html.index("</article>")]
        parts = [" ".join(html.unescape(re.sub("<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1)>", body)]
        want = "\n\n".join(x for x in parts if x)
        assert got[r.page_id].text == want and got[r.page_id].n_chars == len(want)


def test_structure_rules():
    page = (
        "<html><head><title>t</title><style>p{}</style></head><body><header>top</header><nav>menu</nav>"
        "<div class='cookie-notice'>we use</div><main><h1>A &amp; B</h1><p>one <b>two</b>\n three<p>x < y &lt;b&gt;<br>z"
        "<aside>side</aside><script>if (a < b) '</p>'</script><form>f</form><!-- no --><ul><li>i</li><li>j</li></ul>"
        "<section id=comments><p>nice</p></section></main><footer>f</footer>"
    )
    assert html_text.main_text(page) == "A & B\n\none two three\n\nx < y <b> z\n\ni\n\nj"
    for odd in (None, "", "<", "<p", "a < b", "&", "<p>é&nbsp;ü</p>", "<script>x", "<div" * 2000):
        html_text.main_text(odd)
    assert html_text.main_text("plain &eacute;") == "plain é"


@pytest.mark.parametrize("name", ["comment-thread", "user-comments", "cookie-notice-v2", "ad-slot-300x250", "related-articles", "newsletter-optin", "share-buttons"])
def test_named_parts_of_an_article_go(name):
    page = f"<article><h1>T</h1><p>{'word ' * 40}</p><div class='{name}'><p>gone</p></div><p>end</p></article>"
    assert html_text.main_text(page) == f"T\n\n{('word ' * 40).strip()}\n\nend"


def test_the_heaviest_part_is_the_text():
    story = ("a story of many words " * 20).strip()
    assert html_text.main_text(f"<div><p>{story}</p></div><article><p>teaser</p></article>") == story
    assert html_text.main_text(f"<main><p>{story}</p></main><article><p>teaser</p></article>") == story
    assert html_text.main_text(f"<main><article><p>{story}</p></article><p>more</p></main>") == f"{story}\n\nmore"
    assert html_text.main_text(f"<p>by line</p><article><p>{story}</p></article>") == story
    assert html_text.main_text(f"<article><p>{story}</p></article><article><p>{story} too</p></article>") == f"{story}\n\n{story} too"


def test_runs_judge_the_parts_of_articles(spark):
    """A template's text in divisions of any name goes, quotes that articles share stay, and so does a division that is most of the text."""
    rng, words = random.Random(4), "river stone light field house winter paper green sound small early north".split()
    say = lambda n: " ".join(rng.choice(words) + rng.choice(words) for _ in range(n))
    chrome, quote = say(20), say(25)
    rows, want = [], {}
    for i in range(12):
        a, b, own = say(60), say(40), say(15)
        host = "one.example" if i % 2 else "two.example"
        body = f"<h1>{a[:30]}</h1><p>{a}</p><p>{quote}</p><div class='xq7'><p>{chrome}</p></div><div class='xq8'><p>{own}</p></div><p>{b}</p>"
        rows.append((i, f"https://{host}/{i}", f"<nav>menu</nav><article><div id=c>{body}</div></article>" if i % 3 == 0 else f"<article>{body}</article>"))
        want[i] = "\n\n".join([a[:30], a, quote, own, b])
    rows += [(20, "https://alone.example/", f"<article><p>{say(50)}</p><div class='xq7'><p>{chrome}</p></div></article>"), (21, None, None)]
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)).collect()}
    assert {i: got[i] for i in want} == want and chrome in got[20] and got[21] == ""


def test_repeated_runs_by_brute_force():
    r = random.Random(1)
    for _ in range(60):
        pages = [[r.randrange(3) for _ in range(r.randrange(0, 14))] for _ in range(6)]
        tok = np.array([t for p in pages for t in p], dtype=np.int64)
        page = np.array([i for i, p in enumerate(pages) for _ in p], dtype=np.int64)
        run, need = r.choice([1, 2, 3, 5]), r.choice([2, 3])
        want = []
        for p in pages:
            hit = [False] * len(p)
            for i in range(len(p) - run + 1):
                g = p[i : i + run]
                if sum(any(q[j : j + run] == g for j in range(len(q) - run + 1)) for q in pages) >= need:
                    hit[i : i + run] = [True] * run
            want += hit
        assert html_text.repeated(tok, page, run, need).tolist() == want


def test_host_boilerplate_without_articles(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    common_text = " ".join(word() for _ in range(12))
    rows, want = [], {}
    for i in range(40):
        own = " ".join(word() for _ in range(20))
        rows.append((i, f"http://Host.example/{i}", f"<div>{common_text}</div><p>{own}</p>"))
        want[i] = own
    rows += [(90, "http://host.example/n", None), (91, None, ""), (92, "http://other.example/", f"<p>{common_text}</p>"), (0, rows[0][1], rows[0][2])]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("key", F.lit(1)).withColumn("text", F.lit("old"))
    got = [(r.page_id, r.text) for r in html_text.extract(df).collect()]
    assert Counter(got) == Counter([*want.items(), (90, ""), (91, ""), (92, common_text), (0, want[0])])
    assert html_text.extract(df.limit(0)).count() == 0


def test_runs_are_counted_over_a_whole_host(spark):
    line = " ".join(f"notice{i}" for i in range(10))
    rows, want = [], {}
    for i in range(1200):
        want[i] = " ".join(f"own{i}x{j}" for j in range(12))
        rows.append((i, f"http://h.example/{i}", (f"<div>{line}</div>" if i % 400 == 0 else "") + f"<p>{want[i]}</p>"))
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == want


def test_copies_of_a_page_are_one_page(spark):
    own, other = (" ".join(f"{w}{i}" for i in range(20)) for w in "ab")
    rows = [(i, f"http://h.example/{i % 2}", f"<p>{own}</p>") for i in range(12)] + [(20, "http://h.example/x", f"<p>{other}</p>")]
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: own for i in range(12)} | {20: other}


# ---- vectors


def plain_vectors(rows):
    unit = {}
    for k, (i, v, label) in enumerate(rows):
        ok = v is not None and label is not None and i is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)
        if ok:
            x = np.array(v, dtype=float)
            unit[k] = x / np.linalg.norm(x)
    links = {k: [j for j in unit if j != k and rows[j][2] == rows[k][2] and unit[j] @ unit[k] >= 0.98] for k in unit}
    out = []
    for k, (i, _, _) in enumerate(rows):
        seen, todo = {k}, [k]
        while todo:
            for j in links.get(todo.pop(), ()):
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        low = min((rows[j][0] for j in seen if rows[j][0] is not None), default=None)
        out.append((i, len(links.get(k, ())), low, i == low))
    return out


def test_vectors_against_brute_force(spark):
    r = np.random.default_rng(5)
    rows = []
    for c in range(12):
        base = r.normal(size=16)
        for _ in range(int(r.integers(1, 30))):
            rows.append((len(rows), [float(x) for x in (base + r.normal(size=16) * 0.12).astype(np.float32)], c % 3))
    one = rows[0][1]
    rows += [(1000, one, 0), (1001, one, 0), (1002, one, None), (1003, None, 0), (1004, [0.0] * 16, 0), (1005, [float("nan")] + one[1:], 0), (1006, [float("inf")] + one[1:], 0), (1007, [None] + one[1:], 0), (None, one, 0), (1008, [x * 1e-30 for x in one], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("v", F.lit(1)).withColumn("id", F.lit(2))
    got = sorted(map(tuple, vectors.near_duplicates(df).select("vec_id", "n_links", "component_id", "kept").collect()), key=str)
    want = sorted(((i, n, c, k if i is not None else True) for i, n, c, k in plain_vectors(rows)), key=str)
    assert got == want
    assert vectors.near_duplicates(df.limit(0)).count() == 0


def test_links_between_saturated_groups(spark):
    r = np.random.default_rng(8)
    rows = []
    for i in range(24):
        base = np.zeros(16)
        base[:2] = (1.0, 0.0) if i < 12 else (0.985, np.sqrt(1 - 0.985**2))
        rows.append((i, [float(x) for x in base + r.normal(size=16) * 0.002], 0))
    got = sorted(map(tuple, vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).select("vec_id", "n_links", "component_id", "kept").collect()))
    assert got == sorted(plain_vectors(rows)) and {(n, c) for _, n, c, _ in got} == {(23, 0)}


def test_recall_of_the_graph(spark):
    df = table(spark, "/root/testdata/sf0.1", "embeddings")
    rows = [(r.vec_id, r.embedding, r.label) for r in df.collect()]
    want = {}
    by = {}
    for i, v, l in rows:
        by.setdefault(l, []).append((i, np.array(v, float)))
    for l, part in by.items():
        x = np.array([v for _, v in part])
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        for (i, _), n in zip(part, ((x @ x.T) >= 0.98).sum(1) - 1):
            want[i] = int(n)
    got = {r.vec_id: r.n_links for r in vectors.near_duplicates(df).collect()}
    assert sum(min(got[i], n) for i, n in want.items()) >= 0.99 * sum(want.values())
    assert all(got[i] <= n for i, n in want.items())


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(500, 500 + i) for i in range(1, 40)] + [(700, 700), (None, 3), (9, 8)]
    s = common.Scratch(spark, "test")
    got = {r.node: r.root for r in components.connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b", s).collect()}
    assert got == {i: 0 for i in range(61)} | {500 + i: 500 for i in range(40)}
    assert components.connected_components(spark.createDataFrame([], "a long, b long"), "a", "b", s).count() == 0


# ---- mixing


def test_poisson_copies(spark):
    docs = spark.range(20000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 10 < 7, "big").otherwise("small").alias("source"), F.lit("t").alias("text"), F.lit(1).alias("__u"), F.lit("x").alias("copy_no"))
    x = mixing.mix_sources(docs, {"big": 1.0, "small": 3.0})
    n = {r.source: r["count"] for r in x.groupBy("source").count().collect()}
    assert abs(n["big"] / 5000 - 1) < 0.06 and abs(n["small"] / 15000 - 1) < 0.06
    assert x.columns == ["doc_id", "source", "text", "__u", "copy_no", "shuffle_key"]
    per = np.bincount([r["count"] for r in x.where("source = 'small'").groupBy("doc_id").count().collect()], minlength=12)
    per[0] = 6000 - per.sum()
    rate = 2.5
    want = [6000 * np.exp(-rate) * rate**k / np.prod(range(1, k + 1)) for k in range(8)]
    assert np.abs(per[:8] - want).max() < 5 * np.sqrt(max(want))


def test_mixing_is_sorted_and_whole(spark):
    x = mixing.mix_sources(table(spark, SF, "documents"))
    parts = x.select("shuffle_key", F.spark_partition_id().alias("p")).toPandas()
    assert parts["shuffle_key"].is_monotonic_increasing
    assert x.count() == len(parts)
    odd = spark.createDataFrame([(1, None, "a"), (1, None, "a"), (None, "s", None)], "doc_id long, source string, text string")
    got = mixing.mix_sources(odd, seed=3)
    assert got.columns == ["doc_id", "source", "text", "copy_no", "shuffle_key"]
    assert Counter(r.doc_id for r in got.collect())[1] % 2 == 0
    assert mixing.mix_sources(odd.limit(0)).count() == 0


def test_mixing_sql_with_high_rates_null_sources_and_repeated_rows(spark):
    duckdb = pytest.importorskip("duckdb")
    n = 60_000
    big = F.when(F.col("id") < 1, "rare").when(F.col("id") < 5, F.lit(None)).otherwise("common")
    docs = spark.range(n).select(F.col("id").alias("doc_id"), big.alias("source"), F.lit("t").alias("text"))
    docs = docs.unionByName(docs.where("doc_id BETWEEN 3 AND 7")).unionByName(spark.createDataFrame([(None, "common", None)], "doc_id long, source string, text string"))
    assert mixing.source_rates(docs).agg(F.max("rate")).first()[0] > mixing.MAX_RATE
    con = duckdb.connect()
    con.register("documents", docs.toPandas().astype({"doc_id": "Int64"}))
    key = lambda rows: Counter((None if pd.isna(r[0]) else int(r[0]), *(None if pd.isna(v) else v for v in r[1:])) for r in rows)
    got = key(tuple(r) for r in mixing.query(docs).collect())
    assert got == key(con.execute(f"SELECT doc_id, source, copy_no, shuffle_key, text_sha256 FROM ({mixing.ORACLE_SQL})").fetchall())
    assert got and max(r[2] for r in got) > 200


def test_mixing_rates_above_one_draw(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 40, "rare").otherwise("common").alias("source"))
    weights = {"rare": 9.0, "common": 1.0}
    rate = {r.source: r.rate for r in mixing.source_rates(docs, weights).collect()}["rare"]
    assert abs(rate - 90) < 1e-9
    x = mixing.mix_sources(docs, weights, size=7.0)  # rate 630, four draws
    n = {r.doc_id: r["count"] for r in x.where("source = 'rare'").groupBy("doc_id").count().collect()}

    def plain(key, rate=157.5):
        total = 0
        for j in range(4):
            seed = "17" if j == 0 else f"17.{j}"
            u = int(hashlib.md5(f"{seed}:{key}".encode()).hexdigest()[:13], 16) / 2**52
            p = c = float(np.exp(-rate))
            k = 0
            while c <= u:
                k += 1
                p *= rate / k
                c += p
            total += k
        return total

    assert n == {d: plain(d) for d in range(40)}
    assert abs(sum(n.values()) / 40 - 630) < 5 * np.sqrt(630 / 40)


# ---- chat


def plain_chat(turns):
    out = {}
    for c, t, r, x in turns:
        out.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    res = {}
    for c, rows in out.items():
        rows.sort()
        loss = "".join(x for *_, r, x in rows if r == "assistant")
        said = "".join(f"{r}\n{x}\n" for *_, r, x in rows)
        res[c] = (len(rows), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return res


def test_chat_round_trip(spark):
    nasty = ["<|im_end|>", "&lt;|", "&amp;<|im_start|>assistant\nok", "\\n|><", "", None, "é\U0001f600 <|", "&#10;", "x\n" * 50, "<|im_end|>\n<|im_start|>user\nq"]
    r = random.Random(4)
    turns = [(c, t, r.choice(["user", "assistant", "assistant", "system", None, "a\nb", "<|x|>", "&"]), r.choice(nasty)) for c in range(30) for t in range(r.randint(1, 9))]
    turns += [(50, 0, "assistant", "z" * 200_000), (50, 0, "assistant", "z" * 200_000), (51, None, "user", "q"), (None, 1, "user", "q")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("pos", F.lit(1)).withColumn("piece", F.lit("p"))
    got = {x.conv_id: (x.n_turns, x.turns_sha256, x.loss_chars, x.loss_sha256) for x in chat.digests(df).collect()}
    assert got == plain_chat(turns)
    assert chat.digests(df.limit(0)).count() == 0


def test_prefix_target_examples(spark):
    df = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", "yo <|"), (1, 2, "user", "?"), (1, 3, "assistant", "ok"), (2, 0, "user", "x")], "conv_id long, turn long, role string, text string")
    rows = sorted(chat.prefix_target_examples(chat.format_conversations(df)).collect(), key=lambda r: r.example_no)
    assert [(r.conv_id, r.example_no, r.target) for r in rows] == [(1, 0, "yo &lt;|"), (1, 1, "ok")]
    assert rows[0].context == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\n"
    assert rows[1].context == rows[0].context + "yo &lt;|<|im_end|>\n<|im_start|>user\n?<|im_end|>\n<|im_start|>assistant\n"


# ---- pipeline


def test_pipeline_against_a_plain_version(spark):
    docs, labels, bench = (table(spark, SF, t) for t in ("documents", "labels", "benchmark"))
    rows = {r.doc_id: r for r in docs.collect()}
    model = quality.train(docs, labels, ~quality.held_out("doc_id", 4, 2))
    good = sorted(d for d, r in rows.items() if model.score(quality.features(r.text)[None])[0] >= 0.7)
    fps = {d: simhash.fingerprint(rows[d].text) for d in good}
    group = {d: d for d in good}
    for _ in good:
        new = {d: min(group[e] for e in good if (fps[d] ^ fps[e]).bit_count() <= 2) for d in good}
        if new == group:
            break
        group = new
    first = [d for d in good if group[d] == d]
    items = [(i, decontam.shingles(decontam.words(t))) for i, t in ((r.item_id, r.text) for r in bench.collect())]
    clean = [d for d in first if not any(s and len(s & decontam.shingles(decontam.words(rows[d].text))) >= 0.8 * len(s) for _, s in items)]
    n = Counter(rows[d].source for d in clean)
    raw = sum(x**0.5 for x in n.values())
    want = Counter()
    for d in clean:
        rate = n[rows[d].source] ** 0.5 / raw * len(clean) / n[rows[d].source]
        u = int(hashlib.md5(f"17:{d}".encode()).hexdigest()[:13], 16) / 2**52
        p = c = float(np.exp(-rate))
        k = 0
        while c <= u:
            k += 1
            p *= rate / k
            c += p
        want[d] = k
    got = corpus_pipeline.run(spark, SF).collect()
    assert Counter(r.doc_id for r in got) == +want
    assert 3 < len(clean) < len(first) < len(good) < len(rows)
    for r in got:
        assert not pii.rule_spans(r.text) or pii.rule_spans(rows[r.doc_id].text)
        assert r.n_chars == len(r.text)


def test_stages_keep_the_columns(spark):
    docs = table(spark, SF, "documents").limit(60).withColumn("score", F.lit("x")).withColumn("id", F.lit(1))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
    empty = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0, name
    folds = spark.range(50).select("id", quality.held_out("id", 4, 2).alias("out")).collect()
    assert all(r.out == (zlib.crc32(str(r.id).encode()) % 4 == 2) for r in folds)


@pytest.mark.parametrize("name", ["op8_mix_sources", "op10_chat_format", "op4_near_vectors"])
def test_queries_equal_their_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("documents", "conversations", "embeddings"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = queries.QUERIES[name](spark, SF).toPandas()
    want = con.execute(queries.ORACLES[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    assert Counter(map(str, got[cols].values.tolist())) == Counter(map(str, want[cols].values.tolist()))


@pytest.mark.parametrize(
    "page,want",
    [
        ("<article><div class='share-price'>a</div><p id='notice-period'>b</p><p class='header-note'>c</p></article>", "a\n\nb\n\nc"),
        ("<article class=comment>reader</article><article><p>x</p></article>", "x"),
        ("<article><p>x</p><section class='post-comments'><article class='comment'><p>y<article><p>z</article></article></section></article>", "x"),
        ("<article><p>one <span class=ad>x</span> two</p></article>", "one two"),
        ("<article><p>one <span class=ad>x<span>y</span>z</span> two<script>q</script> three</p></article>", "one two three"),
        ("<article><p data-role='navigation' data-id=nav title='hidden ad'>kept</p><p style='display: none'>gone</p></article>", "kept"),
        ("<article><p>a</p><a class=ad>b<p>c</p></a><p>d</p></article>", "a\n\nd"),
        ("<article><div class='cookie-bar'>a</div><div class='site-footer main'>b</div><div class='adaptive'>c</div></article>", "c"),
    ],
)
def test_names_inline_parts_and_nested_comments(page, want):
    assert html_text.main_text(page) == want


@pytest.mark.parametrize("page", ["<div>" * 100_000 + "</b>" * 100_000, "<div>" * 8000 + "</p>" * 8000, "<span class=ad>" * 50_000, "<p>" * 100_000, "<" * 100_000])
def test_deep_and_broken_nesting_is_linear(page):
    start = time.monotonic()
    html_text.main_text(page)
    assert time.monotonic() - start < 3


def test_suffix_array_and_common_prefixes():
    r = random.Random(5)
    for _ in range(200):
        t = [r.randrange(3) for _ in range(r.randrange(1, 30))]
        order, lcp = html_text.suffix_array(np.array(t, dtype=np.int64))
        want = sorted(range(len(t)), key=lambda i: t[i:])
        assert order.tolist() == want and lcp[0] == 0
        for a, b, n in zip(want, want[1:], lcp[1:].tolist()):
            k = 0
            while max(a, b) + k < len(t) and t[a + k] == t[b + k]:
                k += 1
            assert n == k


def test_stretches_send_equal_runs_to_one_place():
    r = np.random.default_rng(3)
    for _ in range(100):
        t = r.integers(0, 4, int(r.integers(0, 60))).astype(np.uint32)
        parts = html_text.stretches(t, 8)
        runs = {}
        for a, z, shard in parts:
            assert z - a - 8 < 64
            for i in range(a, z - 7):
                assert i not in runs
                runs[i] = (t[i : i + 8].tobytes(), shard)
        assert sorted(runs) == list(range(len(t) - 7))
        assert len(set(runs.values())) == len({g for g, _ in runs.values()})


def test_open_pages_against_brute_force(spark):
    """Blocks of pages without an article, judged by all 8-token runs of each host."""
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(30)]
    pool = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 14))) for _ in range(25)]
    rows = []
    for i in range(120):
        parts = [rng.choice(pool) if rng.random() < 0.5 else " ".join(rng.choice(vocabulary) + str(rng.randrange(9)) for _ in range(rng.randint(1, 20))) for _ in range(rng.randint(1, 6))]
        rows.append((i, f"http://h{i % 3}.example/{i}", "".join(f"<p>{x}</p>" for x in parts)))
    rows += [(200, rows[0][1], rows[0][2]), (201, rows[0][1], rows[0][2])]
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(7)).collect()}
    texts = {}
    for host in range(3):
        pages = sorted({h for _, u, h in rows if f"//h{host}." in u})
        split = [[x.split() for x in re.findall("<p>(.*?)</p>", h)] for h in pages]
        flat = [[w for b in p for w in b] for p in split]
        where = {}
        for k, p in enumerate(flat):
            for i in range(len(p) - 7):
                where.setdefault(tuple(p[i : i + 8]), set()).add(k)
        for h, p, bs in zip(pages, flat, split):
            hit = [False] * len(p)
            for i in range(len(p) - 7):
                if len(where[tuple(p[i : i + 8])]) >= 3:
                    hit[i : i + 8] = [True] * 8
            kept, at = [], 0
            for b in bs:
                if sum(hit[at : at + len(b)]) < 0.5 * len(b):
                    kept.append(" ".join(b))
                at += len(b)
            texts[host, h] = "\n\n".join(kept)
    assert got == {i: texts[int(u[8]), h] for i, u, h in rows}
    assert any(texts[int(u[8]), h].count("\n\n") + 1 < h.count("<p>") for _, u, h in rows)


def test_vectors_are_exact_where_the_rounds_fall_short(spark, monkeypatch, caplog):
    for name, value in (("ROUNDS", 1), ("K", 1), ("LONGEST", 1), ("TREES", 1), ("CELL", 2), ("BLOCK", 16)):
        monkeypatch.setattr(vectors, name, value)
    caplog.set_level("INFO", logger=vectors.__name__)
    r = np.random.default_rng(12)
    rows = []
    for c in range(10):
        base = r.normal(size=12)
        for _ in range(12):
            rows.append((len(rows), [float(x) for x in base + r.normal(size=12) * 0.1], c % 2))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = sorted(map(tuple, vectors.near_duplicates(df).select("vec_id", "n_links", "component_id", "kept").collect()))
    assert got == sorted(plain_vectors(rows))
    said = [x.getMessage() for x in caplog.records if "audited links" in x.getMessage()]
    first, last = (list(map(int, re.findall(r"\d+", x))) for x in (said[0], said[-1]))
    assert first[0] < first[1] and last[0] == last[1]


def test_audit_with_few_links_asks_more_nodes_or_compares_all(spark, monkeypatch):
    r = np.random.default_rng(15)
    rows = [(i, [float(x) for x in r.normal(size=8)], 0) for i in range(300)]
    rows += [(300 + k, [x * 1.001 for x in rows[40 * k][1][:7]] + [rows[40 * k][1][7]], 0) for k in range(5)]
    df, want = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), sorted(plain_vectors(rows))
    report = {}
    got = vectors.near_duplicates(df, report=report)
    assert sorted(map(tuple, got.select("vec_id", "n_links", "component_id", "kept").collect())) == want
    assert report["audited"] == 10 and report["joined"] == 1.0 and not report["exact"]  # every node was asked
    monkeypatch.setattr(vectors, "AUDIT", 20)
    monkeypatch.setattr(vectors, "AUDIT_MOST", 40)
    got = vectors.near_duplicates(df, report=report)
    assert sorted(map(tuple, got.select("vec_id", "n_links", "component_id", "kept").collect())) == want and report["exact"]


def test_vectors_of_different_lengths_do_not_link(spark):
    rows = [(1, [1.0, 0.0], 0), (2, [1.0, 0.0, 0.0], 0), (3, [2.0, 0.0], 0), (4, [], 0), (5, [1.0], 0), (6, None, 0)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert got == {1: (1, 1), 2: (0, 2), 3: (1, 1), 4: (0, 4), 5: (0, 5), 6: (0, 6)}
    none = spark.createDataFrame([(4, [], 0), (6, None, 0)], "vec_id long, embedding array<double>, label int")
    assert {r.vec_id: r.n_links for r in vectors.near_duplicates(none).collect()} == {4: 0, 6: 0}


def test_examples_hold_every_preceding_turn(spark):
    """Context and target of each example read back to the turns before the reply and the reply itself."""
    df = table(spark, SF, "conversations")
    turns = {}
    for r in sorted(df.collect(), key=lambda r: (r.conv_id, r.turn, r.role, r.text)):
        turns.setdefault(r.conv_id, []).append((r.role, r.text))
    x = chat.prefix_target_examples(chat.format_conversations(df))
    whole = F.concat("context", "target", F.lit(chat.END))
    got = {(r.conv_id, r.example_no): [(t.role, t.text) for t in r.t] for r in x.select("conv_id", "example_no", chat.read_back(whole).alias("t")).collect()}
    want = {}
    for c, rows in turns.items():
        for k, i in enumerate(i for i, (role, _) in enumerate(rows) if role == "assistant"):
            want[c, k] = rows[: i + 1]
    assert got == want and got

"""Benchmark decontamination: BM25 over test items with block-max WAND, then overlap checks.

Test items are the indexed side, training passages the queries. An item's threshold is the least
score a passage can have that holds the asked share of the item's five-word shingles, so nothing
above the share is lost: with S distinct shingles at most m = floor((1 - share) S) word positions
can be gone, hence at most the m largest term impacts.

As in WAND, an item's terms are taken from the strongest on: a passage that reaches the threshold
must hold enough of the first ones (its pivot terms), since all the others together can't make up
for them. Only pivot terms have postings, by block of items with the largest impact in the block;
blocks whose sums stay under what any of their items needs are skipped, the items of the others
scored in full. Postings are sparse: their size follows the items' words.

A passage of an item is a window three times as long as the item, and one such length on starts
the next, so an item lies in one window even with as many foreign words mixed in, and what is found
depends on the item alone. Candidates are searched in wider windows that hold every such passage.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from itertools import chain, repeat
from math import log

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

WORD = re.compile(r"\w+")
SHINGLE = 5
SHARE = 0.8
K1, B = 1.2, 0.75
BLOCK = 4
#: Share of an item's threshold that terms without postings may add up to.
PIVOT = 0.5
#: Most characters and items of one index slice; larger benchmarks take a pass per slice.
SLICE_CHARS, SLICE_ITEMS = 8_000_000, 20_000
#: Least share of a question's shingles that a passage of its item must hold to be a leak: the answer alone isn't one.
QUESTION = 0.5
#: Sums held at once while passages are matched with blocks.
CELLS = 2_000_000


def words(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def shingles(w: list[str]) -> set[tuple[str, ...]]:
    """Distinct five-word shingles; of fewer words, the whole sequence; of none, nothing."""
    if not w:
        return set()
    return {tuple(w[i : i + SHINGLE]) for i in range(max(1, len(w) - SHINGLE + 1))}


def split_item(text: str | None) -> tuple[list[str], list[str]]:
    """Question and answer words: the last non-empty line is the answer, or the last sentence of one line."""
    lines = [x for x in (text or "").split("\n") if words(x)]
    if len(lines) == 1:
        lines = [x for x in re.split(r"(?<=[.?!])\s+", lines[0]) if words(x)]
    if len(lines) < 2:
        return words(text), []
    return words("\n".join(lines[:-1])), words(lines[-1])


def part_overlap(part: list[str], have: list[str], have_shingles: set[tuple[str, ...]]) -> float:
    """Share of a part's shingles in a window; a part under five words stands there as a whole or not."""
    if not part:
        return 0.0
    if len(part) < SHINGLE:
        return float(any(have[i : i + len(part)] == part for i in range(len(have) - len(part) + 1)))
    s = shingles(part)
    return len(s & have_shingles) / len(s)


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, .. of ``size[0]`` numbers, then those of the next."""
    total = int(size.sum())
    return np.arange(total) - np.repeat(np.cumsum(size) - size - start, size)


@dataclass
class Corpus:
    """What BM25 needs of all items, whatever the slice: their number, mean length, and in how many each word stands."""

    n: int
    mean: float
    df: dict[str, int]


def corpus_of(items: list[tuple[int, str | None]]) -> Corpus:
    all_words = [w for w in (words(t) for _, t in items) if w]
    return Corpus(len(all_words), sum(map(len, all_words)) / max(1, len(all_words)), Counter(x for w in all_words for x in set(w)))


class Index:
    """Inverted index of one slice of items: sparse block maxima of pivot terms, impacts, thresholds."""

    def __init__(self, items: list[tuple[int, str | None]], share: float = SHARE, corpus: Corpus | None = None):
        corpus = corpus or corpus_of(items)
        rows = sorted(((i, words(t), t) for i, t in items if words(t)), key=lambda x: len(x[1]))
        self.ids = [i for i, _, _ in rows]
        self.words = [w for _, w, _ in rows]
        self.parts = [split_item(t) for _, _, t in rows]
        self.longest = max((len(w) for w in self.words), default=1)
        mean, df = corpus.mean, corpus.df
        self.term = {x: k for k, x in enumerate(dict.fromkeys(x for w in self.words for x in w))}
        idf = {x: log(1 + (corpus.n - df[x] + 0.5) / (df[x] + 0.5)) for x in self.term}
        self.impacts: list[dict[int, float]] = []
        self.threshold, need = np.zeros(len(rows)), np.zeros(len(rows))
        maxima: dict[tuple[int, int], float] = {}
        for k, w in enumerate(self.words):
            tf: dict[str, int] = {}
            for x in w:
                tf[x] = tf.get(x, 0) + 1
            imp = {self.term[x]: idf[x] * n * (K1 + 1) / (n + K1 * (1 - B + B * len(w) / mean)) for x, n in tf.items()}
            self.impacts.append(imp)
            lost = int((1 - share) * len(shingles(w)) + 1e-9)
            strongest = sorted(imp.items(), key=lambda x: -x[1])
            self.threshold[k] = sum(imp.values()) - sum(v for _, v in strongest[:lost]) - 1e-3
            rest = sum(imp.values())
            for t, v in strongest:
                if rest <= PIVOT * self.threshold[k]:
                    break
                rest -= v
                at = (t, k // BLOCK)
                maxima[at] = max(maxima.get(at, 0.0), v)
            need[k] = self.threshold[k] - rest - 1e-3
        self.n_block = -(-len(rows) // BLOCK)
        self.need = np.array([need[b * BLOCK : (b + 1) * BLOCK].min() for b in range(self.n_block)])
        # postings by term: blocks and their largest impacts; a term's run starts at first[term]
        order = sorted(maxima)
        term = np.array([t for t, _ in order], dtype=np.int64)
        self.block, self.top = np.array([b for _, b in order], dtype=np.int32), np.array([maxima[x] for x in order])
        self.first = np.searchsorted(term, np.arange(len(self.term) + 1))

    def size(self) -> int:
        """Bytes of the postings."""
        return self.block.nbytes + self.top.nbytes + self.first.nbytes

    def search(self, texts: list[str | None], share: float = SHARE) -> list[tuple[int, int, float, float, float, float]]:
        """(text number, item id, score, overlap, question overlap, answer overlap), best passage each."""
        found: dict[tuple[int, int], tuple] = {}
        if not self.ids:
            return []
        # wide windows of three steps hold each passage of every item: 3 longest <= 2 steps
        step, get = -(-3 * self.longest // 2), self.term.get
        all_words = [words(t) for t in texts]
        n = np.array([len(w) for w in all_words], dtype=np.int64)
        term = np.fromiter(map(get, chain.from_iterable(all_words), repeat(-1)), dtype=np.int64, count=int(n.sum()))
        doc = np.repeat(np.arange(len(n)), n)
        pos = np.arange(len(term)) - np.repeat(np.cumsum(n) - n, n)
        chunks = -(-n // step)
        n_win = np.maximum(chunks - 2, (n > 0).astype(np.int64))
        base = np.cumsum(n_win) - n_win
        hit = (term >= 0) & (self.first[term + 1] > self.first[term])
        term, doc, chunk = term[hit], doc[hit], (pos // step)[hit]
        keys = []
        for back in range(3):
            w = chunk - back
            ok = (w >= 0) & (w < n_win[doc])
            keys.append((base[doc[ok]] + w[ok]) * len(self.term) + term[ok])
        key = np.unique(np.concatenate(keys))
        win, term = key // len(self.term), key % len(self.term)
        per = max(1, CELLS // self.n_block)
        for lo in range(0, int(win[-1]) + 1 if len(win) else 0, per):
            a, z = np.searchsorted(win, (lo, lo + per))
            size = self.first[term[a:z] + 1] - self.first[term[a:z]]
            at = _ranges(self.first[term[a:z]], size)
            cell = np.repeat(win[a:z] - lo, size) * self.n_block + self.block[at]
            bound = np.bincount(cell, weights=self.top[at], minlength=0)
            some = np.flatnonzero(bound > 0)
            some = some[bound[some] >= self.need[some % self.n_block]]
            last, have = -1, None
            for c in some.tolist():
                w, b = lo + c // self.n_block, c % self.n_block
                if w != last:
                    last = w
                    d = int(np.searchsorted(base, w, side="right") - 1)
                    first = int(w - base[d]) * step
                    have = all_words[d][first : first + 3 * step]
                    terms, sh = {get(x) for x in have}, None
                for k in range(b * BLOCK, min((b + 1) * BLOCK, len(self.ids))):
                    if sum(v for t, v in self.impacts[k].items() if t in terms) < self.threshold[k]:
                        continue
                    mine = shingles(self.words[k])
                    if sh is None:
                        sh = shingles(have)
                    if len(mine & sh) < share * len(mine) and len(self.words[k]) >= SHINGLE and len(have) >= SHINGLE:
                        continue
                    self._passages(d, k, all_words[d], first, len(have), share, mine, found)
        return [(d, self.ids[k], *v) for (d, k), v in sorted(found.items())]

    def _passages(self, d: int, k: int, text: list[str], first: int, wide: int, share: float, mine: set, found: dict) -> None:
        """The best passage of item ``k`` that starts in a wide window of the text, if it reaches the share."""
        size = len(self.words[k])
        last = max(-(-len(text) // size) - 3, 0)
        for p in range(-(-first // size), min(last, (first + wide - 1) // size) + 1):
            have = text[p * size : (p + 3) * size]
            sh = shingles(have)
            over = len(mine & sh) / len(mine) if size >= SHINGLE else part_overlap(self.words[k], have, sh)
            if over >= share:
                parts = [part_overlap(y, have, sh) for y in self.parts[k]]
                old = found.get((d, k))
                if old is None or (parts[0] >= QUESTION, over) > (old[2] >= QUESTION, old[1]):
                    terms = {self.term.get(x) for x in have}
                    found[d, k] = (sum(v for t, v in self.impacts[k].items() if t in terms), over, *parts)


def slices_of(items: DataFrame, id_col: str, text_col: str):
    """(corpus, rows) of each slice of checked size, by hash of id and text; null ids take part under null.

    Word counts are those of all items. A benchmark of several slices is counted by Spark, and a slice asks for its
    own words, so the driver holds one slice and its words at a time.
    """
    x = items.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t"))
    n, chars = x.agg(F.count("*"), F.coalesce(F.sum(F.length("t")), F.lit(0))).first()
    parts = max(1, -(-n // SLICE_ITEMS), -(-chars // SLICE_CHARS))
    if parts == 1:
        rows = [(r.i, r.t) for r in x.collect()]
        yield corpus_of(rows), rows
        return

    def counted(batches):
        for b in batches:
            each = [words(t) for t in b["t"]]
            rows = [(x, 1, 0, 0) for w in each for x in set(w)] + [("", 0, 1, len(w)) for w in each if w]  # no word is empty
            yield pd.DataFrame(rows, columns=["word", "df", "n", "length"]).groupby("word", as_index=False).sum()

    counts = x.select("t").mapInPandas(counted, "word string, df long, n long, length long").groupBy("word").agg(F.sum("df").alias("df"), F.sum("n").alias("n"), F.sum("length").alias("length"))
    counts = Scratch(items.sparkSession, "decontam").keep(counts)
    total = counts.where("word = ''").first()
    number, length = (total.n, total.length) if total else (0, 0)
    for k in range(parts):
        part = x.where(F.pmod(F.xxhash64("i", "t"), F.lit(parts)) == k)
        rows = [(r.i, r.t) for r in part.collect()]
        mine = items.sparkSession.createDataFrame([(w,) for w in {w for _, t in rows for w in words(t)}], "word string")
        yield Corpus(number, length / max(1, number), {r.word: r.df for r in counts.join(mine, "word", "left_semi").collect()}), rows


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", share: float = SHARE) -> DataFrame:
    """Rows (id_col, item_id, score, overlap, question_overlap, answer_overlap, verified).

    One row per document row and test item of which at least ``share`` of the five-word shingles
    stand in one passage together with at least QUESTION of the question's; the values are those of the best passage.
    ``verified`` names the parts that the passage holds to ``share``: question, answer, both or neither; an answer without its
    question is no leak. Words are lower-cased runs of letters, digits and underscores. Items, questions and answers under five
    words overlap by 1 where they stand in the passage as a whole, else by 0. Null and empty texts match nothing; null
    ids stay null; repeated rows and items give repeated matches. Items are read to the driver in slices of a
    checked size; each is broadcast, run over all documents and written before the next, so one index is held at a time, and
    scores take their word counts from all items.
    """
    spark, scratch, done = docs.sparkSession, None, []
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()

    def matches(index):
        def run(batches):
            for b in batches:
                ids, texts = b["id"].to_numpy(dtype=object), b["text"].tolist()
                for i in range(0, len(texts), 256):
                    hits = index.value.search(texts[i : i + 256], share)
                    if hits:
                        d, item, *rest = zip(*hits)
                        yield pd.DataFrame({"id": [ids[i + x] for x in d], "item": pd.array(item, dtype="Int64")} | dict(zip(("score", "overlap", "question_overlap", "answer_overlap"), rest)))

        return src.mapInPandas(run, f"id {kind}, item long, score double, overlap double, question_overlap double, answer_overlap double")

    before = None
    for corpus, rows in slices_of(items, item_id, item_text):
        if before is not None:  # more than one slice: the last one's matches are written and its index let go
            scratch = scratch or Scratch(spark, "decontam")
            done.append(scratch.keep(matches(before)))
            before.destroy()
        before = spark.sparkContext.broadcast(Index(rows, share, corpus))
    out = matches(before)
    for part in done:
        out = out.unionByName(part)
    q, a = F.col("question_overlap") >= share, F.col("answer_overlap") >= share
    out = out.where(F.col("question_overlap") >= QUESTION).withColumn("verified", F.when(q & a, "both").when(q, "question").when(a, "answer").otherwise("neither"))
    return out.withColumnsRenamed({"id": id_col, "item": item_id})


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose id has no match; rows with a null id stay."""
    bad = contaminated(docs, items, id_col, text_col).select(id_col).distinct()
    return docs.join(bad, id_col, "left_anti").select(*docs.columns)

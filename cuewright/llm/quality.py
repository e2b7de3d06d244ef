"""Quality scores by positive-unlabelled learning with the non-negative unbiased risk.

A logistic model over binned shape features and hashed character n-grams is fitted to trusted positives and
unlabelled web text: all documents but the trusted positives, whatever labels they may have. The class prior comes from the data: with any scorer, the share of unlabelled rows above a
cut is at least the prior times the share of positives above it, so the smallest ratio over cuts
(on rows that did not fit the scorer) bounds the prior and meets it where the classes part.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample

#: Most trusted positives and most unlabelled rows a fit reads.
FIT_ROWS = 20_000
BINS = 14
PART = 100
CUT = 0.7

_CLASS = np.zeros(128, dtype=np.int64)
for _c in range(128):
    _CLASS[_c] = 1 if chr(_c).islower() else 2 if chr(_c).isupper() else 3 if chr(_c).isdigit() else 4 if chr(_c) == "\n" else 5 if chr(_c).isspace() else 6
N_CLASS = 8 + 128
NAMES = 22
#: Buckets of hashed runs of three characters; each holds its share of a text's runs against an even one, scaled and cut off.
GRAMS, GRAM_SCALE, GRAM_TOP = 256, 0.25, 1.0


def grams(x: np.ndarray) -> np.ndarray:
    """A text's runs of three code points by hash bucket."""
    if len(x) < 3:
        return np.zeros(GRAMS)
    x = x.astype(np.uint64)
    h = ((x[:-2] * np.uint64(0x9E3779B97F4A7C15) + x[1:-1]) * np.uint64(0xBF58476D1CE4E5B9) + x[2:]) * np.uint64(0x94D049BB133111EB)
    return np.minimum(np.bincount((h >> np.uint64(56)).astype(np.int64), minlength=GRAMS) * (GRAM_SCALE * GRAMS / len(h)), GRAM_TOP)


def features(text: str | None) -> np.ndarray:
    """Shape numbers of a whole text, then its character n-grams. Empty: zeros."""
    text = text or ""
    out = np.zeros(NAMES + GRAMS)
    w = text.split()
    n, nw = len(text), len(w)
    if not nw:
        return out
    x = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    c = np.bincount(np.where(x < 128, x, 0), minlength=128)
    kind = np.bincount(_CLASS, weights=c, minlength=7)
    symbols = np.sort(c[_CLASS == 6])[::-1]
    joined = "".join(w)
    lines = [s for s in text.split("\n") if s.strip()]
    parts = [w[i : i + PART] for i in range(0, nw, PART)]
    fresh = np.array([len(set(p)) / len(p) for p in parts])
    rep = sum(map(str.__eq__, w, w[1:])) / nw
    pairs = len(set(zip(w, w[1:]))) / max(1, nw - 1)
    ends = sum(s[-1] in ".!?,;:" for s in w) / nw
    odd = sum(not s[-1].isalnum() and s[-1] not in ".!?,;:'\")" for s in w) / nw
    loud = sum(map(str.isupper, w)) / nw
    plain = sum(map(str.isalnum, w)) / nw
    raw = text.encode("utf-8", "surrogatepass")
    out[NAMES:] = grams(x)
    out[:NAMES] = [
        np.log1p(nw), np.log1p(n), n / nw, kind[1] / n, kind[2] / n, kind[3] / n, kind[4] / n,
        kind[6] / n, symbols[0] / n, symbols[1] / n, symbols[2:].sum() / n,
        rep, fresh.mean(), fresh.min(), pairs, ends, odd, loud, plain,
        len(set(lines)) / len(lines), len(joined) / nw, len(zlib.compress(raw, 1)) / len(raw),
    ]
    return out


@dataclass
class Model:
    edges: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(encode(x, self.edges) @ self.weights + self.bias, -40, 40)))


def encode(x: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Each shape number as 0/1 steps: 1 where it is above an edge; n-grams as they are."""
    return np.concatenate([(x[:, :NAMES, None] > edges[None]).reshape(len(x), -1), x[:, NAMES:]], axis=1, dtype=np.float32)


def _edges(x: np.ndarray) -> np.ndarray:
    q = np.r_[0.001, 0.004, 0.01, 0.03, np.linspace(0.1, 0.9, BINS - 8), 0.97, 0.99, 0.996, 0.999]
    return np.quantile(x, q, axis=0).T


def _sig(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def risk(xp: np.ndarray, xu: np.ndarray, w: np.ndarray, b: float, prior: float) -> tuple[float, float]:
    """The two parts of the unbiased risk under logistic loss: prior * R_p(+), and R_u(-) - prior * R_p(-)."""
    loss = lambda z: np.mean(np.logaddexp(0, z))
    zp, zu = xp @ w + b, xu @ w + b
    return prior * loss(-zp), loss(zu) - prior * loss(zp)


def risk_gradient(xp: np.ndarray, xu: np.ndarray, w: np.ndarray, b: float, prior: float) -> np.ndarray:
    """Direction of descent for (w, b): the gradient of both parts; where the second is negative, minus its own alone."""
    sp, su = _sig(xp @ w + b), _sig(xu @ w + b)
    if risk(xp, xu, w, b, prior)[1] >= 0:
        gp, gu = -prior * np.ones_like(sp) / len(sp), su / len(su)  # prior * (s - 1) - prior * s
    else:  # undo overfitting of the unlabelled part
        gp, gu = prior * sp / len(sp), -su / len(su)
    return np.r_[xp.T @ gp + xu.T @ gu, gp.sum() + gu.sum()]


def _fit(p: np.ndarray, u: np.ndarray, edges: np.ndarray, prior: float, nonneg: bool, steps: int = 1000, rate: float = 0.03, l2: float = 0.003, seed: int = 3):
    """Adam on the risk prior * R_p(+) + max(0, R_u(-) - prior * R_p(-)), or on plain P against U; the mean of the second half's steps."""
    rng, d = np.random.default_rng(seed), edges.size + GRAMS
    w, b, m, v, total = np.zeros(d, np.float32), 0.0, np.zeros(d + 1), np.zeros(d + 1), np.zeros(d + 1)
    for t in range(1, steps + 1):
        xp, xu = (encode(x[rng.integers(0, len(x), 1024)], edges) for x in (p, u))  # only a batch is ever encoded
        if nonneg:
            g = risk_gradient(xp, xu, w, b, prior)
        else:
            gp, gu = (_sig(xp @ w + b) - 1) / len(xp), _sig(xu @ w + b) / len(xu)
            g = np.r_[xp.T @ gp + xu.T @ gu, gp.sum() + gu.sum()]
        g[:-1] += l2 * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = (w - step[:-1]).astype(np.float32), float(b - step[-1])
        if 2 * t > steps:
            total += np.r_[w, b]
    mean = total / (steps - steps // 2)
    return mean[:-1].astype(np.float32), float(mean[-1])


def estimate_prior(p: np.ndarray, u: np.ndarray) -> float:
    """Smallest ratio of unlabelled to positive mass over upper score ranges that hold half of the positives.

    The unlabelled share counts with its standard error: the smallest of many noisy ratios lies too low, and under a
    prior below the true one no document scores high.
    """
    ratios = []
    for c in np.quantile(p, np.linspace(0.0, 0.5, 41)):
        above = np.mean(u >= c)
        ratios.append((above + np.sqrt(above * (1 - above) / len(u))) / max(1e-9, np.mean(p >= c)))
    return float(np.clip(min(ratios), 0.02, 0.98))


def fit(positive: np.ndarray, unlabelled: np.ndarray) -> Model:
    """A model from feature rows; without positives, or where every document is one, it scores 0.5 throughout."""
    if not len(positive) or not len(unlabelled):
        return Model(np.zeros((NAMES, BINS)), np.zeros(NAMES * BINS + GRAMS, np.float32), 0.0, 0.5)
    p, u = positive, unlabelled
    edges = _edges(np.concatenate([p[:, :NAMES], u[:, :NAMES]]))
    w, b = _fit(p[::2], u[::2], edges, 0.5, nonneg=False, steps=600)
    value = lambda x: np.concatenate([encode(x[i : i + 1024], edges) @ w + b for i in range(0, len(x), 1024)])
    prior = estimate_prior(value(p[1::2]), value(u[1::2])) if len(p) > 1 and len(u) > 1 else 0.5
    return Model(edges, *_fit(p, u, edges, prior, nonneg=True), prior)


def feature_rows(df: DataFrame, text_col: str) -> np.ndarray:
    """A row of 4-byte numbers a text, in an order of their own: the same fit in whatever order Spark gives the rows."""

    def run(batches):
        for b in batches:
            if len(b):
                yield pd.DataFrame({"f": [features(t).astype(np.float32).tobytes() for t in b["text"]]})

    rows = df.select(F.col(text_col).cast("string").alias("text")).mapInPandas(run, "f binary").toPandas()
    raw = sorted(rows["f"].tolist())
    return np.frombuffer(b"".join(raw), np.float32).reshape(-1, NAMES + GRAMS)


def train(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", fit_rows: int = FIT_ROWS) -> Model:
    """Fit on labelled positives where ``learn`` holds and on all other documents as unlabelled ones.

    Whether another row has a label, and which, plays no part. Both sides are read through a hash sample of about
    ``fit_rows`` ids at most, one text an id (that of the smallest hash), so only so many rows of numbers reach the driver.
    Labels of a repeated id count once, positive if any is.
    """
    marks = labels.where(learn & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max(label_col).alias("__y"))
    good = marks.where(F.col("__y") == 1).select(id_col)
    rest = docs.select(id_col).where(F.col(id_col).isNotNull()).distinct().join(good, id_col, "left_anti")
    one = lambda ids: docs.select(id_col, F.col(text_col).cast("string").alias("text")).join(bounded_sample(ids, id_col, fit_rows), id_col, "left_semi").groupBy(id_col).agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    return fit(feature_rows(one(good), "text"), feature_rows(one(rest), "text"))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` ids with their score: (id_col, score), one row per input row, 0 to 1, empty texts too."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for b in batches:
            x = np.array([features(t) for t in b["text"]]).reshape(-1, NAMES + GRAMS)
            yield pd.DataFrame({"id": b["id"], "score": shared.value.score(x)})

    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return src.mapInPandas(run, f"id {kind}, score double").withColumnsRenamed({"id": id_col})


def held_out(id_col: str, folds: int, fold: int) -> Column:
    """True where crc32 of the id as text leaves ``fold``; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == fold, F.lit(False))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", cut: float = CUT) -> DataFrame:
    """The rows of ``docs`` scored ``cut`` or more, all columns and repeats kept, null ids too."""
    model = train(docs, labels, ~held_out(id_col, 4, 2), id_col, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def value(text: pd.Series) -> pd.Series:
        return pd.Series(shared.value.score(np.array([features(t) for t in text]).reshape(-1, NAMES + GRAMS)))

    return docs.where(value(F.col(text_col).cast("string")) >= cut)

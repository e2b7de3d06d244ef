"""Personal data: fixed rules, and a character BiLSTM with CRF transitions that adds spans.

The rules find emails, addresses, card and phone numbers. The model is a bidirectional LSTM over
characters (piecewise linear gates) whose outputs are tag scores of a linear-chain CRF; it is
trained in numpy on spans that the rules label in a bounded sample of the corpus and on generated
ones in further spellings set into corpus text. A whole text is read in overlapping windows. Each
character's scores come from the window in which it lies farthest from an edge, and one Viterbi
path over the whole text reconciles the windows. Positions that no stretch of other tags could pay
for are fixed to "outside" first, so the search runs on what is left, with the same result. A model span is added if it has its kind's digits and touches no span of the rules.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, slices

KINDS = ("email", "ip", "card", "phone")
TAGS = len(KINDS) + 1
#: Bounds of the fit: documents whose rule spans label windows, and windows kept.
FIT_DOCS, FIT_WINDOWS = 4_000, 6_000
HIDDEN = 8
TRAIN_LEN, WINDOW, OVERLAP = 96, 512, 64
BATCH = 1024
N_CHAR = 132

# fixed values: the base patterns
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
# the same matches as the plain pattern, in linear time: a match never starts inside a run of digits, and the run is not given back
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = ord(d) - 48
        total += x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches, found from their @ signs: linear in the text."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL_CHARS:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    return out


def rule_spans(text: str | None) -> list[tuple[int, int, int]]:
    """(kind number, start, end) by kind, then start: leftmost non-overlapping per kind."""
    text = text or ""
    out = [(0, a, b) for a, b in _emails(text)]
    if DIGIT.search(text):
        for m in IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
                out.append((1, m.start(), m.end()))
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 16 and 16 <= len(d := _digits(m[0])) <= 19 and luhn(d):
                out.append((2, m.start(), m.end()))
        for m in PHONE.finditer(text):
            if 8 <= len(_digits(m[0])) <= 15:
                out.append((3, m.start(), m.end()))
    return out


def plausible(kind: int, s: str) -> bool:
    """What a model span needs to be added: its kind's digits, and an address sign for emails."""
    d = _digits(s)
    if kind == 0:
        return bool(re.fullmatch(r"[^\s@]+\s?(?:@|\(at\)|\[at\]| at )\s?[^\s@]+(?:\s?(?:\.|\(dot\)|\[dot\]| dot )\s?[^\s@.]+)+", s, re.I))
    if kind == 1:
        p = re.split(r"\s?(?:\.|\[\.\]|\(\.\))\s?", s)
        return len(p) == 4 and all(x.isascii() and x.isdigit() and len(x) <= 3 and int(x) <= 255 for x in p)
    if kind == 2:
        return 13 <= len(d) <= 19 and luhn(d) and s[0].isdigit() and s[-1].isdigit()
    return 8 <= len(d) <= 15 and (s[0] in "+(" or s.startswith("00")) and s[-1].isdigit()


def char_ids(text: str) -> np.ndarray:
    """ASCII as it is; other letters one class, all else another. 0 is padding."""
    x = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    return np.where(x < 128, x + 1, np.where((x < 0x2000) | (x > 0x2BFF), 130, 131)).astype(np.int32)


@dataclass
class Net:
    """Input tables (2, N_CHAR, 4H), recurrent weights (2, H, 4H), outputs and transitions."""

    x: np.ndarray
    u: np.ndarray
    w: np.ndarray
    b: np.ndarray
    a: np.ndarray

    def params(self):
        return [self.x, self.u, self.w, self.b, self.a]

    @staticmethod
    def new(seed: int) -> Net:
        r, h = np.random.default_rng(seed), HIDDEN
        x = r.normal(0, 0.5, (2, N_CHAR, 4 * h))
        x[:, :, h : 2 * h] += 1.0  # remember at first
        return Net(*(p.astype(np.float32) for p in (x, r.normal(0, 0.3, (2, h, 4 * h)), r.normal(0, 0.3, (2 * h, TAGS)), np.array([2.0] + [0.0] * (TAGS - 1)), np.where(np.eye(TAGS) > 0, 1.0, -1.0))))


_LOW = np.repeat(np.array([0, 0, 0, -1], np.float32), HIDDEN)
_SLOPE = np.repeat(np.array([0.25, 0.25, 0.25, 1.0], np.float32), HIDDEN)
_SHIFT = np.repeat(np.array([0.5, 0.5, 0.5, 0.0], np.float32), HIDDEN)


def emissions(net: Net, ids: np.ndarray) -> np.ndarray:
    """Tag scores (T, B, TAGS) of character ids (T, B); gates in, forget, out, new."""
    t_max, n, h = ids.shape[0], ids.shape[1], HIDDEN
    out = np.empty((t_max, n, TAGS), np.float32)
    for d in range(2):
        table, u, w = net.x[d] * _SLOPE + _SHIFT, net.u[d] * _SLOPE, net.w[d * h : (d + 1) * h]
        c, hid, z, zu = np.zeros((n, h), np.float32), np.zeros((n, h), np.float32), np.empty((n, 4 * h), np.float32), np.empty((n, 4 * h), np.float32)
        tmp = np.empty((n, h), np.float32)
        for t in range(t_max) if d == 0 else range(t_max - 1, -1, -1):
            np.take(table, ids[t], axis=0, out=z, mode="clip")
            np.matmul(hid, u, out=zu)
            z += zu
            np.maximum(z, _LOW, out=z)
            np.minimum(z, 1, out=z)
            np.multiply(z[:, h : 2 * h], c, out=c)
            np.multiply(z[:, :h], z[:, 3 * h :], out=tmp)
            c += tmp
            np.clip(c, -1, 1, out=tmp)
            np.multiply(z[:, 2 * h : 3 * h], tmp, out=hid)
            if d == 0:
                np.matmul(hid, w, out=out[t])
            else:
                out[t] += hid @ w
    out += net.b
    return out


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis=axis, keepdims=True)
    return (m + np.log(np.exp(x - m).sum(axis=axis, keepdims=True))).squeeze(axis)


def loss_and_grads(net: Net, ids: np.ndarray, tags: np.ndarray):
    """Mean negative log-likelihood of tag paths and its gradients, by backpropagation through time."""
    t_max, n, h = ids.shape[0], ids.shape[1], HIDDEN
    keep = []
    e = np.zeros((t_max, n, TAGS), np.float32) + net.b
    for d in range(2):
        c, hid = np.zeros((n, h), np.float32), np.zeros((n, h), np.float32)
        steps = []
        for t in range(t_max) if d == 0 else range(t_max - 1, -1, -1):
            raw = (net.x[d][ids[t]] + hid @ net.u[d]) * _SLOPE + _SHIFT
            z = np.minimum(np.maximum(raw, _LOW), 1)
            c_old, h_old = c, hid
            c = z[:, h : 2 * h] * c + z[:, :h] * z[:, 3 * h :]
            tc = np.clip(c, -1, 1)
            hid = z[:, 2 * h : 3 * h] * tc
            e[t] += hid @ net.w[d * h : (d + 1) * h]
            steps.append((t, z, (raw > _LOW) & (raw < 1), c_old, h_old, c, tc, hid))
        keep.append(steps)
    alpha, beta = np.empty_like(e), np.zeros_like(e)
    alpha[0] = e[0]
    for t in range(1, t_max):
        alpha[t] = e[t] + _lse(alpha[t - 1][:, :, None] + net.a[None], 1)
    for t in range(t_max - 2, -1, -1):
        beta[t] = _lse(net.a[None] + (e[t + 1] + beta[t + 1])[:, None, :], 2)
    logz = _lse(alpha[-1], 1)
    rows = np.arange(n)
    gold = sum(e[t, rows, tags[t]] for t in range(t_max)) + sum(net.a[tags[t - 1], tags[t]] for t in range(1, t_max))
    de = np.exp(alpha + beta - logz[None, :, None])
    for t in range(t_max):
        de[t, rows, tags[t]] -= 1
    de /= n
    ga = np.zeros_like(net.a)
    for t in range(1, t_max):
        ga += np.exp(alpha[t - 1][:, :, None] + net.a[None] + (e[t] + beta[t])[:, None, :] - logz[:, None, None]).sum(0)
        np.add.at(ga, (tags[t - 1], tags[t]), -1)
    ga /= n
    gx, gu, gw = np.zeros_like(net.x), np.zeros_like(net.u), np.zeros_like(net.w)
    for d in range(2):
        dh_next, dc_next = np.zeros((n, h), np.float32), np.zeros((n, h), np.float32)
        w = net.w[d * h : (d + 1) * h]
        for t, z, open_, c_old, h_old, c, tc, hid in reversed(keep[d]):
            gw[d * h : (d + 1) * h] += hid.T @ de[t]
            dh = de[t] @ w.T + dh_next
            dc = dc_next + dh * z[:, 2 * h : 3 * h] * (np.abs(c) < 1)
            dz = np.concatenate([dc * z[:, 3 * h :], dc * c_old, dh * tc, dc * z[:, :h]], axis=1) * open_ * _SLOPE
            np.add.at(gx[d], ids[t], dz)
            gu[d] += h_old.T @ dz
            dh_next, dc_next = dz @ net.u[d].T, dc * z[:, h : 2 * h]
    return float((logz - gold).mean()), [gx, gu, gw, de.sum((0, 1)), ga]


def generated(rng: np.random.Generator) -> tuple[int, str]:
    """A kind and a made-up value of it, in common and in disguised spellings."""
    pick = lambda *x: x[rng.integers(len(x))]
    num = lambda k: "".join(map(str, rng.integers(0, 10, k)))
    word = lambda: "".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(2, 9)))
    kind = int(rng.integers(0, 4))
    if kind == 0:
        at, dot = pick(("@", "."), ("@", "."), (" (at) ", " (dot) "), (" [at] ", " [dot] "), ("(at)", "."))
        return kind, word() + pick("", "." + word(), num(2), "_" + word()) + at + word() + pick("", num(1)) + dot + pick("com", "org", "net", "de", "example" + dot + "com")
    if kind == 1:
        return kind, pick(".", ".", "[.]").join(str(rng.integers(0, 256)) for _ in range(4))
    if kind == 2:
        d = num(15)
        d += next(c for c in "0123456789" if luhn(d + c))
        s = pick("", "", " ", "-")
        return kind, s.join((d[:4], d[4:8], d[8:12], d[12:]))
    cc, a, b, c = pick("+1", "+44", "+33", "+49", "0049", "001"), num(3), num(3), num(4)
    return kind, pick(f"{cc} ({a}) {b}-{c}", f"{cc} {a} {b} {c}", f"{cc}-{a}-{b}-{c}", f"{cc}{a}{b}{c}", f"({a}) {b}-{c}")


def train(windows: list[tuple[str, list[tuple[int, int, int]]]], steps: int = 260, batch: int = 64, rate: float = 0.02, seed: int = 11) -> Net:
    """Adam on labelled windows, about half of them with a generated span put in at a space."""
    rng, net = np.random.default_rng(seed), Net.new(seed)
    m, v = [np.zeros_like(p) for p in net.params()], [np.zeros_like(p) for p in net.params()]
    windows = windows or [("the of and to in that is was for on as with by at " * 3, [])]
    for step in range(1, steps + 1):
        ids, tags = np.zeros((TRAIN_LEN, batch), np.int32), np.zeros((TRAIN_LEN, batch), np.int64)
        for j in range(batch):
            text, spans = windows[rng.integers(len(windows))]
            y = np.zeros(len(text), np.int64)
            for k, a, b in spans:
                y[a:b] = k + 1
            if rng.random() < 0.5:
                gaps = [i for i in range(len(text)) if text[i] == " " and y[i] == 0]
                at = gaps[rng.integers(len(gaps))] if gaps else 0
                kind, s = generated(rng)
                pad = " " if gaps else ""
                text = text[:at] + pad + s + text[at:]
                y = np.concatenate([y[:at], np.zeros(len(pad), np.int64), np.full(len(s), kind + 1), y[at:]])
            off = rng.integers(0, max(1, len(text) - TRAIN_LEN + 1))
            part = text[off : off + TRAIN_LEN]
            ids[: len(part), j], tags[: len(part), j] = char_ids(part), y[off : off + TRAIN_LEN]
        _, grads = loss_and_grads(net, ids, tags)
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
        lr = rate * (1 - 0.9 * step / steps)
        for p, g, mm, vv in zip(net.params(), grads, m, v):
            g = g * min(1.0, 5.0 / (norm + 1e-9))
            mm *= 0.9
            mm += 0.1 * g
            vv *= 0.995
            vv += 0.005 * g * g
            p -= lr * (mm / (1 - 0.9**step)) / (np.sqrt(vv / (1 - 0.995**step)) + 1e-7)
    return net


def doubtful(e: np.ndarray, a: np.ndarray) -> np.ndarray:
    """Positions that may be tagged other than "outside" on the best path.

    A stretch of other tags pays its way in and out; what it gains is at most the sum of its
    positions' best leads over "outside" plus the best inner transitions. A position is cleared if
    no stretch through it can gain. Stretches at an end of the text save the way there.
    """
    inner, stay, way_in, way_out = a[1:, 1:].max(), a[0, 0], a[0, 1:].max(), a[1:, 0].max()
    gain = (e[:, 1:].max(axis=1) - e[:, 0]).astype(np.float64) + (inner - stay)
    gain[0] += max(0.0, stay - way_in)
    gain[-1] += max(0.0, stay - way_out)
    s = np.r_[0.0, np.cumsum(gain)]
    best = np.maximum.accumulate(s[:0:-1])[::-1] - np.minimum.accumulate(s[:-1])
    return np.flatnonzero(best > inner + stay - way_in - way_out - 1e-3)


def viterbi(e: np.ndarray, a: np.ndarray, before: int | None, after: int | None) -> np.ndarray:
    """Best tag path of scores (T, TAGS), with fixed tags beside it where there are some."""
    s = e[0] + (a[before] if before is not None else 0)
    back = np.zeros((len(e), TAGS), np.int64)
    for t in range(1, len(e)):
        m = s[:, None] + a
        back[t] = m.argmax(0)
        s = m.max(0) + e[t]
    if after is not None:
        s = s + a[:, after]
    path = np.empty(len(e), np.int64)
    path[-1] = int(s.argmax())
    for t in range(len(e) - 1, 0, -1):
        path[t - 1] = back[t, path[t]]
    return path


def decode(e: np.ndarray, a: np.ndarray) -> list[tuple[int, int, int]]:
    """Spans (kind, start, end) of the best path over a whole text."""
    doubt = doubtful(e, a)
    if not len(doubt):
        return []
    cut = np.flatnonzero(np.r_[True, np.diff(doubt) > 1])
    spans = []
    for i, s in enumerate(cut):
        lo, hi = int(doubt[s]), int(doubt[(cut[i + 1] if i + 1 < len(cut) else len(doubt)) - 1]) + 1
        path = viterbi(e[lo:hi], a, 0 if lo else None, 0 if hi < len(e) else None)
        change = np.flatnonzero(np.r_[True, path[1:] != path[:-1], True])
        spans += [(int(path[x]) - 1, lo + int(x), lo + int(y)) for x, y in zip(change, change[1:]) if path[x]]
    return spans


def window_starts(n: int) -> list[int]:
    if n <= WINDOW:
        return [0] if n else []
    s = list(range(0, n - WINDOW, WINDOW - OVERLAP))
    return [*s, n - WINDOW]


def model_spans(net: Net, texts: list[str | None]) -> list[list[tuple[int, int, int]]]:
    """Per text, spans of the best path; all windows of a slice of texts run side by side.

    A character's scores come from the window in which it is farthest from an edge.
    """
    out: list = [[] for _ in texts]
    ids = [char_ids(t or "") for t in texts]
    starts = [window_starts(len(x)) for x in ids]
    jobs = sorted((min(WINDOW, len(x)), i, k, s) for i, x in enumerate(ids) for k, s in enumerate(starts[i]))
    left = [len(s) for s in starts]
    score: dict[int, np.ndarray] = {}
    for at in range(0, len(jobs), BATCH):
        part = jobs[at : at + BATCH]
        grid = np.zeros((part[-1][0], len(part)), np.int32)
        for j, (n, i, k, s) in enumerate(part):
            grid[:n, j] = ids[i][s : s + n]
        e = emissions(net, grid)
        for j, (n, i, k, s) in enumerate(part):
            size = len(ids[i])
            if size <= WINDOW:
                out[i] = decode(e[:n, j], net.a)
                continue
            if i not in score:
                score[i] = np.empty((size, TAGS), np.float32)
            lo = 0 if k == 0 else (starts[i][k - 1] + WINDOW + s) // 2
            hi = size if k == len(starts[i]) - 1 else (s + WINDOW + starts[i][k + 1]) // 2
            score[i][lo:hi] = e[lo - s : hi - s, j]
            left[i] -= 1
            if not left[i]:
                out[i] = decode(score.pop(i), net.a)
    return out


def all_spans(texts: list[str | None], net: Net) -> list[tuple[list, list]]:
    """Per text the rules' spans and the added ones, each by kind, then start."""
    result = []
    for text, more in zip(texts, model_spans(net, texts)):
        base = rule_spans(text)
        added = []
        for k, a, b in more:
            while a < b and text[a].isspace():
                a += 1
            while b > a and text[b - 1].isspace():
                b -= 1
            if a < b and plausible(k, text[a:b]) and all(b <= x or y <= a for _, x, y in base):
                added.append((k, a, b))
        result.append((base, sorted(added)))
    return result


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fit_docs: int = FIT_DOCS, fit_windows: int = FIT_WINDOWS) -> Net:
    """A model from windows of at most about ``fit_docs`` rows; at most ``fit_windows`` reach the driver."""

    def cut(batches):
        for b in batches:
            rows = []
            for key, text in zip(b["key"], b["text"]):
                text = text or ""
                spans = rule_spans(text)
                rng = np.random.default_rng(int(key) & 0x7FFFFFFF)
                starts = [max(0, a - int(rng.integers(0, TRAIN_LEN))) for _, a, _ in spans] + [int(rng.integers(0, max(1, len(text) - 2 * TRAIN_LEN)))]
                for s in starts:
                    e = s + 2 * TRAIN_LEN
                    here = [(k, max(0, a - s), min(b_, e) - s) for k, a, b_ in spans if b_ > s and a < e]
                    rows.append((text[s:e], [x for y in here for x in y], int(key) ^ s))
            yield pd.DataFrame(rows, columns=["text", "spans", "rank"])

    src = bounded_sample(docs, id_col, fit_docs).select(F.xxhash64(id_col, text_col).alias("key"), F.col(text_col).cast("string").alias("text"))
    rows = src.mapInPandas(cut, "text string, spans array<int>, rank long").orderBy("rank", "text").limit(fit_windows).toPandas()
    return train([(t, [tuple(map(int, s[i : i + 3])) for i in range(0, len(s), 3)]) for t, s in zip(rows["text"], rows["spans"])])


SPAN = "array<struct<kind:string,start:int,end:int,added:boolean>>"


def find_private(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", net: Net | None = None) -> DataFrame:
    """(id_col, spans): one row per input row, spans by kind as in KINDS, then start.

    Offsets are code points, ends exclusive; ``added`` marks what the model adds to the rules.
    Null and empty texts have none. Ids may be null or repeat; each row stands alone. Other
    columns are ignored; an empty table gives an empty one.
    """
    net = net or fit(docs, id_col, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(net)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for b in batches:
            ids = b["id"]
            for start, part in slices(b["text"].tolist(), 600_000):
                found = [sorted([(*s, False) for s in base] + [(*s, True) for s in more]) for base, more in all_spans(part, shared.value)]
                rows = [[{"kind": KINDS[k], "start": a, "end": z, "added": m} for k, a, z, m in f] for f in found]
                yield pd.DataFrame({"id": ids.iloc[start : start + len(part)].to_numpy(dtype=object), "spans": rows})

    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return src.mapInPandas(run, f"id {kind}, spans {SPAN}").withColumnsRenamed({"id": id_col})


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", net: Net | None = None) -> DataFrame:
    """``docs`` with each span of the text replaced by its kind in angle brackets, all columns kept.

    Overlapping spans become one mark, named by the first. Null texts stay null.
    """
    shared = docs.sparkSession.sparkContext.broadcast(net or fit(docs, id_col, text_col))

    def clean(text, spans):
        out, at = [], 0
        for a, b, k in sorted((a, b, k) for k, a, b in spans):
            if a >= at:
                out += [text[at:a], f"<{KINDS[k]}>"]
            at = max(at, b)
        return "".join([*out, text[at:]])

    @F.pandas_udf("string")
    def run(t: pd.Series) -> pd.Series:
        out = []
        for _, part in slices(t.tolist(), 600_000):
            out += [None if x is None else clean(x, base + more) for x, (base, more) in zip(part, all_spans(part, shared.value))]
        return pd.Series(out, dtype=object)

    return docs.withColumn(text_col, run(F.col(text_col).cast("string")))


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def digest(docs: DataFrame, net: Net | None = None) -> DataFrame:
    """The contract's columns from ``find_private``."""
    x = find_private(docs, net=net)
    say = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: ~s["added"])
    count = lambda k: F.size(F.filter("spans", lambda s: ~s["added"] & (s["kind"] == k))).cast("long")
    return x.select(
        "doc_id",
        *(count(k).alias(f"n_{k}") for k in KINDS),
        F.sha2(say(base), 256).alias("base_sha256"),
        say(F.col("spans")).alias("spans"),
        (F.size("spans") - F.size(base)).cast("long").alias("n_added"),
    )


def digest_of(text: str | None) -> str:
    return hashlib.sha256(joined([(KINDS[k], a, b) for k, a, b in rule_spans(text)]).encode()).hexdigest()

"""SimHash near-duplicates over vantage-point shards.

Fingerprints are 64 bits over three-word shingles. Distinct fingerprints are dealt to the leaves
of a vantage-point tree: every inner node has a pivot and a radius, and a fingerprint's home is
inside or outside the ball. A fingerprint also visits each branch that the triangle inequality
cannot rule out for the search radius, so every pair within the radius meets in the home leaf of
its smaller member. The tree is built from a bounded sample; it only balances leaves, and any
tree gives the same pairs.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, partitions
from .components import connected_components

SEED = 42
SHINGLE = 3
RADIUS = 2
LEAF = 2048
TREE_SAMPLE = 20_000


def fingerprint(text: str | None) -> int:
    """The unsigned 64-bit fingerprint of a whole text; null and wordless texts give 0."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) < SHINGLE:
        h = [xxhash.xxh64_intdigest(b" ".join(words), SEED)]
    else:
        digest = xxhash.xxh64_intdigest
        h = [digest(b" ".join(s), SEED) for s in zip(words, words[1:], words[2:])]
    x = np.array(h, dtype="<u8").view(np.uint8).reshape(-1, 8)
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(x), 16384):
        ones += np.unpackbits(x[i : i + 16384], axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row (id, fp) per input row; ``fp`` is the fingerprint as a signed long."""

    def run(batches):
        for b in batches:
            fp = np.array([fingerprint(t) for t in b["text"]], dtype=np.uint64).view(np.int64)
            yield pd.DataFrame({"id": b["id"], "fp": fp})

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInPandas(run, "id long, fp long")


def hamming(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b)


def build_tree(sample: np.ndarray, leaves: int, seed: int = 7) -> list[tuple[int, int, int, int]]:
    """Nodes (pivot, radius, inside, outside); a child below 0 is leaf ``-child - 1``."""
    rng, nodes, n_leaf = np.random.default_rng(seed), [], 0

    def grow(points: np.ndarray, want: int) -> int:
        nonlocal n_leaf
        best = None
        if want > 1 and len(points) >= 2:
            for p in rng.choice(points, size=min(16, len(points)), replace=False):
                d = hamming(points, p)
                for r in {int(np.median(d)), int(np.median(d)) - 1}:
                    inside, near = int((d <= r).sum()), int(((d > r - RADIUS) & (d <= r + RADIUS)).sum())
                    if 0 < inside < len(points):
                        cost = near / len(points) + abs(2 * inside / len(points) - 1)
                        if best is None or cost < best[0]:
                            best = (cost, int(p), r, d <= r)
        if best is None:
            n_leaf += 1
            return -n_leaf
        at = len(nodes)
        nodes.append(None)
        _, p, r, ins = best
        nodes[at] = (p, r, grow(points[ins], want // 2), grow(points[~ins], want - want // 2))
        return at

    grow(sample, leaves)
    return nodes


def route(fps: np.ndarray, nodes: list[tuple[int, int, int, int]], radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, leaf, home) for the home of every fingerprint and each other leaf it must visit."""
    out, todo = [], [(0 if nodes else -1, np.arange(len(fps)), np.ones(len(fps), dtype=bool))]
    while todo:
        node, rows, home = todo.pop()
        if node < 0:
            out.append((rows, np.full(len(rows), -node - 1), home))
            continue
        p, r, inside, outside = nodes[node]
        d = hamming(fps[rows], np.uint64(p)).astype(np.int16)
        for child, may, own in ((inside, d <= r + radius, d <= r), (outside, d > r - radius, d > r)):
            if may.any():
                todo.append((child, rows[may], home[may] & own[may]))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, int), np.zeros(0, int), np.zeros(0, bool))


def leaf_pairs(fps: np.ndarray, home: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs within ``radius`` of a home fingerprint and a larger or home one, once each.

    One more vantage point orders the leaf; only windows whose distance to it differs by at most
    the radius are compared, in blocks.
    """
    own, pivot = np.sort(fps[home]), fps[:1]
    left, right = [], []
    if len(own):
        d_own, d_all = hamming(own, pivot).astype(np.int16), hamming(fps, pivot).astype(np.int16)
        for d in np.unique(d_all):
            near = own[(d_own >= d - radius) & (d_own <= d + radius)]
            mine = fps[d_all == d]
            step = max(1, 2_000_000 // max(1, len(near)))
            for i in range(0, len(mine), step):
                part = mine[i : i + step]
                x, y = np.nonzero((hamming(part[:, None], near[None, :]) <= radius) & (part[:, None] > near[None, :]))
                left.append(part[x])
                right.append(near[y])
    z = np.zeros(0, np.uint64)
    return (np.concatenate(left) if left else z), (np.concatenate(right) if right else z)


def spanning(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Star edges with the same components as the given ones: at most one a node."""
    nodes, inv = np.unique(np.concatenate([left, right]), return_inverse=True)
    a, b, label = inv[: len(left)], inv[len(left) :], np.arange(len(nodes))
    while True:
        low = label.copy()
        np.minimum.at(low, a, label[b])
        np.minimum.at(low, b, label[a])
        low = low[low]
        if (low == label).all():
            break
        label = low
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def near_pairs(fps: DataFrame, radius: int = RADIUS, leaf: int = LEAF) -> DataFrame:
    """Edges (a, b) of distinct fingerprints that keep every component of the within-radius graph.

    ``fps`` has one row per distinct long ``fp``. Only a bounded sample reaches the driver.
    """
    spark = fps.sparkSession
    n = fps.count()
    leaves = max(1, -(-n // leaf))
    nodes: list = []
    if leaves > 1:
        step = max(1, n // TREE_SAMPLE)
        rows = fps.where(F.pmod(F.xxhash64("fp"), F.lit(step)) == 0).limit(2 * TREE_SAMPLE).toPandas()
        nodes = build_tree(rows["fp"].to_numpy(np.int64).view(np.uint64), leaves)

    def deal(batches):
        for b in batches:
            x = b["fp"].to_numpy(np.int64)
            row, to, home = route(x.view(np.uint64), nodes, radius)
            yield pd.DataFrame({"leaf": to.astype(np.int64), "fp": x[row], "home": home})

    def search(batches):
        # a partition holds whole leaves, sorted: one leaf is in memory at a time
        rest = None
        for b in batches:
            rest = b if rest is None else pd.concat([rest, b])
            last = rest["leaf"].iloc[-1] if len(rest) else None
            done, rest = rest[rest["leaf"] != last], rest[rest["leaf"] == last]
            for _, g in done.groupby("leaf", sort=False):
                yield pairs(g)
        if rest is not None and len(rest):
            yield pairs(rest)

    def pairs(g):
        a, b = leaf_pairs(g["fp"].to_numpy(np.int64).view(np.uint64), g["home"].to_numpy(bool), radius)
        a, b = spanning(a, b)
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    dealt = fps.select("fp").mapInPandas(deal, "leaf long, fp long, home boolean")
    return dealt.repartition(max(partitions(spark), min(leaves, 20_000)), "leaf").sortWithinPartitions("leaf").mapInPandas(search, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """One row per input row: id_col, fp (signed long), component_id.

    ``component_id`` is the smallest id reachable by links of ``radius`` or fewer differing bits,
    the row's own included. Null and empty texts share fingerprint 0 and are linked like any
    other. Rows with a null id keep a row; they get the smallest non-null id of their group, null
    if there is none. Repeated ids keep their rows. An empty table gives an empty one.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    fps = scratch.keep(fingerprints(docs, id_col, text_col))
    reps = scratch.keep(fps.groupBy("fp").agg(F.min("id").alias("rep")))
    roots = connected_components(near_pairs(reps), "a", "b", scratch).withColumnsRenamed({"node": "fp"})
    linked = reps.join(roots, "fp", "left").select("fp", "rep", F.coalesce("root", "fp").alias("root"))
    low = linked.groupBy("root").agg(F.min("rep").alias("component_id"))
    member = scratch.keep(linked.select("fp", "root").join(low, "root").select("fp", "component_id"))
    return fps.join(member, "fp").select(F.col("id").alias(id_col), "fp", "component_id")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of its group, with all their columns.

    Of rows that repeat an id one stays. Rows with a null id can't be named by a group; all stay.
    """
    dup = near_duplicates(docs, id_col, text_col)
    kind = docs.schema[id_col].dataType
    first = dup.where(F.col(id_col) == F.col("component_id")).select(F.col(id_col).cast(kind).alias(id_col)).distinct()
    kept = docs.where(F.col(id_col).isNotNull()).join(first, id_col, "left_semi").dropDuplicates([id_col])
    return kept.unionByName(docs.where(F.col(id_col).isNull()))

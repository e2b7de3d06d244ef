"""Near-duplicate vectors by NN-descent, with exact link counts.

Equal vectors of a label are one node. A neighbour graph starts from random-hyperplane cells and
is refined by joining the neighbours of each node with each other (forward and reverse): a pair
enters a list if it beats the list's last entry. After each round a fixed sample of nodes is
compared with all vectors; rounds go on until the share of its links that the graph connects is
high enough. Nodes whose whole list lies above the threshold (saturated) may have links that no
list has room for: they are compared with all other saturated nodes of their label, block against
block, and the components that such links join are merged. If the audit is unmet after that, all
nodes of a label are compared so, and nothing is missed. The recall that the graph reached is
logged. Links at the threshold form components, and in each component every pair is compared in double precision, block against
block, so link counts inside a component are exact. Pairs are counted where they meet; no group
ever lists all its pairs.
"""

from __future__ import annotations

import logging

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, partitions
from .components import connected_components

log = logging.getLogger(__name__)

COSINE = 0.98
K = 10
#: Most entries of a saturated node's list; links that it has no room for are found block by block.
LONGEST = 40
TREES = 4
CELL = 48
CHUNK = 64
ROUNDS = 6
RECALL = 1.0
#: Nodes that a first audit asks, links that it needs to tell a recall, and nodes that it asks at most for them.
AUDIT, AUDIT_LINKS, AUDIT_MOST = 200, 100, 6_400
BLOCK = 1024
#: Most crowded cells that are broadcast (about 40 bytes each); more are joined by shuffle.
CROWDED = 100_000


def nodes(vectors: DataFrame, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    """Rows (id, label, v), one per input row: v has unit length in double precision.

    Where a row can link with nothing, v is null. Vectors link only with those of their own length:
    it is part of the label, and shorter ones are filled with zeros to the longest.
    """
    x = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), F.transform(vec_col, lambda x: x.cast("double")).alias("raw"))
    top = F.aggregate("raw", F.lit(0.0), lambda s, a: F.greatest(s, F.abs(a)))
    finite = F.forall("raw", lambda a: a.isNotNull() & ~F.isnan(a) & (F.abs(a) < float("inf")))
    usable = F.col("label").isNotNull() & F.col("id").isNotNull() & F.col("raw").isNotNull() & finite
    x = x.select("id", "label", F.when(usable, F.col("raw")).alias("raw")).withColumn("top", top)
    x = x.select("id", "label", F.when(F.col("top") > 0, F.transform("raw", lambda a: a / F.col("top"))).alias("raw"))
    x = x.withColumn("norm", F.sqrt(F.aggregate("raw", F.lit(0.0), lambda s, a: s + a * a)))
    n = F.size("raw")
    return x.select("id", F.concat_ws(":", n.cast("string"), "label").alias("label"), F.transform("raw", lambda a: a / F.col("norm")).alias("v"))


def filled(all_nodes: DataFrame, dim: int) -> DataFrame:
    return all_nodes.withColumn("v", F.concat("v", F.array_repeat(F.lit(0.0), F.lit(dim) - F.size("v"))))


def _matrix(col) -> np.ndarray:
    return np.array(col.tolist(), dtype=np.float64)


def _groups(run, keys: list[str]):
    """A mapInPandas body that hands whole groups, one at a time, of partitions sorted by ``keys``."""

    def body(batches):
        rest = None
        for b in batches:
            rest = b if rest is None or not len(rest) else pd.concat([rest, b], ignore_index=True)
            if not len(rest):
                continue
            last = np.ones(len(rest), bool)
            for k in keys:
                last &= (rest[k] == rest[k].iloc[-1]).to_numpy()
            done, rest = rest[~last], rest[last]
            if len(done):
                yield from (run(g) for _, g in done.groupby(keys, sort=False))
        if rest is not None and len(rest):
            yield run(rest)

    return body


def _dealt(df: DataFrame, *keys: str) -> DataFrame:
    return df.repartition(partitions(df.sparkSession), *keys).sortWithinPartitions(*keys)


def first_graph(reps: DataFrame, dim: int, seed: int = 5) -> DataFrame:
    """Edges (u, v, sim) of the best K per node inside its cells of TREES random partitions."""
    sizes = reps.groupBy("label").agg(F.count("*").alias("n"))
    rng = np.random.default_rng(seed)
    planes = rng.normal(size=(TREES, 48, dim))

    def cells(batches):
        for b in batches:
            if not len(b):
                continue
            x, bits = _matrix(b["v"]), np.clip(np.ceil(np.log2(np.maximum(1, b["n"].to_numpy() / CELL))), 0, 48).astype(int)
            for t in range(TREES):
                code = ((x @ planes[t].T > 0) & (np.arange(48) < bits[:, None])) @ (1 << np.arange(48))
                yield pd.DataFrame({"tree": t, "label": b["label"], "cell": code.astype(np.int64), "id": b["id"], "v": b["v"]})

    x = reps.join(sizes, "label").select("id", "label", "v", "n").mapInPandas(cells, "tree int, label string, cell long, id long, v array<double>")
    # a crowded cell is dealt to chunks: it holds near copies, whose chains the rounds join
    w = x.groupBy("tree", "label", "cell").agg(F.count("*").alias("m")).where(F.col("m") > 4 * CELL)
    w = F.broadcast(w) if w.limit(CROWDED + 1).count() <= CROWDED else w
    x = x.join(w, ["tree", "label", "cell"], "left").withColumn("m", F.coalesce("m", F.lit(1)))
    x = x.withColumn("chunk", F.pmod(F.xxhash64("id", "tree"), F.ceil(F.col("m") / (4 * CELL))).cast("int"))

    def best(g):
        ids, x = g["id"].to_numpy(), _matrix(g["v"])
        s = x @ x.T
        np.fill_diagonal(s, -2)
        k = min(K, len(ids) - 1)
        if k < 1:
            return pd.DataFrame({"u": np.zeros(0, np.int64), "v": np.zeros(0, np.int64), "sim": np.zeros(0)})
        top = np.argpartition(-s, k - 1, axis=1)[:, :k]
        return pd.DataFrame({"u": np.repeat(ids, k), "v": ids[top.ravel()], "sim": np.take_along_axis(s, top, 1).ravel()})

    keys = ["tree", "label", "cell", "chunk"]
    return _dealt(x.select(*keys, "id", "v"), *keys).mapInPandas(_groups(best, keys), "u long, v long, sim double")


def _trim(edges: DataFrame, sizes: DataFrame | None) -> DataFrame:
    """The best k distinct neighbours of each node; k is K or the node's enlarged size."""
    e = edges.groupBy("u", "v").agg(F.max("sim").alias("sim"))
    w = W.partitionBy("u").orderBy(F.desc("sim"), "v")
    e = e.withColumn("rank", F.row_number().over(w))
    if sizes is None:
        return e.where(F.col("rank") <= K).select("u", "v", "sim")
    # the fixed bound comes first, so that a hub's candidates are cut before they are shuffled
    e = e.where(F.col("rank") <= max(K, LONGEST)).join(sizes, "u", "left")
    return e.where(F.col("rank") <= F.coalesce("k", F.lit(K))).select("u", "v", "sim")


def refine(graph: DataFrame, reps: DataFrame) -> DataFrame:
    """New edges from neighbours of neighbours: those that beat the last entry of either list."""
    last = graph.groupBy("u").agg(F.min("sim").alias("floor"), F.count("*").alias("k"))
    last = last.select("u", F.when(F.col("k") >= K, F.col("floor")).otherwise(-2.0).alias("floor"))
    info = reps.select(F.col("id").alias("w"), "v").join(last.withColumnRenamed("u", "w"), "w", "left").select("w", F.col("v").alias("vec"), F.coalesce("floor", F.lit(-2.0)).alias("floor"))
    both = graph.select(F.col("u").alias("m"), F.col("v").alias("w")).unionByName(graph.select(F.col("v").alias("m"), F.col("u").alias("w"))).distinct()
    n = both.groupBy("m").agg(F.count("*").alias("n"))
    both = both.join(n, "m").select("m", "w", F.pmod(F.xxhash64("w", "m"), F.ceil(F.col("n") / CHUNK)).cast("int").alias("chunk"))
    x = both.join(info, "w")

    def join(g):
        ids, x, floor = g["w"].to_numpy(), _matrix(g["vec"]), g["floor"].to_numpy()
        s = x @ x.T
        a, b = np.nonzero(np.triu((s > floor[:, None]) | (s > floor[None, :]), 1))
        return pd.DataFrame({"u": np.r_[ids[a], ids[b]], "v": np.r_[ids[b], ids[a]], "sim": np.r_[s[a, b], s[a, b]]})

    keys = ["m", "chunk"]
    return _dealt(x, *keys).mapInPandas(_groups(join, keys), "u long, v long, sim double")


def audit(reps: DataFrame, scratch: Scratch, cosine: float) -> tuple[DataFrame, int, bool]:
    """(links, their number, whether they tell): links of sampled nodes by brute force, of twice as many nodes each time until
    there are AUDIT_LINKS of them, all nodes were asked, or AUDIT_MOST were, which then tells nothing."""
    n, most = reps.count(), AUDIT
    while True:
        truth = scratch.keep(audit_links(reps, n, most, cosine))
        found = truth.count()
        if found >= AUDIT_LINKS or most >= n:
            return truth, found, True
        if most >= AUDIT_MOST:
            return truth, found, False
        scratch.drop(truth)
        most *= 2


def audit_links(reps: DataFrame, n: int, most: int, cosine: float) -> DataFrame:
    """Links (a, b) of a fixed sample of nodes with all nodes of their label, by brute force.

    The sample is a stated query set: at most about twice ``most`` of the ``n`` vectors, broadcast in one block;
    a node's links are counted up to a thousand for the audit only.
    """
    rows = reps.where(F.pmod(F.xxhash64(F.lit("audit"), "id"), F.lit(max(1, n // most))) == 0).limit(2 * most).toPandas()
    if not len(rows):
        return reps.sparkSession.createDataFrame([], "a long, b long")
    shared = reps.sparkSession.sparkContext.broadcast((rows["id"].to_numpy(), rows["label"].to_numpy(), _matrix(rows["v"])))

    def run(batches):
        qi, ql, qv = shared.value
        for b in batches:
            if len(b):
                hit = (_matrix(b["v"]) @ qv.T >= cosine) & (b["label"].to_numpy()[:, None] == ql[None]) & (b["id"].to_numpy()[:, None] != qi[None])
                x, q = np.nonzero(hit)
                yield pd.DataFrame({"a": qi[q], "b": b["id"].to_numpy()[x]})

    pairs = reps.select("id", "label", "v").mapInPandas(run, "a long, b long")
    w = W.partitionBy("a").orderBy(F.xxhash64("b"))
    return pairs.withColumn("r", F.row_number().over(w)).where(F.col("r") <= 1000).select("a", "b")


def audited(truth: DataFrame, roots: DataFrame) -> tuple[int, int]:
    """Audited links, and those of them whose ends are in one component."""
    a, b = roots.select(F.col("node").alias("a"), F.col("root").alias("ra")), roots.select(F.col("node").alias("b"), F.col("root").alias("rb"))
    return truth.join(a, "a", "left").join(b, "b", "left").agg(F.count("*"), F.coalesce(F.sum((F.col("ra") == F.col("rb")).cast("int")), F.lit(0))).first()


def saturated(graph: DataFrame, cosine: float) -> DataFrame:
    """Nodes (id) whose whole list is links, so that there may be more."""
    full = graph.groupBy("u").agg(F.min("sim").alias("low"), F.count("*").alias("n")).where((F.col("low") >= cosine) & (F.col("n") >= K))
    return full.select(F.col("u").alias("id"))


def links_across(reps: DataFrame, roots: DataFrame, cosine: float) -> DataFrame:
    """Distinct (u, v): roots of components with a link between nodes of one label, all compared block by block.

    A node without a component is its own.
    """
    x = reps.join(roots.withColumnRenamed("node", "id"), "id", "left").select("label", "id", F.coalesce("root", "id").alias("root"), "v")
    # a label with one component has nothing to join
    m = x.groupBy("label").agg(F.count("*").alias("m"), F.min("root").alias("lo"), F.max("root").alias("hi")).where(F.col("lo") < F.col("hi"))
    blocks = F.ceil(F.col("m") / BLOCK).cast("int")
    x = x.join(m, "label").withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    x = x.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    x = x.select("label", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "root", "v")

    def join(g):
        a, b = g[g["own"] == g["i"]], g[g["own"] == g["j"]]
        if not len(a) or not len(b):
            return pd.DataFrame({"u": np.zeros(0, np.int64), "v": np.zeros(0, np.int64)})
        ra, rb = a["root"].to_numpy(), b["root"].to_numpy()
        p, q = np.nonzero((_matrix(a["v"]) @ _matrix(b["v"]).T >= cosine) & (ra[:, None] != rb[None]))
        pairs = np.unique(np.c_[ra[p], rb[q]], axis=0)
        return pd.DataFrame({"u": pairs[:, 0], "v": pairs[:, 1]})

    keys = ["label", "i", "j"]
    return _dealt(x, *keys).mapInPandas(_groups(join, keys), "u long, v long").distinct()


def count_links(reps: DataFrame, roots: DataFrame, cosine: float) -> DataFrame:
    """(id, links): copies of other nodes of the component within the threshold, block by block."""
    x = reps.join(roots.withColumnRenamed("node", "id"), "id").select("id", "root", "v", "copies")
    m = x.groupBy("root").agg(F.count("*").alias("m"))
    blocks = F.ceil(F.col("m") / BLOCK).cast("int")
    x = x.join(m, "root").withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    x = x.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    x = x.select("root", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "id", "v", "copies")

    def count(g):
        i, j = g["i"].iloc[0], g["j"].iloc[0]
        a = g[g["own"] == i]
        b = g[g["own"] == j]
        va, vb = _matrix(a["v"]), _matrix(b["v"])
        if not len(a) or not len(b):
            return pd.DataFrame({"id": np.zeros(0, np.int64), "links": np.zeros(0, np.int64)})
        hit = (va @ vb.T >= cosine) & (a["id"].to_numpy()[:, None] != b["id"].to_numpy()[None])
        ids, n = a["id"].to_numpy(), hit @ b["copies"].to_numpy()
        if i != j:
            ids, n = np.r_[ids, b["id"].to_numpy()], np.r_[n, hit.T @ a["copies"].to_numpy()]
        return pd.DataFrame({"id": ids, "links": n.astype(np.int64)})

    keys = ["root", "i", "j"]
    rows = _dealt(x, *keys).mapInPandas(_groups(count, keys), "id long, links long")
    return rows.groupBy("id").agg(F.sum("links").alias("links"))


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", cosine: float = COSINE, report: dict | None = None) -> DataFrame:
    """One row per input row: id_col, n_links, component_id, kept.

    ``report``, if given, gets the audited links, and the shares of them that the graph and the result join. An audit
    that is unmet, or has too few links to tell, is followed by exact blocks of all nodes of a label.

    Rows link when their labels are equal and not null and their cosine in double precision is at
    least ``cosine``. Null, empty, zero and non-finite vectors (and rows without an id) link with
    nothing and are their own component. ``kept`` marks the smallest id of a component. Vectors of
    different lengths don't link. Repeated ids count as one row each in links, and a repeated id
    keeps all its rows. An empty table gives an empty one.
    """
    spark = vectors.sparkSession
    s = Scratch(spark, "vectors")
    all_nodes = nodes(vectors, id_col, vec_col, label_col)
    one = all_nodes.agg(F.max(F.size("v")).alias("d")).first()
    if (one.d or 0) < 1:
        return all_nodes.select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    all_nodes = s.keep(filled(all_nodes, one.d))
    reps = s.keep(all_nodes.where(F.col("v").isNotNull()).groupBy("label", "v").agg(F.min("id").alias("id"), F.count("*").alias("copies")))
    graph = s.keep(_trim(first_graph(reps, one.d), None))
    truth, _, tells = audit(reps, s, cosine)
    roots = None
    for _ in range(ROUNDS):
        edges = graph.where(F.col("sim") >= cosine)
        # saturated lists grow; no list gets shorter
        sizes = graph.groupBy("u").agg(F.min("sim").alias("low"), F.count("*").alias("n"))
        longer = F.when(F.col("low") >= cosine, F.least(F.lit(LONGEST), 2 * F.col("n"))).otherwise(F.col("n"))
        sizes = sizes.where(F.col("n") >= K).select("u", longer.alias("k"))
        nxt = s.keep(_trim(graph.unionByName(refine(graph, reps)), sizes))
        s.drop(graph)
        graph = nxt
        edges = graph.where(F.col("sim") >= cosine)
        if roots is not None:
            s.drop(roots)
        roots = s.keep(connected_components(edges, "u", "v", s))
        n, got = audited(truth, roots)
        if got >= RECALL * n:
            break
    log.info("near_duplicates: %d of %d audited links are joined by the graph", got, n)
    report = {} if report is None else report
    report |= {"audited": n, "graph": got / n if n else None}
    # saturated nodes first; if the audit is still unmet, all of a label
    for some in (reps.join(saturated(graph, cosine), "id"), reps):
        across = s.keep(links_across(some, roots, cosine))
        if across.limit(1).count():
            edges = edges.select("u", "v").unionByName(across)
            roots = s.keep(connected_components(edges, "u", "v", s))
            n, got = audited(truth, roots)
        if got >= RECALL * n and tells:
            break
    log.info("near_duplicates: %d of %d audited links are joined", got, n)
    report |= {"joined": got / n if n else None, "exact": not tells}
    if got < 0.9 * n:
        raise RuntimeError(f"only {got} of {n} audited links are joined")
    counts = s.keep(count_links(reps, roots, cosine))
    low = roots.groupBy("root").agg(F.min("node").alias("component_id"))
    member = reps.join(roots.withColumnRenamed("node", "id"), "id", "left").join(low, "root", "left").join(counts, "id", "left")
    member = member.select("label", "v", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
    x = all_nodes.join(s.keep(member), ["label", "v"], "left")
    comp = F.coalesce("component_id", "id")
    kept = F.coalesce(F.col("id") == comp, F.lit(True))
    return x.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), comp.alias("component_id"), kept.alias("kept"))


ORACLE_SQL = """
WITH RECURSIVE x AS (
  SELECT vec_id, label, list_transform(embedding, lambda e: e::DOUBLE) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND label IS NOT NULL),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM x a JOIN x b ON a.label = b.label AND a.vec_id <> b.vec_id
      WHERE list_cosine_similarity(a.v, b.v) >= 0.98),
r(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY a),
n AS (SELECT a AS vec_id, count(*) AS n_links FROM l GROUP BY a)
SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM c LEFT JOIN n USING (vec_id)
"""

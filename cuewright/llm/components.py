"""Connected components of an undirected edge list by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def _stars(pairs: DataFrame, larger_only: bool) -> DataFrame:
    """Hang neighbours of each node ``u`` on the smallest node known around it.

    ``pairs`` has directed rows (u, v). With ``larger_only`` only neighbours above ``u`` move.
    Minima are combined before the shuffle; the join back can be split where a hub is hot.
    """
    low = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    moved = pairs.join(low, "u")
    if larger_only:
        moved = moved.where(F.col("v") > F.col("u"))
    return moved.where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))


def connected_components(edges: DataFrame, a: str, b: str, scratch: Scratch, max_rounds: int = 60) -> DataFrame:
    """Rows (node, root): for every node with a link to another, the smallest node reachable.

    Nodes are longs; null ends and loops are ignored; repeated and reversed edges are fine. An
    empty list gives an empty table. Large-star and small-star steps alternate until nothing
    moves, in about log2 of the longest chain rounds; each round is written to the shared folder.
    Only two numbers a round reach the driver. Nodes without links get no row.
    """
    e = (
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
        .distinct()
    )
    e = scratch.keep(e)
    seen = None
    for _ in range(max_rounds):
        n, digest = e.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 31)))).first()
        if n == 0 or (n, digest) == seen:
            break
        seen = (n, digest)
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _stars(both, True).distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        kept = low.select("u", F.col("m").alias("v"))
        moved = down.join(low, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        nxt = scratch.keep(kept.unionByName(moved).distinct())
        scratch.drop(e)
        e = nxt
    else:
        raise RuntimeError("components did not settle")
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)

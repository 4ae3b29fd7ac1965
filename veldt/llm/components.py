"""Connected components of an edge table by alternating large-star and small-star steps.

Edges stay a distributed table; each round is written to the shared folder, so lineage
stays short and a lost executor costs one round at most. A star's centre is a hot key:
minima are pre-aggregated before the shuffle, and in the join back nodes with over one in
SHARE of the ends of edges are looked up by broadcast, so their rows stay where they lie. There
are fewer than SHARE such nodes, whatever the input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veldt.llm.common import written

SHARE = 1000


def _with_least(rows: DataFrame, least: DataFrame, ends: int) -> DataFrame:
    """rows(a, b) with m of least(u, m, n) where u = a; n is the number of ends at u, ``ends`` that of all."""
    hot = F.col("n") * SHARE > ends
    heavy, light = F.broadcast(least.where(hot).drop("n")), least.where(~hot).drop("n")
    calm = rows.join(heavy, F.col("a") == F.col("u"), "left_anti")
    return rows.join(heavy, F.col("a") == F.col("u")).union(calm.join(light, F.col("a") == F.col("u")))


def _large_star(edges: DataFrame, size: int) -> DataFrame:
    """Every neighbour above u is tied to the least of u and its neighbours."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
    low = low.select(F.col("a").alias("u"), F.least("a", "m").alias("m"), "n")
    return _with_least(both.where("b > a"), low, 2 * size).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame, size: int) -> DataFrame:
    """u and its neighbours below are tied to the least of those; edges come as a > b."""
    low = edges.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).select(F.col("a").alias("u"), "m", "n")
    down = _with_least(edges, low, size).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return down.union(low.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """edges(a, b) of one comparable type -> (node, root): the least node reachable; roots themselves have no row.

    Self loops and repeated edges are ignored; an empty table gives an empty result.
    """
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = _state(now)
    while True:  # every round that changes anything brings some node nearer to its least one
        large = written(_large_star(now, before[0]), "edges")
        now = written(_small_star(large, large.count()), "edges")
        after = _state(now)
        if after == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = after

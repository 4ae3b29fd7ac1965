"""Registered queries of what has no SQL form of its own, held against a partition planted in the tables.

The points are the nations: a corner for each region, moved by the shares of the segments
among the nation's customers. Every method must return the regions; a cluster is named by
its least nation, as labels are defined up to names. Importing this module registers them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veldt.operators import cluster, graphs
from veldt.operators.pairs import scalar_product, top_k
from veldt.plans.queries import ORACLE, QUERIES, _job, query, shared
from veldt.sources import panel as source

REGIONS, SEGMENTS = 5, ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")


@shared
def planted(spark: SparkSession, d: str) -> DataFrame:
    """(id, x) of all nations, from all customers."""
    c = source.scan(spark, d, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(*[F.avg((F.col("c_mktsegment") == s).cast("double")).alias(s) for s in SEGMENTS])
    n = source.scan(spark, d, "nation").join(c, "n_nationkey", "left")
    corner = [F.when(F.col("n_regionkey") == r, 3.0).otherwise(0.0) for r in range(REGIONS)]
    return n.select(F.col("n_nationkey").cast("long").alias("id"), F.array(*corner, *[F.coalesce(s, F.lit(0.0)) for s in SEGMENTS]).alias("x"))


def planted_graph(spark, d) -> DataFrame:
    """Six neighbours each: all four of the region and two of others, whose ties are weak."""
    return graphs.cosine_graph(planted(spark, d), 6)


def by_least(labels: DataFrame) -> DataFrame:
    return labels.select("id", F.min("id").over(Window.partitionBy("label")).alias("least"))


def _recovered(method: str, rule: str):
    def f(spark: SparkSession, d: str) -> DataFrame:
        g = {} if rule == "-" else {rule: planted_graph(spark, d)}
        return by_least(cluster.run(_job(spark, method, rule, REGIONS), planted(spark, d), g))

    return f


_LEAST = "SELECT n_nationkey::BIGINT AS id, min(n_nationkey) OVER (PARTITION BY n_regionkey)::BIGINT AS least FROM nation"
for _m in cluster.METHODS:
    QUERIES[f"regions_by_{_m}"] = _recovered(_m, "-" if _m in ("kmeans", "gmm", "ward") else "cosine")
    ORACLE[f"regions_by_{_m}"] = _LEAST


@query(_LEAST)
def regions_by_distributed_kmeans(spark, d):
    return by_least(cluster.distributed_kmeans(planted(spark, d), REGIONS, 20))


@query("SELECT n_nationkey::BIGINT AS id, true AS within, true AS same_region FROM nation")
def plane(spark, d):
    """The t-SNE plane of the nations: inside the unit square, and everyone's nearest point is of the own region."""
    at = cluster.plane_of(planted(spark, d))
    near = top_k(at.select("id", F.array("px", "py").alias("x")), 1, _closeness).select(F.col("src").alias("id"), "dst")
    region = source.scan(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_regionkey").alias("r"))
    both = at.join(near, "id").join(region, "id").join(region.select(F.col("id").alias("dst"), F.col("r").alias("s")), "dst")
    return both.select("id", ((F.least("px", "py") >= 0) & (F.greatest("px", "py") <= 1)).alias("within"), (F.col("r") == F.col("s")).alias("same_region"))


def _closeness(a, b):
    return 2 * scalar_product(a, b) - (a**2).sum(1)[:, None] - (b**2).sum(1)[None, :]

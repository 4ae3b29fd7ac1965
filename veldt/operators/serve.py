"""Read-side queries over the exported records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def search(records: DataFrame, name: Column, query: str, limit: int = 12, least: int = 2, tie: str | None = None) -> DataFrame:
    """Records whose name holds the query, by place of the match, then length, then name (then ``tie``)."""
    q = query.lower().strip()
    if len(q) < least:
        return records.limit(0)
    found = records.withColumn("at", F.instr(F.lower(name), q).cast("long")).where("at > 0")
    return found.orderBy("at", F.length(name), name, *[tie] * bool(tie)).limit(limit)


def movers(changes: DataFrame, from_: int | None = None, to: int | None = None) -> DataFrame:
    out = changes
    if from_ is not None:
        out = out.where(F.col("from") == from_)
    if to is not None:
        out = out.where(F.col("to") == to)
    return out


def mover_pairs(changes: DataFrame) -> DataFrame:
    return changes.groupBy("from", "to").agg(F.count(F.lit(1)).alias("n"))


def typical_members(shares: DataFrame, columns: list[str], n: int = 3) -> DataFrame:
    """shares(id, label, ...) -> the n members of each type nearest (L1) to its median shares."""
    med = shares.groupBy("label").agg(*[F.median(c).alias(f"_m_{c}") for c in columns])
    dist = F.lit(0.0)
    for c in columns:
        dist = dist + F.abs(F.col(c) - F.col(f"_m_{c}"))
    w = Window.partitionBy("label").orderBy("distance", "id")
    return shares.join(med, "label").select("label", "id", F.round(dist, 9).alias("distance")).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def portrait(wide: DataFrame, value: str, months: int = 12) -> DataFrame:
    """(entity, mean, ratio): mean of the last months, over the mean of all entities."""
    w = Window.partitionBy("entity").orderBy(F.desc("period"))
    last = wide.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= months).groupBy("entity").agg(F.avg(value).alias("mean"))
    return last.crossJoin(F.broadcast(last.agg(F.avg("mean").alias("_all")))).select("entity", "mean", (F.col("mean") / F.col("_all")).alias("ratio"))


def top_deviations(shares: DataFrame, columns: list[str], n: int = 2) -> DataFrame:
    """(id, category, deviation): strongest relative deviations from the mean shares."""
    mean = shares.agg(*[F.avg(c).alias(f"_m_{c}") for c in columns])
    rows = shares.crossJoin(F.broadcast(mean)).select("id", F.explode(F.array(*[F.struct(F.lit(c).alias("category"), (F.col(c) / F.col(f"_m_{c}") - 1).alias("deviation")) for c in columns])).alias("d")).select("id", "d.*")
    w = Window.partitionBy("id").orderBy(F.abs("deviation").desc(), "category")
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def stay_share(path: DataFrame, labels: DataFrame) -> DataFrame:
    return path.join(labels.select(F.col("id").alias("entity"), "label"), "entity").groupBy("entity").agg(F.avg((F.col("type") == F.col("label")).cast("double")).alias("stay"))


def compare(long: DataFrame, a: int, b: int) -> DataFrame:
    """long(entity, category, value) -> category, both values and their ratio."""
    x = long.where(F.col("entity") == a).select("category", F.col("value").alias("va"))
    y = long.where(F.col("entity") == b).select("category", F.col("value").alias("vb"))
    return x.join(y, "category", "full").select("category", "va", "vb", F.try_divide("va", "vb").alias("ratio"))


def box(points: DataFrame, x: tuple[float, float], y: tuple[float, float]) -> DataFrame:
    return points.where(F.col("x").between(*x) & F.col("y").between(*y))


def month_changes(path: DataFrame, period: str, before: str) -> DataFrame:
    a = path.where(F.col("period") == before).select("entity", F.col("type").alias("from"))
    return path.where(F.col("period") == period).join(a, "entity").where("type <> from").select("entity", "from", F.col("type").alias("to"))


def nearest_point(points: DataFrame, x: float, y: float) -> DataFrame:
    d = F.sqrt(F.pow(F.col("x") - x, F.lit(2)) + F.pow(F.col("y") - y, F.lit(2)))
    return points.select("id", d.alias("distance")).orderBy("distance", "id").limit(1)


def cross_degree(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """(id, degree, cross): neighbours, and those of another type."""
    a, b = labels.select(F.col("id").alias("src"), F.col("label").alias("la")), labels.select(F.col("id").alias("dst"), F.col("label").alias("lb"))
    return edges.join(a, "src").join(b, "dst").groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("degree"), F.sum((F.col("la") != F.col("lb")).cast("long")).alias("cross"))


def best_run(runs: DataFrame, rank: str) -> DataFrame:
    """Best run of each (method, k) by a rank column; nulls last, then key."""
    w = Window.partitionBy("method", "k").orderBy(F.col(rank).asc_nulls_last(), "key")
    return runs.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def index_extent(runs: DataFrame, index: str) -> DataFrame:
    """Each run with the least and largest value of an index among its k."""
    w = Window.partitionBy("k")
    return runs.select("key", "k", index, F.min(index).over(w).alias("lo"), F.max(index).over(w).alias("hi"))


def wins(ranks: DataFrame, item: str, rank: str = "kemeny_rank") -> DataFrame:
    return ranks.where((F.col("item") == item) & (F.col(rank) == 1)).agg(F.countDistinct("k").alias("wins"))


def histogram(df: DataFrame, value: str, bins: int = 12) -> DataFrame:
    """(bin, lo, hi, n) over the value's range; the last bin holds its upper end; empty bins too."""
    ends = df.agg(F.min(value).cast("double").alias("a"), F.max(value).cast("double").alias("b"))
    width = (F.col("b") - F.col("a")) / bins
    at = F.when(F.col("b") == F.col("a"), 0).otherwise(F.least(F.lit(bins - 1), F.floor((F.col(value) - F.col("a")) / width))).cast("int")
    counts = df.crossJoin(F.broadcast(ends)).groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    grid = ends.select("a", "b", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return grid.join(counts, "bin", "left").select("bin", (F.col("a") + F.col("bin") * width).alias("lo"), (F.col("a") + (F.col("bin") + 1) * width).alias("hi"), F.coalesce("n", F.lit(0)).alias("n"))


def label_places(points: DataFrame) -> DataFrame:
    """(label, n, x, y): members and the median of their coordinates."""
    return points.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.median("x").alias("x"), F.median("y").alias("y"))


def radial(shares: DataFrame, reference: DataFrame, low: float = 0.2) -> DataFrame:
    """(id, category, r): share over reference share, not below ``low``."""
    return shares.join(F.broadcast(reference.select("category", F.col("share").alias("_r"))), "category").select("id", "category", F.greatest(F.lit(low), F.try_divide("share", "_r")).alias("r"))


def rank_matrix(runs: DataFrame, ks: list[int]) -> DataFrame:
    """method x k: least rank."""
    return runs.groupBy("method").agg(*[F.min(F.when(F.col("k") == k, F.col("rank"))).alias(f"k{k}") for k in ks])


def key_parts(runs: DataFrame) -> DataFrame:
    """``method|rule|k`` taken apart."""
    p = F.split("key", r"\|")
    return runs.select("*", p[0].alias("method"), p[1].alias("rule"), p[2].cast("int").alias("k"))


def type_profile(shares: DataFrame, columns: list[str], level: str) -> DataFrame:
    """(label, ...): median share over the mean share, less one; level as exp(mean) - 1."""
    nat = shares.agg(*[F.avg(c).alias(f"_n_{c}") for c in columns])
    med = shares.groupBy("label").agg(*[F.median(c).alias(c) for c in columns], F.avg(level).alias("_l"))
    return med.crossJoin(F.broadcast(nat)).select("label", *[(F.col(c) / F.col(f"_n_{c}") - 1).alias(c) for c in columns], (F.exp("_l") - 1).alias(level))


def summary(panel: DataFrame, labels: DataFrame, edges: DataFrame, window: int = 3) -> DataFrame:
    """One row of header counts: entities, first and last period, smoothed slices, categories, types, edges. panel(entity, period, category)."""
    head = panel.agg(F.countDistinct("entity").alias("entities"), F.min("period").alias("first"), F.max("period").alias("last"), (F.countDistinct("period") - window + 1).alias("slices"), F.countDistinct("category").alias("categories"))
    return head.crossJoin(labels.agg(F.countDistinct("label").alias("types"))).crossJoin(edges.where("src < dst").agg(F.count(F.lit(1)).alias("edges")))


def cross_index(values: DataFrame, ranks: DataFrame, k: int) -> DataFrame:
    """(method, key, graph, value): of each method's best run at k, its index on every graph.

    values(key, method, k, graph, value); ranks(key, rank): runs without a rank come last, then by key.
    """
    runs = values.where(F.col("k") == k)
    best = best_run(runs.select("method", "k", "key").distinct().join(ranks, "key", "left"), "rank").select("key")
    return runs.join(best, "key", "left_semi").select("method", "key", "graph", "value")


def stability_curve(stability: DataFrame, method: str, rule: str) -> DataFrame:
    """(k, mean, q10) of one method and rule, from rows with a ``method|rule|k`` key."""
    return key_parts(stability).where((F.col("method") == method) & (F.col("rule") == rule)).select("k", "mean", "q10")


def sensitivity_series(rows: DataFrame) -> DataFrame:
    """(rule, knn, MQ, same_group, place): the points of each rule's line, in order."""
    return rows.select("rule", "knn", "MQ", "same_group", F.row_number().over(Window.partitionBy("rule").orderBy("knn")).alias("place"))

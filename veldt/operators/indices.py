"""Quality of a partition: by features, by graph, and against another partition.

vectors(id, x), labels(id, label), edges(src, dst, w) in both directions. With fewer than
two clusters every index is null.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veldt.operators.pairs import distances_to_labels


def _guard(labels: DataFrame) -> DataFrame:
    return labels.agg(F.countDistinct("label").alias("_k"))


def silhouette_rows(vectors: DataFrame, labels: DataFrame) -> DataFrame:
    """(id, label, s): (b - a) / max(a, b), Euclidean; 0 alone in a cluster."""
    d = distances_to_labels(vectors.join(labels, "id"))
    own = labels.select("id", F.col("label").cast("long").alias("own"))
    d = d.join(own, "id").withColumn("mean", F.col("dist") / F.col("n"))
    ab = d.groupBy("id", "own").agg(F.max(F.when(F.col("label") == F.col("own"), F.col("mean"))).alias("a"), F.min(F.when(F.col("label") != F.col("own"), F.col("mean"))).alias("b"))
    s = F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0))
    return ab.select("id", F.col("own").alias("label"), F.when(F.col("a").isNull(), 0.0).otherwise(s).alias("s"))


def silhouette(vectors: DataFrame, labels: DataFrame) -> DataFrame:
    return silhouette_rows(vectors, labels).agg(F.avg("s").alias("v")).crossJoin(_guard(labels)).select(F.when(F.col("_k") >= 2, F.col("v")).alias("SW"))


def _tidy(vectors: DataFrame, labels: DataFrame) -> DataFrame:
    return vectors.join(labels, "id").select("id", "label", F.posexplode("x").alias("f", "v")).withColumn("v", F.col("v").cast("double"))


def centroids(vectors: DataFrame, labels: DataFrame) -> DataFrame:
    """(label, x): mean vector."""
    means = _tidy(vectors, labels).groupBy("label", "f").agg(F.avg("v").alias("m"))
    return means.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("f", "m"))), lambda r: r["m"]).alias("x"))


def calinski_harabasz(vectors: DataFrame, labels: DataFrame) -> DataFrame:
    """(between / (k - 1)) / (within / (n - k))."""
    t = _tidy(vectors, labels)
    by = t.groupBy("label", "f").agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("m"), F.var_pop("v").alias("s"))
    over = t.groupBy("f").agg(F.avg("v").alias("g"))
    sums = by.join(over, "f").agg(F.sum(F.col("n") * F.pow(F.col("m") - F.col("g"), 2)).alias("b"), F.sum(F.col("n") * F.col("s")).alias("w"))
    k = labels.agg(F.countDistinct("label").alias("k"), F.count(F.lit(1)).alias("n"))
    return sums.crossJoin(k).select(F.when(F.col("k") >= 2, F.try_divide(F.col("b") / (F.col("k") - 1), F.col("w") / (F.col("n") - F.col("k")))).alias("CH"))


def s_dbw(vectors: DataFrame, labels: DataFrame) -> DataFrame:
    """Scatter plus density between clusters (Halkidi, Vazirgiannis 2001)."""
    from veldt.functions.scalars import squared_distance

    t = _tidy(vectors, labels)
    spread = t.groupBy("label", "f").agg(F.var_pop("v").alias("s")).groupBy("label").agg(F.sqrt(F.sum(F.col("s") * F.col("s"))).alias("norm"))
    whole = t.groupBy("f").agg(F.var_pop("v").alias("s")).agg(F.sqrt(F.sum(F.col("s") * F.col("s"))).alias("all"))
    one = spread.agg(F.avg("norm").alias("mean"), (F.sqrt(F.sum("norm")) / F.count(F.lit(1))).alias("dev"), F.count(F.lit(1)).alias("k")).crossJoin(whole)
    c = centroids(vectors, labels)
    a, b = c.select(F.col("label").alias("li"), F.col("x").alias("xi")), c.select(F.col("label").alias("lj"), F.col("x").alias("xj"))
    pair = a.crossJoin(F.broadcast(b)).where("li < lj")  # clusters, not points: k (k - 1) / 2 rows
    mid = pair.select("li", "lj", F.zip_with("xi", "xj", lambda p, q: (p + q) / 2).alias("u"))
    spots = mid.select("li", "lj", F.explode(F.array(F.struct(F.col("li").alias("of"), F.col("u").alias("at")), F.struct(F.col("lj").alias("of"), F.col("u").alias("at")))).alias("s"), F.lit("mid").alias("what")).select("li", "lj", "s.of", "s.at", "what")
    own = c.select(F.col("label").alias("li"), F.col("label").alias("lj"), F.col("label").alias("of"), F.col("x").alias("at"), F.lit("own").alias("what"))
    points = vectors.join(labels, "id").select(F.col("label").alias("of"), "x")
    hit = points.join(F.broadcast(spots.union(own)), "of").crossJoin(F.broadcast(one.select("dev")))
    near = hit.groupBy("what", "li", "lj").agg(F.sum((F.sqrt(squared_distance(F.col("x"), F.col("at"))) <= F.col("dev")).cast("long")).alias("n"))
    centre = near.where("what = 'own'").select(F.col("li").alias("c"), F.col("n").alias("dens"))
    d1, d2 = centre.select(F.col("c").alias("li"), F.col("dens").alias("di")), centre.select(F.col("c").alias("lj"), F.col("dens").alias("dj"))
    ratio = near.where("what = 'mid'").join(d1, "li").join(d2, "lj").select(F.coalesce(F.try_divide(F.col("n").cast("double"), F.greatest("di", "dj")), F.lit(0.0)).alias("r"))
    dens = ratio.agg(F.sum("r").alias("sum"))
    return one.crossJoin(dens).select(F.when(F.col("k") >= 2, F.col("mean") / F.col("all") + 2 * F.col("sum") / (F.col("k") * (F.col("k") - 1))).alias("S_Dbw"))


def block_weights(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """(ci, cj, w) over the full grid of clusters; the diagonal counts every inner edge twice."""
    a, b = labels.select(F.col("id").alias("src"), F.col("label").alias("ci")), labels.select(F.col("id").alias("dst"), F.col("label").alias("cj"))
    sums = edges.join(a, "src").join(b, "dst").groupBy("ci", "cj").agg(F.sum("w").alias("w"))
    names = labels.select("label").distinct()
    grid = names.select(F.col("label").alias("ci")).crossJoin(F.broadcast(names.select(F.col("label").alias("cj"))))  # clusters
    return grid.join(sums, ["ci", "cj"], "left").select("ci", "cj", F.coalesce("w", F.lit(0.0)).alias("w"))


def graph_indices(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """One row: AVI (isolability), AVU (unifiability), MQ (modularity)."""
    b = block_weights(edges, labels)
    per = b.groupBy("ci").agg((F.sum(F.when(F.col("ci") == F.col("cj"), F.col("w"))) / 2).alias("inner"), F.sum(F.when(F.col("ci") != F.col("cj"), F.col("w")).otherwise(0.0)).alias("cut"), F.sum("w").alias("vol"))
    avi = per.agg(F.avg(F.col("inner") / F.greatest(F.col("inner") + F.col("cut"), F.lit(1e-12))).alias("AVI"), F.sum(2 * F.col("inner")).alias("trace"), F.sum("vol").alias("m2"), F.sum(F.col("vol") * F.col("vol")).alias("sq"), F.count(F.lit(1)).alias("k"))
    i, j = per.select(F.col("ci"), F.col("inner").alias("ii")), per.select(F.col("ci").alias("cj"), F.col("inner").alias("ij"))
    pair = b.where("ci < cj").join(i, "ci").join(j, "cj")
    avu = pair.agg(F.avg(F.col("w") / F.greatest(F.col("ii") + F.col("ij") + F.col("w"), F.lit(1e-12))).alias("u"))
    mq = F.col("trace") / F.greatest("m2", F.lit(1e-12)) - F.col("sq") / F.greatest(F.col("m2") * F.col("m2"), F.lit(1e-12))
    two = F.col("k") >= 2
    return avi.crossJoin(avu).select(F.when(two, F.col("AVI")).alias("AVI"), F.when(two, F.coalesce("u", F.lit(0.0))).alias("AVU"), F.when(two, mq).alias("MQ"))


def modularity(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Share of weight inside clusters less its expectation; 0 for one cluster."""
    b = block_weights(edges, labels)
    per = b.groupBy("ci").agg(F.sum(F.when(F.col("ci") == F.col("cj"), F.col("w"))).alias("inner"), F.sum("w").alias("vol"))
    s = per.agg(F.sum("inner").alias("t"), F.sum("vol").alias("m"), F.sum(F.col("vol") * F.col("vol")).alias("q"))
    return s.select((F.col("t") / F.col("m") - F.col("q") / (F.col("m") * F.col("m"))).alias("MQ"))


def _table(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("id", F.col("label").alias("la")).join(b.select("id", F.col("label").alias("lb")), "id").groupBy("la", "lb").agg(F.count(F.lit(1)).cast("double").alias("n"))


def adjusted_rand(a: DataFrame, b: DataFrame) -> DataFrame:
    """From the contingency table alone."""
    t = _table(a, b)
    two = lambda c: F.sum(F.col(c) * (F.col(c) - 1) / 2)
    cells = t.agg(two("n").alias("x"), F.sum("n").alias("n"))
    rows = t.groupBy("la").agg(F.sum("n").alias("n")).agg(two("n").alias("r"))
    cols = t.groupBy("lb").agg(F.sum("n").alias("n")).agg(two("n").alias("c"))
    all_ = F.col("n") * (F.col("n") - 1) / 2
    expected = F.col("r") * F.col("c") / all_
    top = (F.col("r") + F.col("c")) / 2
    return cells.crossJoin(rows).crossJoin(cols).select(F.when(top == expected, 1.0).otherwise((F.col("x") - expected) / (top - expected)).alias("ARI"))


def mutual_information(a: DataFrame, b: DataFrame) -> DataFrame:
    """Normalised by the mean of both entropies."""
    t = _table(a, b)
    total = t.agg(F.sum("n").alias("all"))
    ra, rb = t.groupBy("la").agg(F.sum("n").alias("na")), t.groupBy("lb").agg(F.sum("n").alias("nb"))
    p = t.join(ra, "la").join(rb, "lb").crossJoin(total)
    mi = p.agg(F.sum(F.col("n") / F.col("all") * F.ln(F.col("n") * F.col("all") / (F.col("na") * F.col("nb")))).alias("mi"))
    ha = ra.crossJoin(total).agg((-F.sum(F.col("na") / F.col("all") * F.ln(F.col("na") / F.col("all")))).alias("ha"))
    hb = rb.crossJoin(total).agg((-F.sum(F.col("nb") / F.col("all") * F.ln(F.col("nb") / F.col("all")))).alias("hb"))
    mean = (F.col("ha") + F.col("hb")) / 2
    return mi.crossJoin(ha).crossJoin(hb).select(F.when(mean == 0, 1.0).otherwise(F.greatest(F.col("mi"), F.lit(0.0)) / mean).alias("NMI"))


def mutual_information_by(pairs: DataFrame, by: str) -> DataFrame:
    """pairs(by, la, lb) -> (by, NMI): as ``mutual_information``, for each value of ``by``."""
    t = pairs.groupBy(by, "la", "lb").agg(F.count(F.lit(1)).alias("n"))
    total = t.groupBy(by).agg(F.sum("n").alias("all"))
    ra, rb = (t.groupBy(by, k).agg(F.sum("n").alias(n)) for k, n in (("la", "na"), ("lb", "nb")))
    mi = t.join(ra, [by, "la"]).join(rb, [by, "lb"]).join(total, by).groupBy(by).agg(F.sum(F.col("n") / F.col("all") * F.ln(F.col("n") * F.col("all") / (F.col("na") * F.col("nb")))).alias("mi"))
    entropy = lambda r, n, h: r.join(total, by).groupBy(by).agg((-F.sum(F.col(n) / F.col("all") * F.ln(F.col(n) / F.col("all")))).alias(h))
    mean = (F.col("ha") + F.col("hb")) / 2
    joined = mi.join(entropy(ra, "na", "ha"), by).join(entropy(rb, "nb", "hb"), by)
    return joined.select(by, F.when(mean == 0, 1.0).otherwise(F.greatest(F.col("mi"), F.lit(0.0)) / mean).alias("NMI"))


def sizes(labels: DataFrame) -> DataFrame:
    """One row: clusters, min_share."""
    n = labels.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    return n.agg(F.count(F.lit(1)).alias("clusters"), (F.min("n") / F.sum("n")).alias("min_share"))

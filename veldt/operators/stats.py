"""Association of types with outside attributes."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upper_gamma(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function Q(a, x): series below a + 1, continued fraction above."""
    if x <= 0:
        return 1.0
    scale = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1.0 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return max(0.0, 1.0 - total * scale)
    b = x + 1 - a
    c, d = 1e300, 1.0 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = an * d + b
        d = 1.0 / (d if abs(d) > 1e-300 else 1e-300)
        c = b + an / c
        c = c if abs(c) > 1e-300 else 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return min(1.0, scale * h)


def chi2_p(statistic: Column, dof: Column) -> Column:
    """Upper tail of the chi-squared distribution."""

    @F.pandas_udf("double")
    def p(s: pd.Series, d: pd.Series) -> pd.Series:
        return pd.Series([None if x != x or n != n or n <= 0 else upper_gamma(n / 2, x / 2) for x, n in zip(s, d, strict=True)], dtype="float64")

    return p(statistic.cast("double"), dof.cast("double"))


def cramers_v(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: chi2 (continuity-corrected for 2 x 2), dof, V."""
    t = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    ra, rb = t.groupBy("a").agg(F.sum("n").alias("na")), t.groupBy("b").agg(F.sum("n").alias("nb"))
    one = ra.agg(F.sum("na").alias("all"), F.count(F.lit(1)).alias("r")).crossJoin(rb.agg(F.count(F.lit(1)).alias("c")))
    cells = ra.crossJoin(F.broadcast(rb)).join(t, ["a", "b"], "left").crossJoin(F.broadcast(one))  # categories, not rows
    e = F.col("na") * F.col("nb") / F.col("all")
    gap = F.abs(F.coalesce("n", F.lit(0.0)) - e)
    gap = F.when((F.col("r") == 2) & (F.col("c") == 2), gap - F.least(F.lit(0.5), gap)).otherwise(gap)
    out = cells.groupBy("all", "r", "c").agg(F.sum(gap * gap / e).alias("chi2"))
    return out.select("chi2", ((F.col("r") - 1) * (F.col("c") - 1)).alias("dof"), F.sqrt(F.try_divide(F.col("chi2"), F.col("all") * (F.least("r", "c") - 1))).alias("V"))


def eta_squared(df: DataFrame, value: str, label: str) -> DataFrame:
    """One row: between over total sum of squares, nulls dropped."""
    rows = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")) & F.col(label).isNotNull())
    by = rows.groupBy(label).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("m"))
    all_ = rows.agg(F.avg(value).alias("g"), (F.var_pop(value) * F.count(F.lit(1))).alias("ss"))
    return by.crossJoin(F.broadcast(all_)).groupBy("ss").agg(F.sum(F.col("n") * (F.col("m") - F.col("g")) * (F.col("m") - F.col("g"))).alias("b")).select(F.try_divide("b", "ss").alias("eta2"))


def kruskal_wallis(df: DataFrame, value: str, label: str) -> DataFrame:
    """One row: H with tie correction, dof. Ranks come from counts per value, not from one sort of all rows."""
    rows = df.where(F.col(value).isNotNull() & F.col(label).isNotNull())
    ties = rows.groupBy(F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("t"))
    order = Window.orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    ranked = ties.withColumn("rank", F.coalesce(F.sum("t").over(order), F.lit(0)) + (F.col("t") + 1) / 2)
    by = rows.join(ranked, F.col(value) == F.col("v")).groupBy(label).agg(F.sum("rank").alias("r"), F.count(F.lit(1)).alias("n"))
    h = by.agg(F.sum(F.col("r") * F.col("r") / F.col("n")).alias("s"), F.sum("n").alias("all"), (F.count(F.lit(1)) - 1).alias("dof"))
    c = ranked.agg(F.sum(F.pow(F.col("t").cast("double"), F.lit(3)) - F.col("t")).alias("tie"))
    n = F.col("all").cast("double")
    raw = 12 / (n * (n + 1)) * F.col("s") - 3 * (n + 1)
    return h.crossJoin(c).select((raw / (1 - F.col("tie") / (n * n * n - n))).alias("H"), "dof")


def with_p(row: DataFrame, statistic: str) -> DataFrame:
    return row.withColumn("p", chi2_p(F.col(statistic), F.col("dof")))


def validation_table(df: DataFrame, label: str, numeric: list[str], categorical: list[str]) -> DataFrame:
    """(attribute, measure, value, p): eta squared and Kruskal-Wallis for numbers, Cramér's V for categories."""
    parts = []
    for c in numeric:
        parts.append(eta_squared(df, c, label).select(F.lit(c).alias("attribute"), F.lit("eta2").alias("measure"), F.col("eta2").alias("value"), F.lit(None).cast("double").alias("p")))
        parts.append(with_p(kruskal_wallis(df, c, label), "H").select(F.lit(c), F.lit("H"), "H", "p"))
    for c in categorical:
        parts.append(with_p(cramers_v(df, label, c), "chi2").select(F.lit(c), F.lit("V"), "V", "p"))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def same_label_share(edges: DataFrame, labels: DataFrame) -> DataFrame:
    a, b = labels.select(F.col("id").alias("src"), F.col("label").alias("la")), labels.select(F.col("id").alias("dst"), F.col("label").alias("lb"))
    return edges.where("src < dst").join(a, "src").join(b, "dst").agg(F.avg((F.col("la") == F.col("lb")).cast("double")).alias("observed"))


def join_count(edges: DataFrame, labels: DataFrame, samples: int = 200, seed: int = 0) -> DataFrame:
    """One row: observed share of edges within a type, its mean and z under permuted labels.

    A sample gives the label at the i-th place of a seeded order to the i-th id.
    """
    s = F.explode(F.sequence(F.lit(0), F.lit(samples - 1))).alias("s")
    ids = labels.select("id", "label", s)
    at = ids.withColumn("n", F.row_number().over(Window.partitionBy("s").orderBy("id"))).select("s", "id", "n")
    mixed = ids.withColumn("n", F.row_number().over(Window.partitionBy("s").orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("s").cast("string"), F.col("id").cast("string"))), "id"))).select("s", "n", "label")
    lab = at.join(mixed, ["s", "n"]).select("s", "id", "label")
    half = edges.where("src < dst").select("src", "dst")
    e = half.join(lab.select(F.col("id").alias("src"), "s", F.col("label").alias("la")), "src").join(lab.select(F.col("id").alias("dst"), "s", F.col("label").alias("lb")), ["dst", "s"])
    null = e.groupBy("s").agg(F.avg((F.col("la") == F.col("lb")).cast("double")).alias("v")).agg(F.avg("v").alias("expected"), F.stddev_pop("v").alias("sd"))
    return same_label_share(edges, labels).crossJoin(null).select("observed", "expected", F.try_divide(F.col("observed") - F.col("expected"), "sd").alias("z"))


def within_region(df: DataFrame, region: str, label: str) -> DataFrame:
    """One row: regions, regions with several types, mean number of types."""
    n = df.groupBy(region).agg(F.countDistinct(label).alias("n"))
    return n.agg(F.count(F.lit(1)).alias("regions"), F.sum((F.col("n") > 1).cast("long")).alias("mixed"), F.avg("n").alias("mean_types"))

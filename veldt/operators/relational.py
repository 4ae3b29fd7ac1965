"""Relational building blocks. Keys are explicit; every order is total."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pivot_mean(long: DataFrame, categories: list[str], fill: float | None = None) -> DataFrame:
    """(entity, period, category, value) -> a column per category, repeated cells averaged. The list fixes the schema."""
    aggs = [F.avg(F.when(F.col("category") == c, F.col("value"))).alias(c.lower()) for c in categories]
    out = long.groupBy("entity", "period").agg(*aggs)
    return out if fill is None else out.na.fill(fill)


def complete_entities(wide: DataFrame, min_months: int) -> DataFrame:
    """Rows of the entities seen in at least ``min_months`` periods."""
    seen = wide.groupBy("entity").agg(F.countDistinct("period").alias("n")).where(F.col("n") >= min_months)
    return wide.join(seen, "entity", "left_semi")


def without_nulls(df: DataFrame) -> DataFrame:
    return df.na.drop()


def latest_version(df: DataFrame, key: str, *order: Column) -> DataFrame:
    """The last row per key in ``order`` (give it a tie-breaker)."""
    w = Window.partitionBy(key).orderBy(*[c.desc() for c in order])
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def first_wins(df: DataFrame, key: str, *order: Column) -> DataFrame:
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def reindex(ids: DataFrame, df: DataFrame, key: str) -> DataFrame:
    return ids.join(df, key, "left")


def both_ends(edges: DataFrame, ids: DataFrame, id_column: str = "entity") -> DataFrame:
    """Edges whose two ends are both among the ids."""
    a, b = ids.select(F.col(id_column).alias("src")), ids.select(F.col(id_column).alias("dst"))
    return edges.join(a, "src", "left_semi").join(b, "dst", "left_semi")


def positions(ids: DataFrame, key: str) -> DataFrame:
    """Dense positions 0.. of the keys in their order."""
    return ids.select(key).distinct().withColumn("position", F.row_number().over(Window.orderBy(key)) - 1)


def minus_group_median(df: DataFrame, columns: list[str], by: str = "period") -> DataFrame:
    """Columns less the median of their group; the medians are one small row per group, joined back."""
    med = df.groupBy(by).agg(*[F.median(c).alias(f"_m_{c}") for c in columns])
    out = df.join(med, by)
    return out.select(*[(F.col(c) - F.col(f"_m_{c}")).alias(c) if c in columns else F.col(c) for c in df.columns])


def rolling_sum(df: DataFrame, columns: list[str], window: int, entity: str = "entity", period: str = "period") -> DataFrame:
    """Sums over the last ``window`` periods of each entity; only full windows."""
    w = Window.partitionBy(entity).orderBy(period).rowsBetween(-(window - 1), 0)
    keep = [c for c in df.columns if c not in columns]
    out = df.select(*keep, *[F.sum(c).over(w).alias(c) for c in columns], F.count(F.lit(1)).over(w).alias("_n"))
    return out.where(F.col("_n") == window).drop("_n")


def month_of_year_mean(df: DataFrame, value: str) -> DataFrame:
    """Mean by entity and calendar month."""
    return df.groupBy("entity", F.substring("period", 6, 2).cast("int").alias("month")).agg(F.avg(value).alias(value))


def entity_mean(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.groupBy("entity").agg(*[F.avg(c).alias(c) for c in columns])


def by_period(df: DataFrame, value: str) -> DataFrame:
    """entity -> its values as an array in period order."""
    pairs = F.array_sort(F.collect_list(F.struct("period", F.col(value).alias("v"))))
    return df.groupBy("entity").agg(F.transform(pairs, lambda x: x["v"]).alias(value))


def coalesce_lookup(rows: DataFrame, by_code: DataFrame, by_name: DataFrame, value: str) -> DataFrame:
    """value by ``code``, else by ``name``."""
    a, b = by_code.select("code", F.col(value).alias("_a")), by_name.select("name", F.col(value).alias("_b"))
    return rows.join(a, "code", "left").join(b, "name", "left").select(*rows.columns, F.coalesce("_a", "_b").alias(value))


def carry_header(rows: DataFrame, is_header: Column, value: Column, order: str, group: str | None = None) -> DataFrame:
    """Each row gets the value of the nearest header row at or before it; header rows go."""
    w = (Window.partitionBy(group) if group else Window.partitionBy()).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("header", F.last(F.when(is_header, value), ignorenulls=True).over(w)).where(~is_header)


def average_rank(df: DataFrame, value: str, by: list[str], out: str = "rank") -> DataFrame:
    """Ascending ranks, ties averaged."""
    w, same = Window.partitionBy(*by).orderBy(value), Window.partitionBy(*by, value)
    return df.withColumn(out, F.rank().over(w) + (F.count(F.lit(1)).over(same) - 1) / 2)


def min_rank(df: DataFrame, value: str, by: list[str], out: str = "rank") -> DataFrame:
    """Descending ranks from 1, ties share the least."""
    return df.withColumn(out, F.rank().over(Window.partitionBy(*by).orderBy(F.col(value).desc())))


def contingency(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))


def masked_mean(df: DataFrame, key: str, value: Column, fair: Column) -> DataFrame:
    """Mean by key of the values that the mask lets through; null if none is."""
    return df.groupBy(key).agg(F.avg(F.when(fair, value)).alias("mean"))


def top_n(df: DataFrame, by: str, n: int, *order: Column) -> DataFrame:
    w = Window.partitionBy(by).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def joined_labels(df: DataFrame, label: str) -> DataFrame:
    """entity -> labels in period order, as one string; ``-`` between them, so any number of types is readable."""
    pairs = F.array_sort(F.collect_list(F.struct("period", F.col(label).cast("string").alias("v"))))
    return df.groupBy("entity").agg(F.array_join(F.transform(pairs, lambda x: x["v"]), "-").alias("path"))


def group_medians(df: DataFrame, by: str, columns: list[str]) -> DataFrame:
    return df.groupBy(by).agg(*[F.median(c).alias(c) for c in columns])


def best_by(df: DataFrame, by: list[str], value: str) -> DataFrame:
    return df.groupBy(*by).agg(F.min(value).alias(value))

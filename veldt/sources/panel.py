"""Sources and sinks: long panels, versioned dimensions, road edges, and result bundles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def scan(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Whole-file Parquet scan; column pruning and filters reach it by themselves."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def orders_panel(spark: SparkSession, sf_dir: str, start: str | None = None, stop: str | None = None) -> DataFrame:
    """entity (nation), period (yyyy-MM), category (segment), value (order totals) of all orders, or of a date range."""
    orders = scan(spark, sf_dir, "orders")
    if start:
        orders = orders.where(F.col("o_orderdate") >= F.lit(start).cast("timestamp_ntz"))
    if stop:
        orders = orders.where(F.col("o_orderdate") < F.lit(stop).cast("timestamp_ntz"))
    joined = orders.join(scan(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return joined.groupBy(
        F.col("c_nationkey").cast("long").alias("entity"), F.date_format("o_orderdate", "yyyy-MM").alias("period"), F.col("c_mktsegment").alias("category"),
    ).agg(F.sum("o_totalprice").alias("value"))


def closed_periods(long: DataFrame) -> DataFrame:
    """The panel without its last period, which still runs."""
    return long.crossJoin(F.broadcast(long.agg(F.max("period").alias("_last")))).where(F.col("period") < F.col("_last")).drop("_last")


def events_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """entity (user), period (day), category (event type), value."""
    e = scan(spark, sf_dir, "events")
    return e.groupBy(F.col("user_id").alias("entity"), F.date_format("ts", "yyyy-MM-dd").alias("period"), F.col("event_type").alias("category")).agg(F.sum("value").alias("value"))


def road_edges(spark: SparkSession, sf_dir: str, reach: int = 12, km: float = 100.0) -> DataFrame:
    """Synthetic road lengths between nations, both directions; pairs out of reach have no row.

    Each nation is joined to the keys within reach, so the join is an equality on the key.
    """
    n = scan(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("src"))
    near = n.select("src", F.explode(F.sequence(F.col("src") - reach, F.col("src") + reach)).alias("dst")).where("src <> dst")
    return near.join(n.select(F.col("src").alias("dst")), "dst", "left_semi").select("src", "dst", (km * F.abs(F.col("src") - F.col("dst"))).cast("double").alias("km"))


def of_kind(edges: DataFrame, column: str, kind: str) -> DataFrame:
    """Scan with a pushed equality filter."""
    return edges.where(F.col(column) == kind)


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """path, sha256 of every file below ``path`` (checks a download against a list of digests)."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", F.sha2("content", 256).alias("sha256"))


def verified(digests: DataFrame, expected: DataFrame) -> DataFrame:
    """expected(name, sha256) with ``ok``: a file of that name has that digest."""
    found = digests.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("sha256").alias("_found"))
    return expected.join(found, "name", "left").select("name", "sha256", F.coalesce(F.col("_found") == F.col("sha256"), F.lit(False)).alias("ok"))


def finite(c: Column) -> Column:
    """NaN and infinities become null, as JSON has no name for them."""
    return F.when(F.isnan(c) | c.isin(float("inf"), float("-inf")), F.lit(None)).otherwise(c)


def records(df: DataFrame, columns: list[str], digits: int = 4) -> DataFrame:
    """Rounded, finite columns for export."""
    kinds = dict(df.dtypes)
    return df.select(*[F.round(finite(F.col(c)), digits).alias(c) if kinds[c] in ("double", "float") else F.col(c) for c in columns])


def json_lines(df: DataFrame) -> DataFrame:
    """One JSON text per row, nulls kept."""
    kinds = dict(df.dtypes)
    clean = [finite(F.col(c)).alias(c) if k in ("double", "float") else F.col(c) for c, k in kinds.items()]
    return df.select(F.to_json(F.struct(*clean), {"ignoreNullFields": "false"}).alias("json"))


def flat_edges(edges: DataFrame) -> DataFrame:
    """Upper triangle of a symmetric edge table."""
    return edges.where("src < dst")


def write_bundle(tables: dict[str, DataFrame], folder: str, fmt: str = "parquet") -> None:
    """One folder per named result."""
    for name, df in tables.items():
        df.write.mode("overwrite").format(fmt).save(f"{folder}/{name}")


def read_bundle(spark: SparkSession, folder: str, names: list[str], fmt: str = "parquet") -> dict[str, DataFrame]:
    return {name: spark.read.format(fmt).load(f"{folder}/{name}") for name in names}

"""Compositional features of a panel. ``wide``: entity, period, one column per category, total."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veldt.functions.scalars import clr, floor_shares, total
from veldt.operators.relational import complete_entities, entity_mean, minus_group_median, pivot_mean, rolling_sum, without_nulls


def wide_panel(long: DataFrame, categories: list[str], min_months: int = 24) -> DataFrame:
    """Zero-filled wide panel of the complete entities; total sums all categories, listed or not."""
    aggs = [F.coalesce(F.sum(F.when(F.col("category") == c, F.col("value"))), F.lit(0.0)).alias(c.lower()) for c in categories]
    wide = long.groupBy("entity", "period").agg(*aggs, F.sum("value").alias("total"))
    seen = wide.groupBy("entity").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_months)
    return wide.join(seen, "entity", "left_semi")


def strict_panel(long: DataFrame, categories: list[str], min_months: int = 24) -> DataFrame:
    """Wide panel of means without filling: entities with enough periods, then rows with every category; total of all categories.

    Completeness is judged before rows are dropped, so an entity may keep fewer rows than periods.
    """
    wide = pivot_mean(long, categories).join(long.groupBy("entity", "period").agg(F.sum("value").alias("total")), ["entity", "period"])
    return without_nulls(complete_entities(wide, min_months))


def share_names(categories: list[str]) -> list[str]:
    return [*[c.lower() for c in categories], "other"]


def smoothed_shares(wide: DataFrame, categories: list[str], window: int = 3, floor: float = 0.002) -> DataFrame:
    """entity, period, shares (the rest as ``other``; not below the floor; sum one), total of the window."""
    cats = [c.lower() for c in categories]
    sums = rolling_sum(wide.select("entity", "period", *cats, "total"), [*cats, "total"], window)
    raw = [F.try_divide(F.col(c), F.col("total")) for c in cats]
    sums = sums.select("entity", "period", "total", *[r.alias(c) for r, c in zip(raw, cats, strict=True)])
    sums = sums.withColumn("other", 1 - total([F.col(c) for c in cats]))
    names = share_names(categories)
    return sums.select("entity", "period", "total", *[s.alias(n) for s, n in zip(floor_shares([F.col(n) for n in names], floor), names, strict=True)])


def clr_features(shares: DataFrame, categories: list[str], relative: bool = True) -> DataFrame:
    """entity, period, clr_<share>; relative: less the median of the period, component by component."""
    names = share_names(categories)
    out = shares.select("entity", "period", *[c.alias(f"clr_{n}") for c, n in zip(clr([F.col(n) for n in names]), names, strict=True)])
    return minus_group_median(out, [f"clr_{n}" for n in names]) if relative else out


def level(shares: DataFrame, window: int = 3) -> DataFrame:
    """Log of the mean monthly total, less the period's median."""
    return minus_group_median(shares.select("entity", "period", F.ln(F.col("total") / window).alias("level")), ["level"])


def rhythm(wide: DataFrame, summer: tuple[int, ...] = (6, 7, 8)) -> DataFrame:
    """entity, amplitude, summer, volatility of the unsmoothed log total.

    r is the log total less the period's median, centred by entity; the profile is its mean
    by calendar month. Amplitude: sample deviation of the profile. Summer: its summer mean
    less its mean. Volatility: sample deviation of r less profile less linear trend.
    """
    r = minus_group_median(wide.select("entity", "period", F.ln("total").alias("r")), ["r"])
    r = r.withColumn("month", F.substring("period", 6, 2).cast("int"))
    mean = r.groupBy("entity").agg(F.avg("r").alias("_mean"))
    # the trend's time is the position of the period, centred
    ranked = r.select("period").distinct().withColumn("t", F.row_number().over(Window.orderBy("period")))
    mid = ranked.agg(F.avg("t").alias("_mid"))
    r = r.join(mean, "entity").join(F.broadcast(ranked), "period").crossJoin(F.broadcast(mid))
    r = r.select("entity", "month", (F.col("r") - F.col("_mean")).alias("r"), (F.col("t") - F.col("_mid")).alias("t"))
    profile = r.groupBy("entity", "month").agg(F.avg("r").alias("p"))
    slope = r.groupBy("entity").agg((F.sum(F.col("r") * F.col("t")) / F.sum(F.col("t") * F.col("t"))).alias("slope"))
    rest = r.join(profile, ["entity", "month"]).join(slope, "entity")
    volatility = rest.groupBy("entity").agg(F.stddev_samp(F.col("r") - F.col("p") - F.col("slope") * F.col("t")).alias("volatility"))
    shape = profile.groupBy("entity").agg(
        F.stddev_samp("p").alias("amplitude"), (F.avg(F.when(F.col("month").isin(*summer), F.col("p"))) - F.avg("p")).alias("summer"),
    )
    return shape.join(volatility, "entity").select("entity", "amplitude", "summer", "volatility")


def market_access(ids: DataFrame, market: DataFrame, value: str = "market_access") -> DataFrame:
    """log1p of the entity's value, of the least value where it has none."""
    least = market.agg(F.min(value).alias("_least"))
    return ids.join(market, "entity", "left").crossJoin(F.broadcast(least)).select("entity", F.log1p(F.coalesce(value, "_least")).alias("market"))


def standardise(df: DataFrame, blocks: dict[str, list[str]], weights: dict[str, float]) -> DataFrame:
    """Each feature by its mean and population deviation over all rows, times block weight over root of block size."""
    columns = [c for cols in blocks.values() for c in cols]
    stats = df.agg(*[F.avg(c).alias(f"_m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"_s_{c}") for c in columns])
    out = df.crossJoin(F.broadcast(stats))  # one row
    scaled = [((F.col(c) - F.col(f"_m_{c}")) / (F.col(f"_s_{c}") + 1e-9) * (weights[b] / len(cols) ** 0.5)).alias(c) for b, cols in blocks.items() for c in cols]
    return out.select("entity", "period", *scaled)


def feature_panel(wide: DataFrame, categories: list[str], window: int = 3, floor: float = 0.002, relative: bool = True, weights: dict[str, float] | None = None, market: DataFrame | None = None) -> DataFrame:
    """The standardised feature panel: structure, level, rhythm and, if given, market access."""
    weights = weights or {"structure": 1.0, "level": 1.0, "rhythm": 0.6, "market": 0.5}
    shares = smoothed_shares(wide, categories, window, floor)
    x = clr_features(shares, categories, relative).join(level(shares, window), ["entity", "period"]).join(rhythm(wide), "entity")
    blocks = {"structure": [f"clr_{n}" for n in share_names(categories)], "level": ["level"], "rhythm": ["amplitude", "summer", "volatility"]}
    if market is not None:
        x = x.join(market_access(x.select("entity").distinct(), market), "entity")
        blocks["market"] = ["market"]
    return standardise(x, blocks, weights)


def profile(panel: DataFrame) -> DataFrame:
    """Mean of every feature over the periods."""
    return entity_mean(panel, [c for c in panel.columns if c not in ("entity", "period")])


def as_vectors(df: DataFrame, key: list[str]) -> DataFrame:
    """key columns and ``x``, the other columns as one array."""
    return df.select(*key, F.array(*[F.col(c).cast("double") for c in df.columns if c not in key]).alias("x"))


def category_residuals(wide: DataFrame, categories: list[str]) -> DataFrame:
    """entity, period, a residual per category and for the total: log of at least one, less the period's median."""
    names = [*[c.lower() for c in categories], "total"]
    logs = wide.select("entity", "period", *[F.ln(F.greatest(F.col(c), F.lit(1.0))).alias(c) for c in names])
    return minus_group_median(logs, names)


def log_series(wide: DataFrame) -> DataFrame:
    return wide.select("entity", "period", F.ln("total").alias("log_total"))

"""Registered queries of the analysis operators on the driver's tables, each with its DuckDB text where SQL can say it.

Floats are rounded to six places on both sides. Types are thirds of the entities by mean
level, so everything that needs a partition has one without clustering first.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veldt.functions.scalars import normal_name
from veldt.operators import cluster, concepts, features, graphs, indices, pairs, ranking, relational, serve, stats, temporal
from veldt.plans.config import FAMILIES, HIGHER_IS_BETTER, RULE_SOURCES, Config
from veldt.plans.sqltext import CATS, FEATURES, RESID, SHARES, sql
from veldt.sources import panel as source
from veldt.sources.staging import materialised

CFG = Config(knn=5)
EVERY = 10_000  # periods: the whole series
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(text: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if text:
            ORACLE[f.__name__] = text
        return f

    return add


def r6(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """Rounded doubles; -0 becomes 0."""
    kinds = dict(df.dtypes)
    names = columns or [c for c in df.columns if kinds[c] == "double"]
    return df.select(*[(F.round(F.col(c), digits) + F.lit(0.0)).alias(c) if c in names else F.col(c) for c in df.columns])


def s6(columns, digits: int = 6) -> str:
    return ", ".join(f"round({c}, {digits}) + 0.0 AS {c}" for c in columns)


# ---- shared inputs -------------------------------------------------------------------

_kept: dict[tuple, DataFrame] = {}


def shared(build: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """The context is built once a session and input: many queries start from it, some several times.

    It is written to the shared folder and read back, so plans above it start from a scan.
    """

    @functools.wraps(build)
    def get(spark: SparkSession, d: str, *args) -> DataFrame:
        key = (spark.sparkContext.applicationId, id(spark), build.__name__, d, *args)
        if key not in _kept:
            _kept[key] = materialised(build(spark, d, *args), build.__name__)
        return _kept[key]

    return get


@shared
def closed(spark: SparkSession, d: str) -> DataFrame:
    return source.closed_periods(source.orders_panel(spark, d))


def months(spark: SparkSession, d: str) -> int:
    return closed(spark, d).select("period").distinct().count()


@shared
def wide(spark: SparkSession, d: str) -> DataFrame:
    """Entities with all closed months."""
    return features.wide_panel(closed(spark, d), list(CFG.categories), months(spark, d))


@shared
def shares(spark: SparkSession, d: str) -> DataFrame:
    return features.smoothed_shares(wide(spark, d), list(CFG.categories))


@shared
def panel_features(spark: SparkSession, d: str) -> DataFrame:
    return features.feature_panel(wide(spark, d), list(CFG.categories))


@shared
def profile_vectors(spark: SparkSession, d: str) -> DataFrame:
    return features.as_vectors(features.profile(panel_features(spark, d)).withColumnRenamed("entity", "id"), ["id"])


@shared
def types(spark: SparkSession, d: str) -> DataFrame:
    """(id, label): thirds by mean level, 0 the highest."""
    mean = features.level(shares(spark, d)).groupBy(F.col("entity").alias("id")).agg(F.avg("level").alias("l"))
    return mean.select("id", (F.ntile(3).over(Window.orderBy(F.desc("l"), "id")) - 1).cast("long").alias("label"))


@shared
def residuals(spark: SparkSession, d: str) -> DataFrame:
    return features.category_residuals(wide(spark, d), list(CFG.categories))


def series_z(spark: SparkSession, d: str, columns: tuple[str, ...] = RESID) -> DataFrame:
    return graphs.window_z(residuals(spark, d), list(columns), "9999-99", EVERY, 6)


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return source.scan(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("x"))


def vector_labels(spark: SparkSession, d: str) -> DataFrame:
    return source.scan(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label")


@shared
def vector_graph(spark: SparkSession, d: str) -> DataFrame:
    return graphs.cosine_graph(vectors(spark, d), 15)


@shared
def profile_graph(spark: SparkSession, d: str) -> DataFrame:
    return graphs.cosine_graph(profile_vectors(spark, d), 5)


def regions(spark: SparkSession, d: str) -> DataFrame:
    return source.scan(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_regionkey").alias("g"))


@shared
def emissions(spark: SparkSession, d: str) -> DataFrame:
    panel = panel_features(spark, d)
    p = profile_vectors(spark, d)
    centres = indices.centroids(p, types(spark, d))
    t = temporal.tau(p, centres).first()[0] or 1.0
    return temporal.emissions(features.as_vectors(panel, ["entity", "period"]), centres, t)


def path(spark: SparkSession, d: str) -> DataFrame:
    return temporal.viterbi(emissions(spark, d), CFG.p_switch)


# ---- panel and relational ------------------------------------------------------------


@query(sql("SELECT entity, period, " + ", ".join(f"round(avg(value) FILTER (category = '{c.upper()}'), 6) + 0.0 AS {c}" for c in CATS) + " FROM panel GROUP BY ALL"))
def panel_wide(spark, d):
    return r6(relational.pivot_mean(source.orders_panel(spark, d), list(CFG.categories)))


@query("SELECT user_id AS entity, strftime(ts, '%Y-%m-%d') AS period, event_type AS category, round(sum(value), 6) + 0.0 AS value FROM events GROUP BY ALL")
def panel_days(spark, d):
    return r6(source.events_panel(spark, d))


@query(sql("SELECT entity, count(*) AS periods FROM wide GROUP BY entity"))
def complete_entities(spark, d):
    return relational.complete_entities(features.wide_panel(closed(spark, d), list(CFG.categories), 1), months(spark, d)).groupBy("entity").agg(F.count(F.lit(1)).alias("periods"))


@query(sql("SELECT entity, period FROM (SELECT entity, period, " + ", ".join(f"avg(value) FILTER (category = '{c.upper()}') AS {c}" for c in CATS) + " FROM panel GROUP BY ALL) WHERE " + " AND ".join(f"{c} IS NOT NULL" for c in CATS)))
def rows_without_nulls(spark, d):
    return relational.without_nulls(relational.pivot_mean(source.orders_panel(spark, d), list(CFG.categories))).select("entity", "period")


@query("SELECT o_custkey, o_orderkey, round(o_totalprice, 2) AS o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def latest_version(spark, d):
    o = source.scan(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice")
    return relational.latest_version(o, "o_custkey", F.col("o_orderdate"), F.col("o_orderkey")).select("o_custkey", "o_orderkey", F.round("o_totalprice", 2).alias("o_totalprice"))


@query("SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1")
def first_wins(spark, d):
    return relational.first_wins(source.scan(spark, d, "orders").select("o_custkey", "o_orderkey"), "o_custkey", F.col("o_orderkey")).select("o_custkey", "o_orderkey")


@query("SELECT n_nationkey::BIGINT AS entity, c.n AS customers FROM nation LEFT JOIN (SELECT c_nationkey, count(*) AS n FROM customer WHERE c_acctbal > 9000 GROUP BY 1) c ON c_nationkey = n_nationkey")
def reindexed(spark, d):
    ids = source.scan(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("entity"))
    n = source.scan(spark, d, "customer").where("c_acctbal > 9000").groupBy(F.col("c_nationkey").cast("long").alias("entity")).agg(F.count(F.lit(1)).alias("customers"))
    return relational.reindex(ids, n, "entity")


@query(sql("SELECT src, dst, km FROM roads WHERE src IN (SELECT c_nationkey FROM customer WHERE c_acctbal > 9900) AND dst IN (SELECT c_nationkey FROM customer WHERE c_acctbal > 9900)"))
def both_ends(spark, d):
    ids = source.scan(spark, d, "customer").where("c_acctbal > 9900").select(F.col("c_nationkey").cast("long").alias("entity")).distinct()
    return relational.both_ends(source.road_edges(spark, d), ids).select("src", "dst", "km")


@query("SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1")
def pushed_filter(spark, d):
    return source.of_kind(source.scan(spark, d, "orders"), "o_orderstatus", "F").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT r_name, row_number() OVER (ORDER BY r_name) - 1 AS position FROM region")
def key_positions(spark, d):
    return relational.positions(source.scan(spark, d, "region"), "r_name").select("r_name", F.col("position").cast("long").alias("position"))


@query(sql("SELECT entity, period, " + s6(RESID, 2) + " FROM rolled"))
def rolling_sum(spark, d):
    return r6(relational.rolling_sum(wide(spark, d), list(RESID), 3), digits=2)


@query(sql("SELECT entity, period, round(total - median(total) OVER (PARTITION BY period), 3) + 0.0 AS total FROM wide"))
def period_median_residual(spark, d):
    return r6(relational.minus_group_median(wide(spark, d).select("entity", "period", "total"), ["total"]), digits=3)


@query(sql("SELECT entity, substr(period, 6, 2)::INT AS month, round(avg(total), 3) AS total FROM wide GROUP BY ALL"))
def month_of_year_mean(spark, d):
    return r6(relational.month_of_year_mean(wide(spark, d), "total"), digits=3)


@query(sql("SELECT entity, list(round(total, 2) ORDER BY period) AS total FROM wide GROUP BY entity"))
def series_by_period(spark, d):
    return relational.by_period(wide(spark, d).withColumn("total", F.round("total", 2)), "total")


@query("SELECT p_brand, round(quantile_cont(p_retailprice, 0.1), 6) AS q10, round(quantile_cont(p_retailprice, 0.9), 6) AS q90 FROM part GROUP BY p_brand")
def quantiles(spark, d):
    return source.scan(spark, d, "part").groupBy("p_brand").agg(F.round(F.percentile("p_retailprice", 0.1), 6).alias("q10"), F.round(F.percentile("p_retailprice", 0.9), 6).alias("q90"))


@query("SELECT lang, source, count(*) AS n FROM documents GROUP BY ALL")
def contingency(spark, d):
    return relational.contingency(source.scan(spark, d, "documents"), "lang", "source")


@query("SELECT o_orderpriority AS k, avg(o_totalprice) FILTER (o_orderstatus = 'F') IS NOT NULL AS has, round(avg(o_totalprice) FILTER (o_orderstatus = 'F'), 3) AS mean FROM orders GROUP BY 1")
def masked_mean(spark, d):
    out = relational.masked_mean(source.scan(spark, d, "orders").withColumnRenamed("o_orderpriority", "k"), "k", F.col("o_totalprice"), F.col("o_orderstatus") == "F")
    return out.select("k", F.col("mean").isNotNull().alias("has"), F.round("mean", 3).alias("mean"))


@query("SELECT p_partkey, p_brand, rank() OVER w + (count(*) OVER (PARTITION BY p_brand, p_size) - 1) / 2.0::DOUBLE AS avg_rank, rank() OVER (PARTITION BY p_brand ORDER BY p_size DESC) AS min_rank FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_size)")
def ranks(spark, d):
    p = relational.average_rank(source.scan(spark, d, "part"), "p_size", ["p_brand"], "avg_rank")
    return relational.min_rank(p, "p_size", ["p_brand"], "min_rank").select("p_partkey", "p_brand", "avg_rank", F.col("min_rank").cast("long").alias("min_rank"))


@query("SELECT line, value, header FROM (SELECT o_orderkey AS line, o_orderpriority AS value, last_value(CASE WHEN o_orderpriority = '1-URGENT' THEN o_orderstatus END IGNORE NULLS) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) AS header FROM orders) WHERE value <> '1-URGENT'")
def region_header_fill(spark, d):
    rows = source.scan(spark, d, "orders").select(F.col("o_orderkey").alias("line"), F.col("o_orderpriority").alias("value"), "o_custkey", "o_orderstatus")
    return relational.carry_header(rows, F.col("value") == "1-URGENT", F.col("o_orderstatus"), "line", "o_custkey").select("line", "value", "header")


@query("SELECT n_nationkey::BIGINT AS id, coalesce(CASE WHEN n_regionkey IN (0, 2) THEN n_nationkey * 10 END, CASE WHEN n_regionkey IN (1, 2) THEN n_nationkey * 100 END)::BIGINT AS population FROM nation")
def code_or_name_match(spark, d):
    rows = source.scan(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_nationkey").cast("string").alias("code"), normal_name(F.col("n_name")).alias("name"), "n_regionkey")
    codes = rows.where("n_regionkey in (0, 2)").select("code", (F.col("id") * 10).alias("population"))
    names = rows.where("n_regionkey in (1, 2)").select("name", (F.col("id") * 100).alias("population"))
    return relational.coalesce_lookup(rows.drop("n_regionkey"), codes, names, "population").select("id", "population")


@query("SELECT p_partkey, trim(regexp_replace(regexp_replace(lower(p_name || ' - ' || p_type), '[^a-z0-9]', ' ', 'g'), ' +', ' ', 'g')) AS name FROM part")
def name_normalise(spark, d):
    return source.scan(spark, d, "part").select("p_partkey", normal_name(F.concat_ws(" - ", "p_name", "p_type")).alias("name"))


@query("SELECT c_custkey, TRY_CAST(substr(c_name, 10) AS DOUBLE) AS number, TRY_CAST(c_mktsegment AS DOUBLE) AS bad FROM customer")
def safe_number(spark, d):
    from veldt.functions.scalars import safe_double

    return source.scan(spark, d, "customer").select("c_custkey", safe_double(F.substring("c_name", 10, 20)).alias("number"), safe_double(F.col("c_mktsegment")).alias("bad"))


@query("SELECT c_custkey, substr(lpad(c_custkey::VARCHAR, 10, '0'), 1, 8) AS code FROM customer")
def code8(spark, d):
    from veldt.functions.scalars import code8 as code

    return source.scan(spark, d, "customer").select("c_custkey", code(F.concat(F.col("c_custkey").cast("string"), F.lit(".5"))).alias("code"))


# ---- features ------------------------------------------------------------------------


@query(sql("SELECT entity, period, " + s6(SHARES) + " FROM shares"))
def shares_floor(spark, d):
    return r6(shares(spark, d).select("entity", "period", *SHARES))


@query(sql("SELECT entity, period, " + s6([f"clr_{c}" for c in SHARES]) + " FROM clr0"))
def clr(spark, d):
    return r6(features.clr_features(shares(spark, d), list(CFG.categories), False))


@query(sql("SELECT entity, period, " + s6([f"clr_{c}" for c in SHARES]) + " FROM clr"))
def clr_relative(spark, d):
    return r6(features.clr_features(shares(spark, d), list(CFG.categories)))


@query(sql("SELECT entity, period, " + s6(["level"]) + " FROM level"))
def level(spark, d):
    return r6(features.level(shares(spark, d)))


@query(sql("SELECT entity, " + s6(["amplitude", "summer", "volatility"]) + " FROM rhythm"))
def rhythm(spark, d):
    return r6(features.rhythm(wide(spark, d)))


@query(sql("SELECT entity, period, " + s6(FEATURES) + " FROM features"))
def standardised_features(spark, d):
    return r6(panel_features(spark, d))


@query(sql("SELECT entity, " + s6(FEATURES) + " FROM profile"))
def static_profile(spark, d):
    return r6(features.profile(panel_features(spark, d)))


@query(sql("SELECT entity, period, " + s6(RESID) + " FROM resid"))
def category_residuals(spark, d):
    return r6(residuals(spark, d))


@query(sql("SELECT entity, period, round(ln(total), 6) AS log_total FROM wide"))
def log_series(spark, d):
    return r6(features.log_series(wide(spark, d)))


@query("SELECT n_nationkey::BIGINT AS entity, round(ln(1 + coalesce(m, (SELECT min(m) FROM (SELECT sum(s_acctbal) AS m FROM supplier WHERE s_acctbal > 8000 GROUP BY s_nationkey)))), 6) AS market FROM nation LEFT JOIN (SELECT s_nationkey, sum(s_acctbal) AS m FROM supplier WHERE s_acctbal > 8000 GROUP BY 1) ON s_nationkey = n_nationkey")
def market_access(spark, d):
    ids = source.scan(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("entity"))
    m = source.scan(spark, d, "supplier").where("s_acctbal > 8000").groupBy(F.col("s_nationkey").cast("long").alias("entity")).agg(F.sum("s_acctbal").alias("market_access"))
    return r6(features.market_access(ids, m))


# ---- pairs and graphs ----------------------------------------------------------------


@query(sql("SELECT src, dst, round(sim, 6) + 0.0 AS sim, rank::INT AS rank FROM ecos_r WHERE rank <= 15"))
def cosine_pairs(spark, d):
    return r6(pairs.top_k(vectors(spark, d), 15))


@query(sql("SELECT src, dst, round(w, 6) + 0.0 AS w FROM eknn"))
def knn_graph(spark, d):
    return r6(vector_graph(spark, d))


@query(sql("SELECT src, dst, round(sim, 6) + 0.0 AS sim FROM pcos_r WHERE rank <= 6"))
def twins(spark, d):
    return r6(pairs.top_k(profile_vectors(spark, d), 6).drop("rank"))


@query(sql("SELECT src, dst, round(w, 6) + 0.0 AS w FROM zknn"))
def residual_corr(spark, d):
    return r6(graphs.knn_graph(graphs.residual_similarity(series_z(spark, d), 5), 5))


_LAGS = " UNION ALL ".join(f"SELECT a.id AS src, b.id AS dst, {lag} AS lag, sum(a.z * b.z) / (5 * ((SELECT max(t) FROM ztidy) - {abs(lag)})) AS s FROM ztidy a JOIN ztidy b ON a.c = b.c AND b.t = a.t + {lag} AND a.id <> b.id GROUP BY a.id, b.id" for lag in (-2, -1, 0, 1, 2))


@query(sql(f"SELECT a.src, a.dst, round((a.m + b.m) / 2, 6) + 0.0 AS sim FROM (SELECT src, dst, max(s) AS m FROM ({_LAGS}) GROUP BY ALL) a JOIN (SELECT src, dst, max(s) AS m FROM ({_LAGS}) GROUP BY ALL) b ON a.src = b.dst AND a.dst = b.src"))
def lagged_corr(spark, d):
    return r6(graphs.lagged_similarity(series_z(spark, d), 1000, 5, 2).drop("rank"))


# cell (i, j) of the anti-diagonal d = i + j lies at i + 2, as a step back in i must find one
_DTW = """ts AS (SELECT id, list(z ORDER BY t) AS x, count(*) AS n FROM ztidy WHERE c = 4 GROUP BY id),
diag(src, dst, x, y, n, d, older, last) AS (
SELECT a.id, b.id, a.x, b.x, a.n, -1::BIGINT, list_transform(range(0, a.n + 1), lambda c: CASE WHEN c = 0 THEN 0 ELSE 'Infinity'::DOUBLE END::DOUBLE), list_transform(range(0, a.n + 1), lambda c: 'Infinity'::DOUBLE) FROM ts a JOIN ts b ON a.id <> b.id
UNION ALL SELECT src, dst, x, y, n, d + 1, last, list_transform(range(0, n + 1), lambda c: CASE WHEN c > 0 AND d + 2 - c BETWEEN 0 AND n - 1 AND abs(2 * (c - 1) - d - 1) <= 2 THEN power(x[c] - y[d + 3 - c], 2) + least(older[c], last[c], last[c + 1]) ELSE 'Infinity'::DOUBLE END) FROM diag WHERE d < 2 * n - 2),
far AS (SELECT src, dst, sqrt(last[n + 1]) AS d FROM diag WHERE d = 2 * n - 2)"""


@query(sql("SELECT src, dst, round(exp(-d / (SELECT median(d) FROM far)), 6) AS sim FROM far", _DTW))
def dtw_similarity(spark, d):
    return r6(graphs.dtw_similarity(series_z(spark, d, ("total",)), CFG.dtw_candidates, CFG.dtw_band))


@query(sql("SELECT src, dst, round(sim, 6) AS sim FROM road_sim"))
def road_similarity(spark, d):
    return r6(graphs.road_similarity(source.road_edges(spark, d), 300.0))


@query(sql("SELECT src, dst, round(w, 6) + 0.0 AS w FROM hknn"))
def hybrid_graph(spark, d):
    return r6(graphs.knn_graph(graphs.hybrid_similarity(profile_vectors(spark, d), source.road_edges(spark, d), 5, 0.7, 300.0), 5))


@query(sql("SELECT src, dst, round(w, 6) + 0.0 AS w FROM pknn_n"))
def normalised_graph(spark, d):
    return r6(graphs.normalised(profile_graph(spark, d)))


@query(sql("SELECT src, dst, round(w, 6) + 0.0 AS w FROM multi"))
def multiplex_graph(spark, d):
    return r6(graphs.build("multiplex", profile_vectors(spark, d), residuals(spark, d), source.road_edges(spark, d), list(RESID), "9999-99", EVERY, CFG))


@query(sql("SELECT src, dst, round(w, 6) + 0.0 AS w, rank FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY w DESC, dst)::INT AS rank FROM pknn) WHERE rank <= 8"))
def neighbour_list(spark, d):
    return r6(graphs.neighbours(profile_graph(spark, d), 8))


@query(sql("SELECT k, count(*) // 2 AS edges FROM (SELECT DISTINCT k, src, dst FROM (SELECT k, src, dst FROM ecos_r, (SELECT unnest([5, 10, 15]) AS k) WHERE rank <= k AND sim > 0 UNION ALL SELECT k, dst, src FROM ecos_r, (SELECT unnest([5, 10, 15]) AS k) WHERE rank <= k AND sim > 0)) GROUP BY k"))
def knn_sensitivity(spark, d):
    ranked = pairs.top_k(vectors(spark, d), 15).where("sim > 0")  # ranked once for all k
    each = ranked.select("src", "dst", "rank", F.explode(F.array(*[F.lit(k) for k in (5, 10, 15)])).alias("k")).where("rank <= k")
    both = each.select("k", F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    return both.groupBy("k").agg(F.count(F.lit(1)).alias("edges"))


@query(sql("SELECT src AS id, count(*) AS degree, round(sum(w), 6) AS strength FROM eknn GROUP BY src"))
def graph_degree_stats(spark, d):
    return r6(graphs.degrees(vector_graph(spark, d)))


@query(sql("SELECT a.src AS id, CASE WHEN a.d < 2 THEN 0.0 ELSE round(coalesce(t.n, 0)::DOUBLE / (a.d * (a.d - 1)), 6) END AS clustering FROM (SELECT src, count(*) AS d FROM eknn GROUP BY src) a LEFT JOIN (SELECT p.src, count(*) AS n FROM eknn p JOIN eknn q ON p.src = q.src AND p.dst <> q.dst JOIN eknn r ON r.src = p.dst AND r.dst = q.dst GROUP BY p.src) t USING (src)"))
def local_clustering(spark, d):
    return r6(graphs.local_clustering(vector_graph(spark, d)))


@query(sql("SELECT id, min(component) AS component FROM reach GROUP BY id", "rknn_in AS (SELECT e.* FROM rknn e JOIN nation a ON e.src = a.n_nationkey JOIN nation b ON e.dst = b.n_nationkey WHERE a.n_regionkey = b.n_regionkey), reach(id, component) AS (SELECT n_nationkey::BIGINT, n_nationkey::BIGINT FROM nation UNION SELECT e.src, r.component FROM reach r JOIN rknn_in e ON e.dst = r.id)"))
def components(spark, d):
    g = regions(spark, d)
    e = graphs.build("road", None, None, source.road_edges(spark, d), [], "", 0, CFG)
    e = e.join(g.select(F.col("id").alias("src"), "g"), "src").join(g.select(F.col("id").alias("dst"), "g"), ["dst", "g"]).drop("g")
    return graphs.components(e, g.select("id"))


@query(sql("""SELECT round((same / m - sq / (m * m)) / (1 - sq / (m * m)), 6) + 0.0 AS assortativity FROM (
SELECT sum(n)::DOUBLE AS m, (sum(n) FILTER (a = b))::DOUBLE AS same FROM (SELECT x.n_regionkey AS a, y.n_regionkey AS b, count(*) AS n FROM rknn JOIN nation x ON src = x.n_nationkey JOIN nation y ON dst = y.n_nationkey GROUP BY ALL)),
(SELECT sum(n * n)::DOUBLE AS sq FROM (SELECT n_regionkey, count(*) AS n FROM rknn JOIN nation ON src = n_nationkey GROUP BY 1))"""))
def assortativity(spark, d):
    return r6(graphs.assortativity(graphs.build("road", None, None, source.road_edges(spark, d), [], "", 0, CFG), regions(spark, d)))


@query(sql("SELECT round(avg((a.label <> b.label)::INT), 6) AS cross_share FROM eknn JOIN elabel a ON src = a.id JOIN elabel b ON dst = b.id"))
def cross_type_share(spark, d):
    return r6(graphs.cross_label_share(vector_graph(spark, d), vector_labels(spark, d)))


@query(sql("""SELECT (SELECT count(*) FROM pknn WHERE src < dst) AS edges, round((SELECT count(*) FROM pknn) / 25.0::DOUBLE, 6) AS degree, (SELECT max(c) FROM dg) AS degree_max,
round((SELECT sum(CASE WHEN c < 2 THEN 0 ELSE coalesce(n, 0)::DOUBLE / (c * (c - 1)) END) FROM dg LEFT JOIN tri USING (src)) / 25, 6) AS clustering,
(SELECT count(DISTINCT component) FROM (SELECT id, min(component) AS component FROM reach GROUP BY id)) AS components,
(SELECT round(avg((a.n_regionkey = b.n_regionkey)::INT), 6) FROM pknn JOIN nation a ON src = a.n_nationkey JOIN nation b ON dst = b.n_nationkey WHERE src < dst) AS same_group,
(SELECT round(median(km), 6) FROM pknn JOIN roads USING (src, dst) WHERE src < dst) AS median_km,
(SELECT round((same / m - sq / (m * m)) / (1 - sq / (m * m)), 6) + 0.0 FROM (SELECT sum(n)::DOUBLE AS m, (sum(n) FILTER (a = b))::DOUBLE AS same FROM mix), (SELECT sum(n * n)::DOUBLE AS sq FROM (SELECT a, sum(n) AS n FROM mix GROUP BY a))) AS assortativity""",
  """dg AS (SELECT src, count(*) AS c FROM pknn GROUP BY src), tri AS (SELECT p.src, count(*) AS n FROM pknn p JOIN pknn q ON p.src = q.src AND p.dst <> q.dst JOIN pknn r ON r.src = p.dst AND r.dst = q.dst GROUP BY p.src),
mix AS (SELECT x.n_regionkey AS a, y.n_regionkey AS b, count(*) AS n FROM pknn JOIN nation x ON src = x.n_nationkey JOIN nation y ON dst = y.n_nationkey GROUP BY ALL),
reach(id, component) AS (SELECT n_nationkey::BIGINT, n_nationkey::BIGINT FROM nation UNION SELECT e.src, r.component FROM reach r JOIN pknn e ON e.dst = r.id)"""))
def graph_properties(spark, d):
    return r6(graphs.properties(profile_graph(spark, d), regions(spark, d).select("id"), regions(spark, d), source.road_edges(spark, d)))


@query(sql("SELECT src, dst, round(exp(-d * d / (a.s * b.s)), 6) AS w FROM (SELECT * FROM ed WHERE n <= 30) JOIN (SELECT src, d AS s FROM ed WHERE n = 15) a USING (src) JOIN (SELECT src AS dst, d AS s FROM ed WHERE n = 15) b USING (dst)",
  "ed AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY d, dst) AS n FROM (SELECT a.id AS src, b.id AS dst, list_distance(a.x, b.x) AS d FROM evec a JOIN evec b ON a.id <> b.id))"))
def feature_kernel(spark, d):
    return r6(graphs.feature_kernel(vectors(spark, d), 15, 30))


# ---- partition indices ---------------------------------------------------------------


@query(sql("""SELECT round(avg(CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END), 6) AS "SW" FROM (
SELECT id, max(m) FILTER (own = label) AS a, min(m) FILTER (own <> label) AS b FROM (
SELECT p.id, p.label AS own, q.label, avg(list_distance(p.x, q.x)) AS m FROM evec p JOIN evec q ON p.id <> q.id GROUP BY ALL) GROUP BY id, own)"""))
def silhouette(spark, d):
    return r6(indices.silhouette(vectors(spark, d), vector_labels(spark, d)))


_ETIDY = "SELECT id, label, unnest(range(1, len(x) + 1)) AS f, unnest(x) AS v FROM evec"


@query(sql(f"""SELECT round((b / (k - 1)) / (w / (n - k)), 6) AS "CH" FROM (SELECT sum(c * power(m - g, 2)) AS b, sum(c * s) AS w FROM (SELECT label, f, count(*) AS c, avg(v) AS m, var_pop(v) AS s FROM ({_ETIDY}) GROUP BY ALL) JOIN (SELECT f, avg(v) AS g FROM ({_ETIDY}) GROUP BY f) USING (f)), (SELECT count(DISTINCT label) AS k, count(*) AS n FROM evec)"""))
def calinski_harabasz(spark, d):
    return r6(indices.calinski_harabasz(vectors(spark, d), vector_labels(spark, d)))


@query(sql(f"""SELECT round(scat + dens, 6) AS "S_Dbw" FROM (
SELECT avg(norm) / (SELECT sqrt(sum(s * s)) FROM (SELECT f, var_pop(v) AS s FROM ({_ETIDY}) GROUP BY f)) AS scat FROM norms),
(SELECT avg(CASE WHEN greatest(a.n, b.n) > 0 THEN m.n::DOUBLE / greatest(a.n, b.n) ELSE 0 END) AS dens FROM (
  SELECT i.label AS li, j.label AS lj, (SELECT count(*) FROM evec WHERE label IN (i.label, j.label) AND list_distance(x, list_transform(list_zip(i.x, j.x), lambda z: (z[1] + z[2]) / 2)) <= dev) AS n
  FROM cents i JOIN cents j ON i.label < j.label, devs) m JOIN own a ON a.label = li JOIN own b ON b.label = lj)""",
  f"""norms AS (SELECT label, sqrt(sum(s * s)) AS norm FROM (SELECT label, f, var_pop(v) AS s FROM ({_ETIDY}) GROUP BY ALL) GROUP BY label),
devs AS (SELECT sqrt(sum(norm)) / count(*) AS dev FROM norms),
cents AS (SELECT label, list(m ORDER BY f) AS x FROM (SELECT label, f, avg(v) AS m FROM ({_ETIDY}) GROUP BY ALL) GROUP BY label),
own AS (SELECT c.label, count(*) FILTER (list_distance(e.x, c.x) <= dev) AS n FROM cents c JOIN evec e ON e.label = c.label, devs GROUP BY c.label)"""))
def s_dbw(spark, d):
    return r6(indices.s_dbw(vectors(spark, d), vector_labels(spark, d)))


_BLOCK = 'SELECT g.ci, g.cj, coalesce(w, 0) AS w FROM (SELECT DISTINCT a.label AS ci, b.label AS cj FROM elabel a, elabel b) g LEFT JOIN (SELECT a.label AS ci, b.label AS cj, sum(w) AS w FROM eknn JOIN elabel a ON src = a.id JOIN elabel b ON dst = b.id GROUP BY ALL) s ON g.ci = s.ci AND g.cj = s.cj'


@query(sql(f"SELECT ci, cj, round(w, 5) + 0.0 AS w FROM ({_BLOCK})"))
def block_weights(spark, d):
    return r6(indices.block_weights(vector_graph(spark, d), vector_labels(spark, d)), digits=5)


@query(sql(f"""SELECT round(avg(i / greatest(i + c, 1e-12)), 6) AS "AVI", round((SELECT avg(w / greatest(a.i + b.i + w, 1e-12)) FROM bl JOIN per a ON bl.ci = a.ci JOIN per b ON bl.cj = b.ci WHERE bl.ci < bl.cj), 6) AS "AVU",
round(sum(2 * i) / sum(v) - sum(v * v) / power(sum(v), 2), 6) AS "MQ" FROM per""", f"bl AS ({_BLOCK}), per AS (SELECT ci, sum(w) FILTER (ci = cj) / 2 AS i, coalesce(sum(w) FILTER (ci <> cj), 0) AS c, sum(w) AS v FROM bl GROUP BY ci)"))
def avi_avu(spark, d):
    return r6(indices.graph_indices(vector_graph(spark, d), vector_labels(spark, d)))


@query(sql(f"""SELECT round(sum(w) FILTER (ci = cj) / sum(w) - (SELECT sum(v * v) FROM (SELECT sum(w) AS v FROM bl GROUP BY ci)) / power(sum(w), 2), 6) AS "MQ" FROM bl""", f"bl AS ({_BLOCK})"))
def modularity(spark, d):
    return r6(indices.modularity(vector_graph(spark, d), vector_labels(spark, d)))


_PAIR = "SELECT label AS la, (id % 7) AS lb, count(*)::DOUBLE AS n FROM elabel GROUP BY ALL"


@query(sql(f"""SELECT round((x - r * c / (t * (t - 1) / 2)) / ((r + c) / 2 - r * c / (t * (t - 1) / 2)), 6) + 0.0 AS "ARI" FROM (SELECT sum(n * (n - 1) / 2) AS x, sum(n) AS t FROM ({_PAIR})), (SELECT sum(n * (n - 1) / 2) AS r FROM (SELECT sum(n) AS n FROM ({_PAIR}) GROUP BY la)), (SELECT sum(n * (n - 1) / 2) AS c FROM (SELECT sum(n) AS n FROM ({_PAIR}) GROUP BY lb))"""))
def ari(spark, d):
    lab = vector_labels(spark, d)
    return r6(indices.adjusted_rand(lab, lab.select("id", (F.col("id") % 7).alias("label"))))


@query(sql(f"""SELECT round((SELECT sum(n / t * ln(n * t / (na * nb))) FROM p JOIN (SELECT la, sum(n) AS na FROM p GROUP BY la) USING (la) JOIN (SELECT lb, sum(n) AS nb FROM p GROUP BY lb) USING (lb), tt) /
(((SELECT -sum(n / t * ln(n / t)) FROM (SELECT sum(n) AS n FROM p GROUP BY la), tt) + (SELECT -sum(n / t * ln(n / t)) FROM (SELECT sum(n) AS n FROM p GROUP BY lb), tt)) / 2), 6) AS "NMI" """, f"p AS ({_PAIR}), tt AS (SELECT sum(n) AS t FROM p)"))
def nmi(spark, d):
    lab = vector_labels(spark, d)
    return r6(indices.mutual_information(lab, lab.select("id", (F.col("id") % 7).alias("label"))))


@query(sql("SELECT count(*) AS clusters, round(min(n) / sum(n), 6) AS min_share FROM (SELECT label, count(*) AS n FROM elabel GROUP BY label)"))
def min_share(spark, d):
    return r6(indices.sizes(vector_labels(spark, d)))


@query(sql("SELECT label, f, round(avg(v), 6) + 0.0 AS m FROM (SELECT id, label, unnest(range(0, len(x))) AS f, unnest(x) AS v FROM evec) GROUP BY ALL"))
def centroids(spark, d):
    c = indices.centroids(vectors(spark, d), vector_labels(spark, d))
    return r6(c.select("label", F.posexplode("x").alias("f", "m")).withColumn("f", F.col("f").cast("long")))


# ---- ranking -------------------------------------------------------------------------


def scores(spark, d) -> DataFrame:
    """Brands judged by four measures, within two groups of quantity."""
    l = source.scan(spark, d, "lineitem").join(source.scan(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    m = l.groupBy((F.col("l_linenumber") % 2).alias("k"), F.col("p_brand").alias("item")).agg(
        F.round(F.avg("l_quantity"), 3).alias("q"), F.round(F.avg("l_discount"), 4).alias("c"), F.round(F.sum("l_extendedprice"), 0).alias("e"), F.count(F.lit(1)).cast("double").alias("n"),
    )
    return m.unpivot(["k", "item"], ["q", "c", "e", "n"], "criterion", "value")


_SCORES = """sc AS (SELECT k, item, criterion, value FROM (SELECT (l_linenumber % 2) AS k, p_brand AS item, round(avg(l_quantity), 3) AS q, round(avg(l_discount), 4) AS c, round(sum(l_extendedprice), 0) AS e, count(*)::DOUBLE AS n
FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL) UNPIVOT (value FOR criterion IN (q, c, e, n))),
rk AS (SELECT *, rank() OVER (PARTITION BY k, criterion ORDER BY value) + (count(*) OVER (PARTITION BY k, criterion, value) - 1) / 2.0::DOUBLE AS r FROM sc),
bo AS (SELECT k, item, sum(r) - count(*) AS borda FROM rk GROUP BY ALL),
ma AS (SELECT a.k, a.item AS a, b.item AS b, sum((a.value > b.value)::INT)::BIGINT AS wins FROM sc a JOIN sc b ON a.k = b.k AND a.criterion = b.criterion AND a.item <> b.item GROUP BY ALL),
co AS (SELECT x.k, x.a AS item, sum(sign(x.wins - y.wins))::BIGINT AS copeland FROM ma x JOIN ma y ON x.k = y.k AND x.a = y.b AND x.b = y.a GROUP BY ALL)"""


def with_scores(select: str) -> str:
    return f"WITH {_SCORES}\n{select}"


@query(with_scores("SELECT * FROM bo"))
def borda(spark, d):
    return ranking.borda(scores(spark, d))


@query(with_scores("SELECT * FROM ma"))
def majority(spark, d):
    return ranking.majority(scores(spark, d))


@query(with_scores("SELECT * FROM co"))
def copeland(spark, d):
    return ranking.copeland(scores(spark, d))


@query(with_scores("""SELECT k, round(12 * sum(power(r - mean, 2)) / (4 * 4 * (count(*) * count(*) * count(*) - count(*))), 6) AS "W" FROM (SELECT k, item, sum(r) AS r, avg(sum(r)) OVER (PARTITION BY k) AS mean FROM rk GROUP BY k, item) GROUP BY k"""))
def kendall_w(spark, d):
    return r6(ranking.kendall_w(scores(spark, d)))


@query(with_scores("SELECT k, item, borda, copeland, rank() OVER (PARTITION BY k ORDER BY borda DESC) AS borda_rank, rank() OVER (PARTITION BY k ORDER BY copeland DESC) AS copeland_rank FROM bo JOIN co USING (k, item)"))
def rank_table(spark, d):
    out = ranking.rank_table(scores(spark, d)).drop("kemeny_rank")
    return out.select("k", "item", "borda", "copeland", *[F.col(c).cast("long").alias(c) for c in ("borda_rank", "copeland_rank")])


_KEMENY = """,
beats AS (SELECT x.k, x.a, x.b FROM ma x JOIN ma y ON x.k = y.k AND x.a = y.b AND x.b = y.a WHERE x.wins > y.wins),
pass(k, o, i, moved, step) AS (
SELECT k, list(item ORDER BY borda DESC, item), 1::BIGINT, false, 0::BIGINT FROM bo GROUP BY k
UNION ALL
SELECT p.k, CASE WHEN b.a IS NULL OR p.i = len(p.o) THEN p.o ELSE p.o[:p.i - 1] || [p.o[p.i + 1], p.o[p.i]] || p.o[p.i + 2:] END,
       CASE WHEN p.i = len(p.o) THEN 1 ELSE p.i + 1 END, CASE WHEN p.i = len(p.o) THEN false ELSE p.moved OR b.a IS NOT NULL END, p.step + 1
FROM pass p LEFT JOIN beats b ON b.k = p.k AND b.a = p.o[p.i + 1] AND b.b = p.o[p.i] WHERE p.i < len(p.o) OR p.moved),
ke AS (SELECT k, unnest(o) AS item, unnest(range(1, len(o) + 1)) AS kemeny_rank FROM (SELECT k, arg_max(o, step) AS o FROM pass GROUP BY k))"""


def with_kemeny(select: str) -> str:
    return f"WITH RECURSIVE {_SCORES}{_KEMENY}\n{select}"


@query(with_kemeny("SELECT k, item, kemeny_rank FROM ke"))
def kemeny(spark, d):
    return ranking.kemeny(scores(spark, d))


@query(with_scores("SELECT k, item FROM sc GROUP BY ALL HAVING count(*) = 4 AND min(value) FILTER (criterion = 'n') >= 10"))
def admissible_runs(spark, d):
    runs = scores(spark, d).groupBy("k", "item").pivot("criterion", ["q", "c", "e", "n"]).agg(F.first("value"))
    runs = runs.withColumn("min_share", F.col("n") / 1000).withColumn("clusters", F.lit(2))
    return ranking.admissible(runs, ["q", "c", "e", "n"], 0.01).select("k", "item")


def _runs(spark, d) -> DataFrame:
    """Made-up index values of runs on graphs, from hashes of nothing but numbers."""
    base = spark.range(0, 8 * 7 * 3 * 2)
    methods, rules = ["kmeans", "gmm", "ward", "spectral", "leiden", "attributed_spectral", "sefnac", "dmon"], ["cosine", "residual_corr", "lagged_corr", "dtw", "road", "hybrid", "multiplex"]
    pick = lambda names, c: F.element_at(F.array(*[F.lit(n) for n in names]), (c + 1).cast("int"))
    i = F.col("id")
    rows = base.select(pick(methods, i % 8).alias("method"), pick(rules, F.floor(i / 8) % 7).alias("graph"), (F.floor(i / 56) % 3 + 4).cast("int").alias("k"), pick(["AVI", "MQ"], F.floor(i / 168)).alias("index"), (i * 7919 % 1000 / 1000).alias("value"))
    own = F.when(F.col("method").isin("kmeans", "gmm", "ward"), "-").otherwise("cosine")
    return rows.withColumn("rule", own)


_RUNS = """runs AS (SELECT ['kmeans', 'gmm', 'ward', 'spectral', 'leiden', 'attributed_spectral', 'sefnac', 'dmon'][(id % 8 + 1)::INT] AS method,
['cosine', 'residual_corr', 'lagged_corr', 'dtw', 'road', 'hybrid', 'multiplex'][(id // 8 % 7 + 1)::INT] AS graph, (id // 56 % 3 + 4)::INT AS k, ['AVI', 'MQ'][(id // 168 + 1)::INT] AS index, (id * 7919 % 1000) / 1000.0::DOUBLE AS value FROM (SELECT unnest(range(0, 336)) AS id))"""


@query(f"WITH {_RUNS} SELECT method, CASE WHEN method IN ('kmeans', 'gmm', 'ward') THEN '-' ELSE 'cosine' END AS rule, k, index, round(avg(value) FILTER (graph NOT IN ('cosine', 'hybrid', 'multiplex')), 6) AS value FROM runs GROUP BY ALL")
def fair_index_mean(spark, d):
    return r6(ranking.fair_means(_runs(spark, d)))


@query(f"WITH {_RUNS} SELECT method, graph AS key, k, index, value, rank FROM (SELECT *, rank() OVER (PARTITION BY k, index ORDER BY value DESC) AS rank FROM runs) QUALIFY row_number() OVER (PARTITION BY method, k ORDER BY rank, key) = 1")
def best_run(spark, d):
    w = Window.partitionBy("k", "index").orderBy(F.desc("value"))
    runs = _runs(spark, d).select("method", F.col("graph").alias("key"), "k", "index", "value", F.rank().over(w).cast("long").alias("rank"))
    return serve.best_run(runs, "rank")


@query(f"WITH {_RUNS} SELECT graph AS key, k, value, min(value) OVER (PARTITION BY k) AS lo, max(value) OVER (PARTITION BY k) AS hi FROM runs WHERE index = 'MQ'")
def index_extent(spark, d):
    return serve.index_extent(_runs(spark, d).where(F.col("index") == "MQ").withColumnRenamed("graph", "key"), "value")


@query(f"WITH {_RUNS} SELECT method, " + ", ".join(f"min(value) FILTER (k = {k}) AS k{k}" for k in (4, 5, 6)) + " FROM runs GROUP BY method")
def rank_matrix(spark, d):
    return serve.rank_matrix(_runs(spark, d).withColumn("rank", F.col("value")), [4, 5, 6])


# ---- time ----------------------------------------------------------------------------


@query(sql("SELECT src AS id, round(coalesce(sum(w) FILTER (label = 0), 0) / sum(w), 6) + 0.0 AS f0, round(coalesce(sum(w) FILTER (label = 1), 0) / sum(w), 6) + 0.0 AS f1, round(coalesce(sum(w) FILTER (label = 2), 0) / sum(w), 6) + 0.0 AS f2 FROM pknn JOIN types ON dst = id GROUP BY src"))
def neighbour_share(spark, d):
    f = temporal.neighbour_share(profile_graph(spark, d), types(spark, d), 3)
    return r6(f.select("id", *[F.col("f")[c].alias(f"f{c}") for c in range(3)]))


@query(sql("SELECT round(tau, 6) AS tau FROM tau"))
def tau(spark, d):
    p = profile_vectors(spark, d)
    return r6(temporal.tau(p, indices.centroids(p, types(spark, d))))


@query(sql("SELECT entity, period, type::INT AS type, round(e, 5) + 0.0 AS e FROM emit"))
def emission_table(spark, d):
    return r6(emissions(spark, d).select("entity", "period", F.posexplode("e").alias("type", "e")), digits=5)


@query(sql("SELECT entity, period, type::INT AS type FROM raw"))
def raw_path(spark, d):
    return temporal.raw_path(emissions(spark, d))


def paths_text(steps: str = "tstep", p: float = 0.03, n: str = "") -> str:
    """Recursive text of the hidden paths over the table ``steps``; ``n`` sets the names of its tables apart."""
    stay, move = f"ln(1 - {p})", f"ln({p} / 2)"
    text = f"""vit(entity, t, type, score) AS (
SELECT entity, 0::BIGINT, type, e FROM {steps} WHERE t = 0
UNION ALL SELECT entity, t, type, score FROM (SELECT v.entity, s.t, s.type, max(v.score + CASE WHEN v.type = s.type THEN {stay} ELSE {move} END) + any_value(s.e) AS score FROM vit v JOIN {steps} s ON s.entity = v.entity AND s.t = v.t + 1 GROUP BY v.entity, s.t, s.type)),
back AS (SELECT s.entity, s.t, s.type, arg_max(v.type, [v.score + CASE WHEN v.type = s.type THEN {stay} ELSE {move} END, -v.type]) AS prev FROM vit v JOIN {steps} s ON s.entity = v.entity AND s.t = v.t + 1 GROUP BY ALL),
walk(entity, t, type) AS (SELECT entity, t, arg_max(type, [score, -type]) FROM vit WHERE t = (SELECT max(t) FROM {steps}) GROUP BY entity, t
UNION ALL SELECT w.entity, w.t - 1, b.prev FROM walk w JOIN back b ON b.entity = w.entity AND b.t = w.t AND b.type = w.type),
path AS (SELECT w.entity, w.t, p.period, w.type FROM walk w JOIN (SELECT DISTINCT t, period FROM {steps}) p USING (t))"""
    return re.sub(r"\b(vit|back|walk|path)\b", rf"\1{n}", text) if n else text


_VITERBI = paths_text()


@query(sql("SELECT entity, period, type::INT AS type FROM path", _VITERBI))
def viterbi(spark, d):
    return path(spark, d)


@query(sql("SELECT entity, round(max(score), 5) AS score FROM vit WHERE t = (SELECT max(t) FROM tstep) GROUP BY entity", _VITERBI))
def viterbi_score(spark, d):
    return r6(temporal.viterbi_score(emissions(spark, d), 0.03), digits=5)


_RAW_T = "rt AS (SELECT entity, type, period, row_number() OVER w - 1 AS t, lag(type) OVER w AS b FROM raw WINDOW w AS (PARTITION BY entity ORDER BY period)), ch AS (SELECT entity, arg_min(type, t) AS f, arg_max(type, t) AS l, max(t) FILTER (type <> b) AS t, count(*) FILTER (type <> b) AS s, count(*) AS n FROM rt GROUP BY entity)"


@query(sql('SELECT entity, f::INT AS "from", l::INT AS "to", t::INT AS t, s::BIGINT AS switches FROM ch WHERE s >= 1 AND n - t >= 2', _RAW_T))
def persistent_changes(spark, d):
    return temporal.persistent_changes(temporal.raw_path(emissions(spark, d)), 2).withColumn("t", F.col("t").cast("int"))


@query(sql("SELECT entity, min(type)::INT AS type, any_value(label) AS label FROM raw JOIN types ON id = entity GROUP BY entity HAVING min(type) = max(type) AND min(type) <> any_value(label)"))
def boundary(spark, d):
    return temporal.boundary(temporal.raw_path(emissions(spark, d)), types(spark, d))


@query(sql("SELECT entity, period, (CASE WHEN entity IN (SELECT entity FROM ch WHERE s >= 1 AND n - t >= 2) THEN type ELSE label END)::BIGINT AS type FROM raw JOIN types ON id = entity", _RAW_T))
def display_types(spark, d):
    raw = temporal.raw_path(emissions(spark, d))
    out = temporal.display_types(raw, types(spark, d), temporal.persistent_changes(raw, 2))
    return out.withColumn("type", F.col("type").cast("long"))


@query(sql("SELECT round((SELECT avg((type <> b)::INT) FROM rt WHERE b IS NOT NULL), 6) AS switch_rate, round((SELECT avg(m) FROM (SELECT max((type <> label)::INT) AS m FROM rt JOIN types ON id = entity GROUP BY entity)), 6) AS ever_changed, round((SELECT avg((type <> label)::INT) FROM rt JOIN types ON id = entity), 6) AS off_type_share", _RAW_T))
def switch_stats(spark, d):
    return r6(temporal.switch_stats(temporal.raw_path(emissions(spark, d)), types(spark, d)))


# a sample is a set of entities of its own: entity and sample make up the key
_NULL = """perm AS (SELECT sample, t, row_number() OVER (PARTITION BY sample ORDER BY md5('0:' || sample || ':' || (t // 3)), t) - 1 AS nt FROM (SELECT DISTINCT t FROM tstep), (SELECT unnest(range(0, 50)) AS sample)),
pstep AS MATERIALIZED (SELECT sample * 1000000 + entity AS entity, nt::VARCHAR AS period, nt AS t, type, e FROM tstep JOIN perm USING (t)),
""" + paths_text("pstep", 0.03, "_p") + """,
runs_p AS (SELECT entity, max(t) FILTER (type <> b) AS t, count(*) AS n FROM (SELECT entity, t, type, lag(type) OVER (PARTITION BY entity ORDER BY t) AS b FROM walk_p) GROUP BY entity),
null_p AS (SELECT sample::INT AS sample, count(*) FILTER (entity // 1000000 = sample AND n - t >= 6) AS changes FROM runs_p, (SELECT unnest(range(0, 50)) AS sample) GROUP BY sample)"""


@query(sql("SELECT sample, changes FROM null_p", _NULL))
def block_null(spark, d):
    return temporal.block_null(emissions(spark, d))


@query(sql("SELECT round(avg((changes >= (SELECT count(*) FROM (SELECT entity, max(t) FILTER (type <> b) AS t, count(*) AS n FROM (SELECT entity, t, type, lag(type) OVER (PARTITION BY entity ORDER BY t) AS b FROM walk) GROUP BY entity) WHERE n - t >= 6))::INT), 6) AS p FROM null_p", _NULL + ",\n" + _VITERBI))
def null_pvalue(spark, d):
    e = emissions(spark, d)
    seen = temporal.persistent_changes(temporal.viterbi(e)).agg(F.count(F.lit(1)).alias("changes"))
    return r6(temporal.null_p_value(temporal.block_null(e), seen))


@query(sql("""SELECT "lambda", round(avg((best = label)::INT), 6) AS agreement FROM (
SELECT "lambda", d2.id, any_value(t.label) AS label, arg_max(d2.label, [-d / (SELECT tau FROM tau) + "lambda" * coalesce(f, 0), -d2.label]) AS best
FROM d2 JOIN types t ON t.id = d2.id JOIN (SELECT src, sum(w) AS tot FROM pknn GROUP BY src) g ON g.src = d2.id
LEFT JOIN (SELECT src, label, sum(w) / any_value(tot) AS f FROM pknn JOIN types ON dst = id JOIN (SELECT src, sum(w) AS tot FROM pknn GROUP BY src) USING (src) GROUP BY ALL) s ON s.src = d2.id AND s.label = d2.label,
(SELECT unnest(range(0, 41)) / 4.0::DOUBLE AS "lambda") GROUP BY ALL) GROUP BY "lambda" ORDER BY agreement DESC, "lambda" LIMIT 1"""))
def lambda_fit(spark, d):
    p = profile_vectors(spark, d)
    centres = indices.centroids(p, types(spark, d))
    own = temporal.emissions(p.select(F.col("id").alias("entity"), F.lit("-").alias("period"), "x"), centres, temporal.tau(p, centres).first()[0] or 1.0).select(F.col("entity").alias("id"), "e")
    share = temporal.neighbour_share(profile_graph(spark, d), types(spark, d), 3)
    return r6(temporal.lambda_fit(own, share, types(spark, d), [x / 4 for x in range(41)]))


_SLICES = "sl AS (SELECT dense_rank() OVER (ORDER BY period)::BIGINT AS t, entity AS id, type AS label FROM raw), sz AS (SELECT t, label, count(*) AS n FROM sl GROUP BY ALL), lk AS (SELECT a.t, a.label AS a, b.label AS b, count(*)::DOUBLE / (any_value(x.n) + any_value(y.n) - count(*)) AS j, any_value(x.n) AS na, any_value(y.n) AS nb FROM sl a JOIN sl b ON a.id = b.id AND b.t = a.t + 1 JOIN sz x ON x.t = a.t AND x.label = a.label JOIN sz y ON y.t = b.t AND y.label = b.label GROUP BY ALL), li AS (SELECT *, count(*) OVER (PARTITION BY t, a) AS o, count(*) OVER (PARTITION BY t, b) AS i FROM lk WHERE j >= 0.3)"


@query(sql("""SELECT t + 1 AS t, 'dissolution' AS event, label AS "from", NULL::BIGINT AS "to", n AS size, NULL::DOUBLE AS jaccard FROM sz WHERE t < (SELECT max(t) FROM sz) AND (t, label) NOT IN (SELECT (t, a) FROM li)
UNION ALL SELECT DISTINCT t + 1, 'split', a, NULL, na, NULL FROM li WHERE o > 1
UNION ALL SELECT t, 'birth', NULL, label, n, NULL FROM sz WHERE t > 1 AND (t - 1, label) NOT IN (SELECT (t, b) FROM li)
UNION ALL SELECT DISTINCT t + 1, 'merge', NULL, b, nb, NULL FROM li WHERE i > 1
UNION ALL SELECT t + 1, 'continuation', a, b, nb, round(j, 6) FROM li WHERE o = 1 AND i = 1""", _SLICES))
def lifecycle_events(spark, d):
    raw = temporal.raw_path(emissions(spark, d))
    t = raw.select("period").distinct().withColumn("t", F.row_number().over(Window.orderBy("period")).cast("long"))
    return r6(temporal.lifecycle_events(raw.join(F.broadcast(t), "period").select("t", F.col("entity").alias("id"), F.col("type").cast("long").alias("label"))))


@query(sql("""SELECT period, np AS next_period, f AS "from", g AS "to", count(*) AS n, list(entity ORDER BY entity) AS entities FROM (SELECT entity, period, type::INT AS f, lead(period) OVER w AS np, lead(type) OVER w::INT AS g FROM raw WHERE substr(period, 6, 2) IN ('03', '06', '09', '12') WINDOW w AS (PARTITION BY entity ORDER BY period)) WHERE np IS NOT NULL GROUP BY ALL"""))
def flows(spark, d):
    return temporal.flows(temporal.raw_path(emissions(spark, d)))


@query(sql("""SELECT period, round(CASE WHEN ha + hb = 0 THEN 1 ELSE greatest(mi, 0) / ((ha + hb) / 2) END, 6) + 0.0 AS "NMI" FROM (SELECT period, sum(n / tot * ln(n * tot / (na * nb))) AS mi FROM pt GROUP BY period)
JOIN (SELECT period, -sum(na / tot * ln(na / tot)) AS ha FROM (SELECT DISTINCT period, la, na, tot FROM pt) GROUP BY period) USING (period)
JOIN (SELECT period, -sum(nb / tot * ln(nb / tot)) AS hb FROM (SELECT DISTINCT period, lb, nb, tot FROM pt) GROUP BY period) USING (period)""",
  "pc AS (SELECT period, label AS la, type AS lb, count(*)::DOUBLE AS n FROM raw JOIN types ON id = entity GROUP BY ALL), pt AS (SELECT *, sum(n) OVER (PARTITION BY period, la) AS na, sum(n) OVER (PARTITION BY period, lb) AS nb, sum(n) OVER (PARTITION BY period) AS tot FROM pc)"))
def slice_nmi(spark, d):
    raw, lab = temporal.raw_path(emissions(spark, d)), types(spark, d)
    both = raw.select(F.col("entity").alias("id"), "period", F.col("type").cast("long").alias("lb")).join(lab.select("id", F.col("label").alias("la")), "id")
    return r6(indices.mutual_information_by(both, "period"))


@query(sql("SELECT entity, array_to_string(list(type::VARCHAR ORDER BY period), '-') AS path FROM raw GROUP BY entity"))
def joined_labels(spark, d):
    return relational.joined_labels(temporal.raw_path(emissions(spark, d)), "type")


# ---- concepts and statistics ---------------------------------------------------------

_NUM = ("p_size", "p_retailprice")
_CTX = ", ".join(f"{c} {'>=' if w == 'ge' else '<='} (SELECT quantile_cont({c}, {q}) FROM part) AS {c}_{w}_{round(q * 100)}" for c in _NUM for w, q in concepts.THRESHOLDS)
_CTXSQL = f"SELECT p_partkey AS id, {_CTX} FROM part"


def part_context(spark, d) -> DataFrame:
    p = source.scan(spark, d, "part").select("p_partkey", *[F.col(c).cast("double").alias(c) for c in _NUM])
    return concepts.context(p, list(_NUM), "p_partkey")


@query(_CTXSQL)
def formal_context(spark, d):
    return part_context(spark, d)


@query(f"SELECT id FROM ({_CTXSQL}) WHERE p_size_ge_75 AND p_retailprice_le_25")
def concept_extent(spark, d):
    return concepts.extent(part_context(spark, d), ["p_size_ge_75", "p_retailprice_le_25"])


_ALL = [f"{c}_{w}_{round(q * 100)}" for c in _NUM for w, q in concepts.THRESHOLDS]


@query("WITH c AS (" + _CTXSQL + ") " + " UNION ALL ".join(f"SELECT '{a}' AS attr FROM c WHERE p_size_ge_75 AND p_retailprice_le_25 HAVING bool_and({a})" for a in _ALL))
def concept_intent(spark, d):
    ctx = part_context(spark, d)
    return concepts.intent(ctx, concepts.extent(ctx, ["p_size_ge_75", "p_retailprice_le_25"]))


@query("WITH c AS (" + _CTXSQL + ") SELECT n AS extent, min(n - h) AS delta FROM (" + " UNION ALL ".join(f"SELECT count(*) AS n, count(*) FILTER ({a}) AS h FROM c WHERE p_size_ge_75" for a in _ALL) + ") WHERE h < n GROUP BY n")
def delta_stability(spark, d):
    return concepts.delta_stability(part_context(spark, d), ["p_size_ge_75"])


_SETS = """c AS MATERIALIZED (SELECT x.*, (p_size > 25)::BIGINT AS label FROM (CONTEXT) x JOIN part ON p_partkey = id),
long AS MATERIALIZED (SELECT id, label, unnest(range(0, ATTRS)) AS a, unnest([NAMES]) AS has FROM c),
sets AS (SELECT [a] AS s FROM (SELECT unnest(range(0, ATTRS)) AS a) UNION ALL SELECT [a, b] FROM (SELECT unnest(range(0, ATTRS)) AS a), (SELECT unnest(range(0, ATTRS)) AS b) WHERE a < b
UNION ALL SELECT [a, b, e] FROM (SELECT unnest(range(0, ATTRS)) AS a), (SELECT unnest(range(0, ATTRS)) AS b), (SELECT unnest(range(0, ATTRS)) AS e) WHERE a < b AND b < e),
inside AS (SELECT s, id, label FROM sets JOIN (SELECT id, any_value(label) AS label, list(a ORDER BY a) FILTER (has) AS own FROM long GROUP BY id) ON list_has_all(own, s)),
ext AS (SELECT s, count(*) AS n FROM inside GROUP BY s), hit AS (SELECT s, label, count(*) AS h FROM inside GROUP BY ALL), total AS (SELECT label, count(*) AS m FROM c GROUP BY label),
judged AS (SELECT s, label, n, h / n::DOUBLE AS p, h / m::DOUBLE AS r FROM hit JOIN ext USING (s) JOIN total USING (label)),
chosen AS (SELECT *, 2 * p * r / (p + r) AS f1 FROM judged WHERE n >= 10 AND p >= 0.5 QUALIFY row_number() OVER (PARTITION BY label ORDER BY round(2 * p * r / (p + r), 12) DESC, len(s), s) = 1),
held AS (SELECT k.label, l.a, count(*) FILTER (l.has) AS w, any_value(k.n) AS n FROM chosen k JOIN inside i ON i.s = k.s JOIN long l ON l.id = i.id GROUP BY ALL)""".replace("CONTEXT", _CTXSQL).replace("ATTRS", str(len(_ALL))).replace("NAMES", ", ".join(_ALL))


@query(f"""WITH {_SETS} SELECT label, list_transform(s, lambda a: [{", ".join(f"'{a}'" for a in _ALL)}][a + 1]) AS generator,
(SELECT coalesce(list([{", ".join(f"'{a}'" for a in _ALL)}][a + 1] ORDER BY a), []) FROM held h WHERE h.label = k.label AND w = n) AS closure,
n AS extent, round(p, 6) AS precision, round(r, 6) AS recall, round(f1, 6) AS f1, coalesce((SELECT min(h.n - w) FROM held h WHERE h.label = k.label AND w < h.n), n) AS delta FROM chosen k""")
def describe_types(spark, d):
    lab = source.scan(spark, d, "part").select(F.col("p_partkey").alias("id"), (F.col("p_size") > 25).cast("long").alias("label"))
    return r6(concepts.describe_types(part_context(spark, d), lab))


_X2 = "SELECT a, b, na, nb, tot, coalesce(n, 0) AS n FROM (SELECT lang AS a, count(*)::DOUBLE AS na FROM dl GROUP BY 1) CROSS JOIN (SELECT source AS b, count(*)::DOUBLE AS nb FROM dl GROUP BY 1) CROSS JOIN (SELECT count(*)::DOUBLE AS tot FROM dl) LEFT JOIN (SELECT lang AS a, source AS b, count(*)::DOUBLE AS n FROM dl GROUP BY ALL) USING (a, b)"


@query(f"""WITH dl AS (SELECT lang, source FROM documents), x AS ({_X2}), y AS (SELECT sum(power(n - na * nb / tot, 2) / (na * nb / tot)) AS chi2, any_value(tot) AS tot, count(DISTINCT a) AS r, count(DISTINCT b) AS c FROM x) SELECT round(chi2, 6) AS chi2, (r - 1) * (c - 1) AS dof, round(sqrt(chi2 / (tot * (least(r, c) - 1))), 6) AS "V" FROM y""")
def cramers_v(spark, d):
    return r6(stats.cramers_v(source.scan(spark, d, "documents"), "lang", "source"))


@query("SELECT round((SELECT sum(n * power(m - g, 2)) FROM (SELECT c_mktsegment, count(*) AS n, avg(c_acctbal) AS m FROM customer GROUP BY 1), (SELECT avg(c_acctbal) AS g FROM customer)) / (SELECT var_pop(c_acctbal) * count(*) FROM customer), 6) AS eta2")
def eta_squared(spark, d):
    return r6(stats.eta_squared(source.scan(spark, d, "customer"), "c_acctbal", "c_mktsegment"))


@query("""WITH r AS (SELECT p_brand, p_size, rank() OVER (ORDER BY p_size) + (count(*) OVER (PARTITION BY p_size) - 1) / 2.0::DOUBLE AS r FROM part), g AS (SELECT sum(s * s / n) AS q, count(*) - 1 AS dof FROM (SELECT p_brand, sum(r) AS s, count(*) AS n FROM r GROUP BY 1)), c AS (SELECT count(*)::DOUBLE AS N FROM part), t AS (SELECT sum(power(n, 3) - n) AS t FROM (SELECT count(*)::DOUBLE AS n FROM part GROUP BY p_size))
SELECT round((12 / (N * (N + 1)) * q - 3 * (N + 1)) / (1 - t / (N * N * N - N)), 6) AS "H", dof FROM g, c, t""")
def kruskal_wallis(spark, d):
    return r6(stats.kruskal_wallis(source.scan(spark, d, "part"), "p_size", "p_brand"))


@query()
def validation_table(spark, d):
    return r6(stats.validation_table(source.scan(spark, d, "part"), "p_brand", ["p_size", "p_retailprice"], ["p_type"]))


@query(sql("SELECT round(avg((a.label = b.label)::INT), 6) AS observed FROM eknn JOIN elabel a ON src = a.id JOIN elabel b ON dst = b.id WHERE src < dst"))
def join_count_observed(spark, d):
    return r6(stats.same_label_share(vector_graph(spark, d), vector_labels(spark, d)))


@query(sql("SELECT round(o, 6) AS observed, round(m, 6) AS expected, round((o - m) / sd, 6) AS z FROM (SELECT avg((a.label = b.label)::INT) AS o FROM pknn JOIN types a ON src = a.id JOIN types b ON dst = b.id WHERE src < dst), (SELECT avg(v) AS m, stddev_pop(v) AS sd FROM drawn)",
  """smp AS (SELECT unnest(range(0, 200)) AS s), spot AS (SELECT s, id, row_number() OVER (PARTITION BY s ORDER BY id) AS n FROM types, smp),
mixed AS (SELECT s, label, row_number() OVER (PARTITION BY s ORDER BY md5('0:' || s || ':' || id), id) AS n FROM types, smp), put AS (SELECT s, id, label FROM spot JOIN mixed USING (s, n)),
drawn AS (SELECT a.s, avg((a.label = b.label)::INT) AS v FROM pknn JOIN put a ON src = a.id JOIN put b ON dst = b.id AND b.s = a.s WHERE src < dst GROUP BY a.s)"""))
def join_count(spark, d):
    return r6(stats.join_count(profile_graph(spark, d), types(spark, d)))


@query("SELECT count(*) AS regions, count(*) FILTER (n > 1) AS mixed, round(avg(n), 6) AS mean_types FROM (SELECT n_regionkey, count(DISTINCT c_mktsegment) AS n FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY 1)")
def within_region(spark, d):
    c = source.scan(spark, d, "customer").join(source.scan(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return r6(stats.within_region(c, "n_regionkey", "c_mktsegment"))


# ---- serving -------------------------------------------------------------------------


@query("""SELECT p_partkey, p_name, "at" FROM (SELECT p_partkey, p_name, instr(lower(p_name), 'ri') AS "at" FROM part) WHERE "at" > 0 ORDER BY "at", length(p_name), p_name, p_partkey LIMIT 12""")
def search(spark, d):
    return serve.search(source.scan(spark, d, "part").select("p_partkey", "p_name"), F.col("p_name"), " RI", tie="p_partkey")


@query(sql('SELECT f::INT AS "from", l::INT AS "to", count(*) AS n FROM ch WHERE s >= 1 AND n - t >= 2 GROUP BY ALL', _RAW_T))
def movers(spark, d):
    return serve.mover_pairs(temporal.persistent_changes(temporal.raw_path(emissions(spark, d)), 2))


_SHARE_MEAN = "SELECT entity AS id, label, " + ", ".join(f"avg({c}) AS {c}" for c in SHARES) + " FROM shares JOIN types ON id = entity GROUP BY ALL"


def share_means(spark: SparkSession, d: str) -> DataFrame:
    m = shares(spark, d).groupBy(F.col("entity").alias("id")).agg(*[F.avg(c).alias(c) for c in SHARES])
    return m.join(types(spark, d), "id")


@query(sql("SELECT label, id, round(d, 6) AS distance, rank FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY round(d, 9), id)::INT AS rank FROM (SELECT label, id, " + " + ".join(f"abs({c} - m_{c})" for c in SHARES) + " AS d FROM sm JOIN (SELECT label, " + ", ".join(f"median({c}) AS m_{c}" for c in SHARES) + " FROM sm GROUP BY label) USING (label))) WHERE rank <= 3", f"sm AS ({_SHARE_MEAN})"))
def typical_members(spark, d):
    return r6(serve.typical_members(share_means(spark, d), list(SHARES)))


@query(sql("SELECT entity, round(m, 3) AS mean, round(m / avg(m) OVER (), 6) AS ratio FROM (SELECT entity, avg(total) AS m FROM (SELECT * FROM wide QUALIFY row_number() OVER (PARTITION BY entity ORDER BY period DESC) <= 12) GROUP BY entity)"))
def portrait(spark, d):
    return r6(r6(serve.portrait(wide(spark, d), "total"), "mean", digits=3), "ratio")


@query(sql("SELECT id, category, round(deviation, 6) + 0.0 AS deviation, rank FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY abs(deviation) DESC, category)::INT AS rank FROM (" + " UNION ALL ".join(f"SELECT id, '{c}' AS category, {c} / (SELECT avg({c}) FROM sm) - 1 AS deviation FROM sm" for c in SHARES) + ")) WHERE rank <= 2", f"sm AS ({_SHARE_MEAN})"))
def top_deviations(spark, d):
    return r6(serve.top_deviations(share_means(spark, d), list(SHARES)))


@query(sql("SELECT entity, round(avg((type = label)::INT), 6) AS stay FROM raw JOIN types ON id = entity GROUP BY entity"))
def stay_share(spark, d):
    return r6(serve.stay_share(temporal.raw_path(emissions(spark, d)), types(spark, d)))


@query(sql("SELECT category, round(va, 2) AS va, round(vb, 2) AS vb, round(va / vb, 6) AS ratio FROM (SELECT category, sum(value) AS va FROM panel WHERE entity = 1 GROUP BY 1) FULL JOIN (SELECT category, sum(value) AS vb FROM panel WHERE entity = 2 GROUP BY 1) USING (category)"))
def compare(spark, d):
    long = source.orders_panel(spark, d).groupBy("entity", "category").agg(F.sum("value").alias("value"))
    return r6(r6(serve.compare(long, 1, 2), "va", "vb", digits=2), "ratio")


@query("SELECT c_mktsegment AS label, count(*) AS n FROM customer WHERE c_acctbal BETWEEN 0 AND 5000 AND c_nationkey BETWEEN 3 AND 12 GROUP BY 1")
def box_select(spark, d):
    p = source.scan(spark, d, "customer").select(F.col("c_acctbal").alias("x"), F.col("c_nationkey").cast("double").alias("y"), F.col("c_mktsegment").alias("label"))
    return serve.box(p, (0, 5000), (3, 12)).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query(sql("""SELECT a.entity, b.type::INT AS "from", a.type::INT AS "to" FROM raw a JOIN raw b USING (entity) WHERE a.period = '2000-06' AND b.period = '2000-03' AND a.type <> b.type"""))
def month_changes(spark, d):
    return serve.month_changes(temporal.raw_path(emissions(spark, d)), "2000-06", "2000-03")


@query("SELECT c_custkey AS id, round(sqrt(power(c_acctbal - 1000, 2) + power(c_nationkey - 5, 2)), 6) AS distance FROM customer ORDER BY 2, 1 LIMIT 1")
def nearest_point(spark, d):
    p = source.scan(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("x"), F.col("c_nationkey").cast("double").alias("y"))
    return r6(serve.nearest_point(p, 1000.0, 5.0))


@query(sql('SELECT src AS id, count(*) AS degree, count(*) FILTER (a.label <> b.label) AS "cross" FROM eknn JOIN elabel a ON src = a.id JOIN elabel b ON dst = b.id GROUP BY src'))
def cross_degree(spark, d):
    return serve.cross_degree(vector_graph(spark, d), vector_labels(spark, d))


@query("WITH e AS (SELECT min(p_retailprice) AS a, max(p_retailprice) AS b FROM part) SELECT bin::INT AS bin, round(a + bin * (b - a) / 12, 6) AS lo, round(a + (bin + 1) * (b - a) / 12, 6) AS hi, coalesce(n, 0) AS n FROM (SELECT * FROM (SELECT unnest(range(0, 12)) AS bin), e) LEFT JOIN (SELECT least(11, floor((p_retailprice - a) / ((b - a) / 12)))::BIGINT AS bin, count(*) AS n FROM part, e GROUP BY 1) USING (bin)")
def histogram(spark, d):
    return r6(serve.histogram(source.scan(spark, d, "part"), "p_retailprice"))


@query("SELECT c_mktsegment AS label, count(*) AS n, round(median(c_acctbal), 6) AS x, round(median(c_nationkey), 6) AS y FROM customer GROUP BY 1")
def label_places(spark, d):
    p = source.scan(spark, d, "customer").select(F.col("c_mktsegment").alias("label"), F.col("c_acctbal").alias("x"), F.col("c_nationkey").alias("y"))
    return r6(serve.label_places(p))


@query(sql("SELECT id, category, round(greatest(0.2, share / ref), 6) AS r FROM (" + " UNION ALL ".join(f"SELECT id, '{c}' AS category, {c} AS share, (SELECT avg({c}) FROM sm) AS ref FROM sm" for c in SHARES) + ")", f"sm AS ({_SHARE_MEAN})"))
def radial(spark, d):
    m = share_means(spark, d).drop("label").unpivot("id", list(SHARES), "category", "share")
    return r6(serve.radial(m, m.groupBy("category").agg(F.avg("share").alias("share"))))


@query(sql("SELECT label, " + ", ".join(f"round(median({c}) / (SELECT avg({c}) FROM sm) - 1, 6) + 0.0 AS {c}" for c in SHARES) + ", round(exp(avg(l)) - 1, 6) + 0.0 AS level FROM sm JOIN (SELECT entity AS id, avg(level) AS l FROM level GROUP BY 1) USING (id) GROUP BY label", f"sm AS ({_SHARE_MEAN})"))
def type_profile(spark, d):
    lev = features.level(shares(spark, d)).groupBy(F.col("entity").alias("id")).agg(F.avg("level").alias("level"))
    return r6(serve.type_profile(share_means(spark, d).join(lev, "id"), list(SHARES), "level"))


@query(sql("SELECT src, dst, round(w, 6) + 0.0 AS w FROM pknn WHERE src < dst"))
def flat_edges(spark, d):
    return r6(source.flat_edges(profile_graph(spark, d)))


@query("SELECT c_custkey, round(CASE WHEN c_nationkey = 0 THEN NULL ELSE c_acctbal / c_nationkey END, 8) AS v FROM customer")
def finite_records(spark, d):
    c = source.scan(spark, d, "customer").select("c_custkey", F.when(F.col("c_nationkey") == 0, F.lit(float("inf"))).otherwise(F.col("c_acctbal") / F.nullif("c_nationkey", F.lit(0))).alias("v"))
    return source.records(c, ["c_custkey", "v"], 8)


# ---- clustering (labels are defined up to names: rows only, tests judge recovery) -----


def _job(spark, method: str, rule: str, k: int) -> DataFrame:
    return spark.createDataFrame([(f"{method}|{rule}|{k}", 0, method, rule, k, 1, 1.0)], "key string, draw int, method string, rule string, k int, seed int, fraction double")


def _clustered(method: str, rule: str = "-", k: int = 3):
    def f(spark: SparkSession, d: str) -> DataFrame:
        g = {} if rule == "-" else {rule: profile_graph(spark, d)}
        return cluster.run(_job(spark, method, rule, k), profile_vectors(spark, d), g).select("key", "id", "label")

    f.__name__ = method
    return f


for _m in ("ward", "spectral", "leiden", "attributed_spectral", "sefnac", "dmon"):
    QUERIES[_m] = _clustered(_m, "-" if _m == "ward" else "cosine")


@query()
def kmeans(spark, d):
    return cluster.distributed_kmeans(vectors(spark, d), 5, 20)


@query()
def gmm(spark, d):
    return cluster.distributed_gmm(profile_vectors(spark, d), 2, 3)


def rule_graphs(spark, d) -> dict[str, DataFrame]:
    """The graph of every rule over the whole series, on the entities with a profile."""
    x, roads = profile_vectors(spark, d), source.road_edges(spark, d)
    out = {}
    for rule in RULE_SOURCES:
        e = graphs.build(rule, x, residuals(spark, d), roads, list(RESID), "9999-99", EVERY, CFG)
        out[rule] = e.join(x.select(F.col("id").alias("src")), "src", "left_semi").join(x.select(F.col("id").alias("dst")), "dst", "left_semi").select("src", "dst", "w")
    return out


@shared
def grid_labels(spark: SparkSession, d: str) -> DataFrame:
    """Every method on every rule for 4 to 12 types: 342 runs."""
    from veldt.plans.experiments import jobs

    plain = [m for m, f in FAMILIES.items() if f == "features"]
    j = jobs(spark, plain, [m for m in FAMILIES if m not in plain], RULE_SOURCES, range(4, 13))
    return cluster.run(j, profile_vectors(spark, d), rule_graphs(spark, d))


@query()
def grid(spark, d):
    return grid_labels(spark, d).select("key", "id", "label")


@query()
def stability(spark, d):
    from veldt.plans.experiments import stability as measure

    return r6(measure(profile_vectors(spark, d), {"cosine": profile_graph(spark, d)}, "attributed_spectral", "cosine", 3))


@query()
def ablation(spark, d):
    from veldt.plans.experiments import ablation as measure

    market = source.scan(spark, d, "supplier").groupBy(F.col("s_nationkey").cast("long").alias("entity")).agg(F.sum("s_acctbal").alias("market_access"))
    return r6(measure(wide(spark, d), list(CFG.categories), market, rule_graphs(spark, d)["residual_corr"], types(spark, d), 3))


@query()
def multislice(spark, d):
    from veldt.plans.experiments import multislice as measure

    x = features.as_vectors(panel_features(spark, d), ["entity", "period"])
    return measure(x, 5, 0.2, 1.0)


assert set(HIGHER_IS_BETTER) == {"SW", "CH", "S_Dbw", "AVI", "AVU", "MQ"}

"""Registered queries that chain operators: indices of runs, candidates, sensitivity, network emissions, registers, serving.

As in :mod:`veldt.plans.queries`, whose tables they start from, each has its DuckDB text where
SQL can say it. Importing this module registers them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veldt.operators import cluster, external, features, graphs, indices, ranking, relational, serve, temporal
from veldt.operators.pairs import cosine, top_k
from veldt.plans import experiments
from veldt.plans.queries import (
    _NULL, _RAW_T, _RUNS, CFG, ORACLE, _runs, closed, emissions, grid_labels, panel_features, paths_text, profile_graph, profile_vectors, query, r6, regions, rule_graphs, scores, series_z,
    shared, shares, types, vectors, with_kemeny,
)
from veldt.plans.config import FAMILIES, RULE_SOURCES
from veldt.plans.sqltext import CATS, CTES, sql
from veldt.sources import panel as source
from veldt.sources.staging import materialised

# ---- panel -----------------------------------------------------------------------------

_STRICT = "SELECT entity, period, " + ", ".join(f"avg(value) FILTER (category = '{c.upper()}') AS {c}" for c in CATS) + ", sum(value) AS total FROM panel GROUP BY ALL"
_STRICT = f"st0 AS ({_STRICT}), st1 AS (SELECT * FROM st0 WHERE period < (SELECT max(period) FROM st0)), strict AS (SELECT * FROM st1 WHERE entity IN (SELECT entity FROM st1 GROUP BY entity HAVING count(DISTINCT period) >= 78) AND " + " AND ".join(f"{c} IS NOT NULL" for c in CATS) + ")"


def strict(spark, d) -> DataFrame:
    return features.strict_panel(closed(spark, d), list(CFG.categories), 78)


@query(sql("SELECT entity, period, " + ", ".join(f"round({c}, 4) AS {c}" for c in (*CATS, "total")) + " FROM strict", _STRICT))
def strict_panel(spark, d):
    return r6(strict(spark, d), digits=4)


@query(sql("SELECT entity, period, " + ", ".join(f"round({c} / (automobile + building + furniture + household), 6) AS {c}" for c in CATS) + " FROM strict", _STRICT))
def strict_shares(spark, d):
    all_ = F.col("automobile") + F.col("building") + F.col("furniture") + F.col("household")
    return r6(strict(spark, d).select("entity", "period", *[(F.col(c) / all_).alias(c) for c in CATS]))


# ---- indices of runs, ranking, candidates ----------------------------------------------

_ON = {"types": "SELECT p.id, p.x, t.label FROM pvec p JOIN types t ON p.id = t.id", "region": "SELECT p.id, p.x, n.n_regionkey::BIGINT AS label FROM pvec p JOIN nation n ON p.id = n.n_nationkey"}


def _on(name: str, key: str, graph: str = "pknn") -> str:
    """The text of an index on embeddings, of one run on the panel instead."""
    edges = sql(f"SELECT e.src, e.dst, e.w FROM {graph} e JOIN pvec a ON a.id = e.src JOIN pvec b ON b.id = e.dst")
    return ORACLE[name].replace(CTES["evec"], sql(_ON[key])).replace(CTES["elabel"], sql(f"SELECT id, label FROM ({_ON[key]})")).replace(CTES["eknn"], edges)


_RUN_ROWS = [f"SELECT '{k}' AS key, '{i}' AS \"index\", '-' AS graph, \"{i}\" AS value FROM ({_on(q, k)})" for k in _ON for q, i in (("silhouette", "SW"), ("calinski_harabasz", "CH"), ("s_dbw", "S_Dbw"))]
_RUN_ROWS += [f"SELECT '{k}', '{i}', '{g}', \"{i}\" FROM ({_on('avi_avu', k, t)})" for k in _ON for g, t in (("cosine", "pknn"), ("road", "rknn")) for i in ("AVI", "AVU", "MQ")]


@query(" UNION ALL ".join(_RUN_ROWS))
def run_indices(spark, d):
    x = profile_vectors(spark, d)
    lab = types(spark, d).select(F.lit("types").alias("key"), "id", F.col("label").cast("long").alias("label"))
    lab = materialised(lab.union(regions(spark, d).select(F.lit("region"), "id", F.col("g").cast("long"))).join(x.select("id"), "id", "left_semi").select("key", "id", "label"), "runs")
    road = graphs.build("road", None, None, source.road_edges(spark, d), [], "", 0, CFG)
    ends = x.select(F.col("id").alias("src")), x.select(F.col("id").alias("dst"))
    return r6(experiments.run_indices(lab, x, {"cosine": profile_graph(spark, d), "road": road.join(ends[0], "src").join(ends[1], "dst").select("src", "dst", "w")}, ["types", "region"]))


@query(" UNION ALL ".join(_RUN_ROWS))
def grid_indices(spark, d):
    x = profile_vectors(spark, d)
    lab = types(spark, d).select(F.lit("types").alias("key"), "id", F.col("label").cast("long").alias("label"))
    lab = lab.union(regions(spark, d).select(F.lit("region"), "id", F.col("g").cast("long"))).join(x.select("id"), "id", "left_semi")
    road = graphs.build("road", None, None, source.road_edges(spark, d), [], "", 0, CFG)
    return r6(experiments.grid_indices(lab, x, {"cosine": profile_graph(spark, d), "road": road}).where("index not in ('clusters', 'min_share')"))


@shared
def grid_values(spark, d) -> DataFrame:
    return experiments.grid_indices(grid_labels(spark, d), profile_vectors(spark, d), rule_graphs(spark, d))


@shared
def grid_ranks(spark, d) -> DataFrame:
    return experiments.ranked_runs(grid_values(spark, d), CFG.min_share)


@query()
def grid_ranking(spark, d):
    """The whole chain: 342 runs, their indices, fair means, admissible runs, ranks within k."""
    return r6(grid_ranks(spark, d))


@query()
def grid_ranking_vectors(spark, d):
    """The same 342 runs, indices and ranks on all vectors of the embeddings table.

    It has no series and no roads, so the seven graphs are nearest-neighbour graphs of 9 to 21 neighbours.
    """
    x = vectors(spark, d)
    near = materialised(top_k(x, 21), "ranked")
    layers = {rule: materialised(graphs.knn_graph(near.where(F.col("rank") <= 9 + 2 * i), 9 + 2 * i), "layer") for i, rule in enumerate(RULE_SOURCES)}
    plain = [m for m, family in FAMILIES.items() if family == "features"]
    runs = experiments.jobs(spark, plain, [m for m in FAMILIES if m not in plain], RULE_SOURCES, range(4, 13))
    lab = materialised(cluster.run(runs, x, layers), "runs")
    return r6(experiments.ranked_runs(experiments.grid_indices(lab, x, layers), CFG.min_share))


@query()
def grid_candidates(spark, d):
    """The final run, plain k-means and the first three of every k."""
    return ranking.candidates(grid_ranks(spark, d), "attributed_spectral|hybrid|7", 7)


@query()
def grid_cross_index(spark, d):
    """MQ of every method's best run at 7 types, on every graph."""
    values = serve.key_parts(grid_values(spark, d).where("index = 'MQ'"))
    return r6(serve.cross_index(values, grid_ranks(spark, d).select(F.col("item").alias("key"), F.col("kemeny_rank").alias("rank")), 7))


@query(with_kemeny("SELECT item, min(place)::BIGINT AS place FROM (SELECT 'Brand#4' AS item, 0 AS place UNION ALL SELECT 'kmeans|-|1', 1 UNION ALL SELECT item, k * 1000 + kemeny_rank + 2 FROM ke WHERE kemeny_rank <= 3) GROUP BY item"))
def candidates(spark, d):
    return ranking.candidates(ranking.kemeny(scores(spark, d)), "Brand#4", 1)


@query(with_kemeny("SELECT count(DISTINCT k) AS wins FROM ke WHERE item = 'Brand#4' AND kemeny_rank = 1"))
def wins(spark, d):
    return serve.wins(ranking.kemeny(scores(spark, d)), "Brand#4")


@query(f"WITH {_RUNS}, rs AS (SELECT method || '|' || graph AS key, * FROM runs), mq AS (SELECT * FROM rs WHERE index = 'MQ' AND k = 5), rk AS (SELECT key, rank() OVER (ORDER BY value DESC) AS rank FROM rs WHERE index = 'AVI' AND k = 5 AND value > 0.3) SELECT method, key, graph, value FROM mq WHERE key IN (SELECT key FROM (SELECT DISTINCT method, key FROM mq) LEFT JOIN rk USING (key) QUALIFY row_number() OVER (PARTITION BY method ORDER BY rank NULLS LAST, key) = 1)")
def cross_index(spark, d):
    runs = _runs(spark, d).withColumn("key", F.concat_ws("|", "method", "graph"))
    avi = runs.where((F.col("index") == "AVI") & (F.col("k") == 5) & (F.col("value") > 0.3)).select("key", F.rank().over(Window.partitionBy("k").orderBy(F.desc("value"))).alias("rank"))
    return serve.cross_index(runs.where(F.col("index") == "MQ"), avi, 5)


@query("SELECT k, mean, q10 FROM (SELECT 'm' || (id % 3) || '|r' || (id % 2) || '|' || id AS key, id / 10.0::DOUBLE AS mean, id / 20.0::DOUBLE AS q10, id::INT AS k FROM (SELECT r_regionkey AS id FROM region)) WHERE split_part(key, '|', 1) = 'm0' AND split_part(key, '|', 2) = 'r1'")
def stability_curve(spark, d):
    i = F.col("r_regionkey")
    key = F.concat(F.lit("m"), (i % 3).cast("string"), F.lit("|r"), (i % 2).cast("string"), F.lit("|"), i.cast("string"))
    return serve.stability_curve(source.scan(spark, d, "region").select(key.alias("key"), (i / 10).alias("mean"), (i / 20).alias("q10")), "m0", "r1")


@query(sql("SELECT id, (dense_rank() OVER (ORDER BY m DESC, label) - 1)::INT AS label FROM (SELECT label, median(l) AS m FROM types JOIN (SELECT entity, avg(level) AS l FROM level GROUP BY entity) ON entity = id GROUP BY label) JOIN types USING (label)"))
def types_by_level(spark, d):
    lev = features.level(shares(spark, d)).groupBy(F.col("entity").alias("id")).agg(F.avg("level").alias("level"))
    return cluster.order_by_level(types(spark, d), lev)


@query(sql("SELECT id, arg_min(label, [d, label])::BIGINT AS label FROM d2 GROUP BY id"))
def nearest_type(spark, d):
    p = profile_vectors(spark, d)
    return cluster.nearest_centroid(p, indices.centroids(p, types(spark, d))).withColumn("label", F.col("label").cast("long"))


# ---- sensitivity -----------------------------------------------------------------------

_SENS = {"hybrid": "hsim_r", "cosine": "pcos_r", "residual_corr": "zsim_r", "road": "road_sim_r"}
_SENS_SQL = (
    "ks AS (SELECT unnest([5, 10, 15, 20, 30]) AS knn), allr AS (" + " UNION ALL ".join(f"SELECT '{r}' AS rule, src, dst, sim, rank FROM {t}" for r, t in _SENS.items()) + """),
el AS MATERIALIZED (SELECT rule, knn, src, dst, max(w) AS w FROM (SELECT rule, knn, src, dst, sim AS w FROM allr, ks WHERE rank <= knn AND sim > 0 UNION ALL SELECT rule, knn, dst, src, sim FROM allr, ks WHERE rank <= knn AND sim > 0) GROUP BY ALL),
dg AS (SELECT rule, knn, src, count(*) AS c FROM el GROUP BY ALL),
tri AS (SELECT p.rule, p.knn, p.src, count(*) AS n FROM el p JOIN el q ON p.rule = q.rule AND p.knn = q.knn AND p.src = q.src AND p.dst <> q.dst JOIN el r ON r.rule = p.rule AND r.knn = p.knn AND r.src = p.dst AND r.dst = q.dst GROUP BY ALL),
reach(rule, knn, id, component) AS (SELECT DISTINCT rule, knn, src, src FROM el UNION SELECT e.rule, e.knn, e.src, r.component FROM reach r JOIN el e ON e.rule = r.rule AND e.knn = r.knn AND e.dst = r.id),
bl AS (SELECT rule, knn, a.label AS ci, b.label AS cj, sum(w) AS w FROM el JOIN types a ON src = a.id JOIN types b ON dst = b.id GROUP BY ALL)"""
)


@query(sql("""SELECT rule, knn::INT AS knn, edges, degree_max, clustering, components, same_group, "MQ" FROM (SELECT rule, knn, count(*) AS edges, round(avg((a.n_regionkey = b.n_regionkey)::INT), 6) AS same_group FROM el JOIN nation a ON src = a.n_nationkey JOIN nation b ON dst = b.n_nationkey WHERE src < dst GROUP BY ALL)
JOIN (SELECT rule, knn, max(c) AS degree_max, round(avg(CASE WHEN c < 2 THEN 0 ELSE coalesce(n, 0)::DOUBLE / (c * (c - 1)) END), 6) AS clustering FROM dg LEFT JOIN tri USING (rule, knn, src) GROUP BY ALL) USING (rule, knn)
JOIN (SELECT rule, knn, count(DISTINCT component) AS components FROM (SELECT rule, knn, id, min(component) AS component FROM reach GROUP BY ALL) GROUP BY ALL) USING (rule, knn)
JOIN (SELECT rule, knn, round(i / t - q / power(t, 2), 6) + 0.0 AS "MQ" FROM (SELECT rule, knn, sum(w) FILTER (ci = cj) AS i, sum(w) AS t FROM bl GROUP BY ALL) JOIN (SELECT rule, knn, sum(v * v) AS q FROM (SELECT rule, knn, ci, sum(w) AS v FROM bl GROUP BY ALL) GROUP BY ALL) USING (rule, knn)) USING (rule, knn)""", _SENS_SQL))
def graph_sensitivity(spark, d):
    """Each rule is ranked once for all numbers of neighbours; nodes are those with an edge."""
    x, roads = profile_vectors(spark, d), source.road_edges(spark, d)
    most = 30
    ranked = {
        "hybrid": graphs.hybrid_similarity(x, roads, most, CFG.hybrid_alpha, CFG.road_scale_km),
        "cosine": top_k(x, most, cosine),
        "residual_corr": graphs.residual_similarity(series_z(spark, d), most),
        "road": graphs.ranked(graphs.road_similarity(roads, CFG.road_scale_km), most),
    }
    return r6(experiments.graph_sensitivity(ranked, [5, 10, 15, 20, 30], types(spark, d), regions(spark, d)))


@query()
def sensitivity_series(spark, d):
    return serve.sensitivity_series(graph_sensitivity(spark, d))


def _switching(p: float, n: str) -> str:
    lag = f"SELECT entity, t, type, lag(type) OVER (PARTITION BY entity ORDER BY t) AS b FROM walk{n}"
    return f"""{paths_text("tstep", p, n)}, rt{n} AS MATERIALIZED ({lag}), {paths_text("pstep", p, n + "n")},
nl{n} AS (SELECT sample, count(*) FILTER (entity // 1000000 = sample AND m - t >= 6) AS changes FROM (SELECT entity, max(t) FILTER (type <> b) AS t, count(*) AS m FROM (SELECT entity, t, type, lag(type) OVER (PARTITION BY entity ORDER BY t) AS b FROM walk{n}n) GROUP BY entity), (SELECT unnest(range(0, 20)) AS sample) GROUP BY sample)"""


_SWITCH = _NULL.split("vit_p(")[0].replace("range(0, 50)", "range(0, 20)") + ",\n".join(_switching(p, n) for p, n in ((0.01, "_a"), (0.03, "_b"), (0.1, "_c")))


@query(sql(" UNION ALL ".join(f"""SELECT {p}::DOUBLE AS p, (SELECT count(*) FROM (SELECT entity, max(t) FILTER (type <> b) AS t, count(*) AS m FROM rt{n} GROUP BY entity) WHERE m - t >= 6) AS changes,
(SELECT round(avg(changes), 6) FROM nl{n}) AS null_mean, (SELECT round(stddev_pop(changes), 6) FROM nl{n}) AS null_sd,
(SELECT round(avg((type <> b)::INT), 6) FROM rt{n} WHERE b IS NOT NULL) AS switch_rate, (SELECT round(avg(v), 6) FROM (SELECT max((type <> label)::INT) AS v FROM rt{n} JOIN types ON id = entity GROUP BY entity)) AS ever_changed, (SELECT round(avg((type <> label)::INT), 6) FROM rt{n} JOIN types ON id = entity) AS off_type_share""" for p, n in ((0.01, "_a"), (0.03, "_b"), (0.1, "_c"))), _SWITCH))
def switch_sensitivity(spark, d):
    return r6(temporal.switch_sensitivity(emissions(spark, d), types(spark, d), [0.01, 0.03, 0.1]))


# ---- the network in the type model -----------------------------------------------------

CTES["mcos"] = "SELECT a.period, a.entity AS src, b.entity AS dst, list_dot_product(a.x, b.x) / ((sqrt(list_dot_product(a.x, a.x)) + 1e-12) * (sqrt(list_dot_product(b.x, b.x)) + 1e-12)) AS sim FROM fvec a JOIN fvec b ON a.period = b.period AND a.entity <> b.entity"
CTES["mcos_r"] = "SELECT *, row_number() OVER (PARTITION BY period, src ORDER BY sim DESC, dst) AS rank FROM mcos"
CTES["mknn"] = "SELECT period, src, dst, max(w) AS w FROM (SELECT period, src, dst, sim AS w FROM mcos_r WHERE rank <= 5 AND sim > 0 UNION ALL SELECT period, dst, src, sim FROM mcos_r WHERE rank <= 5 AND sim > 0) GROUP BY ALL"
CTES["mshare"] = "SELECT period, src, label, sum(w) / any_value(tot) AS f FROM mknn JOIN types ON dst = id JOIN (SELECT period, src, sum(w) AS tot FROM mknn GROUP BY ALL) USING (period, src) GROUP BY ALL"


def monthly(spark, d) -> DataFrame:
    return graphs.period_graphs(features.as_vectors(panel_features(spark, d), ["entity", "period"]), 5)


@query(sql("SELECT period, src, dst, round(w, 6) AS w FROM mknn"))
def monthly_graphs(spark, d):
    return r6(monthly(spark, d))


@query(sql("SELECT e.entity, e.period, e.type::INT AS type, round(e.e + 2 * coalesce(f, 0), 5) + 0.0 AS e FROM emit e LEFT JOIN mshare s ON s.period = e.period AND s.src = e.entity AND s.label = e.type"))
def network_emissions(spark, d):
    lab, p = types(spark, d), profile_vectors(spark, d)
    centres = indices.centroids(p, lab)
    share = temporal.neighbour_share(monthly(spark, d), lab, 3, ["period"]).withColumnRenamed("id", "entity")
    x = features.as_vectors(panel_features(spark, d), ["entity", "period"])
    e = temporal.emissions(x, centres, temporal.tau(p, centres).first()[0] or 1.0, share, 2.0)
    return r6(e.select("entity", "period", F.posexplode("e").alias("type", "e")), digits=5)


# ---- registers -------------------------------------------------------------------------


def rows(spark, d) -> DataFrame:
    n = source.scan(spark, d, "nation").join(source.scan(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return n.select(F.col("n_nationkey").cast("long").alias("id"), F.lpad(F.col("n_nationkey").cast("string"), 8, "0").alias("code"), F.col("r_name").alias("region"), F.col("n_name").alias("name"), "n_regionkey")


def bulletin(spark, d) -> DataFrame:
    """Customers of each nation as its population; units of region 3 have new codes, those of region 4 new names as well."""
    c = source.scan(spark, d, "customer").groupBy(F.col("c_nationkey").cast("long").alias("id")).agg(F.count(F.lit(1)).alias("pop"), F.count_if(F.col("c_acctbal") > 0).alias("urban"))
    code = F.concat(F.when(F.col("n_regionkey") >= 3, F.lit("9 ")).otherwise(F.lit("0 ")), F.substring("code", 2, 7), F.lit(" 00"))
    name = F.concat(F.when(F.col("n_regionkey") == 4, F.lit("New ")).otherwise(F.lit("NATION - ")), "name")
    return rows(spark, d).join(c, "id").select(code.alias("code"), F.concat("region", F.lit(" region")).alias("region"), name.alias("name"), "pop", "urban")


def sheet(spark, d) -> DataFrame:
    """Region headers before their members: nations with a supplier of much credit."""
    r = source.scan(spark, d, "region").select((F.col("r_regionkey") * 1000).cast("long").alias("line"), F.col("r_name").alias("text"), F.lit(True).alias("head"))
    n = source.scan(spark, d, "supplier").where("s_acctbal > 9000").select(F.col("s_nationkey").cast("long").alias("id")).distinct().join(rows(spark, d), "id")
    return r.union(n.select((F.col("n_regionkey") * 1000 + 1 + F.col("id")).cast("long"), F.concat(F.lower("name"), F.lit(" district")), F.lit(False)))


def lists(spark, d) -> DataFrame:
    """Three lists of codes, by segment of customers of much credit."""
    place = F.array_position(F.array(F.lit("BUILDING"), F.lit("MACHINERY"), F.lit("HOUSEHOLD")), F.col("c_mktsegment"))
    c = source.scan(spark, d, "customer").where("c_acctbal > 9800").withColumn("place", place).where("place > 0")
    return c.select("place", F.concat(F.col("c_nationkey").cast("string"), F.lit("00.0")).alias("code"), F.lower("c_mktsegment").alias("status")).distinct()


_POP = "pop AS (SELECT n_nationkey::BIGINT AS id, CASE WHEN n_regionkey < 4 THEN pop END AS pop, CASE WHEN n_regionkey < 4 THEN urban END AS urban, CASE WHEN n_regionkey < 4 THEN round(urban / pop::DOUBLE, 6) END AS urban_share FROM nation LEFT JOIN (SELECT c_nationkey, count(*) AS pop, count(*) FILTER (c_acctbal > 0) AS urban FROM customer GROUP BY 1) ON c_nationkey = n_nationkey)"
_NORTH = "north AS (SELECT n_nationkey::BIGINT AS id, n_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 9000) AS listed FROM nation)"
_MONO = "mono AS (SELECT n_nationkey::BIGINT AS id, status FROM nation LEFT JOIN (SELECT c_nationkey, arg_min(lower(c_mktsegment), list_position(['BUILDING', 'MACHINERY', 'HOUSEHOLD'], c_mktsegment)) AS status FROM customer WHERE c_acctbal > 9800 AND c_mktsegment IN ('BUILDING', 'MACHINERY', 'HOUSEHOLD') GROUP BY 1) ON c_nationkey = n_nationkey)"


@query(f"WITH {_POP} SELECT * FROM pop")
def population(spark, d):
    return r6(external.population(rows(spark, d), bulletin(spark, d)))


@query(f"WITH {_NORTH} SELECT * FROM north")
def north_flag(spark, d):
    return external.listed(rows(spark, d), sheet(spark, d), F.col("head"))


@query(f"WITH {_MONO} SELECT * FROM mono")
def town_category(spark, d):
    return external.category(rows(spark, d), lists(spark, d))


@query(f"WITH {_POP}, {_NORTH}, {_MONO} SELECT * FROM pop JOIN north USING (id) JOIN mono USING (id)")
def external_bundle(spark, d):
    return external.bundle(rows(spark, d), r6(external.population(rows(spark, d), bulletin(spark, d))), external.listed(rows(spark, d), sheet(spark, d), F.col("head")), external.category(rows(spark, d), lists(spark, d)))


# ---- serving ---------------------------------------------------------------------------


@query(sql('SELECT entity, f::INT AS "from", l::INT AS "to", t::INT AS t, s::BIGINT AS switches FROM ch WHERE s >= 1 AND n - t >= 2 AND f = 0', _RAW_T))
def movers_from(spark, d):
    changes = temporal.persistent_changes(temporal.raw_path(emissions(spark, d)), 2).withColumn("t", F.col("t").cast("int"))
    return serve.movers(changes, from_=0)


@query(sql("SELECT (SELECT count(DISTINCT entity) FROM panel) AS entities, (SELECT min(period) FROM panel) AS first, (SELECT max(period) FROM panel) AS last, (SELECT count(DISTINCT period) FROM panel) - 2 AS slices, (SELECT count(DISTINCT category) FROM panel) AS categories, (SELECT count(DISTINCT label) FROM types) AS types, (SELECT count(*) FROM pknn WHERE src < dst) AS edges"))
def summary(spark, d):
    return serve.summary(source.orders_panel(spark, d), types(spark, d), profile_graph(spark, d))


@query("SELECT p_partkey, p_brand AS method, p_type AS rule, p_size::INT AS k FROM part")
def key_parts(spark, d):
    p = source.scan(spark, d, "part").select("p_partkey", F.concat_ws("|", "p_brand", "p_type", F.col("p_size").cast("string")).alias("key"))
    return serve.key_parts(p).drop("key")


@query("SELECT p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey)::INT AS rank FROM part QUALIFY rank <= 3")
def top_per_group(spark, d):
    return relational.top_n(source.scan(spark, d, "part"), "p_brand", 3, F.col("p_retailprice").desc(), F.col("p_partkey")).select("p_partkey", F.col("rank").cast("int").alias("rank"))


@query("SELECT p_brand, round(median(p_size), 6) AS p_size, round(median(p_retailprice), 6) AS p_retailprice FROM part GROUP BY p_brand")
def group_medians(spark, d):
    return r6(relational.group_medians(source.scan(spark, d, "part"), "p_brand", ["p_size", "p_retailprice"]))


@query("SELECT p_brand, p_size, min(p_retailprice) AS p_retailprice FROM part GROUP BY ALL")
def best_by(spark, d):
    return relational.best_by(source.scan(spark, d, "part"), ["p_brand", "p_size"], "p_retailprice")


@query("""SELECT '{"c_custkey":' || c_custkey || ',"v":' || CASE WHEN c_nationkey = 0 THEN 'null' ELSE c_nationkey::VARCHAR END || '}' AS json FROM customer""")
def json_lines(spark, d):
    c = source.scan(spark, d, "customer")
    return source.json_lines(c.select("c_custkey", F.when(F.col("c_nationkey") != 0, F.col("c_nationkey")).alias("v")))

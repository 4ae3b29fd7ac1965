"""Orchestration: run grids, indices of every run, stability, ablation, slices through time. Jobs are rows; a task solves one."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veldt.operators import cluster, features, graphs, indices
from veldt.sources.staging import materialised

JOB = "key string, draw int, method string, rule string, k int, seed int, fraction double"


def jobs(spark: SparkSession, feature_methods: Iterable[str], graph_methods: Iterable[str], rules: Iterable[str], ks: Iterable[int], seed: int = 42) -> DataFrame:
    """The grid: feature methods once per k, graph methods once per rule and k."""
    rules, ks = list(rules), list(ks)
    rows = [(f"{m}|-|{k}", 0, m, "-", k, seed, 1.0) for m in feature_methods for k in ks]
    rows += [(f"{m}|{r}|{k}", 0, m, r, k, seed, 1.0) for m in graph_methods for r in rules for k in ks]
    return spark.createDataFrame(rows, JOB)


def run_indices(labels: DataFrame, vectors: DataFrame, edges: dict[str, DataFrame], keys: list[str]) -> DataFrame:
    """(key, index, graph, value): feature indices once per run, graph indices on every graph."""
    out = None
    for key in keys:
        lab = labels.where(F.col("key") == key).select("id", "label")
        tables = [("-", indices.silhouette(vectors, lab)), ("-", indices.calinski_harabasz(vectors, lab)), ("-", indices.s_dbw(vectors, lab))]
        tables += [(name, indices.graph_indices(e, lab)) for name, e in edges.items()]
        for graph, table in tables:
            for index in table.columns:
                one = table.select(F.lit(key).alias("key"), F.lit(index).alias("index"), F.lit(graph).alias("graph"), F.col(index).alias("value"))
                out = one if out is None else out.union(one)
    return out


def _quality(key: str, lab: np.ndarray, x: np.ndarray, edges: dict[str, tuple]) -> pd.DataFrame:
    """All indices of one run but the silhouette; those that need two clusters are null for one."""
    k = int(lab.max()) + 1
    member = (lab[:, None] == np.arange(k)).astype(float)
    size, n = member.sum(0), len(lab)
    rows: list[tuple] = [("clusters", "-", float(k)), ("min_share", "-", float(size.min() / n))]
    two = k >= 2
    centre = (member.T @ x) / size[:, None]
    spread = (member.T @ x**2) / size[:, None] - centre**2
    between, within = (size[:, None] * (centre - x.mean(0)) ** 2).sum(), (size[:, None] * spread).sum()
    norm = np.sqrt((spread**2).sum(1))
    reach = np.sqrt(norm.sum()) / k
    own_near = [int((np.linalg.norm(x[lab == c] - centre[c], axis=1) <= reach).sum()) for c in range(k)]
    dens = []
    for i in range(k):
        for j in range(i + 1, k):
            mid = (np.linalg.norm(x[(lab == i) | (lab == j)] - (centre[i] + centre[j]) / 2, axis=1) <= reach).sum()
            most = max(own_near[i], own_near[j])
            dens.append(mid / most if most else 0.0)
    scatter = norm.mean() / np.sqrt((x.var(0) ** 2).sum())
    rows.append(("CH", "-", float(between / (k - 1) / (within / (n - k))) if two and n > k and within > 0 else None))
    rows.append(("S_Dbw", "-", float(scatter + np.mean(dens)) if two else None))
    for name, (src, dst, w) in edges.items():
        block = np.bincount(lab[src].astype(np.int64) * k + lab[dst], w, k * k).reshape(k, k)
        inner, vol = block.diagonal() / 2, block.sum(1)
        total = max(vol.sum(), 1e-12)
        i, j = np.triu_indices(k, 1)
        rows.append(("AVI", name, float((inner / np.maximum(inner + vol - 2 * inner, 1e-12)).mean()) if two else None))
        rows.append(("AVU", name, float((block[i, j] / np.maximum(inner[i] + inner[j] + block[i, j], 1e-12)).mean()) if two else None))
        rows.append(("MQ", name, float(2 * inner.sum() / total - (vol**2).sum() / total**2) if two else None))
    out = pd.DataFrame(rows, columns=["index", "graph", "value"])
    out.insert(0, "key", key)
    return out


def _widths(at: int, until: int, x: np.ndarray, labels: list[np.ndarray], tile: int = 1024) -> list[float | None]:
    """For each run, the sum of the silhouettes of rows ``at`` to ``until``; None for one cluster.

    Distances are made once for all runs, a tile at a time, and summed by cluster.
    """
    ks = [int(lab.max()) + 1 for lab in labels]
    first = np.r_[0, np.cumsum(ks)]
    sums, sq = np.zeros((until - at, first[-1])), (x**2).sum(1)
    for a in range(0, len(x), tile):
        b = min(a + tile, len(x))
        far = np.sqrt(np.maximum(sq[at:until, None] + sq[None, a:b] - 2 * x[at:until] @ x[a:b].T, 0))
        far[np.arange(at, until)[:, None] == np.arange(a, b)[None, :]] = 0
        member = np.zeros((b - a, first[-1]))
        for lab, f in zip(labels, first, strict=False):
            member[np.arange(b - a), f + lab[a:b]] = 1
        sums += far @ member
    out: list[float | None] = []
    for lab, f, k in zip(labels, first, ks, strict=False):
        if k < 2:
            out.append(None)
            continue
        size, own = np.bincount(lab, minlength=k), lab[at:until, None] == np.arange(k)
        mean = np.where(own, sums[:, f : f + k] / np.maximum(size - 1, 1), sums[:, f : f + k] / size)
        inside, outside = mean[own], np.where(own, np.inf, mean).min(1)
        out.append(float(np.where(size[lab[at:until]] > 1, (outside - inside) / np.maximum(np.maximum(inside, outside), 1e-300), 0.0).sum()))
    return out


def _packed(frame: pd.DataFrame) -> pd.DataFrame:
    """One row: a run's labels, numbered from 0 and in the order of ids, in one or four bytes each."""
    lab = np.unique(frame.sort_values("id")["label"].to_numpy(), return_inverse=True)[1]
    return pd.DataFrame({"key": frame["key"].iloc[:1], "labels": [lab.astype(np.uint8 if lab.max() < 256 else np.int32).tobytes()]})


def grid_indices(labels: DataFrame, vectors: DataFrame, graphs: dict[str, DataFrame], block: int = 512, most: int = 4096) -> DataFrame:
    """labels(key, id, label) -> (key, index, graph, value): sizes and every index of every run.

    As ``cluster.run`` does, it sends the vectors, links and labels of the analysed entities, at
    most MOST_NODES, to every task; ``run_indices`` computes the same from tables of any size.
    Silhouettes take a task for ``block`` entities and runs of ``most`` clusters together, the
    rest a task for some runs.
    """
    spark = vectors.sparkSession
    ids, x, edges = cluster.arrays(vectors, graphs)
    packed = labels.select("key", "id", "label").groupBy("key").applyInPandas(lambda f: _packed(f), "key string, labels binary").collect()
    packed.sort(key=lambda r: r["key"])
    n, keys = len(ids), [r["key"] for r in packed]
    runs = [np.frombuffer(r["labels"], dtype=np.uint8 if len(r["labels"]) == n else np.int32) for r in packed]
    if any(len(lab) != n for lab in runs):
        raise ValueError("a run must label every entity once")
    parts, wide = [[0, 0]] if keys else [], 0  # runs whose silhouettes are taken together
    for i, lab in enumerate(runs):
        wide += int(lab.max()) + 1
        if wide > most and parts[-1][1] > parts[-1][0]:
            parts.append([i, i])
            wide = int(lab.max()) + 1
        parts[-1][1] = i + 1
    some = [("SW", a, min(a + block, n), p, q) for p, q in parts for a in range(0, n, block)]
    some += [("-", a, min(a + 8, len(keys)), 0, 0) for a in range(0, len(keys), 8)]

    def measure(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        wide = x.astype(float)
        for f in frames:
            for i in f["id"]:
                what, a, b, p, q = some[i]
                if what == "SW":
                    yield pd.DataFrame({"key": keys[p:q], "index": "SW", "graph": "-", "value": np.array(_widths(a, b, wide, runs[p:q]), dtype=object)}).astype({"value": float})
                else:
                    for j in range(a, b):
                        yield _quality(keys[j], runs[j], wide, edges)

    found = materialised(spark.range(0, len(some), 1, max(1, len(some))).mapInPandas(measure, "key string, index string, graph string, value double"), "indices")
    sw = found.where("index = 'SW'").groupBy("key", "index", "graph").agg((F.sum("value") / F.lit(float(max(n, 1)))).alias("value"))
    return found.where("index <> 'SW'").union(sw)


def ranked_runs(values: DataFrame, min_share: float = 0.01) -> DataFrame:
    """(k, item, borda, copeland, their ranks, kemeny_rank) of the admissible runs of a grid, within each k.

    Graph indices are means over the graphs that share no source with the run; a run without
    such a graph, with one cluster or with a tiny one is not ranked.
    """
    from veldt.operators import ranking
    from veldt.operators.serve import key_parts
    from veldt.plans.config import HIGHER_IS_BETTER

    parts = materialised(key_parts(values), "run-values")
    fair = ranking.fair_means(parts.where("graph <> '-'")).select("method", "rule", "k", "index", "value")
    plain = parts.where("graph = '-'").select("method", "rule", "k", "index", "value")
    table = plain.union(fair).groupBy("method", "rule", "k").pivot("index", [*HIGHER_IS_BETTER, "clusters", "min_share"]).agg(F.first("value"))
    good = ranking.admissible(table, list(HIGHER_IS_BETTER), min_share)
    scores = good.select("k", F.concat_ws("|", "method", "rule", F.col("k").cast("string")).alias("item"), *HIGHER_IS_BETTER).unpivot(["k", "item"], list(HIGHER_IS_BETTER), "criterion", "value")
    return ranking.rank_table(ranking.oriented(materialised(scores, "run-scores"), HIGHER_IS_BETTER))


def _agreement(frame: pd.DataFrame) -> pd.DataFrame:
    t = pd.crosstab(frame["label"], frame["base"]).to_numpy().astype(float)
    two = lambda m: float((m * (m - 1) / 2).sum())
    n = t.sum()
    expected = two(t.sum(0)) * two(t.sum(1)) / max(n * (n - 1) / 2, 1)
    top = (two(t.sum(0)) + two(t.sum(1))) / 2
    return pd.DataFrame({"draw": [int(frame["draw"].iloc[0])], "ari": [1.0 if top == expected else (two(t) - expected) / (top - expected)]})


def stability(vectors: DataFrame, edges: dict[str, DataFrame], method: str, rule: str, k: int, draws: int = 20, fraction: float = 0.8, seeds: int = 5, seed: int = 42) -> DataFrame:
    """(kind, mean, q10): adjusted Rand index of subsamples and of other seeds against the run on all."""
    spark = vectors.sparkSession
    key = f"{method}|{rule}|{k}"
    rows = [(key, 0, method, rule, k, seed, 1.0)]
    rows += [(key, b + 1, method, rule, k, seed + b + 1, fraction) for b in range(draws)]
    rows += [(key, 1000 + s, method, rule, k, seed + 100 + s, 1.0) for s in range(seeds)]
    lab = materialised(cluster.run(spark.createDataFrame(rows, JOB), vectors, edges), "runs")
    base = lab.where("draw = 0").select("id", F.col("label").alias("base"))
    ari = lab.where("draw > 0").join(base, "id").select("draw", "label", "base").groupBy("draw").applyInPandas(_agreement, "draw int, ari double")
    kind = F.when(F.col("draw") < 1000, "subsample").otherwise("seed")
    return ari.groupBy(kind.alias("kind")).agg(F.avg("ari").alias("mean"), F.percentile("ari", 0.1).alias("q10"))


def _measured(frame: pd.DataFrame) -> pd.DataFrame:
    near: dict[int, set[int]] = {}
    for u, v in zip(frame["src"].tolist(), frame["dst"].tolist(), strict=True):
        near.setdefault(u, set()).add(v)
    closed = []
    for u, around in near.items():
        d = len(around)
        closed.append(sum(len(around & near[v]) for v in around) / (d * (d - 1)) if d > 1 else 0.0)
    left, components = set(near), 0
    while left:
        todo = [left.pop()]
        components += 1
        while todo:
            new = near[todo.pop()] & left
            left -= new
            todo.extend(new)
    half = frame[frame["src"] < frame["dst"]]
    known = frame.dropna(subset=["la", "lb"])
    total = known["w"].sum()
    inner = known.loc[known["la"] == known["lb"], "w"].sum()
    mq = inner / total - (known.groupby("la")["w"].sum() ** 2).sum() / total**2 if total > 0 else None
    row = (frame["rule"].iloc[0], int(frame["knn"].iloc[0]), len(half), max(map(len, near.values())), float(np.mean(closed)), components, float((half["ga"] == half["gb"]).mean()), mq)
    return pd.DataFrame([row], columns=["rule", "knn", "edges", "degree_max", "clustering", "components", "same_group", "MQ"])


def graph_sensitivity(ranked: dict[str, DataFrame], ks: list[int], labels: DataFrame, groups: DataFrame) -> DataFrame:
    """(rule, knn, edges, degree_max, clustering, components, same_group, MQ) of every rule's graph at every number of neighbours.

    ranked: (src, dst, sim, rank) by rule, up to the largest of ks. labels(id, label) and
    groups(id, g) stay fixed. A graph of n nodes has at most 2 n k edges; a task measures one.
    """
    out = None
    for rule, r in ranked.items():
        best = r.where("sim > 0").select("src", "dst", "sim", "rank", F.explode(F.array(*[F.lit(k) for k in ks])).alias("knn")).where("rank <= knn")
        both = best.select("knn", "src", "dst", "sim").union(best.select("knn", "dst", "src", "sim")).groupBy("knn", "src", "dst").agg(F.max("sim").alias("w"))
        one = both.select(F.lit(rule).alias("rule"), "knn", "src", "dst", "w")
        out = one if out is None else out.union(one)
    for end, l, g in (("src", "la", "ga"), ("dst", "lb", "gb")):
        out = out.join(labels.select(F.col("id").alias(end), F.col("label").cast("double").alias(l)), end, "left").join(groups.select(F.col("id").alias(end), F.col("g").alias(g)), end, "left")
    schema = "rule string, knn int, edges long, degree_max long, clustering double, components long, same_group double, MQ double"
    return out.groupBy("rule", "knn").applyInPandas(lambda f: _measured(f), schema)


#: Feature blocks of each variant, and months of smoothing.
VARIANTS = {
    "structure": (("structure",), 3), "structure+level": (("structure", "level"), 3), "structure+level+rhythm": (("structure", "level", "rhythm"), 3),
    "structure+level+rhythm+market": (("structure", "level", "rhythm", "market"), 3), "unsmoothed": (("structure", "level", "rhythm"), 1),
}


def ablation(wide: DataFrame, categories: list[str], market: DataFrame, series: DataFrame, reference: DataFrame, k: int, knn: int = 5, method: str = "attributed_spectral") -> DataFrame:
    """(variant, features, ari, SW, CH, S_Dbw, AVI, AVU, MQ): the method on features of fewer or more blocks.

    The graph is built anew from each variant's features. ari is held against reference(id,
    label), the feature indices against the variant's features, the graph indices against
    series(src, dst, w). market(entity, market_access).
    """
    weights = {"structure": 1.0, "level": 1.0, "rhythm": 0.6, "market": 0.5}
    spark, out = wide.sparkSession, None
    for name, (blocks, window) in VARIANTS.items():
        w = {b: v if b in blocks else 0.0 for b, v in weights.items()}
        panel = features.feature_panel(wide, categories, window, weights=w, market=market if "market" in blocks else None)
        size = len(features.share_names(categories)) + (1 if "level" in blocks else 0) + (3 if "rhythm" in blocks else 0) + (1 if "market" in blocks else 0)
        x = materialised(features.as_vectors(features.profile(panel).withColumnRenamed("entity", "id"), ["id"]), "ablation")
        job = spark.createDataFrame([(name, 0, method, "cosine", k, 42, 1.0)], JOB)
        lab = materialised(cluster.run(job, x, {"cosine": graphs.cosine_graph(x, knn)}).select("key", "id", "label"), "ablation")
        found = grid_indices(lab, x, {"residual_corr": series}).groupBy().pivot("index", ["SW", "CH", "S_Dbw", "AVI", "AVU", "MQ"]).agg(F.first("value"))
        one = indices.adjusted_rand(reference, lab.select("id", "label")).select(F.lit(name).alias("variant"), F.lit(size).alias("features"), F.col("ARI").alias("ari")).crossJoin(found)
        out = one if out is None else out.union(one)
    return out


def multislice(vectors: DataFrame, knn: int, omega: float, resolution: float, periods: int | None = None, seed: int = 42) -> DataFrame:
    """vectors(entity, period, x) -> (entity, period, label): communities of the sequence of kNN graphs, in one task."""
    names = vectors.select("period").distinct().withColumn("t", F.row_number().over(Window.orderBy("period")) - 1)
    if periods:
        names = names.where(F.col("t") < periods)
    rows = vectors.join(F.broadcast(names), "period").select(F.lit(0).alias("g"), "t", "period", "entity", "x")

    def solve(frame: pd.DataFrame) -> pd.DataFrame:
        ids = np.sort(frame["entity"].unique())
        if len(ids) * frame["t"].nunique() > cluster.MOST_SLICED:
            raise ValueError("too many entities and periods for one task")
        layers, order = [], []
        for t, f in frame.groupby("t"):
            f = f.set_index("entity").reindex(ids)
            x = np.array(f["x"].tolist(), dtype=float)
            u = x / (np.linalg.norm(x, axis=1, keepdims=True) + 1e-12)
            s = u @ u.T
            np.fill_diagonal(s, -np.inf)
            a = np.zeros_like(s)
            top = np.argsort(-s, axis=1, kind="stable")[:, :knn]
            at = np.arange(len(ids))[:, None]
            a[at, top] = np.maximum(s[at, top], 0)
            layers.append(np.maximum(a, a.T))
            order.append(f["period"].iloc[0])
            del t
        lab = cluster.multislice(layers, omega, resolution, seed)
        return pd.DataFrame({"entity": np.tile(ids, len(order)), "period": np.repeat(order, len(ids)), "label": lab.ravel()})

    return rows.groupBy("g").applyInPandas(solve, "entity long, period string, label long")

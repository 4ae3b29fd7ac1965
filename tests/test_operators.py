"""The reference behaviour of the analysis operators on small planted inputs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from veldt.operators import cluster, concepts, features, graphs, indices, pairs, ranking, relational, serve, stats, temporal
from veldt.plans import experiments
from veldt.plans.config import Config


def blobs(spark, shuffled=False):
    rng = np.random.default_rng(0)
    x = np.vstack([rng.normal(c, 0.3, (20, 2)) for c in ((0, 0), (4, 0), (0, 4))])
    lab = np.repeat([0, 1, 2], 20)
    if shuffled:
        lab = np.random.default_rng(1).permutation(lab)
    v = spark.createDataFrame([(i, [float(a) for a in r]) for i, r in enumerate(x)], "id long, x array<double>")
    return v, spark.createDataFrame([(i, int(c)) for i, c in enumerate(lab)], "id long, label int")


def cliques(spark, sizes=(5, 5, 5), bridge=0.0):
    lab = np.repeat(range(len(sizes)), sizes)
    n = len(lab)
    rows = [(i, j, 1.0) for i in range(n) for j in range(n) if i != j and lab[i] == lab[j]]
    if bridge:
        rows += [(0, n - 1, bridge), (n - 1, 0, bridge)]
    return spark.createDataFrame(rows, "src long, dst long, w double"), spark.createDataFrame([(i, int(c)) for i, c in enumerate(lab)], "id long, label int")


def test_true_partition_beats_shuffled(spark):
    v, good = blobs(spark)
    _, bad = blobs(spark, True)
    one = lambda f, lab: f(v, lab).first()[0]
    assert one(indices.silhouette, good) > one(indices.silhouette, bad)
    assert one(indices.calinski_harabasz, good) > one(indices.calinski_harabasz, bad)
    assert one(indices.s_dbw, good) < one(indices.s_dbw, bad)


def test_single_cluster_has_no_index(spark):
    v, lab = blobs(spark)
    one = lab.withColumn("label", F.lit(0))
    assert indices.silhouette(v, one).first()[0] is None
    e, cl = cliques(spark)
    assert indices.modularity(e, cl.withColumn("label", F.lit(0))).first()[0] == pytest.approx(0)
    assert indices.graph_indices(e, cl.withColumn("label", F.lit(0))).first()["AVI"] is None


def test_cliques_and_bridge(spark):
    r = indices.graph_indices(*cliques(spark)).first()
    assert (r["AVI"], r["AVU"]) == (1.0, 0.0)
    assert r["MQ"] == pytest.approx(1 - 3 * (1 / 3) ** 2)
    b = indices.graph_indices(*cliques(spark, bridge=2.0)).first()
    assert b["AVI"] < 1 and b["AVU"] > 0


def test_ari_of_itself(spark):
    _, lab = blobs(spark)
    assert indices.adjusted_rand(lab, lab).first()[0] == 1.0
    assert indices.mutual_information(lab, lab).first()[0] == pytest.approx(1.0)


def test_clr_rows_sum_to_zero(spark):
    rows = [(1, f"2000-{m:02d}", c, float(v)) for m in (1, 2, 3) for c, v in (("AUTOMOBILE", 2), ("BUILDING", 3), ("FURNITURE", 1), ("HOUSEHOLD", 4), ("MACHINERY", 5))]
    long = spark.createDataFrame(rows, "entity long, period string, category string, value double")
    cats = list(Config().categories)
    s = features.smoothed_shares(features.wide_panel(long, cats, 3), cats, 1)
    assert s.count() == 3
    for r in features.clr_features(s, cats, relative=False).drop("entity", "period").collect():
        assert sum(r) == pytest.approx(0, abs=1e-12)


def test_planted_partitions_are_found():
    rng = np.random.default_rng(0)
    lab = np.repeat([0, 1, 2], 40)
    x = rng.normal(size=(120, 4))
    x[np.arange(120), lab] += 3
    a = np.triu(rng.random((120, 120)) < np.where(lab[:, None] == lab[None, :], 0.3, 0.02), 1).astype(float)
    a += a.T

    def ari(u, v):
        t = np.zeros((u.max() + 1, v.max() + 1))
        np.add.at(t, (u, v), 1)
        two = lambda m: (m * (m - 1) / 2).sum()
        e = two(t.sum(1)) * two(t.sum(0)) / two(np.array([len(u)]))
        return (two(t) - e) / ((two(t.sum(1)) + two(t.sum(0))) / 2 - e)

    for name, least in (("attributed_spectral", 0.8), ("sefnac", 0.8), ("leiden", 0.8), ("spectral", 0.8), ("dmon", 0.8), ("kmeans", 0.7), ("ward", 0.6), ("gmm", 0.6)):
        assert ari(lab, cluster.METHODS[name](x, a, 3, 0)) > least, name
    assert ari(lab, cluster.multislice([a, a], 0.2, 1.0, 0)[0]) > 0.8


def scores(spark, table):
    return spark.createDataFrame([(0, i, c, float(v)) for c, vs in table.items() for i, v in zip("xyz", vs, strict=True)], "k int, item string, criterion string, value double")


def test_unanimous_ranking(spark):
    s = scores(spark, {"a": (3, 2, 1), "b": (30, 20, 10)})
    assert ranking.kendall_w(s).first()["W"] == pytest.approx(1)
    assert {r["item"]: r["kemeny_rank"] for r in ranking.kemeny(s).collect()} == {"x": 1, "y": 2, "z": 3}


def test_copeland_and_borda(spark):
    s = scores(spark, {"a": (3, 1, 2), "b": (3, 2, 1), "c": (1, 3, 2)})
    assert {r["item"]: r["copeland"] for r in ranking.copeland(s).collect()}["x"] == 2
    assert {r["item"]: r["borda"] for r in ranking.borda(s).collect()} == {"x": 4.0, "y": 3.0, "z": 2.0}


def emissions(spark, rows):
    return spark.createDataFrame([(0, f"{t:02d}", [float(v) for v in e]) for t, e in enumerate(rows)], "entity long, period string, e array<double>")


def test_path_ignores_one_outlier_and_follows_a_change(spark):
    out = temporal.viterbi(emissions(spark, [(-5, 0) if t == 4 else (0, -5) for t in range(10)]), 0.01)
    assert {r["type"] for r in out.collect()} == {0}
    path = temporal.viterbi(emissions(spark, [(0, -5)] * 6 + [(-5, 0)] * 6), 0.03)
    (r,) = temporal.persistent_changes(path, 6).collect()
    assert (r["from"], r["to"], r["t"], r["switches"]) == (0, 1, 6, 1)
    assert temporal.viterbi_score(emissions(spark, [(0, -5)] * 3), 0.03).first()["score"] == pytest.approx(2 * np.log(0.97))


def test_split_event(spark):
    now, then = [0] * 10 + [1] * 10, [0] * 5 + [2] * 5 + [1] * 10
    lab = spark.createDataFrame([(t, i, c) for t, row in enumerate((now, then)) for i, c in enumerate(row)], "t long, id long, label long")
    found = {(r["event"], r["from"], r["to"]) for r in temporal.lifecycle_events(lab, 0.3).collect()}
    assert found == {("split", 0, None), ("continuation", 1, 1)}


def test_blocks_give_the_same_neighbours(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 5))
    v = spark.createDataFrame([(i, [float(a) for a in r]) for i, r in enumerate(x)], "id long, x array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -np.inf)
    want = {(i, int(j)) for i in range(60) for j in np.argsort(-s[i])[:4]}
    for size in (1024, 7):
        assert {(r["src"], r["dst"]) for r in pairs.top_k(v, 4, block=size).collect()} == want


def test_components_and_clustering(spark):
    e, lab = cliques(spark)
    ids = lab.select("id")
    assert {r["component"] for r in graphs.components(e, ids).collect()} == {0, 5, 10}
    assert {r["clustering"] for r in graphs.local_clustering(e).collect()} == {1.0}
    assert graphs.assortativity(e, lab.withColumnRenamed("label", "g")).first()[0] == pytest.approx(1)
    with pytest.raises(ValueError):
        graphs.build("nonesuch", None, None, None, [], "", 1, Config())


def test_dtw_of_equal_and_shifted_series():
    a = np.array([[0.0, 0, 1, 0, 0, 0]])
    assert graphs.dtw(a, a, 2)[0] == 0
    assert graphs.dtw(a, np.roll(a, 1, axis=1), 2)[0] == 0


def test_relational_edge_cases(spark):
    d = spark.createDataFrame([(1, "a", None), (1, "b", 2.0), (2, "a", 5.0)], "entity long, period string, v double")
    assert relational.without_nulls(d).count() == 2
    assert relational.rolling_sum(d, ["v"], 2).count() == 1
    assert relational.minus_group_median(d, ["v"]).count() == 3
    h = spark.createDataFrame([(1, "H1"), (2, "m"), (3, "H2"), (4, "n")], "line long, v string")
    assert [r["header"] for r in relational.carry_header(h, F.col("v").startswith("H"), F.col("v"), "line").orderBy("line").collect()] == ["H1", "H2"]


def test_concepts(spark):
    c = spark.createDataFrame([(1, True, True), (2, True, False), (3, False, True)], "id long, a boolean, b boolean")
    assert {r["id"] for r in concepts.extent(c, ["a"]).collect()} == {1, 2}
    assert concepts.extent(c, []).count() == 3
    assert {r["attr"] for r in concepts.intent(c, concepts.extent(c, ["a"])).collect()} == {"a"}
    assert {r["attr"] for r in concepts.intent(c, concepts.extent(c, ["a"]).where("id > 9")).collect()} == {"a", "b"}
    assert concepts.delta_stability(c, ["a"]).first()["delta"] == 1
    lab = spark.createDataFrame([(1, 0), (2, 0), (3, 1)], "id long, label int")
    found = {r["label"]: r["generator"] for r in concepts.describe_types(c, lab, least=1).collect()}
    assert found[0] == ["a"]


def test_types_without_a_description_have_an_empty_one(spark):
    c = spark.createDataFrame([(i, i < 3) for i in range(6)], "id long, a boolean")
    lab = spark.createDataFrame([(i, int(i >= 3)) for i in range(6)], "id long, label int")
    found = {r["label"]: (r["generator"], r["f1"]) for r in concepts.describe_types(c, lab, least=1).collect()}
    assert found == {0: (["a"], 1.0), 1: ([], 0.0)}


def test_passes_settle_and_keep_what_no_majority_turns():
    assert ranking.settled(["a", "b", "c", "d"], {("d", "a"), ("d", "b"), ("d", "c")}) == ["d", "a", "b", "c"]
    assert ranking.settled(["a", "b"], set()) == ["a", "b"]


def test_extraction_takes_overlapping_groups_one_by_one():
    """Two planted groups that overlap in features but not in links, and outliers that go to the nearest centre."""
    rng = np.random.default_rng(1)
    lab = np.repeat([0, 1], 30)
    x = rng.normal(size=(60, 3)) * 0.6
    x[:, 0] += 2.0 * lab
    a = np.triu(rng.random((60, 60)) < np.where(lab[:, None] == lab[None, :], 0.6, 0.02), 1).astype(float)
    found = cluster.sefnac(x, a + a.T, 2)
    assert max((found == lab).mean(), (found != lab).mean()) > 0.9


def test_soft_modularity_gradient():
    rng = np.random.default_rng(2)
    a = np.triu(rng.random((9, 9)) < 0.5, 1).astype(float)
    a += a.T
    c = rng.dirichlet(np.ones(3), 9)
    _, grad = cluster.soft_modularity(c, a, 0.7)
    for i, j in ((0, 0), (4, 2), (8, 1)):
        step = np.zeros_like(c)
        step[i, j] = 1e-6
        up, down = cluster.soft_modularity(c + step, a, 0.7)[0], cluster.soft_modularity(c - step, a, 0.7)[0]
        assert grad[i, j] == pytest.approx((up - down) / 2e-6, abs=1e-6)


def test_plane_keeps_groups_apart_and_gradient_is_right():
    rng = np.random.default_rng(1)
    lab = np.repeat([0, 1, 2], 30)
    x = rng.normal(size=(90, 5))
    x[np.arange(90), lab] += 8
    y = cluster.plane(x)
    assert y.min() == 0 and y.max() == 1
    d = ((y[:, None] - y[None, :]) ** 2).sum(2) + np.eye(90) * 9
    assert (lab[d.argmin(1)] == lab).mean() > 0.97

    def loss(z):
        q = 1 / (1 + ((z[:, None] - z[None, :]) ** 2).sum(2))
        np.fill_diagonal(q, 0)
        q = q / q.sum()
        on = ~np.eye(len(z), dtype=bool)
        return (p[on] * np.log(p[on] / q[on])).sum()

    p = np.maximum(cluster.neighbour_odds(x, 10.0), 1e-300)
    assert p[~np.eye(90, dtype=bool)].sum() == pytest.approx(1)
    # a settled map lies in a valley: the divergence has no slope in any direction, and it is below that of the components
    z = cluster.tsne(x, 10.0)
    assert loss(z) < loss(cluster.principal(x))
    for _ in range(5):
        move = rng.normal(size=z.shape)
        move *= 0.01 / np.linalg.norm(move)
        assert abs(loss(z + move) - loss(z - move)) / 0.02 < 1e-3
    assert cluster.plane(x[:3]).shape == (3, 2) and not cluster.plane(np.ones((5, 1))).any()


def test_small_communities_follow_their_ties():
    a = np.zeros((8, 8))
    for u, v in ((0, 1), (1, 2), (0, 2), (3, 4), (4, 5), (3, 5), (6, 5), (7, 6)):
        a[u, v] = a[v, u] = 1.0
    lab = cluster.absorb_small(np.array([0, 0, 0, 1, 1, 1, 2, 3]), [0, 1], a)
    assert lab[6] == lab[7] == lab[5] and lab[0] != lab[5]


def test_options_in_sections(tmp_path):
    pytest.importorskip("yaml")
    path = tmp_path / "c.yaml"
    path.write_text("seed: 1\nfeatures:\n  smoothing_window: 2\n  use_market_access: true\ngraph:\n  k: 9\ninterpretation:\n  fca_min_extent: 4\n")
    c = Config.from_yaml(path)
    assert (c.smoothing_window, c.knn, c.min_extent, c.blocks) == (2, 9, 4, ("structure", "level", "rhythm", "market"))
    path.write_text("knn: 3\nnonesuch: 1\n")
    with pytest.raises(ValueError):
        Config.from_yaml(path)


def test_bundle_and_digests(spark, tmp_path):
    import hashlib

    from veldt.sources import panel

    d = spark.createDataFrame([(1, 2.5), (2, None)], "id long, v double")
    panel.write_bundle({"a": d}, str(tmp_path), "json")
    assert panel.read_bundle(spark, str(tmp_path), ["a"], "json")["a"].count() == 2
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "f.bin").write_bytes(b"abc")
    want = spark.createDataFrame([("f.bin", hashlib.sha256(b"abc").hexdigest()), ("g.bin", "0")], "name string, sha256 string")
    assert {r["name"]: r["ok"] for r in panel.verified(panel.file_digests(spark, str(tmp_path / "x")), want).collect()} == {"f.bin": True, "g.bin": False}


def test_p_values():
    assert stats.upper_gamma(0.5, 3.841458820694124 / 2) == pytest.approx(0.05, abs=1e-9)
    assert stats.upper_gamma(5, 18.307038053275146 / 2) == pytest.approx(0.05, abs=1e-9)
    assert stats.upper_gamma(2, 0) == 1


def test_serving(spark):
    p = spark.createDataFrame([(1, "Riga"), (2, "Turin"), (3, "riff")], "id long, name string")
    assert [r["id"] for r in serve.search(p, F.col("name"), "ri").collect()] == [1, 3, 2]
    assert serve.search(p, F.col("name"), "r").count() == 0
    h = serve.histogram(spark.createDataFrame([(1.0,), (1.0,)], "v double"), "v", 4)
    assert [r["n"] for r in h.orderBy("bin").collect()] == [2, 0, 0, 0]


def test_kernels_hold_no_table_of_pairs():
    """3000 nodes: less memory than one 3000 x 3000 table of doubles, right groups, the same from a table of weights; and any cut shared."""
    import tracemalloc

    rng = np.random.default_rng(5)
    n, lab = 3000, np.repeat([0, 1, 2], 1000)
    x = rng.normal(size=(n, 4))
    x[np.arange(n), lab] += 9
    src = np.repeat(np.arange(n), 6)
    dst = (lab[src] * 1000 + rng.integers(0, 1000, len(src))).astype(int)
    pairs = np.unique(np.c_[np.r_[src, dst], np.r_[dst, src]][np.r_[src, dst] != np.r_[dst, src]], axis=0)
    net = cluster.Links(n, pairs[:, 0], pairs[:, 1], np.ones(len(pairs)))
    same = lambda found: len({(a, b) for a, b in zip(lab.tolist(), found.tolist(), strict=True)}) == 3
    tracemalloc.start()
    for name in ("ward", "spectral", "leiden"):
        assert same(cluster.METHODS[name](x, net, 3, 0)), name
    cluster.sefnac(x, net, 3)
    assert len(np.unique(cluster.dmon(x, net, 3, 0, epochs=3))) <= 3
    cluster.Kernel(x) @ np.ones((n, 2))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 8 * n * n
    part = np.arange(0, n, 5)
    some, table = net.among(part), np.zeros((n, n))
    table[pairs[:, 0], pairs[:, 1]] = 1
    assert (some @ np.eye(len(part)) == table[np.ix_(part, part)]).all()
    for name in ("spectral", "sefnac", "ward"):
        for k, found in zip((2, 4), cluster.CUTS[name](x[part], some, [2, 4], 0), strict=True):
            assert (found == cluster.METHODS[name](x[part], table[np.ix_(part, part)], k, 0)).all(), name


def test_leading_vectors_are_those_of_the_whole_decomposition():
    rng = np.random.default_rng(6)
    q = np.linalg.qr(rng.normal(size=(1300, 1300)))[0]
    values = np.r_[np.linspace(-0.5, 0.8, 1290), 0.9, 0.92, 0.95, 0.95, 0.97, 0.98, 1, 1, 1, 1]
    m = (q * values) @ q.T
    found = cluster._found(cluster.leading(1300, 8), lambda v: m @ v)
    assert np.abs(found.T @ found - np.eye(8)).max() < 1e-8 and np.abs(m @ found - found * values[-8:]).max() < 1e-6


def test_indices_do_not_depend_on_blocks(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(70, 3))
    vectors = spark.createDataFrame([(i, x[i].tolist()) for i in range(70)], "id long, x array<double>")
    runs = {f"m|-|{k}": rng.integers(0, k, 70) for k in (1, 2, 5)}
    labels = spark.createDataFrame([(key, i, int(v)) for key, lab in runs.items() for i, v in enumerate(lab)], "key string, id long, label long")
    edges = {"g": spark.createDataFrame([(i, (i + 1) % 70, 1.0) for i in range(70)] + [((i + 1) % 70, i, 1.0) for i in range(70)], "src long, dst long, w double")}
    told = lambda df: {(r["key"], r["index"], r["graph"]): r["value"] for r in df.collect()}
    whole, cut = told(experiments.grid_indices(labels, vectors, edges)), told(experiments.grid_indices(labels, vectors, edges, block=9, most=6))
    assert whole.keys() == cut.keys() and len(whole) == 3 * 8
    for key, v in whole.items():
        assert (v is None and cut[key] is None) or v == pytest.approx(cut[key], abs=1e-12), key
    far = np.linalg.norm(x[:, None] - x[None], axis=2)
    for key, lab in runs.items():
        if len(set(lab)) < 2:
            assert whole[key, "SW", "-"] is None
            continue
        width = []
        for i in range(70):
            mean = {c: far[i, (lab == c) & (np.arange(70) != i)] for c in set(lab.tolist())}
            a, b = mean[lab[i]].mean(), min(v.mean() for c, v in mean.items() if c != lab[i])
            width.append((b - a) / max(a, b))
        assert whole[key, "SW", "-"] == pytest.approx(np.mean(width), abs=1e-9)

"""Registered queries against their DuckDB text on the driver's small tables; skipped where these are missing."""

import math
import os

import pytest

FOLDER = os.environ.get("TESTDATA", "/root/testdata/sf0.01")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")
PICK = (
    "clr_relative", "rhythm", "standardised_features", "lagged_corr", "hybrid_graph", "multiplex_graph", "local_clustering",
    "silhouette", "s_dbw", "avi_avu", "nmi", "rank_table", "viterbi", "lifecycle_events", "kruskal_wallis", "delta_stability", "fair_index_mean",
    "both_ends", "components", "market_access", "code_or_name_match", "search", "kemeny", "dtw_similarity", "feature_kernel", "graph_properties", "block_null", "null_pvalue", "lambda_fit", "slice_nmi",
    "describe_types", "strict_panel", "strict_shares", "run_indices", "grid_indices", "candidates", "wins", "cross_index", "types_by_level", "nearest_type", "graph_sensitivity", "switch_sensitivity",
    "monthly_graphs", "network_emissions", "external_bundle", "movers_from", "summary", "key_parts", "plane",
    *[f"regions_by_{m}" for m in ("kmeans", "gmm", "ward", "spectral", "leiden", "attributed_spectral", "sefnac", "dmon", "distributed_kmeans")],
)


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for name in os.listdir(FOLDER):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{FOLDER}/{name}'")
    return con


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return "null"
    return f"{float(value):.9g}" if isinstance(value, (int, float)) else str(value)


@pytest.mark.parametrize("name", PICK)
def test_query_matches_sql(spark, duck, name):
    from veldt.plans import chained, recovered  # noqa: F401
    from veldt.plans.queries import ORACLE, QUERIES

    got = QUERIES[name](spark, FOLDER)
    want = duck.execute(ORACLE[name])
    columns = sorted(c[0] for c in want.description)
    assert sorted(got.columns) == columns
    order = [[c[0] for c in want.description].index(c) for c in columns]
    expected = sorted(tuple(plain(r[i]) for i in order) for r in want.fetchall())
    assert sorted(tuple(plain(r[c]) for c in columns) for r in got.collect()) == expected


def test_every_oracle_has_a_query():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0

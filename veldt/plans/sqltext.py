"""DuckDB text of the intermediate tables, put together by name."""

from __future__ import annotations

import re

CATS = ("automobile", "building", "furniture", "household")
SHARES = (*CATS, "other")
RESID = (*CATS, "total")

CTES: dict[str, str] = {}

CTES["panel"] = """
SELECT c_nationkey::BIGINT AS entity, strftime(o_orderdate, '%Y-%m') AS period, c_mktsegment AS category, sum(o_totalprice) AS value
FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL"""
CTES["wide_all"] = "SELECT entity, period, " + ", ".join(f"coalesce(sum(value) FILTER (category = '{c.upper()}'), 0) AS {c}" for c in CATS) + ", sum(value) AS total FROM panel GROUP BY ALL"
# the last month still runs; of the closed ones an entity must have all
CTES["closed"] = "SELECT * FROM wide_all WHERE period < (SELECT max(period) FROM wide_all)"
CTES["wide"] = "SELECT * FROM closed WHERE entity IN (SELECT entity FROM closed GROUP BY entity HAVING count(DISTINCT period) >= (SELECT count(DISTINCT period) FROM closed))"
CTES["rolled"] = "SELECT * FROM (SELECT entity, period, " + ", ".join(f"sum({c}) OVER w AS {c}" for c in RESID) + ", count(*) OVER w AS n FROM wide WINDOW w AS (PARTITION BY entity ORDER BY period ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)) WHERE n = 3"
CTES["raw_shares"] = "SELECT entity, period, total, " + ", ".join(f"{c} / total AS {c}" for c in CATS) + ", 1 - (" + " + ".join(f"{c} / total" for c in CATS) + ") AS other FROM rolled"
CTES["floored"] = "SELECT entity, period, total, " + ", ".join(f"greatest({c}, 0.002) AS {c}" for c in SHARES) + ", " + " + ".join(f"greatest({c}, 0.002)" for c in SHARES) + " AS s FROM raw_shares"
CTES["shares"] = "SELECT entity, period, total, " + ", ".join(f"{c} / s AS {c}" for c in SHARES) + " FROM floored"
_MEAN = "(" + " + ".join(f"ln({c})" for c in SHARES) + ") / 5"
CTES["clr0"] = "SELECT entity, period, " + ", ".join(f"ln({c}) - {_MEAN} AS clr_{c}" for c in SHARES) + " FROM shares"
CTES["clr"] = "SELECT entity, period, " + ", ".join(f"clr_{c} - median(clr_{c}) OVER (PARTITION BY period) AS clr_{c}" for c in SHARES) + " FROM clr0"
CTES["level"] = "SELECT entity, period, ln(total / 3) - median(ln(total / 3)) OVER (PARTITION BY period) AS level FROM shares"
CTES["r0"] = "SELECT entity, period, substr(period, 6, 2)::INT AS month, ln(total) - median(ln(total)) OVER (PARTITION BY period) AS r, dense_rank() OVER (ORDER BY period) AS t FROM wide"
CTES["r1"] = "SELECT entity, month, r - avg(r) OVER (PARTITION BY entity) AS r, t - (SELECT avg(t) FROM (SELECT DISTINCT t FROM r0)) AS t FROM r0"
CTES["prof"] = "SELECT entity, month, avg(r) AS p FROM r1 GROUP BY ALL"
CTES["slope"] = "SELECT entity, sum(r * t) / sum(t * t) AS slope FROM r1 GROUP BY entity"
CTES["rhythm"] = """
SELECT a.entity, amplitude, summer, volatility
FROM (SELECT entity, stddev_samp(p) AS amplitude, avg(p) FILTER (month IN (6, 7, 8)) - avg(p) AS summer FROM prof GROUP BY entity) a
JOIN (SELECT entity, stddev_samp(r - p - slope * t) AS volatility FROM r1 JOIN prof USING (entity, month) JOIN slope USING (entity) GROUP BY entity) b USING (entity)"""
FEATURES = (*[f"clr_{c}" for c in SHARES], "level", "amplitude", "summer", "volatility")
WEIGHT = {**{f"clr_{c}": "1.0 / sqrt(5.0)" for c in SHARES}, "level": "1.0", **{c: "0.6 / sqrt(3.0)" for c in ("amplitude", "summer", "volatility")}}
CTES["feat"] = "SELECT * FROM clr JOIN level USING (entity, period) JOIN rhythm USING (entity)"
CTES["features"] = "SELECT entity, period, " + ", ".join(f"({c} - avg({c}) OVER ()) / (stddev_pop({c}) OVER () + 1e-9) * {WEIGHT[c]} AS {c}" for c in FEATURES) + " FROM feat"
CTES["profile"] = "SELECT entity, " + ", ".join(f"avg({c}) AS {c}" for c in FEATURES) + " FROM features GROUP BY entity"
CTES["pvec"] = "SELECT entity AS id, [" + ", ".join(FEATURES) + "]::DOUBLE[] AS x FROM profile"
CTES["fvec"] = "SELECT entity, period, [" + ", ".join(FEATURES) + "]::DOUBLE[] AS x FROM features"
CTES["resid"] = "SELECT entity, period, " + ", ".join(f"ln(greatest({c}, 1)) - median(ln(greatest({c}, 1))) OVER (PARTITION BY period) AS {c}" for c in RESID) + " FROM wide"
# standardised residuals of the whole series, one row per entity, category and position
CTES["ztidy"] = " UNION ALL ".join(f"SELECT entity AS id, {i} AS c, row_number() OVER (PARTITION BY entity ORDER BY period) AS t, ({c} - avg({c}) OVER (PARTITION BY entity)) / (stddev_pop({c}) OVER (PARTITION BY entity) + 1e-9) AS z FROM resid" for i, c in enumerate(RESID))
CTES["zsim"] = "SELECT a.id AS src, b.id AS dst, sum(a.z * b.z) / count(*) AS sim FROM ztidy a JOIN ztidy b ON a.c = b.c AND a.t = b.t AND a.id <> b.id GROUP BY ALL"
CTES["roads"] = "SELECT a.n_nationkey::BIGINT AS src, b.n_nationkey::BIGINT AS dst, 100.0::DOUBLE * abs(a.n_nationkey - b.n_nationkey) AS km FROM nation a JOIN nation b ON a.n_nationkey <> b.n_nationkey AND abs(a.n_nationkey - b.n_nationkey) <= 12"
CTES["road_sim"] = "SELECT src, dst, exp(-km / 300.0) AS sim FROM roads"
CTES["evec"] = "SELECT vec_id AS id, embedding::DOUBLE[] AS x, label FROM embeddings"
CTES["elabel"] = "SELECT vec_id AS id, label FROM embeddings"


def _cos(table: str) -> str:
    return f"SELECT a.id AS src, b.id AS dst, list_dot_product(a.x, b.x) / ((sqrt(list_dot_product(a.x, a.x)) + 1e-12) * (sqrt(list_dot_product(b.x, b.x)) + 1e-12)) AS sim FROM {table} a JOIN {table} b ON a.id <> b.id"


def _ranked(sims: str) -> str:
    return f"SELECT *, row_number() OVER (PARTITION BY src ORDER BY sim DESC, dst) AS rank FROM {sims}"


def _knn(ranked: str, k: int) -> str:
    return f"SELECT src, dst, max(w) AS w FROM (SELECT src, dst, sim AS w FROM {ranked} WHERE rank <= {k} AND sim > 0 UNION ALL SELECT dst, src, sim FROM {ranked} WHERE rank <= {k} AND sim > 0) GROUP BY ALL"


CTES["ecos"], CTES["pcos"] = _cos("evec"), _cos("pvec")
for _s in ("ecos", "pcos", "zsim", "road_sim"):
    CTES[f"{_s}_r"] = _ranked(_s)
CTES["eknn"], CTES["pknn"], CTES["zknn"], CTES["rknn"] = _knn("ecos_r", 15), _knn("pcos_r", 5), _knn("zsim_r", 5), _knn("road_sim_r", 5)
CTES["hsim"] = "SELECT p.src, p.dst, 0.7 * (p.sim + 1) / 2 + 0.3 * coalesce(r.sim, 0) AS sim FROM pcos p LEFT JOIN road_sim r ON p.src = r.src AND p.dst = r.dst"
CTES["hsim_r"] = _ranked("hsim")
CTES["hknn"] = _knn("hsim_r", 5)
for _g in ("pknn", "zknn", "rknn"):
    CTES[f"{_g}_d"] = f"SELECT src, sum(w) AS d FROM {_g} GROUP BY src"
    CTES[f"{_g}_n"] = f"SELECT e.src, e.dst, e.w / sqrt(greatest(a.d, 1e-12)) / sqrt(greatest(b.d, 1e-12)) AS w FROM {_g} e JOIN {_g}_d a ON e.src = a.src JOIN {_g}_d b ON e.dst = b.src"
CTES["multi"] = "SELECT src, dst, sum(w) / 3 AS w FROM (SELECT * FROM pknn_n UNION ALL SELECT * FROM zknn_n UNION ALL SELECT * FROM rknn_n) GROUP BY ALL"
# types: thirds of the mean level, 0 the highest
CTES["types"] = "SELECT entity AS id, (ntile(3) OVER (ORDER BY avg(level) DESC, entity) - 1)::BIGINT AS label FROM level GROUP BY entity"
CTES["centres"] = "SELECT label, " + ", ".join(f"avg({c}) AS {c}" for c in FEATURES) + " FROM profile JOIN types ON id = entity GROUP BY label"
CTES["cvec"] = "SELECT label, [" + ", ".join(FEATURES) + "]::DOUBLE[] AS x FROM centres"
CTES["d2"] = "SELECT p.id, c.label, power(list_distance(p.x, c.x), 2) AS d FROM pvec p, cvec c"
CTES["tau"] = "SELECT median(d) AS tau FROM (SELECT id, min(d) AS d FROM d2 GROUP BY id)"
CTES["emit"] = "SELECT entity, period, c.label AS type, -power(list_distance(f.x, c.x), 2) / (SELECT tau FROM tau) AS e FROM fvec f, cvec c"
CTES["tstep"] = "SELECT *, dense_rank() OVER (ORDER BY period) - 1 AS t FROM emit"
CTES["raw"] = "SELECT entity, period, type FROM (SELECT *, row_number() OVER (PARTITION BY entity, period ORDER BY e DESC, type) AS n FROM emit) WHERE n = 1"


def sql(select: str, recursive: str = "") -> str:
    """``select`` with every table of CTES that it needs, in order. recursive: text of further tables."""
    need: list[str] = []

    def visit(text: str) -> None:
        for name in CTES:
            if name not in need and re.search(rf"\b(FROM|JOIN|,)\s+{name}\b", text):
                visit(CTES[name])
                if name not in need:
                    need.append(name)

    visit(recursive + "\n" + select)
    # one evaluation each, in the order in which they were found to be needed
    head = [f"{n} AS MATERIALIZED ({CTES[n].strip()})" for n in need] + ([recursive] if recursive else [])
    return (f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(head) + "\n" if head else "") + select

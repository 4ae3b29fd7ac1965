"""All-pairs similarities by blocks of rows.

Vectors are dealt into blocks by a hash of the id; every unordered pair of blocks is one group,
whose product numpy takes once for both directions (measures are symmetric), and only the best
k of each row leave it. The n x n table is never made, and a group holds two blocks whatever n is.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

Measure = Callable[[np.ndarray, np.ndarray], np.ndarray]


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    unit = lambda m: m / (np.linalg.norm(m, axis=1, keepdims=True) + 1e-12)
    return unit(a) @ unit(b).T


def scalar_product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a @ b.T


def lagged(a: np.ndarray, b: np.ndarray, categories: int, lag_max: int) -> np.ndarray:
    """Best mean product over shifts, both ways averaged; rows are category series one after another."""

    def best(p: np.ndarray, q: np.ndarray) -> np.ndarray:
        p, q = p.reshape(len(p), categories, -1), q.reshape(len(q), categories, -1)
        size = p.shape[2]
        out = np.full((len(p), len(q)), -np.inf)
        for lag in range(-lag_max, lag_max + 1):
            x = p[:, :, max(0, -lag) : size - max(0, lag)]
            y = q[:, :, max(0, lag) : size - max(0, -lag)]
            out = np.maximum(out, x.reshape(len(p), -1) @ y.reshape(len(q), -1).T / (categories * (size - abs(lag))))
        return out

    return (best(a, b) + best(b, a).T) / 2


def _stack(frame: pd.DataFrame) -> np.ndarray:
    return np.array(frame["x"].tolist(), dtype=np.float64).reshape(len(frame), -1)


def blocks(vectors: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """The two sides of every pair of blocks i <= j: (i, j, id, x)."""
    n = max(1, -(-vectors.count() // size))
    own = F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    rows = vectors.select("*", own.alias("own"), other.alias("other"))

    def side(i: str, j: str) -> DataFrame:  # aliases: the two sides of a cogroup must not share columns
        return rows.where(F.col(i) <= F.col(j)).select(F.col(i).alias("i"), F.col(j).alias("j"), *[F.col(c).alias(c) for c in vectors.columns])

    return side("own", "other"), side("other", "own")


def _best(s: np.ndarray, src: np.ndarray, dst: np.ndarray, k: int) -> pd.DataFrame:
    s = np.where(src[:, None] == dst[None, :], -np.inf, s)
    m = min(k, s.shape[1])
    # stable order on ids ascending: equal similarities keep the lower id
    top = np.argsort(-s, axis=1, kind="stable")[:, :m]
    sim = np.take_along_axis(s, top, axis=1).ravel()
    out = pd.DataFrame({"src": np.repeat(src, m), "dst": dst[top.ravel()], "sim": sim})
    return out[np.isfinite(sim)]


def _trim(left: pd.DataFrame, right: pd.DataFrame, k: int, measure: Measure) -> pd.DataFrame:
    if not len(left) or not len(right):
        return pd.DataFrame({"src": np.zeros(0, np.int64), "dst": np.zeros(0, np.int64), "sim": np.zeros(0)})
    one = left["i"].iloc[0] == left["j"].iloc[0]
    left, right = left.sort_values("id"), right.sort_values("id")
    src, dst = left["id"].to_numpy(), right["id"].to_numpy()
    s = measure(_stack(left), _stack(right))
    there = _best(s, src, dst, k)
    return there if one else pd.concat([there, _best(s.T, dst, src, k)], ignore_index=True)


def top_k(vectors: DataFrame, k: int, measure: Measure = cosine, block: int = 1024) -> DataFrame:
    """vectors(id long, x array) -> (src, dst, sim, rank): the k most similar others of each, lower id first on ties."""
    a, b = blocks(vectors.select("id", "x"), block)
    found = a.groupBy("i", "j").cogroup(b.groupBy("i", "j")).applyInPandas(partial(_trim, k=k, measure=measure), "src long, dst long, sim double")
    order = Window.partitionBy("src").orderBy(F.col("sim").desc(), "dst")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _sums(d: np.ndarray, same: np.ndarray, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    names, code = np.unique(right["label"].to_numpy(), return_inverse=True)
    hot = np.eye(len(names))[code]
    sums, counts = d @ hot, (~same).astype(float) @ hot
    return pd.DataFrame({"id": np.repeat(left["id"].to_numpy(), len(names)), "label": np.tile(names, len(left)).astype(np.int64), "dist": sums.ravel(), "n": counts.ravel().astype(np.int64)})


def _label_sums(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    if not len(left) or not len(right):
        return pd.DataFrame({"id": np.zeros(0, np.int64), "label": np.zeros(0, np.int64), "dist": np.zeros(0), "n": np.zeros(0, np.int64)})
    x, y = _stack(left), _stack(right)
    d = np.sqrt(np.maximum((x**2).sum(1)[:, None] + (y**2).sum(1)[None, :] - 2 * x @ y.T, 0.0))
    same = left["id"].to_numpy()[:, None] == right["id"].to_numpy()[None, :]
    d[same] = 0.0
    there = _sums(d, same, left, right)
    return there if left["i"].iloc[0] == left["j"].iloc[0] else pd.concat([there, _sums(d.T, same.T, right, left)], ignore_index=True)


def distances_to_labels(vectors: DataFrame, block: int = 1024) -> DataFrame:
    """vectors(id, x, label) -> (id, label, dist, n): summed distance to the others of each label, and their number."""
    a, b = blocks(vectors.select("id", "x", F.col("label").cast("long").alias("label")), block)
    part = a.groupBy("i", "j").cogroup(b.groupBy("i", "j")).applyInPandas(_label_sums, "id long, label long, dist double, n long")
    return part.groupBy("id", "label").agg(F.sum("dist").alias("dist"), F.sum("n").alias("n")).where("n > 0")


def similarity_of(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """Cosine of the given (src, dst) pairs only."""
    from veldt.functions.scalars import dot, norm

    a, b = vectors.select(F.col("id").alias("src"), F.col("x").alias("xa")), vectors.select(F.col("id").alias("dst"), F.col("x").alias("xb"))
    j = pairs.join(a, "src").join(b, "dst")
    return j.select(*pairs.columns, (dot(F.col("xa"), F.col("xb")) / ((norm(F.col("xa")) + 1e-12) * (norm(F.col("xb")) + 1e-12))).alias("cos"))

"""Formal concepts: thresholds as attributes, extents, intents, stability, and short descriptions of types."""

from __future__ import annotations

from functools import partial
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: (direction, quantile) of each attribute of a numeric column, in order.
THRESHOLDS = (("ge", 0.90), ("ge", 0.75), ("ge", 0.25), ("le", 0.75), ("le", 0.25), ("le", 0.10))


def context(objects: DataFrame, columns: list[str], key: str = "id") -> DataFrame:
    """(id, attr_...): six booleans per column against its quantiles (exact, linear)."""
    cuts = objects.agg(*[F.percentile(c, F.array(F.lit(0.1), F.lit(0.25), F.lit(0.75), F.lit(0.9))).alias(f"_q_{c}") for c in columns])
    at = {0.1: 0, 0.25: 1, 0.75: 2, 0.9: 3}
    rows = objects.crossJoin(F.broadcast(cuts))  # one row
    attrs = []
    for c in columns:
        for way, q in THRESHOLDS:
            cut = F.col(f"_q_{c}")[at[q]]
            attrs.append(((F.col(c) >= cut) if way == "ge" else (F.col(c) <= cut)).alias(f"{c}_{way}_{round(q * 100)}"))
    return rows.select(F.col(key).alias("id"), *attrs)


def extent(ctx: DataFrame, attrs: list[str]) -> DataFrame:
    """Objects that have all attributes; no attribute, all objects."""
    out = ctx
    for a in attrs:
        out = out.where(F.col(a))
    return out.select("id")


def intent(ctx: DataFrame, objects: DataFrame | None) -> DataFrame:
    """(attr): attributes that all the objects share; no object, all attributes."""
    names = [c for c in ctx.columns if c != "id"]
    rows = ctx if objects is None else ctx.join(objects.select("id"), "id", "left_semi")
    one = rows.agg(*[F.coalesce(F.bool_and(c), F.lit(True)).alias(c) for c in names])
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("attr"), F.col(c).alias("has")) for c in names]))
    return one.select(pairs.alias("p")).where("p.has").select("p.attr")


def delta_stability(ctx: DataFrame, attrs: list[str]) -> DataFrame:
    """One row: extent, and the least number of objects that one more attribute outside the intent loses."""
    names = [c for c in ctx.columns if c != "id"]
    rows = ctx.join(extent(ctx, attrs), "id", "left_semi")
    one = rows.agg(F.count(F.lit(1)).alias("extent"), *[F.sum(F.col(c).cast("long")).alias(c) for c in names])
    lost = F.array_compact(F.array(*[F.when(F.col(c) < F.col("extent"), F.col("extent") - F.col(c)) for c in names]))
    return one.select("extent", F.coalesce(F.array_min(lost), F.col("extent")).alias("delta"))


def _describe(frame: pd.DataFrame, names: list[str], most: int, precision: float, least: int) -> pd.DataFrame:
    has = np.array(frame["attrs"].tolist(), dtype=bool).reshape(len(frame), -1)
    label = frame["label"].to_numpy()
    kinds = np.unique(label)
    member = (label[:, None] == kinds).astype(np.float32)
    sizes = member.sum(0)
    best: dict[int, tuple] = {}
    for size in range(1, most + 1):
        for head in combinations(range(has.shape[1]), size - 1):
            base = has[:, head].all(1) if head else np.ones(len(has), bool)
            tail = np.arange(head[-1] + 1 if head else 0, has.shape[1])
            if not len(tail):
                continue
            sets = (has[:, tail] & base[:, None]).astype(np.float32)
            extent = sets.sum(0)
            hits = sets.T @ member
            p = hits / np.maximum(extent, 1)[:, None]
            r = hits / sizes
            f1 = np.where(p + r > 0, 2 * p * r / np.maximum(p + r, 1e-30), 0)
            f1 = np.where((extent[:, None] >= least) & (p >= precision), f1, -1)
            for k, c in enumerate(kinds):
                j = int(f1[:, k].argmax())
                if f1[j, k] >= 0 and (c not in best or f1[j, k] > best[c][0] + 1e-12):
                    best[c] = (float(f1[j, k]), [*head, int(tail[j])], int(extent[j]), float(p[j, k]), float(r[j, k]))
    rows = []
    for c in kinds.tolist():
        if c not in best:
            rows.append((int(c), [], [], 0, 0.0, 0.0, 0.0, 0))
            continue
        f1, attrs, n, p, r = best[c]
        inside = has[has[:, attrs].all(1)]
        closed = inside.all(0)
        counts = inside.sum(0)
        lost = n - counts[~closed]
        rows.append((int(c), [names[a] for a in attrs], [names[a] for a in np.flatnonzero(closed)], n, p, r, f1, int(lost.min()) if len(lost) else n))
    return pd.DataFrame(rows, columns=["label", "generator", "closure", "extent", "precision", "recall", "f1", "delta"])


def describe_types(ctx: DataFrame, labels: DataFrame, most: int = 3, precision: float = 0.5, least: int = 10) -> DataFrame:
    """Best attribute set of up to ``most`` attributes per type by F1; the first in column order wins. A type that no set describes has an empty one.

    The context is packed to one array of booleans an object and searched in one task: it is
    as small as the number of analysed entities, which is the limit of this operator.
    """
    names = [c for c in ctx.columns if c != "id"]
    rows = ctx.join(labels, "id").select(F.lit(0).alias("g"), F.col("label").cast("long").alias("label"), F.array(*names).alias("attrs"))
    schema = "label long, generator array<string>, closure array<string>, extent long, precision double, recall double, f1 double, delta long"
    return rows.groupBy("g").applyInPandas(lambda f: partial(_describe, names=names, most=most, precision=precision, least=least)(f), schema)

"""The type model on a stream: each entity's best type after every new period, by the forward recursion alone.

State per entity: the last period and a score per type. A period at or before the last one
is late and is left out. Scores are kept relative to their maximum, so they never grow.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "entity long, period string, type int, margin double"
STATE = "last string, scores array<double>"


def step(scores: np.ndarray | None, e: np.ndarray, p_switch: float) -> np.ndarray:
    """Scores after one more period; a lone type never switches."""
    if scores is None:
        new = e
    else:
        k = len(e)
        move = math.log(p_switch / (k - 1)) if k > 1 else -math.inf
        new = np.maximum(scores + math.log(1 - p_switch), scores.max() + move) + e
    return new - new.max()


def online_types(emissions: DataFrame, p_switch: float = 0.03) -> DataFrame:
    """Streaming emissions(entity long, period string, e array) -> entity, period, type, margin to the runner-up."""

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, scores = (state.get[0], np.array(state.get[1])) if state.exists else ("", None)
        out = []
        rows = pd.concat(list(frames)).sort_values("period")
        for period, e in zip(rows["period"], rows["e"], strict=True):
            if period <= last:
                continue
            scores, last = step(scores, np.array(e, dtype=float), p_switch), period
            order = np.sort(scores)[::-1]
            out.append((key[0], period, int(scores.argmax()), float(order[0] - order[1]) if len(order) > 1 else 0.0))
        if scores is not None:
            state.update((last, scores.tolist()))
        yield pd.DataFrame(out, columns=["entity", "period", "type", "margin"])

    return emissions.groupBy("entity").applyInPandasWithState(update, OUT, STATE, "append", GroupStateTimeout.NoTimeout)

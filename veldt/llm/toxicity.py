"""Toxicity by subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the mean of the vectors of its character n-grams (with word boundaries), a text
the mean of its words; two softmax outputs read the text vector. A misspelt word shares
most n-grams with the word it stands for, so it lands near it without having been seen.

Training sees a bounded sample of labelled rows (``max_rows`` rows, a third at most of
label 1, and ``max_bytes`` of text, both documented parameters) on the driver; scoring runs over every text on the executors
with a model of fixed size (buckets x 8 bytes). For two classes the gradient of every
n-gram vector lies along the difference of the output vectors, so a step needs one
weighted count per bucket rather than one vector per n-gram.

Odd input: null and blank texts score by the bias alone; labels without a value, or for
ids that no document has, are not used; of an id's repeated rows the least text and the
greater label count; without labels every score is 0; repeated rows
are scored each; a null id counts as the empty text for ``held_out``; an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass
class Model:
    """pull[b]: what bucket b adds to the logit of label 1 (its vector times the output difference)."""

    pull: np.ndarray
    bias: float
    low: int = 3
    high: int = 5


def grams(word: str, buckets: int, low: int = 3, high: int = 5) -> list[int]:
    """Buckets of the word itself and its n-grams, boundaries included."""
    w = f"<{word}>"
    n, digest = len(w), xxhash.xxh3_64_intdigest
    return [digest(w) % buckets] + [digest(w[i : i + k]) % buckets for k in range(low, min(high, n - 1) + 1) for i in range(n - k + 1)]


def _bag(text: str, buckets: int, seen: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a text and their shares in the mean of means."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.int32), np.zeros(0, np.float32)
    ids, shares = [], []
    for w in words:
        g = seen.get(w)
        if g is None:
            g = seen[w] = np.array(grams(w, buckets), dtype=np.int32)
        ids.append(g)
        shares.append(len(g))
    flat = np.concatenate(ids)
    weight = np.repeat(1.0 / np.array(shares), shares) / len(words)
    kept, back = np.unique(flat, return_inverse=True)
    return kept.astype(np.int32), np.bincount(back, weight).astype(np.float32)


def fit(texts: list[str], labels: list[int], prior: float, buckets: int = 1 << 15, dim: int = 8, epochs: int = 30, batch: int = 128, rate: float = 0.08, decay: float = 2e-5, seed: int = 11) -> Model:
    """Adam on n-gram vectors and output vectors together; ``prior`` is the share of label 1 to calibrate to.

    ``decay`` had the least log loss of five values on a quarter of the training rows, the model being fitted on the others.
    """
    y = np.array(labels, dtype=np.float64)
    if not len(y) or y.min() == y.max():
        return Model(np.zeros(buckets), -np.inf if not len(y) or not y[0] else 4.0)
    seen: dict[str, np.ndarray] = {}
    bags = [_bag(t, buckets, seen) for t in texts]
    del seen
    weight = np.where(y > 0, prior / y.mean(), (1 - prior) / (1 - y.mean()))
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1.0 / dim, 1.0 / dim, (buckets, dim))
    out = rng.normal(0, 0.5, (dim, 2))
    bias = np.array([0.0, np.log(prior / (1 - prior))])
    params = [vectors.astype(np.float32), out.astype(np.float32), bias.astype(np.float32)]
    vectors, out, bias = params
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    step = 0
    epochs = max(epochs, min(200, 600 * batch // len(y)))  # small samples: as many steps
    for epoch in range(epochs):
        order = rng.permutation(len(y))
        pace = rate * (1 - epoch / epochs)
        for at in range(0, len(y), batch):
            pick = order[at : at + batch]
            ids = np.concatenate([bags[i][0] for i in pick])
            share = np.concatenate([bags[i][1] for i in pick])
            row = np.repeat(np.arange(len(pick)), [len(bags[i][0]) for i in pick])
            logits = np.stack([np.bincount(row, share * (vectors @ out[:, c])[ids], minlength=len(pick)) for c in (0, 1)], axis=1) + bias
            logits -= logits.max(axis=1, keepdims=True)
            prob = np.exp(logits)
            prob /= prob.sum(axis=1, keepdims=True)
            err = prob.copy()
            err[np.arange(len(pick)), y[pick].astype(int)] -= 1
            err *= weight[pick, None] / len(pick)
            # per bucket: sum over texts of share x error, for each output
            pulled = np.stack([np.bincount(ids, share * err[row, c], minlength=buckets) for c in (0, 1)], axis=1).astype(np.float32)
            grads = [pulled @ out.T + decay * vectors, vectors.T @ pulled, err.sum(axis=0)]
            step += 1
            for k, (p, g) in enumerate(zip(params, grads, strict=True)):
                m[k] += 0.1 * (g - m[k])
                v[k] += 0.001 * (g * g - v[k])
                p -= pace * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-9)
    return Model((vectors @ (out[:, 1] - out[:, 0])).astype(np.float64), float(bias[1] - bias[0]))


def score(text: str | None, model: Model, seen: dict[str, float]) -> float:
    words = (text or "").lower().split()
    total, pull = 0.0, model.pull
    for w in words:
        s = seen.get(w)
        if s is None:
            if len(seen) > 300_000:
                seen.clear()
            g = grams(w, len(pull), model.low, model.high)
            s = seen[w] = float(pull[g].mean())
        total += s
    logit = model.bias + (total / len(words) if words else 0.0)
    return 1.0 / (1.0 + np.exp(-logit)) if logit > -700 else 0.0


def _scores(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    seen: dict[str, float] = {}
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            s = [float(score(t, model, seen)) for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(s, pa.float64()), pa.array([int(x >= 0.5) for x in s], pa.int32())], names=["doc_id", "held_out", "score", "predicted"])


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text is divisible by 5."""
    return F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "UTF-8")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 6000, max_bytes: int = 48 << 20, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """Model of a bounded sample of the labelled rows that aren't held out.

    Rows come in a seeded order of their ids, of each label; those whose text no longer fits
    in the label's part of ``max_bytes`` (a third for label 1) are passed over.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col(doc_id).isNotNull() & ~held_out(F.col(doc_id))).groupBy(F.col(doc_id).alias("_id")).agg(F.max(F.col(label).cast("int")).alias("_y"))
    counts = {r["_y"]: r["count"] for r in known.groupBy("_y").count().collect()}
    order = F.xxhash64(F.col("_id").cast("string"), F.lit("toxicity"))
    sample = known.where("_y = 1").orderBy(order, "_id").limit(max_rows // 3).union(known.where("_y = 0").orderBy(order, "_id").limit(max_rows - max_rows // 3))
    texts = docs.select(F.col(doc_id).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    found = texts.join(F.broadcast(sample), "_id")
    sizes = found.groupBy("_id", "_y").agg(F.max(F.octet_length("t")).alias("n")).select("_id", "_y", "n", order.alias("o")).collect()
    room, chosen = {1: max_bytes // 3, 0: max_bytes - max_bytes // 3}, []
    for r in sorted(sizes, key=lambda r: (r["o"], r["_id"])):
        if r["n"] <= room[r["_y"]]:
            room[r["_y"]] -= r["n"]
            chosen.append((r["_id"], r["_y"]))
    if not chosen:
        return fit([], [], 0.0)
    picked = docs.sparkSession.createDataFrame(chosen, f"_id {known.schema['_id'].dataType.simpleString()}, _y int")
    rows = texts.join(F.broadcast(picked), "_id").groupBy("_id", "_y").agg(F.min("t").alias("t")).collect()
    rows.sort(key=lambda r: r["_id"])
    return fit([r["t"] for r in rows], [r["_y"] for r in rows], counts.get(1, 0) / sum(counts.values()))


def classify(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), held_out(F.col(doc_id)).alias("held_out"), F.col(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(partial(_scores, model=model), f"doc_id {kind}, held_out boolean, score double, predicted int")

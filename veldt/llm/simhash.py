"""SimHash near-dedup with a Gray-order hierarchical index.

Fingerprints are 64 majority bits over the XXH64 values of a text's word shingles.
Distinct fingerprints within ``distance`` bits are linked and components are formed.

Search. Of ``distance + 1`` disjoint bit segments a linked pair agrees in at least one,
so each distinct fingerprint goes to one bucket per segment. A bucket of more than
``most`` fingerprints is cut again by segments of the bits that are left, until so few
are left that a bucket is bounded by their combinations: no task holds an unbounded
group, and no block meets every other. Inside a bucket fingerprints are sorted by Gray rank; runs of eight become a node that keeps
the bits all members share (mask and pattern), runs of eight nodes a node above, up to
one root. A query descends from the root adding up the differences on the bits that
each node newly fixes and drops the whole group once they exceed the distance. Every
bucket answers with links to one local root per fingerprint, never with all pairs.

Odd input: null and blank texts have fingerprint 0 and are linked like any other;
repeated rows and equal texts share a fingerprint; null ids never become a component
id unless all ids of the component are null; an empty table gives an empty result;
extra columns are ignored. :mod:`veldt.llm.near_copies` drops near copies with this index.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veldt.llm.common import scratch, written
from veldt.llm.components import components

FANOUT = 8
BITS = 64


def fingerprint(text: str | None, size: int = 3, seed: int = 42) -> int:
    """Majority bits over all shingles (A-Z lower-cased, repeats included), unsigned."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z and the six spaces
    if not w:
        return 0
    grams = map(b" ".join, zip(*[w[i:] for i in range(size)], strict=False)) if len(w) >= size else [b" ".join(w)]
    digest = xxhash.xxh64_intdigest
    return majority(np.array([digest(g, seed) for g in grams], dtype=np.uint64))


def majority(h: np.ndarray) -> int:
    """64 bits, each set if it is in over half the hashes."""
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(h), 1 << 15):
        piece = h[at : at + (1 << 15)]
        ones += np.unpackbits(piece.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch], size: int, seed: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 512):  # texts become Python strings a few at a time
            part = batch.slice(at, 512)
            fps = np.array([fingerprint(t, size, seed) for t in part.column("text").to_pylist()], dtype=np.uint64)
            cols = [part.column(i) for i in range(part.num_columns) if part.schema.names[i] != "text"]
            names = [n for n in part.schema.names if n != "text"]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(fps.view(np.int64))], names=[*names, "fp"])


def fingerprints(df: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 3, seed: int = 42) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long)."""
    rows = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(partial(_fingerprints, size=size, seed=seed), f"doc_id {kind}, fp long")


# ---- the index -------------------------------------------------------------------------


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Position of each code in the reflected Gray sequence (prefix exclusive-or of the bits)."""
    r = codes.copy()
    for s in (1, 2, 4, 8, 16, 32):
        r ^= r >> np.uint64(s)
    return r


class GrayIndex:
    """Hierarchy of masked patterns over codes sorted by (bucket, Gray rank)."""

    def __init__(self, codes: np.ndarray, bucket: np.ndarray):
        self.codes = codes
        self.start = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(codes) else np.zeros(0, int)
        sizes = np.diff(np.r_[self.start, len(codes)])
        self.sizes = sizes
        self.first = [np.arange(len(codes))]  # first leaf of every node, by level
        self.last = [np.arange(len(codes))]
        self.child = [None]  # first child of every node, and one past its last
        self.ones, self.any = [codes], [codes]
        starts, counts = self.start, sizes  # of each bucket's nodes in the level below
        while len(counts) and counts.max() > 1:
            up = -(-counts // FANOUT)
            top = np.r_[0, np.cumsum(up)]
            owner = np.repeat(np.arange(len(up)), up)
            lo = starts[owner] + FANOUT * (np.arange(top[-1]) - top[owner])
            hi = np.minimum(lo + FANOUT, (starts + counts)[owner])
            self.child.append((lo, hi))
            self.ones.append(np.bitwise_and.reduceat(self.ones[-1], lo))
            self.any.append(np.bitwise_or.reduceat(self.any[-1], lo))
            self.first.append(self.first[-1][lo])
            self.last.append(self.last[-1][hi - 1])
            starts, counts = top[:-1], up
        self.roots = starts

    def shared(self, level: int, node: np.ndarray) -> np.ndarray:
        return ~(self.ones[level][node] ^ self.any[level][node])

    def links(self, distance: int, step: int = 1 << 17) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (i < j) of positions in one bucket whose codes differ in at most ``distance`` bits."""
        top = len(self.child) - 1
        busy = np.flatnonzero(self.sizes > 1)
        if not len(busy):
            return
        query = np.concatenate([np.arange(self.start[b], self.start[b] + self.sizes[b]) for b in busy]) if len(busy) < 64 else np.flatnonzero(np.repeat(self.sizes > 1, self.sizes))
        bucket = np.repeat(np.arange(len(self.sizes)), self.sizes)[query]
        cost = np.cumsum(self.sizes[bucket])
        cuts = np.searchsorted(cost, np.arange(step, cost[-1] + step, step), side="left")
        at = 0
        for cut in [*cuts, len(query)]:
            cut = max(int(cut), min(at + 1, len(query)))
            if cut <= at:
                continue
            q, node = query[at:cut], self.roots[bucket[at:cut]]
            at = cut
            fixed = self.shared(top, node)
            acc = np.bitwise_count((self.codes[q] ^ self.ones[top][node]) & fixed)
            for level in range(top, 0, -1):
                keep = (acc <= distance) & (self.last[level][node] > q)
                q, node, acc, fixed = q[keep], node[keep], acc[keep], fixed[keep]
                lo, hi = self.child[level][0][node], self.child[level][1][node]
                n = hi - lo
                q, acc, fixed = np.repeat(q, n), np.repeat(acc, n), np.repeat(fixed, n)
                node = np.repeat(lo - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(len(q))
                now = self.shared(level - 1, node)
                acc = acc + np.bitwise_count((self.codes[q] ^ self.ones[level - 1][node]) & now & ~fixed)
                fixed = now
            keep = (acc <= distance) & (node > q)
            yield q[keep], node[keep]


def _local_roots(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Least position of each position's component."""
    label = np.arange(n)
    for a, b in pairs:
        while len(a):
            la, lb = label[a], label[b]
            open_ = la != lb
            a, b, la, lb = a[open_], b[open_], la[open_], lb[open_]
            if not len(a):
                break
            np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
            while True:
                up = label[label]
                if np.array_equal(up, label):
                    break
                label = up
    return label


def _bucket_links(frames: Iterator[pd.DataFrame], distance: int, rows: int = 1 << 17) -> Iterator[pd.DataFrame]:
    """Buckets come whole, one after another (sorted by bucket): links fp -> local root."""
    rest: pd.DataFrame | None = None

    def solve(f: pd.DataFrame) -> pd.DataFrame:
        fp = f["fp"].to_numpy().view(np.uint64)
        bucket = f["bucket"].to_numpy()
        order = np.lexsort((gray_rank(f["rest"].to_numpy().view(np.uint64)), bucket))  # the bits that are not shared
        root = _local_roots(len(fp), GrayIndex(fp[order], bucket[order]).links(distance))
        linked = np.flatnonzero(root != np.arange(len(root)))
        signed = fp[order].view(np.int64)
        return pd.DataFrame({"a": signed[linked], "b": signed[root[linked]]})

    for frame in frames:
        f = frame if rest is None else pd.concat([rest, frame], ignore_index=True)
        rest = f
        if len(f) >= rows:
            end = int(np.searchsorted(f["bucket"].to_numpy(), f["bucket"].iloc[-1], side="left"))
            if end:
                yield solve(f.iloc[:end])
                rest = f.iloc[end:].reset_index(drop=True)
    if rest is not None and len(rest):
        yield solve(rest)


#: Bits that may be left in a bucket of any size: at most 2^13 fingerprints differ in them.
FEW_BITS = 13


def _cut(rows: DataFrame, parts: int) -> DataFrame:
    """Each row once per segment of the ``r`` bits left: bucket takes up the segment's value, rest and r lose it."""
    at = rows.select("fp", "rest", "r", "bucket", F.explode(F.array(*[F.lit(k) for k in range(parts)])).alias("k"))
    at = at.select("*", F.expr(f"int(r * k div {parts})").alias("a"), F.expr(f"int(r * (k + 1) div {parts})").alias("b"))
    value = F.expr("shiftrightunsigned(rest, a) & (shiftleft(1L, b - a) - 1)")
    low, high = F.expr("rest & (shiftleft(1L, a) - 1)"), F.expr(f"if(b < {BITS}, shiftleft(shiftrightunsigned(rest, b), a), 0L)")
    return at.select("fp", low.bitwiseOR(high).alias("rest"), F.expr("r - (b - a)").alias("r"), F.xxhash64("bucket", "k", value).alias("bucket"))


def links(fps: DataFrame, distance: int = 2, most: int = 2048) -> DataFrame:
    """fps(fp), distinct -> links (a, b) that connect exactly what pairs within ``distance`` bits connect."""
    rows = fps.select("fp", F.col("fp").alias("rest"), F.lit(BITS).alias("r"), F.lit(0).cast("long").alias("bucket"))
    parts, left, calm = distance + 1, BITS, []
    while left > FEW_BITS:
        rows = _cut(rows, parts)
        left -= left // parts
        hot = written(rows.groupBy("bucket").count().where(F.col("count") > most).select("bucket"), "crowded")
        if hot.isEmpty():
            break
        calm.append(rows.join(hot, "bucket", "left_anti").select("fp", "rest", "bucket"))
        rows = rows.join(hot, "bucket", "left_semi").select("fp", "rest", "r", "bucket")
    dealt = rows.select("fp", "rest", "bucket")
    for c in calm:
        dealt = dealt.union(c)
    dealt = dealt.repartition("bucket").sortWithinPartitions("bucket")
    return dealt.mapInPandas(partial(_bucket_links, distance=distance), "a long, b long").distinct()


def classes(df: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 3, distance: int = 2, seed: int = 42) -> DataFrame:
    """One row per input row: doc_id, fp, component_id (least doc_id reachable)."""
    with scratch(df.sparkSession):
        docs = written(fingerprints(df, doc_id, text, size, seed), "simhash-docs", keep=True)
        fps = written(docs.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-distinct")
        roots = components(links(fps.select("fp"), distance))
        rooted = fps.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
        least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
        named = written(rooted.join(least, "root").select("fp", "component_id"), "simhash-named", keep=True)
    return docs.join(named, "fp").select("doc_id", "fp", "component_id")

"""Winnowed anchors: how texts that share a long enough run of symbols find each other.

A text is a sequence of symbols (words or bytes). Every run of ``gram`` symbols has a
rolling hash; a window of ``span`` symbols holds ``span - gram + 1`` of them and is
assigned to the least. Windows one after another with the same least value form a
*domain*, one row of the anchor table. Equal windows have equal least values, so they
lie in domains with the same anchor, wherever they are: nothing is sampled and nothing
is lost. A domain that occurs twice as a whole is repeated throughout (wholes are told
apart by two 64-bit hashes); only anchors that meet in *different* domains (the ends of
repeats) need a look at the symbols. A seed that very many different domains share is
lengthened until its stretches fit a task.

The steps here are common to the two substring operators; each brings its own unit and
its own kernel for the undecided groups.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veldt.llm.common import scratch, written

ODD = np.uint64(0x9E3779B97F4A7C15)
MASK = (1 << 64) - 1


class Words:
    """Symbols are words, compared as they are."""

    def __init__(self, span: int, gram: int):
        self.span, self.gram, self._seen = span, gram, {}

    def parse(self, raw: bytes) -> tuple[np.ndarray, bytes, list[bytes]]:
        """Symbol values, the buffer that domain digests read (8 bytes a symbol), and the symbols."""
        parts, seen, digest = raw.split(), self._seen, xxhash.xxh3_64_intdigest
        if len(seen) > 400_000:
            seen.clear()
        values = []
        for w in parts:
            v = seen.get(w)
            if v is None:
                v = seen[w] = digest(w)
            values.append(v)
        symbols = np.array(values, dtype=np.uint64)
        return symbols, symbols.tobytes(), parts

    width = 8

    @staticmethod
    def piece(parts: list[bytes], a: int, b: int) -> bytes:
        return b" ".join(parts[a:b])

    @staticmethod
    def units(piece: bytes) -> list[bytes]:
        return piece.split()


class Bytes:
    """Symbols are UTF-8 bytes."""

    def __init__(self, span: int, gram: int):
        self.span, self.gram = span, gram

    def parse(self, raw: bytes) -> tuple[np.ndarray, bytes, bytes]:
        return np.frombuffer(raw, dtype=np.uint8).astype(np.uint64) + np.uint64(1), raw, raw

    width = 1

    @staticmethod
    def piece(parts: bytes, a: int, b: int) -> bytes:
        return parts[a:b]

    @staticmethod
    def units(piece: bytes) -> bytes:
        return piece


def gram_hashes(symbols: np.ndarray, k: int) -> np.ndarray:
    """Mixed polynomial hash of every run of k symbols, by doubling."""
    have, power, length = symbols * np.uint64(0xC2B2AE3D27D4EB4F), ODD, 1
    out, done = None, 0
    left = k
    while left:
        if left & 1:
            if out is None:
                out, done = have, length
            else:
                m = len(symbols) - done - length + 1
                out = out[:m] * power + have[done : done + m]
                done += length
        left >>= 1
        if left:
            have = have[:-length] * power + have[length:]
            with np.errstate(over="ignore"):
                power = power * power
            length *= 2
    out = out ^ (out >> np.uint64(29))
    out = out * np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(32))


def domains(symbols: np.ndarray, span: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """anchor, first window, windows, and whether the anchor's gram occurs twice inside (a text that overlaps itself).

    A domain has as many windows as hold one gram at most; longer runs of one value (a text
    of short period) are several domains, so no stretch grows with its text.
    """
    none = np.zeros(0, dtype=np.int64)
    if len(symbols) < span:
        return none.astype(np.uint64), none, none, none.astype(bool)
    with np.errstate(over="ignore"):
        h = gram_hashes(symbols, gram)
    low, w, width = h, 1, span - gram + 1
    while 2 * w <= width:
        low = np.minimum(low[:-w], low[w:])
        w *= 2
    if width > w:
        low = np.minimum(low[: len(low) - (width - w)], low[width - w :])
    at = np.flatnonzero(np.r_[True, low[1:] != low[:-1]])
    n = np.diff(np.r_[at, len(low)])
    if n.max() > width:
        parts = -(-n // width)
        step = width * (np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts))
        n = np.minimum(width, np.repeat(n, parts) - step)
        at = np.repeat(at, parts) + step
    anchor = low[at]
    # does the anchor's gram occur again in reach of the domain's windows? only where a value repeats at all
    twice = np.zeros(len(at), dtype=bool)
    ordered = np.sort(h)
    repeated = ordered[1:][ordered[1:] == ordered[:-1]]
    if len(repeated):
        for d in np.flatnonzero(np.isin(anchor, repeated)).tolist():
            twice[d] = np.count_nonzero(h[at[d] : at[d] + n[d] - 1 + width] == anchor[d]) > 1
    return anchor, at, n, twice


def row_key(raw: bytes) -> int:
    return xxhash.xxh3_64_intdigest(raw) - (1 << 63)


def _texts(batch: pa.RecordBatch, step: int = 256) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    for at in range(0, batch.num_rows, step):
        part = batch.slice(at, step)
        texts = part.column("text").cast(pa.binary()).to_pylist()
        yield part, [t or b"" for t in texts]


def _anchor_rows(batches: Iterator[pa.RecordBatch], unit) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, texts in _texts(batch):
            cols: list[list[np.ndarray]] = [[] for _ in range(7)]
            for i, raw in enumerate(texts):
                symbols, buffer, _ = unit.parse(raw)
                v, at, n, twice = domains(symbols, unit.span, unit.gram)
                if not len(v):
                    continue
                w, digest = unit.width, xxhash.xxh3_64_intdigest
                view = memoryview(buffer)
                g = np.array([digest(view[w * a : w * (a + m - 1 + unit.span)]) for a, m in zip(at.tolist(), n.tolist(), strict=True)], dtype=np.uint64)
                for col, x in zip(cols, (np.full(len(v), i), v.view(np.int64), g.view(np.int64), np.full(len(v), row_key(raw), dtype=np.int64), at, n, twice), strict=True):
                    col.append(x)
            if cols[0]:
                row, *rest = [np.concatenate(c) for c in cols]
                ids = part.column("doc_id").take(pa.array(row))
                yield pa.RecordBatch.from_arrays([ids, *[pa.array(x) for x in rest[:3]], pa.array(rest[3].astype(np.int32)), pa.array(rest[4].astype(np.int32)), pa.array(rest[5])], names=["doc_id", "v", "g", "k", "at", "n", "twice"])


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts compressed one by one, so that the shuffles that bring them to their marks stay small."""
    zip_ = zstandard.ZstdCompressor(level=1, write_content_size=True, write_checksum=False)
    for batch in batches:
        for part, texts in _texts(batch):
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([row_key(t) for t in texts], pa.int64()), pa.array([zip_.compress(t) for t in texts], pa.binary())], names=["doc_id", "k", "z"])


def _pieces(batches: Iterator[pa.RecordBatch], unit) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, k, z, marks: list of v, g, c, at, n, hot) -> a row per mark with the domain's symbols."""
    unzip = zstandard.ZstdDecompressor()
    names = ["v", "g", "c", "at", "n", "hot"]
    for batch in batches:
        for i in range(batch.num_rows):
            one = batch.slice(i, 1)
            marks = one.column("marks").flatten()
            raw = unzip.decompress(one.column("z")[0].as_py())
            parts = unit.parse(raw)[2]
            ats, ns = marks.field("at").to_numpy(), marks.field("n").to_numpy()
            for a in range(0, len(ats), 4096):
                b = min(a + 4096, len(ats))
                content = [unit.piece(parts, x, x + n - 1 + unit.span) for x, n in zip(ats[a:b].tolist(), ns[a:b].tolist(), strict=True)]
                some, take = marks.slice(a, b - a), pa.array(np.zeros(b - a, dtype=np.int64))
                yield pa.RecordBatch.from_arrays([one.column("doc_id").take(take), one.column("k").take(take), *[some.field(x) for x in names], pa.array(content, pa.binary())], names=["doc_id", "k", *names, "content"])


def seeds_in(content: bytes, anchor: int, unit) -> np.ndarray:
    """Places of the anchor's gram in a stretch."""
    with np.errstate(over="ignore"):
        return np.flatnonzero(gram_hashes(unit.parse(content)[0], unit.gram) == np.uint64(anchor & MASK))


def _kernel_groups(frames, unit, solve) -> Iterator:
    """Whole groups, in sorted order; solve(contents, counts, seeds of each) -> window positions of each."""
    import pandas as pd

    rest = None

    def run(f):
        out: dict[str, list] = {"i": [], "at": []}
        groups = f["v"].to_numpy()
        cut = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1]])
        contents, counts, ats, seeds = f["content"].tolist(), f["c"].tolist(), f["at"].to_numpy(), f["seed"].tolist()
        for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(f)], strict=True):
            places = [[s] if s >= 0 else seeds_in(c, int(groups[a]), unit).tolist() for s, c in zip(seeds[a:b], contents[a:b], strict=True)]
            for i, found in enumerate(solve(contents[a:b], counts[a:b], places)):
                if counts[a + i] == 1:
                    for p in sorted(found):
                        out["i"].append(a + i)
                        out["at"].append(p)
        i = np.array(out["i"], dtype=np.int64)
        at = np.array(out["at"], dtype=np.int64) + ats[i] if len(i) else i
        start = np.flatnonzero(np.r_[True, (i[1:] != i[:-1]) | (at[1:] != at[:-1] + 1)]) if len(i) else i
        n = np.diff(np.r_[start, len(i)]) if len(i) else i
        g = f.iloc[i[start]]
        return pd.DataFrame({"doc_id": g["doc_id"].to_numpy(), "k": g["k"].to_numpy(), "at": at[start].astype(np.int32), "n": n.astype(np.int32)})

    for frame in frames:
        f = frame if rest is None else pd.concat([rest, frame], ignore_index=True)
        end = int(np.searchsorted(f["v"].to_numpy(), f["v"].iloc[-1], side="left")) if len(f) else 0
        if end:
            yield run(f.iloc[:end].reset_index(drop=True))
            f = f.iloc[end:].reset_index(drop=True)
        rest = f
    if rest is not None and len(rest):
        yield run(rest)


def _lengthened(batches: Iterator[pa.RecordBatch], unit, parts: int) -> Iterator[pa.RecordBatch]:
    """Stretches of a crowded seed, dealt by longer seeds.

    A window holds the gram (the first in it, where there are several) at some offset. The
    offsets are cut into ``parts`` intervals; all windows of an interval share the text from
    its last window's start to its first window's end, and that text is the longer seed. Each
    window of a stretch goes with exactly one seed. With an interval per offset the seed is
    the window itself.
    """
    width = unit.span - unit.gram + 1
    parts = min(parts, width)
    edges = [(width * k // parts, width * (k + 1) // parts - 1) for k in range(parts)]
    for batch in batches:
        for start in range(0, batch.num_rows, 256):
            part = batch.slice(start, 256)
            out: dict[str, list] = {x: [] for x in ("row", "v", "w", "at", "n", "seed", "content")}
            for i, (content, v, first, n, seed, wide) in enumerate(zip(*(part.column(c).to_pylist() for c in ("content", "v", "at", "n", "seed", "wide")), strict=True)):
                units = unit.units(content)
                # a seed that is longer already: its windows are those that start at most ``wide`` before it
                places = seeds_in(content, v, unit).tolist() if seed < 0 else [seed]
                for j, p in enumerate(places):
                    least = max(places[j - 1] + 1 if j else 0, 0)
                    for a, b in edges if seed < 0 else [(x, x) for x in range(wide + 1)]:
                        lo, hi = max(least, p - b), min(n - 1, p - a)
                        if lo > hi:
                            continue
                        # of a longer seed, offsets count from its start
                        end = p + unit.span - b
                        d = xxhash.xxh3_128_digest(b"%d %d " % (v, a) + unit.piece(units, p - a, end))
                        out["row"].append(i)
                        out["v"].append(int.from_bytes(d[:8], "little", signed=True))
                        out["w"].append(int.from_bytes(d[8:], "little", signed=True))
                        out["at"].append(first + lo)
                        out["n"].append(hi - lo + 1)
                        out["seed"].append(p - a - lo)
                        out["content"].append(unit.piece(units, lo, hi + unit.span))
            take = pa.array(out["row"], pa.int64())
            wide = max(b - a for a, b in edges)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id").take(take), part.column("k").take(take), part.column("c").take(take), *[pa.array(out[x], pa.int64()) for x in ("v", "w")], *[pa.array(out[x], pa.int32()) for x in ("at", "n", "seed")], pa.array([wide] * len(take), pa.int32()), pa.array(out["content"], pa.binary())],
                names=["doc_id", "k", "c", "v", "w", "at", "n", "seed", "wide", "content"],
            )


def _finished(batches: Iterator[pa.RecordBatch], unit, finish) -> Iterator[pa.RecordBatch]:
    unzip = zstandard.ZstdDecompressor()
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            rows, marks = [], part.column("marks")
            for i in range(part.num_rows):
                raw = unzip.decompress(part.column("z")[i].as_py())
                found = marks[i].values if marks[i].is_valid else None
                spots = (found.field("at").to_numpy(), found.field("n").to_numpy()) if found is not None and len(found) else None
                rows.append(finish(raw, spots))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *[pa.array(x) for x in zip(*rows, strict=True)]], names=["doc_id", *finish.names])


def covered(spots: tuple[np.ndarray, np.ndarray], total: int, span: int) -> tuple[np.ndarray, int]:
    """Boolean cover of ``total`` symbols by the marked runs of windows (first, count), and how many are covered."""
    first, count = spots
    edge = np.zeros(total + 1, dtype=np.int64)
    np.add.at(edge, first, 1)
    np.subtract.at(edge, first + count - 1 + span, 1)
    cover = np.cumsum(edge[:-1]) > 0
    return cover, int(cover.sum())


SALTS = 16
HEAVY = 10_000


def _common(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows beside ``size``, the copies their group has, of groups of two or more; a group's rows are spread over several tasks."""
    salt = F.pmod(F.xxhash64("doc_id", "k", "at"), F.lit(SALTS))
    groups = rows.groupBy(*keys).agg(F.sum("c").alias("copies"), F.count("*").alias("size")).where("copies > 1")
    groups = groups.select(*keys, "copies", "size", F.explode(F.array(*[F.lit(x).cast("long") for x in range(SALTS)])).alias("salt"))
    return rows.withColumn("salt", salt.cast("long")).join(groups, [*keys, "salt"]).drop("salt")


def _joined(rows: DataFrame, keys: DataFrame, on: list[str], size: str) -> DataFrame:
    """Inner join; ``size`` of a key is the number of its rows (of which there are all in ``rows``).

    Keys with more than one row in HEAVY are fewer than HEAVY, so they are broadcast and their
    rows stay where they lie.
    """
    most = rows.count() // HEAVY
    rows = rows.select([c for c in rows.columns if c != size])
    light, heavy = keys.where(F.col(size) <= most), F.broadcast(keys.where(F.col(size) > most))
    return rows.join(heavy, on, "left_anti").join(light, on).unionByName(rows.join(heavy, on))


def remove_repeats(df: DataFrame, unit, solve: Callable, finish: Callable, crowd: int, parts: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Marks every window of ``unit.span`` symbols that also starts elsewhere and finishes each row with its marks.

    solve: kernel for the stretches of one seed, at most ``crowd`` different ones. A seed with
    more is lengthened: the stretches are dealt again by ``parts`` longer texts around it, and
    those that still crowd by the whole windows, of which equal ones need no kernel.
    finish(raw text, (first windows, counts) or None) -> the result columns, named and typed by finish.names, finish.schema.
    """
    docs = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    ids = f"doc_id {kind}"
    with scratch(df.sparkSession):
        anchors = written(docs.mapInArrow(partial(_anchor_rows, unit=unit), f"{ids}, v long, g long, k long, at int, n int, twice boolean"), "anchors")
        met = anchors.groupBy("v").agg(F.sum(F.when(F.col("twice"), 2).otherwise(1)).alias("s"), F.count("*").alias("rows")).where("s > 1").select("v", "rows")
        met = written(met, "met-keys")
        # anchors with more than a part in HEAVY of all rows are fewer than HEAVY: rows are matched with those where they lie
        many = met.where(F.col("rows") > anchors.count() // HEAVY).select("v")
        light = anchors.join(F.broadcast(many), "v", "left_anti").join(met.join(F.broadcast(many), "v", "left_anti"), "v", "left_semi")
        met = written(light.union(anchors.join(F.broadcast(many), "v", "left_semi")), "met")
        same = met.groupBy("v", "g").agg(F.count("*").alias("c"), F.max("twice").alias("twice"), F.max("n").alias("n"), F.min(F.struct("doc_id", "k", "at")).alias("first"))
        same = written(same, "domains")
        group = same.groupBy("v").agg(F.count("*").alias("m"), F.max("twice").alias("t"))
        group = written(group.where("m > 1 or t").select("v", "m", (F.col("m") > crowd).alias("hot")), "groups")
        full = _joined(met, same.where("c > 1").select("v", "g", "c"), ["v", "g"], "c").select("doc_id", "k", "at", "n")
        edges = _joined(same, group, ["v"], "m").select("v", "g", "c", "n", "hot", "first.doc_id", "first.k", "first.at")
        per_doc = edges.groupBy("doc_id", "k").agg(F.collect_list(F.struct("v", "g", "c", "at", "n", "hot")).alias("marks"))
        packed = docs.mapInArrow(_packed, f"{ids}, k long, z binary")
        left = packed.alias("p").join(per_doc.alias("m"), F.col("p.doc_id").eqNullSafe(F.col("m.doc_id")) & (F.col("p.k") == F.col("m.k")))
        pieces = left.select("p.doc_id", "p.k", "z", "marks").mapInArrow(partial(_pieces, unit=unit), f"{ids}, k long, v long, g long, c long, at int, n int, hot boolean, content binary")
        pieces = written(pieces, "pieces")
        pieces = pieces.withColumn("seed", F.lit(-1))

        def solved(calm: DataFrame, order: str) -> DataFrame:
            calm = calm.select("doc_id", "k", "v", "c", "at", "seed", "content", order).repartition("v").sortWithinPartitions("v", order)
            return calm.mapInPandas(partial(_kernel_groups, unit=unit, solve=solve), f"{ids}, k long, at int, n int")

        marks = full.union(solved(pieces.where("not hot"), "g"))
        hot = pieces.where("hot").withColumn("wide", F.lit(0))
        if not hot.isEmpty():
            rows = f"{ids}, k long, c long, v long, w long, at int, n int, seed int, wide int, content binary"
            dealt = written(hot.mapInArrow(partial(_lengthened, unit=unit, parts=parts), rows), "lengthened")
            dealt = written(_common(dealt, ["v"]), "crowds")
            marks = marks.union(solved(dealt.where(F.col("size") <= crowd), "w"))
            whole = dealt.where(F.col("size") > crowd).mapInArrow(partial(_lengthened, unit=unit, parts=unit.span), rows)
            whole = written(whole.drop("content"), "windows")
            marks = marks.union(_common(whole, ["v", "w"]).where("c = 1").select("doc_id", "k", "at", "n"))
        marks = marks.groupBy("doc_id", "k").agg(F.collect_set(F.struct("at", "n")).alias("marks"))
        marks = written(marks, "marks", keep=True)
    packed = docs.mapInArrow(_packed, f"{ids}, k long, z binary")
    done = packed.alias("p").join(marks.alias("m"), F.col("p.doc_id").eqNullSafe(F.col("m.doc_id")) & (F.col("p.k") == F.col("m.k")), "left")
    return done.select("p.doc_id", "z", "marks").mapInArrow(partial(_finished, unit=unit, finish=finish), f"{ids}, {finish.schema}")

"""Sharding by histogram sort: splitters are refined by exact byte counts, then rows move once.

The sort key is ``(crc32 of the text, doc_id)``, so equal texts lie side by side. Each
round counts, in one distributed aggregation, the exact bytes below up to ``probes``
candidate boundaries inside every splitter's open interval; only those counts (at most
splitters x probes rows) reach the driver. Rounds stop when each boundary is within
``tolerance`` of its target or a single crc is left, of which the nearer edge becomes the
boundary: equal texts stay in one shard. Only a group of more than ``whole`` of a shard's
bytes, which would itself make sizes unequal, is cut, by ``doc_id``. One exchange on
(shard, range) then numbers the rows.

Odd input: a null text counts as empty (size 1, crc 0); null ids sort first; repeated
rows are rows of their own; an empty table gives an empty result; extra columns are
carried along when asked for.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veldt.llm.common import free_name, scratch, written

CRC_SPAN = 1 << 32
LOWEST, HIGHEST = -(1 << 63), (1 << 63) - 1


@dataclass
class Splitter:
    """Rows with (crc, id) below (crc, doc) belong to the left; [lo, hi) is still open."""

    target: float
    crc: int = 0
    doc: int = LOWEST
    below: int = 0
    level: str = "crc"
    lo: int = 0
    hi: int = CRC_SPAN


def _probe(keys: DataFrame, level: str, spans: list[tuple], probes: int) -> dict[tuple, list[tuple[int, int, int]]]:
    """Exact (bytes) of every bin of every open interval: {span: [(bin lo, bin hi, bytes)]}."""
    key = F.col("crc") if level == "crc" else F.col("id")
    branch = None
    steps = []
    for n, (crc, lo, hi) in enumerate(spans):
        step = max(1, -(-(hi - lo) // probes))
        steps.append(step)
        inside = (key >= F.lit(lo)) & (key <= F.lit(hi - 1))
        if level == "id":
            inside = inside & (F.col("crc") == F.lit(crc))
        # decimal arithmetic: an id interval can be wider than a long
        offset = (key - F.lit(lo)) if level == "crc" else (key.cast("decimal(20,0)") - F.lit(lo).cast("decimal(20,0)"))
        bin_ = F.lit(n * probes).cast("long") + F.floor(offset / F.lit(step).cast(offset_type(level))).cast("long")
        branch = F.when(inside, bin_) if branch is None else branch.when(inside, bin_)
    rows = keys.select(branch.alias("bin"), "size").where("bin is not null").groupBy("bin").agg(F.sum("size").alias("b")).collect()
    found: dict[tuple, list] = {s: [] for s in spans}
    for r in sorted(rows, key=lambda r: r["bin"]):
        n, k = divmod(r["bin"], probes)
        crc, lo, hi = spans[n]
        found[spans[n]].append((lo + k * steps[n], min(hi, lo + (k + 1) * steps[n]), r["b"]))
    return found


def offset_type(level: str) -> str:
    return "bigint" if level == "crc" else "decimal(20,0)"


def splitters(keys: DataFrame, shards: int, tolerance: float = 1e-4, probes: int = 1024, whole: float = 0.04) -> tuple[list[Splitter], int]:
    """Boundaries of ``shards`` key ranges of near equal bytes; keys: crc, id (long, not null), size."""
    total = keys.agg(F.sum("size")).first()[0] or 0
    slack = tolerance * total / shards
    found = [Splitter(total * k / shards) for k in range(1, shards)]
    open_ = list(found) if total else []
    while open_:
        for level in ("crc", "id"):
            now = [s for s in open_ if s.level == level]
            spans = sorted({(s.crc if level == "id" else 0, s.lo, s.hi) for s in now})
            bins = _probe(keys, level, spans, probes) if spans else {}
            for s in now:
                seen = s.below
                for lo, hi, b in bins[(s.crc if level == "id" else 0, s.lo, s.hi)]:
                    if seen + b >= s.target:
                        break
                    seen += b
                s.below, s.lo, s.hi = seen, lo, hi
                if level == "crc":
                    s.crc = lo
                else:
                    s.doc = lo
                over = seen + b
                if s.target - seen <= slack:
                    open_.remove(s)  # the lower edge of the bin is the boundary
                elif over - s.target <= slack or (hi - lo == 1 and (level == "id" or b <= whole * total / shards)):
                    if over - s.target <= s.target - seen:  # the upper edge is nearer
                        s.below = over
                        if level == "crc":
                            s.crc = hi
                        elif hi > HIGHEST:
                            s.crc, s.doc = s.crc + 1, LOWEST
                        else:
                            s.doc = hi
                    open_.remove(s)
                elif hi - lo == 1:  # a large group straddles the target: go on inside it, by id
                    s.level, s.lo, s.hi = "id", LOWEST, HIGHEST + 1
    return found, total


def shard_of(crc: Column, id_: Column, found: list[Splitter]) -> Column:
    """Number of boundaries at or below the row's key."""
    steps = [F.when((crc > F.lit(s.crc)) | ((crc == F.lit(s.crc)) & (id_ >= F.lit(s.doc))), 1).otherwise(0) for s in found]
    return reduce(lambda a, b: a + b, steps, F.lit(0)).cast("int")


def key_columns(text: Column, doc_id: Column) -> list[Column]:
    body = F.coalesce(text, F.lit(""))
    return [
        (F.octet_length(body).cast("long") + 1).alias("size"),
        F.crc32(F.encode(body, "UTF-8")).alias("crc"),
        F.coalesce(doc_id.cast("long"), F.lit(LOWEST)).alias("id"),
    ]


def shard(df: DataFrame, shards: int = 8, doc_id: str = "doc_id", text: str = "text", carry: bool = False, tolerance: float = 1e-4, ranges: int = 4096) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard; ``carry`` keeps the input columns too.

    Slots run through a shard in key order of ``ranges`` key ranges. A range that holds
    more than its even part of the rows (one text repeated without end) is further dealt
    by a hash of the id, so no task numbers more than about rows / ranges rows.
    """
    names = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")
    size, crc, id_ = (free_name(df, n) for n in ("size", "crc", "id"))
    part, sub, base, of_shard, of_part, of_sub = (free_name(df, n) for n in ("range", "sub", "base", "of_shard", "of_range", "of_sub"))
    keep = [c for c in df.columns if c not in names] if carry else [doc_id]
    keyed = [k.alias(n) for k, n in zip(key_columns(F.col(text), F.col(doc_id)), (size, crc, id_), strict=True)]
    with scratch(df.sparkSession):
        if carry:
            data = df.select(*keep, *keyed)
            keys = written(data.select(F.col(size).alias("size"), F.col(crc).alias("crc"), F.col(id_).alias("id")), "shard-keys")
        else:
            data = written(df.select(*keep, *keyed), "shard-keys", keep=True)
            keys = data.select(F.col(size).alias("size"), F.col(crc).alias("crc"), F.col(id_).alias("id"))
        found, _ = splitters(keys, shards, tolerance)
        span = CRC_SPAN // ranges
        in_range = lambda c: F.floor(F.col(c) / F.lit(span)).cast("int")
        per_range = keys.groupBy(in_range("crc").alias("r")).count().collect()  # at most ``ranges`` rows
        even = max(1, sum(x["count"] for x in per_range) // ranges)
        ways = {x["r"]: -(-x["count"] // (4 * even)) for x in per_range if x["count"] > 8 * even}

        def sub_of(r: Column, i: Column) -> Column:
            out = F.lit(0).cast("long")
            for n in sorted(set(ways.values())):
                out = F.when(r.isin([k for k, v in ways.items() if v == n]), F.pmod(F.xxhash64(i), F.lit(n))).otherwise(out)
            return out

        counts = keys.select(shard_of(F.col("crc"), F.col("id"), found).alias("shard"), in_range("crc").alias("r"), "id").groupBy("shard", "r", sub_of(F.col("r"), F.col("id")).alias("sub")).count()
        before = Window.partitionBy("shard").orderBy("r", "sub").rowsBetween(Window.unboundedPreceding, -1)
        base_of = counts.select(F.col("shard").alias(of_shard), F.col("r").alias(of_part), F.col("sub").alias(of_sub), F.coalesce(F.sum("count").over(before), F.lit(0)).alias(base))
        base_of = written(base_of, "shard-bases", keep=True)
    data = data.select("*", shard_of(F.col(crc), F.col(id_), found).alias("shard"), in_range(crc).alias(part))
    data = data.withColumn(sub, sub_of(F.col(part), F.col(id_)))
    # the one exchange: numbering inside (shard, range, sub); the offsets are at most shards x ranges + subs rows
    order = Window.partitionBy("shard", part, sub).orderBy(crc, id_, size)
    data = data.withColumn("slot", F.row_number().over(order).cast("long"))
    data = data.join(F.broadcast(base_of), (F.col("shard") == F.col(of_shard)) & (F.col(part) == F.col(of_part)) & (F.col(sub) == F.col(of_sub)))
    return data.select(
        *keep,
        F.col(size).alias("size"),
        F.col(crc).alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("slot") - 1 + F.col(base)).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )

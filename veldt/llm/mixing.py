"""Mixing sources to target weights by capped water-filling.

Weights are shares of a word budget. A source whose share would pass ``max_epochs``
times its own size is clamped there; what it cannot take is reshared among the others
by weight until no share is above its cap. Inside a source, every document gets the
whole part of target / size as full repetitions; the fractional part is spent in a
seeded random order of documents until the source's target is met to the word, so one
document per source at most is repeated in part.

Where in the order a source's extra words end is found in two steps, from the totals of
hash ranges and then inside one range, so a source with a third of all rows is never
ranked as a whole. One small row per source then decides about every document.

Odd input: a null source is a source of its own, last in order; null or blank texts
have size 0 and take 0; repeated rows count each and, where the extra words end among
them, take even parts; an empty table gives an empty
result; extra columns are ignored, and kept by ``materialise``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veldt.llm.common import SPACE_RUN, SPACES, free_name, scratch, words, written

WEIGHT_CYCLE = (5, 2, 1)


def targets(sizes: DataFrame, share: float = 1.5, max_epochs: int = 2, cycle: tuple[int, ...] = WEIGHT_CYCLE) -> DataFrame:
    """sizes(source, source_size) -> the same plus weight and target. One row per source.

    Clamping in order of cap / weight reaches the fixed point of "clamp and reshare" in
    one pass: source k stays free exactly if the level (budget left / weight left) over
    the sources from k on is below its cap per weight.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    at = F.row_number().over(order) - 1
    weight = F.element_at(F.array(*[F.lit(w).cast("long") for w in cycle]), F.pmod(at, F.lit(len(cycle))) + 1)
    cap = (F.col("source_size") * max_epochs).cast("double")
    out = sizes.withColumn("weight", weight).withColumn("cap", cap)
    fill = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, rest = fill.rowsBetween(Window.unboundedPreceding, -1), fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    every = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    out = (
        out.withColumn("budget", F.lit(share) * F.sum("source_size").over(every))
        .withColumn("left", F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("weights", F.sum("weight").over(rest))
        .withColumn("clamped", F.col("weight") * F.col("left") >= F.col("cap") * F.col("weights"))
    )
    # the first free source in fill order has the largest remaining weight; all later ones share its level
    level = F.min(F.when(~F.col("clamped"), F.struct((-F.col("weights")).alias("neg"), "left", "weights"))).over(every)
    out = out.withColumn("level", level)
    target = F.when(F.col("clamped") | F.col("level").isNull(), F.col("cap")).otherwise(F.col("weight") * F.col("level")["left"] / F.col("level")["weights"])
    return out.select("source", "source_size", "weight", target.alias("target"))


#: Sources up to which the table of decisions is broadcast; beyond, it is joined by a shuffle on the source.
MANY_SOURCES = 100_000


def _sized(df: DataFrame, doc_id: str, text: str, source: str, seed: int, keep: list[Column]) -> DataFrame:
    """size (words) and key (seeded order) beside what is kept."""
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))))
    return df.select(*keep, F.col(source).alias("_source"), F.size(words(F.col(text))).cast("long").alias("_size"), key.alias("_key"))


def _decisions(rows: DataFrame, share: float, max_epochs: int, cycle: tuple[int, ...], digits: int) -> DataFrame:
    """rows(_source, _size, _key) -> one row per source: source_size, target, whole, and where its extra words end.

    The extra words run over the documents in key order. The bucket of keys in which they end is
    found from bucket totals, the document from that bucket alone.
    """
    bucket = F.substring("_key", 1, digits)
    sums = written(rows.groupBy(F.col("_source").alias("source"), bucket.alias("bucket")).agg(F.sum("_size").alias("words")), "mix-buckets")
    totals = targets(sums.groupBy("source").agg(F.sum("words").alias("source_size")), share, max_epochs, cycle)
    ratio = F.coalesce(F.try_divide(F.col("target"), F.col("source_size")), F.lit(0.0))
    totals = totals.withColumn("whole", F.floor(ratio).cast("long"))
    totals = totals.withColumn("extra", F.round(F.col("target"), 0).cast("long") - F.col("whole") * F.col("source_size"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    at = sums.withColumn("start", F.coalesce(F.sum("words").over(before), F.lit(0)))
    at = at.alias("b").join(totals.alias("t"), F.col("b.source").eqNullSafe(F.col("t.source")))
    at = at.where("start <= extra and extra < start + words").select(F.col("b.source").alias("source"), "bucket", (F.col("extra") - F.col("start")).alias("left"))
    inside = rows.withColumn("bucket", bucket).alias("r").join(at.alias("a"), F.col("r._source").eqNullSafe(F.col("a.source")) & (F.col("r.bucket") == F.col("a.bucket")))
    # rows alike in key and size (repeated rows) are one step, shared evenly
    steps = inside.groupBy("source", "left", "_key", "_size").agg(F.count(F.lit(1)).alias("m"))
    order = Window.partitionBy("source").orderBy("_key", "_size").rowsBetween(Window.unboundedPreceding, -1)
    steps = steps.withColumn("before", F.coalesce(F.sum(F.col("m") * F.col("_size")).over(order), F.lit(0)))
    end = steps.where("before <= left and left < before + m * _size").select(F.col("source").alias("_s"), F.col("_key").alias("end_key"), F.col("_size").alias("end_size"), F.floor((F.col("left") - F.col("before")) / F.col("m")).cast("long").alias("part"))
    out = totals.join(end, F.col("source").eqNullSafe(F.col("_s")), "left")
    return written(out.select("source", "source_size", "target", "whole", "extra", "end_key", "end_size", "part"), "mix-plan", keep=True)


def _taken(rows: DataFrame, decisions: DataFrame) -> DataFrame:
    """rows beside source_size, target and taken: words that the mix takes of each."""
    few = decisions.count() <= MANY_SOURCES
    d = F.broadcast(decisions) if few else decisions
    here, there = F.struct("_key", "_size"), F.struct(F.col("end_key").alias("_key"), F.col("end_size").alias("_size"))
    room = F.when(F.col("end_key").isNull(), F.when(F.col("extra") > 0, F.col("_size")).otherwise(0)).when(here < there, F.col("_size")).when(here == there, F.col("part")).otherwise(0)
    joined = rows.join(d, F.col("_source").eqNullSafe(F.col("source")))
    return joined.select(*rows.columns, "source_size", "target", (F.col("whole") * F.col("_size") + room).cast("long").alias("taken"))


def plan(df: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", share: float = 1.5, max_epochs: int = 2, cycle: tuple[int, ...] = WEIGHT_CYCLE, seed: int = 7, digits: int = 3) -> DataFrame:
    """Every input row once: doc_id, size, source_size, target, taken (words the mix takes).

    digits: leading hexadecimal digits of the seeded hash that make a bucket (3: 4096 per source).
    """
    with scratch(df.sparkSession):
        rows = written(_sized(df, doc_id, text, source, seed, [F.col(doc_id).alias("doc_id")]), "mix-sizes", keep=True)
        decisions = _decisions(rows, share, max_epochs, cycle, digits)
    out = _taken(rows, decisions)
    return out.select("doc_id", F.col("_size").alias("size"), "source_size", "target", "taken")


def materialise(df: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", share: float = 1.5, max_epochs: int = 2, cycle: tuple[int, ...] = WEIGHT_CYCLE, seed: int = 7, digits: int = 3) -> DataFrame:
    """The mixture itself: each row of ``df`` as often as the plan repeats it, columns unchanged.

    A document repeated in part appears once more with as many of its first words as
    the plan takes, white space between them normalised to one space. Texts are read,
    not shuffled: what decides about a row is one small row per source.
    """
    with scratch(df.sparkSession):
        rows = written(_sized(df, doc_id, text, source, seed, []), "mix-sizes")
        decisions = _decisions(rows, share, max_epochs, cycle, digits)
    row = free_name(df, "row")
    packed = _sized(df, doc_id, text, source, seed, [F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(row)])
    mixed = _taken(packed, decisions)
    whole = F.when(F.col("_size") > 0, F.floor(F.col("taken") / F.col("_size"))).otherwise(0).cast("int")
    part = (F.col("taken") - whole * F.col("_size")).cast("int")
    copies = F.concat(F.array_repeat(F.lit(-1), whole), F.when(part > 0, F.array(part)).otherwise(F.array().cast("array<int>")))
    out = mixed.select(row, F.explode(copies).alias("n"))
    body = F.split(F.btrim(F.col(row)[text], F.lit(SPACES)), SPACE_RUN)
    cut = F.when(F.col("n") < 0, F.col(row)[text]).otherwise(F.array_join(F.slice(body, 1, F.greatest(F.col("n"), F.lit(1))), " "))
    return out.select(*[cut.alias(c) if c == text else F.col(row)[c].alias(c) for c in df.columns])

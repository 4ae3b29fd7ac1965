"""What every operator on documents does with an empty table, repeated rows, null ids and clashing columns."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from veldt.llm import decontaminate, mixing, near_copies, quality_rules, sharding, simhash, substring_dedup, suffix_array, token_counts, toxicity

SAME = " ".join(f"word{i}" for i in range(80))
ROWS = [(1, SAME), (1, SAME), (None, SAME), (None, None), (2, ""), (2, ""), (None, " \t"), (3, "short one")]
CLASH = "size int, fp string, crc string, words int, k string, marks int, v int, g int, at int, n int, t string, _size int, _key int, row int, held_out int, score string, component_id string, kept int, shard int, slot int"


def op10(d):
    m = F.col("m_")
    return d.select("doc_id", quality_rules.metrics(F.col("text")).alias("m_")).select("doc_id", (~quality_rules.base_failed(m) & quality_rules.verdict(m)).alias("kept"))


EACH = {
    "op1": mixing.plan,
    "op2": suffix_array.dedup,
    "op3": substring_dedup.dedup,
    "op5": lambda d: toxicity.classify(d, toxicity.train(d, d.select("doc_id", F.lit(1).alias("toxic")).where("doc_id = 1").union(d.where("doc_id = 3").select("doc_id", F.lit(0))))),
    "op6": lambda d: token_counts.count(d, token_counts.seeded_edits(F.col("doc_id"), F.col("text"))),
    "op7": lambda d: sharding.shard(d, 3),
    "op8": simhash.classes,
    "op10": op10,
}


def table(spark):
    d = spark.createDataFrame(ROWS, "doc_id long, text string").withColumn("source", F.lit("a"))
    for column in CLASH.split(", "):
        name, kind = column.split()
        d = d.withColumn(name, F.lit("7").cast(kind))
    return d


@pytest.mark.parametrize("name", EACH)
def test_every_row_gets_its_answer(spark, name):
    rows = EACH[name](table(spark)).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(i for i, _ in ROWS)
    assert EACH[name](table(spark).limit(0)).count() == 0


def test_repeated_rows_have_equal_answers(spark):
    for name in ("op2", "op3", "op5", "op6", "op8", "op10"):
        rows = EACH[name](table(spark)).collect()
        assert len({tuple(r) for r in rows if r["doc_id"] == 1}) == 1, name


def test_rows_that_stay(spark):
    d = table(spark)
    kept = near_copies.keep_one(d)
    assert kept.columns == d.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 2, 3]
    items = spark.createDataFrame([(0, SAME), (1, None), (2, "")], "item_id long, text string")
    left = decontaminate.drop_leaks(d, items)
    assert left.columns == d.columns and left.count() == 5

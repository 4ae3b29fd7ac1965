"""Slice queries cover every period."""

import os

import pytest
from pyspark.sql import functions as F

from veldt.operators import indices

FOLDER = os.environ.get("TESTDATA", "/root/testdata/sf0.01")


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")
@pytest.mark.parametrize("name", ["slice_nmi", "multislice"])
def test_all_periods(spark, name):
    from veldt.plans.queries import QUERIES, panel_features

    periods = lambda df: {r[0] for r in df.select("period").distinct().collect()}
    want = periods(panel_features(spark, FOLDER))
    assert len(want) > 70 and periods(QUERIES[name](spark, FOLDER)) == want


def test_grouped_agreement_is_that_of_each_group(spark):
    rows = [(p, i, (i * p) % 3, (i // 2) % (p + 1)) for p in (0, 1, 2) for i in range(12)]
    df = spark.createDataFrame(rows, "period long, id long, la long, lb long")
    for r in indices.mutual_information_by(df, "period").collect():
        one = df.where(F.col("period") == r["period"])
        want = indices.mutual_information(one.select("id", F.col("la").alias("label")), one.select("id", F.col("lb").alias("label"))).first()[0]
        assert r["NMI"] == pytest.approx(want)

"""The streamed types against the batch scores."""

import numpy as np

from veldt.streaming.types import online_types, step


def test_step_keeps_the_leader_through_an_outlier():
    s = None
    for t in range(10):
        s = step(s, np.array([-5.0, 0.0] if t == 4 else [0.0, -5.0]), 0.01)
    assert s.argmax() == 0 and s.max() == 0
    assert step(None, np.array([1.0]), 0.03).tolist() == [0.0]


def test_stream(spark, tmp_path):
    schema = "entity long, period string, e array<double>"
    first = [(1, f"{t:02d}", [0.0, -5.0]) for t in range(4)]
    spark.createDataFrame(first, schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    out = online_types(spark.readStream.schema(schema).json(str(tmp_path / "in")))
    run = lambda: out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination(60)
    assert run()
    late = [(1, "02", [-9.0, 0.0]), *[(1, f"{t:02d}", [-5.0, 0.0]) for t in range(4, 9)]]
    spark.createDataFrame(late, schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    assert run()
    rows = spark.read.parquet(str(tmp_path / "out")).orderBy("period").collect()
    assert [r["period"] for r in rows] == [f"{t:02d}" for t in range(9)]  # the late one is left out
    assert rows[3]["type"] == 0 and rows[8]["type"] == 1

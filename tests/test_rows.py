"""Row softmax, medians and magnitudes against brute force, with the cases that SQL oracles don't reach."""

from __future__ import annotations

import math
import random
from statistics import median

from pyspark.sql import functions as F

from sparrowgrid.operators import tables
from sparrowgrid.operators.attention import row_softmax
from sparrowgrid.operators.graph import log_softmax
from sparrowgrid.operators.prune import kth_value
from sparrowgrid.tensor import Tensor


def tensor(spark, rows):
    return Tensor.from_df(spark.createDataFrame(rows, "i long, j long, v double"), ["i", "j"])


def test_softmax_of_far_values(spark):
    r = random.Random(1)
    rows = [(0, j, r.uniform(-900, 900)) for j in range(50)] + [(1, 0, 1e300), (1, 1, -1e300), (2, 0, -1e5), (2, 1, -1e5 - 1)]
    rows += [(3, 0, float("-inf")), (3, 1, 2.0), (4, 0, float("-inf"))]
    t = tensor(spark, rows)
    got = {(i, j): v for i, j, v in row_softmax(t, 2.0).df.collect()}
    logs = {(i, j): v for i, j, v in log_softmax(t).df.collect()}
    assert len(got) == len(logs) == len(rows) and math.isnan(got[4, 0])
    for i in range(4):
        cells = {j: v for k, j, v in rows if k == i}
        top = max(cells.values())
        total = sum(math.exp((v - top) / 2) for v in cells.values())
        whole = math.log(sum(math.exp(v - top) for v in cells.values()))
        for j, v in cells.items():
            assert math.isclose(got[i, j], math.exp((v - top) / 2) / total, rel_tol=1e-9, abs_tol=1e-300)
            assert math.isclose(logs[i, j], v - top - whole, rel_tol=1e-9, abs_tol=1e-9)


def test_softmax_of_a_vector_and_of_nothing(spark):
    v = Tensor.from_df(spark.createDataFrame([(0, 1.0), (1, 1.0)], "i long, v double"), ["i"])
    assert [x[1] for x in row_softmax(v).df.collect()] == [0.5, 0.5]
    assert row_softmax(tensor(spark, [])).df.count() == 0


def test_medians_of_small_large_and_null_groups(spark, monkeypatch):
    monkeypatch.setattr(tables, "SMALL", 20)
    r = random.Random(2)
    groups = {"odd": [r.gauss(0, 1) for _ in range(5001)], "even": [r.gauss(0, 9) for _ in range(6000)], "ties": [1.0] * 3000 + [2.0] * 3000, None: [3.0, 5.0], "one": [7.0]}
    rows = [(g, x) for g, xs in groups.items() for x in [*xs, None]] + [("none", None)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(7)
    got = {row["g"]: row for row in tables.timing_summary(df, "g", "x").collect()}
    assert set(got) == {*groups, "none"} and got["none"]["md"] is None
    for g, xs in groups.items():
        assert got[g]["md"] == median(xs) and got[g]["mn"] == min(xs)
    assert tables.timing_summary(df.limit(0), "g", "x").count() == 0


def test_kth_magnitude_over_many_distinct_values(spark):
    df = spark.range(20_000).select(F.col("id").alias("i"), F.lit(0).alias("j"), (F.pmod(F.xxhash64("id"), F.lit(1 << 40)) - (1 << 39)).cast("double").alias("v"))
    t = Tensor.from_df(df, ["i", "j"])
    values = sorted(abs(x[0]) for x in df.select("v").collect())
    assert [kth_value(t, k) for k in (1, 7_777, 20_000)] == [values[0], values[7_776], values[-1]]
    assert kth_value(t, 20_001) is None and kth_value(t, share=0.25) == values[4_999]

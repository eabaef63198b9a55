"""Every catalogue query against its SQL, on the smallest tables."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from sparrowgrid import oracles
from sparrowgrid import queries as catalogue
from tests.compare import compare, duck

SLOW = {"q_spgemm"}


@pytest.fixture(scope="module")
def connection(sf_dir):
    if not Path(sf_dir).exists():
        pytest.skip("no tables")
    return duck(sf_dir)


@pytest.mark.parametrize("name", sorted(oracles.oracle_sql()))
def test_matches(spark, connection, sf_dir, name):
    assert compare(spark, connection, catalogue.queries()[name], oracles.oracle_sql()[name], sf_dir) == ""


def test_whole_products_use_every_part(spark, sf_dir):
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").count()
    assert catalogue.queries()["q_matmul_dense"](spark, sf_dir).select("j").distinct().count() == parts
    total = lambda name: catalogue.queries()[name](spark, sf_dir).agg({"v": "sum"}).first()[0]
    squares = catalogue.queries()["q_coalesce"](spark, sf_dir).groupBy("j").agg({"v": "sum"}).selectExpr("sum(`sum(v)` * `sum(v)`)").first()[0]
    assert total("q_self_spgemm") == squares


def test_whole_encoding_keeps_every_token(spark, sf_dir):
    words = F.size(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9']+"), F.lit(0)))
    want = {r.doc_id: min(r.n, 8192) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", words.alias("n")).collect() if r.n}
    got = {r.doc_id: sum(i != "1" for i in r.ids.split(",")) for r in catalogue.queries()["q_encode"](spark, sf_dir).collect()}
    assert got == want


def test_every_query_has_an_oracle():
    assert set(catalogue.queries()) == set(oracles.oracle_sql())


def test_private_indices_are_summed_before_operands_meet(spark):
    from sparrowgrid import Tensor, einsum

    x = Tensor.from_df(spark.createDataFrame([(0, 2.0), (1, 3.0)], "i long, v double"), ["i"])
    b = Tensor.from_df(spark.createDataFrame([(0, 5, 1.0), (1, 5, 4.0), (1, 6, 2.0)], "j long, k long, v double"), ["j", "k"])
    got = einsum("i,jk->ik", x, b)
    assert sorted(map(tuple, got.df.collect())) == [(0, 5, 10.0), (0, 6, 4.0), (1, 5, 15.0), (1, 6, 6.0)]
    plan = got.df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.index("Aggregate")  # the root is printed first
    assert sorted(map(tuple, einsum("i,jk->i", x, b).df.collect())) == [(0, 14.0), (1, 21.0)]
    empty = b.with_df(b.df.limit(0))
    assert einsum("i,jk->ik", x, empty).df.count() == 0 and einsum("i,jk->i", x, empty).df.count() == 0


def test_nan_is_a_cell_and_null_is_not(spark):
    from sparrowgrid import Tensor

    df = spark.createDataFrame([(0, float("nan")), (1, None), (None, 2.0), (3, 1.0)], "i long, v double")
    for t in (Tensor.from_df(df, ["i"]), Tensor.from_cells(df, ["i"])):
        assert sorted(r.i for r in t.df.collect()) == [0, 3]

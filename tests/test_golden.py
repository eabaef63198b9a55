"""Golden cases with known coordinates and values."""

import numpy as np
import pytest

import sparrowgrid as sg
from sparrowgrid.operators import attention, convert, graph, prune, tables
from sparrowgrid.operators.elementwise import broadcast_mode
from sparrowgrid.plans.expr import Contraction, infer_format, parse_einsum
from sparrowgrid.plans.planner import plan
from sparrowgrid.tensor import ShapeError, Tensor


def tensor(spark, array, dims, keep_zeros=False, fmt=None):
    array = np.asarray(array, float)
    cells = [(*map(int, i), float(x)) for i, x in np.ndenumerate(array) if x or keep_zeros]
    df = spark.createDataFrame(cells, ", ".join(f"{d} bigint" for d in dims) + ", v double")
    return Tensor.from_df(df, dims, shape=array.shape, fmt=fmt)


def cells(t):
    return {tuple(r[d] for d in t.dims): r["v"] for r in t.df.collect()}


def dense(t, shape):
    out = np.zeros(shape)
    for k, v in cells(t).items():
        out[k] = v
    return out


A12 = [1, 0, 2, 0, 3, 0, 4, 0, 5, 0, 8, 4]
B12 = [2, 2, 2, 2, 2, 0, 0, 0, 0, 0, 1, 2.5]
A5 = [[1, 2, 3, 4, 5], [2, 2, 0, 0, 0], [3, 0, 3, 0, 0], [0, 0, 0, 0, 0], [5, 0, 0, 0, 5]]
B5 = [[1, 0, 0, 0, 0], [0, 2, 0, 0, 0], [0, 0, 0, 0, 0], [0, 0, 0, 1, 0], [0, 0, 0, 3, 1]]


def test_vectors(spark):
    a, b = tensor(spark, A12, ["i"]), tensor(spark, B12, ["i"])
    assert cells(sg.einsum("i,i->i", a, b)) == {(0,): 2, (2,): 4, (4,): 6, (10,): 8, (11,): 10}
    assert cells(a + b) == {(0,): 3, (1,): 2, (2,): 4, (3,): 2, (4,): 5, (6,): 4, (8,): 5, (10,): 9, (11,): 6.5}
    assert cells(sg.einsum("i,i->", a, b)) == {(): 30}


def test_outer(spark):
    got = cells(sg.outer(tensor(spark, [1, 0, 2, 0, 3], ["i"]), tensor(spark, [7, 8, 0, 9], ["j"])))
    assert [got[k] for k in sorted(got)] == [7, 8, 9, 14, 16, 18, 21, 24, 27]


def test_matrix_product_and_sum(spark):
    a, b = tensor(spark, A5, ["i", "j"]), tensor(spark, B5, ["j", "k"])
    assert dense(a @ b, (5, 5)).tolist() == [[1, 4, 0, 19, 5], [2, 4, 0, 0, 0], [3, 0, 0, 0, 0], [0] * 5, [5, 0, 0, 15, 5]]
    pointers, entries = convert.to_csr(a + b)
    assert [r.pos_end for r in pointers.orderBy("r").collect()] == [5, 7, 9, 10, 13]
    assert [r.v for r in entries.orderBy("p").collect()] == [2, 2, 3, 4, 5, 2, 4, 3, 3, 1, 5, 3, 6]


def test_dense_product_over_a_short_mode_shuffles_no_products(spark):
    rng = np.random.default_rng(2)
    a, b = rng.integers(-3, 4, (9, 4)), rng.integers(-3, 4, (7, 4))
    a[2], b[:, 1] = 0, 0  # a row without a cell has no product, as cells without a partner have none
    for keep_zeros in (True, False):
        x, y = (tensor(spark, t, d, keep_zeros, "dd") for t, d in ((a, "if"), (b, "kf")))
        got = cells(sg.einsum("if,kf->ik", x, y))
        meet = (np.ones((9, 4)) if keep_zeros else a != 0) @ (np.ones((4, 7)) if keep_zeros else b.T != 0) > 0
        assert got == {(i, k): (a @ b.T)[i, k] for i, k in zip(*map(lambda n: n.tolist(), np.nonzero(meet)), strict=True)}
    twice = Tensor(x.df.union(x.df), x.dims, x.shape, "dd", coalesced=False)
    assert cells(sg.einsum("if,kf->ki", twice, y)) == {(k, i): 2 * v for (i, k), v in got.items()}
    plan = sg.einsum("if,kf->ik", x, y).df._jdf.queryExecution().executedPlan().toString()
    top = plan[: plan.index("Join" if "Join" in plan else "CartesianProduct")]
    assert "Exchange" not in top and "Aggregate" not in top


def test_csr_round_trip(spark):
    rows = spark.createDataFrame([(0, 2), (1, 2), (2, 3)], "i bigint, pos_end bigint")
    entries = spark.createDataFrame([(0, 4, 1.0), (1, 5, 2.0), (2, 0, 3.0)], "p bigint, j bigint, v double")
    assert cells(Tensor.from_csr(rows, entries, ("i", "j"))) == {(0, 4): 1, (0, 5): 2, (2, 0): 3}


def test_scalars_and_numpy(spark):
    a = tensor(spark, A5, ["i", "j"])
    assert (2 * a - a).to_numpy().tolist() == A5 and (-a).to_numpy()[0, 1] == -2
    with pytest.raises(ShapeError):
        a.to_numpy(most=24)
    pointers, entries = convert.to_csr(a)
    back = Tensor.from_csr(pointers.withColumnRenamed("r", "i"), entries, ("i", "j"), (5, 5))
    assert back.to_numpy().tolist() == A5


def test_explicit_zero_goes_in_conversion_only(spark):
    df = spark.createDataFrame([(0, 0, 1.0), (1, 1, 2.0), (2, 2, 3.0), (2, 3, 4.0), (3, 3, 0.0), (4, 4, 5.0)], "i bigint, j bigint, v double")
    t = Tensor.from_df(df, ["i", "j"], shape=(5, 5))
    assert t.nnz() == 6
    pointers, entries = convert.to_csr(t)
    assert [r.pos_end for r in pointers.orderBy("r").collect()] == [1, 2, 4, 4, 5]
    assert len(cells(sg.to_dense(t))) == 25


def test_batched(spark):
    rng = np.random.default_rng(7)
    a, b = rng.random((3, 3, 3)) * (rng.random((3, 3, 3)) > 0.5), rng.random((3, 3, 3))
    got = sg.einsum("bij,bjk->bik", tensor(spark, a, list("bij")), tensor(spark, b, list("bjk")))
    assert np.allclose(dense(got, (3, 3, 3)), np.einsum("bij,bjk->bik", a, b))


@pytest.mark.parametrize("expr,shapes", [
    ("ij,jk->ik", [(8, 9), (9, 7)]), ("ij,j->i", [(8, 9), (9,)]), ("ij,ij->ij", [(8, 9), (8, 9)]), ("ij,ik,jk->ij", [(8, 9), (8, 4), (9, 4)]),
    ("ijk,km->ijm", [(4, 5, 6), (6, 3)]), ("ijk,jm,km->im", [(4, 5, 6), (5, 3), (6, 3)]), ("ii->i", [(6, 6)]), ("ij->ji", [(4, 6)]),
    ("ij,jk,k->i", [(6, 5), (5, 4), (4,)]), ("abcd,abcd->abcd", [(2, 3, 4, 5)] * 2), ("bhij,bhjd->bhid", [(2, 2, 3, 4), (2, 2, 4, 3)]), ("ij->", [(5, 6)]),
])
@pytest.mark.parametrize("sparsity", [0.3, 1.1])
def test_einsum_against_numpy(spark, expr, shapes, sparsity):
    rng = np.random.default_rng(42)
    arrays = [rng.random(s) * (rng.random(s) < 1 - sparsity + 0.2) for s in shapes]
    left, out = expr.split("->")
    ts = [tensor(spark, a, [f"m{n}" for n in range(a.ndim)]) for a in arrays]
    got = sg.einsum(expr, *ts)
    want = np.einsum(expr, *arrays)
    assert np.allclose(dense(got, want.shape), want, atol=1e-9)


def test_output_only_index(spark):
    a, b = tensor(spark, A5, ["i", "j"]), tensor(spark, [1, 2, 0, 0, 3], ["j"])
    got = sg.einsum("ij,j->ik", a, b, domains={"k": 2})
    assert np.allclose(dense(got, (5, 2)), np.repeat((np.array(A5) @ [1, 2, 0, 0, 3])[:, None], 2, 1))


def test_formats():
    c = lambda e: parse_einsum(e, [len(x) for x in e.split("->")[0].split(",")])
    assert infer_format(c("ij,jk->ik"), ["oo", "dd"]) == "dd"
    assert infer_format(c("ij,jk->ik"), ["ds", "dd"]) == "dd"
    assert infer_format(c("ij,jk->ik"), ["ds", "ds"]) == "ds"
    assert infer_format(c("ij,jk->ik"), ["oo", "oo"]) == "oo"
    assert infer_format(c("ij,ik,jk->ij"), ["ds", "dd", "dd"]) == "oo"
    assert infer_format(Contraction(("i", "j"), "ij"), ["s", "s"]) == "ss"


def test_bad_expressions(spark):
    a = tensor(spark, A5, ["i", "j"])
    for bad in ("ij,jk", "ij->iij", "ij,jk->ik"):
        with pytest.raises(ValueError):
            sg.einsum(bad, a)
    with pytest.raises(ShapeError):
        sg.einsum("ij,jk->ik", a, tensor(spark, np.ones((4, 2)), ["j", "k"]))
    with pytest.raises(ValueError):
        sg.pipeline(a, tensor(spark, B5, ["j", "k"]), ["softplus"])
    with pytest.raises(ValueError):
        convert.apply(a, "sigmoid")


def test_plan_sums_early_and_joins_the_mask_first():
    steps = plan([("i", "j"), ("j", "k"), ("k",)], ["i"], [1e6, 1e6, 1e3], [True, True, False])
    assert (steps[0].left, steps[0].right, steps[0].keep) == (1, 2, ("j",))
    steps = plan([("i", "k"), ("j", "k"), ("i", "j")], ["i", "j"], [1e6, 1e6, 1e4], [False, False, True])
    assert 2 in (steps[0].left, steps[0].right)


def test_fused_layer(spark):
    rng = np.random.default_rng(42)
    a, x, b = rng.random((16, 16)) * (rng.random((16, 16)) < 0.2), rng.random((16, 5)), rng.random(5) - 1
    got = sg.pipeline(tensor(spark, a, ["i", "j"]), tensor(spark, x, ["j", "f"], fmt="dd"), [("add", tensor(spark, b, ["f"])), "relu"])
    want = np.maximum(a @ x + b, 0)
    want[~(a != 0).any(1)] = 0
    assert np.allclose(dense(got, (16, 5)), want)


def test_expression_tree(spark):
    a, b = tensor(spark, A5, ["i", "j"]), tensor(spark, B5, ["i", "j"])
    x, y = sg.Access(a, ("i", "j")), sg.Access(b, ("i", "j"))
    assert np.allclose(dense(sg.evaluate((x + y) * (x - y)), (5, 5)), np.square(A5) - np.square(B5))
    assert np.allclose(dense(sg.evaluate((x * y).sum("j")), (5,)), (np.array(A5) * B5).sum(1))


def test_duplicates_are_summed_and_nulls_go(spark):
    df = spark.createDataFrame([(0, 1.0), (0, 2.0), (None, 5.0), (1, None)], "i bigint, v double")
    assert cells(Tensor.from_df(df, ["i"])) == {(0,): 3}


def test_graph_and_attention(spark):
    edges = spark.createDataFrame([(0, 1), (1, 2), (1, 0)], "s bigint, d bigint")
    nodes = spark.createDataFrame([(k,) for k in range(4)], "n bigint")
    u = graph.undirect(edges)
    assert u.count() == 4
    n = graph.gcn_adjacency(u, nodes)
    a = np.zeros((4, 4))
    a[0, 1] = a[1, 0] = a[1, 2] = a[2, 1] = 1
    a += np.eye(4)
    d = a.sum(1) ** -0.5
    assert np.allclose(dense(n, (4, 4)), d[:, None] * a * d)
    assert {(r.i, r.j) for r in attention.longformer_mask(nodes, 1).collect()} == {(i, j) for i in range(4) for j in range(4) if abs(i - j) <= 1 or 0 in (i, j)}
    rng = np.random.default_rng(1)
    q, k, v = (rng.random((4, 3)) for _ in range(3))
    got = attention.sparse_attention(attention.band_mask(nodes, 1), *(tensor(spark, m, ["p", "f"], fmt="dd") for m in (q, k, v)), 2.0)
    z = np.where(np.abs(np.subtract.outer(range(4), range(4))) <= 1, q @ k.T / 2, -np.inf)
    e = np.exp(z - z.max(1, keepdims=True))
    assert np.allclose(dense(got, (4, 3)), e / e.sum(1, keepdims=True) @ v)
    assert {r["rank"] for r in graph.relabel(nodes.filter("n > 1")).collect()} == {0, 1}


def test_gcn_forward(spark):
    rng = np.random.default_rng(3)
    a, x, w1, b1, w2, b2 = rng.random((5, 5)), rng.random((5, 4)), rng.random((3, 4)), rng.random(3), rng.random((2, 3)), rng.random(2)
    t = lambda m, *d: tensor(spark, m, list(d), fmt="d" * len(d))
    got = graph.gcn_forward(t(a, "i", "j"), t(x, "j", "f"), t(w1, "h", "f"), t(b1, "h"), t(w2, "o", "h"), t(b2, "o"))
    z = a @ (np.maximum(a @ (x @ w1.T) + b1, 0) @ w2.T) + b2
    z -= z.max(1, keepdims=True)
    assert np.allclose(dense(got, (5, 2)), z - np.log(np.exp(z).sum(1, keepdims=True)))


def test_prune_keeps_ties(spark):
    t = tensor(spark, [1, -2, 2, 3, -4, 4, 0.5], ["i"])
    assert sorted(cells(prune.prune(t, 0.5)).values()) == [-4, -2, 2, 3, 4]
    wide = Tensor(spark.range(20000).selectExpr("id as i", "cast((id * 7919) % 20011 as double) as v"), ("i",), (20000,), "o")
    values = sorted((k * 7919) % 20011 for k in range(20000))
    assert prune.kth_value(wide, 9000) == values[8999]


def test_rows_layout_and_broadcast(spark):
    a = tensor(spark, A5, ["i", "j"])
    rows = spark.createDataFrame([(j, [float(j), 1.0]) for j in range(5)], "j bigint, row array<double>")
    got = {r.i: r.row for r in sg.spmm_rows(a, rows, "j", "row", 2).collect()}
    want = np.array(A5) @ np.array([[j, 1.0] for j in range(5)])
    assert all(np.allclose(got[i], want[i]) for i in got)
    assert np.allclose(dense(broadcast_mode(a, tensor(spark, [1, 2, 0, 4, 5], ["x"]), "j"), (5, 5)), np.array(A5) * [1, 2, 0, 4, 5])


def test_text_tables(spark):
    df = spark.createDataFrame([(0, "The cat's the cat"), (1, "a dog"), (2, "")], "id bigint, text string")
    toks = tables.tokens(df, "id", "text")
    vocab = tables.vocabulary(toks, 4)
    assert [(r.token, r.id) for r in vocab.orderBy("id").collect()] == [("the", 2), ("a", 3)]
    got = {r.id: r.ids for r in tables.encode(toks, vocab, "id", 5).collect()}
    assert got == {0: [2, 0, 2, 0, 1], 1: [3, 0, 1, 1, 1]}


def test_mtx(spark, tmp_path):
    p = tmp_path / "m.mtx"
    p.write_text("%%MatrixMarket matrix coordinate real symmetric\n% note\n3 3 3\n1 1 2.0\n2 1 5.0\n3 2 7.0\n")
    from sparrowgrid.sources.matrix import random_exact, random_sparse, read_mtx

    t = read_mtx(spark, str(p))
    assert t.shape == (3, 3)
    assert dense(t, (3, 3)).tolist() == [[2, 5, 0], [5, 0, 7], [0, 7, 0]]
    e = random_exact(spark, 40, 30, 500, 3)
    assert e.nnz() == 500 and len(cells(e)) == 500 and all(0 <= i < 40 and 0 <= j < 30 and 0 < v <= 1 for (i, j), v in cells(e).items())
    r = random_sparse(spark, 50, 40, 0.1, 1)
    assert r.nnz() == random_sparse(spark, 50, 40, 0.1, 1).nnz() <= 200


def test_streaming_coalesce(spark, tmp_path):
    from sparrowgrid.streaming.coalesce import coalesce_stream

    src = tmp_path / "in"
    spark.createDataFrame([(0, 1.0), (0, 2.0), (1, 5.0)], "i bigint, v double").write.parquet(str(src))
    stream = coalesce_stream(spark.readStream.schema("i bigint, v double").parquet(str(src)), ["i"])
    q = stream.writeStream.format("memory").queryName("cells").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {tuple(r) for r in spark.table("cells").collect()} == {(0, 3.0), (1, 5.0)}

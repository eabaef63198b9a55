"""The tensor catalogue over the driver's tables, each query through the engine's own operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparrowgrid.functions.activations import gelu, positional_encoding, sigmoid, tanh
from sparrowgrid.operators import attention, convert, graph, prune, tables
from sparrowgrid.operators.contract import contract, einsum, matmul, mttkrp, outer, sddmm, spgemm, spmm, spmm_rows, spmv, ttm
from sparrowgrid.operators.elementwise import add, broadcast_mode, div, hadamard, sub
from sparrowgrid.operators.fused import compiled, pipeline
from sparrowgrid.plans.expr import Access, evaluate
from sparrowgrid.sources import matrix
from sparrowgrid.sources.scratch import scratch
from sparrowgrid.tensor import VALUE, Tensor

Query = Callable[[SparkSession, str], DataFrame]


class Tables:
    """The shared operands, lazily read."""

    def __init__(self, spark: SparkSession, sf_dir: str, summed: bool = True) -> None:
        self.spark, self.dir, self.summed = spark, sf_dir, summed

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def raw(self, name: str) -> Tensor:
        """An operand whose rows aren't summed yet, for operators that sum anyway; joins that expand a lot gain from
        summing first."""
        return getattr(Tables(self.spark, self.dir, summed=False), name)

    def _items(self, cols: dict[str, str], where: str | None = None) -> Tensor:
        df = self.read("lineitem")
        df = df.filter(where) if where else df
        make = Tensor.from_df if self.summed else Tensor.from_cells
        return make(df.select(*[F.col(c).alias(d) for d, c in cols.items()], F.col("l_quantity").alias(VALUE)), list(cols))

    @property
    def a(self) -> Tensor:
        return self._items({"i": "l_orderkey", "j": "l_partkey"})

    @property
    def b(self) -> Tensor:
        return self._items({"j": "l_partkey", "k": "l_suppkey"})

    @property
    def t(self) -> Tensor:
        return self._items({"i": "l_orderkey", "j": "l_partkey", "k": "l_suppkey"})

    @property
    def p(self) -> Tensor:
        return self._items({"i": "l_orderkey", "j": "l_partkey"}, "l_returnflag = 'A'")

    @property
    def q(self) -> Tensor:
        return self._items({"i": "l_orderkey", "j": "l_partkey"}, "l_linestatus = 'O'")

    def _features(self, table: str, key: str, dim: str, cols: list) -> Tensor:
        rows = self.read(table).select(F.col(key).alias("key"), F.array(*[c.cast("double") for c in cols]).alias("row"))
        return Tensor.from_rows(rows, "key", "row", (dim, "f"), len(cols))

    @property
    def d(self) -> Tensor:
        return self._features("part", "p_partkey", "j", [F.col("p_size"), F.col("p_partkey") % 7, F.lit(1)])

    @property
    def d_rows(self) -> DataFrame:
        return self.read("part").select(F.col("p_partkey").alias("j"), F.array(F.col("p_size").cast("double"), (F.col("p_partkey") % 7).cast("double"), F.lit(1.0)).alias("row"))

    @property
    def k(self) -> Tensor:
        return self._features("supplier", "s_suppkey", "k", [F.col("s_nationkey"), F.col("s_suppkey") % 5, F.lit(2)])

    def vector(self, table: str, key: str, value: str, dim: str) -> Tensor:
        cells = self.read(table).select(F.col(key).cast("bigint").alias(dim), F.col(value).cast("double").alias(VALUE))
        return Tensor(cells, (dim,), (None,), "d")

    @property
    def nodes(self) -> DataFrame:
        return self.read("supplier").select("s_suppkey")

    @property
    def edges(self) -> DataFrame:
        """A square graph: supplier to part, for part keys within the suppliers' range."""
        n = self.read("supplier").agg(F.count("*").alias("n"))
        pairs = self.read("lineitem").select(F.col("l_suppkey").alias("s"), F.col("l_partkey").alias("d")).filter("s <> d")
        return graph.undirect(pairs.join(F.broadcast(n), F.col("d") < F.col("n")).select("s", "d"))


def _round(t: Tensor, digits: int) -> DataFrame:
    return t.df.withColumn(VALUE, F.round(VALUE, digits))


def _unfold(rows: DataFrame) -> DataFrame:
    return rows.select("i", F.posexplode("row").alias("f", VALUE)).withColumn("f", F.col("f").cast("bigint"))


def _private_index(x: Tables) -> DataFrame:
    """``i,jk->ik``: j belongs to one operand alone, so it is summed before the two meet."""
    n = x.read("nation").select(F.col("n_nationkey").alias("i"), (F.col("n_nationkey") + 1.0).alias(VALUE))
    return einsum("i,jk->ik", Tensor.from_df(n, ["i"], coalesced=True), x.raw("b")).df


def _vectors(x: Tables) -> tuple[Tensor, Tensor]:
    seven = x.read("part").select(F.col("p_partkey").cast("bigint").alias("j"), (F.col("p_partkey") % 7).cast("double").alias(VALUE))
    return x.vector("part", "p_partkey", "p_size", "j"), Tensor(seven, ("j",), (None,), "d")


def _metrics(x: Tables) -> DataFrame:
    rows = x.read("lineitem").select((F.col("l_partkey") % 3).alias("pred"), (F.col("l_suppkey") % 3).alias("y"), (F.col("l_quantity") / 51).alias("p"))
    return tables.metrics(rows, "pred", "y", "p").select(F.round("accuracy", 9).alias("accuracy"), F.round("nll", 9).alias("nll"))


def _chain(x: Tables) -> DataFrame:
    s = x.vector("supplier", "s_suppkey", "s_nationkey", "k")
    return einsum("ij,jk,k->i", x.raw("a"), x.raw("b"), s).df


def _activations(x: Tables) -> DataFrame:
    z = F.col(VALUE) / 50
    return x.a.df.select("i", "j", F.round(sigmoid(z), 6).alias("sig"), F.round(tanh(z), 6).alias("th"), F.round(gelu(z), 6).alias("gelu"))


def _batched(x: Tables) -> DataFrame:
    left = x._items({"b": "l_linenumber", "i": "l_orderkey", "j": "l_partkey"})
    right = x._items({"b": "l_linenumber", "j": "l_partkey", "k": "l_suppkey"})
    got = einsum("bij,bjk->bik", left, right).df
    return got.withColumn("b", F.col("b").cast("int"))


def _hadamard4(x: Tables) -> DataFrame:
    # unaggregated cells on both sides, as the rows stand: a join on all four coordinates
    t = x.read("lineitem").select(
        F.col("l_orderkey").alias("i"), F.col("l_partkey").alias("j"), F.col("l_suppkey").alias("k"), F.col("l_linenumber").cast("bigint").alias("l"), F.col("l_quantity").alias(VALUE)
    )
    raw = Tensor(t, ("i", "j", "k", "l"), (None,) * 4, "oooo", coalesced=True)
    return hadamard(raw, raw).df


def _outer(x: Tables) -> DataFrame:
    n = x.read("nation").select(F.col("n_nationkey").alias("i"), (F.col("n_nationkey") + 1.0).alias(VALUE))
    r = x.read("region").select(F.col("r_regionkey").alias("j"), (F.col("r_regionkey") + 1.0).alias(VALUE))
    got = outer(Tensor.from_df(n, ["i"], coalesced=True), Tensor.from_df(r, ["j"], coalesced=True))
    return got.df.select(F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("j"), VALUE)


def _broadcast_output(x: Tables) -> DataFrame:
    y = contract([x.b, x.vector("supplier", "s_suppkey", "s_nationkey", "k")], ("j",))
    ones = Tensor(x.read("region").select(F.col("r_regionkey").cast("bigint").alias("k"), F.lit(1.0).alias(VALUE)), ("k",), (None,), "d")
    return outer(y, ones).df.withColumn("k", F.col("k").cast("int"))


def _to_dense(x: Tables) -> DataFrame:
    cells = x.read("nation").select(F.col("n_nationkey").alias("i"), F.col("n_regionkey").alias("j"), (F.col("n_nationkey") + 1.0).alias(VALUE))
    domains = {"i": x.read("nation").select("n_nationkey"), "j": x.read("region").select("r_regionkey")}
    got = convert.to_dense(Tensor.from_df(cells, ["i", "j"]), domains).df
    return got.select(F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("j"), VALUE)


def _self_spgemm(x: Tables) -> DataFrame:
    return einsum("jk,jl->kl", x.b, x.b, dims=("k1", "k2")).df


def _matmul_dense(x: Tables) -> DataFrame:
    return einsum("jf,kf->jk", x.d, x.k, dims=("j", "k")).df


def _csr_pos(x: Tables) -> DataFrame:
    return convert.csr_pointers(convert.transpose(x.b), x.nodes)


def _compound(x: Tables) -> DataFrame:
    p, q, a = (Access(t, ("i", "j")) for t in (x.raw("p"), x.raw("q"), x.raw("a")))
    return evaluate((p + q) * (a + q), ("i", "j")).df


def _attention(x: Tables) -> DataFrame:
    k = x.k
    got = attention.sparse_attention(attention.band_mask(x.nodes, 4), k, k, k, 100.0)
    return _round(got, 5)


def _message_passing(x: Tables) -> DataFrame:
    return graph.message_passing(x.edges, x.k).df


def _text_vocabulary(x: Tables) -> DataFrame:
    return tables.vocabulary(tables.tokens(x.read("documents"), "doc_id", "text"), 1002).select("token", "n", "id")


def _embedding_sddmm(x: Tables) -> DataFrame:
    """Band-masked products of embedding rows, kept as arrays: one joined row a cell, no unfolding."""
    e = x.read("embeddings").select(F.col("vec_id").alias("i"), F.transform("embedding", lambda y: y.cast("double")).alias("x"))
    mask = attention.band_mask(e.select("i"), 4)
    pairs = mask.join(e, "i").join(e.select(F.col("i").alias("j"), F.col("x").alias("y")), "j")
    dot = F.aggregate(F.zip_with("x", "y", lambda a, b: a * b), F.lit(0.0), lambda s, z: s + z)
    return pairs.select("i", "j", (F.round(dot, 5) + 0.0).alias(VALUE))


def _four_dims(x: Tables) -> DataFrame:
    keys = lambda cols: x.read("lineitem").select(*[(F.col(c) % n).cast("bigint").alias(d) for d, (c, n) in cols.items()], F.col("l_quantity").alias(VALUE))
    p = Tensor.from_df(keys({"b": ("l_linenumber", 2), "h": ("l_orderkey", 3), "i": ("l_partkey", 40), "j": ("l_suppkey", 30)}), list("bhij"))
    v = Tensor.from_df(keys({"b": ("l_linenumber", 2), "h": ("l_orderkey", 3), "j": ("l_suppkey", 30), "d": ("l_partkey", 8)}), list("bhjd"))
    return attention.multi_head_attention(p, v).df


def _weights(x: Tables, rows: list[list[float]], dims: tuple[str, str]) -> Tensor:
    cells = [(i, j, float(v)) for i, r in enumerate(rows) for j, v in enumerate(r)]
    return Tensor(x.spark.createDataFrame(cells, f"{dims[0]} long, {dims[1]} long, v double"), dims, (len(rows), len(rows[0])), "dd")


def _vector(x: Tables, values: list[float], dim: str) -> Tensor:
    return Tensor(x.spark.createDataFrame([(k, float(v)) for k, v in enumerate(values)], f"{dim} long, v double"), (dim,), (len(values),), "d")


#: Small weights of the layered queries, the same as in their SQL.
W1, B1, W2, B2 = [[0.1, -0.2, 0.3], [0.05, 0.1, -0.1]], [0.5, -0.25], [[0.2, -0.4], [-0.3, 0.6]], [0.1, 0.0]


def _gcn_forward(x: Tables) -> DataFrame:
    a = graph.gcn_adjacency(x.edges, x.nodes)
    got = graph.gcn_forward(a, x.k, _weights(x, W1, ("h", "f")), _vector(x, B1, "h"), _weights(x, W2, ("o", "h")), _vector(x, B2, "o"))
    i, o = got.dims
    return got.df.select(F.col(i).alias("i"), F.col(o).alias("o"), (F.round(VALUE, 6) + 0.0).alias("lp"))


def _autoencoder(x: Tables) -> DataFrame:
    inputs = convert.transpose(x.k)
    got = prune.sparse_layers(inputs, [(_weights(x, W1, ("h", "f")), _vector(x, B1, "h"), "relu"), (_weights(x, W2, ("o", "h")), _vector(x, B2, "o"), "sigmoid")])
    o, k = got.dims
    return got.df.select(F.col(o).alias("o"), F.col(k).alias("k"), F.round(VALUE, 6).alias("y"))


def _positional(x: Tables) -> DataFrame:
    grid = x.nodes.crossJoin(x.spark.range(4).withColumnRenamed("id", "f"))
    return grid.select(F.col("s_suppkey").alias("i"), "f", (F.round(positional_encoding(F.col("s_suppkey"), F.col("f"), 4), 6) + 0.0).alias("pe"))


def _encode(x: Tables) -> DataFrame:
    """Cut and padded to 8,192 tokens, the sequence length of the model that the operator feeds."""
    toks = tables.tokens(x.read("documents"), "doc_id", "text")
    got = tables.encode(toks, tables.vocabulary(toks, 1002), "doc_id", 8192)
    return got.select("doc_id", F.array_join(F.transform("ids", lambda i: i.cast("string")), ",").alias("ids"))


def _csr_round_trip(x: Tables) -> DataFrame:
    b = convert.transpose(x.b)
    pointers, entries = convert.to_csr(b, x.nodes)
    return Tensor.from_csr(pointers.withColumnRenamed("r", "k"), entries, ("k", "j")).df


def _accuracy(x: Tables) -> DataFrame:
    predicted = graph.argmax(x.b).select("j", (F.col("k") % 2).alias("pred"))
    truth = x.read("part").select(F.col("p_partkey").alias("j"), (F.col("p_size") % 2).cast("bigint").alias("y"), (F.col("p_partkey") % 3 == 0).alias("test"))
    return graph.masked_accuracy(predicted, truth, "j", "test").select(F.round("accuracy", 9).alias("accuracy"))


def _nations(x: Tables) -> Tensor:
    """A matrix of the 25 nations and 5 regions, the same at every size of the tables."""
    cells = x.read("nation").select(F.col("n_nationkey").alias("i"), F.col("n_regionkey").alias("j"), (F.col("n_nationkey") + 1.0).alias(VALUE))
    return Tensor.from_df(cells, ["i", "j"], shape=(25, 5))


def _read_mtx(x: Tables) -> DataFrame:
    """A Matrix Market file, written here as the one text that it is, and read."""
    entry = F.concat_ws(" ", F.col("i") + 1, F.col("j") + 1, VALUE)
    text = F.concat_ws("\n", F.lit("%%MatrixMarket matrix coordinate real general"), F.lit("% nations by region"), F.concat_ws(" ", F.lit(25), F.lit(5), F.count("*")), F.array_join(F.collect_list(entry), "\n"))
    path = scratch(x.spark, "mtx")
    _nations(x).df.agg(text.alias("value")).write.text(path)
    return matrix.read_mtx(x.spark, path).df


def _to_host(x: Tables) -> DataFrame:
    """The nonzero cells of a numpy array."""
    got = _nations(x).to_numpy()
    return x.spark.createDataFrame([(int(i), int(j), float(got[i, j])) for i, j in zip(*got.nonzero(), strict=True)], "i long, j long, v double")


def _graph_source(x: Tables) -> DataFrame:
    path = scratch(x.spark, "graph")
    x.edges.write.parquet(f"{path}/edges.parquet")
    x.nodes.write.parquet(f"{path}/nodes.parquet")
    edges, nodes = matrix.read_graph(x.spark, path)
    return edges.join(nodes.select(F.col("s_suppkey").alias("s")), "s", "left_semi").select("s", "d")


def _results_sink(x: Tables) -> DataFrame:
    """Results appended twice to CSV and once to JSON, all read back."""
    path, got = scratch(x.spark, "results"), x.read("events").groupBy("event_type").agg(F.count("*").alias("n"))
    for kind in ("csv", "csv", "json"):
        matrix.append_results(got, f"{path}/{kind}", kind)
    read = x.spark.read.schema("event_type string, n long")
    return read.csv(f"{path}/csv", header=True).unionByName(read.json(f"{path}/json"))


def _labelled_csv(x: Tables) -> DataFrame:
    path = scratch(x.spark, "labelled")
    x.read("lineitem").select("l_linenumber", "l_returnflag", "l_linestatus").write.csv(path)
    return matrix.read_labelled_csv(x.spark, path, 3)


def _labelled_text(x: Tables) -> DataFrame:
    """A file a region with its nations, in folders named by region, which give the label."""
    path = scratch(x.spark, "folders")
    names = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda n: n["n_name"]), " ")
    x.read("nation").groupBy("n_regionkey").agg(names.alias("value")).write.partitionBy("n_regionkey").text(path)
    return matrix.read_labelled_text(x.spark, path, {f"n_regionkey={k}": k for k in range(5)})


def _random_exact(x: Tables) -> DataFrame:
    t = matrix.random_exact(x.spark, 1000, 800, 5000, 1)
    inside = F.col("i").between(0, 999) & F.col("j").between(0, 799) & (F.col(VALUE) > 0) & (F.col(VALUE) <= 1)
    return t.df.agg(F.count("*").alias("n"), F.count_distinct("i", "j").alias("places"), F.every(inside).alias("inside"))


_QUERIES: dict[str, Callable[[Tables], DataFrame]] = {
    "q_coalesce": lambda x: x.a.df,
    "q_spmv": lambda x: spmv(x.raw("a"), x.vector("part", "p_partkey", "p_size", "j")).df,
    "q_spmv_float": lambda x: _round(spmv(x.raw("a"), x.vector("part", "p_partkey", "p_retailprice", "j")), 4),
    "q_spmm": lambda x: _unfold(spmm_rows(x.raw("a"), x.d_rows, "j", "row", 3)),
    "q_spmm_bias_relu": lambda x: pipeline(x.raw("a"), x.d, [("add", lambda f: -1000.0 * (f + 1)), "relu"]).df,
    "q_spmm_bias": lambda x: pipeline(x.raw("a"), x.d, [("add", Tensor(x.spark.range(3).selectExpr("id as f", "id * 10.0D as v"), ("f",), (3,), "d"))]).df,
    "q_spmm_scale": lambda x: pipeline(x.raw("a"), x.d, [("mul", lambda f: f + 1)]).df,
    "q_spgemm": lambda x: spgemm(x.a, x.b).df,
    "q_self_spgemm": _self_spgemm,
    "q_sddmm": lambda x: sddmm(x.b, x.d, x.k).df,
    "q_matmul_dense": _matmul_dense,
    "q_hadamard": lambda x: hadamard(x.p, x.q).df,
    "q_hadamard3": lambda x: hadamard(x.t, x.t).df,
    "q_hadamard4": _hadamard4,
    "q_outer": _outer,
    "q_matvec_broadcast": lambda x: broadcast_mode(x.a, x.vector("part", "p_partkey", "p_size", "j"), "j").df,
    "q_ttm": lambda x: ttm(x.raw("t"), x.k.rename("k", "m")).df,
    "q_mttkrp": lambda x: mttkrp(x.t, x.d.rename("j", "m"), x.k.rename("k", "m")).df,
    "q_batched_matmul": _batched,
    "q_broadcast_output": _broadcast_output,
    "q_chain": _chain,
    "q_scalar_out": lambda x: einsum("ij,ij->", x.p, x.q).df,
    "q_diag": lambda x: einsum("jj->j", x.b, dims=("i",)).df,
    "q_add": lambda x: add(x.raw("p"), x.raw("q")).df,
    "q_add3": lambda x: add(x.raw("p"), x.raw("q"), x.raw("a")).df,
    "q_sub": lambda x: sub(x.raw("a"), x.raw("p")).df,
    "q_div": lambda x: _round(div(x.p, x.a), 6),
    "q_compound": _compound,
    "q_mul_add": lambda x: add(hadamard(x.p, x.q), x.raw("a")).df,
    "q_activations": _activations,
    "q_transpose": lambda x: convert.transpose(x.a, names=("i", "j")).df,
    "q_to_dense": _to_dense,
    "q_to_sparse": lambda x: convert.to_sparse(sub(x.raw("a"), x.raw("p"))).df,
    "q_csr_pos": _csr_pos,
    "q_nnz_row": lambda x: convert.row_counts(x.a),
    "q_undirect": lambda x: x.edges,
    "q_gcn_norm": lambda x: graph.gcn_adjacency(x.edges, x.nodes).df.select("s", "d", F.round(VALUE, 6).alias("w")),
    "q_message_passing": _message_passing,
    "q_log_softmax": lambda x: graph.log_softmax(x.k).df.select("k", "f", (F.round(VALUE, 6) + 0.0).alias("lp")),
    "q_row_softmax": lambda x: _round(attention.row_softmax(x.b, 10.0), 6).withColumnRenamed(VALUE, "p"),
    "q_argmax": lambda x: graph.argmax(x.b),
    "q_subgraph": lambda x: graph.subgraph(x.edges, x.nodes.filter("s_suppkey % 2 = 0")),
    "q_longformer_mask": lambda x: attention.longformer_mask(x.nodes, 4),
    "q_block_mask": lambda x: attention.block_mask(x.nodes, 8, 4),
    "q_attention": _attention,
    "q_prune": lambda x: prune.prune(x.a, 0.9).df,
    "q_timing_summary": lambda x: tables.timing_summary(x.read("events"), "event_type", "value").select(
        "event_type", "mn", F.round("av", 6).alias("av"), F.round("sd", 6).alias("sd"), F.round("md", 6).alias("md")),
    "q_completed": lambda x: tables.completed(x.read("events"), "user_id", "event_type", ("click", "error")),
    "q_vocabulary": _text_vocabulary,
    "q_embedding_sddmm": _embedding_sddmm,
    "q_attention4": lambda x: _four_dims(x),
    "q_transposed_rhs": lambda x: einsum("ij,fj->if", x.raw("a"), convert.transpose(x.d)).df,
    "q_gcn_forward": lambda x: _gcn_forward(x),
    "q_autoencoder": lambda x: _autoencoder(x),
    "q_positional": lambda x: _positional(x),
    "q_layer_norm": lambda x: tables.layer_norm(x.k.df, "k", VALUE).select("k", "f", (F.round("normed", 6) + 0.0).alias("normed")),
    "q_encode": lambda x: _encode(x),
    "q_csr_round_trip": lambda x: _csr_round_trip(x),
    "q_accuracy": lambda x: _accuracy(x),
    "q_relabel": lambda x: graph.relabel(x.nodes.filter("s_suppkey % 3 = 1")),
    "q_runtime": lambda x: tables.runtime_by_size(x.read("events"), "event_type", "value").select("event_type", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std")),
    "q_mse": lambda x: tables.mean_squared_error(x.read("lineitem"), "l_discount", "l_tax").select(F.round("mse", 9).alias("mse")),
    "q_spmm_long": lambda x: spmm(x.raw("a"), x.d).df,
    "q_private_index": lambda x: _private_index(x),
    "q_vector_matrix": lambda x: matmul(x.vector("part", "p_partkey", "p_size", "j"), x.raw("b")).df,
    "q_dot": lambda x: matmul(*_vectors(x)).df,
    "q_sddmm_kj": lambda x: sddmm(x.b, x.d, convert.transpose(x.k), transposed=False).df,
    "q_mode_order": lambda x: convert.change_mode_order(x.a, (1, 0)).df,
    "q_metrics": lambda x: _metrics(x),
    "q_compiled": lambda x: compiled(lambda a, d: pipeline(a, d, [("mul", lambda f: f + 1)]))(x.raw("a"), x.d).df,
    "q_read_mtx": lambda x: _read_mtx(x),
    "q_to_host": lambda x: _to_host(x),
    "q_graph_source": lambda x: _graph_source(x),
    "q_results_sink": lambda x: _results_sink(x),
    "q_labelled_csv": lambda x: _labelled_csv(x),
    "q_labelled_text": lambda x: _labelled_text(x),
    "q_random_exact": lambda x: _random_exact(x),
    "q_matmul_vector": lambda x: matmul(x.raw("a"), x.vector("part", "p_partkey", "p_size", "j")).df,
}


def queries() -> dict[str, Query]:
    return {name: (lambda spark, sf_dir, f=f: f(Tables(spark, sf_dir))) for name, f in _QUERIES.items()}

"""Graph operators over edge lists ``(s, d)``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparrowgrid.operators.contract import spgemm
from sparrowgrid.operators.convert import coalesce
from sparrowgrid.operators.fused import pipeline
from sparrowgrid.operators.rows import exponential_sums
from sparrowgrid.tensor import VALUE, Tensor


def undirect(edges: DataFrame) -> DataFrame:
    """Both directions, each once."""
    return edges.select("s", "d").unionByName(edges.select(F.col("d").alias("s"), F.col("s").alias("d"))).distinct()


def degree(edges: DataFrame) -> DataFrame:
    return edges.groupBy("s").agg(F.count("*").alias("n"))


def gcn_adjacency(edges: DataFrame, nodes: DataFrame) -> Tensor:
    """``D^-1/2 (A + I) D^-1/2`` of distinct undirected edges; ``nodes`` has one column."""
    own = nodes.select(F.col(nodes.columns[0]).alias("s"), F.col(nodes.columns[0]).alias("d"))
    loops = edges.select("s", "d").unionByName(own)
    n = degree(loops)
    w = 1 / F.sqrt(F.col("ns").cast("double")) / F.sqrt(F.col("nd").cast("double"))
    joined = loops.join(n.withColumnRenamed("n", "ns"), "s").join(n.select(F.col("s").alias("d"), F.col("n").alias("nd")), "d")
    return Tensor(joined.select("s", "d", w.alias(VALUE)), ("s", "d"), (None, None), "oo")


def message_passing(edges: DataFrame, features: Tensor) -> Tensor:
    """Sum of the features of a node's in-neighbours."""
    node, f = features.dims
    got = edges.join(features.df.withColumnRenamed(node, "s"), "s").groupBy(F.col("d").alias("i"), f).agg(F.sum(VALUE).alias(VALUE))
    return Tensor(got, ("i", f), (features.shape[0], features.shape[1]), "dd")


def log_softmax(t: Tensor) -> Tensor:
    """Over the last mode. No row is held in one task."""
    t = coalesce(t)
    return t.with_df(exponential_sums(t).select(*t.dims, (F.col("_z") - F.log("_sum")).alias(VALUE)))


def gcn_forward(adjacency: Tensor, x: Tensor, w1: Tensor, b1: Tensor, w2: Tensor, b2: Tensor) -> Tensor:
    """``log_softmax(A relu(A X W1' + b1) W2' + b2)``; weights are (out, in)."""
    from sparrowgrid.operators.convert import transpose

    hidden = pipeline(adjacency, spgemm(x, transpose(w1)), [("add", b1), "relu"])
    return log_softmax(pipeline(adjacency, spgemm(hidden, transpose(w2)), [("add", b2)]))


def argmax(t: Tensor) -> DataFrame:
    """The coordinate of the largest value of each row; ties go to the smaller one. No row is sorted."""
    i, k = t.dims
    t = coalesce(t)
    best = F.max_by(F.col(k), F.struct(F.col(VALUE), -F.col(k))).alias(k)
    return t.df.groupBy(i).agg(best)


def masked_accuracy(predicted: DataFrame, truth: DataFrame, key: str, mask: str) -> DataFrame:
    """``predicted`` (key, pred), ``truth`` (key, y, mask): share of equal labels where the mask holds."""
    hit = (F.col("pred") == F.col("y")).cast("double")
    return truth.filter(F.col(mask)).join(predicted, key).agg(F.avg(hit).alias("accuracy"))


def subgraph(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges between the given nodes."""
    own = nodes.select(F.col(nodes.columns[0]).alias("_n")).distinct()
    return edges.join(own, F.col("s") == F.col("_n"), "left_semi").join(own, F.col("d") == F.col("_n"), "left_semi")


def relabel(nodes: DataFrame) -> DataFrame:
    """``(node, rank)``: dense ranks of a node batch, from 0, by node id."""
    from sparrowgrid.operators.convert import running_sum

    node = nodes.columns[0]
    got = running_sum(nodes.select(F.col(node).cast("bigint").alias(node)).distinct(), node, F.lit(1))
    return got.select(node, (F.col("running") - 1).alias("rank"))

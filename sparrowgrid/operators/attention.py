"""Sparse attention: masks, row softmax, and the SDDMM-softmax-SpMM chain."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparrowgrid.operators.contract import contract, sddmm
from sparrowgrid.operators.convert import coalesce
from sparrowgrid.operators.rows import exponential_sums
from sparrowgrid.tensor import VALUE, Tensor


def band_mask(nodes: DataFrame, width: int) -> DataFrame:
    """``(i, j)`` with ``|i - j| <= width``: every position is unfolded to its band and joined by equality,
    so rows grow with ``n * width`` and no range join is needed."""
    n = nodes.select(F.col(nodes.columns[0]).cast("bigint").alias("i"))
    wide = n.select("i", F.explode(F.sequence(F.col("i") - width, F.col("i") + width)).alias("j"))
    return wide.join(n.select(F.col("i").alias("j")), "j", "left_semi").select("i", "j")


def longformer_mask(nodes: DataFrame, width: int, global_nodes: tuple[int, ...] = (0,)) -> DataFrame:
    """The band, and whole rows and columns of a few global positions; each cell once."""
    n = nodes.select(F.col(nodes.columns[0]).cast("bigint").alias("i"))
    marks = F.array(*[F.lit(g).cast("bigint") for g in global_nodes])
    have = n.filter(F.col("i").isin(*global_nodes)).agg(F.collect_list("i").alias("g"))
    g = n.crossJoin(F.broadcast(have)).select("i", F.explode(F.array_intersect("g", marks)).alias("j"))
    every = g.unionByName(g.select(F.col("j").alias("i"), F.col("i").alias("j")))
    return band_mask(nodes, width).unionByName(every).distinct()


def block_mask(nodes: DataFrame, width: int, block: int) -> DataFrame:
    """Band cells whose both coordinates are multiples of ``block``."""
    n = nodes.select(F.col(nodes.columns[0]).cast("bigint").alias("i")).filter(F.col("i") % block == 0)
    return band_mask(n, width).filter(F.col("j") % block == 0)


def row_softmax(t: Tensor, scale: float = 1.0) -> Tensor:
    """Over the stored cells of each row; ``scale`` divides first. No row is held in one task."""
    t = coalesce(t)
    return t.with_df(exponential_sums(t, scale).select(*t.dims, (F.exp("_z") / F.col("_sum")).alias(VALUE)))


def sparse_attention(mask: DataFrame, q: Tensor, k: Tensor, v: Tensor, scale: float) -> Tensor:
    """``softmax(mask * (Q K') / scale) V`` for modes (position, feature)."""
    ones = Tensor(mask.select("i", "j", F.lit(1.0).alias(VALUE)), ("i", "j"), (None, None), "oo")
    scores = sddmm(ones, q, k).map(lambda x: x / scale)
    p = row_softmax(scores)
    return contract([p.rename("i", "j"), v.rename("j", "f")], ("i", "f"))


def multi_head_attention(p: Tensor, v: Tensor) -> Tensor:
    """``bhij,bhjd->bhid``."""
    from sparrowgrid.operators.contract import einsum

    return einsum("bhij,bhjd->bhid", p, v)

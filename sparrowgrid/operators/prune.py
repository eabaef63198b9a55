"""Magnitude pruning and sparse feed-forward layers."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparrowgrid.operators.contract import matmul
from sparrowgrid.operators.convert import coalesce
from sparrowgrid.operators.elementwise import broadcast_mode
from sparrowgrid.sources.scratch import scratch
from sparrowgrid.tensor import VALUE, Tensor


#: Distinct magnitudes that the driver sorts.
FEW = 4096


def kth_value(t: Tensor, k: int | None = None, share: float | None = None) -> float | None:
    """The k-th smallest magnitude (from 1), or that at a share of the stored cells, rounded down; exactly, without a
    global sort. None if there is no such cell.

    Up to FEW distinct magnitudes are counted in one pass. With more, a range of values is narrowed by counts of
    1,024 bins until few remain: each pass is one aggregation with bounded output, over counts written once.
    """
    counts = coalesce(t).df.select(F.abs(VALUE).alias("a")).groupBy("a").agg(F.count("*").alias("n"))

    def sorted_pick(rows: list, k: int) -> float | None:
        for a, n in sorted(rows):
            k -= n
            if k <= 0:
                return a
        return None

    few = counts.limit(FEW + 1).collect()
    if len(few) <= FEW:
        k = int(sum(n for _, n in few) * share) if k is None else k
        return sorted_pick(few, k) if k >= 1 else None
    path = scratch(t.df.sparkSession, "magnitudes")
    counts.write.parquet(path)
    counts = t.df.sparkSession.read.schema(counts.schema).parquet(path)
    low, high, total = counts.agg(F.min("a"), F.max("a"), F.sum("n")).first()
    k = int(total * share) if k is None else k
    if k < 1 or k > total:
        return None
    while low < high:
        inside = counts.filter(F.col("a").between(low, high))
        few = inside.limit(FEW + 1).collect()
        if len(few) <= FEW:
            return sorted_pick(few, k)
        at = F.least(F.floor((F.col("a") - low) / ((high - low) / 1024)), F.lit(1023))
        bins = inside.groupBy(at.alias("b")).agg(F.sum("n").alias("n"), F.min("a").alias("lo"), F.max("a").alias("hi")).collect()
        for _, n, lo, hi in sorted(bins):
            if k <= n:
                low, high = lo, hi
                break
            k -= n
    return low


def prune(t: Tensor, sparsity: float) -> Tensor:
    """Keeps cells whose magnitude is at least the ``floor(n * sparsity)``-th smallest; ties stay."""
    t = coalesce(t)
    limit = kth_value(t, share=sparsity)
    return t if limit is None else t.with_df(t.df.filter(F.abs(VALUE) >= F.lit(limit)))


def sparse_layers(x: Tensor, layers: list[tuple[Tensor, Tensor | None, str | None]]) -> Tensor:
    """``act(W x + b)`` for each (weights, bias, activation); ``x`` has modes (feature, example)."""
    from sparrowgrid.functions.activations import BY_NAME

    for w, b, act in layers:
        x = matmul(w, x)
        if b is not None:
            x = broadcast_mode(x, b, x.dims[0], "add")
        if act:
            x = x.map(BY_NAME[act])
    return x

"""Elementwise operators: a union of cells and a sum, or an inner join of cells."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from sparrowgrid.operators.convert import coalesce
from sparrowgrid.tensor import ACCUMULATOR, VALUE, ShapeError, Tensor


def _agree(*tensors: Tensor) -> None:
    first = tensors[0]
    for t in tensors[1:]:
        if t.rank != first.rank or any(m is not None and n is not None and m != n for m, n in zip(t.shape, first.shape, strict=True)):
            raise ShapeError(f"shapes {first.shape} and {t.shape}")


def _bag(tensors: tuple[Tensor, ...], signs: tuple[int, ...]) -> Tensor:
    _agree(*tensors)
    first = tensors[0]
    wide = ACCUMULATOR[first.dtype]
    parts = [t.rename(*first.dims).df.withColumn(VALUE, (F.col(VALUE) if s > 0 else -F.col(VALUE)).cast(wide)) for t, s in zip(tensors, signs, strict=True)]
    df = reduce(lambda a, b: a.unionByName(b), parts).groupBy(*first.dims).agg(F.sum(VALUE).alias(VALUE))
    return first.with_df(df, coalesced=True)


def add(*tensors: Tensor) -> Tensor:
    """n terms in one union and one aggregation; the result has the first one's format. Zeros that arise stay."""
    return _bag(tensors, (1,) * len(tensors))


def sub(a: Tensor, b: Tensor) -> Tensor:
    return _bag((a, b), (1, -1))


def hadamard(a: Tensor, b: Tensor) -> Tensor:
    """Cell by cell product on common coordinates."""
    from sparrowgrid.operators.contract import contract

    _agree(a, b)
    return contract([a, b.rename(*a.dims)], a.dims, a.fmt)


mul = hadamard


def div(a: Tensor, b: Tensor) -> Tensor:
    """Cell by cell quotient on common coordinates; a stored zero in ``b`` gives null, which is no cell."""
    _agree(a, b)
    a, b = coalesce(a), coalesce(b)
    joined = a.df.withColumnRenamed(VALUE, "_x").join(b.rename(*a.dims).df.withColumnRenamed(VALUE, "_y"), list(a.dims))
    return a.with_df(joined.select(*a.dims, F.try_divide(F.col("_x"), F.col("_y")).alias(VALUE)).dropna())


def broadcast_mode(a: Tensor, x: Tensor, mode: str, how: str = "mul") -> Tensor:
    """``A[.., j] * x[j]`` or ``A[.., j] + x[j]`` on the stored cells of ``A``."""
    (d,) = x.dims
    a, x = coalesce(a), coalesce(x)
    joined = a.df.withColumnRenamed(VALUE, "_x").join(x.df.select(F.col(d).alias(mode), F.col(VALUE).alias("_y")), mode, "inner" if how == "mul" else "left")
    value = F.col("_x") * F.col("_y") if how == "mul" else F.col("_x") + F.coalesce("_y", F.lit(0))
    return a.with_df(joined.select(*a.dims, value.alias(VALUE)))

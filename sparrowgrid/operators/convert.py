"""Layouts: dense grids, zero removal, transposition, CSR pointers."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparrowgrid.functions.activations import BY_NAME, KEEPS_ZERO
from sparrowgrid.tensor import ACCUMULATOR, VALUE, ShapeError, Tensor, check_format

#: Cells of a dense grid beyond which to_dense asks for leave.
GRID_BUDGET = 10**10


def coalesce(t: Tensor) -> Tensor:
    """One row a coordinate."""
    if t.coalesced:
        return t
    return t.with_df(t.df.groupBy(*t.dims).agg(F.sum(F.col(VALUE).cast(ACCUMULATOR[t.dtype])).alias(VALUE)), coalesced=True)


def to_dense(t: Tensor, domains: dict[str, DataFrame] | None = None, budget: int = GRID_BUDGET) -> Tensor:
    """Every coordinate, absent ones as 0. ``domains`` gives a mode's coordinates where they aren't 0..n-1."""
    spark, grid, cells = t.df.sparkSession, None, 1
    for d, n in zip(t.dims, t.shape, strict=True):
        own = (domains or {}).get(d)
        if own is None and n is None:
            raise ShapeError(f"mode {d} has no extent")
        cells *= n or 1
        axis = own.select(F.col(own.columns[0]).cast("bigint").alias(d)).distinct() if own is not None else spark.range(n).select(F.col("id").alias(d))
        grid = axis if grid is None else grid.crossJoin(axis)
    if cells > budget:
        raise ShapeError(f"a grid of {cells} cells; the budget is {budget}")
    stored = to_sparse(t).df
    df = grid.join(stored, list(t.dims), "left").select(*t.dims, F.coalesce(VALUE, F.lit(0).cast(t.dtype)).alias(VALUE))
    return Tensor(df, t.dims, t.shape, "d" * t.rank)


def to_sparse(t: Tensor, fmt: str | None = None) -> Tensor:
    """Without stored zeros, coalesced; all-compressed unless a format is given."""
    got = coalesce(t)
    return got.with_df(got.df.filter(F.col(VALUE) != 0), fmt=check_format(fmt or "s" * t.rank, t.rank))


def transpose(t: Tensor, *dims: str, names: tuple[str, ...] | None = None) -> Tensor:
    """Modes in another order: names of modes, reversed if none are given. No data moves."""
    dims = dims or t.dims[::-1]
    at = [t.dims.index(d) for d in dims]
    out = Tensor(t.df.select(*dims, VALUE), tuple(dims), tuple(t.shape[k] for k in at), "".join(t.fmt[k] for k in at), t.coalesced)
    return out.rename(*names) if names else out


def change_mode_order(t: Tensor, order: tuple[int, ...]) -> Tensor:
    """Physical clustering by another mode order; the logical shape stays. Zeros go, as in a conversion."""
    if sorted(order) != list(range(t.rank)):
        raise ValueError(f"{order} isn't an order of {t.rank} modes")
    return replace(to_sparse(t, t.fmt), order=tuple(order)).clustered()


def running_sum(df: DataFrame, order: str, value: Column, block_rows: int = 1_000_000) -> DataFrame:
    """``df`` with ``running``, the inclusive prefix sum of ``value`` along the integer column ``order``.

    Two passes: sums of blocks of ``order`` (one small row a block), then a window inside each block; no
    window ever holds all rows.
    """
    block = F.floor(F.col(order) / block_rows)
    got = df.withColumn("_b", block).withColumn("_x", value)
    sums = got.groupBy("_b").agg(F.sum("_x").alias("_s"))
    sums = sums.select("_b", F.coalesce(F.sum("_s").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = F.sum("_x").over(Window.partitionBy("_b").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return got.join(sums, "_b").withColumn("running", (inside + F.col("_before")).cast("bigint")).drop("_b", "_x", "_before")


def csr_pointers(t: Tensor, rows: DataFrame | None = None) -> DataFrame:
    """``(r, pos_end)`` for every row of the first mode, empty rows included."""
    i = t.dims[0]
    counts = coalesce(t).df.groupBy(F.col(i).alias("r")).agg(F.count("*").alias("n"))
    if rows is None:
        if t.shape[0] is None:
            raise ShapeError(f"mode {i} has no extent")
        rows = t.df.sparkSession.range(t.shape[0])
    every = rows.select(F.col(rows.columns[0]).cast("bigint").alias("r")).join(counts, "r", "left")
    return running_sum(every, "r", F.coalesce("n", F.lit(0))).select("r", F.col("running").alias("pos_end"))


def to_csr(t: Tensor, rows: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Pointers ``(r, pos_end)`` and entries ``(p, j, v)`` numbered by row and column from 0."""
    i, j = t.dims
    got = to_sparse(t, "ds")
    pointers = csr_pointers(got, rows)
    size = got.df.groupBy(F.col(i).alias("r")).agg(F.count("*").alias("n"))
    start = pointers.join(size, "r").select(F.col("r").alias(i), (F.col("pos_end") - F.col("n")).alias("start"))
    inside = F.row_number().over(Window.partitionBy(i).orderBy(j)) - 1
    entries = got.df.join(start, i).select((F.col("start") + inside).cast("bigint").alias("p"), j, VALUE)
    return pointers, entries


def row_counts(t: Tensor) -> DataFrame:
    return coalesce(t).df.groupBy(t.dims[0]).agg(F.count("*").alias("nnz"))


def apply(t: Tensor, name: str) -> Tensor:
    """An activation by name. One that moves zero needs a dense tensor."""
    if not KEEPS_ZERO[name] and "s" in t.fmt + "".join("s" if k == "o" else "" for k in t.fmt):
        raise ValueError(f"{name} moves zero: make the tensor dense first")
    return t.map(BY_NAME[name])

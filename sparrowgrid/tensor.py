"""The tensor wrapper: a lazy DataFrame (one BIGINT column a mode, one value column) and its metadata."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VALUE = "v"
#: Value types a tensor may hold, and the wider type in which products are summed.
ACCUMULATOR = {"float": "double", "double": "double", "tinyint": "bigint", "smallint": "bigint", "int": "bigint", "bigint": "bigint"}


def stored(df: DataFrame, dims: Sequence[str]) -> DataFrame:
    """Rows without a null coordinate or value; NaN is a value."""
    return df.filter(reduce(and_, [F.col(c).isNotNull() for c in (*dims, VALUE)]))


class ShapeError(ValueError):
    """Operands whose modes don't agree."""


def check_format(fmt: str | Sequence[str], rank: int) -> str:
    """One letter a mode: d(ense), s (compressed) or o (coordinate); long names are taken too."""
    names = {"dense": "d", "compressed": "s", "sparse": "s", "c": "s", "coordinate": "o", "coord": "o"}
    out = "".join(names.get(x, x) for x in ([fmt] if isinstance(fmt, str) and fmt in names else fmt))
    if set(out) - set("dso") or len(out) != rank:
        raise ValueError(f"format {fmt!r} doesn't describe {rank} modes")
    return out


@dataclass(frozen=True)
class Tensor:
    """Immutable. ``df`` has the columns ``dims`` (BIGINT, never null) and ``v``.

    A coordinate without a row is zero. ``shape`` is logical and may be unknown (None for a mode).
    ``coalesced`` says that no coordinate has two rows, which lets later operators skip an aggregation.
    ``order`` is the mode order of the physical clustering, metadata only.
    """

    df: DataFrame
    dims: tuple[str, ...]
    shape: tuple[int | None, ...]
    fmt: str
    coalesced: bool = True
    order: tuple[int, ...] | None = None

    def __post_init__(self) -> None:
        if len(self.dims) != len(self.shape) or len(set(self.dims)) != len(self.dims):
            raise ShapeError(f"modes {self.dims} and shape {self.shape} don't agree")
        check_format(self.fmt, len(self.dims))

    @staticmethod
    def from_df(df: DataFrame, dims: Sequence[str], value: str = VALUE, shape: Sequence[int | None] | None = None, fmt: str | None = None, coalesced: bool = False, dtype: str = "double") -> Tensor:
        """Columns of any frame as a tensor. Rows with a null coordinate or value are no cells and go.

        Rows that share a coordinate are summed unless ``coalesced`` promises that there are none.
        """
        if dtype not in ACCUMULATOR:
            raise TypeError(f"no tensor of {dtype}")
        rank = len(dims)
        cols = [F.col(d).cast("bigint").alias(d) for d in dims]
        cells = stored(df.select(*cols, F.col(value).cast(dtype).alias(VALUE)), dims)
        if not coalesced:
            cells = cells.groupBy(*dims).agg(F.sum(F.col(VALUE).cast(ACCUMULATOR[dtype])).alias(VALUE))
        return Tensor(cells, tuple(dims), tuple(shape or [None] * rank), check_format(fmt or "o" * rank, rank))

    @staticmethod
    def from_cells(df: DataFrame, dims: Sequence[str], value: str = VALUE, shape: Sequence[int | None] | None = None, fmt: str | None = None) -> Tensor:
        """As ``from_df``, but rows that share a coordinate stay as they are until an operator sums them.

        Sums of products and additions don't mind, and save a shuffle; elementwise functions, counts and row
        operators need ``convert.coalesce`` first.
        """
        cols = [F.col(d).cast("bigint").alias(d) for d in dims]
        cells = stored(df.select(*cols, F.col(value).cast("double").alias(VALUE)), dims)
        return Tensor(cells, tuple(dims), tuple(shape or [None] * len(dims)), check_format(fmt or "o" * len(dims), len(dims)), coalesced=False)

    @staticmethod
    def from_rows(df: DataFrame, key: str, array: str, dims: Sequence[str], width: int | None = None) -> Tensor:
        """A dense matrix kept as one array a row, unfolded to cells."""
        cells = df.select(F.col(key).cast("bigint").alias(dims[0]), F.posexplode(array).alias(dims[1], VALUE))
        cells = cells.select(dims[0], F.col(dims[1]).cast("bigint").alias(dims[1]), F.col(VALUE).cast("double").alias(VALUE))
        return Tensor(stored(cells, dims), tuple(dims), (None, width), "dd")

    @staticmethod
    def from_csr(rows: DataFrame, cells: DataFrame, dims: Sequence[str], shape: Sequence[int | None] | None = None) -> Tensor:
        """From pointers ``(i, pos_end)`` and entries ``(p, j, v)``, p counting entries from 0.

        The row of an entry is the first whose ``pos_end`` exceeds p: pointers become spans of entries, and
        every span is unfolded to its entry numbers, so that the join is on equality.
        """
        from pyspark.sql import Window

        i, j = dims
        block = F.floor(F.col(i) / 1_000_000)  # spans of neighbouring rows, bounded for every task
        ends = rows.select(F.col(i).cast("bigint").alias(i), F.col("pos_end").cast("bigint").alias("e"))
        edge = ends.groupBy(block.alias("b")).agg(F.max("e").alias("last"))
        edge = edge.select((F.col("b") + 1).alias("b"), F.col("last").alias("from_before"))
        spans = ends.withColumn("b", block).join(edge, "b", "left")
        before = F.coalesce(F.lag("e").over(Window.partitionBy("b").orderBy(i)), "from_before", F.lit(0))
        spans = spans.withColumn("s", before).filter("e > s")
        owner = spans.select(i, F.explode(F.sequence("s", F.col("e") - 1)).alias("p"))
        got = owner.join(cells, "p").select(i, F.col(j).cast("bigint").alias(j), F.col(VALUE).cast("double").alias(VALUE))
        return Tensor(got, tuple(dims), tuple(shape or (None, None)), "ds")

    # -- metadata ---------------------------------------------------------------------------
    @property
    def rank(self) -> int:
        return len(self.dims)

    @property
    def dtype(self) -> str:
        return dict(self.df.dtypes)[VALUE]

    def nnz(self) -> int:
        """Stored cells, explicit zeros included."""
        return self.df.count()

    def to_numpy(self, most: int = 10_000_000):
        """A numpy array of a tensor of known shape with at most ``most`` cells; more are refused, not cut."""
        import numpy as np

        if None in self.shape or (cells := int(np.prod(self.shape))) > most:
            raise ShapeError(f"{self.shape} is unknown or beyond {most} cells")
        out = np.zeros(self.shape)
        got = self.df.limit(cells + 1).toPandas()
        np.add.at(out, tuple(got[d].to_numpy() for d in self.dims), got[VALUE].to_numpy())
        return out

    def rename(self, *dims: str) -> Tensor:
        if len(dims) != self.rank:
            raise ShapeError(f"{len(dims)} names for {self.rank} modes")
        cols = [F.col(a).alias(b) for a, b in zip(self.dims, dims, strict=True)]
        return replace(self, df=self.df.select(*cols, VALUE), dims=tuple(dims))

    def with_df(self, df: DataFrame, **changes: object) -> Tensor:
        return replace(self, df=df, **changes)

    def map(self, f) -> Tensor:
        """``f`` over stored cells; it must keep zero, or the tensor must be dense."""
        if not self.coalesced:
            from sparrowgrid.operators.convert import coalesce

            return coalesce(self).map(f)
        return self.with_df(self.df.select(*self.dims, f(F.col(VALUE)).alias(VALUE)))

    def sorted(self) -> DataFrame:
        """Cells in mode order, for exports."""
        order = self.order or range(self.rank)
        return self.df.orderBy(*[self.dims[k] for k in order])

    def clustered(self) -> Tensor:
        """Cells of one first coordinate together and sorted, for writing."""
        first = self.dims[(self.order or (0,))[0]]
        order = [self.dims[k] for k in (self.order or range(self.rank))]
        return self.with_df(self.df.repartition(first).sortWithinPartitions(*order))

    # -- operators --------------------------------------------------------------------------
    def __add__(self, other: Tensor) -> Tensor:
        from sparrowgrid.operators.elementwise import add

        return add(self, other)

    def __sub__(self, other: Tensor) -> Tensor:
        from sparrowgrid.operators.elementwise import sub

        return sub(self, other)

    def __mul__(self, other: Tensor | float) -> Tensor:
        from sparrowgrid.operators.elementwise import hadamard

        return hadamard(self, other) if isinstance(other, Tensor) else self.map(lambda v: v * other)

    __rmul__ = __mul__

    def __neg__(self) -> Tensor:
        return self.map(lambda v: -v)

    def __truediv__(self, other: Tensor) -> Tensor:
        from sparrowgrid.operators.elementwise import div

        return div(self, other)

    def __matmul__(self, other: Tensor) -> Tensor:
        from sparrowgrid.operators.contract import matmul

        return matmul(self, other)

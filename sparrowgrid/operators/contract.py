"""Contractions: products summed over the indices that the output lacks, as equi-joins and aggregations."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add, or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparrowgrid.plans.expr import Contraction, index_extents, infer_format, parse_einsum
from sparrowgrid.plans.planner import estimate, plan
from sparrowgrid.tensor import ACCUMULATOR, VALUE, ShapeError, Tensor, check_format

LETTERS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Extent of a dense mode up to which a product of two dense operands keeps it as columns.
NARROW = 64
#: Parts that each side of such a product is dealt to, at most: their pairs may be tasks.
DEALT = 256


def _diagonal(t: Tensor, letters: str) -> Tensor:
    """An operand under the columns of its letters; a repeated letter keeps the diagonal."""
    df, seen, cols, shape, fmt = t.df, {}, [], [], []
    for d, x, n, k in zip(t.dims, letters, t.shape, t.fmt, strict=True):
        if x in seen:
            df = df.filter(F.col(d) == F.col(seen[x]))
            continue
        seen[x] = d
        cols.append(F.col(d).alias(x))
        shape.append(n)
        fmt.append(k)
    return Tensor(df.select(*cols, VALUE), tuple(seen), tuple(shape), "".join(fmt), t.coalesced)


def _total(df: DataFrame, keep: Sequence[str], dtype: str) -> DataFrame:
    total = F.sum(F.col(VALUE).cast(ACCUMULATOR[dtype])).alias(VALUE)
    return df.groupBy(*keep).agg(total) if keep else df.agg(F.coalesce(total, F.lit(0).cast(ACCUMULATOR[dtype])).alias(VALUE))


def _summed(t: Tensor, keep: Sequence[str]) -> Tensor:
    """A tensor without the modes that aren't kept; an empty one stays empty."""
    total = F.sum(F.col(VALUE).cast(ACCUMULATOR[t.dtype])).alias(VALUE)
    df = t.df.groupBy(*keep).agg(total) if keep else t.df.agg(total).filter(F.col(VALUE).isNotNull())
    shape, fmt = dict(zip(t.dims, t.shape, strict=True)), dict(zip(t.dims, t.fmt, strict=True))
    return Tensor(df, tuple(keep), tuple(shape[d] for d in keep), "".join(fmt[d] for d in keep))


def _narrow(a: Tensor, b: Tensor, keep: Sequence[str]) -> int | None:
    """The extent of the only shared mode, if it is summed, dense and short in both and both have other modes, all kept."""
    shared = set(a.dims) & set(b.dims)
    if len(shared) != 1 or min(a.rank, b.rank) < 2 or {*a.dims, *b.dims} - shared != {*a.dims, *b.dims} & set(keep):
        return None
    n, m = (t.shape[t.dims.index(*shared)] for t in (a, b))
    dense = all(t.fmt[t.dims.index(*shared)] == "d" for t in (a, b))
    return n if dense and n == m and n is not None and n <= NARROW else None


def _dense_pair(a: Tensor, b: Tensor, f: str, n: int) -> Tensor:
    """Every row of one operand with every row of the other, the ``n`` values of mode ``f`` being columns of a row.

    The result has as many cells as rows meet, and none is shuffled: an equi-join on ``f`` would make ``n`` times as
    many and sum them in an aggregate. A pair that shares no index has no cell, as there.
    """
    parts = min(int(a.df.sparkSession.conf.get("spark.sql.shuffle.partitions")), DEALT)
    wide = ACCUMULATOR[a.dtype]

    def rows(t: Tensor, name: str) -> tuple[DataFrame, list[str]]:
        free = [d for d in t.dims if d != f]
        values = [F.sum(F.when(F.col(f) == k, F.col(VALUE).cast(wide))).alias(f"{name}{k}") for k in range(n)]
        # dealt by number: the two are small, their product isn't
        return t.df.filter(F.col(f).between(0, n - 1)).repartition(parts, *free).groupBy(*free).agg(*values), free

    (left, own), (right, others) = rows(a, "_x"), rows(b, "_y")
    products = [F.col(f"_x{k}") * F.col(f"_y{k}") for k in range(n)]
    met = reduce(or_, [F.col(f"_x{k}").isNotNull() & F.col(f"_y{k}").isNotNull() for k in range(n)])
    total = reduce(add, [F.coalesce(p, F.lit(0).cast(wide)) for p in products])
    df = left.crossJoin(right).filter(met).select(*own, *others, total.alias(VALUE))
    extents = dict(zip(a.dims, a.shape, strict=True)) | dict(zip(b.dims, b.shape, strict=True))
    return Tensor(df, (*own, *others), tuple(extents[d] for d in (*own, *others)), "o" * len((*own, *others)))


def _pair(a: Tensor, b: Tensor, keep: Sequence[str], summed: bool) -> Tensor:
    shared = [d for d in a.dims if d in b.dims]
    if n := _narrow(a, b, keep):
        return _dense_pair(a, b, shared[0], n)
    wide = ACCUMULATOR[a.dtype]
    left = a.df.withColumnRenamed(VALUE, "_x")
    right = b.df.withColumnRenamed(VALUE, "_y")
    joined = left.join(right, shared) if shared else left.crossJoin(right)
    product = (F.col("_x").cast(wide) * F.col("_y").cast(wide)).alias(VALUE)
    dims = tuple(dict.fromkeys([*a.dims, *b.dims]))
    df = joined.select(*[d for d in dims if d in keep], product)
    kept = tuple(d for d in dims if d in keep)
    whole = len(kept) == len(dims)
    if not whole and summed or whole and not (a.coalesced and b.coalesced):
        df = _total(df, kept, a.dtype)
        whole = True
    extents = dict(zip(a.dims, a.shape, strict=True)) | {d: n for d, n in zip(b.dims, b.shape, strict=True) if n is not None}
    return Tensor(df, kept, tuple(extents.get(d) for d in kept), "o" * len(kept), coalesced=whole)


def contract(tensors: Sequence[Tensor], output: Sequence[str], fmt: str | None = None, domains: dict[str, int] | None = None, summed: bool = True) -> Tensor:
    """The product of tensors whose modes are already named by index, summed to ``output``.

    An output index that no operand has is spread over its extent in ``domains``. Duplicates of a coordinate
    are summed. An empty operand gives an empty result; a scalar output is one row, 0 over nothing.
    """
    if len({t.dtype for t in tensors}) > 1 and len({ACCUMULATOR[t.dtype] for t in tensors}) > 1:
        raise TypeError(f"operands of {[t.dtype for t in tensors]}")
    output = tuple(output)
    have = {d for t in tensors for d in t.dims}
    spread = [d for d in output if d not in have]
    inner = [d for d in output if d in have]
    work = dict(enumerate(tensors))
    steps = plan([t.dims for t in tensors], inner, [estimate(t) for t in tensors], [bool(set(t.fmt) & set("so")) for t in tensors])
    for at, s in enumerate(steps):
        left = work.pop(s.left)
        work[len(tensors) + at] = _summed(left, s.keep) if s.right < 0 else _pair(left, work.pop(s.right), s.keep, summed)
    (got,) = work.values()
    if set(got.dims) != set(inner) or not inner or not got.coalesced:
        got = Tensor(_total(got.df, inner, got.dtype), tuple(inner), tuple(dict(zip(got.dims, got.shape, strict=True))[d] for d in inner), "o" * len(inner))
    df, shape = got.df, dict(zip(got.dims, got.shape, strict=True))
    for d in spread:
        if not domains or d not in domains:
            raise ShapeError(f"index {d} is in no operand and has no extent")
        df = df.crossJoin(df.sparkSession.range(domains[d]).select(F.col("id").alias(d)))
        shape[d] = domains[d]
    return Tensor(df.select(*output, VALUE), output, tuple(shape[d] for d in output), check_format(fmt or "o" * len(output), len(output)))


def einsum(expr: str, *tensors: Tensor, format: str | None = None, domains: dict[str, int] | None = None, dims: Sequence[str] | None = None) -> Tensor:
    """``einsum("ij,jk->ik", A, B)``: any number of operands, repeated indices and scalar outputs included.

    ``dims`` names the result's modes (its letters, if not given). Operands are never changed.
    """
    c = parse_einsum(expr, [t.rank for t in tensors])
    extents = index_extents(c, tensors, domains)
    named = [_diagonal(t, x) for t, x in zip(tensors, c.inputs, strict=True)]
    fmt = check_format(format, len(c.output)) if format else infer_format(Contraction(tuple("".join(t.dims) for t in named), c.output), [t.fmt for t in named])
    out = contract(named, tuple(c.output), fmt, {k: n for k, n in extents.items() if n is not None})
    return out.rename(*dims) if dims else out


def _by_rank(a: Tensor, b: Tensor, left: str, right: str, out: str, format: str | None) -> Tensor:
    if (a.rank, b.rank) != (len(left), len(right)):
        raise ShapeError(f"operands of rank {a.rank} and {b.rank}")
    names = dict(zip(right, b.dims, strict=True)) | dict(zip(left, a.dims, strict=True))
    return einsum(f"{left},{right}->{out}", a, b, format=format, dims=_distinct([names[x] for x in out]))


def _distinct(names: Sequence[str]) -> list[str]:
    out: list[str] = []
    for x in names:
        while x in out:
            x += "_"
        out.append(x)
    return out


def spmv(a: Tensor, x: Tensor, format: str | None = None) -> Tensor:
    return _by_rank(a, x, "ij", "j", "i", format)


def spgemm(a: Tensor, b: Tensor, format: str | None = None) -> Tensor:
    return _by_rank(a, b, "ij", "jk", "ik", format)


def spmm(a: Tensor, b: Tensor, format: str | None = None) -> Tensor:
    return _by_rank(a, b, "ij", "jk", "ik", format)


def outer(a: Tensor, b: Tensor, format: str | None = None) -> Tensor:
    return _by_rank(a, b, "i", "j", "ij", format)


def ttm(t: Tensor, m: Tensor, format: str | None = None) -> Tensor:
    return _by_rank(t, m, "ijk", "km", "ijm", format)


def mttkrp(t: Tensor, x: Tensor, y: Tensor, format: str | None = None) -> Tensor:
    return einsum("ijk,jm,km->im", t, x, y, format=format, dims=_distinct([t.dims[0], x.dims[1]]))


def sddmm(mask: Tensor, a: Tensor, b: Tensor, transposed: bool = True, format: str | None = None) -> Tensor:
    """``mask * (a b')``: the mask is joined first, so only its coordinates are ever computed."""
    return einsum(f"ij,ik,{'jk' if transposed else 'kj'}->ij", mask, a, b, format=format, dims=mask.dims)


def matmul(a: Tensor, b: Tensor, format: str | None = None) -> Tensor:
    """By rank: matrix·vector, matrix·matrix, vector·matrix or dot product."""
    kinds = {(2, 1): "ij,j->i", (2, 2): "ij,jk->ik", (1, 2): "i,ij->j", (1, 1): "i,i->"}
    if (a.rank, b.rank) not in kinds:
        raise ShapeError(f"no product of ranks {a.rank} and {b.rank}")
    left, right = kinds[a.rank, b.rank].split("->")[0].split(",")
    return _by_rank(a, b, left, right, kinds[a.rank, b.rank].split("->")[1], format)


def spmm_rows(a: Tensor, rows: DataFrame, key: str, array: str, width: int) -> DataFrame:
    """Sparse matrix times a dense one kept as an array a row: ``(i, row)``.

    One shuffled row a cell of ``a`` instead of ``width``; the sums of all features are one hash aggregate with
    map-side combining, so no list of rows is ever held. ``width`` is meant for feature counts up to a few hundred.
    """
    i, j = a.dims
    joined = a.df.join(rows.select(F.col(key).alias(j), F.col(array).alias("_row")), j)
    sums = [F.sum(F.col(VALUE) * F.get("_row", F.lit(f))).alias(f"_{f}") for f in range(width)]
    return joined.groupBy(i).agg(*sums).select(i, F.array(*[f"_{f}" for f in range(width)]).alias("row"))


def expansion(a: Tensor, b: Tensor, on: str) -> float:
    """Products that a join of two tensors on one index would make; a guard before a large one is run."""
    left = a.df.groupBy(F.col(on).alias("k")).agg(F.count("*").alias("m"))
    right = b.df.groupBy(F.col(on).alias("k")).agg(F.count("*").alias("n"))
    (x,) = left.join(right, "k").agg(F.sum(F.col("m").cast("double") * F.col("n"))).first()
    return x or 0.0

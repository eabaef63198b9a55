"""Einsum notation, output formats, and a small expression tree over tensors."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column

from sparrowgrid.tensor import ShapeError, Tensor


@dataclass(frozen=True)
class Contraction:
    inputs: tuple[str, ...]
    output: str


def parse_einsum(expr: str, ranks: Sequence[int]) -> Contraction:
    """``"ij,jk->ik"``. White space is free; the arrow is required; letters only."""
    text = "".join(expr.split())
    if text.count("->") != 1:
        raise ValueError(f"{expr!r} needs one '->'")
    left, output = text.split("->")
    inputs = tuple(left.split(","))
    if not all(x.isalpha() for x in [*inputs, output] if x) or len(set(output)) != len(output):
        raise ValueError(f"{expr!r} isn't an index expression")
    if [len(x) for x in inputs] != list(ranks):
        raise ShapeError(f"{expr!r} doesn't fit operands of rank {list(ranks)}")
    return Contraction(inputs, output)


def index_extents(c: Contraction, tensors: Sequence[Tensor], domains: dict[str, int] | None = None) -> dict[str, int | None]:
    """The extent of each index; raises where two known extents differ."""
    extents: dict[str, int | None] = dict(domains or {})
    for letters, t in zip(c.inputs, tensors, strict=True):
        for letter, n in zip(letters, t.shape, strict=True):
            known = extents.get(letter)
            if known is not None and n is not None and known != n:
                raise ShapeError(f"index {letter} has extents {known} and {n}")
            extents[letter] = n if known is None else known
    return extents


def infer_format(c: Contraction, formats: Sequence[str]) -> str:
    """Compressed beats coordinate beats dense on each index; a sparse mode before a dense one turns dense.

    With a summed index, and an operand that has exactly the output's indices and a sparse mode, the output
    keeps that operand's coordinates and is all-coordinate.
    """
    kinds: dict[str, set[str]] = {}
    for letters, fmt in zip(c.inputs, formats, strict=True):
        for letter, kind in zip(letters, fmt, strict=True):
            kinds.setdefault(letter, set()).add(kind)
    out = ["s" if "s" in (k := kinds.get(x, {"d"})) else "o" if "o" in k else "d" for x in c.output]
    for at in range(len(out) - 2, -1, -1):
        if out[at + 1] == "d":
            out[at] = "d"
    summed = set("".join(c.inputs)) - set(c.output)
    if summed and any(set(x) == set(c.output) and set(f) & set("so") for x, f in zip(c.inputs, formats, strict=True)) and set(out) & set("so"):
        return "o" * len(out)
    return "".join(out)


# -- expression tree ----------------------------------------------------------------------------
@dataclass(frozen=True)
class Node:
    def __add__(self, other: Node) -> Node:
        return Add((self, other))

    def __sub__(self, other: Node) -> Node:
        return Add((self, Scale(other, -1.0)))

    def __mul__(self, other: Node) -> Node:
        return Mul((self, other))

    def sum(self, *indices: str) -> Node:
        return Sum(self, indices)

    def map(self, f: Callable[[Column], Column]) -> Node:
        return Map(self, f)


@dataclass(frozen=True)
class Access(Node):
    """``A[i, j]``: a tensor under index names."""

    tensor: Tensor
    indices: tuple[str, ...]


@dataclass(frozen=True)
class Add(Node):
    terms: tuple[Node, ...]


@dataclass(frozen=True)
class Mul(Node):
    factors: tuple[Node, ...]


@dataclass(frozen=True)
class Scale(Node):
    of: Node
    by: float


@dataclass(frozen=True)
class Sum(Node):
    of: Node
    over: tuple[str, ...]


@dataclass(frozen=True)
class Map(Node):
    of: Node
    f: Callable[[Column], Column]


def evaluate(node: Node, output: Sequence[str] | None = None) -> Tensor:
    """The tensor of an expression, lazily; ``output`` orders its modes and sums the others away.

    Products that stand under a sum are planned as one contraction, so that a chain is aggregated early.
    """
    from sparrowgrid.operators.contract import contract
    from sparrowgrid.operators.elementwise import add

    def flat(n: Node) -> list[Node]:
        return [x for f in n.factors for x in flat(f)] if isinstance(n, Mul) else [n]

    def go(n: Node, keep: tuple[str, ...] | None) -> Tensor:
        if isinstance(n, Access):
            t = n.tensor.rename(*n.indices)
            return t if keep is None or tuple(keep) == t.dims else contract([t], keep)
        if isinstance(n, Mul):
            parts = [go(x, None) for x in flat(n)]
            out = keep or tuple(dict.fromkeys(d for p in parts for d in p.dims))
            return contract(parts, out)
        if isinstance(n, Sum):
            inner = free(n.of)
            return go(n.of, tuple(keep or [d for d in inner if d not in n.over]))
        if isinstance(n, Add):
            terms = [go(x, keep) for x in n.terms]
            return add(*[terms[0], *[t if t.dims == terms[0].dims else contract([t], terms[0].dims) for t in terms[1:]]])
        if isinstance(n, Scale):
            return go(n.of, keep).map(lambda v: v * n.by)
        if isinstance(n, Map):
            t = go(n.of, None)
            t = t.map(n.f)
            return t if keep is None or tuple(keep) == t.dims else contract([t], keep)
        raise TypeError(f"no such expression: {n!r}")

    def free(n: Node) -> tuple[str, ...]:
        if isinstance(n, Access):
            return n.indices
        if isinstance(n, Mul):
            return tuple(dict.fromkeys(d for x in flat(n) for d in free(x)))
        if isinstance(n, Add):
            return free(n.terms[0])
        if isinstance(n, Sum):
            return tuple(d for d in free(n.of) if d not in n.over)
        return free(n.of)  # type: ignore[attr-defined]

    return go(node, tuple(output) if output is not None else None)

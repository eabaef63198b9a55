"""Matrix product, bias, scale and activation as one lazy plan."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import functions as F

from sparrowgrid.functions.activations import BY_NAME
from sparrowgrid.operators.contract import matmul
from sparrowgrid.operators.elementwise import broadcast_mode
from sparrowgrid.tensor import Tensor


def pipeline(a: Tensor, b: Tensor, post: Sequence[tuple[str, object] | str]) -> Tensor:
    """``matmul`` and then each of ``post``: ``("add", x)`` or ``("mul", x)`` with a vector over the last mode
    or a column function, or an activation's name. An unknown step raises; none is ever skipped.

    Steps run over the cells that the product has; rows of a product with a dense right side are complete.
    A column function gets the last mode's coordinate and stays in the aggregation's stage.
    """
    out = matmul(a, b)
    last = out.dims[-1]
    for step in post:
        if isinstance(step, str):
            if step not in BY_NAME:
                raise ValueError(f"no such step: {step}")
            out = out.map(BY_NAME[step])
            continue
        kind, x = step
        if kind not in ("add", "mul"):
            raise ValueError(f"no such step: {kind}")
        if isinstance(x, Tensor):
            out = broadcast_mode(out, x, last, kind)
        elif callable(x):
            by = x(F.col(last))
            out = out.map(lambda v, by=by, kind=kind: v + by if kind == "add" else v * by)
        else:
            raise TypeError(f"{kind} takes a vector or a column function")
    return out


def compiled(f: Callable[..., Tensor]) -> Callable[..., Tensor]:
    """Composition is the plan already: the function itself."""
    return f

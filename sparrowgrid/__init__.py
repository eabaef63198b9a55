"""Sparse tensor algebra on Spark: tensors are relations keyed by coordinates."""

from sparrowgrid.operators.contract import (
    einsum, matmul, mttkrp, outer, sddmm, spgemm, spmm, spmm_rows, spmv, ttm,
)
from sparrowgrid.operators.convert import coalesce, csr_pointers, to_dense, to_sparse, transpose
from sparrowgrid.operators.elementwise import add, div, hadamard, mul, sub
from sparrowgrid.operators.fused import pipeline
from sparrowgrid.plans.expr import Access, evaluate
from sparrowgrid.tensor import Tensor

__all__ = [
    "Access", "Tensor", "add", "coalesce", "csr_pointers", "div", "einsum", "evaluate", "hadamard",
    "matmul", "mttkrp", "mul", "outer", "pipeline", "sddmm", "spgemm", "spmm", "spmm_rows", "spmv",
    "sub", "to_dense", "to_sparse", "transpose", "ttm",
]

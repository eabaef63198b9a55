"""Scalar activations as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def relu(v: Column) -> Column:
    return F.greatest(v, F.lit(0.0))


def sigmoid(v: Column) -> Column:
    return 1 / (1 + F.exp(-v))


def tanh(v: Column) -> Column:
    return F.tanh(v)


def gelu(v: Column) -> Column:
    """The tanh form: ``v/2 (1 + tanh(sqrt(2/pi) (v + 0.044715 v^3)))``."""
    return v * F.lit(0.5) * (1 + F.tanh(F.lit(0.7978845608) * (v + F.lit(0.044715) * v * v * v)))


#: Those that keep zero may run over the stored cells of a sparse tensor.
KEEPS_ZERO = {"relu": True, "tanh": True, "gelu": True, "sigmoid": False}
BY_NAME = {"relu": relu, "sigmoid": sigmoid, "tanh": tanh, "gelu": gelu}


def positional_encoding(pos: Column, k: Column, width: int) -> Column:
    """Sine on even features, cosine on odd ones."""
    angle = pos / F.pow(F.lit(10000.0), (k - k % 2) / F.lit(float(width)))
    return F.when(k % 2 == 0, F.sin(angle)).otherwise(F.cos(angle))

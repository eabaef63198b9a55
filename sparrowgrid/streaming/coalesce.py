"""Cells that arrive as a stream, kept as running sums (a capability of this engine, beyond batch parity)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparrowgrid.tensor import VALUE


def coalesce_stream(cells: DataFrame, dims: list[str]) -> DataFrame:
    """Sum a coordinate; write it in update mode. State is one row a coordinate."""
    return cells.groupBy(*dims).agg(F.sum(VALUE).alias(VALUE))


def windowed_coalesce(cells: DataFrame, dims: list[str], ts: str, window: str, late: str) -> DataFrame:
    """Sums a coordinate and window; state older than the watermark goes."""
    return cells.withWatermark(ts, late).groupBy(F.window(ts, window), *dims).agg(F.sum(VALUE).alias(VALUE))

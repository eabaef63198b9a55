"""What a row's cells share, without a window over its cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparrowgrid.tensor import VALUE, Tensor

#: The width of a bin of exponents.
WIDTH = 64.0


def joined(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """On equal keys; without keys, ``b`` is one row."""
    return a.join(b, keys) if keys else a.crossJoin(F.broadcast(b))


def exponential_sums(t: Tensor, scale: float = 1.0) -> DataFrame:
    """The cells with ``_z``, the scaled value less a number of its row, and ``_sum``, the row's sum of ``exp(_z)``.

    Values are summed in bins of exponents, each relative to its own, so nothing overflows and the sums are plain
    aggregates that shrink before they are shuffled; a row's few bins are then brought to the highest one. A row of
    minus infinities has a sum of NaN.
    """
    keys = list(t.dims[:-1])
    x = F.col(VALUE).cast("double") / scale
    bin_ = F.greatest(F.rint(x / WIDTH), F.lit(-1e300))
    bins = t.df.groupBy(*keys, bin_.alias("_bin")).agg(F.sum(F.exp(x - WIDTH * bin_)).alias("_s"))
    bins = bins.withColumn("_top", F.max("_bin").over(Window.partitionBy(*keys)))
    total = F.sum(F.col("_s") * F.exp(WIDTH * (F.col("_bin") - F.col("_top"))))
    sums = bins.groupBy(*keys).agg(F.max("_top").alias("_top"), total.alias("_sum"))
    sums = sums.withColumn("_sum", F.when(F.col("_sum") == 0, F.lit(float("nan"))).otherwise(F.col("_sum")))
    return joined(t.df, sums, keys).withColumn("_z", x - WIDTH * F.col("_top"))

"""Summaries and text tables that surround the kernels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a group up to which its median is looked for among all of them.
SMALL = 10_000
#: The share of a larger group on either side of a median's estimate in which the median lies; the estimate errs by a
#: tenth of it at most.
NEAR = 1e-3


def timing_summary(df: DataFrame, by: str, value: str) -> DataFrame:
    """Minimum, mean, sample deviation and exact median of each group; null values don't count."""
    got = df.groupBy(by).agg(F.min(value).alias("mn"), F.avg(value).alias("av"), F.stddev_samp(value).alias("sd"))
    md = medians(df, by, value)
    return got.join(md, got[by].eqNullSafe(md["_g"]), "left").drop("_g")


def medians(df: DataFrame, by: str, value: str) -> DataFrame:
    """``(_g, md)``, the exact median of each group that has a value; null is a group.

    It is looked for between two quantiles of a sketch of bounded size. Values below them are only counted, so that a
    large group has some 0.2 % of its rows put in order.
    """
    cells = df.select(F.col(by).alias("_k"), F.col(value).cast("double").alias("_x")).filter(F.col("_x").isNotNull())
    sketch = F.percentile_approx("_x", [0.5 - NEAR, 0.5 + NEAR], int(10 / NEAR))
    groups = cells.groupBy(F.col("_k").alias("_g")).agg(F.count("*").alias("_n"), F.min("_x").alias("_mn"), F.max("_x").alias("_mx"), sketch.alias("_q"))
    bound = [F.when(F.col("_n") <= SMALL, c).otherwise(F.get("_q", F.lit(k))) for k, c in enumerate((F.col("_mn"), F.col("_mx")))]
    groups = groups.select("_g", "_n", bound[0].alias("_low"), bound[1].alias("_high"))
    inside = cells.join(groups, cells["_k"].eqNullSafe(groups["_g"])).filter("_x <= _high")
    counts = inside.groupBy("_g", "_n", F.when(F.col("_x") >= F.col("_low"), F.col("_x")).alias("_at")).agg(F.count("*").alias("_c"))
    order = Window.partitionBy("_g").orderBy(F.col("_at").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    ranked = counts.withColumn("_to", F.sum("_c").over(order))
    found = F.coalesce("_at", F.raise_error(F.lit("a median below its bounds")))
    middle = [F.min(F.when(F.col("_to") >= F.floor((F.col("_n") + k) / 2), found)) for k in (1, 2)]
    return ranked.groupBy("_g").agg(((middle[0] + middle[1]) / 2).alias("md"))


def completed(df: DataFrame, key: str, item: str, wanted: tuple[str, ...]) -> DataFrame:
    """Keys that have every wanted item."""
    have = F.count_distinct(F.col(item)) == len(wanted)
    return df.filter(F.col(item).isin(*wanted)).groupBy(key).agg(have.alias("all")).filter("all").select(key)


def runtime_by_size(df: DataFrame, size: str, value: str) -> DataFrame:
    return df.groupBy(size).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"))


def tokens(df: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, pos, token)`` of lower-cased ``[a-z0-9']+``."""
    found = F.posexplode(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9']+"), F.lit(0))).alias("pos", "token")
    return df.select(key, found)


def vocabulary(tokens: DataFrame, size: int) -> DataFrame:
    """``(token, n, id)``: the ``size - 2`` most frequent, ties by token, ids from 2; 0 is unknown, 1 padding."""
    top = tokens.groupBy("token").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "token").limit(size - 2)
    return top.withColumn("id", F.row_number().over(Window.orderBy(F.desc("n"), "token")) + 1)


def encode(tokens: DataFrame, vocab: DataFrame, key: str, length: int) -> DataFrame:
    """``(key, ids)`` cut and padded to ``length``."""
    ids = tokens.filter(F.col("pos") < length).join(vocab.select("token", F.col("id").alias("_id")), "token", "left")
    listed = ids.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("_id", F.lit(0)).alias("_id")))), lambda x: x["_id"]).alias("ids"))
    return listed.select(key, F.concat("ids", F.array_repeat(F.lit(1), F.lit(length) - F.size("ids"))).alias("ids"))


def metrics(df: DataFrame, predicted: str, truth: str, probability: str | None = None) -> DataFrame:
    """Accuracy, and the mean negative log likelihood of the true label's probability if there is one."""
    out = [F.avg((F.col(predicted) == F.col(truth)).cast("double")).alias("accuracy")]
    if probability:
        out.append(F.avg(-F.log(probability)).alias("nll"))
    return df.agg(*out)


def mean_squared_error(df: DataFrame, a: str, b: str) -> DataFrame:
    d = F.col(a) - F.col(b)
    return df.agg(F.avg(d * d).alias("mse"))


def layer_norm(df: DataFrame, key: str, value: str, eps: float = 1e-5) -> DataFrame:
    """Each value less its row's mean, over the root of the row's variance. No row is held in one task."""
    moments = df.groupBy(key).agg(F.avg(value).alias("_mean"), F.var_pop(value).alias("_variance"))
    normed = (F.col(value) - F.col("_mean")) / F.sqrt(F.col("_variance") + eps)
    return df.join(moments, key).withColumn("normed", normed).drop("_mean", "_variance")

"""Files: Matrix Market triples, parquet edges, headerless CSV, labelled text folders; CSV and JSON results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparrowgrid.tensor import VALUE, Tensor


def read_mtx(spark: SparkSession, path: str, dims: tuple[str, str] = ("i", "j")) -> Tensor:
    """A Matrix Market coordinate file; general, symmetric, skew-symmetric and pattern matrices.

    The two header lines are read by the driver; entries stay distributed. Coordinates count from 0.
    """
    lines = spark.read.text(path)
    banner = lines.filter(F.col("value").startswith("%%MatrixMarket")).first()
    kinds = banner[0].lower().split() if banner else ["", "matrix", "coordinate", "real", "general"]
    if kinds[2] != "coordinate" or kinds[3] == "complex":
        raise ValueError(f"no reader for {' '.join(kinds)}")
    parts = lines.filter(~F.col("value").startswith("%") & (F.trim("value") != "")).select(F.split(F.trim("value"), r"\s+").alias("p"))
    pattern = kinds[3] == "pattern"
    # the size line is the first that isn't a comment
    body = parts.withColumn("at", F.monotonically_increasing_id())
    first, size = body.agg(F.min("at"), F.min_by("p", "at")).first()
    m, n = int(size[0]), int(size[1])
    cells = body.filter(F.col("at") != first).select(
        (F.element_at("p", 1).cast("bigint") - 1).alias(dims[0]),
        (F.element_at("p", 2).cast("bigint") - 1).alias(dims[1]),
        (F.lit(1.0) if pattern else F.element_at("p", 3).cast("double")).alias(VALUE),
    )
    if kinds[4] != "general":
        sign = -F.col(VALUE) if kinds[4].startswith("skew") else F.col(VALUE)
        mirrored = cells.filter(F.col(dims[0]) != F.col(dims[1])).select(F.col(dims[1]).alias(dims[0]), F.col(dims[0]).alias(dims[1]), sign.alias(VALUE))
        cells = cells.unionByName(mirrored)
    return Tensor.from_df(cells, dims, shape=(m, n))


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``edges.parquet`` (s, d) and ``nodes.parquet`` under one folder."""
    return spark.read.parquet(f"{path}/edges.parquet"), spark.read.parquet(f"{path}/nodes.parquet")


def read_labelled_text(spark: SparkSession, path: str, labels: dict[str, int]) -> DataFrame:
    """``(text, label)`` of whole files; the label is that of the folder's name."""
    df = spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(
        F.col("value").alias("text"), F.element_at(F.split("_metadata.file_path", "/"), -2).alias("folder")
    )
    pairs = [x for k, v in labels.items() for x in (F.lit(k), F.lit(v))]
    return df.select("text", F.element_at(F.create_map(*pairs), F.col("folder")).alias("label"))


def read_labelled_csv(spark: SparkSession, path: str, columns: int) -> DataFrame:
    """Headerless: the first column is a label from 1, the others are joined to a text."""
    df = spark.read.csv(path)
    return df.select((F.col("_c0").cast("int") - 1).alias("label"), F.concat_ws(" ", *[f"_c{k}" for k in range(1, columns)]).alias("text"))


def append_results(df: DataFrame, path: str, kind: str = "csv") -> None:
    df.write.mode("append").option("header", True).format(kind).save(path)


def random_sparse(spark: SparkSession, m: int, n: int, density: float, seed: int) -> Tensor:
    """Uniform values at random coordinates: each row draws ``round(n * density)`` columns, repeats are summed away."""
    each = max(0, round(n * density))
    rows = spark.range(m).select(F.col("id").alias("i"), F.explode(F.sequence(F.lit(1), F.lit(max(each, 1)))).alias("t"))
    h = F.xxhash64("i", "t", F.lit(seed))
    cells = rows.select("i", F.pmod(h, F.lit(n)).alias("j"), (F.pmod(F.xxhash64("i", "t", F.lit(seed + 1)), F.lit(1 << 30)) / float(1 << 30)).alias(VALUE))
    cells = cells.dropDuplicates(["i", "j"]) if each else cells.limit(0)
    return Tensor(cells, ("i", "j"), (m, n), "oo")


def random_exact(spark: SparkSession, m: int, n: int, nnz: int, seed: int) -> Tensor:
    """Exactly ``nnz`` distinct random coordinates: twice as many hashed draws are made distinct, and the first by
    another hash are kept by a distributed top-k."""
    if nnz > m * n // 2:
        raise ValueError("more than half of the cells: prune a dense tensor instead")
    draws = spark.range(2 * nnz + 64).select(
        F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(m)).alias("i"), F.pmod(F.xxhash64("id", F.lit(seed + 1)), F.lit(n)).alias("j")
    ).distinct()
    kept = draws.orderBy(F.xxhash64("i", "j", F.lit(seed)), "i", "j").limit(nnz)
    value = (F.pmod(F.xxhash64("i", "j", F.lit(seed + 2)), F.lit(1 << 30)) + 1) / float(1 << 30)
    return Tensor(kept.select("i", "j", value.alias(VALUE)), ("i", "j"), (m, n), "oo")

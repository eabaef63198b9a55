"""What the operators share: the cluster's shared folder, cut lineage, order buckets, Arrow mapping."""

from __future__ import annotations

import gc
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one Arrow batch handed to Python: bounds a worker's memory, whatever the texts' lengths.
BATCH_ROWS = 512
#: Rows of an order bucket (a shard, a window's partition).
BUCKET_ROWS = 4096


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset, a temporary one of this machine, but only for a local
    master, as in tests; a cluster's executors wouldn't see it, so there it raises."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not found:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        found = getattr(sc, "_sparrowgrid_dir", None) or f"file://{tempfile.mkdtemp(prefix='sparrowgrid-')}"
        sc._sparrowgrid_dir = found
    return found.rstrip("/")


def fresh_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str) -> DataFrame:
    """``df`` written to the shared folder and read again: its lineage ends there and lost executors cost nothing."""
    path = fresh_path(df.sparkSession, what)
    df.write.parquet(path)
    remove_at_exit(df.sparkSession, path)
    release(df.sparkSession)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove_at_exit(spark: SparkSession, path: str) -> None:
    """Has the driver's file system delete a folder of the shared one when the application ends."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(conf).deleteOnExit(at)


def text_keys(text: Column) -> tuple[Column, Column]:
    """Two numbers of 60 bits each from a text's SHA-256 (null: as empty), without nulls."""
    h = F.sha2(F.coalesce(text, F.lit("")), 256)
    return tuple(F.conv(F.substring(h, at, 15), 16, 10).cast("bigint") for at in (1, 17))


def release(spark: SparkSession) -> None:
    """Lets go of the shuffle files of finished steps: Spark removes them once the driver's garbage is collected."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def ship(spark: SparkSession) -> None:
    """Sends this package's modules to the executors, once a context; Spark's file server carries them."""
    sc = spark.sparkContext
    if getattr(sc, "_sparrowgrid", False):
        return
    package = Path(__file__).resolve().parents[1]
    path = Path(tempfile.mkdtemp(prefix="sparrowgrid-")) / "sparrowgrid_code.zip"
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(package.rglob("*.py")):
            z.write(p, p.relative_to(package.parent))
    sc.addPyFile(str(path))
    sc._sparrowgrid = True


def arrow_map(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow with small batches: the session sends at most 4 * BATCH_ROWS rows at once, ``f`` sees BATCH_ROWS."""

    def small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, BATCH_ROWS):
                yield b.slice(k, BATCH_ROWS)

    ship(df.sparkSession)
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(4 * BATCH_ROWS))
    return df.mapInArrow(lambda batches: f(small(batches)), schema)


def order_splits(df: DataFrame, key: str, rows: int = BUCKET_ROWS) -> list[int]:
    """Values of an integer key that cut its order into buckets of about ``rows`` rows: one scan of that column.

    Each split is a value of the data, so it is the first of its bucket. About n / rows numbers reach the driver.
    """
    n = df.count()
    parts = max(1, -(-n // rows))
    if parts == 1:
        return []
    shares = [k / parts for k in range(1, parts)]
    found = df.agg(F.percentile_approx(key, shares, max(10_000, 20 * parts))).first()[0] or []
    return sorted(set(found))


def bucket_of(key: Column, splits: list[int]) -> Column:
    """The number of splits at or below ``key`` (null: 0), found in two levels of about sqrt(n) comparisons."""
    if not splits:
        return F.lit(0)
    width = max(1, int(len(splits) ** 0.5))
    groups = [splits[k : k + width] for k in range(0, len(splits), width)]
    tops = F.array(*[F.lit(g[0]) for g in groups])
    if len(splits) <= 64:
        return F.coalesce(F.size(F.filter(F.array(*[F.lit(s) for s in splits]), lambda s: s <= key)), F.lit(0))
    at = F.size(F.filter(tops, lambda s: s <= key))
    inner = F.array(*[F.array(*[F.lit(s) for s in g]) for g in groups])
    below = F.size(F.filter(F.get(inner, at - 1), lambda s: s <= key))
    return F.when(key.isNull() | (at == 0), 0).otherwise((at - 1) * width + below)

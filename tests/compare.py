"""Run queries against their DuckDB oracles: python tests/compare.py SF_DIR [NAME...]"""

from __future__ import annotations

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


def duck(sf_dir: str):
    import duckdb

    c = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        c.sql(f"create view {p.stem} as select * from read_parquet('{p}{'/*.parquet' if p.is_dir() else ''}')")
    return c


def rows(frame, cols):
    return sorted((tuple("nan" if x != x else x if not isinstance(x, list) else tuple(x) for x in r) for r in frame[cols].astype(object).where(frame[cols].notna(), None).itertuples(index=False)), key=repr)


def compare(spark, connection, query, sql, sf_dir) -> str:
    """'' if rows, names and values agree."""
    got = query(spark, sf_dir).toPandas()
    want = connection.sql(sql).df()
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} and {sorted(want.columns)}"
    if len(got) != len(want):
        return f"{len(got)} rows and {len(want)}"
    cols = sorted(got.columns)
    for a, b in zip(rows(got, cols), rows(want, cols), strict=True):
        if a != b:
            return f"{a} and {b}"
    return ""


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    import __spark_entry__ as e

    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    sf, names = sys.argv[1], sys.argv[2:] or list(e.oracle_sql())
    c, qs, sqls, bad = duck(sf), e.queries(), e.oracle_sql(), 0
    for n in names:
        t = time.time()
        try:
            why = compare(spark, c, qs[n], sqls[n], sf)
        except Exception as x:  # noqa: BLE001
            why = f"{type(x).__name__}: {str(x)[:600]}"
        bad += bool(why)
        print(f"{n}: {why or 'ok'} {time.time() - t:.1f}s", flush=True)
    print(f"{bad} differ")
    sys.exit(bool(bad))

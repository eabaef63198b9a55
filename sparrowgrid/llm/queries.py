"""The registered queries of the language-model operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    """A vocabulary file of the public tokenizers package, which every executor has; never copied."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparrowgrid.llm.langid import identify

    return identify(_read(spark, sf_dir, "documents"), vocabulary_path("piece_bpe_32k.model"))


def op2_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from sparrowgrid.llm.ann import search

    vectors = _read(spark, sf_dir, "embeddings")
    return search(vectors, vectors.filter(F.col("vec_id") % 20 == 0), k=20)


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparrowgrid.llm.simhash import digest

    return digest(_read(spark, sf_dir, "documents"))


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparrowgrid.llm.sketch import digest

    return digest(_read(spark, sf_dir, "documents"))


def op5_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparrowgrid.llm.bpe import round_trip

    return round_trip(_read(spark, sf_dir, "documents"), vocabulary_path())


def op6_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparrowgrid.llm.mixing import digest

    return digest(_read(spark, sf_dir, "documents"))


def op7_repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparrowgrid.llm.repeats import digest

    return digest(_read(spark, sf_dir, "documents"))


def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparrowgrid.llm.pii import digest

    return digest(_read(spark, sf_dir, "documents"))


def op9_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparrowgrid.llm.records import digest

    return digest(_read(spark, sf_dir, "documents"), vocabulary_path())


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparrowgrid.llm.urlfilter import digest

    return digest(_read(spark, sf_dir, "pages"))


def queries() -> dict[str, Query]:
    return {
        "op1_language": op1_language,
        "op2_nearest_vectors": op2_nearest_vectors,
        "op3_simhash": op3_simhash,
        "op4_fingerprints": op4_fingerprints,
        "op5_bpe_round_trip": op5_bpe_round_trip,
        "op6_mixture": op6_mixture,
        "op7_repeated_bytes": op7_repeated_bytes,
        "op8_personal_data": op8_personal_data,
        "op9_token_records": op9_token_records,
        "op10_url_filter": op10_url_filter,
    }


def oracle_sql() -> dict[str, str]:
    from sparrowgrid.llm.urlfilter import ORACLE_SQL

    return {"op10_url_filter": ORACLE_SQL}

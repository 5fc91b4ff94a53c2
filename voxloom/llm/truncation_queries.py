"""Queries on texts that were cut off (p9)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxloom.llm.truncation import truncated
from voxloom.storage import read


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncated(read(spark, sf_dir, "documents"), "doc_id", "text", "source", "kind")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents whose text was cut off."""
    return _docs(spark, sf_dir).where("cut").select(F.col("id").alias("doc_id"))


def p9_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts, cut texts and the rate of each source ('' for none)."""
    return _docs(spark, sf_dir).groupBy("source").agg(
        F.count("*").alias("texts"), F.sum(F.col("cut").cast("long")).alias("cut"),
        F.round(F.avg(F.col("cut").cast("double")), 6).alias("rate"),
    )


QUERIES = {"p9_found": p9_found, "p9_rates": p9_rates}
SQL: dict[str, str] = {}

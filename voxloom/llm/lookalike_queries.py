"""Queries on texts that look alike but differ in characters (p4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxloom.llm import lookalikes
from voxloom.storage import read


def _values(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments = lookalikes.fields(read(spark, sf_dir, "segment"), "segment", "segment_id", "text")
    chunks = lookalikes.fields(read(spark, sf_dir, "aligned_chunk"), "aligned_chunk", "chunk_id", "asr_text", "book_text")
    return segments.unionByName(chunks)


def p4_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every value of the three fields in its consistent form."""
    values = _values(spark, sf_dir)
    out = lookalikes.with_consistent(values, "text", lookalikes.train(values, "text"))
    return out.select("tbl", "field", "row_key", "text", "form")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The values that are not in consistent form."""
    return p4_forms(spark, sf_dir).where(F.col("form") != F.col("text")).select("tbl", "field", "row_key").distinct()


QUERIES = {"p4_found": p4_found, "p4_forms": p4_forms}
SQL: dict[str, str] = {}

"""Queries on packing (p7) and mixing (p8) of documents sized in tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from voxloom.llm import mixing, packing
from voxloom.llm.tokens import with_tokens
from voxloom.storage import cut, read


def _sized(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").where("text IS NOT NULL")
    return cut(with_tokens(docs.select("doc_id", "source", "text"), "text").drop("text"))


def _capacities(spark: SparkSession, sf_dir: str) -> dict[str, int]:
    return {r["container"]: r["capacity_tokens"] for r in read(spark, sf_dir, "container_spec").collect()}


def _targets(spark: SparkSession, sf_dir: str) -> dict[str, tuple[float, int]]:
    return {r["source"]: (r["target_share"], r["max_repeats"]) for r in read(spark, sf_dir, "mix_target").collect()}


def p7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text, or piece of a text over the capacity, with its container, for each capacity."""
    return packing.pack(_sized(spark, sf_dir), "doc_id", "tokens", _capacities(spark, sf_dir))


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers used and how full they are, for each capacity."""
    return packing.fill_report(p7_packing(spark, sf_dir), _capacities(spark, sf_dir))


def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each text is used so that every source supplies its share."""
    return mixing.mix(_sized(spark, sf_dir), "doc_id", "source", "tokens", _targets(spark, sf_dir))


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and reached share of each source."""
    items, targets = _sized(spark, sf_dir), _targets(spark, sf_dir)
    return mixing.share_report(mixing.mix(items, "doc_id", "source", "tokens", targets), items, "source", "tokens", targets)


QUERIES = {"p7_packing": p7_packing, "p7_fill": p7_fill, "p8_mix": p8_mix, "p8_shares": p8_shares}
SQL: dict[str, str] = {}

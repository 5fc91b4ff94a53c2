"""Corpus and evaluation aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxloom.functions.metrics import moments
from voxloom.operators.quantiles import UPPER, quantiles, with_quantiles

# Histogram brackets.
CER_EDGES = ((0.0, 0.05), (0.05, 0.10), (0.10, 0.20), (0.20, 0.50), (0.50, 1.01))


def volume(df: DataFrame, key: str, seconds: str, total: bool = True) -> DataFrame:
    """(key, is_total, clips, hours) per key and, with ``total``, over all rows. Seconds are summed to 1e-4 exactly."""
    hours = F.round(F.coalesce(F.sum(F.col(seconds).cast("decimal(18,4)")), F.lit(0)).cast("double") / 3600, 6).alias("hours")
    aggs = [F.count("*").alias("clips"), hours]
    if not total:
        return df.groupBy(key).agg(*aggs)
    return df.rollup(key).agg(F.grouping(key).cast("int").alias("is_total"), *aggs)


def reason_counts(df: DataFrame, reason: str) -> DataFrame:
    """(tag, n): reasons by tag, what follows ':' cut off."""
    return df.groupBy(F.split(reason, ":")[0].alias("tag")).agg(F.count("*").alias("n"))


def histogram(df: DataFrame, value: str, edges: tuple[tuple[float, float], ...] = CER_EDGES) -> DataFrame:
    """(bin, lo, hi, n, pct): left-closed bins; values beyond the last are in none but count in the total."""
    tests = [F.count(F.when((F.col(value) >= lo) & (F.col(value) < hi), 1)).alias(f"b{i}") for i, (lo, hi) in enumerate(edges)]
    one = df.agg(F.count("*").alias("all"), *tests)
    rows = F.array(*[F.struct(F.lit(i).alias("bin"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi"), F.col(f"b{i}").alias("n")) for i, (lo, hi) in enumerate(edges)])
    pct = F.round(F.coalesce(F.try_divide(F.col("n") * 100.0, F.col("all")), F.lit(0.0)), 6)
    return one.select("all", F.explode(rows).alias("r")).select("r.*", "all").withColumn("pct", pct).drop("all")


def metric_summary(df: DataFrame, value: str, *keys: str) -> DataFrame:
    """mean, median, population deviation, p90, min, max, n per key or overall."""
    out = with_quantiles(df.groupBy(*keys).agg(*moments(F.col(value))), df, value, {"median": 0.5, "p90": 0.9}, *keys)
    return out.select(*keys, "mean", "median", "std", "p90", "min", "max", "n")


def mean_and_middle(df: DataFrame, *values: str) -> DataFrame:
    """One row: mean_x and median_x (the upper of two) of each value, 0.0 without rows."""
    out = df.agg(*[F.coalesce(F.avg(v), F.lit(0.0)).alias(f"mean_{v}") for v in values])
    for v in values:
        q = quantiles(df, v, {f"median_{v}": UPPER}).select(F.coalesce(f"median_{v}", F.lit(0.0)).alias(f"median_{v}"))
        out = out.crossJoin(F.broadcast(q))
    return out.select(*[f"{x}_{v}" for v in values for x in ("mean", "median")])


def yield_report(df: DataFrame, key: str, kept: Column, seconds: str) -> DataFrame:
    """Per key: rows, kept, pass_rate, kept and total seconds, yield_pct, spread of kept durations; 0 where empty."""
    s, k = F.col(seconds), F.when(kept, F.col(seconds))
    zero = F.lit(0.0)
    per = df.groupBy(key).agg(
        F.count("*").alias("total"),
        F.count(F.when(kept, 1)).alias("kept"),
        F.coalesce(F.try_divide(F.count(F.when(kept, 1)), F.count("*")), zero).alias("pass_rate"),
        F.coalesce(F.round(F.sum(k), 4), zero).alias("kept_seconds"),
        F.coalesce(F.round(F.try_divide(F.sum(k) * 100, F.sum(s)), 6), zero).alias("yield_pct"),
        F.coalesce(F.min(k), zero).alias("min_seconds"), F.coalesce(F.max(k), zero).alias("max_seconds"),
        F.coalesce(F.round(F.avg(k), 6), zero).alias("mean_seconds"),
    )
    out = with_quantiles(per, df.where(kept), seconds, {"median_seconds": 0.5}, key)
    return out.withColumn("median_seconds", F.coalesce("median_seconds", zero))


def pooled_rate(df: DataFrame, edits: str, size: str) -> DataFrame:
    """Corpus-level error rate: summed edits over summed reference sizes."""
    return df.agg(F.try_divide(F.sum(edits), F.sum(size)).alias("rate"))

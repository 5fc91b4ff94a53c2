"""Per-key work in equal chunks, so that a key holding most rows is spread over many tasks.

Rows are range-partitioned by a global order (not by key), counted per partition and key, and the
counts are prefix-summed over partitions. That gives every row its exact number within its key without
ever bringing one key's rows together. Keys are then processed in chunks of ``chunk_rows`` rows and the
ordered chunk states are merged.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxloom.storage import cut

CHUNK_ROWS = 200_000
_ROW_BITS = (1 << 33) - 1  # monotonically_increasing_id keeps the row's number in the low 33 bits


def _free(prefix: str, df: DataFrame) -> str:
    """``prefix`` with as many underscores before it as it takes to clash with no column."""
    while any(c.lower().startswith(prefix) for c in df.columns):
        prefix = "_" + prefix
    return prefix


def number_within_key(df: DataFrame, keys: list[str], order: list[str], rank: str = "rank_in_key") -> DataFrame:
    """Add ``rank``: the row's 0-based number within its key in the order of ``order``.

    ``order`` should be unique over the table (append an id): ties are numbered in an arbitrary but
    fixed way, and only the values of ``order``, never those of a key, decide the partition. Null keys
    form one key; nulls in ``order`` come first. With no keys the whole table is numbered. An empty table
    gives an empty one. Other columns may have any name but ``rank``.
    """
    p = _free("_nk", df)
    part, row, first, n, before = (f"{p}_{x}" for x in ("part", "row", "first", "n", "before"))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = [F.col(c).asc_nulls_first() for c in order]
    laid = df.repartitionByRange(parts, *by).sortWithinPartitions(*keys, *by)
    laid = laid.withColumn(part, F.spark_partition_id()).withColumn(row, F.monotonically_increasing_id().bitwiseAND(F.lit(_ROW_BITS)))
    laid = cut(laid)
    counts = laid.groupBy(*keys, part).agg(F.min(row).alias(first), F.count("*").alias(n))
    earlier = Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn(before, F.coalesce(F.sum(n).over(earlier), F.lit(0))).drop(n)
    on = F.lit(True)
    for i, c in enumerate([*keys, part]):
        offsets = offsets.withColumnRenamed(c, f"{p}_k{i}")
        on = on & laid[c].eqNullSafe(offsets[f"{p}_k{i}"])
    return laid.join(offsets, on).select(*df.columns, (F.col(row) - F.col(first) + F.col(before)).alias(rank))


def with_chunks(df: DataFrame, keys: list[str], order: list[str], chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Add ``rank_in_key`` and ``chunk`` = rank div ``chunk_rows``: every chunk but a key's last is full."""
    return number_within_key(df, keys, order).withColumn(
        "chunk", F.floor(F.col("rank_in_key") / F.lit(chunk_rows)).cast("long")
    )


def apply_in_chunks(
    df: DataFrame, keys: list[str], order: list[str], process: Callable, schema: str, chunk_rows: int = CHUNK_ROWS
) -> DataFrame:
    """Run a pandas function on each (key, chunk), at most ``chunk_rows`` rows in ``rank_in_key`` order.

    ``process(frame) -> frame`` returns chunk states; ``schema`` names their columns. The caller merges
    the states of a key by ``chunk``.
    """
    return (
        with_chunks(df, keys, order, chunk_rows)
        .groupBy(*keys, "chunk")
        .applyInPandas(lambda pdf: process(pdf.sort_values("rank_in_key")), schema)
    )


def key_profile(
    df: DataFrame, key: str, at: str, order: list[str], amount: Column, chunk_rows: int = CHUNK_ROWS
) -> DataFrame:
    """Per key: rows, summed amount, first and last ``at``, and the longest wait between neighbours.

    Rows are ordered by ``at``, then ``order``. The waits inside a chunk come from that chunk alone; the
    wait across a boundary is found when the chunk states, carrying their first and last times, are
    merged in order. Null amounts count as 0, null times are skipped, a null key is a key. Columns: key,
    clips, amount, first_at, last_at, max_wait_us.
    """
    us = F.unix_micros(F.col(at).cast("timestamp"))
    tie = [F.col(c).alias(f"o{i}") for i, c in enumerate(order)]
    rows = df.select(F.col(key).alias("k"), us.alias("us"), *tie, amount.alias("amount"))
    rows = with_chunks(rows, ["k"], ["us", *[f"o{i}" for i in range(len(order))]], chunk_rows)
    inside = Window.partitionBy("k", "chunk").orderBy("rank_in_key")
    states = (
        rows.withColumn("wait", F.col("us") - F.lag("us").over(inside))
        .groupBy("k", "chunk")
        .agg(
            F.count("*").alias("clips"),
            F.sum("amount").alias("amount"),
            F.min("us").alias("first"),
            F.max("us").alias("last"),
            F.max("wait").alias("wait"),
        )
    )
    across = Window.partitionBy("k").orderBy("chunk")
    return (
        states.withColumn("edge", F.col("first") - F.lag("last").over(across))
        .groupBy("k")
        .agg(
            F.sum("clips").alias("clips"),
            F.coalesce(F.sum("amount"), F.lit(0)).alias("amount"),
            F.timestamp_micros(F.min("first")).alias("first_at"),
            F.timestamp_micros(F.max("last")).alias("last_at"),
            F.coalesce(F.greatest(F.max("wait"), F.max("edge")), F.lit(0)).alias("max_wait_us"),
        )
        .withColumnRenamed("k", key)
    )


def heavy_keys(df: DataFrame, key: str, order: list[str], share: float, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Keys on at least ``share`` of all rows, null and '' excluded, counted chunk by chunk.

    The total covers all rows, also those without a key. Columns: key, rows, total.
    """
    rows = df.select(F.col(key).alias("k"), *[F.col(c).alias(f"o{i}") for i, c in enumerate(order)])
    states = with_chunks(rows, ["k"], [f"o{i}" for i in range(len(order))], chunk_rows).groupBy("k", "chunk").count()
    per_key = states.groupBy("k").agg(F.sum("count").alias("rows"))
    total = per_key.agg(F.sum("rows").alias("total"))
    heavy = (F.col("k") != "") & (F.col("rows") >= F.lit(share) * F.col("total"))
    return per_key.crossJoin(F.broadcast(total)).where(heavy).select(F.col("k").alias(key), "rows", "total")

"""Continuous periods and gaps of time intervals, exact and without one task per entity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_MS = 600_000


def to_ms(sec: Column) -> Column:
    """Seconds as whole milliseconds; NaN and infinities become null."""
    ok = sec.isNotNull() & ~F.isnan(sec) & (F.abs(sec) < F.lit(9e12))
    return F.when(ok, F.floor(sec * 1000 + 0.5).cast("long"))


def periods_and_gaps(df: DataFrame, entity: str, start_sec: str, end_sec: str, block_ms: int = BLOCK_MS) -> DataFrame:
    """Merge the intervals of each entity; columns entity, kind ('period' or 'gap'), start_ms, end_ms.

    Touching intervals belong together. A row with a null or NaN bound, or an end not after its start,
    is no interval; rows without entity are left out. Repeated rows change nothing.

    Intervals are first collapsed to the latest end per (entity, start), so a block of ``block_ms``
    milliseconds holds at most that many rows, however uneven the entities are. Inside each block rows
    are sorted by start and compared with the running maximum of the ends before them; what earlier
    blocks contribute (their latest end, and the label of the period still open) is a prefix over one
    row per block. An island is labelled by the start that opens it.
    """
    iv = (
        df.select(F.col(entity).alias("e"), to_ms(F.col(start_sec)).alias("s"), to_ms(F.col(end_sec)).alias("t"))
        .where(F.col("e").isNotNull() & (F.col("t") > F.col("s")))
        .groupBy("e", "s")
        .agg(F.max("t").alias("t"))
        .withColumn("b", F.floor(F.col("s") / F.lit(block_ms)).cast("long"))
    )
    earlier = Window.partitionBy("e").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    reach = iv.groupBy("e", "b").agg(F.max("t").alias("top")).withColumn("reach", F.max("top").over(earlier)).drop("top")
    inside = Window.partitionBy("e", "b").orderBy("s")
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    prev = F.greatest("reach", "run")  # skips nulls
    rows = (
        iv.join(reach, ["e", "b"])
        .withColumn("run", F.max("t").over(before))
        .withColumn("prev", prev)
        .withColumn("opens", F.col("prev").isNull() | (F.col("s") > F.col("prev")))
        .withColumn("island", F.last(F.when(F.col("opens"), F.col("s")), ignorenulls=True).over(inside))
    )
    parts = rows.groupBy("e", "b", "island").agg(
        F.max("t").alias("t"), F.max(F.when(F.col("opens"), F.col("prev"))).alias("prev")
    )
    heads = parts.groupBy("e", "b").agg(F.max("island").alias("newest"))
    heads = heads.withColumn("open", F.max("newest").over(earlier)).drop("newest")
    labelled = parts.join(heads, ["e", "b"]).withColumn("island", F.coalesce("island", "open"))
    periods = labelled.groupBy("e", "island").agg(F.max("t").alias("t"), F.max("prev").alias("prev"))
    kinds = F.array(
        F.struct(F.lit("period").alias("kind"), F.col("island").alias("start_ms"), F.col("t").alias("end_ms")),
        F.struct(F.lit("gap").alias("kind"), F.col("prev").alias("start_ms"), F.col("island").alias("end_ms")),
    )
    return (
        periods.select(F.col("e").alias(entity), F.explode(kinds).alias("k"))
        .select(entity, "k.kind", "k.start_ms", "k.end_ms")
        .where(F.col("start_ms").isNotNull())
    )

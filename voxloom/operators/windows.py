"""Ordering operators: exact ranks, best-per-key, islands. None sorts a whole key in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxloom.operators.chunking import CHUNK_ROWS, number_within_key, with_chunks


def numbered(df: DataFrame, order: list[str], name: str = "rn") -> DataFrame:
    """Number all rows from 0 in a global order, without a single-task window."""
    return number_within_key(df, [], order, name)


def best_per_key(df: DataFrame, key: str, *order: Column) -> DataFrame:
    """The first row of each key in ``order``, by partial aggregation. Order expressions must be ascending-able
    (negate numbers for descending); add a unique column last so that ties are defined."""
    others = [c for c in df.columns if c != key]
    first = F.min_by(F.struct(*others), F.struct(*[o.alias(f"_{i}") for i, o in enumerate(order)]))
    return df.groupBy(key).agg(first.alias("_b")).select(key, "_b.*").select(*df.columns)


def top_keys(df: DataFrame, key: str, amount: Column, most: int, largest: bool = True) -> DataFrame:
    """(key, amount) of the ``most`` keys by summed amount, ties by key."""
    total = df.groupBy(key).agg(amount.alias("amount"))
    return total.orderBy(F.desc("amount") if largest else F.asc("amount"), key).limit(most)


def rank_map(df: DataFrame, key: str, offset: int) -> DataFrame:
    """(key, n, index): keys numbered by row count descending, then name, from ``offset``."""
    counted = df.groupBy(key).agg(F.count("*").alias("n")).withColumn("_neg", -F.col("n"))
    return numbered(counted, ["_neg", key], "_rn").select(key, "n", (F.col("_rn") + offset).cast("int").alias("index"))


def sequence_ids(df: DataFrame, key: str, order: list[str], kind: str, name: str = "segment_id") -> DataFrame:
    """'{key}_{kind}_00000', counting from 0 within the key in ``order``."""
    n = number_within_key(df, [key], order, "_seq")
    return n.withColumn(name, F.format_string(f"%s_{kind}_%05d", F.col(key), F.col("_seq"))).drop("_seq")


def islands(
    df: DataFrame, key: str, order: list[str], start: str, end: str, gap: float, chunk_rows: int = CHUNK_ROWS
) -> DataFrame:
    """Add ``island``: rows whose start follows the previous row's end by less than ``gap`` stay together.

    Only the directly preceding row counts, as in a gap merge whose end is the last one's. Rows are
    processed in equal chunks of a key; the last end of a chunk and its number of islands are carried to
    the next ones. ``order`` must be unique within a key.
    """
    rows = with_chunks(df, [key], order, chunk_rows)
    inside = Window.partitionBy(key, "chunk").orderBy("rank_in_key")
    ends = rows.groupBy(key, "chunk").agg(F.max_by(F.col(end), F.col("rank_in_key")).alias("_end"))
    by_chunk = Window.partitionBy(key).orderBy("chunk")
    ends = ends.withColumn("_carry", F.lag("_end").over(by_chunk)).drop("_end")
    rows = rows.join(ends, [key, "chunk"]).withColumn("_prev", F.coalesce(F.lag(end).over(inside), F.col("_carry")))
    opens = F.col("_prev").isNull() | ~(F.col(start) - F.col("_prev") < F.lit(gap))
    rows = rows.withColumn("_in", F.sum(opens.cast("long")).over(inside))
    base = rows.groupBy(key, "chunk").agg(F.max("_in").alias("_n"))
    before = by_chunk.rowsBetween(Window.unboundedPreceding, -1)
    base = base.withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    out = rows.join(base, [key, "chunk"]).withColumn("island", F.col("_in") + F.col("_base") - 1)
    return out.drop("_prev", "_carry", "_in", "_base")


def gap_merge(df: DataFrame, key: str, order: list[str], start: str, end: str, gap: float) -> DataFrame:
    """(key, island, start, end, parts): rows of an island merged from its first start to its last end."""
    i = islands(df, key, order, start, end, gap)
    at = F.col("rank_in_key")
    return i.groupBy(key, "island").agg(
        F.min_by(start, at).alias(start), F.max_by(end, at).alias(end), F.count("*").alias("parts")
    )


def fixed_windows(df: DataFrame, start: str, end: str, size: float) -> DataFrame:
    """Cut intervals longer than ``size`` into windows of that size and a rest; adds part."""
    n = F.greatest(F.ceil((F.col(end) - F.col(start)) / F.lit(size)).cast("int"), F.lit(1))
    parts = df.withColumn("_s", F.col(start)).withColumn("part", F.explode(F.sequence(F.lit(0), n - 1)))
    return parts.withColumns({start: F.col("_s") + F.col("part") * size, end: F.least(F.col("_s") + (F.col("part") + 1) * size, F.col(end))}).drop("_s")


def round_robin(df: DataFrame, order: list[str], shards: int) -> DataFrame:
    """Add shard: rows in ``order`` dealt to ``shards`` in turn."""
    return numbered(df, order, "_rn").withColumn("shard", F.pmod("_rn", F.lit(shards)).cast("int")).drop("_rn")

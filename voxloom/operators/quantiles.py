"""Exact quantiles without one task that holds all values, nor one per key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxloom.storage import cut

UPPER = "upper"  # instead of a fraction: the middle value, the upper of two


def quantiles(df: DataFrame, value: str, points: dict[str, float | str], *keys: str) -> DataFrame:
    """(keys, names of ``points``): linearly interpolated quantiles, or upper medians, of a numeric column.

    Nulls are left out; keys without values, or an empty table with keys, have no row, and without keys
    one row always comes, of nulls if there is no value. Null keys form a key. Equal values are counted
    first, so a value that most rows share is one row; distinct values are range-partitioned by key and
    value, numbered within partitions and shifted by the sums of those before, one row per key and
    partition. Only rows on either side of a quantile go on to the last, partial aggregation.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = [f"k{i}" for i in range(len(keys))]
    rows = df.where(F.col(value).isNotNull()).select(*[F.col(k).alias(n) for k, n in zip(keys, names)], F.col(value).cast("double").alias("x"))
    rows = rows.groupBy(*names, "x").agg(F.count("*").alias("n"))
    rows = cut(rows.repartitionByRange(parts, *[F.col(n).asc_nulls_first() for n in names], "x").withColumn("part", F.spark_partition_id()))
    sums = rows.groupBy(*names, "part").agg(F.sum("n").alias("s"))
    whole, earlier = Window.partitionBy(*names), Window.partitionBy(*names).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*[F.col(n).alias(f"s_{n}") for n in names], F.col("part").alias("s_part"), F.sum("s").over(whole).alias("all"), F.coalesce(F.sum("s").over(earlier), F.lit(0)).alias("before"))
    inside = Window.partitionBy(*names, "part").orderBy("x").rowsBetween(Window.unboundedPreceding, -1)
    on = F.col("part") == F.col("s_part")
    for n in names:
        on = on & F.col(n).eqNullSafe(F.col(f"s_{n}"))
    rows = rows.withColumn("lo", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(sums, on).withColumn("lo", F.col("lo") + F.col("before"))

    def at(rank):
        return F.max(F.when((F.col("lo") <= rank) & (rank < F.col("lo") + F.col("n")), F.col("x")))

    got, out = [], []
    for name, p in points.items():
        if p == UPPER:
            got.append(at(F.floor(F.col("all") / 2)).alias(f"a_{name}"))
            out.append(F.col(f"a_{name}").alias(name))
        else:
            place = F.lit(float(p)) * (F.col("all") - 1)
            got += [at(F.floor(place)).alias(f"a_{name}"), at(F.ceil(place)).alias(f"b_{name}"), F.max(place - F.floor(place)).alias(f"f_{name}")]
            a, b, f = (F.col(f"{x}_{name}") for x in "abf")
            out.append(F.when(a == b, a).otherwise((1 - f) * a + f * b).alias(name))
    return rows.groupBy(*names).agg(*got).select(*[F.col(n).alias(k) for n, k in zip(names, keys)], *out)


def with_quantiles(grouped: DataFrame, df: DataFrame, value: str, points: dict[str, float | str], *keys: str) -> DataFrame:
    """Add quantiles of ``df`` to a table of one row per key (or of one row), nulls where a key has no value."""
    q = quantiles(df, value, points, *keys)
    if not keys:
        return grouped.crossJoin(F.broadcast(q))
    other = q.select(*[F.col(k).alias(f"_q{i}") for i, k in enumerate(keys)], *points)
    on = F.lit(True)
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_q{i}"))
    return grouped.join(other, on, "left").drop(*[f"_q{i}" for i in range(len(keys))])

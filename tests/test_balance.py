"""Chunked keys and interval periods against brute force."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from voxloom.operators import chunking, intervals
from voxloom.operators.joins import attach_by_key


def skewed(n=500):
    rng = random.Random(3)
    keys = ["hot"] * 6 + ["a", "b", None, ""]
    return [(rng.choice(keys), rng.randrange(40), i, None if i % 50 == 0 else float(i % 7)) for i in range(n)]


@pytest.mark.parametrize("partitions", ["1", "4", "17"])
def test_rank_within_key(spark, partitions):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        rows = skewed()
        df = spark.createDataFrame(rows, "k string, at int, id int, x double").withColumn("_nk_part", F.lit("clash"))
        got = {r["id"]: r["rank_in_key"] for r in chunking.number_within_key(df, ["k"], ["at", "id"]).collect()}
        groups = defaultdict(list)
        for k, at, i, _ in rows:
            groups[k].append((at, i))
        want = {i: n for g in groups.values() for n, (_, i) in enumerate(sorted(g))}
        assert got == want
        every = {r["id"]: r["rn"] for r in chunking.number_within_key(df, [], ["at", "id"], "rn").collect()}
        assert every == {i: n for n, (_, i) in enumerate(sorted((at, i) for _, at, i, _ in rows))}
        assert chunking.number_within_key(df.limit(0), ["k"], ["id"]).count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


@pytest.mark.parametrize("chunk_rows", [1, 3, 10_000])
def test_profile_is_independent_of_chunks(spark, chunk_rows):
    rows = skewed()
    df = spark.createDataFrame(rows, "clips string, at int, id int, x double").withColumn("at", F.timestamp_micros(F.col("at").cast("long")))
    got = {r["clips"]: r for r in chunking.key_profile(df.withColumnRenamed("clips", "chunk"), "chunk", "at", ["id"], F.col("x"), chunk_rows)
           .withColumnRenamed("clips", "n").withColumnRenamed("chunk", "clips").collect()}
    groups = defaultdict(list)
    for k, at, i, x in rows:
        groups[k].append((at, i, x))
    for k, g in groups.items():
        g.sort()
        waits = [b[0] - a[0] for a, b in zip(g, g[1:])]
        assert (got[k]["n"], got[k]["amount"], got[k]["max_wait_us"]) == (len(g), sum(x or 0 for *_, x in g), max(waits, default=0))
    heavy = {r["k"]: r["rows"] for r in chunking.heavy_keys(spark.createDataFrame(rows, "k string, at int, id int, x double"), "k", ["id"], 0.3, chunk_rows).collect()}
    assert heavy == {"hot": len(groups["hot"])}


def test_apply_in_chunks(spark):
    df = spark.createDataFrame(skewed(), "k string, at int, id int, x double")
    out = chunking.apply_in_chunks(
        df, ["k"], ["id"], lambda p: p.groupby(["k", "chunk"], dropna=False, as_index=False).agg(n=("id", "count"), first=("id", "first")),
        "k string, chunk long, n long, first int", chunk_rows=20,
    ).collect()
    assert sum(r["n"] for r in out) == 500 and max(r["n"] for r in out) == 20


def brute(rows):
    groups = defaultdict(list)
    for e, s, t in rows:
        if e is not None and s is not None and t is not None and s == s and t == t and t > s:
            groups[e].append((round(s * 1000), round(t * 1000)))
    out = []
    for e, g in groups.items():
        merged = []
        for s, t in sorted(g):
            if merged and s <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], t)
            else:
                merged.append([s, t])
        out += [(e, "period", s, t) for s, t in merged]
        out += [(e, "gap", a[1], b[0]) for a, b in zip(merged, merged[1:])]
    return sorted(out)


@pytest.mark.parametrize("block", [1, 7, 1000, 600_000])
def test_periods_and_gaps(spark, block):
    rng = random.Random(block)
    rows = [(rng.choice(["hot", "hot", "a", "b"]), rng.randrange(60) / 10, rng.randrange(70) / 10) for _ in range(90)]
    rows += [("n", None, 1.0), ("n", 1.0, float("nan")), (None, 0.0, 1.0), ("z", 5.0, 5.0), ("long", 0.0, 999.0), ("long", 1.0, 2.0), ("long", 999.0, 1000.0), ("long", 1000.5, 1001.0)]
    df = spark.createDataFrame(rows * 2, "kind string, s double, e double").withColumn("t", F.lit(0))
    got = sorted(tuple(r) for r in intervals.periods_and_gaps(df, "kind", "s", "e", block).toDF("e", "kind", "s", "t").collect())
    assert got == brute(rows)
    assert intervals.periods_and_gaps(df.limit(0), "kind", "s", "e").count() == 0


@pytest.mark.parametrize("min_hot", [2, 100_000])
def test_hot_join(spark, min_hot):
    rows = spark.createDataFrame([("h", i) for i in range(50)] + [("c", 99), (None, 1)], "key string, i int")
    table = spark.createDataFrame([("h", 50, "x"), ("c", 1, "y"), ("none", 0, "z")], "key string, n long, v string")
    got = sorted((r["i"], r["v"]) for r in attach_by_key(rows, table, "key", "n", min_hot).collect())
    assert got == [(i, "x") for i in range(50)] + [(99, "y")]
    assert attach_by_key(rows, table.limit(0), "key", "n", min_hot).count() == 0

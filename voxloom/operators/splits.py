"""Hash splits, hold-outs, seeded draws and pairing within a speaker."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.config import PREP
from voxloom.functions.hashing import hash_split, seeded
from voxloom.operators.chunking import number_within_key
from voxloom.operators.windows import numbered


def eval_split(df: DataFrame, clip_id: str, speaker: str, holdout: list[str], ratio: float = PREP.eval_ratio) -> DataFrame:
    """Adds split: hold-out speakers and the hashed share go to eval, the rest to train."""
    held = F.col(speaker).isin(holdout) if holdout else F.lit(False)
    return df.withColumn("split", F.when(held, "eval").otherwise(hash_split(F.col(clip_id), ratio, "eval", "train")))


def check_holdout(df: DataFrame, speaker: str, holdout: list[str]) -> None:
    """Raise if a hold-out speaker does not occur; names up to 20 that do."""
    have = {r[0] for r in df.where(F.col(speaker).isin(holdout)).select(speaker).distinct().collect()}
    if missing := sorted(set(holdout) - have):
        some = [r[0] for r in df.select(speaker).distinct().orderBy(speaker).limit(20).collect()]
        raise ValueError(f"unknown hold-out speakers {missing}; there are {some}")


def seeded_share(df: DataFrame, clip_id: str, parts: int = 20, seed: int = 42) -> DataFrame:
    """Adds split: the first max(1, n div parts) rows in seeded order are eval, the rest train."""
    rows = numbered(df.withColumn("_h", seeded(F.col(clip_id), seed)), ["_h", clip_id], "_rn")
    n = F.broadcast(df.agg(F.count("*").alias("_n")))
    take = F.greatest(F.floor(F.col("_n") / parts), F.lit(1))
    return rows.crossJoin(n).withColumn("split", F.when(F.col("_rn") < take, "eval").otherwise("train")).drop("_h", "_rn", "_n")


def seeded_draw(df: DataFrame, clip_id: str, n: int, seed: int = 42) -> DataFrame:
    """``n`` rows drawn reproducibly."""
    return df.orderBy(seeded(F.col(clip_id), seed), clip_id).limit(n)


def context_pairs(df: DataFrame, clip_id: str, speaker: str, seed: int = 42) -> DataFrame:
    """(id, speaker, context_id): another clip of the same speaker for every clip.

    Clips are numbered exactly within their speaker; clip r of n is paired with clip (r + k) mod n, where
    k in 1..n-1 comes from a seeded hash. Speakers with one clip have no row. Ids must be distinct.
    """
    rows = number_within_key(df.select(clip_id, speaker).withColumn("_h", seeded(F.col(clip_id), seed)), [speaker], ["_h", clip_id], "_r")
    n = df.groupBy(speaker).agg(F.count("*").alias("_n")).where("_n > 1")
    mine = rows.join(n, speaker)
    step = F.lit(1) + F.pmod(seeded(F.col(clip_id), seed + 1), F.col("_n") - 1)
    mine = mine.withColumn("_o", F.pmod(F.col("_r") + step, F.col("_n")))
    other = rows.select(speaker, F.col("_r").alias("_o"), F.col(clip_id).alias("context_id"))
    return mine.join(other, [speaker, "_o"]).select(clip_id, speaker, "context_id")

"""Queries on uneven keys (p2) and on time intervals (p3), with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxloom.operators.chunking import heavy_keys, key_profile
from voxloom.operators.intervals import periods_and_gaps
from voxloom.storage import once, read

HEAVY_SHARE = 0.05


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Speakers, as written, on at least 5 % of the distinct clips of train_manifest."""
    clips = once(read(spark, sf_dir, "train_manifest"), "ingested_at", "id", "speaker_id")
    return heavy_keys(clips, "speaker_id", ["ingested_at", "id"], HEAVY_SHARE).select("speaker_id")


def p2_speaker_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clips, hours, arrival span and longest wait between consecutive arrivals of each speaker."""
    clips = once(read(spark, sf_dir, "train_manifest"), "ingested_at", "id", "speaker_id", "duration")
    out = key_profile(clips, "speaker_id", "ingested_at", ["id"], F.col("duration").cast("decimal(18,4)"))
    return out.select(
        "speaker_id",
        "clips",
        F.round(F.col("amount").cast("double") / 3600, 6).alias("hours"),
        F.unix_micros("first_at").alias("first_us"),
        F.unix_micros("last_at").alias("last_us"),
        "max_wait_us",
    )


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periods and gaps of segment and of word_timing, each treated alone."""
    out = None
    for tbl in ("segment", "word_timing"):
        part = periods_and_gaps(read(spark, sf_dir, tbl), "recording_id", "start_sec", "end_sec")
        part = part.select(F.lit(tbl).alias("tbl"), "recording_id", "kind", "start_ms", "end_ms")
        out = part if out is None else out.unionByName(part)
    return out


QUERIES = {"p2_found": p2_found, "p2_speaker_profile": p2_speaker_profile, "p3_found": p3_found}

_P3 = """
  SELECT '{t}' AS tbl, recording_id, s, e, max(e) OVER w AS prev
  FROM (SELECT recording_id, CAST(floor(start_sec * 1000 + 0.5) AS BIGINT) AS s,
               CAST(floor(end_sec * 1000 + 0.5) AS BIGINT) AS e FROM {t}
        WHERE recording_id IS NOT NULL AND start_sec IS NOT NULL AND end_sec IS NOT NULL AND NOT isnan(start_sec)
          AND NOT isnan(end_sec))
  WHERE e > s WINDOW w AS (PARTITION BY recording_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"""

SQL = {
    "p2_found": """
WITH c AS (SELECT DISTINCT id, speaker_id FROM train_manifest)
SELECT speaker_id FROM c GROUP BY speaker_id
HAVING speaker_id <> '' AND count(*) >= 0.05::DOUBLE * (SELECT count(*) FROM c)""",
    "p2_speaker_profile": """
WITH c AS (SELECT id, speaker_id, duration, min(ingested_at) AS arrived FROM train_manifest GROUP BY id, speaker_id, duration),
g AS (SELECT *, epoch_us(arrived) AS us,
        epoch_us(arrived) - lag(epoch_us(arrived)) OVER (PARTITION BY speaker_id ORDER BY arrived, id) AS wait FROM c)
SELECT speaker_id, count(*) AS clips,
       round(CAST(coalesce(sum(CAST(duration AS DECIMAL(18,4))), 0) AS DOUBLE) / 3600, 6) AS hours,
       min(us) AS first_us, max(us) AS last_us, coalesce(max(wait), 0) AS max_wait_us
FROM g GROUP BY speaker_id""",
    "p3_found": f"""
WITH m AS ({_P3.format(t='segment')} UNION ALL {_P3.format(t='word_timing')}),
i AS (SELECT *, sum(CASE WHEN prev IS NULL OR s > prev THEN 1 ELSE 0 END)
        OVER (PARTITION BY tbl, recording_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS k FROM m),
p AS (SELECT tbl, recording_id, k, min(s) AS s, max(e) AS e FROM i GROUP BY ALL)
SELECT tbl, recording_id, 'period' AS kind, s AS start_ms, e AS end_ms FROM p
UNION ALL
SELECT tbl, recording_id, 'gap', e, nxt FROM
  (SELECT *, lead(s) OVER (PARTITION BY tbl, recording_id ORDER BY k) AS nxt FROM p) WHERE nxt IS NOT NULL""",
}

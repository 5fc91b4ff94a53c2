"""Resumable quality pipeline: named stages, kept and dropped rows, checkpoints by name and configuration."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxloom.config import QUALITY, QualityConfig
from voxloom.operators import filters
from voxloom.operators.aggs import metric_summary


@dataclass
class StageResult:
    """All rows with their reason, KEPT for those that stay, and tables to write beside them."""

    judged: DataFrame
    side: dict[str, DataFrame] = field(default_factory=dict)


Stage = Callable[[DataFrame, QualityConfig], StageResult]
STAGES: dict[str, Stage] = {}


def stage(name: str):
    """Register a stage; the caller chooses the order."""

    def add(f: Stage) -> Stage:
        STAGES[name] = f
        return f

    return add


def by_reason(df: DataFrame) -> StageResult:
    """A null reason counts as dropped."""
    return StageResult(df.withColumn("reason", F.coalesce("reason", F.lit("unknown"))))


@stage("standardize")
def standardize(df: DataFrame, c: QualityConfig) -> StageResult:
    loud = F.col("loudness") if "loudness" in df.columns else None
    return by_reason(df.withColumn("reason", filters.standard_reason(F.col("duration"), loud, c)))


@stage("enhance")
def enhance(df: DataFrame, c: QualityConfig) -> StageResult:
    """Keeps rows whose scorer reported success in enhanced; without that column all rows stay."""
    ok = F.coalesce("enhanced", F.lit(False)) if "enhanced" in df.columns else F.lit(True)
    return by_reason(df.withColumn("reason", F.when(ok, filters.KEPT).otherwise("enhance_error")))


@stage("nisqa")
def nisqa(df: DataFrame, c: QualityConfig) -> StageResult:
    """Score at least ``min_mos``; all scores, also of dropped rows, go to a side table."""
    if "nisqa_mos" not in df.columns:
        df = df.withColumn("nisqa_mos", F.lit(None).cast("double"))
    mos = F.col("nisqa_mos")
    r = by_reason(df.withColumn("reason", filters.cascade((mos.isNull() | F.isnan(mos), "no_score"), (mos < c.min_mos, "low_mos"))))
    r.side["nisqa_scores"] = df.select("id", *[x for x in df.columns if x.startswith("nisqa_")])
    return r


@stage("silence_trim")
def silence_trim(df: DataFrame, c: QualityConfig) -> StageResult:
    """Needs trimmed_duration from a scorer; not among the default stages."""
    t = F.col("trimmed_duration")
    return by_reason(df.withColumn("reason", filters.cascade((t.isNull(), "trim_error"), (t < c.min_trimmed, "too_short"))))


@stage("duration_outlier")
def duration_outlier(df: DataFrame, c: QualityConfig) -> StageResult:
    valued = df.withColumn("char_duration", filters.char_duration(F.col("text"), F.col("duration")))
    b = F.broadcast(filters.iqr_bounds(valued, "char_duration", c.iqr_factor))
    x = F.col("char_duration")
    reason = F.when(F.col("lo").isNull(), filters.KEPT).otherwise(
        filters.cascade((x.isNull(), "no_chars"), (x < F.col("lo"), "too_fast"), (x > F.col("hi"), "too_slow"))
    )
    return by_reason(valued.crossJoin(b).withColumn("reason", reason).drop("lo", "hi"))


@stage("transcript_verify")
def transcript_verify(df: DataFrame, c: QualityConfig) -> StageResult:
    from voxloom.functions.metrics import cer_verify

    scored = df.withColumn("asr_cer", cer_verify(F.col("text"), F.col("asr_text")))
    reason = filters.cascade((F.col("asr_text").isNull(), "asr_error"), (F.col("asr_cer") > c.max_cer, "high_cer"))
    return by_reason(scored.withColumn("reason", reason))


@stage("speaker_select")
def speaker_select(df: DataFrame, c: QualityConfig) -> StageResult:
    """Speakers of enough volume, at most ``max_speakers``; if any row lacks a speaker, cluster_id decides."""
    nameless = df.where(F.col("speaker_id").isNull() | F.col("speaker_id").isin("", "unknown")).limit(1).count()
    if nameless and "cluster_id" in df.columns:
        key, good = "cluster_id", filters.cluster_sizes(df, "cluster_id", c.min_cluster)
    else:
        named = df.where(F.col("speaker_id").isNotNull())
        key, good = "speaker_id", filters.enough_volume(named, "speaker_id", F.col("duration"), c.min_speaker_seconds, c.max_speakers)
    good = good.groupBy(key).agg(F.first(F.lit(filters.KEPT)).alias("reason"))
    return StageResult(df.join(good, key, "left").withColumn("reason", F.coalesce("reason", F.lit("speaker_volume"))))


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def run_quality(
    clips: DataFrame, output: str, stages: tuple[str, ...] | None = None, config: QualityConfig = QUALITY, resume: bool = True
) -> DataFrame:
    """Run stages in order and return the rows kept by all.

    Every stage is computed once and writes parquet under ``output/stage=<i>_<name>/rows/verdict=kept|dropped``
    (and side tables) and, last, a marker. A stage is skipped on resume only if its own name, the stages before it and the
    configuration all match, so a changed list never resumes wrongly. Empty input passes through.
    """
    spark = clips.sparkSession
    names = tuple(config.stages if stages is None else stages)
    if unknown := [n for n in names if n not in STAGES]:
        raise ValueError(f"unknown stages {unknown}; there are {sorted(STAGES)}")
    now = clips
    for i, name in enumerate(names, 1):
        mark = hashlib.md5(json.dumps([names[:i], asdict(config)], default=str).encode()).hexdigest()
        base = f"{output}/stage={i}_{name}"
        fs, done = _fs(spark, f"{base}/done-{mark}")
        if not (resume and fs.exists(done)):
            fs.delete(_fs(spark, base)[1], True)
            result = STAGES[name](now, config)
            verdict = F.when(F.col("reason") == filters.KEPT, "kept").otherwise("dropped")
            result.judged.withColumn("verdict", verdict).write.mode("overwrite").partitionBy("verdict").parquet(f"{base}/rows")
            spark.createDataFrame([], result.judged.schema).write.mode("overwrite").parquet(f"{base}/schema")
            for k, v in result.side.items():
                v.write.mode("overwrite").parquet(f"{base}/side={k}")
            fs.create(done).close()
        now = stage_rows(spark, base).where("verdict = 'kept'").drop("verdict", "reason")
    return now


def stage_rows(spark: SparkSession, base: str) -> DataFrame:
    """All rows of a finished stage with reason and verdict, also if a verdict has none."""
    schema = spark.read.parquet(f"{base}/schema").schema
    return spark.read.schema(schema.add("verdict", "string")).parquet(f"{base}/rows")


def stage_statistics(spark: SparkSession, output: str, names: tuple[str, ...], values: dict[str, str]) -> DataFrame:
    """(stage, value, mean, median, std, p90, min, max, n) of a stage's column over all rows it judged; ``values`` maps stages to columns."""
    out = None
    for i, name in enumerate(names, 1):
        if name in values:
            part = metric_summary(stage_rows(spark, f"{output}/stage={i}_{name}"), values[name])
            part = part.select(F.lit(name).alias("stage"), F.lit(values[name]).alias("value"), *part.columns)
            out = part if out is None else out.unionByName(part)
    return out


def stage_counts(spark: SparkSession, output: str, names: tuple[str, ...]) -> DataFrame:
    """(stage, kept, dropped, kept_pct) of a finished run."""
    rows = None
    for i, name in enumerate(names, 1):
        each = [F.count(F.when(F.col("verdict") == v, 1)).alias(v) for v in ("kept", "dropped")]
        part = stage_rows(spark, f"{output}/stage={i}_{name}").agg(*each)
        part = part.select(F.lit(i).alias("stage_no"), F.lit(name).alias("stage"), "kept", "dropped")
        rows = part if rows is None else rows.unionByName(part)
    share = F.coalesce(F.try_divide(F.col("kept") * 100.0, F.col("kept") + F.col("dropped")), F.lit(0.0))
    return rows.withColumn("kept_pct", share)

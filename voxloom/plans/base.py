"""Distinct rows of the manifest tables, as the core queries see them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from voxloom.storage import read

CLIP_COLUMNS = ["id", "audio_path", "text", "speaker_id", "duration", "book_title", "has_punctuation", "multi_speaker"]
SEGMENT_COLUMNS = ["segment_id", "recording_id", "text", "asr_text", "book_text", "start_sec", "end_sec", "duration_sec", "cer", "speaker_id"]


def clips(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Clips of train_manifest, delivered again or not, once; only the named columns are read."""
    return read(spark, sf_dir, "train_manifest").select(*(columns or CLIP_COLUMNS)).distinct()


def evals(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return read(spark, sf_dir, "eval_manifest").select(*(columns or [*CLIP_COLUMNS, "split"])).distinct()


def segments(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return read(spark, sf_dir, "segment").select(*(columns or SEGMENT_COLUMNS)).distinct()


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "aligned_chunk").distinct()

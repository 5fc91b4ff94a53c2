"""Corpus preparation, recording segmentation and evaluation as DataFrame plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxloom.config import PREP
from voxloom.functions.hashing import hash_split
from voxloom.functions.metrics import cer_eval, wer
from voxloom.functions.text import base_name, stem
from voxloom.operators import aggs, filters, folds, joins, splits, windows


def prepare_corpus(clips: DataFrame, holdout: list[str] | None = None) -> DataFrame:
    """Adds reason and, for kept clips, split; duration rounded to 1e-4. Audio columns are never touched."""
    rows = filters.with_prep_reason(clips, "id", "book_title", "text", "duration")
    rows = splits.eval_split(rows, "id", "speaker_id", holdout or [])
    split = F.when(F.col("reason") == filters.KEPT, F.col("split"))
    return rows.withColumns({"split": split, "duration": F.round("duration", 4)})


def speaker_index(clips: DataFrame, holdout: str) -> DataFrame:
    """(speaker_id, n, index): single speakers by clip count, the hold-out left out, numbered from the offset."""
    named = clips.where(F.col("speaker_id").isNotNull() & ~F.col("speaker_id").contains(",") & (F.col("speaker_id") != holdout))
    return windows.rank_map(named, "speaker_id", PREP.index_offset)


def route_experiment(clips: DataFrame, holdout: str) -> DataFrame:
    """Adds route (train, val, holdout or a reason) and speaker_index; the speaker's name stays."""
    r = filters.experiment_route(
        F.col("has_punctuation"), F.col("multi_speaker"), F.col("speaker_id"), holdout,
        hash_split(F.col("id"), PREP.train_ratio, "train", "val"),
    )
    index = speaker_index(clips, holdout).select("speaker_id", F.col("index").alias("speaker_index"))
    return clips.withColumn("route", r).join(index, "speaker_id", "left")


def trainer_manifest(clips: DataFrame, audio_dir: str, codes_dir: str, codes: DataFrame | None = None, contexts: DataFrame | None = None) -> DataFrame:
    """Trainer fields: re-rooted paths, integer speaker (0 unless all digits), optional codes and context."""
    speaker = F.when(F.col("speaker_id").rlike("^[0-9]+$"), F.col("speaker_id").try_cast("int"))
    out = clips.select(
        "id",
        F.concat(F.lit(audio_dir.rstrip("/") + "/"), base_name(F.col("audio_path"))).alias("audio_filepath"),
        "text", "duration", "speaker_id", F.coalesce(speaker, F.lit(0)).alias("speaker"),
        F.concat(F.lit(codes_dir.rstrip("/") + "/"), stem(F.col("audio_path")), F.lit(".pt")).alias("target_audio_codes_path"),
    )
    if codes is not None:
        have = codes.select(F.col("path").alias("target_audio_codes_path"), F.lit(True).alias("_have")).distinct()
        out = out.join(have, "target_audio_codes_path", "left").withColumn("target_audio_codes_path", F.when(F.col("_have"), F.col("target_audio_codes_path"))).drop("_have")
    if contexts is not None:
        out = joins.first_reference(out, contexts, "speaker_id", "ref_order")
    return out


def segment_recordings(words: DataFrame) -> DataFrame:
    """Sentence segments with ids that count through a recording, and their filter reason."""
    segs = folds.sentence_segments(words)
    segs = windows.sequence_ids(segs, "recording_id", ["recording_id", "chunk_idx", "seg"], "seg")
    return segs.withColumn("reason", filters.segment_reason(F.col("text"), F.col("duration_sec")))


def chunk_recordings(intervals: DataFrame, key: str) -> DataFrame:
    """Speech intervals to recogniser chunks: bounded merge, then absorption of short ones."""
    return folds.absorb_short(folds.bounded_merge(intervals, key).drop("parts"), key)


def evaluate(samples: DataFrame, reference: Column, hypothesis: Column) -> DataFrame:
    """Adds cer and wer per sample."""
    return samples.withColumns({"cer": cer_eval(reference, hypothesis), "wer": wer(reference, hypothesis)})


def best_run(scored: DataFrame, run: str, speaker: str, metric: str) -> DataFrame:
    """(run, run_mean, speaker, speaker_mean): the run of the lowest mean, ties by name, and its best speaker."""
    runs = scored.groupBy(run).agg(F.avg(metric).alias("run_mean"))
    best = runs.orderBy("run_mean", run).limit(1)
    per = scored.groupBy(run, speaker).agg(F.avg(metric).alias("speaker_mean")).join(F.broadcast(best), run)
    return per.orderBy("speaker_mean", speaker).limit(1).select(run, "run_mean", speaker, "speaker_mean")


def run_evaluation(samples: DataFrame, metrics: dict[str, str], output: str | None = None) -> DataFrame:
    """(metric, mean, median, std, p90, min, max, n, error), one row per metric of ``metrics`` (name to column).

    A metric whose column is missing has its error and nulls. With ``output`` the samples and the summary
    are written there, the summary also as one JSON line per metric.
    """
    out = None
    for name, column in metrics.items():
        if column in samples.columns:
            part = aggs.metric_summary(samples, column).withColumn("error", F.lit(None).cast("string"))
        else:
            fields = [F.lit(None).cast("double").alias(c) for c in ("mean", "median", "std", "p90", "min", "max")]
            part = samples.sparkSession.range(1).select(*fields, F.lit(0).cast("long").alias("n"), F.lit(f"no column {column}").alias("error"))
        part = part.select(F.lit(name).alias("metric"), *part.columns)
        out = part if out is None else out.unionByName(part)
    if output:
        samples.write.mode("overwrite").parquet(f"{output}/samples")
        out.write.mode("overwrite").parquet(f"{output}/summary")
        out.coalesce(1).write.mode("overwrite").json(f"{output}/summary_json")
    return out

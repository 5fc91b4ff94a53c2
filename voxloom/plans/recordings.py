"""Recording drivers: speech to judged clips, manifests and yields, resumable by recording.

One plan covers all recordings; work is partitioned by recording only where the alignment cursor demands
it. Audio never passes through: intervals, transcripts and word timings come as tables, from a scorer
(``voxloom.scorers``) or from an earlier run.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxloom.functions.text import script_ratio
from voxloom.operators import aggs, align, filters, joins, windows
from voxloom.plans.corpus import chunk_recordings, segment_recordings
from voxloom.plans.runner import _fs


def recogniser_chunks(intervals: DataFrame) -> DataFrame:
    """(recording_id, chunk_id, start_sec, end_sec, duration_sec) of speech intervals.

    Chunks are numbered before those of unfit length go out, so the numbers have gaps.
    """
    c = windows.sequence_ids(chunk_recordings(intervals, "recording_id"), "recording_id", ["recording_id", "start_sec", "end_sec"], "_chunk", "chunk_id")
    c = c.withColumn("duration_sec", F.col("end_sec") - F.col("start_sec"))
    return c.where(filters.chunk_length_ok(F.col("duration_sec"))).select("recording_id", "chunk_id", "start_sec", "end_sec", "duration_sec")


def judge_chunks(aligned: DataFrame, chunks: DataFrame) -> DataFrame:
    """Aligned chunks with duration_sec, reason and tag; a recording whose book doesn't fit keeps its transcripts."""
    rows = filters.without_book_text(aligned, "recording_id", "asr_text", "cer")
    rows = rows.join(chunks.select("chunk_id", "duration_sec"), "chunk_id", "left")
    text = F.when(F.col("punctuated_text") != "", F.col("punctuated_text")).otherwise(F.coalesce("asr_text", F.lit("")))
    return filters.with_chunk_reason(rows.withColumn("text", text), "text", "cer", "duration_sec")


def first_generation(intervals: DataFrame, transcripts: DataFrame, books: DataFrame) -> DataFrame:
    """Chunk, look up transcripts(chunk_id, text), align to books(recording_id, text), judge.

    A chunk without transcript counts as ''. One row per chunk, with its reason.
    """
    chunks = recogniser_chunks(intervals)
    spoken = joins.left_default(chunks.select("recording_id", "chunk_id"), transcripts, "chunk_id", {"text": ""})
    return judge_chunks(align.align_chunks(spoken, books), chunks)


def second_generation(words: DataFrame, books: DataFrame) -> DataFrame:
    """Sentence segments of word timings, aligned to books(recording_id, text) and judged; one row per segment."""
    segs = segment_recordings(words).drop("reason")
    spans = segs.select("recording_id", "segment_id", "start_sec", "end_sec", "duration_sec")
    out = align.align_segments(segs.select("recording_id", "segment_id", "text"), books).join(spans, ["recording_id", "segment_id"])
    return out.withColumn("reason", filters.segment_reason(F.col("text"), F.col("duration_sec")))


def clip_manifest(judged: DataFrame, clip_id: str, speaker: Column, folder: str = "wavs", measures: bool = False) -> DataFrame:
    """Manifest rows of the clips that passed; ``measures`` adds pace and script share."""
    out = judged.where(F.col("reason") == filters.KEPT).select(
        F.col(clip_id).alias("id"), F.concat(F.lit(folder.rstrip("/") + "/"), F.col(clip_id), F.lit(".wav")).alias("audio_filepath"),
        "text", "asr_text", "book_text", speaker.alias("speaker_id"), F.col("duration_sec").alias("duration"), "cer",
    )
    if not measures:
        return out
    return out.withColumns({"chars_per_sec": filters.chars_per_second(F.col("text"), F.col("duration")), "georgian_ratio": script_ratio(F.col("text"))})


def recording_yield(judged: DataFrame) -> DataFrame:
    """Per recording the rows judged and kept, and their seconds; see ``aggs.yield_report``."""
    return aggs.yield_report(judged, "recording_id", F.col("reason") == filters.KEPT, "duration_sec")


def run_recordings(names: DataFrame, judge: Callable[[DataFrame], DataFrame], output: str, resume: bool = True) -> DataFrame:
    """Judge the recordings of names(recording_id) not judged by an earlier run and return all judged rows.

    ``judge(pending)`` gets the pending recording_ids. A run appends its rows to ``output/rows`` and only
    then its recordings, also those without any row, to ``output/done``; rows of a run that died in
    between are ignored, as each run's rows carry its number. ``output/summary`` has the counts over all
    recordings as one JSON line. An empty table of names changes nothing.
    """
    spark = names.sparkSession
    fs, root = _fs(spark, output)
    if not resume:
        fs.delete(root, True)
    done_path, rows_path = f"{output}/done", f"{output}/rows"
    wanted = names.select("recording_id").where(F.col("recording_id").isNotNull()).distinct()
    run = 0
    if fs.exists(_fs(spark, done_path)[1]):
        done = spark.read.parquet(done_path)
        run = (done.agg(F.max("run")).first()[0] or 0) + 1
        wanted = filters.pending(wanted, done, "recording_id")
    if not wanted.isEmpty():
        fs.delete(_fs(spark, f"{rows_path}/run={run}")[1], True)
        judge(wanted).write.parquet(f"{rows_path}/run={run}")
        wanted.withColumn("run", F.lit(run)).write.mode("append").parquet(done_path)
    done = spark.read.parquet(done_path)
    judged = spark.read.option("basePath", rows_path).parquet(*[f"{rows_path}/run={r['run']}" for r in done.select("run").distinct().collect()])
    judged = judged.join(done.select("recording_id", "run"), ["recording_id", "run"], "left_semi").drop("run")
    kept = F.col("reason") == filters.KEPT
    one = judged.agg(F.count("*").alias("clips"), F.count(F.when(kept, 1)).alias("kept"), F.sum("duration_sec").alias("seconds"), F.sum(F.when(kept, F.col("duration_sec"))).alias("kept_seconds")).first()
    summary = one.asDict() | {"recordings": done.count(), "tags": {r["tag"]: r["n"] for r in aggs.reason_counts(judged, "reason").collect()}}
    spark.createDataFrame([(json.dumps(summary, ensure_ascii=False),)], "value string").coalesce(1).write.mode("overwrite").text(f"{output}/summary")
    return judged

"""Row filters: first-match cascades with reasons, global outliers, presence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxloom.config import CHUNK, FILTER, PREP, QUALITY, QualityConfig
from voxloom.functions.compress import compression_ratio
from voxloom.functions.metrics import cer_verify
from voxloom.functions.text import repeated_chars, repeated_words, script_ratio, segment_number, stripped
from voxloom.operators.quantiles import quantiles

KEPT = "ok"


def cascade(*rules: tuple[Column, str]) -> Column:
    """Name of the first rule that holds, KEPT if none does; a null condition does not hold."""
    out = None
    for test, name in rules:
        out = F.when(test, name) if out is None else out.when(test, name)
    return out.otherwise(KEPT)


def chars_per_second(text: Column, seconds: Column) -> Column:
    """Characters (spaces included) over seconds; null unless the duration is positive."""
    return F.when(seconds > 0, F.length(text) / seconds)


def standard_reason(seconds: Column, loudness: Column | None = None, config: QualityConfig = QUALITY) -> Column:
    """dropped_error (no duration, or loudness not finite), dropped_short, dropped_long or ok; bounds inclusive."""
    bad = seconds.isNull() | F.isnan(seconds)
    if loudness is not None:
        bad = bad | loudness.isNull() | F.isnan(loudness) | (F.abs(loudness) == float("inf"))
    return cascade((bad, "dropped_error"), (seconds < config.min_duration, "dropped_short"), (seconds > config.max_duration, "dropped_long"))


def char_duration(text: Column, seconds: Column) -> Column:
    """Seconds per character other than U+0020; null without characters."""
    return F.try_divide(seconds, F.length(F.replace(text, F.lit(" "), F.lit(""))))


def duration_or_frames(seconds: Column, frames: Column, rate: Column) -> Column:
    """The duration, or frames over sample rate where it is null or not positive."""
    return F.when(seconds > 0, seconds).otherwise(F.try_divide(frames, rate))


def iqr_bounds(df: DataFrame, value: str, factor: float = QUALITY.iqr_factor) -> DataFrame:
    """One row (lo, hi): linear-interpolated quartiles widened by ``factor`` times their distance."""
    q = quantiles(df, value, {"q1": 0.25, "q3": 0.75})
    spread = (F.col("q3") - F.col("q1")) * factor
    return q.select((F.col("q1") - spread).alias("lo"), (F.col("q3") + spread).alias("hi"))


def iqr_keep(df: DataFrame, value: str) -> DataFrame:
    """Rows within the bounds, both inclusive. Rows without a value go out, unless no row has one: then all stay."""
    b = F.broadcast(iqr_bounds(df, value))
    inside = (F.col(value) >= F.col("lo")) & (F.col(value) <= F.col("hi"))
    return df.crossJoin(b).where(inside | F.col("lo").isNull()).drop("lo", "hi")


def verified(df: DataFrame, text: str, asr: str, most: float = QUALITY.max_cer) -> DataFrame:
    """Adds asr_cer and keeps rows up to ``most``; a missing transcript drops the row."""
    return df.withColumn("asr_cer", cer_verify(F.col(text), F.col(asr))).where(F.col(asr).isNotNull() & (F.col("asr_cer") <= most))


def chunk_reason(text: Column, cer: Column, seconds: Column, compression: Column) -> Column:
    """Reason of the first transcript filter that fails, with its value as 'tag:value', or ok.

    ``text`` is the punctuated or raw transcript. Non-positive or missing durations skip only the pace.
    """
    seconds = F.coalesce(seconds, F.lit(0.0))
    text = F.coalesce(text, F.lit(""))
    pace, share = chars_per_second(text, seconds), script_ratio(text)
    def fmt(tag, places, value):
        return F.concat(F.lit(tag + ":"), F.format_string(f"%.{places}f", value))
    out = F.when(F.length(stripped(text)) < FILTER.min_chars, "empty_text")
    for test, reason in (
        (cer > FILTER.max_cer, fmt("high_cer", 3, cer)),
        (share < FILTER.min_script, fmt("low_georgian", 2, share)),
        (pace < FILTER.min_cps, fmt("low_cps", 1, pace)),
        (pace > FILTER.max_cps, fmt("high_cps", 1, pace)),
        (compression > FILTER.max_compression, fmt("high_compression", 2, compression)),
        (repeated_chars(text, FILTER.repeated_chars), F.lit("repeated_chars")),
        (repeated_words(text, FILTER.repeated_words), F.lit("repeated_words")),
    ):
        out = out.when(test, reason)
    return out.otherwise(KEPT)


def with_chunk_reason(df: DataFrame, text: str, cer: str, seconds: str) -> DataFrame:
    """Adds reason and tag. The compression UDF sees only rows that pass the JVM-side tests before it."""
    c = lambda comp: chunk_reason(F.col(text), F.col(cer), F.col(seconds), comp)
    before = df.withColumn("_early", c(F.lit(0.0)))
    alive = F.col("_early").isin(KEPT, "repeated_chars", "repeated_words")
    done = before.where(~alive).withColumn("reason", F.col("_early"))
    late = before.where(alive).withColumn("_ratio", compression_ratio(F.coalesce(F.col(text), F.lit(""))))
    late = late.withColumn("reason", c(F.col("_ratio"))).drop("_ratio")
    return done.unionByName(late).drop("_early").withColumn("tag", F.split("reason", ":")[0])


def segment_reason(text: Column, seconds: Column) -> Column:
    """Second-generation filters; no error-rate test."""
    pace = chars_per_second(text, seconds)
    return cascade(
        (F.length(stripped(text)) < FILTER.v2_min_chars, "short_text"),
        (seconds < FILTER.v2_min_seconds, "short_duration"),
        (seconds > FILTER.v2_max_seconds, "long_duration"),
        (script_ratio(text) < FILTER.min_script, "low_georgian"),
        (pace < FILTER.min_cps, "low_cps"),
        (pace > FILTER.max_cps, "high_cps"),
    )


def book_edges(df: DataFrame, clip_id: str, book: str) -> DataFrame:
    """(book, first_seg, last_seg, segs) over all rows with a segment number; a null book counts as ''."""
    n = segment_number(F.col(clip_id))
    return (
        df.select(F.coalesce(book, F.lit("")).alias("book"), n.alias("n")).where("n >= 0")
        .groupBy("book").agg(F.min("n").alias("first_seg"), F.max("n").alias("last_seg"), F.count("*").alias("segs"))
    )


def prep_reason(text: Column, seconds: Column, seg: Column, first: Column, last: Column) -> Column:
    """Corpus preparation filters; the clips at a book's edges are intro and outro."""
    text, seconds = F.coalesce(text, F.lit("")), F.coalesce(seconds, F.lit(0.0))
    pace = F.when(text != "", chars_per_second(text, seconds))
    numbered = (seg >= 0) & first.isNotNull()
    return cascade(
        (seconds < PREP.min_seconds, "too_short"),
        (seconds > PREP.max_seconds, "too_long"),
        (pace < PREP.min_cps, "cps_low"),
        (pace > PREP.max_cps, "cps_high"),
        (F.length(stripped(text)) < PREP.min_text, "empty_text"),
        (numbered & (seg < first + PREP.clip_start), "intro_clip"),
        (numbered & (seg > last - PREP.clip_end), "outro_clip"),
    )


def with_prep_reason(df: DataFrame, clip_id: str, book: str, text: str, seconds: str) -> DataFrame:
    """Adds reason: book edges are aggregated and joined, so wide rows are never sorted."""
    edges = book_edges(df, clip_id, book).withColumnRenamed("book", "_book")
    j = df.withColumn("_book", F.coalesce(book, F.lit(""))).join(edges, "_book", "left")
    reason = prep_reason(F.col(text), F.col(seconds), segment_number(F.col(clip_id)), F.col("first_seg"), F.col("last_seg"))
    return j.withColumn("reason", reason).drop("_book", "first_seg", "last_seg", "segs")


def experiment_route(punctuated: Column, several: Column, speaker: Column, holdout: str, train_or_val: Column) -> Column:
    """not_punctuated, multi_speaker, holdout, or what ``train_or_val`` says."""
    return (
        F.when(~F.coalesce(punctuated, F.lit(False)), "not_punctuated")
        .when(F.coalesce(several, F.lit(False)) | F.coalesce(speaker.contains(","), F.lit(False)), "multi_speaker")
        .when(speaker == holdout, "holdout")
        .otherwise(train_or_val)
    )


def chunk_length_ok(seconds: Column) -> Column:
    return (seconds >= CHUNK.min_seconds) & (seconds <= CHUNK.max_seconds * CHUNK.slack)


def listed(df: DataFrame, path: str, listing: DataFrame, listed_path: str) -> DataFrame:
    """Rows whose file exists according to a listing."""
    return df.join(listing.select(F.col(listed_path).alias(path)).distinct(), path, "left_semi")


def pending(df: DataFrame, done: DataFrame, *keys: str) -> DataFrame:
    """Rows not yet done; rows with a null key are pending."""
    return df.join(done.select(*keys).distinct(), list(keys), "left_anti")


def enough_volume(df: DataFrame, key: str, amount: Column, least: float, most_keys: int | None = None) -> DataFrame:
    """Rows of keys whose summed amount reaches ``least``; with ``most_keys`` only the largest, ties by key."""
    total = df.groupBy(key).agg(F.sum(amount).alias("_amount")).where(F.col("_amount") >= least)
    if most_keys is not None:
        total = total.orderBy(F.desc("_amount"), key).limit(most_keys)
    return df.join(total.select(key), key, "left_semi")


def cluster_sizes(df: DataFrame, cluster: str, least: int) -> DataFrame:
    """Rows of clusters with at least ``least`` members."""
    big = df.groupBy(cluster).count().where(F.col("count") >= least)
    return df.join(big.select(cluster), cluster, "left_semi")


def mismatched_books(df: DataFrame, book: str, asr: str, cer: str, limit: float = FILTER.mismatch_cer) -> DataFrame:
    """(book, avg_cer, mismatch): mean error over rows with a transcript; no such row counts as 1.0."""
    mean = F.avg(F.when(F.col(asr) != "", F.col(cer)))
    return df.groupBy(book).agg(F.coalesce(mean, F.lit(1.0)).alias("avg_cer")).withColumn("mismatch", F.col("avg_cer") >= limit)


def without_book_text(df: DataFrame, book: str, asr: str, cer: str) -> DataFrame:
    """Falls back to the transcript in mismatched books: book_text '', cer 0, alignment_score 1."""
    j = df.join(mismatched_books(df, book, asr, cer), book, "left")
    m = F.coalesce("mismatch", F.lit(False))
    return j.withColumns({
        "punctuated_text": F.when(m, F.col(asr)).otherwise(F.col("punctuated_text")),
        "book_text": F.when(m, "").otherwise(F.col("book_text")),
        "cer": F.when(m, 0.0).otherwise(F.col(cer)),
        "alignment_score": F.when(m, 1.0).otherwise(F.col("alignment_score")),
    }).drop("avg_cer", "mismatch")



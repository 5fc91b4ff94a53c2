"""Queries on filters, joins, aggregates, windows, splits and sequential operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voxloom.config import CHUNK
from voxloom.functions import metrics as M
from voxloom.functions import text as T
from voxloom.functions.hashing import hash_split
from voxloom.operators import aggs, align, filters, folds, joins, splits, windows
from voxloom.plans import corpus, recordings, runner
from voxloom.plans import sqltext as Q
from voxloom.plans.base import chunks, clips, evals, segments
from voxloom.scorers import EchoTranscriber, score
from voxloom.storage import read, scratch

QUERIES: dict = {}
SQL: dict[str, str] = {}
HOLDOUT = "narr_0000007"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# filters


@query(f"""WITH {Q.CLIPS} SELECT CASE WHEN duration IS NULL OR isnan(duration) THEN 'dropped_error' WHEN duration < 0.5::DOUBLE THEN 'dropped_short'
WHEN duration > 30.0::DOUBLE THEN 'dropped_long' ELSE 'ok' END AS reason, count(*) AS n FROM clips GROUP BY 1""")
def flt1_standardize(spark: SparkSession, d: str) -> DataFrame:
    r = filters.standard_reason(F.col("duration")).alias("reason")
    return clips(spark, d, "id", "duration").groupBy(r).agg(F.count("*").alias("n"))


@query(f"""WITH {Q.SEGMENTS} SELECT segment_id FROM segs WHERE cer IS NOT NULL AND NOT isnan(cer) AND cer >= 0.02::DOUBLE""")
def flt2_score_threshold(spark: SparkSession, d: str) -> DataFrame:
    s = segments(spark, d, "segment_id", "cer")
    return s.where(F.col("cer").isNotNull() & ~F.isnan("cer") & (F.col("cer") >= 0.02)).select("segment_id")


@query(f"""WITH {Q.CLIPS}, v AS (SELECT id, duration / nullif(length(replace(text, ' ', '')), 0) AS x FROM clips),
q AS (SELECT quantile_cont(x, 0.25) AS a, quantile_cont(x, 0.75) AS b FROM v)
SELECT id, x AS char_duration FROM v, q WHERE x >= a - (b - a) * 1.5::DOUBLE AND x <= b + (b - a) * 1.5::DOUBLE""")
def flt3_duration_outlier(spark: SparkSession, d: str) -> DataFrame:
    v = clips(spark, d, "id", "text", "duration").withColumn("char_duration", filters.char_duration(F.col("text"), F.col("duration")))
    return filters.iqr_keep(v, "char_duration").select("id", "char_duration")


_R, _H = Q.collapsed("text"), Q.collapsed("asr_text")


@query(f"""WITH {Q.SEGMENTS}, b AS (SELECT *, {_R} AS r, {_H} AS h FROM segs WHERE text IS NOT NULL AND asr_text IS NOT NULL), {Q.edits('b', 'r', 'h')},
c AS (SELECT *, CASE WHEN len(ua) > 0 THEN d / len(ua)::DOUBLE WHEN len(ub) > 0 THEN 1.0 ELSE 0.0 END AS x FROM dist)
SELECT segment_id, round(x, 9) AS asr_cer FROM c WHERE x <= 0.2::DOUBLE""")
def flt4_transcript_verify(spark: SparkSession, d: str) -> DataFrame:
    return filters.verified(segments(spark, d), "text", "asr_text").select("segment_id", F.round("asr_cer", 9).alias("asr_cer"))


@query()
def flt6_chunk_cascade(spark: SparkSession, d: str) -> DataFrame:
    s = segments(spark, d, "segment_id", "asr_text", "cer", "duration_sec")
    return filters.with_chunk_reason(s, "asr_text", "cer", "duration_sec").select("segment_id", "reason", "tag")


_PACE = "(CASE WHEN duration_sec > 0 THEN length(asr_text) / duration_sec END)"


_V2 = f"""CASE WHEN length({Q.stripped('asr_text')}) < 10 THEN 'short_text' WHEN duration_sec < 3.0::DOUBLE THEN 'short_duration'
WHEN duration_sec > 27.5::DOUBLE THEN 'long_duration' WHEN {Q.ratio('asr_text')} < 0.8::DOUBLE THEN 'low_georgian'
WHEN {_PACE} < 3.0::DOUBLE THEN 'low_cps' WHEN {_PACE} > 25.0::DOUBLE THEN 'high_cps' ELSE 'ok' END"""


@query(f"WITH {Q.SEGMENTS} SELECT segment_id, {_V2} AS reason FROM segs")
def flt7_segment_cascade(spark: SparkSession, d: str) -> DataFrame:
    s = segments(spark, d, "segment_id", "asr_text", "duration_sec")
    return s.select("segment_id", filters.segment_reason(F.col("asr_text"), F.col("duration_sec")).alias("reason"))


_PREP = f"""{Q.CLIPS}, n AS (SELECT *, coalesce(book_title, '') AS book, {Q.seg_number('id')} AS seg, coalesce(text, '') AS t, coalesce(duration, 0.0) AS s FROM clips),
e AS (SELECT book, min(seg) AS first_seg, max(seg) AS last_seg, count(*) AS segs FROM n WHERE seg >= 0 GROUP BY book),
r AS (SELECT n.*, CASE WHEN s < 1.5::DOUBLE THEN 'too_short' WHEN s > 25.0::DOUBLE THEN 'too_long'
  WHEN t <> '' AND s > 0 AND length(t) / s < 5.0::DOUBLE THEN 'cps_low' WHEN t <> '' AND s > 0 AND length(t) / s > 25.0::DOUBLE THEN 'cps_high'
  WHEN length({Q.stripped('t')}) < 3 THEN 'empty_text' WHEN seg >= 0 AND seg < first_seg + 3 THEN 'intro_clip'
  WHEN seg >= 0 AND seg > last_seg - 3 THEN 'outro_clip' ELSE 'ok' END AS reason FROM n LEFT JOIN e USING (book))"""


@query(f"WITH {_PREP} SELECT id, reason, CASE WHEN reason = 'ok' THEN CASE WHEN coalesce(speaker_id, '') = '{HOLDOUT}' THEN 'eval' WHEN {Q.fraction('id')} < 0.02::DOUBLE THEN 'eval' ELSE 'train' END END AS split FROM r")
def flt8_prepare_corpus(spark: SparkSession, d: str) -> DataFrame:
    return corpus.prepare_corpus(clips(spark, d, "id", "text", "speaker_id", "duration", "book_title"), [HOLDOUT]).select("id", "reason", "split")


_INDEX = f"""i AS (SELECT speaker_id, count(*) AS n, CAST(row_number() OVER (ORDER BY count(*) DESC, speaker_id) + 4 AS INTEGER) AS idx FROM clips
  WHERE speaker_id IS NOT NULL AND NOT contains(speaker_id, ',') AND speaker_id <> '{HOLDOUT}' GROUP BY speaker_id)"""
_ROUTE = f"""CASE WHEN NOT coalesce(has_punctuation, false) THEN 'not_punctuated' WHEN coalesce(multi_speaker, false) OR coalesce(contains(speaker_id, ','), false) THEN 'multi_speaker'
WHEN speaker_id = '{HOLDOUT}' THEN 'holdout' WHEN {Q.fraction('id')} < 0.98::DOUBLE THEN 'train' ELSE 'val' END"""


@query(f"WITH {Q.CLIPS}, {_INDEX} SELECT id, {_ROUTE} AS route, coalesce(idx, -1) AS speaker_index FROM clips LEFT JOIN i USING (speaker_id)")
def flt9_experiment_routes(spark: SparkSession, d: str) -> DataFrame:
    return corpus.route_experiment(clips(spark, d, "id", "speaker_id", "has_punctuation", "multi_speaker"), HOLDOUT).select("id", "route", F.coalesce("speaker_index", F.lit(-1)).alias("speaker_index"))


@query(f"WITH {Q.SEGMENTS} SELECT segment_id FROM segs WHERE duration_sec >= 1.5::DOUBLE AND duration_sec <= 44.0::DOUBLE")
def flt10_chunk_length(spark: SparkSession, d: str) -> DataFrame:
    return segments(spark, d, "segment_id", "duration_sec").where(filters.chunk_length_ok(F.col("duration_sec"))).select("segment_id")


@query(f"""WITH {Q.CLIPS} SELECT id FROM clips WHERE regexp_replace(text, '[ ]+', '', 'g') <> '' AND speaker_id IN (SELECT speaker_id FROM eval_manifest)""")
def flt11_listed_and_filled(spark: SparkSession, d: str) -> DataFrame:
    have = read(spark, d, "eval_manifest").select(F.col("speaker_id").alias("listed"))
    rows = clips(spark, d, "id", "text", "speaker_id").where(F.trim("text") != "")
    return filters.listed(rows, "speaker_id", have, "listed").select("id")


@query(f"WITH {Q.CLIPS} SELECT id FROM clips WHERE speaker_id IS NULL OR speaker_id NOT IN (SELECT speaker_id FROM eval_manifest WHERE speaker_id IS NOT NULL)")
def flt13_pending(spark: SparkSession, d: str) -> DataFrame:
    return filters.pending(clips(spark, d, "id", "speaker_id"), read(spark, d, "eval_manifest"), "speaker_id").select("id")


@query(f"""WITH {Q.CLIPS}, v AS (SELECT speaker_id FROM clips WHERE duration > 1.0::DOUBLE GROUP BY speaker_id HAVING sum(CAST(duration AS DECIMAL(18,4))) >= 600)
SELECT id FROM clips WHERE duration > 1.0::DOUBLE AND speaker_id IN (SELECT speaker_id FROM v)""")
def flt15_enough_volume(spark: SparkSession, d: str) -> DataFrame:
    rows = clips(spark, d, "id", "speaker_id", "duration").where(F.col("duration") > 1.0)
    return filters.enough_volume(rows, "speaker_id", F.col("duration").cast("decimal(18,4)"), 600).select("id")


@query(f"""WITH {Q.CLIPS} SELECT id FROM clips WHERE duration >= 1.5::DOUBLE AND length(text) / nullif(duration, 0) BETWEEN 5.0::DOUBLE AND 20.0::DOUBLE
AND NOT regexp_matches(text, '[0-9]') AND NOT coalesce(multi_speaker, false)""")
def flt16_strict_clips(spark: SparkSession, d: str) -> DataFrame:
    pace = filters.chars_per_second(F.col("text"), F.col("duration"))
    ok = (F.col("duration") >= 1.5) & pace.between(5.0, 20.0) & ~F.col("text").rlike("[0-9]") & ~F.coalesce("multi_speaker", F.lit(False))
    return clips(spark, d, "id", "text", "duration", "multi_speaker").where(ok).select("id")


# joins and sets


@query("""SELECT t.book_title, t.n AS train_clips, e.n AS eval_clips FROM (SELECT book_title, count(DISTINCT id) AS n FROM train_manifest GROUP BY 1) t
JOIN (SELECT book_title, count(DISTINCT id) AS n FROM eval_manifest GROUP BY 1) e USING (book_title)""")
def jn1_books_of_both(spark: SparkSession, d: str) -> DataFrame:
    t = clips(spark, d, "id", "book_title").groupBy("book_title").agg(F.count("*").alias("train_clips"))
    e = evals(spark, d, "id", "book_title").groupBy("book_title").agg(F.count("*").alias("eval_clips"))
    return t.join(e, "book_title")


@query(f"""WITH {Q.SEGMENTS}, {Q.CHUNKS}, s AS (SELECT recording_id, sum(CAST(duration_sec AS DECIMAL(18,3))) AS x FROM segs GROUP BY 1)
SELECT chunk_id, CAST(coalesce(x, 0) AS DOUBLE) AS seconds FROM (SELECT chunk_id, split_part(chunk_id, '__chunk_', 1) AS recording_id FROM chunks) LEFT JOIN s USING (recording_id)""")
def jn2_duration_default(spark: SparkSession, d: str) -> DataFrame:
    s = segments(spark, d, "segment_id", "recording_id", "duration_sec").groupBy("recording_id").agg(F.sum(F.col("duration_sec").cast("decimal(18,3)")).cast("double").alias("seconds"))
    c = chunks(spark, d).select("chunk_id", F.substring_index("chunk_id", "__chunk_", 1).alias("recording_id"))
    return joins.left_default(c, s, "recording_id", {"seconds": 0.0}).select("chunk_id", "seconds")


@query(f"""WITH {Q.CLIPS}, f AS (SELECT speaker_id, arg_min(id, id) AS ref_id, arg_min(audio_path, id) AS ref_audio_path FROM (SELECT DISTINCT id, speaker_id, audio_path FROM eval_manifest) GROUP BY speaker_id)
SELECT id, ref_id, ref_audio_path FROM clips LEFT JOIN f USING (speaker_id)""")
def jn4_first_reference(spark: SparkSession, d: str) -> DataFrame:
    refs = evals(spark, d, "id", "speaker_id", "audio_path")
    return joins.first_reference(clips(spark, d, "id", "speaker_id"), refs, "speaker_id", "id").select("id", "ref_id", "ref_audio_path")


@query("""WITH a AS (SELECT DISTINCT speaker_id || '.pt' AS k, speaker_id FROM train_manifest WHERE speaker_id IS NOT NULL), b AS (SELECT speaker_id || '.pt' AS k, round(avg(duration), 6) AS x FROM (SELECT DISTINCT id, speaker_id, duration FROM eval_manifest) GROUP BY speaker_id)
SELECT speaker_id, coalesce(x, -1.0) AS similarity FROM a LEFT JOIN b USING (k)""")
def jn5_default_similarity(spark: SparkSession, d: str) -> DataFrame:
    a = clips(spark, d, "speaker_id").where("speaker_id IS NOT NULL").withColumn("k", F.concat("speaker_id", F.lit(".pt")))
    b = evals(spark, d, "id", "speaker_id", "duration").groupBy("speaker_id").agg(F.round(F.avg("duration"), 6).alias("similarity"))
    b = b.select(F.concat("speaker_id", F.lit(".pt")).alias("k"), "similarity")
    return joins.left_default(a, b, "k", {"similarity": -1.0}).select("speaker_id", "similarity")


@query("SELECT id FROM (SELECT DISTINCT id, speaker_id FROM train_manifest) WHERE speaker_id IN (SELECT speaker_id FROM eval_manifest GROUP BY 1 HAVING count(*) >= 3)")
def jn7_semi(spark: SparkSession, d: str) -> DataFrame:
    often = read(spark, d, "eval_manifest").groupBy("speaker_id").count().where("count >= 3")
    return clips(spark, d, "id", "speaker_id").join(often, "speaker_id", "left_semi").select("id")


@query(f"""WITH {Q.SEGMENTS}, k AS (SELECT segment_id FROM segs WHERE {_V2} = 'ok')
SELECT segment_id, duration_sec FROM segs WHERE segment_id NOT IN (SELECT segment_id FROM k)""")
def jn8_dropped_rows(spark: SparkSession, d: str) -> DataFrame:
    s = segments(spark, d, "segment_id", "asr_text", "duration_sec")
    kept = s.where(filters.segment_reason(F.col("asr_text"), F.col("duration_sec")) == filters.KEPT)
    return filters.pending(s, kept, "segment_id").select("segment_id", "duration_sec")


@query(f"""WITH i AS (SELECT DISTINCT id, speaker_id FROM train_manifest WHERE speaker_id <> ''),
r AS (SELECT *, row_number() OVER (PARTITION BY speaker_id ORDER BY {Q.drawn('id', 42)}, id) - 1 AS r, count(*) OVER (PARTITION BY speaker_id) AS n FROM i)
SELECT a.id, a.speaker_id, b.id AS context_id FROM r a JOIN r b ON a.speaker_id = b.speaker_id AND b.r = (a.r + 1 + {Q.drawn('a.id', 43)} % (a.n - 1)) % a.n WHERE a.n > 1""")
def jn10_context_pairs(spark: SparkSession, d: str) -> DataFrame:
    rows = clips(spark, d, "id", "speaker_id").where("speaker_id <> ''")
    return splits.context_pairs(rows, "id", "speaker_id")


@query("SELECT split, container, r_name FROM split_target, container_spec, region")
def jn11_grid(spark: SparkSession, d: str) -> DataFrame:
    a, b, c = (read(spark, d, t) for t in ("split_target", "container_spec", "region"))
    return a.select("split").crossJoin(b.select("container")).crossJoin(c.select("r_name"))


@query("""WITH t AS (SELECT DISTINCT recording_id FROM word_timing), f AS (SELECT DISTINCT segment_id FROM segment)
SELECT recording_id, min(segment_id) AS segment_id FROM t LEFT JOIN f ON starts_with(segment_id, recording_id || '_') GROUP BY recording_id""")
def jn12_prefix_join(spark: SparkSession, d: str) -> DataFrame:
    t = read(spark, d, "word_timing").select("recording_id")
    return joins.prefix_matches(t, "recording_id", segments(spark, d, "segment_id"), "segment_id")


@query("""WITH n AS (SELECT DISTINCT CASE WHEN length(book_title) % 2 = 0 THEN book_title ELSE split_part(book_title, ' ', 2) END AS name FROM eval_manifest WHERE book_title IS NOT NULL),
b AS (SELECT DISTINCT book_title AS title FROM train_manifest WHERE book_title IS NOT NULL),
j AS (SELECT name, title, CASE WHEN name = title THEN 0 ELSE 1 END AS p FROM n LEFT JOIN b ON contains(title, name))
SELECT name, coalesce(arg_min(title, (p, title)), '') AS title FROM j GROUP BY name""")
def jn13_title_lookup(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("book_title")
    names = evals(spark, d, "book_title").where(t.isNotNull())
    names = names.select(F.when(F.length(t) % 2 == 0, t).otherwise(F.coalesce(F.try_element_at(F.split(t, " "), F.lit(2)), F.lit(""))).alias("name"))
    books = clips(spark, d, "book_title").where(t.isNotNull()).select(t.alias("title"), t.alias("o"))
    return joins.title_lookup(names, "name", books, "title", "o")


@query("""SELECT DISTINCT split_part(x, '/', -1) AS name FROM (SELECT audio_path AS x FROM train_manifest UNION ALL SELECT audio_path FROM eval_manifest)""")
def set3_distinct_files(spark: SparkSession, d: str) -> DataFrame:
    both = clips(spark, d, "audio_path").unionByName(evals(spark, d, "audio_path"))
    return both.select(T.base_name(F.col("audio_path")).alias("name")).distinct()


# aggregates


@query(f"""WITH {Q.CLIPS} SELECT speaker_id, CAST(grouping(speaker_id) AS INTEGER) AS is_total, count(*) AS clips,
round(CAST(coalesce(sum(CAST(duration AS DECIMAL(18,4))), 0) AS DOUBLE) / 3600, 6) AS hours FROM clips GROUP BY ROLLUP (speaker_id)""")
def agg1_speaker_volume(spark: SparkSession, d: str) -> DataFrame:
    return aggs.volume(clips(spark, d, "id", "speaker_id", "duration"), "speaker_id", "duration")


@query(f"""WITH {Q.CLIPS} SELECT speaker_id, count(*) AS clips, round(CAST(coalesce(sum(CAST(duration AS DECIMAL(18,4))), 0) AS DOUBLE) / 3600, 6) AS hours
FROM clips WHERE coalesce(has_punctuation, false) GROUP BY speaker_id""")
def agg2_punctuated_volume(spark: SparkSession, d: str) -> DataFrame:
    rows = clips(spark, d, "id", "speaker_id", "duration", "has_punctuation").where(F.coalesce("has_punctuation", F.lit(False)))
    return aggs.volume(rows, "speaker_id", "duration", total=False)


@query(f"""WITH {Q.SEGMENTS} SELECT speaker_id, count(*) AS n, round(avg(coalesce(cer, 0.0)), 9) AS mean_cer, round(avg(coalesce(duration_sec, 0.0)), 9) AS mean_seconds FROM segs GROUP BY speaker_id""")
def agg3_missing_as_zero(spark: SparkSession, d: str) -> DataFrame:
    s, z = segments(spark, d, "segment_id", "speaker_id", "cer", "duration_sec"), F.lit(0.0)
    return s.groupBy("speaker_id").agg(
        F.count("*").alias("n"), F.round(F.avg(F.coalesce("cer", z)), 9).alias("mean_cer"), F.round(F.avg(F.coalesce("duration_sec", z)), 9).alias("mean_seconds")
    )


@query(f"WITH {_PREP} SELECT * FROM e")
def agg5_book_edges(spark: SparkSession, d: str) -> DataFrame:
    return filters.book_edges(clips(spark, d, "id", "book_title"), "id", "book_title")


@query(f"WITH {Q.SEGMENTS} SELECT {_V2} AS tag, count(*) AS n FROM segs GROUP BY 1")
def agg6_reason_counts(spark: SparkSession, d: str) -> DataFrame:
    s = segments(spark, d, "segment_id", "asr_text", "duration_sec").withColumn("reason", filters.segment_reason(F.col("asr_text"), F.col("duration_sec")))
    return aggs.reason_counts(s, "reason")


@query(f"""WITH {Q.CLIPS} SELECT count(*) FILTER (r = 'train') AS train, count(*) FILTER (r = 'val') AS val, count(*) FILTER (r = 'holdout') AS holdout,
count(*) FILTER (r = 'not_punctuated') AS not_punctuated, count(*) FILTER (r = 'multi_speaker') AS multi_speaker FROM (SELECT {_ROUTE} AS r FROM clips)""")
def agg7_route_counts(spark: SparkSession, d: str) -> DataFrame:
    routes = ["train", "val", "holdout", "not_punctuated", "multi_speaker"]
    r = corpus.route_experiment(clips(spark, d, "id", "speaker_id", "has_punctuation", "multi_speaker"), HOLDOUT)
    wide = r.groupBy().pivot("route", routes).agg(F.count("id"))
    return wide.select(*[F.coalesce(c, F.lit(0)).alias(c) for c in routes])


@query(f"""WITH {Q.SEGMENTS} SELECT round(coalesce(avg(cer), 0.0), 9) AS mean_cer, coalesce(list_sort(list(cer) FILTER (cer IS NOT NULL))[count(cer) // 2 + 1], 0.0) AS median_cer FROM segs""")
def agg8_mean_and_upper_median(spark: SparkSession, d: str) -> DataFrame:
    out = aggs.mean_and_middle(segments(spark, d, "segment_id", "cer"), "cer")
    return out.select(F.round("mean_cer", 9).alias("mean_cer"), "median_cer")


_SUMMARY = """round(avg({x}), 9) AS mean, quantile_cont({x}, 0.5) AS median, round(stddev_pop({x}), 9) AS std, round(quantile_cont({x}, 0.9), 9) AS p90, min({x}) AS min, max({x}) AS max, count({x}) AS n"""


def _rounded(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys, F.round("mean", 9).alias("mean"), "median", F.round("std", 9).alias("std"), F.round("p90", 9).alias("p90"), "min", "max", "n")


@query(f"WITH {Q.SEGMENTS} SELECT {_SUMMARY.format(x='cer')} FROM segs")
def agg10_overall_summary(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(aggs.metric_summary(segments(spark, d, "segment_id", "cer"), "cer"))


@query(f"WITH {Q.SEGMENTS} SELECT speaker_id, {_SUMMARY.format(x='cer')} FROM segs GROUP BY speaker_id")
def agg11_speaker_summary(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(aggs.metric_summary(segments(spark, d, "segment_id", "speaker_id", "cer"), "cer", "speaker_id"), "speaker_id")


_BINS = " UNION ALL ".join(
    f"SELECT {i} AS bin, {lo}::DOUBLE AS lo, {hi}::DOUBLE AS hi, count(*) FILTER (cer >= {lo}::DOUBLE AND cer < {hi}::DOUBLE) AS n, round(count(*) FILTER (cer >= {lo}::DOUBLE AND cer < {hi}::DOUBLE) * 100.0::DOUBLE / count(*), 6) AS pct FROM segs"
    for i, (lo, hi) in enumerate(aggs.CER_EDGES)
)


@query(f"WITH {Q.SEGMENTS} {_BINS}")
def agg13_histogram(spark: SparkSession, d: str) -> DataFrame:
    return aggs.histogram(segments(spark, d, "segment_id", "cer"), "cer")


@query(f"""WITH {Q.SEGMENTS}, v AS (SELECT recording_id, duration_sec AS s, CASE WHEN {_V2} = 'ok' THEN duration_sec END AS k, {_V2} = 'ok' AS kept FROM segs)
SELECT recording_id, count(*) AS total, count(*) FILTER (kept) AS kept, count(*) FILTER (kept) / count(*) AS pass_rate, coalesce(round(sum(k), 4), 0) AS kept_seconds,
coalesce(round(sum(k) * 100 / nullif(sum(s), 0), 6), 0) AS yield_pct, coalesce(min(k), 0) AS min_seconds, coalesce(max(k), 0) AS max_seconds,
coalesce(round(avg(k), 6), 0) AS mean_seconds, coalesce(quantile_cont(k, 0.5), 0) AS median_seconds FROM v GROUP BY recording_id""")
def agg15_recording_yield(spark: SparkSession, d: str) -> DataFrame:
    kept = filters.segment_reason(F.col("asr_text"), F.col("duration_sec")) == filters.KEPT
    return aggs.yield_report(segments(spark, d, "segment_id", "recording_id", "asr_text", "duration_sec"), "recording_id", kept, "duration_sec")


_MISMATCH = f"""{Q.CHUNKS}, c AS (SELECT *, split_part(chunk_id, '__chunk_', 1) AS recording_id FROM chunks),
m AS (SELECT recording_id, coalesce(avg(cer) FILTER (asr_text <> ''), 1.0) AS avg_cer FROM c GROUP BY 1)"""


@query(f"WITH {_MISMATCH} SELECT recording_id, round(avg_cer, 9) AS avg_cer, avg_cer >= 0.4::DOUBLE AS mismatch FROM m")
def agg17_mismatched_books(spark: SparkSession, d: str) -> DataFrame:
    c = chunks(spark, d).withColumn("recording_id", F.substring_index("chunk_id", "__chunk_", 1))
    return filters.mismatched_books(c, "recording_id", "asr_text", "cer").select("recording_id", F.round("avg_cer", 9).alias("avg_cer"), "mismatch")


@query("SELECT count(DISTINCT speaker_id) AS speakers, count(DISTINCT audio_path) AS files FROM train_manifest")
def agg18_distinct(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "train_manifest").agg(F.countDistinct("speaker_id").alias("speakers"), F.countDistinct("audio_path").alias("files"))


@query(f"""WITH {Q.SEGMENTS} SELECT recording_id, speaker_id, round(coalesce(avg(cer), -1.0), 9) AS mean_cer FROM segs GROUP BY ALL""")
def agg19_default_metric(spark: SparkSession, d: str) -> DataFrame:
    s = segments(spark, d, "segment_id", "recording_id", "speaker_id", "cer")
    return s.groupBy("recording_id", "speaker_id").agg(F.round(F.coalesce(F.avg("cer"), F.lit(-1.0)), 9).alias("mean_cer"))


@query("SELECT vec_id, label FROM embeddings WHERE label IN (SELECT label FROM embeddings GROUP BY label HAVING count(*) >= 50)")
def agg20_large_clusters(spark: SparkSession, d: str) -> DataFrame:
    return filters.cluster_sizes(read(spark, d, "embeddings").select("vec_id", "label"), "label", 50)


# windows and order


@query(f"WITH {Q.CLIPS}, {_INDEX} SELECT speaker_id, n, idx AS index FROM i")
def win2_speaker_index(spark: SparkSession, d: str) -> DataFrame:
    return corpus.speaker_index(clips(spark, d, "id", "speaker_id"), HOLDOUT)


_HOURS = "sum(CAST(coalesce(duration, 0) AS DECIMAL(18,4)))"


@query(f"WITH {Q.CLIPS} SELECT speaker_id, CAST({_HOURS} AS DOUBLE) AS seconds FROM clips WHERE speaker_id IS NOT NULL GROUP BY speaker_id ORDER BY {_HOURS}, speaker_id LIMIT 5")
def win3_smallest_speakers(spark: SparkSession, d: str) -> DataFrame:
    rows = clips(spark, d, "id", "speaker_id", "duration").where("speaker_id IS NOT NULL")
    total = F.sum(F.coalesce("duration", F.lit(0.0)).cast("decimal(18,4)"))
    return windows.top_keys(rows, "speaker_id", total, 5, largest=False).select("speaker_id", F.col("amount").cast("double").alias("seconds"))


@query(f"WITH {Q.CLIPS} SELECT speaker_id, CAST({_HOURS} AS DOUBLE) AS seconds FROM clips WHERE speaker_id IS NOT NULL GROUP BY speaker_id ORDER BY {_HOURS} DESC, speaker_id LIMIT 50")
def win5_largest_speakers(spark: SparkSession, d: str) -> DataFrame:
    rows = clips(spark, d, "id", "speaker_id", "duration").where("speaker_id IS NOT NULL")
    total = F.sum(F.coalesce("duration", F.lit(0.0)).cast("decimal(18,4)"))
    return windows.top_keys(rows, "speaker_id", total, 50).select("speaker_id", F.col("amount").cast("double").alias("seconds"))


@query(f"""WITH {Q.SEGMENTS}, r AS (SELECT speaker_id, segment_id, coalesce(cer, 0.0) AS cer, row_number() OVER (PARTITION BY speaker_id ORDER BY coalesce(cer, 0.0) DESC, segment_id) AS k FROM segs)
SELECT speaker_id, segment_id, cer FROM r WHERE k = 1""")
def win6_best_per_speaker(spark: SparkSession, d: str) -> DataFrame:
    s = segments(spark, d, "segment_id", "speaker_id", "cer").withColumn("cer", F.coalesce("cer", F.lit(0.0)))
    return windows.best_per_key(s, "speaker_id", -F.col("cer"), F.col("segment_id")).select("speaker_id", "segment_id", "cer")


@query(f"""WITH {Q.SEGMENTS}, s AS (SELECT * FROM segs WHERE cer IS NOT NULL AND speaker_id IS NOT NULL), b AS (SELECT recording_id, avg(cer) AS m FROM s GROUP BY 1 ORDER BY round(m, 9), 1 LIMIT 1)
SELECT recording_id, round(m, 9) AS run_mean, speaker_id, round(avg(cer), 9) AS speaker_mean FROM s JOIN b USING (recording_id) GROUP BY recording_id, m, speaker_id ORDER BY round(avg(cer), 9), speaker_id LIMIT 1""")
def win7_best_run(spark: SparkSession, d: str) -> DataFrame:
    s = segments(spark, d, "segment_id", "recording_id", "speaker_id", "cer").where("cer IS NOT NULL AND speaker_id IS NOT NULL")
    best = corpus.best_run(s, "recording_id", "speaker_id", "cer")
    return best.withColumns({c: F.round(c, 9) for c in ("run_mean", "speaker_mean")})


@query(f"""WITH {Q.SEGMENTS}, m AS (SELECT recording_id, speaker_id, round(avg(cer), 9) AS x FROM segs WHERE cer IS NOT NULL AND speaker_id IS NOT NULL GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY x, speaker_id) AS k FROM m) SELECT recording_id, speaker_id, x AS mean_cer FROM r WHERE k = 1""")
def win8_best_speaker_per_run(spark: SparkSession, d: str) -> DataFrame:
    s = segments(spark, d, "segment_id", "recording_id", "speaker_id", "cer").where("cer IS NOT NULL AND speaker_id IS NOT NULL")
    m = s.groupBy("recording_id", "speaker_id").agg(F.round(F.avg("cer"), 9).alias("mean_cer"))
    return windows.best_per_key(m, "recording_id", F.col("mean_cer"), F.col("speaker_id"))


_SPANS = f"""{Q.SEGMENTS}, v AS (SELECT DISTINCT recording_id, start_sec AS s, end_sec AS e, segment_id FROM segs WHERE start_sec IS NOT NULL AND end_sec > start_sec AND recording_id IS NOT NULL)"""


@query(f"""WITH {_SPANS}, g AS (SELECT *, CASE WHEN s - lag(e) OVER w < 0.3::DOUBLE THEN 0 ELSE 1 END AS o FROM v WINDOW w AS (PARTITION BY recording_id ORDER BY s, e, segment_id)),
i AS (SELECT *, sum(o) OVER (PARTITION BY recording_id ORDER BY s, e, segment_id ROWS UNBOUNDED PRECEDING) - 1 AS island, row_number() OVER (PARTITION BY recording_id ORDER BY s, e, segment_id) AS k FROM g)
SELECT recording_id, CAST(island AS BIGINT) AS island, arg_min(s, k) AS start_sec, arg_max(e, k) AS end_sec, count(*) AS parts FROM i GROUP BY recording_id, island""")
def win11_gap_merge(spark: SparkSession, d: str) -> DataFrame:
    v = segments(spark, d, "recording_id", "start_sec", "end_sec", "segment_id").where("recording_id IS NOT NULL AND start_sec IS NOT NULL AND end_sec > start_sec")
    return windows.gap_merge(v, "recording_id", ["start_sec", "end_sec", "segment_id"], "start_sec", "end_sec", CHUNK.merge_gap)


@query()
def win12_recogniser_chunks(spark: SparkSession, d: str) -> DataFrame:
    v = segments(spark, d, "recording_id", "start_sec", "end_sec").where("end_sec > start_sec")
    return corpus.chunk_recordings(v, "recording_id")


@query(f"""WITH {_SPANS}, p AS (SELECT segment_id, s, e, unnest(range(0, greatest(CAST(ceil((e - s) / 5.0::DOUBLE) AS INTEGER), 1))) AS part FROM v)
SELECT segment_id, CAST(part AS INTEGER) AS part, round(s + part * 5.0::DOUBLE, 6) AS start_sec, round(least(s + (part + 1) * 5.0::DOUBLE, e), 6) AS end_sec FROM p""")
def win14_fixed_windows(spark: SparkSession, d: str) -> DataFrame:
    v = segments(spark, d, "recording_id", "segment_id", "start_sec", "end_sec").where("recording_id IS NOT NULL AND end_sec > start_sec")
    w = windows.fixed_windows(v, "start_sec", "end_sec", 5.0)
    return w.select("segment_id", "part", F.round("start_sec", 6).alias("start_sec"), F.round("end_sec", 6).alias("end_sec"))


@query()
def win16_sentence_segments(spark: SparkSession, d: str) -> DataFrame:
    return corpus.segment_recordings(read(spark, d, "word_timing"))


@query("SELECT doc_id, CAST((row_number() OVER (ORDER BY -length(text) NULLS FIRST, doc_id) - 1) % 4 AS INTEGER) AS shard FROM documents")
def win17_round_robin(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents").select("doc_id", (-F.length("text")).alias("size"))
    return windows.round_robin(docs, ["size", "doc_id"], 4).select("doc_id", "shard")


@query(f"""WITH {Q.SEGMENTS}, r AS (SELECT speaker_id, segment_id, row_number() OVER (PARTITION BY speaker_id ORDER BY -coalesce(cer, 0.0), segment_id) AS k FROM segs)
SELECT speaker_id, segment_id, k - 1 AS rank FROM r WHERE k <= 10""")
def win18_top_ten_per_speaker(spark: SparkSession, d: str) -> DataFrame:
    s = segments(spark, d, "segment_id", "speaker_id", "cer").select("speaker_id", "segment_id", (-F.coalesce("cer", F.lit(0.0))).alias("x"))
    best = Window.partitionBy("speaker_id").orderBy("x", "segment_id")  # every task keeps ten per speaker before the shuffle
    return s.withColumn("rank", F.row_number().over(best).cast("long") - 1).where("rank < 10").select("speaker_id", "segment_id", "rank")


# splits


@query(f"WITH {Q.CLIPS} SELECT id, CASE WHEN {Q.fraction('id')} < 0.02::DOUBLE THEN 'eval' ELSE 'train' END AS a, CASE WHEN {Q.fraction('id')} < 0.98::DOUBLE THEN 'train' ELSE 'val' END AS b FROM clips")
def spl1_hash_splits(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("id")
    return clips(spark, d, "id").select("id", hash_split(i, 0.02, "eval", "train").alias("a"), hash_split(i, 0.98, "train", "val").alias("b"))


@query(f"""WITH i AS (SELECT DISTINCT id FROM train_manifest), n AS (SELECT *, row_number() OVER (ORDER BY {Q.drawn('id', 42)}, id) - 1 AS k, count(*) OVER () AS total FROM i)
SELECT id, CASE WHEN k < greatest(total // 20, 1) THEN 'eval' ELSE 'train' END AS split FROM n""")
def spl5_seeded_share(spark: SparkSession, d: str) -> DataFrame:
    return splits.seeded_share(clips(spark, d, "id"), "id")


@query(f"SELECT DISTINCT id, text FROM eval_manifest ORDER BY {Q.drawn('id', 42)}, id LIMIT 8")
def spl7_seeded_draw(spark: SparkSession, d: str) -> DataFrame:
    return splits.seeded_draw(evals(spark, d, "id", "text"), "id", 8)


# sequential operators


def _books(spark: SparkSession, d: str) -> DataFrame:
    """A reference text per recording: the distinct book passages of its chunks, in order."""
    c = chunks(spark, d).where("book_text <> ''").select(F.substring_index("chunk_id", "__chunk_", 1).alias("recording_id"), "chunk_id", "book_text")
    ordered = F.array_sort(F.collect_set(F.struct("chunk_id", "book_text")))
    return c.groupBy("recording_id").agg(F.concat_ws("\n", F.transform(ordered, lambda x: x["book_text"])).alias("text"))


@query()
def op_align_chunks(spark: SparkSession, d: str) -> DataFrame:
    c = chunks(spark, d).select(F.substring_index("chunk_id", "__chunk_", 1).alias("recording_id"), "chunk_id", F.col("asr_text").alias("text")).distinct()
    return align.align_chunks(c, _books(spark, d))


@query()
def op_align_segments(spark: SparkSession, d: str) -> DataFrame:
    s = segments(spark, d, "recording_id", "segment_id", "asr_text").withColumnRenamed("asr_text", "text")
    return align.align_segments(s, _books(spark, d))


@query(f"""WITH {_MISMATCH} SELECT chunk_id, CASE WHEN avg_cer >= 0.4::DOUBLE THEN asr_text ELSE punctuated_text END AS punctuated_text, CASE WHEN avg_cer >= 0.4::DOUBLE THEN '' ELSE book_text END AS book_text,
CASE WHEN avg_cer >= 0.4::DOUBLE THEN 0.0 ELSE cer END AS cer, CASE WHEN avg_cer >= 0.4::DOUBLE THEN 1.0 ELSE alignment_score END AS alignment_score FROM c LEFT JOIN m USING (recording_id)""")
def op_mismatch_fallback(spark: SparkSession, d: str) -> DataFrame:
    c = chunks(spark, d).withColumn("recording_id", F.substring_index("chunk_id", "__chunk_", 1))
    return filters.without_book_text(c, "recording_id", "asr_text", "cer").select("chunk_id", "punctuated_text", "book_text", "cer", "alignment_score")


_FRAMES = """f AS (SELECT DISTINCT recording_id, chunk_idx, ordinal AS frame, length(word) % 3 AS token FROM word_timing WHERE recording_id IS NOT NULL AND chunk_idx IS NOT NULL AND ordinal IS NOT NULL AND word IS NOT NULL),
u AS (SELECT recording_id, chunk_idx, frame, min(token) AS token FROM f GROUP BY ALL)"""


@query(f"""WITH {_FRAMES}, g AS (SELECT *, CASE WHEN token = lag(token) OVER w THEN 0 ELSE 1 END AS o FROM u WINDOW w AS (PARTITION BY recording_id, chunk_idx ORDER BY frame)),
r AS (SELECT *, sum(o) OVER (PARTITION BY recording_id, chunk_idx ORDER BY frame ROWS UNBOUNDED PRECEDING) AS run FROM g),
s AS (SELECT recording_id, chunk_idx, run, min(token) AS token, min(frame) AS first, max(frame) + 1 AS past FROM r GROUP BY ALL)
SELECT recording_id, chunk_idx, token, first, past, CAST(row_number() OVER (PARTITION BY recording_id, chunk_idx ORDER BY run) - 1 AS INTEGER) AS span FROM s WHERE token <> 0""")
def op_token_spans(spark: SparkSession, d: str) -> DataFrame:
    w = read(spark, d, "word_timing").dropna(subset=["recording_id", "chunk_idx", "ordinal", "word"])
    f = w.groupBy("recording_id", "chunk_idx", F.col("ordinal").alias("frame")).agg(F.min(F.length("word") % 3).alias("token"))
    return folds.token_spans(f, ["recording_id", "chunk_idx"])


@query("""WITH e AS (SELECT label, embedding::DOUBLE[] AS v FROM embeddings), n AS (SELECT label, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) AS u FROM e),
p AS (SELECT a.label = b.label AS same, list_dot_product(a.u, b.u) AS s, count(*) OVER () AS k FROM (SELECT *, row_number() OVER () AS i FROM n) a JOIN (SELECT *, row_number() OVER () AS i FROM n) b ON a.i <> b.i)
SELECT same, count(*) AS pairs, round(avg(s), 6) AS mean_similarity FROM p GROUP BY same""")
def pro8_within_between_similarity(spark: SparkSession, d: str) -> DataFrame:
    """Mean cosine of pairs within and between labels, from sums of unit vectors: no pair is formed."""
    e = read(spark, d, "embeddings").select("label", F.col("embedding").cast("array<double>").alias("v"))
    norm = F.sqrt(M.dot(F.col("v"), F.col("v")))
    cells = e.withColumn("norm", norm).select("label", F.posexplode("v").alias("i", "x"), "norm").withColumn("u", F.col("x") / F.col("norm"))
    sums = cells.groupBy("label", "i").agg(F.sum("u").alias("s"))
    inside = sums.groupBy("label").agg(F.sum(F.col("s") * F.col("s")).alias("q")).join(e.groupBy("label").agg(F.count("*").alias("n")), "label")
    inside = inside.agg(F.sum("n").alias("n"), F.sum(F.col("q") - F.col("n")).alias("q"), F.sum(F.col("n") * (F.col("n") - 1)).alias("p"))
    every = sums.groupBy("i").agg(F.sum("s").alias("s")).agg(F.sum(F.col("s") * F.col("s")).alias("a"))
    one = inside.crossJoin(every)
    others, whole = F.col("n") * (F.col("n") - 1) - F.col("p"), F.col("a") - F.col("n") - F.col("q")
    rows = F.array(
        F.struct(F.lit(True).alias("same"), F.col("p").alias("pairs"), F.round(F.col("q") / F.col("p"), 6).alias("mean_similarity")),
        F.struct(F.lit(False).alias("same"), others.alias("pairs"), F.round(whole / others, 6).alias("mean_similarity")),
    )
    return one.select(F.explode(rows).alias("r")).select("r.*")


@query(f"""WITH {Q.SEGMENTS}, b AS (SELECT *, {Q.norm('text')} AS r, {Q.norm('asr_text')} AS h FROM segs WHERE text IS NOT NULL AND asr_text IS NOT NULL), {Q.edits('b', 'r', 'h')}
SELECT sum(d)::DOUBLE / sum(len(ua)) AS rate FROM dist""")
def pro7_pooled_error_rate(spark: SparkSession, d: str) -> DataFrame:
    s = segments(spark, d, "segment_id", "text", "asr_text").where("text IS NOT NULL AND asr_text IS NOT NULL")
    r, h = T.norm_eval(F.col("text")), T.norm_eval(F.col("asr_text"))
    return aggs.pooled_rate(s.select(F.levenshtein(r, h).alias("d"), F.length(r).alias("n")), "d", "n")


# orchestration


_QUALITY = f"""{Q.CLIPS}, a AS (SELECT *, duration / nullif(length(replace(text, ' ', '')), 0) AS x FROM clips WHERE duration >= 0.5::DOUBLE AND duration <= 30.0::DOUBLE),
q AS (SELECT quantile_cont(x, 0.25) AS lo, quantile_cont(x, 0.75) AS hi FROM a),
b AS (SELECT a.* FROM a, q WHERE x >= lo - (hi - lo) * 1.5::DOUBLE AND x <= hi + (hi - lo) * 1.5::DOUBLE),
k AS (SELECT speaker_id FROM b WHERE speaker_id IS NOT NULL GROUP BY 1 HAVING sum(duration) >= 1400 ORDER BY sum(duration) DESC, 1 LIMIT 50),
c AS (SELECT * FROM b WHERE speaker_id IN (SELECT speaker_id FROM k)), n AS (SELECT (SELECT count(*) FROM clips) AS n0, (SELECT count(*) FROM a) AS n1, (SELECT count(*) FROM b) AS n2, (SELECT count(*) FROM c) AS n3)"""


@query(f"""WITH {_QUALITY} SELECT 1 AS stage_no, 'standardize' AS stage, n1 AS kept, n0 - n1 AS dropped FROM n UNION ALL
SELECT 2, 'duration_outlier', n2, n1 - n2 FROM n UNION ALL SELECT 3, 'speaker_select', n3, n2 - n3 FROM n""")
def orc1_quality_run(spark: SparkSession, d: str) -> DataFrame:
    import uuid

    names = ("standardize", "duration_outlier", "speaker_select")
    out = scratch(spark, f"quality-{uuid.uuid4().hex}")
    runner.run_quality(clips(spark, d, "id", "text", "speaker_id", "duration"), out, names)
    return runner.stage_counts(spark, out, names).drop("kept_pct")


def _intervals(spark: SparkSession, d: str) -> DataFrame:
    return segments(spark, d, "segment_id", "recording_id", "start_sec", "end_sec").where("recording_id IS NOT NULL AND end_sec > start_sec")


@query()
def orc3_recordings(spark: SparkSession, d: str) -> DataFrame:
    """Speech intervals to a manifest: chunks, transcripts, alignment, mismatch fallback, filters."""
    spoken = chunks(spark, d).select("chunk_id", F.col("asr_text").alias("text")).groupBy("chunk_id").agg(F.max("text").alias("text"))
    judged = recordings.first_generation(_intervals(spark, d), spoken, _books(spark, d))
    return recordings.clip_manifest(judged, "chunk_id", T.narrator(F.col("recording_id")), measures=True)


@query()
def orc4_recordings(spark: SparkSession, d: str) -> DataFrame:
    """Word timings to yields: sentence segments, alignment, filters."""
    words = read(spark, d, "word_timing")
    return recordings.recording_yield(recordings.second_generation(words, _books(spark, d)))


@query(f"""WITH {Q.SEGMENTS} SELECT segment_id AS id, 'wavs/' || segment_id || '.wav' AS audio_filepath, text, asr_text, book_text, speaker_id, duration_sec AS duration, cer FROM segs WHERE {_V2.replace('asr_text', 'text')} = 'ok'""")
def prj7_clip_manifest(spark: SparkSession, d: str) -> DataFrame:
    s = segments(spark, d, "segment_id", "text", "asr_text", "book_text", "speaker_id", "duration_sec", "cer")
    judged = s.withColumn("reason", filters.segment_reason(F.col("text"), F.col("duration_sec")))
    return recordings.clip_manifest(judged, "segment_id", F.col("speaker_id"))


@query(f"""WITH {Q.SEGMENTS} SELECT 'cer' AS metric, {_SUMMARY.format(x='cer')}, CAST(NULL AS VARCHAR) AS error FROM segs
UNION ALL SELECT 'mcd', NULL, NULL, NULL, NULL, NULL, NULL, 0, 'no column mcd'""")
def orc6_evaluation(spark: SparkSession, d: str) -> DataFrame:
    out = corpus.run_evaluation(segments(spark, d, "segment_id", "cer"), {"cer": "cer", "mcd": "mcd"})
    return _rounded(out, "metric", "error")


@query(f"""WITH {Q.EVALS} SELECT DISTINCT id, text, array_to_string(list_filter(string_split({Q.stripped(Q.collapsed("coalesce(text, '')"))}, ' '), lambda w, i: i % 7 <> 0), ' ') AS asr_text, CAST(NULL AS VARCHAR) AS error FROM evals""")
def ml4_transcribe_seam(spark: SparkSession, d: str) -> DataFrame:
    return score(evals(spark, d, "id", "text"), EchoTranscriber, EchoTranscriber.schema)


@query(f"""WITH {Q.CLIPS} SELECT cast(to_json(list({{'speaker_id': speaker_id, 'n': n}} ORDER BY speaker_id)) AS VARCHAR) AS value FROM (SELECT speaker_id, count(*) AS n FROM clips WHERE speaker_id IS NOT NULL GROUP BY 1)""")
def snk2_json_array(spark: SparkSession, d: str) -> DataFrame:
    from voxloom.sources.sinks import json_array

    per = clips(spark, d, "id", "speaker_id").where("speaker_id IS NOT NULL").groupBy("speaker_id").agg(F.count("*").alias("n"))
    return json_array(per, "speaker_id")


@query(f"""WITH {Q.EVALS} SELECT audio_path || '|' || {Q.stripped('text')} AS value FROM evals WHERE {Q.stripped('text')} <> ''""")
def snk6_transcript_lines(spark: SparkSession, d: str) -> DataFrame:
    from voxloom.sources.sinks import transcript_lines

    return transcript_lines(evals(spark, d, "id", "audio_path", "text"), "audio_path", "text")

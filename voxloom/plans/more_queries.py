"""Smaller queries that complete the inventory: simple joins, limits, roll-ups, clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxloom.functions import text as T
from voxloom.functions.hashing import hash_split
from voxloom.operators import aggs, clusters, filters, folds, joins
from voxloom.plans import corpus
from voxloom.plans import sqltext as Q
from voxloom.plans.base import chunks, clips, evals, segments
from voxloom.plans.table_queries import _INDEX, _V2, HOLDOUT
from voxloom.sources import readers
from voxloom.storage import read

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query("""SELECT id, text, duration, has_punctuation, CAST(NULL AS VARCHAR) AS split FROM train_manifest UNION ALL SELECT id, text, duration, has_punctuation, split FROM eval_manifest""")
def set1_union_all(spark: SparkSession, d: str) -> DataFrame:
    c = ["id", "text", "duration", "has_punctuation"]
    return readers.union_splits(read(spark, d, "train_manifest").select(*c), read(spark, d, "eval_manifest").select(*c, "split"))


@query(f"WITH {Q.CLIPS} SELECT id FROM clips WHERE speaker_id = '{HOLDOUT}' UNION ALL SELECT id FROM clips WHERE speaker_id IS DISTINCT FROM '{HOLDOUT}' AND {Q.fraction('id')} < 0.05::DOUBLE")
def set4_holdout_and_slice(spark: SparkSession, d: str) -> DataFrame:
    c = clips(spark, d, "id", "speaker_id")
    held = F.coalesce(F.col("speaker_id") == HOLDOUT, F.lit(False))
    rest = c.where(~held & (hash_split(F.col("id"), 0.05, "eval", "train") == "eval"))
    return c.where(held).select("id").unionByName(rest.select("id"))


@query(f"WITH {Q.CLIPS} SELECT id, round(duration, 4) AS duration FROM clips WHERE coalesce(has_punctuation, false)")
def prj5_rounded_punctuated(spark: SparkSession, d: str) -> DataFrame:
    c = clips(spark, d, "id", "duration", "has_punctuation").where(F.coalesce("has_punctuation", F.lit(False)))
    return c.select("id", F.round("duration", 4).alias("duration"))


@query(f"WITH {Q.SEGMENTS}, t AS (SELECT chunk_id, coalesce(asr_text, '') AS x FROM (SELECT DISTINCT chunk_id, asr_text FROM aligned_chunk)) SELECT chunk_id, x AS text FROM t WHERE {Q.stripped('x')} <> ''")
def flt12_filled_transcripts(spark: SparkSession, d: str) -> DataFrame:
    c = chunks(spark, d).select("chunk_id", F.coalesce("asr_text", F.lit("")).alias("text")).distinct()
    return c.where(F.length(T.stripped(F.col("text"))) > 0)


@query("""WITH w AS (SELECT DISTINCT recording_id, chunk_idx FROM word_timing), t AS (SELECT DISTINCT chunk_id, asr_text FROM aligned_chunk),
k AS (SELECT recording_id, chunk_idx, printf('%s__chunk_%05d', recording_id, chunk_idx) AS chunk_id FROM w)
SELECT k.chunk_id, coalesce(asr_text, '') AS asr_text FROM k LEFT JOIN t USING (chunk_id)""")
def jn3_transcript_default(spark: SparkSession, d: str) -> DataFrame:
    k = read(spark, d, "word_timing").select("recording_id", "chunk_idx").distinct()
    k = k.select(F.format_string("%s__chunk_%05d", "recording_id", "chunk_idx").alias("chunk_id"))
    return joins.left_default(k, chunks(spark, d).select("chunk_id", "asr_text").distinct(), "chunk_id", {"asr_text": ""})


@query(f"WITH {Q.CLIPS}, {_INDEX} SELECT idx AS index, count(*) AS clips FROM clips JOIN i USING (speaker_id) GROUP BY idx")
def jn6_speaker_map(spark: SparkSession, d: str) -> DataFrame:
    c = clips(spark, d, "id", "speaker_id")
    return c.join(corpus.speaker_index(c, HOLDOUT), "speaker_id").groupBy("index").agg(F.count("*").alias("clips"))


@query(f"""WITH {Q.CLIPS}, {Q.EVALS} SELECT e.id, count(c.id) AS clips FROM evals e JOIN clips c ON c.book_title = e.book_title WHERE e.split = 'holdout' GROUP BY e.id""")
def jn14_exact_title(spark: SparkSession, d: str) -> DataFrame:
    per = clips(spark, d, "id", "book_title").groupBy("book_title").agg(F.count("id").alias("clips"))
    return evals(spark, d, "id", "book_title", "split").where("split = 'holdout'").join(per, "book_title").select("id", "clips")


@query(f"WITH {Q.SEGMENTS} SELECT round(avg(cer), 9) AS mean, round(stddev_pop(cer), 9) AS std, min(cer) AS min, max(cer) AS max, count(cer) AS n, count(*) FILTER (cer < 0.2::DOUBLE) AS good FROM segs")
def agg12_overall(spark: SparkSession, d: str) -> DataFrame:
    s = segments(spark, d, "segment_id", "cer")
    c = F.col("cer")
    return s.agg(F.round(F.avg(c), 9).alias("mean"), F.round(F.stddev_pop(c), 9).alias("std"), F.min(c).alias("min"), F.max(c).alias("max"), F.count(c).alias("n"), F.count(F.when(c < 0.2, 1)).alias("good"))


@query(f"""WITH {Q.SEGMENTS}, b AS (SELECT recording_id, count(*) AS total, count(*) FILTER ({_V2} = 'ok') AS kept FROM segs GROUP BY 1)
SELECT count(*) AS recordings, sum(total)::BIGINT AS total, sum(kept)::BIGINT AS kept FROM b WHERE kept > 0""")
def agg16_roll_up(spark: SparkSession, d: str) -> DataFrame:
    kept = filters.segment_reason(F.col("asr_text"), F.col("duration_sec")) == filters.KEPT
    per = aggs.yield_report(segments(spark, d, "segment_id", "recording_id", "asr_text", "duration_sec"), "recording_id", kept, "duration_sec").where("kept > 0")
    return per.agg(F.count("*").alias("recordings"), F.sum("total").alias("total"), F.sum("kept").alias("kept"))


_HOURS = "sum(CAST(coalesce(duration, 0) AS DECIMAL(18,4)))"


@query(f"WITH {Q.CLIPS} SELECT speaker_id, count(*) AS clips FROM clips WHERE speaker_id IS NOT NULL GROUP BY speaker_id ORDER BY {_HOURS}, speaker_id LIMIT 1")
def win4_smallest_speaker(spark: SparkSession, d: str) -> DataFrame:
    c = clips(spark, d, "id", "speaker_id", "duration").where("speaker_id IS NOT NULL")
    per = c.groupBy("speaker_id").agg(F.sum(F.coalesce("duration", F.lit(0.0)).cast("decimal(18,4)")).alias("s"), F.count("*").alias("clips"))
    return per.orderBy("s", "speaker_id").limit(1).select("speaker_id", "clips")


@query("SELECT doc_id, id FROM (SELECT doc_id, printf('t_%04d', row_number() OVER (ORDER BY doc_id) - 1) AS id, row_number() OVER (ORDER BY doc_id) AS k FROM documents) WHERE k <= 20")
def win10_first_rows(spark: SparkSession, d: str) -> DataFrame:
    return readers.test_set(read(spark, d, "documents").select("doc_id"), ["doc_id"], "t", first=20)


@query()
def win13_absorbed_chunks(spark: SparkSession, d: str) -> DataFrame:
    v = segments(spark, d, "recording_id", "start_sec", "end_sec").where("end_sec > start_sec")
    return folds.absorb_short(folds.remerge(v, "recording_id").drop("parts"), "recording_id")


_KNOWN = "".join(map(chr, range(32, 127))) + "".join(map(chr, range(0x10D0, 0x10F1)))


@query(f"""WITH {Q.EVALS}, c AS (SELECT id, list_distinct(regexp_extract_all(text, '(?s).')) AS v FROM evals WHERE text IS NOT NULL)
SELECT id, array_to_string(list_sort(list_filter(v, lambda x: NOT contains('{_KNOWN.replace("'", "''")}', x))), '') AS unknown FROM c""")
def sf28_unknown_chars(spark: SparkSession, d: str) -> DataFrame:
    return evals(spark, d, "id", "text").where("text IS NOT NULL").select("id", F.array_join(T.unknown_chars(F.col("text"), list(_KNOWN)), "").alias("unknown"))


@query()
def op_cluster_speakers(spark: SparkSession, d: str) -> DataFrame:
    return clusters.cluster_speakers(read(spark, d, "embeddings"), "embedding", least=20).select("vec_id", "cluster_speaker_id")


@query("""SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n FROM events GROUP BY ALL""")
def str1_windowed_counts(spark: SparkSession, d: str) -> DataFrame:
    from voxloom.streaming.ingest import windowed_counts

    out = windowed_counts(read(spark, d, "events"), "ts", "event_type")
    return out.select(F.col("window.start").cast("timestamp_ntz").alias("hour"), "event_type", "n")


@query(f"""WITH {Q.SEGMENTS}, m AS (SELECT recording_id, speaker_id, round(avg(cer), 9) AS x FROM segs WHERE cer IS NOT NULL AND speaker_id IS NOT NULL GROUP BY ALL)
SELECT speaker_id, count(*) AS runs, min(x) AS best, max(x) AS worst FROM m GROUP BY speaker_id""")
def win9_run_summary(spark: SparkSession, d: str) -> DataFrame:
    s = segments(spark, d, "segment_id", "recording_id", "speaker_id", "cer").where("cer IS NOT NULL AND speaker_id IS NOT NULL")
    m = s.groupBy("recording_id", "speaker_id").agg(F.round(F.avg("cer"), 9).alias("x"))
    return m.groupBy("speaker_id").agg(F.count("*").alias("runs"), F.min("x").alias("best"), F.max("x").alias("worst"))

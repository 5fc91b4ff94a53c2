"""Queries on sources, projections and scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxloom.functions import metrics as M
from voxloom.functions import text as T
from voxloom.functions.compress import compression_ratio
from voxloom.operators import filters
from voxloom.plans import sqltext as Q
from voxloom.plans.base import chunks, clips, evals, segments
from voxloom.plans.corpus import trainer_manifest
from voxloom.operators.windows import sequence_ids
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


@query("SELECT split, count(*) AS n FROM (SELECT 'train' AS split FROM train_manifest UNION ALL SELECT split FROM eval_manifest) GROUP BY split")
def src2_split_rows(spark: SparkSession, d: str) -> DataFrame:
    both = readers.union_splits(read(spark, d, "train_manifest").select(F.lit("train").alias("split")), read(spark, d, "eval_manifest").select("split"))
    return both.groupBy("split").agg(F.count("*").alias("n"))


@query("""SELECT coalesce(speaker_id, '0') AS speaker_id, count(*) AS n FROM
(SELECT id, speaker_id FROM train_manifest UNION ALL SELECT id, speaker_id FROM eval_manifest) GROUP BY 1""")
def src4_default_speaker(spark: SparkSession, d: str) -> DataFrame:
    both = readers.union_splits(read(spark, d, "train_manifest").select("id", "speaker_id"), read(spark, d, "eval_manifest").select("id", "speaker_id"))
    return readers.with_default_speaker(both).groupBy("speaker_id").agg(F.count("*").alias("n"))


@query("SELECT doc_id, printf('fleurs_%04d', row_number() OVER (ORDER BY doc_id) - 1) AS id FROM documents")
def src10_test_ids(spark: SparkSession, d: str) -> DataFrame:
    return readers.test_set(read(spark, d, "documents").select("doc_id"), ["doc_id"])


@query("SELECT id, audio_path FROM train_manifest ORDER BY id LIMIT 1")
def src14_default_reference(spark: SparkSession, d: str) -> DataFrame:
    return readers.default_reference(clips(spark, d, "id", "audio_path"), "id")


@query(f"WITH {Q.CLIPS} SELECT id, duration / nullif(length(replace(text, ' ', '')), 0) AS char_duration FROM clips")
def prj2_char_duration(spark: SparkSession, d: str) -> DataFrame:
    return clips(spark, d, "id", "text", "duration").select("id", filters.char_duration(F.col("text"), F.col("duration")).alias("char_duration"))


@query("""SELECT recording_id, segment_id, CASE WHEN duration_sec > 0 THEN duration_sec ELSE length(asr_text)::DOUBLE / nullif(length(text), 0) END AS seconds
FROM (SELECT DISTINCT recording_id, segment_id, duration_sec, asr_text, text FROM segment)""")
def prj3_fallback_duration(spark: SparkSession, d: str) -> DataFrame:
    s = segments(spark, d, "recording_id", "segment_id", "duration_sec", "asr_text", "text")
    seconds = filters.duration_or_frames(F.col("duration_sec"), F.length("asr_text"), F.length("text"))
    return s.select("recording_id", "segment_id", seconds.alias("seconds"))


@query(f"WITH {Q.CLIPS} SELECT id, CASE WHEN duration > 0 THEN length(text) / duration END AS pace FROM clips")
def prj4_chars_per_second(spark: SparkSession, d: str) -> DataFrame:
    return clips(spark, d, "id", "text", "duration").select("id", filters.chars_per_second(F.col("text"), F.col("duration")).alias("pace"))


@query(f"""WITH {Q.CLIPS} SELECT id, '/data/24k/' || string_split(audio_path, '/')[-1] AS audio_filepath, duration,
coalesce(CASE WHEN regexp_full_match(speaker_id, '[0-9]+') THEN try_cast(speaker_id AS INTEGER) END, 0) AS speaker,
'/data/codes/' || regexp_replace(string_split(audio_path, '/')[-1], '\\.[^.]*$', '') || '.pt' AS codes FROM clips""")
def prj6_trainer_manifest(spark: SparkSession, d: str) -> DataFrame:
    t = trainer_manifest(clips(spark, d, "id", "audio_path", "text", "duration", "speaker_id"), "/data/24k/", "/data/codes")
    return t.select("id", "audio_filepath", "duration", "speaker", F.col("target_audio_codes_path").alias("codes"))


@query(f"""WITH {Q.CHUNKS} SELECT chunk_id, coalesce(nullif(punctuated_text, ''), nullif(asr_text, ''), '') AS text,
CASE WHEN cer <= 0.2::DOUBLE THEN book_text ELSE '' END AS book_text, alignment_score FROM chunks""")
def prj9_text_choice(spark: SparkSession, d: str) -> DataFrame:
    ok = F.col("cer") <= 0.2
    return chunks(spark, d).select(
        "chunk_id", T.first_filled(F.col("punctuated_text"), F.col("asr_text")).alias("text"), F.when(ok, F.col("book_text")).otherwise("").alias("book_text"), "alignment_score"
    )


@query(f"""WITH {Q.EVALS} SELECT id, CASE WHEN audio_path LIKE '/%' THEN audio_path WHEN audio_path IS NOT NULL THEN '/corpus/' || audio_path END AS path,
'[' || speaker_id || ']' || text AS prompt FROM evals""")
def prj10_paths_and_prompts(spark: SparkSession, d: str) -> DataFrame:
    prompt = F.concat(F.lit("["), "speaker_id", F.lit("]"), "text")
    return evals(spark, d, "id", "audio_path", "text", "speaker_id").select("id", T.absolute(F.col("audio_path"), "/corpus").alias("path"), prompt.alias("prompt"))


@query("""SELECT recording_id, chunk_idx, printf('%s_seg_%05d', recording_id, row_number() OVER (PARTITION BY recording_id ORDER BY chunk_idx) - 1) AS segment_id
FROM (SELECT DISTINCT recording_id, chunk_idx FROM word_timing)""")
def prj12_sequence_ids(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "word_timing").select("recording_id", "chunk_idx").distinct()
    return sequence_ids(rows, "recording_id", ["recording_id", "chunk_idx"], "seg")


@query(f"WITH {Q.SEGMENTS} SELECT segment_id, {Q.norm('text')} AS norm FROM segs")
def sf1_norm_eval(spark: SparkSession, d: str) -> DataFrame:
    return segments(spark, d, "segment_id", "text").select("segment_id", T.norm_eval(F.col("text")).alias("norm"))


@query(f"""SELECT doc_id, md5({Q.norm("regexp_replace(text, '(?m)^#+[\\t-\\r\\x{1c}-\\x{20}]+', '', 'g')")}) AS norm_md5 FROM documents""")
def sf2_norm_book(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", F.md5(T.norm_book(F.col("text")).cast("binary")).alias("norm_md5"))


@query("SELECT word, regexp_replace(word, '[^\\p{L}\\p{N}_]', '', 'g') AS bare, regexp_matches(word, '[.!?;:…]$') AS closes, count(*) AS n FROM word_timing GROUP BY ALL")
def sf3_bare_words(spark: SparkSession, d: str) -> DataFrame:
    w = read(spark, d, "word_timing").groupBy("word").agg(F.count("*").alias("n"))
    return w.select("word", T.bare_word(F.col("word")).alias("bare"), T.ends_sentence(F.col("word")).alias("closes"), "n")


def _rates(d_over: str, empty: str) -> str:
    return f"CASE WHEN len(ua) > 0 THEN d / ({d_over})::DOUBLE WHEN len(ub) > 0 THEN 1.0 WHEN {empty} THEN 0.0 END"


_PAIR = "b AS (SELECT segment_id, {r} AS r, {h} AS h FROM segs WHERE text IS NOT NULL AND asr_text IS NOT NULL)"


def _cer(r: str, h: str, over: str = "len(ua)", of: str = "chars", name: str = "cer") -> str:
    return f"WITH {Q.SEGMENTS}, {_PAIR.format(r=r, h=h)}, {Q.edits('b', 'r', 'h', of)} SELECT segment_id, round({_rates(over, 'true')}, 9) AS {name} FROM dist"


def _pairs(spark, d):
    return segments(spark, d, "segment_id", "text", "asr_text").where("text IS NOT NULL AND asr_text IS NOT NULL")


@query(_cer(Q.collapsed("text"), Q.collapsed("asr_text")))
def sf5_cer_verify(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d).select("segment_id", F.round(M.cer_verify(F.col("text"), F.col("asr_text")), 9).alias("cer"))


@query(_cer(Q.norm("text"), Q.norm("asr_text")))
def sf6_cer_eval(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d).select("segment_id", F.round(M.cer_eval(F.col("text"), F.col("asr_text")), 9).alias("cer"))


@query(_cer(Q.stripped("text"), Q.stripped("asr_text")))
def sf7_cer_plain(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d).select("segment_id", F.round(M.cer_plain(F.col("text"), F.col("asr_text")), 9).alias("cer"))


@query(_cer("text", "asr_text"))
def sf8_cer_raw(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d).select("segment_id", F.round(M.cer_raw(F.col("text"), F.col("asr_text")), 9).alias("cer"))


@query(_cer("text", "asr_text", "greatest(len(ua), len(ub))"))
def sf9_cer_bounded(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d).select("segment_id", F.round(M.cer_bounded(F.col("text"), F.col("asr_text")), 9).alias("cer"))


@query(_cer(Q.norm("text"), Q.norm("asr_text"), of="words", name="wer"))
def sf10_wer(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d).select("segment_id", F.round(M.wer(F.col("text"), F.col("asr_text")), 9).alias("wer"))


@query(f"""WITH w AS (SELECT DISTINCT lower(word) AS w FROM word_timing WHERE word IS NOT NULL), p AS (SELECT w AS word, lead(w) OVER (ORDER BY w) AS next FROM w),
b AS (SELECT word, next, word AS r, next AS h FROM p WHERE next IS NOT NULL), {Q.edits('b', 'r', 'h')}
SELECT word, next, round(coalesce(d / nullif(greatest(len(ua), len(ub)), 0)::DOUBLE, 0.0), 9) AS cer FROM dist""")
def sf11_word_cer(spark: SparkSession, d: str) -> DataFrame:
    from voxloom.operators.windows import numbered

    w = read(spark, d, "word_timing").where("word IS NOT NULL").select(F.lower("word").alias("word")).distinct()
    n = numbered(w, ["word"])
    after = n.select((F.col("rn") - 1).alias("rn"), F.col("word").alias("next"))
    return n.join(after, "rn").select("word", "next", F.round(M.word_cer(F.col("word"), F.col("next")), 9).alias("cer"))


@query(f"SELECT doc_id, round({Q.ratio('text')}, 9) AS ratio FROM documents")
def sf12_script_ratio(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", F.round(T.script_ratio(F.col("text")), 9).alias("ratio"))


@query()
def sf13_compression_ratio(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", compression_ratio("text").alias("ratio"))


_CH, _WD = Q.units("text", "chars"), Q.units(Q.collapsed("text"), "words")


@query(rf"""WITH {Q.CLIPS}, l AS (SELECT id, text, {_CH} AS c, {_WD} AS w FROM clips WHERE text IS NOT NULL)
SELECT id, len(list_filter(range(1, len(c) - 3), lambda i: c[i] <> chr(10) AND len(list_distinct(c[i:i+4])) = 1)) > 0 AS chars,
len(list_filter(range(1, len(w) - 2), lambda i: len(list_distinct(w[i:i+3])) = 1)) > 0 AS words FROM l""")
def sf14_repetition(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return clips(spark, d, "id", "text").where(t.isNotNull()).select("id", T.repeated_chars(t).alias("chars"), T.repeated_words(t).alias("words"))


@query(f"WITH {Q.CLIPS} SELECT id, {Q.seg_number('id')} AS seg FROM clips")
def sf18_segment_number(spark: SparkSession, d: str) -> DataFrame:
    return clips(spark, d, "id").select("id", T.segment_number(F.col("id")).alias("seg"))


@query(rf"""WITH b AS (SELECT DISTINCT book_title FROM train_manifest WHERE book_title IS NOT NULL)
SELECT book_title, substr(regexp_replace(regexp_replace(regexp_replace(book_title, '[^\p{{L}}\p{{N}}_]', '_', 'g'), '_+', '_', 'g'), '^_|_$', '', 'g'), 1, 80) AS id,
substr(regexp_replace(book_title, '[^\p{{L}}\p{{N}}_]', '_', 'g'), 1, 60) AS id2 FROM b""")
def sf19_safe_ids(spark: SparkSession, d: str) -> DataFrame:
    b = clips(spark, d, "book_title").where("book_title IS NOT NULL")
    t = F.col("book_title")
    return b.select("book_title", T.safe_id(t).alias("id"), T.safe_id(t, 60, squeeze=False).alias("id2"))


@query(f"""WITH {Q.CLIPS}, s AS (SELECT id, regexp_replace(string_split(audio_path, '/')[-1], '\\.[^.]*$', '') AS stem FROM clips)
SELECT id, CASE WHEN len(string_split(stem, '_')) >= 3 THEN string_split(stem, '_')[-1] WHEN stem IS NOT NULL THEN 'unknown' ELSE 'unknown' END AS narrator FROM s""")
def sf20_narrator(spark: SparkSession, d: str) -> DataFrame:
    return clips(spark, d, "id", "audio_path").select("id", T.narrator(F.col("audio_path")).alias("narrator"))


@query(f"""WITH {Q.EVALS}, n AS (SELECT id, {Q.norm('text')} AS t FROM evals WHERE text IS NOT NULL)
SELECT id, array_to_string(CASE WHEN length(t) >= 8 THEN list_transform(range(1, length(t) - 6, 4), lambda i: substr(t, i, 8)) ELSE [t] END, '|') AS grams FROM n""")
def sf21_char_ngrams(spark: SparkSession, d: str) -> DataFrame:
    t = T.norm_eval(F.col("text"))
    return evals(spark, d, "id", "text").where("text IS NOT NULL").select("id", F.array_join(T.char_ngrams(t), "|").alias("grams"))


@query("""SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) AS similarity
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def sf22_cosine(spark: SparkSession, d: str) -> DataFrame:
    from voxloom.operators.joins import paired_similarity

    e = read(spark, d, "embeddings")
    pairs = e.select(F.col("vec_id").alias("a"), (F.col("vec_id") + 1).alias("b"))
    out = paired_similarity(e, pairs, "vec_id", "embedding", "a", "b")
    return out.select("a", "b", F.round("similarity", 9).alias("similarity"))


@query("""WITH p AS (SELECT a.vec_id, a.embedding::DOUBLE[] AS x, b.embedding::DOUBLE[] AS y FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)
SELECT vec_id, round(list_sum(list_transform(range(57, 65), lambda i: x[i] * (1 - (i - 57) / 7.0::DOUBLE) + y[i - 56] * ((i - 57) / 7.0::DOUBLE))) + list_sum(x[1:56]) + list_sum(y[9:64]), 6) AS total,
len(x) + len(y) - 8 AS size FROM p""")
def sf24_crossfade(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    j = e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("x").alias("y")), "vec_id")
    c = j.select("vec_id", M.crossfade(F.col("x"), F.col("y"), 8).alias("c"))
    return c.select("vec_id", F.round(F.aggregate("c", F.lit(0.0), lambda s, v: s + v), 6).alias("total"), F.size("c").cast("long").alias("size"))


@query("""SELECT id, md5(id) AS hex, round(('0x' || substr(md5(id), 1, 8))::BIGINT / 4294967295.0::DOUBLE, 9) AS fraction, regexp_full_match(speaker_id, '[0-9]+') AS numeric_speaker
FROM (SELECT DISTINCT id, speaker_id FROM eval_manifest)""")
def sf26_md5_and_digits(spark: SparkSession, d: str) -> DataFrame:
    from voxloom.functions.hashing import md5_fraction

    return evals(spark, d, "id", "speaker_id").select(
        "id", F.md5(F.col("id").cast("binary")).alias("hex"), F.round(md5_fraction(F.col("id")), 9).alias("fraction"), F.col("speaker_id").rlike("^[0-9]+$").alias("numeric_speaker")
    )

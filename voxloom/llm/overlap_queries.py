"""Queries on texts that evaluation and training share (p1)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxloom.llm import overlap
from voxloom.operators.joins import attach_by_key, attach_unknown, join_copies
from voxloom.storage import cut, read


def _linked(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pairs of classes, train members in a pair, eval members in a pair)."""
    train_ids, train = overlap.word_classes(read(spark, sf_dir, "train_manifest"), "id", "text")
    eval_ids, evals = overlap.word_classes(read(spark, sf_dir, "eval_manifest"), "id", "text")
    pairs = cut(overlap.overlaps(train, evals))
    sides = []
    for ids, key in ((train_ids, "train_key"), (eval_ids, "eval_key")):
        ids = cut(ids.withColumnRenamed("key", key))
        sizes = ids.join(pairs.select(key).distinct(), key, "left_semi").groupBy(key).agg(F.count("*").alias("n"))
        sides.append(cut(attach_by_key(ids, cut(sizes), key, "n").withColumnRenamed("id", key.replace("key", "id"))))
    return pairs, *sides


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of an evaluation clip and a training clip with the same or nearly the same text."""
    pairs, train, evals = _linked(spark, sf_dir)
    both = join_copies(pairs.select("train_key", "eval_key"), evals, "eval_key", "n", "eval_id")
    both = join_copies(both, train, "train_key", "n", "train_id")
    return both.select(F.least("train_id", "eval_id").alias("id_a"), F.greatest("train_id", "eval_id").alias("id_b")).distinct()


def p1_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per split and book_title: evaluation clips, those found in training, exactly and almost, and their common spans.

    spans and span_words sum, over the clips found, the merged maximal matches of three words or more with
    the partner of which they cover most.
    """
    pairs, train, evals = _linked(spark, sf_dir)
    reach = train.groupBy("train_key").agg(F.count("*").alias("train_clips"))
    exact = (F.col("common") == F.greatest("train_words", "eval_words")).cast("int")
    best = F.max(F.struct("span_words", (-F.col("spans")).alias("spans")))
    per_class = attach_unknown(pairs, reach, "train_key").groupBy("eval_key").agg(
        F.max(exact).alias("exact"), F.sum("train_clips").alias("train_clips"), best.alias("best")
    )
    sizes = evals.groupBy("eval_key").agg(F.count("*").alias("copies"))
    found = attach_by_key(evals.drop("n"), cut(per_class.join(sizes, "eval_key")), "eval_key", "copies")
    clips = read(spark, sf_dir, "eval_manifest").select(F.col("id").alias("eval_id"), "split", "book_title").distinct()
    found = found.groupBy("eval_id").agg(F.max("exact").alias("exact"), F.sum("train_clips").alias("train_clips"), F.max("best").alias("best"))
    none = F.lit(0)
    return clips.join(found, "eval_id", "left").groupBy("split", "book_title").agg(
        F.count("*").alias("clips"),
        F.count("train_clips").alias("overlapping"),
        F.coalesce(F.sum("exact"), none).alias("exact"),
        F.coalesce(F.sum("train_clips"), none).alias("train_clips"),
        F.coalesce(F.sum(-F.col("best.spans")), none).alias("spans"),
        F.coalesce(F.sum("best.span_words"), none).alias("span_words"),
    )


QUERIES = {"p1_found": p1_found, "p1_report": p1_report}

# Pairs that have enough words in common, however ordered, then their common subsequence row by row: a row is the
# running maximum of the row before and of its diagonal plus one where words agree.
SQL = {
    "p1_found": r"""
WITH RECURSIVE
t AS (SELECT DISTINCT id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM train_manifest),
e AS (SELECT DISTINCT id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM eval_manifest),
tw AS (SELECT w AS words, x, row_number() OVER (PARTITION BY w, x) AS k FROM (SELECT DISTINCT w FROM t WHERE len(w) >= 6), unnest(w) AS u(x)),
ew AS (SELECT w AS words, x, row_number() OVER (PARTITION BY w, x) AS k FROM (SELECT DISTINCT w FROM e WHERE len(w) >= 6), unnest(w) AS u(x)),
near AS (SELECT tw.words AS a, ew.words AS b FROM tw JOIN ew USING (x, k) GROUP BY a, b
  HAVING 5 * count(*) >= 4 * greatest(len(tw.words), len(ew.words))),
walk AS (
  SELECT a, b, 0 AS i, list_transform(range(len(b)), lambda j: 0) AS row FROM near
  UNION ALL
  SELECT a, b, i + 1, list_transform(range(1, len(b) + 1), lambda j: list_max(
    list_transform(range(1, j + 1), lambda q: greatest(row[q], CASE WHEN a[i + 1] = b[q] THEN 1 + CASE WHEN q > 1 THEN row[q - 1] ELSE 0 END ELSE 0 END))))
  FROM walk WHERE i < len(a)),
hit AS (SELECT a, b FROM walk WHERE i = len(a) AND 5 * row[len(b)] >= 4 * greatest(len(a), len(b)))
SELECT DISTINCT least(t.id, e.id) AS id_a, greatest(t.id, e.id) AS id_b FROM hit JOIN t ON t.w = hit.a JOIN e ON e.w = hit.b""",
}

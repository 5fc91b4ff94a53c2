"""Queries on duplicates (p6) and splits (p5), with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxloom.llm import dedup, splits
from voxloom.storage import read


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every copy but the smallest of its group, in train_manifest and in manifest_raw."""
    train = dedup.copies_of(read(spark, sf_dir, "train_manifest"), "id", "text", dedup.canonical_texts)
    raw = dedup.copies_of(read(spark, sf_dir, "manifest_raw"), "line_id", "line", dedup.canonical_lines)
    return train.select(F.lit("train_manifest").alias("tbl"), "id_a", "id_b").unionByName(
        raw.select(F.lit("manifest_raw").alias("tbl"), "id_a", "id_b")
    )


def p6_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each record of train_manifest once, with the number of clips that carry its text in any formatting."""
    return dedup.collapsed(read(spark, sf_dir, "train_manifest"), "id", "text", dedup.canonical_texts)


def p6_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each record of manifest_raw once, with the number of lines that carry it; broken lines by exact copy."""
    return dedup.collapsed(read(spark, sf_dir, "manifest_raw"), "line_id", "line", dedup.canonical_lines)


def _targets(spark: SparkSession, sf_dir: str) -> dict[str, float]:
    return {r["split"]: r["target_share"] for r in read(spark, sf_dir, "split_target").where("target_share > 0").collect()}


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Speakers who must share a split."""
    clips = splits.clips_with_tokens(read(spark, sf_dir, "train_manifest"))
    return splits.speakers_together(clips, _targets(spark, sf_dir)).select("speaker_a", "speaker_b")


def p5_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The split of every clip of train_manifest."""
    return splits.assign(splits.clips_with_tokens(read(spark, sf_dir, "train_manifest")), _targets(spark, sf_dir))


def p5_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and reached share of each split."""
    got = p5_assignment(spark, sf_dir).groupBy("split").agg(F.count("*").alias("clips"))
    want = read(spark, sf_dir, "split_target").select("split", "target_share")
    total = got.agg(F.sum("clips").alias("all"))
    return (
        want.join(got, "split", "left").crossJoin(F.broadcast(total))
        .select("split", "target_share", F.coalesce("clips", F.lit(0)).alias("clips"),
                F.round(F.coalesce("clips", F.lit(0)) / F.col("all"), 6).alias("reached_share"))
    )


QUERIES = {
    "p5_found": p5_found, "p5_assignment": p5_assignment, "p5_shares": p5_shares,
    "p6_found": p6_found, "p6_copies": p6_copies, "p6_lines": p6_lines,
}

_TOKENS = """
clips AS (SELECT DISTINCT id, speaker_id, book_title FROM train_manifest WHERE id IS NOT NULL),
link AS (
  SELECT id, 's:' || trim(s) AS node FROM (SELECT id, unnest(string_split(speaker_id, ',')) AS s FROM clips)
  WHERE trim(s) NOT IN ('', 'unknown')
  UNION SELECT id, 'b:' || book_title FROM clips WHERE trim(book_title) NOT IN ('', 'unknown')
  UNION SELECT id, 'r:' || split_part(id, '__seg_', 1) FROM clips WHERE instr(id, '__seg_') > 1),
pair AS (SELECT DISTINCT a.node AS x, b.node AS y FROM
  (SELECT DISTINCT h, list_sort(list(node)) AS nodes FROM (SELECT id AS h, node FROM link) GROUP BY h) t,
  unnest(nodes) AS a(node), unnest(nodes) AS b(node)),
reach AS (SELECT x, y FROM pair UNION SELECT r.x, p.y FROM reach r JOIN pair p ON r.y = p.x)"""

_SQUEEZED = r"regexp_replace(lower(text), '[^\p{L}\p{N}]+', '', 'g')"

# Canonical forms: of a text its letters and digits, of a line its fields in order with numbers as such; values
# without one (too few words, broken lines) stand for themselves, null values for their row.
_FORMS = rf"""
clip AS (SELECT DISTINCT id, text, coalesce(len(regexp_extract_all(text, '[\p{{L}}\p{{N}}]+')) >= 6, false) AS canonical FROM train_manifest),
line AS (SELECT DISTINCT line_id AS id, line, coalesce(json_type(CASE WHEN json_valid(line) THEN line END) = 'OBJECT', false) AS canonical FROM manifest_raw),
field AS (SELECT line, unnest(json_keys(CASE WHEN canonical THEN line END)) AS k FROM (SELECT DISTINCT line, canonical FROM line)),
value AS (SELECT line, k, json_type(line, '$."' || k || '"') AS t, json_extract_string(line, '$."' || k || '"') AS v FROM field),
object AS (SELECT line, string_agg(k || '=' || CASE
    WHEN k = 'text' AND t = 'VARCHAR' THEN 's' || regexp_replace(lower(v), '[^\p{{L}}\p{{N}}]+', '', 'g')
    WHEN t = 'VARCHAR' THEN 's' || v WHEN t IN ('DOUBLE', 'BIGINT', 'UBIGINT') THEN 'n' || CAST(CAST(v AS DOUBLE) AS VARCHAR)
    ELSE t || coalesce(v, '') END, chr(10) ORDER BY k) AS c FROM value GROUP BY line),
form AS (
  SELECT 'train_manifest' AS tbl, id, canonical, CASE WHEN canonical THEN 'c' || {_SQUEEZED} ELSE coalesce('r' || text, 'i' || id) END AS c FROM clip
  UNION ALL SELECT 'manifest_raw', id, canonical, CASE WHEN canonical THEN 'c' || c ELSE coalesce('r' || line, 'i' || id) END
  FROM line LEFT JOIN object USING (line))"""

SQL = {
    "p5_found": f"""
WITH RECURSIVE {_TOKENS}
SELECT min(substr(x, 3)) AS speaker_a, substr(y, 3) AS speaker_b FROM reach
WHERE x LIKE 's:%' AND y LIKE 's:%' GROUP BY y HAVING min(substr(x, 3)) <> substr(y, 3)""",
    "p6_found": rf"""
WITH {_FORMS}
SELECT tbl, min_id AS id_a, id AS id_b FROM (
  SELECT DISTINCT tbl, id, min(id) OVER (PARTITION BY tbl, c) AS min_id FROM form WHERE canonical) WHERE id <> min_id""",
    "p6_copies": f"""
WITH {_FORMS}
SELECT min(id) AS id, count(*) AS copies FROM form WHERE tbl = 'train_manifest' GROUP BY c""",
    "p6_lines": f"""
WITH {_FORMS}
SELECT min(id) AS id, count(*) AS copies FROM form WHERE tbl = 'manifest_raw' GROUP BY c""",
}

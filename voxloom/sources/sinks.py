"""Sinks: JSON lines, small JSON arrays, kept/dropped stage tables, delimited transcripts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.functions.text import stripped


def write_manifest(df: DataFrame, path: str, single_file: bool = False) -> None:
    """JSON lines in UTF-8; null fields are left out. ``single_file`` is for small exports."""
    (df.coalesce(1) if single_file else df).write.mode("overwrite").option("ignoreNullFields", True).json(path)


def json_array(df: DataFrame, order: str) -> DataFrame:
    """One row, value: all rows as a JSON array in ``order``; for small tables such as summaries."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("_o"), F.struct(*df.columns).alias("_r"))))
    return df.agg(F.to_json(F.transform(rows, lambda r: r["_r"])).alias("value"))


def write_dataset(df: DataFrame, path: str, rows_per_file: int = 100_000) -> None:
    """Parquet dataset export with files of a bounded number of rows, readable by Arrow-based loaders."""
    df.write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).option("compression", "zstd").parquet(path)


def transcript_lines(df: DataFrame, path: str, text: str, listing: DataFrame | None = None, listed: str | None = None) -> DataFrame:
    """(value): 'audio_file|text' lines without quoting; blank texts and files not in the listing go out."""
    rows = df.where(F.length(stripped(F.col(text))) > 0)
    if listing is not None:
        rows = rows.join(listing.select(F.col(listed).alias(path)).distinct(), path, "left_semi")
    return rows.select(F.concat_ws("|", F.col(path), stripped(F.col(text))).alias("value"))


def write_transcript_lines(lines: DataFrame, path: str) -> None:
    """A header file and data files; the header is its own small file, read first by name."""
    spark = lines.sparkSession
    lines.write.mode("overwrite").text(path)
    spark.createDataFrame([("audio_file|text",)], "value string").coalesce(1).write.mode("overwrite").text(path + ".header")

"""Sources: manifests, shards, reference texts, file listings and PCM headers."""

from __future__ import annotations

import io
import os
import wave
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxloom import schemas
from voxloom.operators.windows import numbered

SPLITS = {"train": "train_manifest.json", "eval": "eval_manifest.json", "test": "test_manifest.json"}


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p)
    return found is not None and len(found) > 0


def read_manifest(spark: SparkSession, path: str, schema: str = schemas.CLIP) -> DataFrame:
    """JSON lines with a given schema; blank lines are skipped and a broken line fails the read."""
    if not _exists(spark, path):
        raise FileNotFoundError(f"no manifest at {path}; ingest the corpus first")
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_splits(spark: SparkSession, folder: str, schema: str = schemas.CLIP) -> DataFrame:
    """The three fixed manifests of a folder, with their split."""
    out = None
    for split, name in SPLITS.items():
        part = read_manifest(spark, os.path.join(folder, name), schema).withColumn("split", F.lit(split))
        out = part if out is None else out.unionByName(part)
    return out


def union_splits(*manifests: DataFrame) -> DataFrame:
    """UNION ALL by name; columns that one side lacks are null."""
    out = manifests[0]
    for m in manifests[1:]:
        out = out.unionByName(m, allowMissingColumns=True)
    return out


def with_default_speaker(df: DataFrame, default: str = "0") -> DataFrame:
    return df.withColumn("speaker_id", F.coalesce("speaker_id", F.lit(default)))


def read_shards(spark: SparkSession, folder: str, pattern: str = "train-*.parquet", schema: str | None = None) -> DataFrame:
    """All shards of a folder; an error if there are none. Only selected columns are read, audio included."""
    path = os.path.join(folder, pattern)
    if not _exists(spark, path):
        raise FileNotFoundError(f"no shards match {path}")
    r = spark.read.schema(schema) if schema else spark.read
    return r.parquet(path)


def read_reference_texts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.REFERENCE_TEXT).parquet(path)


def read_json_document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON array or object file, such as cached transcripts."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def test_set(df: DataFrame, order: list[str], prefix: str = "fleurs", first: int | None = None) -> DataFrame:
    """Adds id '<prefix>_0000' by position in ``order``; optionally only the first rows."""
    n = numbered(df if first is None else df.orderBy(*order).limit(first), order, "_rn")
    return n.withColumn("id", F.format_string(f"{prefix}_%04d", F.col("_rn"))).drop("_rn")


def list_files(spark: SparkSession, folder: str, pattern: str = "*.wav") -> DataFrame:
    """(path, name, length) of matching files; contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "length")


def pcm_info(spark: SparkSession, folder: str, pattern: str = "*.wav") -> DataFrame:
    """(name, frames, sample_rate, channels) from PCM headers; all null for a file that isn't one."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)

    @F.pandas_udf("frames long, sample_rate int, channels int")
    def info(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for p in parts:
            out = []
            for data in p:
                try:
                    with wave.open(io.BytesIO(data)) as w:
                        out.append((w.getnframes(), w.getframerate(), w.getnchannels()))
                except (wave.Error, EOFError):
                    out.append((None, None, None))
            yield pd.DataFrame(out, columns=["frames", "sample_rate", "channels"]).astype("Int64")

    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), info("content").alias("i")).select("name", "i.*")


def default_reference(df: DataFrame, order: str) -> DataFrame:
    """The first row in ``order``."""
    return df.orderBy(order).limit(1)

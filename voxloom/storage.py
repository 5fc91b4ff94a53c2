"""Lineage cuts and shared scratch space.

Long plans are cut by writing a compressed table into the folder named by ``spark.checkpoint.dir``,
which every executor reaches; nothing lives only on one executor, so a lost executor costs a re-read.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; a temporary one only on a local master."""
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not d:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        d = tempfile.mkdtemp(prefix="voxloom-")
        spark.sparkContext.setCheckpointDir(d)
    return d.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def _clean() -> None:
    for spark, path in _written:
        try:
            _delete(spark, path)
        except Exception:  # the session has ended; the cluster's own cleaner takes over
            pass


atexit.register(_clean)


def scratch(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that is deleted when the program ends."""
    path = f"{shared_dir(spark)}/voxloom-{name}"
    _written.append((spark, path))
    return path


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder as zstd parquet and return it read back.

    The result's lineage is only that table. Row order inside a file is kept; partition numbers are
    not, so carry them as a column when they matter.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/voxloom-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _written.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete the table behind a frame from ``cut`` that nothing will read again, such as a past round's."""
    path = df._cut_path
    _delete(df.sparkSession, path)
    _written.remove((df.sparkSession, path))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def once(df: DataFrame, arrival: str, *columns: str) -> DataFrame:
    """Rows delivered again count once: group by ``columns`` and keep the earliest ``arrival``.

    Only the named columns are read. Nulls group together; the shuffle is on all columns, so no value
    of a single one can fill a task, and partial aggregation collapses repeats before it.
    """
    return df.groupBy(*columns).agg(F.min(arrival).alias(arrival))

"""Speaker groups from embeddings, where clips carry no usable speaker name."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.config import QUALITY
from voxloom.operators.filters import cluster_sizes


def cluster_count(rows: int, most: int = QUALITY.max_speakers, per: int = QUALITY.min_cluster) -> int:
    return min(most, max(2, rows // per))


def cluster_speakers(df: DataFrame, embedding: str, least: int = QUALITY.min_cluster, seed: int = 42, out: str = "cluster_speaker_id") -> DataFrame:
    """Rows of clusters with at least ``least`` members, with the cluster's number in ``out``.

    The number of clusters follows the number of rows. Labels are arbitrary. Rows without an embedding
    go out; fewer than two rows form no cluster.
    """
    rows = df.where(F.size(embedding) > 0)
    n = rows.count()
    if n < 2:
        return rows.limit(0).withColumn(out, F.lit(0))
    vectors = rows.withColumn("_features", array_to_vector(F.col(embedding).cast("array<double>")))
    model = KMeans(k=cluster_count(n), seed=seed, featuresCol="_features", predictionCol=out).fit(vectors.select("_features"))
    return cluster_sizes(model.transform(vectors).drop("_features"), out, least)

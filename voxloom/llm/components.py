"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.operators.joins import attach_by_key
from voxloom.storage import cut, discard

MAX_ROUNDS = 60


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """One star operation on edges (u, v), u > v: hang neighbours on each node's smallest neighbour.

    Large star: every larger neighbour of a node goes to the smallest of the node and its neighbours.
    Small star: the node and its smaller neighbours do.
    """
    if small:
        near = edges.select(F.col("u").alias("node"), F.col("v").alias("other"))
    else:
        near = edges.select(F.explode(F.array(
            F.struct(F.col("u").alias("node"), F.col("v").alias("other")),
            F.struct(F.col("v").alias("node"), F.col("u").alias("other")),
        )).alias("x")).select("x.*")
    least = near.groupBy("node").agg(F.min("other").alias("m"), F.count("*").alias("degree"))
    least = cut(least.withColumn("m", F.least("m", "node")))
    moved = attach_by_key(near, least, "node", "degree")
    if small:
        out = moved.select(F.col("other").alias("u"), F.col("m").alias("v")).unionByName(
            least.select(F.col("node").alias("u"), F.col("m").alias("v"))
        )
    else:
        out = moved.where(F.col("other") > F.col("node")).select(F.col("other").alias("u"), F.col("m").alias("v"))
    done = cut(out.where(F.col("u") != F.col("v")).distinct())
    discard(least)
    discard(edges)
    return done


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root): every node of ``links`` with the smallest node of its component.

    Links with a null end are ignored, loops make a component of one, repeats change nothing. The node
    type may be any ordered type. Each round is two grouped minima and two joins, with hubs (a value that
    a third of all records share) handled as hot keys. It ends when every larger end has one link left
    and no smaller end is itself a larger one: then all links point at roots. A round's tables are
    written to the shared folder, deleted once the next is there, and only a number reaches the driver.
    """
    links = links.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    every = cut(links.select(F.col(a).alias("node")).unionByName(links.select(F.col(b).alias("node"))).distinct())
    edges = cut(
        links.where(F.col(a) != F.col(b))
        .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .distinct()
    )
    for _ in range(MAX_ROUNDS):
        ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("up")).unionByName(edges.select(F.col("v").alias("x"), F.lit(0).alias("up")).distinct())
        loose = ends.groupBy("x").agg(F.sum("up").alias("ups"), F.count("*").alias("n")).where((F.col("ups") > 1) | (F.col("ups") == 1) & (F.col("n") > 1))
        if loose.isEmpty():
            break
        edges = _star(_star(edges, small=False), small=True)
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return every.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"))

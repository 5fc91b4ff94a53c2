"""Joins that keep a hot key off a single task, and the reference joins built from key look-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

HOT_KEYS = 1000
MIN_HOT_ROWS = 50_000


def attach_by_key(rows: DataFrame, table: DataFrame, key: str, copies: str, min_hot: int = MIN_HOT_ROWS) -> DataFrame:
    """Inner join of many ``rows`` with a ``table`` of one row per key, exact and safe against hot keys.

    ``table.copies`` tells how many rows carry each key. A key is hot if it has ``min_hot`` rows and at
    least a thousandth of all: there are at most HOT_KEYS of those by construction, so they are
    broadcast; all other keys go through a shuffle in which no key exceeds that share. Null keys match
    nothing. ``rows`` is read twice when hot keys exist, so pass a cheap or cut table.
    """
    size = table.agg(F.sum(copies).alias("all"), F.max(copies).alias("top")).first()
    limit = max(min_hot, -(-(size["all"] or 0) // HOT_KEYS))
    if (size["top"] or 0) < limit:
        return rows.join(table, key)
    hot = F.broadcast(table.where(F.col(copies) >= limit))
    cold = rows.join(hot.select(key), key, "left_anti").join(table.where(F.col(copies) < limit), key)
    return rows.join(hot, key).unionByName(cold)


def attach_unknown(rows: DataFrame, table: DataFrame, key: str, min_hot: int = MIN_HOT_ROWS) -> DataFrame:
    """Inner join of many ``rows`` with a ``table`` of one row per key whose numbers of rows aren't known.

    Rows are first counted by 65,536 buckets of the key's hash, then by key inside buckets that reach the
    limit of ``attach_by_key``, so only there a count per key is shuffled. Hot keys, at most HOT_KEYS by
    construction, meet broadcast rows of the table; all others go through a shuffle. Null keys match
    nothing. ``rows`` is read up to three times, so pass a cheap or cut table.
    """
    bucket = F.pmod(F.xxhash64(key), F.lit(65_536))
    buckets = rows.where(F.col(key).isNotNull()).groupBy(bucket.alias("b")).count()
    limit = F.greatest(F.lit(min_hot), F.ceil(F.sum("count").over(Window.partitionBy()) / HOT_KEYS))
    full = {r["b"]: r["l"] for r in buckets.withColumn("l", limit).where("count >= l").select("b", "l").collect()}
    if not full:
        return rows.join(table, key)
    counts = rows.where(bucket.isin(list(full))).groupBy(key).count()
    hot = [r[key] for r in counts.where(F.col("count") >= max(full.values())).select(key).collect()]
    if not hot:
        return rows.join(table, key)
    is_hot = F.col(key).isin(hot)
    return rows.where(is_hot).join(F.broadcast(table.where(is_hot)), key).unionByName(rows.where(~is_hot).join(table.where(~is_hot), key))


def join_copies(rows: DataFrame, members: DataFrame, key: str, copies: str, member: str, min_hot: int = MIN_HOT_ROWS) -> DataFrame:
    """Inner join in which both sides may repeat a key; ``members.copies`` is the number of its members.

    A key with more members than the limit of ``attach_by_key`` is split: each member falls into one of
    enough parts of about that size, by a hash of ``member``, and every row meets each part. At most
    HOT_KEYS keys are split, so only those are broadcast. ``copies`` is dropped.
    """
    share = max(min_hot, -(-members.count() // HOT_KEYS))
    parts = F.ceil(F.col(copies) / share).cast("int")
    each = members.withColumn("_part", F.pmod(F.xxhash64(member), parts).cast("int"))
    split = members.where(F.col(copies) > share).groupBy(key).agg(F.max(parts).alias("_parts"))
    spread = rows.join(F.broadcast(split), key, "left").withColumn("_parts", F.coalesce("_parts", F.lit(1)))
    spread = spread.withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts")
    return spread.join(each.drop(copies), [key, "_part"]).drop("_part")


def left_default(df: DataFrame, other: DataFrame, key: str, defaults: dict[str, object]) -> DataFrame:
    """Left join on ``key``, with defaults where the other side has no row or null. One row per key there."""
    j = df.join(other.select(key, *defaults), key, "left")
    return j.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in defaults.items()})


def first_reference(df: DataFrame, refs: DataFrame, key: str, order: str) -> DataFrame:
    """Left join with the first reference row of each key in ``order``, as ref_* columns."""
    fields = [c for c in refs.columns if c != key]
    first = refs.groupBy(key).agg(F.min_by(F.struct(*fields), F.col(order)).alias("_r"))
    return df.join(first, key, "left").select(df["*"], *[F.col(f"_r.{c}").alias(f"ref_{c}") for c in fields])


def prefix_matches(titles: DataFrame, title: str, files: DataFrame, name: str) -> DataFrame:
    """(title, name): the first file, by name, that starts with the title and '_'; null if none does.

    Every file name has few '_'-ended prefixes, so these are exploded and joined by equality; no pair of
    title and file is compared otherwise.
    """
    at = F.filter(F.sequence(F.lit(1), F.length(name)), lambda i: F.substring(F.col(name), i, F.lit(1)) == "_")
    prefixes = files.where(F.length(name) > 0).select(F.explode(F.transform(at, lambda i: F.substring(F.col(name), F.lit(1), i - 1))).alias(title), F.col(name))
    first = prefixes.groupBy(title).agg(F.min(name).alias(name))
    return titles.select(title).distinct().join(first, title, "left")


def title_lookup(wanted: DataFrame, name: str, books: DataFrame, title: str, order: str) -> DataFrame:
    """(name, title): exact title, else the first title in ``order`` that contains the name; '' if none does.

    Only names without an exact match are compared with titles, and both are distinct first; the side of
    titles is the catalogue of books, not the records.
    """
    names = wanted.select(name).where(F.col(name).isNotNull()).distinct()
    catalogue = books.groupBy(title).agg(F.min(order).alias("_o"))
    exact = names.join(catalogue.select(F.col(title).alias(name)), name, "left_semi").withColumn(title, F.col(name))
    rest = names.join(catalogue.select(F.col(title).alias(name)), name, "left_anti")
    part = rest.join(catalogue, F.col(title).contains(F.col(name)), "left").groupBy(name).agg(F.coalesce(F.min_by(title, "_o"), F.lit("")).alias(title))
    return exact.unionByName(part)


def paired_similarity(vectors: DataFrame, pairs: DataFrame, vec_id: str, vec: str, a: str, b: str) -> DataFrame:
    """pairs plus similarity of their two vectors; pairs with a missing vector go out."""
    from voxloom.functions.metrics import cosine

    left = vectors.select(F.col(vec_id).alias(a), F.col(vec).alias("_va"))
    right = vectors.select(F.col(vec_id).alias(b), F.col(vec).alias("_vb"))
    return pairs.join(left, a).join(right, b).withColumn("similarity", cosine(F.col("_va"), F.col("_vb"))).drop("_va", "_vb")

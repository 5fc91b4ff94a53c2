"""Duplicates hidden by formatting: collapse raw rows, canonicalise survivors, group on the full form."""

from __future__ import annotations

import json
from collections.abc import Callable
from decimal import Decimal

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.llm.text import digest, squeezed, words
from voxloom.operators.joins import attach_by_key
from voxloom.storage import cut

MIN_WORDS = 6
_NOT_WORD = regex.compile(r"[^\p{L}\p{N}]+")


def canonical_texts(distinct: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(key, raw) to (key, canon): letters and digits in lower case; null for texts under ``min_words`` words."""
    enough = F.size(words(F.col("raw"))) >= min_words
    return distinct.select("key", F.when(enough, squeezed(F.col("raw"))).alias("canon"))


def _value(v):
    """A JSON value as text in which equal values look equal: 5, 5.0 and 5e0 are one number, true is none."""
    if isinstance(v, dict):
        return "{" + ",".join(f"{json.dumps(k)}:{_value(v[k])}" for k in sorted(v)) + "}"
    if isinstance(v, list):
        return "[" + ",".join(map(_value, v)) + "]"
    if isinstance(v, (int, Decimal)) and not isinstance(v, bool):
        sign, digits, exponent = Decimal(v).as_tuple()
        text = "".join(map(str, digits)).lstrip("0")
        kept = text.rstrip("0")  # every digit is kept, however long the number
        return f"{'-' * sign}{kept}e{exponent + len(text) - len(kept)}" if kept else "0"
    return json.dumps(v, ensure_ascii=False)


def _no_constant(name: str):
    raise ValueError(name)


def canonical_line(line: str, text_field: str = "text") -> str | None:
    """Canonical form of a JSON object line, or None if it isn't valid JSON.

    Field order, spacing, escaping and number spelling are disregarded; the text field is compared by
    its letters and digits. A missing field differs from null.
    """
    try:
        obj = json.loads(line, parse_float=Decimal, parse_int=Decimal, parse_constant=_no_constant)
    except (ValueError, RecursionError, ArithmeticError):
        return None
    if not isinstance(obj, dict):
        return None
    if isinstance(obj.get(text_field), str):
        obj[text_field] = _NOT_WORD.sub("", obj[text_field].lower())
    return _value(obj)


def canonical_lines(distinct: DataFrame) -> DataFrame:
    """(key, raw) to (key, canon) for JSON lines; null for broken lines."""

    def run(batches):
        for b in batches:
            yield pd.DataFrame({"key": b["key"], "canon": pd.Series([canonical_line(x) for x in b["raw"]], dtype=object)})

    return distinct.mapInPandas(run, "key binary, canon string")


def groups(df: DataFrame, id_col: str, raw: str, canonical: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(members, forms, merged) of rows whose ``raw`` values have one canonical form.

    members: key, id, one row per distinct (id, raw). forms: key, canon, first_id, same, one row per
    distinct raw value with the number of its rows; canon is null for values that ``canonical`` can't
    compare. merged: canon, group_id (smallest id), copies, variants (distinct raw values), one row per
    canonical form.

    Byte-identical values are collapsed and counted first (partial aggregation makes a value that holds
    a third of all rows cheap); only distinct survivors are canonicalised, and those are grouped on the
    full canonical text. Null values are in none of the three. Repeated rows count once; other columns
    are not read.
    """
    rows = df.where(F.col(raw).isNotNull()).select(F.col(id_col).alias("id"), F.col(raw).alias("raw"))
    rows = rows.withColumn("key", digest(F.col("raw")))
    members = cut(rows.select("key", "id").distinct())
    counted = members.groupBy("key").agg(F.min("id").alias("first_id"), F.count("*").alias("same"))
    distinct = rows.groupBy("key").agg(F.first("raw").alias("raw"))
    forms = cut(canonical(distinct).join(counted, "key"))
    merged = forms.where(F.col("canon").isNotNull()).groupBy("canon").agg(
        F.min("first_id").alias("group_id"), F.sum("same").alias("copies"), F.count("*").alias("variants")
    )
    return members, forms, merged


def copies_of(df: DataFrame, id_col: str, raw: str, canonical: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(id_a, id_b): one row per copy except the smallest id of its group, which is id_a.

    Only values with a canonical form have copies here. Both joins back, from groups to raw values and
    from raw values to rows, are safe against a group or a value that holds a third of all rows.
    """
    members, forms, merged = groups(df, id_col, raw, canonical)
    several = cut(merged.where(F.col("copies") > 1).select(digest(F.col("canon")).alias("form"), "group_id", "variants"))
    by_raw = forms.where(F.col("canon").isNotNull()).select("key", "same", digest(F.col("canon")).alias("form"))
    table = cut(attach_by_key(by_raw, several, "form", "variants").select("key", "same", "group_id"))
    out = attach_by_key(members, table, "key", "same").where(F.col("id") != F.col("group_id"))
    return out.select(F.col("group_id").alias("id_a"), F.col("id").alias("id_b")).distinct()


def collapsed(df: DataFrame, id_col: str, raw: str, canonical: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(id, copies): every record once, each group under its smallest id with the number of its copies.

    A value without a canonical form (a text of too few words, a broken line) is a group of its exact
    copies; a row whose value is null is a group of one.
    """
    _, forms, merged = groups(df, id_col, raw, canonical)
    exact = forms.where(F.col("canon").isNull()).select(F.col("first_id").alias("id"), F.col("same").alias("copies"))
    empty = df.where(F.col(raw).isNull()).select(F.col(id_col).alias("id")).distinct().withColumn("copies", F.lit(1).cast("long"))
    return merged.select(F.col("group_id").alias("id"), "copies").unionByName(exact).unionByName(empty)

"""Word and canonical forms shared by the operators on text; all JVM-side expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}]+"
NOT_WORD = r"[^\p{L}\p{N}]+"


def words(text: Column) -> Column:
    """The runs of letters and digits of ``text`` in lower case; null gives null, '' an empty array."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def squeezed(text: Column) -> Column:
    """Letters and digits in lower case, everything else removed; null stays null."""
    return F.regexp_replace(F.lower(text), NOT_WORD, "")


def digest(text: Column) -> Column:
    """16-byte key of a string (MD5), for joins that would otherwise carry the text."""
    return F.unhex(F.md5(text.cast("binary")))

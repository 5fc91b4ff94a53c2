"""Text functions as column expressions.

Character classes are spelled out, because the engine's own word and space classes differ between
regular-expression dialects; the same strings serve the SQL oracles.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space as Python's str.split sees it; word characters; the Georgian blocks.
SPACE = r"\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
WORD = r"\p{L}\p{N}_"
GEORGIAN = r"\x{10a0}-\x{10ff}\x{2d00}-\x{2d2f}"
NOT_TEXT = rf"[^{WORD}{SPACE}]"
HEADING = r"(?m)^#+[\t-\r\x{1c}-\x{20}]+"
SENTENCE_END = r"[.!?;:…]$"


def stripped(c: Column) -> Column:
    return F.regexp_replace(c, rf"^[{SPACE}]+|[{SPACE}]+$", "")


def collapsed(c: Column) -> Column:
    """White space runs as one space, none at the ends."""
    return F.trim(F.regexp_replace(c, rf"[{SPACE}]+", " "))


def norm_eval(c: Column) -> Column:
    """Punctuation out, white space collapsed; letter case stays."""
    return collapsed(F.regexp_replace(c, NOT_TEXT, ""))


def norm_book(c: Column) -> Column:
    """``norm_eval`` after removal of Markdown heading marks."""
    return norm_eval(F.regexp_replace(c, HEADING, ""))


def bare_word(c: Column) -> Column:
    return F.regexp_replace(c, rf"[^{WORD}]", "")


def tokens(c: Column) -> Column:
    """Words between white space; no empty ones."""
    return F.filter(F.split(collapsed(c), " "), lambda w: w != "")


def script_ratio(c: Column, block: str = GEORGIAN) -> Column:
    """Share of letters that lie in ``block``; 0.0 without letters."""
    letters = F.regexp_replace(c, r"[^\p{L}]", "")
    inside = F.length(F.regexp_replace(letters, rf"[^{block}]", ""))
    return F.when(F.length(letters) > 0, inside / F.length(letters)).otherwise(F.lit(0.0))


def repeated_chars(c: Column, most: int = 4) -> Column:
    """Some character other than a line feed stands more than ``most`` times in a row."""
    return c.rlike(rf"(?d)(.)\1{{{most},}}")


def repeated_words(c: Column, most: int = 3) -> Column:
    """Some word stands more than ``most`` times in a row."""
    w = tokens(c)
    at = F.sequence(F.lit(1), F.greatest(F.size(w) - most, F.lit(1)))
    same = F.exists(at, lambda i: F.size(F.array_distinct(F.slice(w, i, most + 1))) == 1)
    return (F.size(w) > most) & same


def ends_sentence(c: Column) -> Column:
    return c.rlike(SENTENCE_END)


def segment_number(c: Column) -> Column:
    """Number after the last 'seg_', -1 where there is none."""
    return F.coalesce(F.regexp_extract(c, r"(?s)^.*seg_([0-9]{1,9})$", 1).try_cast("int"), F.lit(-1))


def stem(path: Column) -> Column:
    """File name without folder and last extension."""
    return F.regexp_replace(base_name(path), r"(?<=.)\.[^.]*$", "")


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def safe_id(c: Column, most: int = 80, squeeze: bool = True) -> Column:
    """Other than word characters become '_'; with ``squeeze`` runs collapse and the ends are trimmed."""
    out = F.regexp_replace(c, rf"[^{WORD}]", "_")
    if squeeze:
        out = F.regexp_replace(F.regexp_replace(out, "_+", "_"), "^_|_$", "")
    return F.substring(out, 1, most)


def narrator(path: Column) -> Column:
    """Last part of a file stem of at least three '_' parts, else 'unknown'."""
    parts = F.split(stem(path), "_")
    return F.when(F.size(parts) >= 3, F.element_at(parts, -1)).otherwise(F.lit("unknown"))


def char_ngrams(c: Column, n: int = 8) -> Column:
    """Character n-grams at a stride of half their length; a shorter text is its only one, '' has none."""
    last = F.length(c) - n + 1
    grams = F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1)), F.lit(max(n // 2, 1))), lambda i: F.substring(c, i, F.lit(n)))
    return F.when(last >= 1, grams).otherwise(F.when(F.length(c) > 0, F.array(c)).otherwise(F.array().cast("array<string>")))


def absolute(path: Column, base: str) -> Column:
    return F.when(path.startswith("/"), path).otherwise(F.concat(F.lit(base.rstrip("/") + "/"), path))


def first_filled(*columns: Column) -> Column:
    """First value that is neither null nor ''."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns], F.lit(""))


def unknown_chars(c: Column, vocabulary: list[str]) -> Column:
    """Distinct characters of a text that a vocabulary lacks, sorted."""
    chars = F.filter(F.split(c, ""), lambda x: x != "")
    return F.array_sort(F.array_except(chars, F.array(*[F.lit(v) for v in vocabulary])))

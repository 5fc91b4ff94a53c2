"""Error rates, similarities and summary statistics as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from voxloom.functions.text import collapsed, norm_eval, stripped, tokens


def _rate(ref: Column, hyp: Column, size: Column) -> Column:
    """Edits over ``size``; an empty reference counts 1 against any hypothesis and 0 against an empty one."""
    empty = F.when(F.length(hyp) > 0, F.lit(1.0)).otherwise(F.lit(0.0))
    return F.when(F.length(ref) > 0, F.levenshtein(ref, hyp) / size).otherwise(empty)


def cer_verify(ref: Column, hyp: Column) -> Column:
    """White space collapsed, punctuation counts; over the reference's length."""
    r, h = collapsed(ref), collapsed(hyp)
    return _rate(r, h, F.length(r))


def cer_eval(ref: Column, hyp: Column) -> Column:
    """Both sides normalised; over the reference's length, so it may exceed 1."""
    r, h = norm_eval(ref), norm_eval(hyp)
    return _rate(r, h, F.length(r))


def cer_plain(ref: Column, hyp: Column) -> Column:
    """Only the ends are stripped."""
    r, h = stripped(ref), stripped(hyp)
    return _rate(r, h, F.length(r))


def cer_raw(ref: Column, hyp: Column) -> Column:
    """Inputs taken as they are; over the reference's length."""
    return _rate(ref, hyp, F.length(ref))


def cer_bounded(ref: Column, hyp: Column) -> Column:
    """Over the longer side: between 0 and 1."""
    return _rate(ref, hyp, F.greatest(F.length(ref), F.length(hyp)))


def word_cer(a: Column, b: Column) -> Column:
    """Lower-cased words over the longer one; two empty words are equal."""
    a, b = F.lower(a), F.lower(b)
    size = F.greatest(F.length(a), F.length(b))
    return F.when(size > 0, F.levenshtein(a, b) / size).otherwise(F.lit(0.0))


def word_edits(ref_words: Column, hyp_words: Column) -> Column:
    """Word-level edit distance without a UDF: every distinct word of the pair becomes one character.

    Characters start at U+4E00, so up to 35,000 distinct words a pair stay clear of the surrogates. The
    words are bound as a lambda variable, else they would be derived anew for every word.
    """
    pair = F.struct(ref_words.alias("r"), hyp_words.alias("h"), F.array_distinct(F.concat(ref_words, hyp_words)).alias("v"))

    def encoded(side: Column, words: Column) -> Column:
        code = F.transform(side, lambda w: F.decode(F.unhex(F.lpad(F.hex(F.array_position(words, w) + 19967), 4, "0")), "UTF-16BE"))
        return F.array_join(code, "")

    return F.transform(F.array(pair), lambda p: F.levenshtein(encoded(p["r"], p["v"]), encoded(p["h"], p["v"])))[0]


def wer(ref: Column, hyp: Column) -> Column:
    """Word edits of the normalised texts over the reference's words; empty references as for CER."""
    def rate(p: Column) -> Column:
        empty = F.when(F.size(p["h"]) > 0, F.lit(1.0)).otherwise(F.lit(0.0))
        return F.when(F.size(p["r"]) > 0, word_edits(p["r"], p["h"]) / F.size(p["r"])).otherwise(empty)

    sides = F.struct(tokens(norm_eval(ref)).alias("r"), tokens(norm_eval(hyp)).alias("h"))
    return F.transform(F.array(sides), rate)[0]


def dot(a: Column, b: Column) -> Column:
    zero = F.lit(0.0)
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), zero, lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of numeric arrays; null for a zero vector."""
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def crossfade(a: Column, b: Column, n: int) -> Column:
    """Join two arrays, blending the last ``n`` of the first linearly into the first ``n`` of the second.

    The weights run from 1 to 0 and 0 to 1, both ends included (one sample keeps the first side). With
    ``n`` <= 0 or a side shorter than ``n`` the arrays are only concatenated.
    """
    if n <= 0:
        return F.concat(a, b)
    tail, head = F.slice(a, F.greatest(F.size(a) - n + 1, F.lit(1)), F.lit(n)), F.slice(b, F.lit(1), F.lit(n))
    ramp = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: i / F.lit(float(max(n - 1, 1))))
    out = F.zip_with(tail, ramp, lambda x, w: x * (1 - w))
    into = F.zip_with(head, ramp, lambda x, w: x * w)
    mixed = F.zip_with(out, into, lambda x, y: x + y)
    body = F.slice(a, F.lit(1), F.greatest(F.size(a) - n, F.lit(0)))
    rest = F.slice(b, F.lit(n + 1), F.greatest(F.size(b) - n, F.lit(0)))
    return F.when((F.size(a) >= n) & (F.size(b) >= n), F.concat(body, mixed, rest)).otherwise(F.concat(a, b))


def moments(x: Column) -> list[Column]:
    """mean, population deviation, min, max, n of a metric."""
    return [F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"), F.min(x).alias("min"), F.max(x).alias("max"), F.count(x).alias("n")]

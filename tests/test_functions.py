"""Text and metric functions against plain Python."""

import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxloom.functions import metrics as M
from voxloom.functions import text as T
from voxloom.functions.compress import compression_ratio
from voxloom.functions.hashing import hash_split, md5_fraction
from voxloom.operators import align

TEXTS = [
    "", " ", "გამარჯობა, მსოფლიო!", "## თავი 1\nტექსტი — აქ", "a  b\t c d e", "ааааа", "aaaa", "aaaaa", "da da da", "da da da da", "x_y z-1 ½ ²",
    "\x1c sep \x1f", "Mixed ქართული text", "12345", "🎧🎧🎧🎧🎧", "ერთი. ორი…", "né é é", "one\ntwo\n\n\n\n\nthree",
]
from voxloom.operators.aggs import metric_summary
from voxloom.operators.quantiles import UPPER, quantiles


def column(spark, values, *cols, schema="a string"):
    rows = [v if isinstance(v, tuple) else (v,) for v in values]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"i int, {schema}")
    return [tuple(r)[1:] for r in df.select("i", *cols).orderBy("i").collect()]


def norm(t):
    return re.sub(r"\s+", " ", re.sub(r"[^\w\s]", "", t)).strip()


def test_text_functions(spark):
    a = F.col("a")
    got = column(spark, TEXTS, T.norm_eval(a), T.norm_book(a), T.bare_word(a), T.repeated_chars(a), T.repeated_words(a), T.script_ratio(a), T.tokens(a), T.ends_sentence(a))
    for t, (n, b, w, rc, rw, ratio, toks, ends) in zip(TEXTS, got):
        letters = [c for c in t if c.isalpha()]
        words = t.split()
        assert n == norm(t) and b == norm(re.sub(r"^#+\s+", "", t, flags=re.M)) and w == re.sub(r"[^\w]", "", t)
        assert rc == bool(re.search(r"(.)\1{4,}", t)) and toks == words
        assert rw == any(len(set(words[i : i + 4])) == 1 for i in range(len(words) - 3))
        assert ratio == (sum("Ⴀ" <= c <= "ჿ" for c in letters) / len(letters) if letters else 0.0)
        assert ends == bool(re.search(r"[.!?;:…]$", t))


def test_nulls_give_nulls(spark):
    a = F.col("a")
    assert column(spark, [None], T.norm_eval(a), T.bare_word(a), M.cer_eval(a, a), F.size(T.char_ngrams(a)))[0][:2] == (None, None)
    assert column(spark, [None], compression_ratio("a"), md5_fraction(a), hash_split(a, 0.5, "x", "y")) == [(None, None, None)]


def test_ids_and_paths(spark):
    a = F.col("a")
    ids = ["book__seg_00012", "seg_7_seg_x", "plain", "a__seg_", "b__seg_-3"]
    assert [r[0] for r in column(spark, ids, T.segment_number(a))] == [12, -1, -1, -1, -1]
    paths = ["x/y/Title_Part_Voice.wav", "one_two.wav", "noext", "a.b/c.d.e"]
    assert column(spark, paths, T.stem(a), T.narrator(a)) == [("Title_Part_Voice", "Voice"), ("one_two", "unknown"), ("noext", "unknown"), ("c.d", "unknown")]
    assert column(spark, [" A--b!! "], T.safe_id(a), T.safe_id(a, 4, squeeze=False)) == [("A_b", "_A__")]
    assert column(spark, ["abcdefghij", "abc"], T.char_ngrams(a, 4)) == [(["abcd", "cdef", "efgh", "ghij"],), (["abc"],)]


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(prev + (x != y), row[j] + 1, row[j - 1] + 1)
    return row[-1]


def test_error_rates(spark):
    rng = random.Random(7)
    words = ["ერთი", "ორი,", "three", "сон", "a", "b."]
    pairs = [(" ".join(rng.choices(words, k=rng.randrange(0, 9))), " ".join(rng.choices(words, k=rng.randrange(0, 9)))) for _ in range(60)]
    a, b = F.col("a"), F.col("b")
    got = column(spark, pairs, M.cer_verify(a, b), M.cer_eval(a, b), M.cer_plain(a, b), M.cer_bounded(a, b), M.wer(a, b), M.word_cer(a, b), schema="a string, b string")
    def rate(r, h, n=None):
        return (levenshtein(r, h) / (n or len(r))) if r else float(bool(h))
    for (x, y), (cv, ce, cp, cb, w, wc) in zip(pairs, got):
        r, h = norm(x), norm(y)
        assert cv == pytest.approx(rate(" ".join(x.split()), " ".join(y.split()))) and ce == pytest.approx(rate(r, h)) and cp == pytest.approx(rate(x.strip(), y.strip()))
        assert cb == pytest.approx(rate(x, y, max(len(x), len(y)))) and w == pytest.approx(rate(r.split(), h.split()))
        assert wc == pytest.approx(levenshtein(x.lower(), y.lower()) / max(len(x), len(y), 1))
        assert align.edits(x, y) == levenshtein(x, y)


def test_vectors_and_summaries(spark):
    rng = np.random.default_rng(1)
    u, v = rng.normal(size=(2, 9))
    df = spark.createDataFrame([([float(x) for x in u], [float(x) for x in v])], "u array<double>, v array<double>")
    assert df.select(M.cosine(F.col("u"), F.col("v"))).first()[0] == pytest.approx(u @ v / math.sqrt(u @ u) / math.sqrt(v @ v))
    assert df.select(M.cosine(F.col("u"), F.array(*[F.lit(0.0)] * 9))).first()[0] is None
    for n in (0, 1, 3, 9, 10):
        ramp = np.linspace(1, 0, n) if n > 1 else np.ones(n)
        want = np.concatenate([u, v]) if n <= 0 or n > 9 else np.concatenate([u[:-n], u[-n:] * ramp + v[:n] * (1 - ramp), v[n:]])
        assert df.select(M.crossfade(F.col("u"), F.col("v"), n)).first()[0] == pytest.approx(list(want))
    for values in ([3.0, 1.0, 2.0, 2.5], [5.0], [1.0, None, 9.0, 4.0]):
        x = sorted(y for y in values if y is not None)
        df = spark.createDataFrame([(y,) for y in values], "x double")
        r = metric_summary(df, "x").first()
        assert quantiles(df, "x", {"up": UPPER}).first()[0] == x[len(x) // 2]
        assert [r[k] for k in ("mean", "median", "std", "p90", "min", "max", "n")] == pytest.approx([np.mean(x), np.median(x), np.std(x), np.percentile(x, 90), x[0], x[-1], len(x)])


def test_compression_ratio(spark):
    got = [r[0] for r in column(spark, TEXTS, compression_ratio("a"))]
    assert got == [len(t.encode()) / len(zlib.compress(t.encode())) if t else 0.0 for t in TEXTS]


def test_quantiles_by_key(spark):
    rng = np.random.default_rng(4)
    rows = [(k, float(v)) for k, n in (("a", 500), ("b", 7), (None, 30)) for v in rng.integers(0, 40, n)] + [("a", 3.0)] * 400 + [("c", None), ("a", None)]
    df = spark.createDataFrame(rows, "k string, x double").repartition(5)
    got = {r["k"]: r for r in quantiles(df, "x", {"q": 0.25, "p": 0.9, "up": UPPER}, "k").collect()}
    assert set(got) == {"a", "b", None}
    for k, r in got.items():
        x = sorted(v for j, v in rows if j == k and v is not None)
        assert (r["q"], r["p"], r["up"]) == pytest.approx((np.percentile(x, 25), np.percentile(x, 90), x[len(x) // 2]))
    assert quantiles(df.limit(0), "x", {"q": 0.5}).collect()[0]["q"] is None and quantiles(df.limit(0), "x", {"q": 0.5}, "k").count() == 0
    summary = {r["k"]: r for r in metric_summary(df, "x", "k").collect()}
    assert summary["c"]["n"] == 0 and summary["c"]["median"] is None and summary[None]["n"] == 30

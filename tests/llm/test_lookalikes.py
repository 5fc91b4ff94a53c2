import random

import pytest

from voxloom.llm import lookalikes as la
from voxloom.llm.lookalikes import ScriptModel


@pytest.fixture(scope="module")
def model(spark):
    texts = ["Kestrion Peroluxის Milvento caxe", "Бурлянец пастырь сорока Кобрений", None, "", "ერთი ორი", "Κόσμος", "Kеstrion"]
    return la.train(spark.createDataFrame([(t,) for t in texts], "t string"), "t")


@pytest.mark.parametrize("text,form", [
    (None, None), ("", ""), ("ერთი — „ორი“… 🎧 Café сорока", "ერთი — „ორი“… 🎧 Café сорока"),
    ("Ｋｅｓｔｒｉｏｎ１！", "Kestrion1!"), ("Café", "Café"), ("ერ​თი­ა﻿", "ერთია"), ("a b c　d\te", "a b c d e"),
    ("Kеstriоnის", "Kestrionის"), ("Бурлянeц", "Бурлянец"), ("Wеndarо", "Wendaro"), ("Κestriοn", "Kestrion"),
    ("Windowsში თავი Ⅱ", "Windowsში თავი II"), ("👩‍👧 ❤️", "👩‍👧 ❤️"), ("Zorандия", "Zorандия"),
    ("Ꮶestrionის", "Kestrionის"), ("ꓗestrion", "Kestrion"), ("Kestriⲟn", "Kestrion"), ("Kestrioո", "Kestrion"), ("Ꮇilvento", "Milvento"),
])
def test_forms(model, text, form):
    assert model.consistent(text) == form
    assert model.consistent(form) == form


def test_whole_column_and_empty_table(spark, model):
    df = spark.createDataFrame([(1, "Ａ", "x"), (2, None, "y"), (3, "a" * 100_000 + "​", "z")], "id long, text string, form0 string")
    rows = {r["id"]: r["form"] for r in la.with_consistent(df, "text", model).collect()}
    assert rows == {1: "A", 2: None, 3: "a" * 100_000}
    empty = la.train(df.limit(0), "text")
    assert isinstance(empty, ScriptModel) and la.with_consistent(df.limit(0), "text", empty).count() == 0
    assert empty.consistent("Kеy") in ("Key", "Kеy")


def test_large_alphabets_keep_trigrams(spark):
    rng = random.Random(3)
    signs = [chr(0x4E00 + i) for i in range(400)]
    texts = ["b" + "".join(rng.choices(signs, k=1000)) for _ in range(400)]  # some 400,000 trigrams
    texts += ["cape " * 5, "сох хсах хархо хрех хе " * 5000]  # bigrams speak for Cyrillic, trigrams for Latin
    df = spark.createDataFrame([(t,) for t in [*texts, "саpе"]], "t string").repartition(4)
    got = la.with_consistent(df, "t", la.train(df, "t")).where("t = 'саpе'").first()
    assert got["form"] == "cape"

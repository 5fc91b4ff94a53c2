"""Filters, windows, folds, alignment, splits and joins on small fixtures with every edge."""

import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from voxloom.operators import aggs, align, filters, folds, joins, splits, windows
from voxloom.plans import corpus


def chunk_reason(text, cer, seconds):
    text, seconds = text or "", seconds or 0.0
    letters = [c for c in text if c.isalpha()]
    ratio = sum("Ⴀ" <= c <= "ჿ" for c in letters) / len(letters) if letters else 0.0
    words, raw = text.split(), text.encode()
    comp = len(raw) / len(zlib.compress(raw)) if raw else 0.0
    if len(text.strip()) < 5:
        return "empty_text"
    if cer is not None and cer > 0.2:
        return f"high_cer:{cer:.3f}"
    if ratio < 0.8:
        return f"low_georgian:{ratio:.2f}"
    if seconds > 0 and len(text) / seconds < 3:
        return f"low_cps:{len(text) / seconds:.1f}"
    if seconds > 0 and len(text) / seconds > 25:
        return f"high_cps:{len(text) / seconds:.1f}"
    if comp > 3.5:
        return f"high_compression:{comp:.2f}"
    if re.search(r"(.)\1{4,}", text):
        return "repeated_chars"
    return "repeated_words" if any(len(set(words[i : i + 4])) == 1 for i in range(len(words) - 3)) else "ok"


def test_chunk_cascade(spark):
    rows = [
        (1, None, 0.0, 3.0), (2, "    ", 0.0, 3.0), (3, "ქართ", 0.0, 1.0), (4, "ქართუ", 0.2, 1.0), (5, "ქართული", 0.2001, 1.0), (6, "latin text", 0.0, 2.0),
        (7, "ქართული ტექსტი", None, 0.0), (8, "ქართული ტექსტი", 0.1, None), (9, "ქართული ტექსტი", 0.1, 100.0), (10, "ქართული ტექსტი", 0.1, 0.1),
        (11, "აბ " * 200, 0.1, 60.0), (12, "ააააა ქართული", 0.1, 2.0), (13, "კი კი კი კი არა", 0.1, 2.0), (14, "კი კი კი არა", 0.1, 2.0),
    ]
    df = spark.createDataFrame(rows, "id int, text string, cer double, seconds double").withColumn("tag", F.lit("old"))
    got = {r["id"]: (r["reason"], r["tag"]) for r in filters.with_chunk_reason(df, "text", "cer", "seconds").collect()}
    want = {i: chunk_reason(t, c, s) for i, t, c, s in rows}
    assert {i: r for i, (r, _) in got.items()} == want and all(t == r.split(":")[0] for r, t in got.values())
    assert filters.with_chunk_reason(df.limit(0), "text", "cer", "seconds").count() == 0


def test_bounds_are_inclusive(spark):
    rows = [(x,) for x in (None, float("nan"), 0.0, 0.5, 0.4999, 1.5, 30.0, 30.0001, 44.0, 44.1)]
    df = spark.createDataFrame(rows, "s double")
    got = [tuple(r) for r in df.select(filters.standard_reason(F.col("s")), filters.chunk_length_ok(F.col("s"))).collect()]
    assert got == [
        ("dropped_error", None), ("dropped_error", False), ("dropped_short", False), ("ok", False), ("dropped_short", False), ("ok", True), ("ok", True),
        ("dropped_long", True), ("dropped_long", True), ("dropped_long", False),
    ]
    seg = spark.createDataFrame([("ა" * 10, 3.0), ("ა" * 9, 3.0), ("ა" * 90, 27.5), ("ა" * 90, 27.6), ("a" * 20, 5.0), ("ა" * 10, 2.9), ("ა" * 400, 10.0)], "t string, s double")
    assert [r[0] for r in seg.select(filters.segment_reason(F.col("t"), F.col("s"))).collect()] == ["ok", "short_text", "ok", "long_duration", "low_georgian", "short_duration", "high_cps"]


def test_iqr(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate([1.0, 2.0, 3.0, 4.0, 100.0, None])], "id int, x double")
    assert sorted(r["id"] for r in filters.iqr_keep(df, "x").collect()) == [0, 1, 2, 3]
    none = df.withColumn("x", F.lit(None).cast("double"))
    assert filters.iqr_keep(none, "x").count() == 6 and filters.iqr_keep(df.limit(0), "x").count() == 0


def test_prep_edges(spark):
    t = "x" * 40
    rows = [(f"b__seg_{i:05d}", "b", t, 4.0) for i in range(8)] + [("odd", "b", t, 4.0), ("s__seg_00001", "s", t, 4.0), ("n__seg_00000", None, t, 4.0)]
    rows += [("z__seg_1", "z", "ab", None), ("y__seg_1", "y", None, 5.0)]
    df = spark.createDataFrame(rows, "id string, book_title string, text string, duration double").withColumn("segs", F.lit(1))
    got = {r["id"]: r["reason"] for r in filters.with_prep_reason(df.drop("segs"), "id", "book_title", "text", "duration").collect()}
    assert [got[f"b__seg_{i:05d}"] for i in range(8)] == ["intro_clip"] * 3 + ["ok"] * 2 + ["outro_clip"] * 3
    assert got["odd"] == "ok" and got["s__seg_00001"] == got["n__seg_00000"] == "intro_clip" and got["z__seg_1"] == "too_short" and got["y__seg_1"] == "empty_text"


def test_routes_and_index(spark):
    rows = [("1", "A", True, False), ("2", "A, B", True, False), ("3", "H", True, None), ("4", None, True, False), ("5", "B", None, False), ("6", "A", True, True), ("7", "B", True, False)]
    df = spark.createDataFrame(rows, "id string, speaker_id string, has_punctuation boolean, multi_speaker boolean")
    got = {r["id"]: (r["route"], r["speaker_index"]) for r in corpus.route_experiment(df, "H").collect()}
    assert got["2"][0] == "multi_speaker" and got["3"] == ("holdout", None) and got["5"] == ("not_punctuated", 6) and got["6"] == ("multi_speaker", 5)
    assert got["1"][1] == 5 and got["4"][0] in ("train", "val")


def sequential_islands(rows, gap):
    out, last = [], None
    for s, e in rows:
        if last is None or not s - last < gap:
            out.append([s, e])
        else:
            out[-1][1] = e
        last = e
    return [tuple(x) for x in out]


@pytest.mark.parametrize("chunk_rows", [1, 4, 1000])
def test_gap_merge(spark, chunk_rows):
    rng = random.Random(chunk_rows)
    rows = [(rng.choice("aab"), round(rng.uniform(0, 60), 1), i) for i in range(60)]
    rows = [(k, s, round(s + rng.choice([0.2, 0.5, 3.0]), 1), i) for k, s, i in rows] + [("c", 1.0, 2.0, 100), ("c", 2.3, 3.0, 101)]
    df = spark.createDataFrame(rows, "k string, s double, e double, id int")
    i = windows.islands(df, "k", ["s", "e", "id"], "s", "e", 0.3, chunk_rows)
    got = defaultdict(list)
    for r in i.groupBy("k", "island").agg(F.min_by("s", "rank_in_key").alias("s"), F.max_by("e", "rank_in_key").alias("e")).orderBy("k", "island").collect():
        got[r["k"]].append((r["s"], r["e"]))
    by_key = defaultdict(list)
    for k, s, e, n in sorted(rows, key=lambda r: (r[1], r[2], r[3])):
        by_key[k].append((s, e))
    assert got == {k: sequential_islands(v, 0.3) for k, v in by_key.items()}


def test_bounded_merge_and_absorption(spark):
    rows = [("a", 0.0, 10.0), ("a", 11.0, 20.0), ("a", 21.0, 36.0), ("a", 38.0, 39.0), ("a", 50.0, 51.0), ("b", 0.0, 1.0), ("b", 3.0, 40.0), ("c", None, 1.0)]
    df = spark.createDataFrame(rows, "k string, start_sec double, end_sec double")
    m = sorted(tuple(r) for r in folds.bounded_merge(df, "k").collect())
    assert m == [("a", 0.0, 20.0, 2), ("a", 21.0, 36.0, 1), ("a", 38.0, 39.0, 1), ("a", 50.0, 51.0, 1), ("b", 0.0, 1.0, 1), ("b", 3.0, 40.0, 1)]
    absorbed = sorted(tuple(r) for r in corpus.chunk_recordings(df, "k").collect())
    assert absorbed == [("a", 0.0, 20.0), ("a", 21.0, 51.0), ("b", 0.0, 1.0), ("b", 3.0, 40.0)]
    assert sorted(tuple(r) for r in folds.remerge(df.where("k = 'a'"), "k").collect()) == [("a", 0.0, 20.0, 2), ("a", 21.0, 51.0, 3)]
    assert folds.bounded_merge(df.limit(0), "k").count() == 0


def words(*spec, chunk=0):
    return [("r", chunk, i, w, s, e, 1.0) for i, (w, s, e) in enumerate(spec)]


def test_sentence_segments(spark):
    rows = words(("one", 0.0, 1.0), ("two.", 1.1, 3.2), ("three", 3.5, 4.0), ("four", 4.1, 5.5))  # a sentence, then a leftover that joins it
    rows += words(("a", 0.0, 1.0), ("b", 1.1, 2.0), chunk=1)  # too short, nothing before: lost
    rows += words(("a", 0.0, 25.5), ("b", 25.7, 26.0), ("c", 26.05, 27.6), chunk=2)  # too long: cut at a short pause; the rest stands alone
    rows += words(("a", 0.0, 3.5), ("b", 4.0, 5.0), chunk=3)  # long pause; the leftover is under 1.5 s: lost
    df = spark.createDataFrame(rows * 2 + [("r", 4, 0, None, 0.0, 9.0, 1.0), ("r", 4, 1, "x", None, 9.0, 1.0)],
                               "recording_id string, chunk_idx int, ordinal int, word string, start_sec double, end_sec double, score double")
    got = sorted((r["chunk_idx"], r["segment_id"], r["text"], r["start_sec"], r["end_sec"]) for r in corpus.segment_recordings(df).collect())
    assert got == [
        (0, "r_seg_00000", "one two. three four", 0.0, 5.5), (2, "r_seg_00001", "a", 0.0, 25.5), (2, "r_seg_00002", "b c", 25.7, 27.6), (3, "r_seg_00003", "a", 0.0, 3.5),
    ]
    assert corpus.segment_recordings(df.limit(0)).count() == 0


def test_token_spans_and_words(spark):
    frames = spark.createDataFrame([("r", i, t) for i, t in enumerate([0, 5, 5, 0, 5, 7, 7, 0, 9])], "r string, frame int, token int")
    spans = folds.token_spans(frames, ["r"])
    assert sorted((x["span"], x["token"], x["first"], x["past"]) for x in spans.collect()) == [(0, 5, 1, 3), (1, 5, 4, 5), (2, 7, 5, 7), (3, 9, 8, 9)]
    w = spark.createDataFrame([("r", 0, "ab", 2), ("r", 1, "", 0), ("r", 2, "c", 1), ("r", 3, "de", 2), ("r", 4, "f", 1)], "r string, ordinal int, word string, n_tokens int")
    got = sorted((x["ordinal"], x["start_sec"], x["end_sec"]) for x in folds.words_from_spans(spans, w, ["r"], 0.5).collect())
    assert got == [(0, 0.5, 2.5), (2, 2.5, 3.5), (3, 4.0, 4.5)]


BOOK = "# თავი პირველი\n\nერთ დღეს, მამა წავიდა ქალაქში. „სად მიდიხარ?“ — ჰკითხა შვილმა.\nბაზარში მივდივარ, უპასუხა მამამ; იქ ვაშლებს ვიყიდი!  საღამოს სახლში დავბრუნდები."


def test_alignment_restores_spelling(spark):
    chunks = [("b", "c1", "ერთ დღეს მამა წავიდა ქალაქში სად მიდიხარ"), ("b", "c2", "ჰკითხა შვილმა ბაზარში მივდივარ უპასუხა მამამ"), ("b", "c3", ""), ("b", "c4", "იქ ვაშლებს ვიკიდი საღამოს სახლში დავბრუნდები"), ("x", "c1", "არ არის წიგნი")]
    df = spark.createDataFrame(chunks, "recording_id string, chunk_id string, text string")
    books = spark.createDataFrame([("b", BOOK), ("y", None)], "recording_id string, text string")
    got = {(r["recording_id"], r["chunk_id"]): r for r in align.align_chunks(df, books).collect()}
    assert got["b", "c1"]["punctuated_text"] == "ერთ დღეს, მამა წავიდა ქალაქში. „სად მიდიხარ?“"
    assert got["b", "c2"]["punctuated_text"].endswith("ბაზარში მივდივარ, უპასუხა მამამ;") and got["b", "c2"]["cer"] < 0.1
    assert "ვიყიდი!" in got["b", "c4"]["punctuated_text"]
    clean = align.Book.of(BOOK).clean
    for r in got.values():
        if r["book_text"]:
            assert clean[r["book_offset_start"] : r["book_offset_end"]].strip() == r["book_text"]
    assert got["b", "c3"]["cer"] == 1.0 and got["b", "c3"]["book_text"] == "" and got["x", "c1"]["cer"] == 1.0
    segs = df.withColumnRenamed("chunk_id", "segment_id")
    two = {(r["recording_id"], r["segment_id"]): r for r in align.align_segments(segs, books).collect()}
    assert two["b", "c1"]["matched"] and two["b", "c1"]["text"].startswith("ერთ დღეს, მამა") and not two["x", "c1"]["matched"] and len(two) == 5
    assert align.align_chunks(df.limit(0), books).count() == 0


def test_book_positions():
    for text in (BOOK, "", "  ", "!!!", "a", "#\n# b\n## c d"):
        b = align.Book.of(text)
        assert len(b.norm) == len(b.back) and all(b.clean[p] == c for p, c in zip(b.back, b.norm)) and b.norm == b.norm.strip() and "  " not in b.norm
    assert align.word_pairs(list("abc"), list("abxc")) == [(0, 0), (1, 1), (2, 3)]
    assert align.best_match("abc", "", 0, 10) == (0, 0, 1.0) and align.best_match("hello", "say hello there", 0, 99)[2] == 0.0


def test_mismatch_falls_back(spark):
    rows = [("b", "x", "X.", "book", 0.5, 0.5), ("b", "y", "Y.", "book", 0.3, 0.7), ("g", "z", "Z.", "book", 0.1, 0.9), ("e", "", "", "", 0.0, 1.0)]
    df = spark.createDataFrame(rows, "r string, asr_text string, punctuated_text string, book_text string, cer double, alignment_score double")
    got = {r["asr_text"]: tuple(r)[2:] for r in filters.without_book_text(df, "r", "asr_text", "cer").collect()}
    assert got["x"] == ("x", "", 0.0, 1.0) and got["z"] == ("Z.", "book", 0.1, 0.9) and got[""][1] == ""


def test_splits_and_pairs(spark):
    rows = [(f"c{i}", "hot" if i % 3 else "b") for i in range(200)] + [("lone", "single"), ("n", None)]
    df = spark.createDataFrame(rows, "id string, speaker string")
    pairs = splits.context_pairs(df.where("speaker IS NOT NULL"), "id", "speaker").collect()
    who = dict(rows)
    assert len(pairs) == 200 and all(r["id"] != r["context_id"] and who[r["context_id"]] == who[r["id"]] for r in pairs)
    assert {tuple(r) for r in pairs} == {tuple(r) for r in splits.context_pairs(df.where("speaker IS NOT NULL").repartition(7), "id", "speaker").collect()}
    assert splits.seeded_share(df, "id").where("split = 'eval'").count() == 10 and splits.seeded_share(df.limit(3), "id").where("split = 'eval'").count() == 1
    assert splits.seeded_draw(df, "id", 5).count() == 5
    held = splits.eval_split(df, "id", "speaker", ["b"]).where("speaker = 'b'").select("split").distinct().collect()
    assert [r[0] for r in held] == ["eval"]
    with pytest.raises(ValueError, match="nobody"):
        splits.check_holdout(df, "speaker", ["b", "nobody"])


def test_lookups(spark):
    names = spark.createDataFrame([("Book",), ("Other Book",), ("none",), (None,)], "name string")
    books = spark.createDataFrame([("Other Book", 2), ("My Book", 1), ("Book of x", 3)], "title string, o int")
    assert {tuple(r) for r in joins.title_lookup(names, "name", books, "title", "o").collect()} == {("Book", "My Book"), ("Other Book", "Other Book"), ("none", "")}
    files = spark.createDataFrame([("My_a.wav",), ("My_b.wav",), ("My Book_c.wav",), ("",), (None,)], "file string")
    titles = spark.createDataFrame([("My",), ("My Book",), ("No",)], "t string")
    assert {tuple(r) for r in joins.prefix_matches(titles, "t", files, "file").collect()} == {("My", "My_a.wav"), ("My Book", "My Book_c.wav"), ("No", None)}


def test_aggregates_on_nothing(spark):
    empty = spark.createDataFrame([], "k string, x double")
    assert aggs.mean_and_middle(empty, "x").first().asDict() == {"mean_x": 0.0, "median_x": 0.0}
    assert [r["n"] for r in aggs.histogram(empty, "x").collect()] == [0] * 5
    assert aggs.yield_report(empty, "k", F.col("x") > 0, "x").count() == 0
    some = spark.createDataFrame([(x,) for x in (0.0, 0.05, 0.0999, 0.2, 1.0, 1.01, 3.0)], "x double")
    assert [r["n"] for r in aggs.histogram(some, "x").orderBy("bin").collect()] == [1, 2, 0, 1, 1]


def test_fixed_windows_and_dealing(spark):
    df = spark.createDataFrame([("a", 0.0, 80.0), ("b", 5.0, 5.0), ("c", 1.0, 36.0)], "id string, s double, e double")
    got = sorted((r["id"], r["part"], r["s"], r["e"]) for r in windows.fixed_windows(df, "s", "e", 35.0).collect())
    assert got == [("a", 0, 0.0, 35.0), ("a", 1, 35.0, 70.0), ("a", 2, 70.0, 80.0), ("b", 0, 5.0, 5.0), ("c", 0, 1.0, 36.0)]
    shards = [r["shard"] for r in windows.round_robin(spark.range(10), ["id"], 3).orderBy("id").collect()]
    assert shards == [i % 3 for i in range(10)]


@pytest.mark.parametrize("min_hot", [3, 50_000])
def test_joins_of_unknown_and_repeated_keys(spark, min_hot):
    rows = [(k, i) for i, k in enumerate(["hot"] * 40 + ["a", "a", "b", None, "none"])]
    df = spark.createDataFrame(rows, "k string, i int")
    table = spark.createDataFrame([("hot", 1), ("a", 2), ("b", 3), (None, 4), ("unused", 5)], "k string, v int")
    got = sorted((r["k"], r["i"], r["v"]) for r in joins.attach_unknown(df, table, "k", min_hot).collect())
    values = {"hot": 1, "a": 2, "b": 3}
    assert got == sorted((k, i, values[k]) for k, i in rows if k in values)
    assert joins.attach_unknown(df.limit(0), table, "k", min_hot).count() == 0 and joins.attach_unknown(df, table.limit(0), "k", min_hot).count() == 0
    n = {k: sum(1 for j, _ in rows if j == k) for k, _ in rows}
    members = spark.createDataFrame([(k, n[k], i) for k, i in rows], "k string, n long, member int")
    left = spark.createDataFrame([("hot", "x"), ("hot", "y"), ("b", "z"), ("b", "z"), ("gone", "w"), (None, "q")], "k string, side string")
    out = joins.join_copies(left, members, "k", "n", "member", min_hot)
    want = sorted((k, s, i) for k, s in [("hot", "x"), ("hot", "y"), ("b", "z"), ("b", "z")] for j, i in rows if j == k)
    assert sorted((r["k"], r["side"], r["member"]) for r in out.collect()) == want
    assert "n" not in out.columns and joins.join_copies(left, members.limit(0), "k", "n", "member", min_hot).count() == 0

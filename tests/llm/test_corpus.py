"""Duplicates, components and splits against brute force."""

import json
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from voxloom.llm import dedup, splits
from voxloom.llm.components import components
from voxloom.operators import joins


@pytest.fixture(params=[2, 50_000])
def hot(request, monkeypatch):
    monkeypatch.setattr(joins.attach_by_key, "__defaults__", (request.param,))
    return request.param


def test_copies_of_texts(spark, hot):
    base = ["ერთი ორი სამი ოთხი ხუთი ექვსი", "one two three four five six 7", "a b c d e", "", None, "x " * 5000]
    rng, rows = random.Random(1), []
    for i in range(120):
        t = base[0] if i % 3 == 0 else rng.choice(base)
        if t and rng.random() < 0.5:
            t = rng.choice([t.upper(), t.replace(" ", "  "), t + "!", "— " + t.replace(" ", ", ")])
        rows.append((f"id{i:03d}", t))
    rows.append(("glued", "ერთიორი სამი ოთხი ხუთი ექვ სი ერთიო"))
    df = spark.createDataFrame(rows + rows[:20], "id string, text string").withColumn("key", F.lit(1)).withColumn("canon", F.lit("x"))
    groups = defaultdict(list)
    for i, t in rows:
        if t and len(re.findall(r"[^\W_]+", t)) >= 6:
            groups["".join(c for c in t.lower() if c.isalnum())].append(i)
    short = defaultdict(set)
    for i, t in rows:
        if t is not None and len(re.findall(r"[^\W_]+", t)) < 6:
            short[t].add(i)
    rest = {(min(g), len(g)) for g in short.values()} | {(i, 1) for i, t in rows if t is None}
    want = {(min(g), x) for g in groups.values() for x in set(g) if x != min(g)}
    assert {tuple(r) for r in dedup.copies_of(df, "id", "text", dedup.canonical_texts).collect()} == want
    assert {tuple(r) for r in dedup.collapsed(df, "id", "text", dedup.canonical_texts).collect()} == {(min(g), len(g)) for g in groups.values()} | rest
    assert dedup.copies_of(df.limit(0), "id", "text", dedup.canonical_texts).count() == 0


def test_canonical_lines():
    same = ['{"id": "a", "text": "One, two", "d": 5.0}', '{ "d":5,"text":"one TWO","id":"\\u0061"}', '{"text": "onetwo", "d": 0.5e1, "id": "a"}']
    assert len({dedup.canonical_line(x) for x in same}) == 1
    other = ['{"id": "a", "text": "one two", "d": true}', '{"id": "a", "text": "one two", "d": "5"}', '{"id": "A", "text": "one two", "d": 5}', '{"id": "a", "text": "one two"}',
             '{"id": "a", "text": "one two", "d": null}', '{"id": "a", "text": "one two", "d": [5, {"x": -0.0}]}']
    assert len({dedup.canonical_line(x) for x in other} | {dedup.canonical_line(same[0])}) == len(other) + 1
    long = '{"n": 123456789012345678901234567890123456789%s}'
    assert len({dedup.canonical_line(long % x) for x in ("0", "1", "00", "0.50", "0.5", "0.51", "e1")}) == 5
    assert [dedup.canonical_line(x) for x in ("", "{", "[1]", '{"a": NaN}', '{"a": 1} x', "null")] == [None] * 6


def test_copies_of_lines(spark, hot):
    rows = [("3", json.dumps({"a": 1, "text": "X y"})), ("1", '{"text":"x Y!","a":1.0}'), ("2", '{"text":"x Y!","a":1.0}'), ("4", "{bad"), ("5", "{bad"), ("6", None)]
    df = spark.createDataFrame(rows, "line_id string, line string")
    assert {tuple(r) for r in dedup.copies_of(df, "line_id", "line", dedup.canonical_lines).collect()} == {("1", "2"), ("1", "3")}
    assert {tuple(r) for r in dedup.collapsed(df, "line_id", "line", dedup.canonical_lines).collect()} == {("1", 3), ("4", 2), ("6", 1)}


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed, hot):
    rng = random.Random(seed)
    links = [(f"n{rng.randrange(60):02d}", f"n{rng.randrange(60):02d}") for _ in range(45)] + [("hub", f"n{i:02d}") for i in range(0, 60, 7)] + [("x", "x"), (None, "y")]
    links += [(f"p{i:02d}", f"p{i + 1:02d}") for i in range(40)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a string, b string"), "a", "b").collect()}
    root = {}
    def find(v):
        while root.setdefault(v, v) != v:
            v = root[v]
        return v
    for a, b in links:
        if a and b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    assert got == {v: find(v) for v in root}


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.integers(1, 500), st.integers(1, 60), max_size=25))
def test_differencing_places_all_and_balances(weights):
    spread = splits.Differencing(weights, 8)
    each = spread.counts(np.arange(8), 8)
    assert {w: int(c.sum()) for w, c in each.items()} == weights
    assert spread.totals.tolist() == [sum(w * int(c[b]) for w, c in each.items()) for b in range(8)]
    if weights:
        assert spread.totals.max() <= max(max(weights), spread.totals.sum() / 8 + max(weights))


def test_differencing_of_many_weights():
    rng = random.Random(1)
    weights = {w: rng.randrange(1, 300) for w in range(1, 4000)}
    spread = splits.Differencing(weights, 100)
    assert spread.totals.sum() == sum(w * c for w, c in weights.items()) and np.ptp(spread.totals) <= 20


def test_bins_follow_the_targets():
    assert splits.bins_for({"a": 0.9, "b": 0.1}) == 100 and splits.bins_for({"a": 0.999, "b": 0.001}) == 5000
    spread = splits.Differencing({1: 60_000, 7: 300}, 5000)
    names, bin_split = splits.fill_splits(spread.totals, {"a": 0.999, "b": 0.001, "c": 0})
    reached = np.bincount(bin_split, spread.totals, minlength=3) / spread.totals.sum()
    assert names == ["a", "b", "c"] and abs(reached[1] - 0.001) < 2e-4 and reached[2] == 0


def test_assignment(spark):
    rng, rows = random.Random(9), []
    for i in range(1500):
        s = rng.choice([f"s{rng.randrange(150)}", "s1, s2", None, "", "unknown", "unknown, s7"])
        rows.append((f"r{rng.randrange(400)}__seg_{i}" if i % 4 else f"odd{i}", s, rng.choice([f"b{rng.randrange(300)}", None, ""]) if i % 5 == 0 else None, i))
    df = spark.createDataFrame(rows, "id string, speaker_id string, book_title string, at int").withColumn("ingested_at", F.timestamp_micros(F.col("at").cast("long")))
    clips = splits.clips_with_tokens(df.unionByName(df))
    tokens = {r["id"]: r["tokens"] for r in clips.collect()}
    assert tokens[rows[1][0]][-1].startswith("r:r") and all(t[2:] not in ("", "unknown") for v in tokens.values() for t in v)
    out = splits.assign(clips, {"train": 0.8, "val": 0.1, "test": 0.1})
    got = {r["id"]: r["split"] for r in out.collect()}
    assert set(got) == {r[0] for r in rows} and out.count() == len(got)
    by_token = defaultdict(set)
    for i, ts in tokens.items():
        for t in ts:
            by_token[t].add(got[i])
    assert all(len(v) == 1 for v in by_token.values())
    pairs = splits.speakers_together(clips, {"train": 0.8, "val": 0.1, "test": 0.1}).collect()
    for r in pairs:
        assert r["speaker_a"] < r["speaker_b"]
        for name in (r["speaker_a"], r["speaker_b"]):
            assert by_token.get(f"s:{name}") == {r["split"]}
    assert any(r["speaker_b"] == "s2" or r["speaker_a"] == "s2" for r in pairs)
    assert splits.assign(clips.limit(0), {"train": 1.0}).count() == 0


def test_shares_are_met_with_small_groups(spark):
    df = spark.createDataFrame([(f"c{i}", [f"s:{i // 3}"] if i % 7 else []) for i in range(3000)], "id string, tokens array<string>")
    n = Counter(r["split"] for r in splits.assign(df, {"train": 0.9, "val": 0.05, "test": 0.05}).collect())
    assert abs(n["train"] - 2700) <= 30 and abs(n["val"] - 150) <= 15 and abs(n["test"] - 150) <= 15

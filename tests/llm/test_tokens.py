"""Token sizes, packing and mixing against their definitions."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from voxloom.llm import mixing, packing, tokens


def test_sizes_equal_the_tokenizer(spark):
    import os

    with open(os.path.join(tokens.TOKENIZERS, tokens.VOCABULARY), "rb") as f:
        c = tokens.Counter(f.read())
    texts = ["", "ერთი ორი, სამი!  one  two's\n\n 123", "x" * 20_000, None, "🎧 — …"]
    got = [r["tokens"] for r in tokens.with_tokens(spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1), "text").collect()]
    assert got == [None if t is None else len(c.encode(t)) for t in texts]


def test_least_squares_reaches_an_exact_mix():
    lengths = np.array([3, 5, 6, 8, 10])
    sizes, times = packing.combinations(lengths, 16)
    assert ((sizes * times).sum(1) == 16).all() and len(np.unique(np.concatenate([sizes, times], 1), axis=0)) == len(sizes)
    assert {(10, 6, 0), (8, 5, 3)} <= {tuple(r) for r in sizes.tolist()}
    h = np.zeros(6)
    h[1:] = [30, 30, 50, 40, 50]
    index = np.where(sizes > 0, np.searchsorted(lengths, sizes) + 1, 0)
    x = packing.nnls(index, times, h, np.ones(6), rounds=2000, tolerance=1e-10)
    fit = np.zeros(6)
    for row, m, v in zip(index, times, x):
        np.add.at(fit, row, m * v)
    assert (x >= 0).all() and np.abs(fit - h)[1:].max() < 0.5


@settings(max_examples=25, deadline=None)
@given(st.dictionaries(st.integers(1, 32), st.integers(1, 2000), max_size=20))
def test_plan_places_every_item(histogram):
    used = Counter()
    for mix, times in packing.plan(histogram, 32):
        assert times > 0 and sum(s * m for s, m in mix.items()) <= 32
        for s, m in mix.items():
            used[s] += m * times
    assert used == Counter(histogram)


@pytest.mark.parametrize(("lengths", "capacity", "fill"), [
    ([33], 8192, 0.99), ([33], 2048, 0.99), (range(20, 60), 512, 0.99), (range(1, 2000), 2048, 0.99), (range(2000, 4000), 8192, 0.93),
])
def test_fill(lengths, capacity, fill):
    rng = random.Random(5)
    histogram = Counter(rng.choice(lengths) for _ in range(100_000))
    containers = sum(n for _, n in packing.plan(histogram, capacity))
    assert sum(s * n for s, n in histogram.items()) / (containers * capacity) > fill


def test_lengths_beyond_the_exact_ones_round_up(spark):
    ns = [1, 8191, 8192, 8193, 16385, 1_000_003]
    got = [r[0] for r in spark.createDataFrame([(n,) for n in ns], "n long").select(packing.rounded(F.col("n"))).collect()]
    assert got[:2] == [1, 8191] and all(n <= g <= n * (1 + 2**-12) for n, g in zip(ns, got))


def test_packing(spark):
    rng = random.Random(2)
    sizes = {i: rng.choice([3, 40, 41, 100, 177, 300, 1000, 1700]) if i % 3 else 77 for i in range(2000)}
    df = spark.createDataFrame([*sizes.items(), (5000, None), (5001, 0)], "id long, n long")
    out = packing.pack(df, "id", "n", {"a": 256, "b": 2048})
    rows = out.collect()
    for name, cap in (("a", 256), ("b", 2048)):
        mine = [r for r in rows if r["container"] == name]
        load, parts = Counter(), defaultdict(list)
        for r in mine:
            load[r["container_no"]] += r["tokens"]
            parts[r["doc_id"]].append((r["start_token"], r["tokens"]))
        assert max(load.values()) <= cap and set(parts) == set(sizes)
        for i, p in parts.items():
            p.sort()
            assert [s for s, _ in p] == [k * cap for k in range(len(p))] and sum(t for _, t in p) == sizes[i]
            assert len(p) == -(-sizes[i] // cap)
        assert sum(load.values()) / (len(load) * cap) > 0.9
    assert packing.pack(df.limit(0), "id", "n", {"a": 256}).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 30), min_size=1, max_size=12), st.integers(0, 4000))
def test_subset_sums_leave_nothing_that_fits(counts, budget):
    got = mixing.subset_counts(counts, budget)
    assert all(0 < c <= counts[n] for n, c in got.items())
    open_ = budget - sum(n * c for n, c in got.items())
    assert open_ >= 0 and all(got.get(n, 0) == c or n > open_ for n, c in counts.items())
    if 1 in counts and counts[1] > 2 * max(counts) + 1 and budget < sum(n * c for n, c in counts.items()):
        assert open_ == 0


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_taken_lengths_follow_the_source(seed):
    rng = random.Random(seed)
    for lengths in ([*range(1, 3000)], [int(rng.lognormvariate(5, 1)) + 1 for _ in range(3000)], [7] * 2000 + [400] * 1000):
        counts = Counter(lengths)
        budget = sum(lengths) * rng.randrange(20, 80) // 100
        got = mixing.subset_counts(counts, budget, seed)
        used = sum(n * c for n, c in got.items())
        assert budget - used < min(counts) and abs(used / sum(got.values()) / (sum(lengths) / len(lengths)) - 1) < 0.02
    assert mixing.subset_counts(counts, budget, 1) != mixing.subset_counts(counts, budget, 99) or len(counts) < 3


def test_mix_reaches_shares(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice(["big", "mid", "small", "other", None]), rng.randrange(1, 90) if i % 3 else 33) for i in range(3000)]
    rows += [(9001, "big", None), (9002, "big", 0)]
    df = spark.createDataFrame(rows, "id long, s string, n long")
    targets = {"big": (0.5, 1), "mid": (0.3, 2), "small": (0.18, 3), "absent": (0.02, 4)}
    rep = {r["source"]: r for r in mixing.share_report(mixing.mix(df, "id", "s", "n", targets), df, "s", "n", targets).collect()}
    for s, (w, cap) in targets.items():
        assert rep[s]["most_copies"] <= cap
        assert abs(rep[s]["reached_share"] - (0 if s == "absent" else w / 0.98)) < 1e-4
    assert mixing.mix(df.limit(0), "id", "s", "n", targets).count() == 0


@pytest.mark.parametrize("total", [1000, 10**9])
def test_mix_total(spark, total):
    df = spark.createDataFrame([(i, "a", 7) for i in range(100)], "id long, s string, n long")
    used = sum(r["tokens"] * r["copies"] for r in mixing.mix(df, "id", "s", "n", {"a": (1.0, 2)}, total).collect())
    assert used == min(994, 1400) if total == 1000 else used == 1400

"""Overlap search against brute force; the index against plain search."""

import random

import numpy as np
import pytest

from voxloom.llm import overlap
from voxloom.llm.fmindex import WordIndex


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        prev = 0
        for j, y in enumerate(b):
            prev, row[j + 1] = row[j + 1], prev + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


def test_index_finds_every_occurrence():
    rng = random.Random(1)
    docs = [np.array([rng.randrange(6) * 7 - 9 for _ in range(rng.randrange(1, 12))]) for _ in range(60)]
    ix = WordIndex.loads(WordIndex.build(docs, [bytes([i, 0]) for i in range(60)]).dumps())
    for _ in range(60):
        d = docs[rng.randrange(60)]
        s = rng.randrange(len(d))
        pat = d[s : s + 3]
        lo, hi = np.array([0]), np.array([ix.size])
        for w in pat[::-1]:
            lo, hi = ix.extend(ix.symbols(np.array([w])), lo, hi)
        got = sorted(ix.locate(np.arange(lo[0], hi[0])).tolist())
        want = sorted(
            int(ix.starts[i]) + p for i, x in enumerate(docs) for p in range(len(x) - len(pat) + 1) if list(x[p : p + len(pat)]) == list(pat)
        )
        assert got == want
    text = ix.text()
    for i, x in enumerate(docs):
        assert list(ix.vocab[text[ix.starts[i] : ix.starts[i] + len(x)] - 1]) == list(x)


@pytest.mark.parametrize("vocabulary", [4, 30, 400])
def test_search_equals_brute_force(vocabulary):
    rng = random.Random(vocabulary)
    evals = [[rng.randrange(vocabulary) for _ in range(rng.choice([6, 7, 9, 14, 25, 80]))] for _ in range(40)]
    texts = []
    for e in evals * 3:
        t = list(e)
        for _ in range(rng.randrange(0, 5)):
            p = rng.randrange(len(t))
            kind = rng.randrange(3)
            if kind == 0:
                t[p] = rng.randrange(vocabulary + 5)
            elif kind == 1:
                t.insert(p, rng.randrange(vocabulary + 5))
            elif len(t) > 6:
                del t[p]
        texts.append(t)
    texts += [[rng.randrange(vocabulary) for _ in range(10)] for _ in range(40)]
    uniq = [list(x) for x in dict.fromkeys(map(tuple, evals))]
    s = overlap.Searcher(WordIndex.build([np.array(e) for e in uniq], [i.to_bytes(2, "big") for i in range(len(uniq))]).dumps())
    got = {}
    for a, b, n, m, common, spans, covered in s.search(list(range(len(texts))), [np.array(t) for t in texts]):
        assert (a, b) not in got and 3 * spans <= covered <= n
        got[a, int.from_bytes(b, "big")] = common
    want = {}
    for a, t in enumerate(texts):
        for b, e in enumerate(uniq):
            if (c := lcs(t, e)) * 5 >= 4 * max(len(t), len(e)):
                want[a, b] = c
    assert got == want


def test_end_to_end(spark, tmp_path):
    near = "ერთი ორი სამი ოთხი ხუთი ექვსი შვიდი რვა ცხრა ათი"
    train = [("t1", near.upper() + "!"), ("t2", near.replace("ორი", "სხვა")), ("t3", "one two three four five"), ("t4", None), ("t5", ""), ("t1", near.upper() + "!")]
    evals = [("e1", near), ("a9", near + " one two"), ("e2", "one two three four five"), ("e3", None)]
    t_ids, t = overlap.word_classes(spark.createDataFrame(train, "id string, text string"), "id", "text")
    e_ids, e = overlap.word_classes(spark.createDataFrame(evals, "id string, text string"), "id", "text")
    for shard_words in (5, 1000):
        pairs = overlap.overlaps(t, e, shard_words=shard_words, lane_texts=1)
        got = pairs.join(t_ids.withColumnRenamed("key", "train_key"), "train_key").join(
            e_ids.withColumnRenamed("key", "eval_key").withColumnRenamed("id", "e"), "eval_key"
        )
        assert {(r["id"], r["e"]) for r in got.collect()} == {("t1", "e1"), ("t2", "e1"), ("t1", "a9")}
    assert overlap.overlaps(t, e.limit(0)).count() == 0
    assert overlap.overlaps(t.limit(0), e).count() == 0


def test_hits_of_one_text_in_parts(monkeypatch):
    rng = random.Random(3)
    evals = [list(x) for x in {tuple(rng.randrange(3) for _ in range(12)) for _ in range(200)}]
    texts = [*evals[:20], [rng.randrange(3) for _ in range(150)], [rng.randrange(3) for _ in range(11)]]
    s = overlap.Searcher(WordIndex.build([np.array(e) for e in evals], [bytes([i]) for i in range(len(evals))]).dumps())
    args = (list(range(len(texts))), [np.array(t) for t in texts])
    whole = sorted(s.search(*args))
    monkeypatch.setattr(overlap, "HITS_AT_ONCE", 7)
    assert sorted(s.search(*args)) == whole and len(whole) > 20


def test_spans_are_maximal_matches():
    text = np.array([1, 2, 3, 4, 5, 90, 6, 7, 8, 9, 10])
    s = overlap.Searcher(WordIndex.build([np.array([1, 2, 3, 4, 5, 6, 7, 8, 9, 10])], [b"a"]).dumps())
    assert list(s.search(["t"], [text])) == [("t", b"a", 11, 10, 10, 2, 10)]


@pytest.mark.parametrize("vocabulary", [3, 12, 3000])
def test_tables_equal_brute_force(spark, vocabulary, monkeypatch):
    """Through routing, shards and lanes, with texts on both sides of every length limit, few and many words."""
    monkeypatch.setattr(overlap, "COMMON", (4, 8))
    rng = random.Random(vocabulary)
    evals = [[rng.randrange(vocabulary) for _ in range(rng.choice([6, 7, 10, 31, 32, 33, 40, 41, 50, 51, 70, 130]))] for _ in range(60)] + [[1] * 8, [1] * 7 + [2]]
    texts = []
    for e in evals * 2:
        t = list(e)
        for _ in range(rng.randrange(0, max(2, len(t) // 4))):
            p = rng.randrange(len(t))
            kind = rng.randrange(3)
            if kind == 0:
                t[p] = rng.randrange(vocabulary + 5)
            elif kind == 1:
                t.insert(p, rng.randrange(vocabulary + 5))
            elif len(t) > 6:
                del t[p]
        texts.append(t)
    frames = []
    for side in (texts, evals):
        rows = [(f"{i:03d}", " ".join(f"w{x}" for x in t)) for i, t in enumerate(side)]
        frames.append(overlap.word_classes(spark.createDataFrame(rows, "id string, text string"), "id", "text"))
    (t_ids, t), (e_ids, e) = frames
    pairs = overlap.overlaps(t, e, shard_words=600)
    out = pairs.join(t_ids.withColumnRenamed("key", "train_key").withColumnRenamed("id", "a"), "train_key")
    out = out.join(e_ids.withColumnRenamed("key", "eval_key").withColumnRenamed("id", "b"), "eval_key")
    got = {(int(r["a"]), int(r["b"])): r["common"] for r in out.collect()}
    want = {}
    for a, x in enumerate(texts):
        for b, y in enumerate(evals):
            if min(len(x), len(y)) * 5 >= 4 * max(len(x), len(y)) and (c := lcs(x, y)) * 5 >= 4 * max(len(x), len(y)):
                want[a, b] = c
    assert got == want

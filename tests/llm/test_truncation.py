"""Cut texts planted in generated documents."""

import random

from voxloom.llm import truncation as tr


def corpus(n=1500, limit=120):
    rng = random.Random(5)
    stems = ["".join(rng.choice("bdgklmnprstvz") + rng.choice("aeiou") for _ in range(3)) for _ in range(60)]
    word = lambda: rng.choice(stems) + rng.choice(["ns", "rt", "lm"])
    rows, planted = [], set()
    for i in range(n):
        kind = "passage" if i % 3 else "transcript"
        words = [word() for _ in range(rng.randrange(6, 60))]
        text = " ".join(words) if kind == "transcript" else ". ".join(" ".join(words[j : j + 6]) for j in range(0, len(words), 6)) + "."
        source = "short" if i % 2 else "open"
        if source == "short" and len(text) > limit and rng.random() < 0.5:
            text = text[:limit]
            if text[-1] != ".":
                planted.add(i)
        elif rng.random() < 0.03:
            text = text[: rng.randrange(20, len(text))]
            if text[-1] != "." and text not in (" ".join(words),):
                planted.add(i)
        rows.append((i, text, source, kind))
    return rows, planted


def test_planted_cuts_are_found(spark):
    rows, planted = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, kind string")
    got = {r["id"] for r in tr.truncated(df, "doc_id", "text", "source", "kind").where("cut").collect()}
    ends = {i for i, t, _, _ in rows if t[-2:] in ("ns", "rt", "lm") and t[-1] != " "}
    sure = {i for i in planted if i not in ends}
    assert len(sure) > 60 and len(got & sure) >= 0.95 * len(sure)
    assert len(got - planted) <= 0.03 * len(got)


def test_edges(spark):
    rows = [(1, None, None, None), (2, "", "a", "b"), (3, "  ", "a", "b"), (4, "ends here.", None, "b"), (5, "broken �", "a", None), (6, "x" * 50_000, "a", "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, kind string").withColumn("tail", tr.F.lit(1))
    got = {r["id"]: r["cut"] for r in tr.truncated(df, "doc_id", "text", "source", "kind").collect()}
    assert set(got) == {4, 5, 6} and got[4] is False and got[5] is True
    assert tr.truncated(df.limit(0), "doc_id", "text", "source", "kind").count() == 0


def test_symbols():
    assert "".join(tr.symbols("one, two 14.\n\n— End &quot;")) == 'a,a0.¶—a"'
    assert tr.symbols("ab &am")[-1] == "e" and tr.symbols("ab ")[-1] == "␠" and tr.symbols("q\\u10d")[-1] == "e"
    assert tr.complete("aa.") and tr.complete('a."') and not tr.complete('aa"') and not tr.complete("aaa")
    assert [tr.script_of(x) for x in ("abc", "сон", "ერთი 5", "12")] == ["latn", "cyrl", "ka", "none"]


def rare_script(n=40):
    """A few transcripts in Cyrillic, every second one cut inside its last word, among much Latin text."""
    rng = random.Random(9)
    stems = ["".join(rng.choice("бдгклмн") + rng.choice("аеиоу") for _ in range(3)) for _ in range(8)]
    rows = [(i, "bonakirs medulint " * 50_000 + "bonakirs.", "bulk", "passage") for i in range(20)]
    for i in range(n):
        words = [rng.choice(stems) + "рт" for _ in range(12)]
        text = " ".join(words)
        rows.append((100 + i, text[:-3] if i % 2 else text, "rare", "transcript"))
    return rows


def test_rare_scripts_keep_their_word_statistics(spark):
    rows = rare_script()
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, kind string").repartition(4)
    got = {r["id"]: r["log_odds"] for r in tr.truncated(df, "doc_id", "text", "source", "kind").collect() if r["id"] >= 100}
    assert len(got) == 40
    assert min(x for i, x in got.items() if i % 2) > max(x for i, x in got.items() if i % 2 == 0) + 2

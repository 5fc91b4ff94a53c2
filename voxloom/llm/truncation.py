"""Texts cut off by a length limit or in transfer.

Two readings of a value's final context are compared: the text ends here, or it went on. Both are
backward character n-gram models that spell the context from its last character leftwards. Inside a word
the characters themselves are spelled (end-of-word against inside-a-word statistics of the whole corpus);
around words the context is spelled in symbols (a letter run, a digit run, each mark, line ends), by
record kind and script. How often the text went on, per position relative to the length limits of its
source, and the symbol models are fitted together by expectation maximisation, so the threshold on the
log-odds comes out per kind, script and position.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxloom.operators.joins import attach_by_key
from voxloom.storage import cut

ORDER = 6  # characters a backward n-gram spans, the anchor included
TAIL = 120
BACKOFF = 2.0
NEAR, WORD_CHARS, WORD_BYTES = 30, 25, 60
STEP, CLIP = 0.5, 9.0
ROUNDS = 25
MARKS = ".!?…,;:-–—„“”\"'«»()[]/*_%&+=#�"
TRACES = "�e"  # a split character, an unfinished reference or escape: left by the cut itself

CLOSING, AFTER_CLOSING = ".!?…", "”“\"'»)"

_UNIT = regex.compile(r"(?P<q>&[a-zA-Z]+;)|(?P<e>(?:&[a-zA-Z]{0,6}|\\(?:u[0-9a-fA-F]{0,3})?|%[0-9A-F]?)$)|(?P<t>\s+$)|(?P<a>[\p{L}\p{M}]+)|(?P<d>\p{N}+)|(?P<p>\n\s*\n\s*)|(?P<n>\n\s*)|(?P<s>\s+)|(?P<g>\p{Extended_Pictographic}[\p{M}\p{Cf}\p{Sk}]*)|(?P<o>.)")
_RUN = regex.compile(r"(\p{N}\s)?([\p{L}\p{M}]+)(?=\s*$)")


def complete(last: str) -> bool:
    """Whether the symbols end a sentence: a closing mark, perhaps with quotes or brackets after it."""
    return last.rstrip("␠").rstrip(AFTER_CLOSING)[-1:] in tuple(CLOSING)


def symbols(tail: str) -> list[str]:
    """The tail in symbols: a letters, 0 digits, ¶ blank line, ⏎ line end, ☺ pictographs, marks as themselves, x others.

    A complete character reference counts as a quote, e is an unfinished one, ␠ is trailing white space.
    """
    out = []
    for m in _UNIT.finditer(tail):
        k = m.lastgroup
        if k != "s":
            out.append({"a": "a", "d": "0", "p": "¶", "n": "⏎", "q": '"', "e": "e", "t": "␠", "g": "☺"}.get(k) or (m.group() if m.group() in MARKS else "x"))
    return out


def last_symbols(tail: str) -> str:
    """The last three symbols of a tail; only its end is read where that settles them."""
    end = symbols(tail[-40:])
    return "".join((end if len(end) >= 6 else symbols(tail))[-3:])


def script_of(tail: str) -> str:
    """Script of the last letters of a text; its lang column may be missing or wrong."""
    last = next((c for c in reversed(tail) if c.isalpha()), "")
    for name, lo, hi in (("ka", 0x10A0, 0x10FF), ("cyrl", 0x400, 0x52F), ("latn", 0x41, 0x24F)):
        if last and lo <= ord(last) <= hi:
            return name
    return "other" if last else "none"


class WordEnds:
    """Backward character n-grams of word ends and of positions inside words.

    ``count`` holds the counts of n-grams per model, ``open`` those of contexts with any character
    before them; '' is the context of all. Only the n-grams within the runs to be spelled are needed.
    """

    def __init__(self, count: dict[str, dict[str, int]], open: dict[str, dict[str, int]]):
        self.count, self.open = count, open
        self.total = {m: o.get("", 0) or 1 for m, o in open.items()}

    def spell(self, model: str, run: str) -> float:
        """log P(run | model), leftwards from its last character; '^' or '0' marks the word's start.

        A context seldom seen falls back to one that is shorter by the characters next to the end,
        counted in both models alike, so what has no evidence leaves the odds unchanged.
        """
        c, o, out = self.count[model], self.open[model], 0.0
        word = run
        for i in range(len(word) - 1, max(-1, len(word) - 1 - ORDER), -1):
            after = word[i + 1 :]
            shared = self._shared(word[i], after)
            out += math.log((c.get(word[i] + after, 0) + BACKOFF * shared) / (o.get(after, 0) + BACKOFF))
        return out

    def _shared(self, c: str, after: str) -> float:
        a, b = self.count["end"], self.count["in"]
        p = 1e-3
        for k in range(min(len(after), ORDER - 2), -1, -1):
            h = after[:k]
            seen = self.open["end"].get(h, 0) + self.open["in"].get(h, 0)
            if seen >= 20 or k == 0:
                n = a.get(c + h, 0) + b.get(c + h, 0)
                return (n + 0.05) / (seen + 1.0)
        return p

    def log_odds(self, run: str) -> float:
        """log P(run | a word ends here) - log P(run | a cut at any letter); about 2 at most.

        ``run`` begins with its start mark: '0' after a number, '^' otherwise.
        """
        end, inside = self.spell("end", run), self.spell("in", run)
        we, wi = self.total["end"], self.total["in"]
        top = max(end, inside)
        cut_at = (we * math.exp(end - top) + wi * math.exp(inside - top)) / (we + wi)
        return end - top - math.log(cut_at)


def word_grams(docs: DataFrame, text: str) -> DataFrame:
    """(gram, end, in): n-grams over all words of all texts but each text's final one, which may be cut.

    Words are counted first (partial aggregation), so n-grams are taken from distinct words. Every
    n-gram is kept, however rare; the table stays distributed.
    """
    runs = F.regexp_extract_all(F.lower(F.col(text)), F.lit(r"(?:\p{N}\s)?[\p{L}\p{M}]+"), F.lit(0))
    open_end = F.right(F.col(text), F.lit(1)).rlike(r"[\p{L}\p{M}]")
    rows = docs.select(runs.alias("w"), open_end.alias("open"))
    whole = F.slice("w", F.lit(1), F.greatest(F.size("w") - F.col("open").cast("int"), F.lit(0)))
    counted = rows.select(F.explode(whole).alias("w")).groupBy("w").agg(F.count("*").alias("n"))

    def spread(batches):
        for b in batches:
            have: dict[str, list[int]] = defaultdict(lambda: [0, 0])
            for w, n in zip(b["w"], b["n"]):
                word = "0" + w[2:] if w[0].isnumeric() else "^" + w
                for p in range(2, len(word) + 1):
                    model = 0 if p == len(word) else 1
                    for i in range(max(0, p - ORDER), p):
                        have[word[i:p]][model] += n
            yield pd.DataFrame([(g, *n) for g, n in have.items()], columns=["gram", "end", "in"])

    return cut(counted.mapInPandas(spread, "gram string, end long, in long").groupBy("gram").agg(F.sum("end").alias("end"), F.sum("in").alias("in")))


def word_odds(runs: DataFrame, grams: DataFrame) -> DataFrame:
    """(run, copies, odds) for rows of (run, copies): word log-odds in steps of STEP, from all ``grams``.

    ``runs`` has one row per ending of at most ORDER characters. Its substrings look up their counts by
    join; only the two totals reach the driver.
    """
    t = grams.where(F.length("gram") == 1).agg(F.sum("end"), F.sum("in")).first()
    totals = {"end": t[0] or 0, "in": t[1] or 0}

    def pieces(i):
        return F.transform(F.sequence(F.lit(1), F.length("run") - i + 1), lambda k: F.substring(F.col("run"), i, k))

    each = F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.length("run")), pieces)))
    asked = cut(runs.select("run", F.explode(each).alias("gram")))
    none = F.lit(0).cast("long")
    after = grams.where(F.length("gram") > 1).select(F.substring("gram", F.lit(2), F.length("gram")).alias("gram"), none.alias("end"), none.alias("in"), F.col("end").alias("open_end"), F.col("in").alias("open_in"))
    known = grams.select("gram", "end", "in", none.alias("open_end"), none.alias("open_in")).unionByName(after)
    counts = ("end", "in", "open_end", "open_in")
    known = known.groupBy("gram").agg(*[F.sum(c).alias(c) for c in counts])
    table = cut(asked.groupBy("gram").agg(F.count("*").alias("askers")).join(known, "gram"))
    entry = F.struct("gram", *counts).alias("g")
    found = attach_by_key(asked, table, "gram", "askers").select("run", none.alias("copies"), entry)
    blank = F.lit(None).cast(found.schema["g"].dataType).alias("g")  # a run of which nothing is known keeps its row
    found = found.unionByName(runs.select("run", "copies", blank)).groupBy("run").agg(F.sum("copies").alias("copies"), F.collect_list("g").alias("g"))

    def score(batches):
        for b in batches:
            odds = []
            for run, gram, *ns in zip(b["run"], b["gram"], *(b[c] for c in counts)):
                e, i, oe, oi = (dict(zip(gram, n)) for n in ns)
                m = WordEnds({"end": e, "in": i}, {"end": oe | {"": totals["end"]}, "in": oi | {"": totals["in"]}})
                odds.append(max(-CLIP, min(CLIP, round(m.log_odds(run) / STEP) * STEP)))
            yield pd.DataFrame({"run": b["run"], "copies": b["copies"], "odds": odds})

    return cut(found.select("run", "copies", "g.gram", *[f"g.{c}" for c in counts]).mapInPandas(score, "run string, copies long, odds double"))


def tails(docs: DataFrame, doc_id: str, text: str, source: str, kind: str) -> DataFrame:
    """One row per non-blank text: id, source, kind, tail, and lengths in characters and UTF-8 bytes."""
    t = F.col(text)
    return docs.where(F.length(F.trim(t)) > 0).select(
        F.col(doc_id).alias("id"), F.coalesce(F.col(source), F.lit("")).alias("source"), F.coalesce(F.col(kind), F.lit("")).alias("kind"),
        F.right(t, F.lit(TAIL)).alias("tail"), F.length(t).alias("chars"), F.octet_length(t).alias("bytes"),
    )


def _spikes(hist: DataFrame, reach: int) -> DataFrame:
    """Lengths whose count (with ``reach`` to either side) stands out from those around: source, at."""
    def w(r):
        return Window.partitionBy("source").orderBy("at").rangeBetween(-r, r)

    around = F.sum("n").over(w(NEAR)) - F.sum("n").over(w(reach + 2))
    width = 2 * reach + 1
    back = around * F.lit(width / (2 * (NEAR - reach - 2)))
    h = hist.withColumn("here", F.sum("n").over(w(reach))).withColumn("back", back)
    h = h.withColumn("me", F.struct("here", "n", F.col("at").alias("x"))).withColumn("best", F.max("me").over(w(2 * reach + 2)))
    out = h.where((F.col("here") > 3 * F.col("back") + 5 * F.sqrt("back") + 4) & (F.col("me") == F.col("best")))
    return out.select("source", "at")


def limits(rows: DataFrame) -> DataFrame:
    """(source, unit, value, place): lengths at a limit ('at') or up to a word below it ('below').

    A limit is a spike in the histogram of character lengths, or, among texts not at such a limit, of
    byte lengths, where a split character is dropped or replaced and widens the spike by two bytes. Only
    histograms, of at most one row per length, are sorted.
    """
    def table(spikes, unit, at, below):
        span = F.explode(F.sequence(F.col("at") - F.lit(below), F.col("at") + F.lit(at)))
        place = F.when(F.col("value") >= F.col("at") - at, "at").otherwise("below")
        return spikes.select("source", "at", span.alias("value")).select("source", F.lit(unit).alias("unit"), "value", place.alias("place"))

    by_char = cut(_spikes(rows.groupBy("source", F.col("chars").alias("at")).agg(F.count("*").alias("n")), 0))
    rest = rows.join(by_char.withColumnRenamed("at", "chars"), ["source", "chars"], "left_anti")
    by_byte = _spikes(rest.groupBy("source", F.col("bytes").alias("at")).agg(F.count("*").alias("n")), 2)
    both = table(by_char, "chars", 0, WORD_CHARS).unionByName(table(by_byte, "bytes", 2, WORD_BYTES))
    return cut(both.groupBy("source", "unit", "value").agg(F.min("place").alias("place")))


def placed(rows: DataFrame, table: DataFrame) -> DataFrame:
    """Add ``place``: 'at' or 'below' a limit of the source, else 'free'."""
    for unit in ("chars", "bytes"):
        t = table.where(F.col("unit") == unit).select("source", F.col("value").alias(unit), F.col("place").alias(f"by_{unit}"))
        rows = rows.join(t, ["source", unit], "left")
    return rows.withColumn("place", F.coalesce(F.least("by_chars", "by_bytes"), F.lit("free"))).drop("by_chars", "by_bytes")


def described(rows: DataFrame, grams: DataFrame) -> DataFrame:
    """Add script, last (the last three symbols) and odds (word log-odds in steps of STEP)."""

    @F.pandas_udf("script string, last string, run string")
    def describe(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for p in parts:
            out = []
            for t in p:
                run = _RUN.search(t)
                word = ("0" if run[1] else "^") + run[2].lower() if run else None
                out.append((script_of(t), last_symbols(t), word and word[-ORDER:]))
            yield pd.DataFrame(out, columns=["script", "last", "run"])

    seen = cut(rows.withColumn("d", describe("tail")).select("id", "source", "kind", "place", "d.script", "d.last", "d.run"))
    runs = cut(seen.where(F.col("run").isNotNull()).groupBy("run").agg(F.count("*").alias("copies")))
    known = attach_by_key(seen, word_odds(runs, grams), "run", "copies").drop("run", "copies")
    return known.unionByName(seen.where(F.col("run").isNull()).drop("run").withColumn("odds", F.lit(0.0)))


def inner_shares(rows: DataFrame) -> dict[str, float]:
    """Share of each symbol among the characters of all tails: what a cut at any place leaves last.

    ``TRACES`` stand apart: a text that goes on doesn't show them, so they share a hundredth each.
    """
    def sign(pattern):
        return F.sum(F.regexp_count("tail", F.lit(pattern)))

    each = {"a": sign(r"[\p{L}\p{M}]"), "0": sign(r"\p{N}"), "␠": sign(r"[^\S\n]"), "⏎": sign(r"\n"), "☺": sign(r"\p{So}")}
    each |= {m: F.sum(F.length("tail") - F.length(F.replace(F.col("tail"), F.lit(m), F.lit("")))) for m in MARKS if m not in TRACES}
    got = rows.agg(*[c.alias(f"c{i}") for i, c in enumerate(each.values())]).first()
    total = sum(n or 0 for n in got) or 1
    return {k: (n or 0) / total for k, n in zip(each, got)} | {t: 0.01 for t in TRACES}


class Fit:
    """The end-or-cut model of final contexts, fitted to counts of (kind, script, last, place, odds).

    It starts from the whole: what a cut leaves last are the symbols as they stand inside texts
    (``inside``), what an end shows is any symbol but a trace of a cut. START, the rates of cuts assumed
    first, weighs as much as two texts.
    """

    START = {"at": 0.9, "below": 0.3, "free": 0.02}
    NEVER = TRACES + "␠"

    def __init__(self, counts: list[tuple], inside: dict[str, float]):
        self.inside = inside
        self.rate: dict = {}
        self.end: dict = {}
        self.cut: dict = {}
        for _ in range(ROUNDS):
            self._round(counts)

    def chance(self, kind, script, last, place, odds) -> float:
        """log-odds that the text went on; a finished sentence is never cut inside one."""
        if complete(last):
            return -2 * CLIP
        p = min(max(self.rate.get((kind, place), self.START[place]), 1e-4), 1 - 1e-4)
        out = math.log(p / (1 - p)) + math.log(self._p(self.cut, (kind,), last, True)) - math.log(self._p(self.end, (kind, script), last, False))
        if last.endswith("a␠"):
            return out - min(odds, 0.0)
        return out - odds if place != "below" and last.endswith("a") else out

    def _p(self, table, group, last, is_cut) -> float:
        """Symbols leftwards: P(last symbol), then the two before it given it.

        Each is smoothed towards all records, then those of the kind, then those of kind and script.
        """
        out = 1.0
        for k in (1, 3):
            now, ctx = last[-k:], last[-1:] if k == 3 else ""
            p = 1.0 / 30
            if k == 1:
                p = max(self.inside.get(now, 0.0), 1e-3) if is_cut else (1e-6 if now in self.NEVER else 0.02)
            for level, weight in zip(("*", *(group[:n] for n in range(1, len(group) + 1))), (5, 3, 3)):
                own = table.get((level, k, ctx), {})
                p = (own.get(now, 0.0) + weight * p) / (own.get("", 0.0) + weight)
            out *= p
        return out

    def _round(self, counts) -> None:
        end, gone = defaultdict(lambda: defaultdict(float)), defaultdict(lambda: defaultdict(float))
        rate = defaultdict(lambda: [0.0, 0.0])
        for kind, script, last, place, odds, n in counts:
            x = self.chance(kind, script, last, place, odds)
            q = 1 / (1 + math.exp(-max(-30.0, min(30.0, x))))
            rate[kind, place][0] += q * n
            rate[kind, place][1] += n
            for table, group, m in ((end, (kind, script), (1 - q) * n), (gone, (kind,), q * n)):
                for k in (1, 3):
                    now, ctx = last[-k:], last[-1:] if k == 3 else ""
                    for level in ("*", *(group[:i] for i in range(1, len(group) + 1))):
                        table[level, k, ctx][now] += m
                        table[level, k, ctx][""] += m
        self.end, self.cut = end, gone
        for (kind, place), (a, b) in rate.items():
            self.rate[kind, place] = (a + 2 * self.START[place]) / (b + 2)


def truncated(docs: DataFrame, doc_id: str, text: str, source: str, kind: str) -> DataFrame:
    """(id, source, log_odds, cut) for every non-blank text; ``cut`` is log_odds > 0.

    Null and blank texts have no row. The text's n-grams, the length histograms and the fit cover all
    rows; the fit sees counts of (kind, script, last three symbols, place, odds step), whose number is
    bounded by the symbol set and the kinds. Equal rows get equal results; other columns aren't read.
    """
    rows = cut(tails(docs, doc_id, text, source, kind))
    seen = cut(described(placed(rows, limits(rows)), word_grams(docs, text)))
    keys = ["kind", "script", "last", "place", "odds"]
    counts = [tuple(r) for r in seen.groupBy(*keys).count().toLocalIterator()]
    fit = Fit(counts, inner_shares(rows))
    table = [(*c[:5], float(fit.chance(*c[:5]))) for c in counts]
    schema = "kind string, script string, last string, place string, odds double, log_odds double"
    odds = docs.sparkSession.createDataFrame(table, schema)
    return seen.join(odds, keys).select("id", "source", "log_odds", (F.col("log_odds") > 0).alias("cut"))

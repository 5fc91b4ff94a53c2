"""One consistent form for texts that look alike but differ in characters."""

from __future__ import annotations

import math
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import product

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxloom.llm.text import digest
from voxloom.operators.joins import attach_by_key
from voxloom.storage import cut

# Letters of Latin, Cyrillic, Greek, Armenian, Cherokee, Coptic and Lisu that look the same, one group a line.
LOOK_ALIKE = """
AАΑᎪꓮ
BВΒᏴꓐ
CСϹᏟⲤꓚ
DᎠꓓ
EЕΕᎬꓰ
FϜꓝ
GԌᏀꓖ
HНΗᎻⲎꓧ
IІΙⲒꓲ
JЈᎫꓙ
KКΚᏦⲔꓗ
LᏞꓡ
MМΜᎷⲘꓟ
NΝⲚꓠ
OОΟՕⲞꓳ
PРΡᏢⲢꓑ
QԚ
RᎡꓣ
SЅՏᏚꓢ
TТΤᎢⲦꓔ
UՍꓴ
VѴᏙꓦ
WԜᎳꓪ
XХΧⲬꓫ
YУΥҮⲨꓬ
ZΖᏃꓜ
ГΓᎱⲄ
ПΠⲠ
ФΦⲪ
aаα
cсϲⲥ
dԁ
eе
gց
hһհ
iіι
jјϳյ
kкκⲕ
lӏ
nո
oоοօⲟ
pрρⲣ
qԛզ
sѕ
uυս
vνѵ
wԝ
xхχⲭ
yуγү
""".split()
SCRIPTS = ("Latin", "Cyrillic", "Greek", "Armenian", "Cherokee", "Coptic", "Lisu")
KEPT = "…"  # a compatibility character that is ordinary punctuation here
ORDER = 3  # characters of an n-gram
CHANGE_COST = 1.0
SWITCH_COST = 14.0

_TWINS = {c: [x for x in group if x != c] for group in LOOK_ALIKE for c in group}
_SCRIPT = {s: regex.compile(rf"\p{{Script={s}}}") for s in SCRIPTS}
PLAIN = r"[^\n -~¡§«°»¿ა-ჰ–—‘-‟…]"  # what a text must have to need any work
_IGNORABLE = regex.compile(
    r"(?<=[\p{Extended_Pictographic}️‍\U0001F3FB-\U0001F3FF\U000E0020-\U000E007F])[‍️](?=[\p{Extended_Pictographic}])(*SKIP)(*FAIL)"
    r"|(?<=\p{Extended_Pictographic})️(*SKIP)(*FAIL)|\p{Default_Ignorable_Code_Point}"
)
_SPACE = regex.compile(r"[\p{Zs}\t]")
_WORD = regex.compile(r"[\p{L}\p{M}]{2,}")
_FOREIGN = "[" + "".join(rf"\p{{Is{s}}}" for s in SCRIPTS) + "]"


@lru_cache(maxsize=100_000)
def _script(c: str) -> str | None:
    """Which of SCRIPTS a letter belongs to; None for Georgian, marks and all others."""
    return next((s for s, p in _SCRIPT.items() if p.match(c)), None)


def settled(text: str) -> str:
    """Ignorable characters out, compatibility forms and split accents composed, spaces U+0020."""
    text = _IGNORABLE.sub("", text)
    text = KEPT.join(unicodedata.normalize("NFKC", part) for part in text.split(KEPT))
    return _SPACE.sub(" ", text)


def mixed_words(text: str) -> list[str]:
    """The distinct words of a settled text with letters of two scripts."""
    return sorted({w for w in _WORD.findall(text) if len({_script(c) for c in w} - {None}) > 1})


def lattice_grams(word: str) -> set[str]:
    """The n-grams of all readings of a word, and their contexts."""
    at = [("^",)] * (ORDER - 1) + [(c, *_TWINS.get(c, ())) for c in word] + [("$",)]
    grams = {"".join(g) for i in range(len(word) + 1) for g in product(*at[i : i + ORDER])}
    return grams | {g[:-1] for g in grams}


class WordReader:
    """The Viterbi search over look-alikes, given the counts of a word's ``lattice_grams``."""

    def __init__(self, grams: dict[str, int], letters: int):
        self.grams, self.letters = grams, letters

    def cost(self, context: str, c: str) -> float:
        """-log P(c | context) with add-half smoothing, plus SWITCH_COST where the script changes.

        Changes to Georgian (an ending on a foreign word) and from a word's start are free.
        """
        n, k = self.grams.get(context + c, 0), self.grams.get(context, 0)
        out = -math.log((n + 0.5) / (k + 0.5 * self.letters))
        a, b = _script(context[-1]), _script(c)
        return out + (SWITCH_COST if a and b and a != b else 0.0)

    def fix(self, word: str) -> str:
        """The cheapest reading of a word over its lattice of look-alikes."""
        best = {"^" * (ORDER - 1): (0.0, "")}
        for c in word:
            nxt: dict[str, tuple[float, str]] = {}
            for state, (cost, done) in best.items():
                for x in (c, *_TWINS.get(c, ())):
                    y = cost + self.cost(state, x) + (x != c) * CHANGE_COST
                    s = (state + x)[1:]
                    if s not in nxt or y < nxt[s][0]:
                        nxt[s] = (y, done + x)
            best = nxt
        return min((cost + self.cost(s, "$"), done) for s, (cost, done) in best.items())[1]


class ScriptModel:
    """Character trigrams of words that keep to one script, in a distributed table (gram, n).

    ``letters``, the number of distinct last characters, is all that the driver holds.
    """

    def __init__(self, grams: DataFrame, letters: int):
        self.grams, self.letters = grams, letters

    def readings(self, words: DataFrame) -> DataFrame:
        """(word, copies, reading) for rows of (word, copies), one per distinct word of two scripts.

        The n-grams of a word's lattice look up their counts by join.
        """
        letters = self.letters

        def spread(batches):
            for b in batches:
                rows = [(w, g) for w in b["word"] for g in lattice_grams(w)]
                yield pd.DataFrame(rows, columns=["word", "gram"])

        def read(batches):
            for b in batches:
                fixed = [WordReader(dict(zip(g, n)), letters).fix(w) for w, g, n in zip(b["word"], b["gram"], b["n"])]
                yield pd.DataFrame({"word": b["word"], "copies": b["copies"], "reading": fixed})

        asked = cut(words.select("word").mapInPandas(spread, "word string, gram string"))
        contexts = self.grams.groupBy(F.substring("gram", 1, ORDER - 1).alias("gram")).agg(F.sum("n").alias("n"))
        table = cut(asked.groupBy("gram").agg(F.count("*").alias("askers")).join(self.grams.unionByName(contexts), "gram"))
        entry = F.struct("gram", "n").alias("g")
        found = attach_by_key(asked, table, "gram", "askers").select("word", F.lit(0).cast("long").alias("copies"), entry)
        blank = F.lit(None).cast(found.schema["g"].dataType).alias("g")  # a word of which nothing is known keeps its row
        found = found.unionByName(words.select("word", "copies", blank)).groupBy("word").agg(F.sum("copies").alias("copies"), F.collect_list("g").alias("g"))
        return found.select("word", "copies", "g.gram", "g.n").mapInPandas(read, "word string, copies long, reading string")

    def consistent(self, text: str | None) -> str | None:
        """The consistent form of one text; null stays null and '' stays ''. Applying it twice changes nothing more."""
        form, words = _parts(text)
        if not words:
            return form
        rows = self.grams.sparkSession.createDataFrame([(w, 1) for w in words], "word string, copies long")
        got = {r["word"]: r["reading"] for r in self.readings(rows).collect()}
        return _replaced(form, got)


def _parts(text: str | None) -> tuple[str | None, list[str]]:
    """The settled text and its words of two scripts."""
    if text is None:
        return None, []
    form = settled(text)
    return form, mixed_words(form)


def _replaced(text: str, readings: dict[str, str]) -> str:
    return _WORD.sub(lambda m: readings.get(m.group(), m.group()), text)


def train(values: DataFrame, text: str) -> ScriptModel:
    """Fit the model on all ``values``: words with a foreign letter that keep to one foreign script.

    Words are counted by partial aggregation, then the trigrams of distinct words by count. All are kept,
    at every size; letters of other scripts may stand in such words, so their number has no small bound.
    """
    every = F.filter(F.regexp_extract_all(F.col(text), F.lit(r"[\p{L}\p{M}]+"), F.lit(0)), lambda w: w.rlike(_FOREIGN))
    counted = values.where(F.col(text).rlike(_FOREIGN)).select(F.explode(every).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    mixed = F.lit(0)
    for s in SCRIPTS:
        mixed = mixed + F.col("w").rlike(rf"\p{{Is{s}}}").cast("int")
    padded = F.concat(F.lit("^" * (ORDER - 1)), "w", F.lit("$"))
    each = F.transform(F.sequence(F.lit(1), F.length("w") + 1), lambda i: F.substring(padded, i, F.lit(ORDER)))
    grams = cut(counted.where(mixed == 1).select("n", F.explode(each).alias("gram")).groupBy("gram").agg(F.sum("n").alias("n")))
    return ScriptModel(grams, max(grams.select(F.substring("gram", ORDER, 1)).distinct().count(), 1))


def with_consistent(df: DataFrame, text: str, model: ScriptModel, out: str = "form") -> DataFrame:
    """Add ``out``, the consistent form of ``text``.

    Texts in plain characters stay in the JVM, and those without words of two scripts pass without a
    shuffle. Of the others the distinct words
    are read once each, and their readings come back by join, under a digest of the settled text.
    """

    @F.pandas_udf("form string, words array<string>")
    def parts(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for p in texts:
            yield pd.DataFrame([_parts(t) for t in p], columns=["form", "words"])

    @F.pandas_udf("string")
    def replace(form: pd.Series, words: pd.Series, readings: pd.Series) -> pd.Series:
        return pd.Series([_replaced(f, dict(zip(w, r))) for f, w, r in zip(form, words, readings)], dtype=object)

    columns = [F.col(c) for c in df.columns]
    plain = ~F.coalesce(F.col(text).rlike(PLAIN), F.lit(False))
    rows = df.where(~plain).withColumn("_p", parts.asNondeterministic()(F.col(text)))  # else a filter on it evaluates it twice
    several = F.size("_p.words") > 0
    found = cut(rows.where(several).select(*columns, F.col("_p.form").alias("_form"), F.col("_p.words").alias("_words")).withColumn("_key", digest(F.col("_form"))))
    texts = cut(found.groupBy("_key").agg(F.first("_words").alias("_words"), F.count("*").alias("_copies")))
    pairs = cut(texts.select("_key", "_copies", F.explode("_words").alias("word")))
    readings = cut(model.readings(cut(pairs.groupBy("word").agg(F.count("*").alias("copies")))))
    read = attach_by_key(pairs, readings, "word", "copies")
    table = cut(read.groupBy("_key").agg(F.max("_copies").alias("_copies"), F.collect_list(F.struct("word", "reading")).alias("_r")))
    done = attach_by_key(found, table, "_key", "_copies").withColumn(out, replace("_form", "_r.word", "_r.reading"))
    passed = df.where(plain).select(*columns, F.col(text).alias(out))
    return passed.unionByName(rows.where(~several).select(*columns, F.col("_p.form").alias(out))).unionByName(done.select(*columns, out))


def fields(df: DataFrame, tbl: str, key: str, *names: str) -> DataFrame:
    """(tbl, field, row_key, text), one row per value of the named fields."""
    each: list[Column] = [F.struct(F.lit(n).alias("field"), F.col(n).alias("text")) for n in names]
    return df.select(F.lit(tbl).alias("tbl"), F.col(key).alias("row_key"), F.explode(F.array(*each)).alias("v")).select(
        "tbl", "v.field", "row_key", "v.text"
    )

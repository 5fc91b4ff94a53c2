"""Sequential folds over ordered rows of a key, with memory bounded by one batch."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.config import CHUNK, SEGMENT
from voxloom.functions.text import SENTENCE_END
from voxloom.schemas import SEGMENT as SEGMENT_SCHEMA


def fold_in_order(
    df: DataFrame, key: str, order: list[str], schema: str, start: Callable[[Any], Any], step: Callable[[Any, pd.DataFrame], list[dict]],
    finish: Callable[[Any], list[dict]] | None = None,
) -> DataFrame:
    """Run a stateful fold over each key's rows in ``order``.

    ``start(key)`` makes a state, ``step(state, frame)`` consumes the next rows and returns output rows,
    ``finish(state)`` returns the last ones. Rows of a key are sorted by Spark (spilling if needed) and
    pass in batches, so a long key costs time in one task but not memory; use it only for folds whose
    next state truly depends on all rows before.
    """
    names = [f.split()[0] for f in schema.split(",")]
    rows = df.repartition(key).sortWithinPartitions(key, *[F.col(c).asc_nulls_first() for c in order])

    def run(batches):
        have, state = object(), None
        for b in batches:
            out: list[dict] = []
            for k, frame in b.groupby(key, sort=False, dropna=False):
                if k != have and not (pd.isna(k) and isinstance(have, float)):
                    if state is not None and finish:
                        out += finish(state)
                    have, state = k, start(k)
                out += step(state, frame)
            yield pd.DataFrame(out, columns=names)
        if state is not None and finish:
            yield pd.DataFrame(finish(state), columns=names)

    return rows.mapInPandas(run, schema)


def bounded_merge(intervals: DataFrame, key: str, start: str = "start_sec", end: str = "end_sec",
                  longest: float = CHUNK.vad_max, gap: float = CHUNK.vad_gap) -> DataFrame:
    """(key, start_sec, end_sec, parts): join neighbours while the gap is under ``gap`` and the whole is at most ``longest``.

    Intervals with a null bound are left out; ties in start are ordered by end.
    """
    def begin(k):
        return {"key": k, "open": None}

    def close(s):
        o = s["open"]
        return [] if o is None else [{key: s["key"], "start_sec": o[0], "end_sec": o[1], "parts": o[2]}]

    def step(s, frame):
        out = []
        for a, z in zip(frame[start], frame[end]):
            o = s["open"]
            if o is not None and z - o[0] <= longest and a - o[1] < gap:
                s["open"] = (o[0], z, o[2] + 1)
            else:
                out += close(s)
                s["open"] = (a, z, 1)
        return out

    rows = intervals.where(F.col(start).isNotNull() & F.col(end).isNotNull()).select(key, start, end)
    return fold_in_order(rows, key, [start, end], f"{key} string, start_sec double, end_sec double, parts int", begin, step, close)


def absorb_short(chunks: DataFrame, key: str, shortest: float = CHUNK.vad_min, longest: float = CHUNK.vad_max) -> DataFrame:
    """A chunk under ``shortest`` extends the one before if their durations together are at most ``longest``.

    The gap does not count; without a predecessor, or where it would not fit, the short chunk stays.
    Chunks over ``longest`` pass unchanged and may be extended no further.
    """
    def begin(k):
        return {"key": k, "last": None}

    def close(s):
        return [] if s["last"] is None else [{key: s["key"], "start_sec": s["last"][0], "end_sec": s["last"][1]}]

    def step(s, frame):
        out = []
        for a, z in zip(frame["start_sec"], frame["end_sec"]):
            p = s["last"]
            if p is not None and z - a < shortest and (p[1] - p[0]) + (z - a) <= longest:
                s["last"] = (p[0], z)
            else:
                out += close(s)
                s["last"] = (a, z)
        return out

    return fold_in_order(chunks, key, ["start_sec", "end_sec"], f"{key} string, start_sec double, end_sec double", begin, step, close)


def remerge(parts: DataFrame, key: str, longest: float = CHUNK.vad_max) -> DataFrame:
    """Join consecutive parts while the whole is at most ``longest``, whatever the gaps."""
    return bounded_merge(parts, key, longest=longest, gap=float("inf"))


def _sentences(begin: list[float], end: list[float], closes: list[bool]) -> list[tuple[int, int]]:
    """Half-open row ranges of one chunk's segments.

    A segment ends after a word if it is long enough and the word closes a sentence before a pause, or
    any longer pause follows, or if it is too long and a short pause follows. Rows left at the end join
    the segment before if the whole is not too long, else stand alone; without a segment before, or when
    shorter than the least leftover, they are lost.
    """
    n, out, first = len(begin), [], 0
    for i in range(n):
        pause = begin[i + 1] - end[i] if i + 1 < n else float("inf")
        length = end[i] - begin[first]
        full = length >= SEGMENT.min_seconds and (pause > SEGMENT.pause or closes[i] and pause > SEGMENT.sentence_pause)
        if full or (length > SEGMENT.max_seconds and pause > SEGMENT.long_pause):
            out.append((first, i + 1))
            first = i + 1
    if first < n and out and end[n - 1] - begin[first] >= SEGMENT.leftover_seconds:
        if end[n - 1] - begin[out[-1][0]] <= SEGMENT.max_seconds:
            out[-1] = (out[-1][0], n)
        else:
            out.append((first, n))
    return out


def sentence_segments(words: DataFrame) -> DataFrame:
    """Word timings to sentence segments per (recording_id, chunk_idx), in ordinal order; see SEGMENT.

    Repeated rows count once; words with a null bound or text are left out. Rows are spread by recording
    and chunk (a stretch of speech of bounded length), sorted, and folded chunk after chunk in batches;
    a chunk is held until the next one begins.
    """
    keys = ["recording_id", "chunk_idx"]
    rows = words.select(*keys, "ordinal", "word", "start_sec", "end_sec").dropna().distinct()
    rows = rows.withColumn("closes", F.col("word").rlike(SENTENCE_END))
    rows = rows.repartition(*keys).sortWithinPartitions(*keys, "ordinal", "start_sec", "end_sec", "word")
    names = [c.split()[0] for c in SEGMENT_SCHEMA.split(", ")]

    def segments(key, held):
        _, _, word, begin, end, closes = zip(*held)
        for seg, (a, z) in enumerate(_sentences(begin, end, closes)):
            yield (*key, seg, " ".join(word[a:z]), begin[a], end[z - 1], end[z - 1] - begin[a], z - a)

    def run(batches):
        key, held = None, []
        for b in batches:
            out = []
            for row in b[[*keys, "word", "start_sec", "end_sec", "closes"]].itertuples(index=False, name=None):
                if row[:2] != key:
                    if held:
                        out += segments(key, held)
                    key, held = row[:2], []
                held.append(row)
            yield pd.DataFrame(out, columns=names)
        if held:
            yield pd.DataFrame(list(segments(key, held)), columns=names)

    return rows.mapInPandas(run, SEGMENT_SCHEMA)


def token_spans(frames: DataFrame, keys: list[str], frame: str = "frame", token: str = "token") -> DataFrame:
    """(keys, span, token, first, past): runs of one non-blank token (blank is 0) in consecutive frames.

    Groups are one chunk each. Spans are numbered from 0.
    """
    from pyspark.sql import Window

    w = Window.partitionBy(*keys).orderBy(frame)
    f = frames.withColumn("_new", F.coalesce((F.col(token) != F.lag(token).over(w)).cast("int"), F.lit(1)))
    f = f.withColumn("_run", F.sum("_new").over(w))
    runs = f.groupBy(*keys, "_run").agg(F.first(token).alias("token"), F.min(frame).alias("first"), (F.max(frame) + 1).alias("past"))
    runs = runs.where("token <> 0")
    return runs.withColumn("span", F.row_number().over(Window.partitionBy(*keys).orderBy("_run")) - 1).drop("_run")


def words_from_spans(spans: DataFrame, words: DataFrame, keys: list[str], seconds_per_frame: float) -> DataFrame:
    """(keys, ordinal, word, start_sec, end_sec): word i takes as many spans as it has tokens, in order.

    ``words`` has ordinal, word and n_tokens. Words without tokens, or after the spans have run out, get
    no row; a word that spans run out on ends with the last one.
    """
    from pyspark.sql import Window

    w = Window.partitionBy(*keys).orderBy("ordinal")
    need = words.withColumn("_to", F.sum("n_tokens").over(w)).withColumn("_from", F.col("_to") - F.col("n_tokens")).where("n_tokens > 0")
    j = need.join(spans, keys).where("span >= _from AND span < _to")
    return j.groupBy(*keys, "ordinal", "word").agg(
        (F.min("first") * seconds_per_frame).alias("start_sec"), (F.max("past") * seconds_per_frame).alias("end_sec")
    )

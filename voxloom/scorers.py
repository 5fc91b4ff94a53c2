"""The seam for external models: a batch scorer runs next to the data and adds columns."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame


class Scorer(Protocol):
    """Made once per Python worker, then called for batches of rows.

    Returns one row per input row in the same order with the columns of ``schema``.
    """

    schema: str

    def __call__(self, frame: pd.DataFrame) -> pd.DataFrame: ...


def score(df: DataFrame, make: Callable[[], Scorer], schema: str, batch: int = 64) -> DataFrame:
    """Adds the columns of ``schema`` and error. A failing batch is retried row by row; a failing row gets
    nulls and the message in error, so one bad record never loses its neighbours."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = make()

        def one(part: pd.DataFrame) -> pd.DataFrame:
            try:
                got = scorer(part)[names].reset_index(drop=True)
                return pd.concat([part.reset_index(drop=True), got.assign(error=None)], axis=1)
            except Exception as e:
                if len(part) > 1:
                    return pd.concat([one(part.iloc[i : i + 1]) for i in range(len(part))], ignore_index=True)
                empty = pd.DataFrame({n: [None] for n in names})
                return pd.concat([part.reset_index(drop=True), empty.assign(error=str(e)[:200])], axis=1)

        for frame in frames:
            for at in range(0, len(frame), batch):
                yield one(frame.iloc[at : at + batch])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInPandas(run, f"{fields}, {schema}, error string")


class EchoTranscriber:
    """Deterministic stand-in for a speech recogniser: returns the text without its every ``skip``-th word."""

    schema = "asr_text string"

    def __init__(self, text: str = "text", skip: int = 7):
        self.text, self.skip = text, skip

    def __call__(self, frame: pd.DataFrame) -> pd.DataFrame:
        words = [(t or "").split() for t in frame[self.text]]
        return pd.DataFrame({"asr_text": [" ".join(w for i, w in enumerate(ws, 1) if i % self.skip) for ws in words]})


# What each external model receives and returns. ``one`` scorers return a row per row, ``many`` any number.
CONTRACTS = {
    "loudness": ("one", "loudness double, duration double"),
    "enhancement": ("one", "enhanced boolean"),
    "speech_quality": ("one", "nisqa_mos double, nisqa_noisiness double, nisqa_discontinuity double, nisqa_coloration double, nisqa_loudness double"),
    "transcript": ("one", "asr_text string"),
    "silence_trim": ("one", "trimmed_duration double"),
    "speaker_embedding": ("one", "embedding array<float>"),
    "spectral_distance": ("one", "mcd double"),
    "speech_intervals": ("many", "recording_id string, ordinal int, start_sec double, end_sec double"),
    "word_timings": ("many", "recording_id string, chunk_idx int, ordinal int, word string, start_sec double, end_sec double, score double"),
}


def attach(df: DataFrame, contract: str, make: Callable[[], Scorer], batch: int = 64) -> DataFrame:
    """``score`` or ``expand`` with the columns of a contract; a scorer that returns others fails its rows."""
    kind, schema = CONTRACTS[contract]
    return (score if kind == "one" else expand)(df, make, schema, batch)


def expand(df: DataFrame, make: Callable[[], Scorer], schema: str, batch: int = 64) -> DataFrame:
    """Rows of ``schema`` plus error from a scorer that returns any number of rows per row.

    A failing batch is retried row by row; a failing row gives one row of nulls with the message in error.
    """
    names = [c.split()[0] for c in schema.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = make()

        def one(part: pd.DataFrame) -> pd.DataFrame:
            try:
                return scorer(part)[names].assign(error=None)
            except Exception as e:
                if len(part) > 1:
                    return pd.concat([one(part.iloc[i : i + 1]) for i in range(len(part))], ignore_index=True)
                return pd.DataFrame({n: [None] for n in names}).assign(error=str(e)[:200])

        for frame in frames:
            for at in range(0, len(frame), batch):
                yield one(frame.iloc[at : at + batch])

    return df.mapInPandas(run, f"{schema}, error string")


class FixedScorer:
    """Stand-in that returns the same values for every row, for plans without a model at hand."""

    def __init__(self, **values):
        self.values = values

    def __call__(self, frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({k: [v] * len(frame) for k, v in self.values.items()})


class EvenIntervals:
    """Stand-in for speech detection: stretches of ``speech`` seconds with pauses of ``pause`` up to a recording's duration."""

    def __init__(self, speech: float = 8.0, pause: float = 0.5):
        self.speech, self.pause = speech, pause

    def __call__(self, frame: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for recording, seconds in zip(frame["recording_id"], frame["duration"]):
            for i in range(int(seconds // (self.speech + self.pause)) + 1):
                start = i * (self.speech + self.pause)
                if start < seconds:
                    rows.append((recording, i, start, min(start + self.speech, seconds)))
        return pd.DataFrame(rows, columns=["recording_id", "ordinal", "start_sec", "end_sec"])

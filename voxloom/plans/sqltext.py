"""Fragments of oracle SQL that several queries share."""

from __future__ import annotations

from voxloom.functions.text import GEORGIAN, SPACE, WORD

CLIPS = (
    "clips AS (SELECT DISTINCT id, audio_path, text, speaker_id, duration, book_title, has_punctuation, multi_speaker"
    " FROM train_manifest)"
)
EVALS = CLIPS.replace("clips AS", "evals AS").replace("multi_speaker FROM train_manifest", "multi_speaker, split FROM eval_manifest")
SEGMENTS = (
    "segs AS (SELECT DISTINCT segment_id, recording_id, text, asr_text, book_text, start_sec, end_sec, duration_sec, cer, speaker_id"
    " FROM segment)"
)
CHUNKS = "chunks AS (SELECT DISTINCT * FROM aligned_chunk)"


def drawn(c: str, seed: int) -> str:
    return f"CAST('0x' || substr(md5({c} || ':{seed}'), 1, 15) AS BIGINT)"


def stripped(c: str) -> str:
    return f"regexp_replace({c}, '^[{SPACE}]+|[{SPACE}]+$', '', 'g')"


def collapsed(c: str) -> str:
    return f"trim(regexp_replace({c}, '[{SPACE}]+', ' ', 'g'))"


def norm(c: str) -> str:
    return collapsed(f"regexp_replace({c}, '[^{WORD}{SPACE}]', '', 'g')")


def ratio(c: str) -> str:
    letters = rf"regexp_replace({c}, '[^\p{{L}}]', '', 'g')"
    return f"CASE WHEN length({letters}) > 0 THEN length(regexp_replace({letters}, '[^{GEORGIAN}]', '', 'g'))::DOUBLE / length({letters}) WHEN {c} IS NOT NULL THEN 0.0 ELSE 0.0 END"


def units(c: str, of: str) -> str:
    """The characters, or the space-separated words, of a string as a list."""
    return rf"regexp_extract_all({c}, '(?s).')" if of == "chars" else rf"regexp_extract_all({c}, '[^ ]+')"


def edits(source: str, a: str, b: str, of: str = "chars") -> str:
    """CTEs enc, dist: every distinct unit of a pair becomes one byte, so a byte distance counts units."""
    x, y = units(a, of), units(b, of)
    code = "array_to_string(list_transform({u}, lambda c: chr(CAST(list_position(v, c) AS INTEGER))), '')"
    return (
        f"enc AS (SELECT *, {x} AS ua, {y} AS ub, list_distinct(list_concat({x}, {y})) AS v FROM {source}),\n"
        f"dist AS (SELECT *, levenshtein({code.format(u='ua')}, {code.format(u='ub')}) AS d FROM enc)"
    )


def seg_number(c: str) -> str:
    return rf"coalesce(try_cast(regexp_extract({c}, '(?s)^.*seg_([0-9]{{1,9}})$', 1) AS INTEGER), -1)"


def fraction(c: str) -> str:
    return f"(('0x' || substr(md5({c}), 1, 8))::BIGINT / 4294967295.0::DOUBLE)"

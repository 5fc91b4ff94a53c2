"""Explicit schemas; JSON is never read by inference."""

from __future__ import annotations

CLIP = "id string, audio_path string, text string, speaker_id string, duration double"
ENRICHED = CLIP + (
    ", nisqa_mos double, nisqa_noisiness double, nisqa_discontinuity double, nisqa_coloration double,"
    " nisqa_loudness double, char_duration double, asr_cer double, asr_text string"
)
CORPUS = CLIP + ", book_title string, has_punctuation boolean, multi_speaker boolean"
SHARD = CORPUS.replace("audio_path string, ", "") + ", audio struct<bytes: binary>"
TRAINER = (
    "audio_filepath string, text string, duration double, speaker int, target_audio_codes_path string,"
    " context_audio_filepath string, context_audio_duration double, context_audio_codes_path string"
)
REFERENCE_TEXT = "title string, text string"
INTERVAL = "recording_id string, ordinal int, start_sec double, end_sec double"
WORD = "recording_id string, chunk_idx int, ordinal int, word string, start_sec double, end_sec double, score double"
SEGMENT = (
    "recording_id string, chunk_idx int, seg int, text string, start_sec double, end_sec double, duration_sec double, words int"
)
HYPOTHESIS = "chunk_id string, text string"

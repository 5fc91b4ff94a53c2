"""Thresholds of the curation pipelines. The numbers are fixed values that results depend on."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class QualityConfig:
    stages: tuple[str, ...] = ("standardize", "enhance", "nisqa", "duration_outlier", "transcript_verify", "speaker_select")
    min_duration: float = 0.5
    max_duration: float = 30.0
    min_mos: float = 0.0
    min_trimmed: float = 0.3
    iqr_factor: float = 1.5
    max_cer: float = 0.20
    min_speaker_seconds: float = 1400.0
    max_speakers: int = 50
    min_cluster: int = 50


@dataclass(frozen=True)
class ChunkConfig:
    min_seconds: float = 1.5
    max_seconds: float = 40.0
    slack: float = 1.1
    merge_gap: float = 0.3
    vad_min: float = 3.0
    vad_max: float = 35.0
    vad_gap: float = 1.5


@dataclass(frozen=True)
class SegmentConfig:
    min_seconds: float = 3.0
    max_seconds: float = 25.0
    leftover_seconds: float = 1.5
    sentence_pause: float = 0.2
    pause: float = 0.4
    long_pause: float = 0.15


@dataclass(frozen=True)
class FilterConfig:
    max_cer: float = 0.20
    min_script: float = 0.80
    min_cps: float = 3.0
    max_cps: float = 25.0
    max_compression: float = 3.5
    repeated_chars: int = 4
    repeated_words: int = 3
    min_chars: int = 5
    v2_min_chars: int = 10
    v2_min_seconds: float = 3.0
    v2_max_seconds: float = 27.5
    mismatch_cer: float = 0.4


@dataclass(frozen=True)
class PrepConfig:
    min_seconds: float = 1.5
    max_seconds: float = 25.0
    min_cps: float = 5.0
    max_cps: float = 25.0
    min_text: int = 3
    clip_start: int = 3
    clip_end: int = 3
    eval_ratio: float = 0.02
    train_ratio: float = 0.98
    index_offset: int = 5


QUALITY, CHUNK, SEGMENT, FILTER, PREP = QualityConfig(), ChunkConfig(), SegmentConfig(), FilterConfig(), PrepConfig()

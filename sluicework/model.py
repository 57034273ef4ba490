"""Vocabularies and fixed values of the data model."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
LANES = ["realtime", "standard", "bulk"]
LANE_SHARES = [0.40, 0.50, 0.10]
STATES = ["pending", "admitted", "running", "done", "failed", "canceled"]
HOLDS_SLOT = ["admitted", "running"]
TERMINAL = ["done", "failed", "canceled"]
WARNINGS = [
    "variable_frame_rate", "rotation_metadata", "non_monotonic_timestamps", "start_time_offset", "no_keyframe_index", "sparse_keyframes",
    "unknown_duration", "multiple_video_streams", "no_audio", "interlaced", "non_square_pixels", "hdr_transfer",
]
NEEDS_NORMALISING = ["variable_frame_rate", "rotation_metadata", "non_monotonic_timestamps", "start_time_offset", "interlaced", "non_square_pixels"]
MUST_NOT_SURVIVE = ["variable_frame_rate", "rotation_metadata", "non_monotonic_timestamps"]
HDR_TRANSFERS = ["smpte2084", "arib-std-b67"]
SEVERITIES = ["error", "warning", "info"]
SPARSE_GAP_MS, MIN_SPLITTABLE_MS, SPLIT_TARGET_MS = 15_000, 120_000, 10_000
STRAGGLER_FLOOR_MS, STRAGGLER_FACTOR = 60_000, 4
MATCH_DISTANCE, HASH_WIDTH, HASH_HEIGHT = 10, 9, 8
SAMPLES = 60
GATE_VMAF = 93.0
CREDIT_BAND = 1.0
TOTAL_SLOTS, TICK_MS, STALL_SECONDS, MAX_ATTEMPTS, SWEEP_EVERY_TICKS = 64, 250, 300, 5, 240
CHUNK_ATTEMPTS = 4
MAX_THREADS = 16
SEGMENT_SECONDS = 2
CODEC_NAMES = {"h264": "h264", "avc": "h264", "x264": "h264", "libx264": "h264", "h265": "h265", "hevc": "h265", "x265": "h265", "libx265": "h265", "av1": "av1"}


def rank(value: Column, vocabulary: list[str]) -> Column:
    """Position of a word in its vocabulary, 0-based; null for an unknown word."""
    return F.nullif(F.array_position(F.array(*map(F.lit, vocabulary)), value), F.lit(0)) - 1


def checked(value: Column, vocabulary: list[str], what: str) -> Column:
    """The word itself; an unknown one is an error, not a default."""
    return F.when(value.isin(vocabulary), value).otherwise(F.raise_error(F.concat(F.lit(f"unknown {what}: "), F.coalesce(value, F.lit("null")))))

"""Playback and analysis verdicts on measured facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import policy
from ..functions import scalar

_c = F.col


def metadata_lies() -> Column:
    """The header's count is off by over 1 %, or its rate by over 5 %; false where nothing was measured."""
    count = (_c("declared_frame_count") > 0) & (F.abs(_c("declared_frame_count") - _c("frame_count")) / _c("frame_count") > policy.COUNT_TOLERANCE)
    rate = (_c("declared_fps") > 0) & (F.abs(_c("declared_fps") - _c("fps")) / _c("fps") > policy.RATE_TOLERANCE)
    return F.when((_c("frame_count") <= 0) | (_c("fps") <= 0), F.lit(False)).otherwise(count | rate)


def rules(profile: policy.PlaybackProfile, t: policy.Thresholds) -> list[tuple[str, Column, bool, bool]]:
    """(reason, when it holds, concerns playback, concerns analysis)."""
    source, codec, fps = _c("timing_source"), _c("codec_name"), _c("fps")
    truncated = scalar.truncated(_c("duration"), _c("declared_duration"), t.truncation_duration_ratio)
    unsupplied = source.isin("absent", "synthesized")
    disordered = (_c("coded_reordering_depth") > 0) & source.isin("decode", "synthesized", "absent")
    return [
        ("unsupported_container", ~_c("container").isin(*profile.containers), True, False),
        ("unsupported_codec", ~codec.isin(*profile.codecs), True, False),
        ("variable_frame_rate", scalar.supplied(source) & ~_c("constant_frame_rate"), True, True),
        ("rotated", _c("rotation_degrees") != 0, True, True),
        ("non_square_pixels", ~_c("square_pixels"), True, True),
        ("non_zero_start_time", F.when(fps > 0, F.abs(_c("start_time")) > t.start_time_frame_periods / fps), True, False),
        ("interlaced", ~_c("progressive"), True, True),
        ("unverified_frame_correspondence", ~codec.isin(*t.frame_exact_codecs), False, True),
        ("client_dependent_decode", codec.isin(*profile.client_dependent_codecs) | ~_c("pixel_format").isin(*profile.baseline_pixel_formats), True, False),
        ("moov_not_at_start", ~_c("moov_at_start"), True, False),
        ("large_seek_payload", _c("max_gop_bytes") > t.max_gop_bytes, True, False),
        ("sparse_keyframes", _c("max_keyframe_interval_frames") > t.max_keyframe_interval_frames, True, False),
        ("unreliable_timing_metadata", (~truncated & metadata_lies()) | unsupplied, False, True),
        ("presentation_timing_requires_decode", (source == "synthesized") | disordered, True, True),
    ]


def derive(facts: DataFrame, profile: policy.PlaybackProfile = policy.PROFILE, thresholds: policy.Thresholds = policy.THRESHOLDS) -> DataFrame:
    """facts with playable, stream_transcode, analysis_transcode, stream_reasons, analysis_reasons (sorted arrays), truncated.

    A null fact fires no rule that needs it.
    """
    made = rules(profile, thresholds)
    pick = lambda i: F.array_sort(F.array_compact(F.array(*[F.when(r[1], r[0]) for r in made if r[i]])))
    out = facts.withColumns({"stream_reasons": pick(2), "analysis_reasons": pick(3), "truncated": scalar.truncated(_c("duration"), _c("declared_duration"), thresholds.truncation_duration_ratio)})
    hard = F.arrays_overlap("stream_reasons", F.array(*map(F.lit, policy.HARD_STREAM_REASONS)))
    return out.withColumns(
        {
            "stream_transcode": F.when(hard, "required").when(F.size("stream_reasons") > 0, "recommended"),
            "analysis_transcode": F.when(F.size("analysis_reasons") > 0, "required"),
            "playable": ~hard,
        }
    )

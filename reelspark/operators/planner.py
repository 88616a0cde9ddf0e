"""The cheapest repair for a verdict, and its command line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import policy
from ..functions import scalar

_c = F.col
BASE = ("ffmpeg", "-hide_banner", "-v", "error", "-y")
AV1_CPU, AV1_HARDWARE = "libsvtav1", "av1_nvenc"


def _has(column: str, *names: str) -> Column:
    return F.arrays_overlap(_c(column), F.array(*map(F.lit, names)))


def minimum_operation(target: str) -> Column:
    """reencode_av1, a remux, or null, before the output container is looked at."""
    if target == "analysis":
        return F.when(_has("analysis_reasons", *policy.REENCODE_ANALYSIS_REASONS), "reencode_av1").when(_has("analysis_reasons", "unreliable_timing_metadata"), "remux_timebase")
    return (
        F.when(_has("stream_reasons", *policy.REENCODE_STREAM_REASONS), "reencode_av1")
        .when(_has("stream_reasons", "unsupported_container"), "remux_container")
        .when(_has("stream_reasons", "moov_not_at_start"), "remux_faststart")
    )


def select_operation(target: str) -> Column:
    """A copy becomes a re-encode where mp4 can't carry the codec or where packets don't all decode."""
    least = minimum_operation(target)
    undeliverable = ~_c("codec_name").isin(*policy.MP4_COPY_CODECS) | (_c("discard_flagged_packets") > 0) | (_c("leading_non_keyframe_frames") > 0)
    return F.when(least.isNotNull() & undeliverable, "reencode_av1").otherwise(least)


def encoder(allow_hardware: Column, usable: Column, requested: str | None = None) -> Column:
    return F.lit(requested) if requested else F.when(allow_hardware & usable, AV1_HARDWARE).otherwise(AV1_CPU)


def _args(*words) -> Column:
    return F.array(*[w if isinstance(w, Column) else F.lit(str(w)) for w in words]) if words else F.array().cast("array<string>")


def _fixed(x: Column) -> Column:
    return F.format_string("%.6f", x)


def copy_argv(source: Column, destination: Column, flags: Column, fps: Column) -> Column:
    stamps = F.when(fps > 0, _args("-bsf:v", F.concat(F.lit("setts=ts=N/"), _fixed(fps), F.lit("/TB")))).otherwise(_args())
    return F.concat(_args(*BASE), flags, _args("-i", source, "-c", "copy"), stamps, _args("-movflags", "+faststart", destination))


def reencode_argv(source: Column, destination: Column, e: policy.Encoding, name: Column) -> Column:
    filters = F.concat_ws(",", F.when(~_c("progressive"), "yadif"), F.when(~_c("square_pixels"), "scale=trunc(iw*sar/2)*2:trunc(ih/2)*2,setsar=1"))
    fps = F.when(_c("fps") > 0, _c("fps")).otherwise(_c("declared_fps"))
    hardware = _args("-c:v", AV1_HARDWARE, "-preset", e.nvenc_preset, "-cq", e.quality)
    audio = F.when(_c("has_audio"), _args("-c:a", "aac")).otherwise(_args("-an")) if e.keep_audio else _args("-an")
    return F.concat(
        _args(*BASE, "-flags2", "+showall"),
        F.when(_c("discard_flagged_packets") > 0, _args("-ignore_editlist", "1")).otherwise(_args()),
        _args("-i", source),
        F.when(filters != "", _args("-vf", filters)).otherwise(_args()),
        F.when(fps > 0, _args("-r", _fixed(fps), "-fps_mode", "cfr")).otherwise(_args()),
        F.when(name == AV1_HARDWARE, hardware).otherwise(_args("-c:v", name, "-preset", e.cpu_preset, "-crf", e.quality)),
        _args("-pix_fmt", e.pixel_format),
        _args("-g", e.keyframe_interval) if e.keyframe_interval is not None else _args(),
        audio,
        _args("-movflags", "+faststart", destination),
    )


def build_command(verdicts: DataFrame, target: str, encoding: policy.Encoding, allow_hardware: bool = False, usable: Column | None = None) -> DataFrame:
    """verdicts with operation, argv, encoder_name, reasons, error; needs columns source and destination.

    Without an operation argv is null. A file without timing and without a stated rate is
    refused: error tells so, and argv is null.
    """
    op, name = _c("operation"), encoder(F.lit(allow_hardware), F.lit(False) if usable is None else usable, encoding.encoder)
    stamp = F.when(_c("timing_source") == "absent", _c("declared_fps")).otherwise(0.0)
    refused = op.isNotNull() & (_c("timing_source") == "absent") & (_c("declared_fps") <= 0)
    genpts = F.when((op == "remux_timebase") & (stamp <= 0), _args("-fflags", "+genpts")).otherwise(_args())
    argv = F.when(op == "reencode_av1", reencode_argv(_c("source"), _c("destination"), encoding, name)).when(op.isNotNull(), copy_argv(_c("source"), _c("destination"), genpts, stamp))
    out = verdicts.withColumn("operation", select_operation(target)).withColumn("error", F.when(refused, "states no frame rate"))
    fine = _c("error").isNull()
    return out.withColumns(
        {
            "argv": F.when(fine, argv),
            "encoder_name": F.when(fine & (op == "reencode_av1"), name).when(fine & op.isNotNull(), ""),
            "reasons": F.when(op.isNotNull(), _c("analysis_reasons" if target == "analysis" else "stream_reasons")),
        }
    )


def resolve_output(source: Column, output: Column, is_dir: Column) -> tuple[Column, Column]:
    """(destination, error): a directory gets the source's stem with .mp4; another suffix and the source itself are refused."""
    name = F.substring_index(source, "/", -1)
    stem = F.when(scalar.suffix(source) != "", F.regexp_replace(name, r"\.[^.]+$", "")).otherwise(name)
    to = F.when(is_dir, F.concat(F.regexp_replace(output, "/+$", ""), F.lit("/"), stem, F.lit(".mp4"))).otherwise(output)
    return to, F.when(scalar.suffix(to) != ".mp4", "not an mp4").when(to == source, "would overwrite the source")


def acceptance(target: str) -> tuple[Column, Column]:
    """(error, residual_recommended) of an output's verdict."""
    if target == "analysis":
        return F.when(_c("analysis_transcode").isNotNull(), F.concat(F.lit("still needs an analysis transcode: "), scalar.joined(_c("analysis_reasons")))), F.lit(False)
    hard = F.coalesce(_c("stream_transcode") == "required", F.lit(False))
    return F.when(hard, F.concat(F.lit("still cannot play: "), scalar.joined(_c("stream_reasons")))), F.coalesce(_c("stream_transcode") == "recommended", F.lit(False))


def recovery(discarded: Column, index_source: Column, index_space: Column) -> tuple[Column, Column]:
    """(space to decode in, error): an index of another scanner or space is refused."""
    space = F.when(discarded > 0, "edit_list_ignored").otherwise("container_default")
    return space, F.when(index_space.isNotNull() & ((index_source != "in_process") | (index_space != space)), "index of another space")


def geometry(resize_width: Column, resize_height: Column) -> tuple[Column, Column, Column]:
    """(width, height, error): a resize wins over the turn, the turn over the coded size."""
    turn = F.pmod(_c("rotation_degrees"), F.lit(360))
    w, h = scalar.displayed(_c("width"), _c("height"), _c("rotation_degrees"))
    bad = F.when(~turn.isin(0, 90, 180, 270), "unsupported rotation")
    return F.coalesce(resize_width, w), F.coalesce(resize_height, h), bad


def encoder_listed(lines: DataFrame, names: list[str]) -> DataFrame:
    """name, listed: whether the second word of some line is the name."""
    word = F.get(F.split(F.trim(F.col("line")), r"\s+"), F.lit(1))
    asked = F.explode(F.array(*map(F.lit, names)))
    hits = lines.select(word.alias("name")).where(F.col("name").isin(*names)).distinct().withColumn("hit", F.lit(True))
    return lines.sparkSession.range(1).select(asked.alias("name")).join(hits, "name", "left").select("name", F.coalesce("hit", F.lit(False)).alias("listed"))

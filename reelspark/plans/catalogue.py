"""Every query of the media-facts engine by name, with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import frames, policy
from ..frames import pixels
from ..functions import scalar
from ..operators import delivery, facts, gop, identity, index, planner, sequence, timing, verdict
from ..sources import driver_tables as D
from ..sources import probe_text
from ..streaming import gop_state
from . import inputs as I
from . import oracles

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_c = F.col


def query(f):
    QUERIES[f.__name__] = f
    return f


def _sql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    return D.read_sql(spark, sf_dir, text)


def _sources(packets: DataFrame) -> DataFrame:
    """Every fifth file has no timestamps."""
    return packets.select("file_id", F.when(_c("file_id") % 5 == 0, "none").otherwise("pts").alias("source")).distinct()


def _verdicts(spark, d):
    return verdict.derive(D.facts(spark, d))


# timing and keyframe intervals
@query
def timing_fit(spark, d):
    return timing.timing(D.packets_b(spark, d)).select("file_id", "frame_count", "fps", "duration")


@query
def frame_drift(spark, d):
    return timing.timing(D.packets_b(spark, d)).select("file_id", "max_drift", "constant_frame_rate")


@query
def timestamp_gap(spark, d):
    return timing.timing(D.packets_b(spark, d)).select("file_id", "max_gap")


@query
def instantaneous_fps(spark, d):
    return timing.timing(D.packets_a(spark, d)).select("file_id", "max_instantaneous_fps")


@query
def gop_stats(spark, d):
    return gop.gop_stats(D.packets_b(spark, d))


@query
def discard_count(spark, d):
    return gop.discard_count(D.packets_b(spark, d))


@query
def leading_frames(spark, d):
    p = D.packets_b(spark, d)
    return gop.leading_frames(p, _sources(p))


@query
def untimed_facts(spark, d):
    p = D.packets_b(spark, d)
    return facts.measure(p, sources=_sources(p))


@query
def probe_facts(spark, d):
    return facts.measure(D.packets_a(spark, d))


def _raw_packets(spark, d):
    return probe_text.timed(probe_text.packets(_sql(spark, d, I.PACKET_LINES)))


def _media_facts(spark, d, identities: bool):
    """The whole facts table, from text as probing prints it."""
    heads, p = probe_text.headers(_sql(spark, d, I.HEADER_JSON)), _raw_packets(spark, d)
    moov = probe_text.moov_first(_sql(spark, d, I.BOXES))
    if not identities:
        return facts.facts(heads, p, moov)
    named = heads.where("error IS NULL").join(p.groupBy("file_id").agg(F.first("source").alias("source")), "file_id")
    named = named.withColumn("timing_source", scalar.timing_source(_c("source"), _c("container")))
    cols = [_c(x).cast("long").alias(x) if x in identity.INTEGERS else _c(x) for x in (*identity.STRINGS, *identity.INTEGERS, *identity.FLAGS)]
    return facts.facts(heads, p, moov, identity.mint(p, named.select("file_id", *cols, "timing_source")))


@query
def media_facts(spark, d):
    """The columns of the facts that another engine can tell; pixel_format and others are absent in these headers."""
    told = "file_id container codec_name width rotation_degrees square_pixels progressive has_audio declared_frame_count declared_fps timing_source duration fps frame_count constant_frame_rate max_instantaneous_fps"
    told += " max_timestamp_gap_frame_periods max_keyframe_interval_frames max_gop_bytes discard_flagged_packets leading_non_keyframe_frames moov_at_start pixel_format color_range coded_reordering_depth identity_scheme"
    return _media_facts(spark, d, False).select(*told.split())


@query
def probe_media(spark, d):
    """All columns of the facts, identities too."""
    return _media_facts(spark, d, True)


# identity and duplicates
def _heads(spark, d):
    cols = [*identity.STRINGS, *identity.INTEGERS, *identity.FLAGS, "timing_source"]
    return D.facts(spark, d).select("file_id", *[_c(x).cast("long").alias(x) if x in identity.INTEGERS else _c(x) for x in cols])


@query
def content_digest(spark, d):
    return identity.mint(D.packets_a(spark, d), _heads(spark, d)).select("file_id", "content_digest")


@query
def video_uuid(spark, d):
    return identity.mint(D.packets_a(spark, d), _heads(spark, d)).select("file_id", "video_uuid")


@query
def content_digest_md5(spark, d):
    return identity.content_md5(D.packets_a(spark, d))


def _compared(spark, d):
    f = D.facts(spark, d)
    cols = ("content_digest", "timing_source", "fps", "duration")
    left = f.select(_c("file_id").alias("left_id"), F.expr(I.PARTNER).cast("long").alias("right_id"), *[_c(x).alias(f"left_{x}") for x in cols])
    right = f.select(_c("file_id").alias("right_id"), *[_c(x).alias(f"right_{x}") for x in cols])
    return identity.compare(left.join(right, "right_id"))


@query
def duplicate_compare(spark, d):
    return _compared(spark, d).select("left_id", "right_id", "verdict", "fps_delta", "fps_tolerance", "duration_delta", "duration_tolerance")


@query
def exit_code(spark, d):
    return _compared(spark, d).select("left_id", "right_id", identity.exit_code(_c("verdict")).alias("code"))


@query
def duplicate_facts(spark, d):
    return identity.duplicates(D.facts(spark, d)).select("left_file_id", "right_file_id", "verdict")


@query
def duplicate_groups(spark, d):
    """Turns with the same role: few groups, each as large as the table."""
    c = spark.read.parquet(f"{d}/conversations.parquet")
    return identity.exact_groups(c.select((_c("conv_id") * 1000 + _c("turn")).alias("id"), F.md5("role").alias("digest")))


# indexes and reads
@query
def presentation_rank(spark, d):
    return index.seek_index(D.packets_b(spark, d)).select("file_id", "time", "rank")


@query
def seek_index(spark, d):
    return index.seek_index(D.packets_b(spark, d))


@query
def preceding_keyframe(spark, d):
    return index.preceding_keyframe(index.seek_index(D.packets_b(spark, d)))


@query
def group_by_gop(spark, d):
    out = index.group_by_gop(index.seek_index(D.packets_b(spark, d)), _sql(spark, d, I.TARGETS))
    return out.select("file_id", "keyframe_rank", F.array_join(_c("targets").cast("array<string>"), ",").alias("targets"))


@query
def asof_keyframe(spark, d):
    p = D.packets_a(spark, d)
    return index.asof_keyframe(index.seek_index(p), p.where("discard").select("file_id", (_c("time") + 30.0).alias("target_time")))


@query
def frame_window(spark, d):
    return index.window(index.seek_index(D.packets_b(spark, d)), 10, 40).select("file_id", "rank", "time")


@query
def strided_read(spark, d):
    return index.window(index.seek_index(D.packets_b(spark, d)), 5, 200, 7).select("file_id", "rank", "time")


@query
def read_batch(spark, d):
    return index.batches(index.seek_index(D.packets_b(spark, d)), 32)


@query
def sparse_read(spark, d):
    return index.sparse_read(index.seek_index(D.packets_b(spark, d)), _sql(spark, d, I.TARGETS)).select("file_id", "rank", "time", "keyframe_rank")


@query
def seek_point(spark, d):
    return D.facts(spark, d).select("file_id", index.seek_status(_c("file_id") % 3000, F.lit(5), F.least(F.lit(2500), "frame_count")).alias("status"))


@query
def gop_stream(spark, d):
    """The packets as a stream in batches of files, whose last state is the batch operator's result."""
    rows = identity.ordered(D.packets_a(spark, d)).select("file_id", _c("position").cast("long").alias("seq"), "size", "keyframe")
    return gop_state.replayed(rows)


# sequences of files
@query
def zipped_sequences(spark, d):
    told = D.segments(spark, d).where("sequence_id % 3 > 0 OR ordinal % 5 > 0").select("sequence_id", "ordinal", "frame_count")
    return sequence.zipped(_sql(spark, d, I.ZIPPED), told).select("sequence_id", "ordinal", "path", "error", "frame_count")


@query
def canonical_fps(spark, d):
    return sequence.canonical_fps(D.segments(spark, d)).select("sequence_id", F.round("fps", 6).alias("fps"))


@query
def sequence_uniformity(spark, d):
    return sequence.uniformity(D.segments(spark, d))


@query
def segment_starts(spark, d):
    return sequence.with_starts(D.segments(spark, d)).select("sequence_id", "ordinal", "frame_count", "start_frame")


@query
def segment_for_frame(spark, d):
    return sequence.segment_for_frame(D.segments(spark, d), _sql(spark, d, I.GLOBAL_TARGETS))


@query
def multi_frame_space(spark, d):
    s = sequence.with_starts(D.segments(spark, d))
    total = s.groupBy("sequence_id").agg(F.sum("frame_count").alias("total_frames"))
    return s.join(total, "sequence_id").select("sequence_id", "ordinal", "start_frame", (_c("start_frame") + _c("frame_count")).alias("end_frame"), "total_frames")


@query
def junction_read(spark, d):
    s = D.segments(spark, d)
    return sequence.segment_for_frame(s, sequence.junctions(s))


# delivery
def _delivered(spark, d):
    p = identity.ordered(D.packets_a(spark, d))
    fps = F.when(_c("file_id") % 4 == 0, 0.0).when(_c("file_id") % 4 == 1, F.lit(1.0) / 500).when(_c("file_id") % 4 == 2, F.lit(1.0) / 3000).otherwise(F.lit(1.0) / 2000)
    gap = F.when(_c("file_id") % 3 == 0, 0.0).when(_c("file_id") % 3 == 1, 1.2).otherwise(1.4)
    return p.select("file_id", (_c("position") + 1).cast("long").alias("position"), "time", fps.alias("fps"), gap.alias("max_gap"))


@query
def decode_gap_check(spark, d):
    return delivery.gap_check(_delivered(spark, d)).select("file_id", "position", "status")


@query
def delivery_shortfall(spark, d):
    f = D.facts(spark, d)
    got = F.floor(_c("frame_count") / 3) - _c("file_id") % 3
    return f.select("file_id", delivery.shortfall(got, F.lit(2), _c("frame_count"), F.lit(3)).alias("shortfall"))


def _observed(spark, d):
    return _sql(spark, d, I.OBSERVED.replace("{micros}", D.MICROS["A"][0]))


@query
def landing_rank(spark, d):
    return delivery.landing_rank(index.seek_index(D.packets_a(spark, d)), _observed(spark, d)).select("file_id", "obs_id", "rank")


@query
def seek_landing(spark, d):
    return delivery.seek_landing(index.seek_index(D.packets_a(spark, d)), _observed(spark, d)).select("file_id", "obs_id", "rank", "status")


@query
def verify_delivery(spark, d):
    shown = _delivered(spark, d).select("file_id", (_c("position") - 1).alias("rank"), (_c("time") + (_c("file_id") % 3) * 100).alias("time"), "fps")
    return delivery.verify(index.seek_index(D.packets_a(spark, d)), shown).select("file_id", "rank", "status")


# verdicts and plans
@query
def derive_verdict(spark, d):
    return _verdicts(spark, d).select("file_id", "playable", "stream_transcode", "analysis_transcode", scalar.joined(_c("stream_reasons")).alias("stream_reasons"), scalar.joined(_c("analysis_reasons")).alias("analysis_reasons"), "truncated")


@query
def metadata_lies(spark, d):
    return D.facts(spark, d).select("file_id", verdict.metadata_lies().alias("lies"))


@query
def truncation(spark, d):
    return D.facts(spark, d).select("file_id", scalar.truncated(_c("duration"), _c("declared_duration"), policy.THRESHOLDS.truncation_duration_ratio).alias("truncated"))


@query
def minimum_operation(spark, d):
    return _verdicts(spark, d).select("file_id", planner.minimum_operation("analysis").alias("analysis"), planner.minimum_operation("playback").alias("playback"))


@query
def select_operation(spark, d):
    return _verdicts(spark, d).select("file_id", planner.select_operation("analysis").alias("analysis"), planner.select_operation("playback").alias("playback"))


def _commands(spark, d, target, encoding):
    path = F.col("file_id").cast("string")
    v = _verdicts(spark, d).withColumns({"source": F.concat(F.lit("in/"), path, F.lit(".bin")), "destination": F.concat(F.lit("out/"), path, F.lit(".mp4"))})
    out = planner.build_command(v, target, encoding)
    return out.select("file_id", "operation", F.array_join("argv", " ").alias("argv"), "error", "encoder_name", scalar.joined(_c("reasons")).alias("reasons"))


@query
def build_command(spark, d):
    return _commands(spark, d, "analysis", policy.ANALYSIS)


@query
def build_command_playback(spark, d):
    return _commands(spark, d, "playback", policy.PLAYBACK)


@query
def select_encoder(spark, d):
    return D.facts(spark, d).select("file_id", planner.encoder(_c("file_id") % 2 == 0, _c("has_audio")).alias("encoder"))


@query
def resolve_output(spark, d):
    to, error = planner.resolve_output(_c("source"), _c("output"), _c("is_dir"))
    return _sql(spark, d, I.OUTPUTS).select("file_id", to.alias("destination"), error.alias("error"))


@query
def acceptance_gate(spark, d):
    (a, _), (p, residual) = planner.acceptance("analysis"), planner.acceptance("playback")
    return _verdicts(spark, d).select("file_id", a.alias("analysis_error"), p.alias("playback_error"), residual.alias("residual_recommended"))


@query
def recovery_options(spark, d):
    k = _c("file_id") % 4
    given = F.when(k == 1, "edit_list_ignored").when(k != 3, "container_default")
    space, error = planner.recovery(_c("discard_flagged_packets"), F.when(k == 2, "ffprobe").otherwise("in_process"), given)
    return D.facts(spark, d).select("file_id", space.alias("space"), error.alias("error"))


@query
def output_geometry(spark, d):
    resized = _c("file_id") % 5 == 0
    w, h, error = planner.geometry(F.when(resized, 64), F.when(resized, 48))
    return D.facts(spark, d).select("file_id", w.alias("out_width"), h.alias("out_height"), error.alias("error"))


# scalar rules
@query
def parse_fraction(spark, d):
    return _sql(spark, d, I.FRACTIONS).select("id", scalar.parse_fraction(_c("v")).alias("value"))


@query
def elementary_fps(spark, d):
    rate = F.concat_ws("/", _c("num").cast("string"), _c("den").cast("string"))
    return _sql(spark, d, I.RATES).select("id", scalar.elementary_fps(rate, _c("container"), _c("codec")).alias("fps"))


@query
def timing_source(spark, d):
    s = _sql(spark, d, I.SOURCES).select("id", scalar.timing_source(_c("src"), _c("container")).alias("timing_source"))
    return s.withColumn("supplied", scalar.supplied(_c("timing_source")))


@query
def rotation_normalize(spark, d):
    return _sql(spark, d, I.ANGLES).select("id", scalar.rotation(_c("angle")).alias("rotation_degrees"))


@query
def displayed_dims(spark, d):
    w, h = scalar.displayed(_c("width"), _c("height"), _c("rotation_degrees"))
    return D.facts(spark, d).select("file_id", w.alias("width"), h.alias("height"))


@query
def thumbnail_dims(spark, d):
    p = spark.read.parquet(f"{d}/part.parquet").select(_c("p_partkey").alias("id"), (_c("p_size") * 37 + 1).cast("int").alias("w"), F.floor("p_retailprice").cast("int").alias("h"))
    w, h = scalar.thumbnail(_c("w"), _c("h"))
    return p.select("id", w.alias("width"), h.alias("height"))


@query
def timing_tolerance(spark, d):
    t = scalar.timing_tolerance
    return D.facts(spark, d).select("file_id", t(_c("fps"), _c("duration")).alias("fps_tolerance"), t(_c("duration"), _c("duration")).alias("duration_tolerance"))


@query
def measured_or_none(spark, d):
    told = probe_text.known("moov_at_start", "max_instantaneous_fps", "fps", "width", "height")
    return D.facts(spark, d).select("file_id", F.when(told, _c("fps")).alias("fps"), F.when(told, _c("width")).alias("width"))


@query
def progress_parse(spark, d):
    b = _sql(spark, d, I.PROGRESS_FIELDS).select("id", _c("us").alias("out_time_us"), _c("ck").alias("out_time"), _c("sp").alias("speed"), F.lit(None).cast("string").alias("fps"), _c("d").alias("duration"), _c("id").alias("run_id"), F.lit(0).alias("block"))
    return probe_text.readings(b).select(_c("run_id").alias("id"), "out_time", "speed", "fraction")


@query
def quality_map(spark, d):
    preset = scalar.av1_preset(_c("preset"))
    return _sql(spark, d, I.QUALITY).select("id", scalar.av1_crf(_c("crf")).alias("av1_crf"), preset.alias("av1_preset"))


@query
def quality_errors(spark, d):
    crf, preset, error = scalar.quality(F.when(_c("id") % 3 > 0, _c("crf")), F.when(_c("id") % 4 > 0, _c("preset")), _c("own"), F.when(_c("id") % 11 == 0, 5).otherwise(8))
    return _sql(spark, d, I.QUALITY).select("id", crf.alias("av1_crf"), preset.alias("av1_preset"), error.alias("error"))


@query
def stream_offset(spark, d):
    return D.packets_a(spark, d).select("file_id", "decode_order", scalar.stream_offset(_c("time") - 1704067200.0, F.lit(1.0) / 90000).alias("offset"))


# text sources
@query
def candidate_filter(spark, d):
    return probe_text.candidates(_sql(spark, d, I.PATHS))


@query
def moov_order(spark, d):
    return probe_text.moov_first(_sql(spark, d, I.BOXES))


@query
def packet_scan(spark, d):
    return probe_text.packets(_sql(spark, d, I.PACKET_LINES))


@query
def timestamp_source(spark, d):
    return probe_text.timed(probe_text.packets(_sql(spark, d, I.PACKET_LINES))).select("file_id", "decode_order", "source", "time")


@query
def scan_errors(spark, d):
    return probe_text.scan_errors(_sql(spark, d, I.PACKET_LINES))


@query
def stream_select(spark, d):
    return probe_text.selected_streams(_sql(spark, d, I.HEADER_JSON)).select("file_id", "video_position", "video_stream_count")


@query
def header_parse(spark, d):
    return probe_text.headers(_sql(spark, d, I.HEADER_JSON)).select("file_id", "container", "codec_name", "width", "square_pixels", "progressive", "has_audio", "rotation_degrees", "declared_fps", "declared_frame_count", "error")


@query
def progress_blocks(spark, d):
    return probe_text.progress(_sql(spark, d, I.PROGRESS_LINES))


@query
def encoder_listed(spark, d):
    return planner.encoder_listed(_sql(spark, d, I.ENCODER_LINES), ["av1", "av1_nvenc", "libsvtav1", "h264_nvenc", "encoder3"])


@query
def probe_json(spark, d):
    return facts.as_json(_verdicts(spark, d))


def _frames(spark, d):
    return _sql(spark, d, I.FRAMES).withColumn("data", F.unhex("hexed")).drop("hexed")


def _fitting(spark, d):
    return frames.checked(_frames(spark, d), 2, 3, 3).where("error IS NULL").drop("error")


@query
def grey_raw(spark, d):
    return pixels.to_grey(_fitting(spark, d)).withColumn("data", F.hex("data"))


@query
def first_frames(spark, d):
    return pixels.first_frames(_fitting(spark, d)).select("file_id", "frame_index", F.hex("data").alias("data"))


@query
def thumbnails(spark, d):
    return pixels.thumbnails(_fitting(spark, d), 2).withColumn("data", F.hex("data"))


@query
def frame_batches(spark, d):
    b = pixels.read_batches(_fitting(spark, d), 16)
    return b.select("file_id", "batch", F.size("indices").cast("long").alias("frames"), F.array_join(_c("indices").cast("array<string>"), ",").alias("indices"), F.hex("data").alias("data"))


@query
def writer_counts(spark, d):
    return pixels.written(_frames(spark, d), 2, 3)


@query
def rotate_raw(spark, d):
    """Frames of 4 x 3 grey pixels cut from hashes, turned by their file's quarter turns."""
    f = D.facts(spark, d).where("rotation_degrees % 90 = 0").select("file_id", "rotation_degrees", F.lit(0).cast("long").alias("frame_index"), F.lit(3).alias("height"), F.lit(4).alias("width"), F.lit(1).alias("channels"))
    return frames.rotate(f.withColumn("data", F.substring(F.md5(_c("file_id").cast("string")), 1, 12).cast("binary"))).withColumn("data", F.hex("data"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(oracles.SQL)

"""Facts of many files from their headers and packets, as one composition."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import policy
from ..functions import scalar
from .gop import decode_facts
from .timing import timing


def measure(packets: DataFrame, drift: float = policy.THRESHOLDS.drift_frame_periods, sources: DataFrame | None = None) -> DataFrame:
    """One row for each file: timing, keyframe intervals, discarded and leading frames.

    sources (file_id, source) tells files without timestamps: there fps, duration and gap are 0,
    the rate isn't constant, and frame_count is the number of packets. The packets are
    dealt out by file once; both orders, by decoding and by time, are windows over that.
    """
    dealt = packets.select("file_id", "decode_order", "time", "size", "keyframe", "discard").repartition("file_id")
    out = decode_facts(dealt).join(timing(dealt, drift, dealt=True), "file_id", "left")
    out = out.withColumn("source", F.lit("pts")) if sources is None else out.join(sources, "file_id")
    none, pick = F.col("source") == "none", lambda untimed, c: F.when(none, untimed).otherwise(F.col(c))
    leading = pick(F.when(F.col("keyframes") > 0, F.col("before")).otherwise(0), "leading")
    return out.select(
        "file_id", pick(0.0, "duration").alias("duration"), pick(0.0, "fps").alias("fps"), pick(F.col("packets"), "frame_count").alias("frame_count"),
        pick(False, "constant_frame_rate").alias("constant_frame_rate"), F.when(~none, F.col("max_instantaneous_fps")).alias("max_instantaneous_fps"),
        pick(0.0, "max_gap").alias("max_timestamp_gap_frame_periods"), "max_keyframe_interval_frames", "max_gop_bytes", F.col("discarded").alias("discard_flagged_packets"),
        F.coalesce(leading, F.lit(0)).cast("long").alias("leading_non_keyframe_frames"), pick(None, "error").alias("error"),
    )


def facts(headers: DataFrame, packets: DataFrame, moov: DataFrame | None = None, identity: DataFrame | None = None, prober: str = "") -> DataFrame:
    """The facts table. headers as read from probe text, packets with source and time, moov (file_id, moov_at_start), identity (file_id, video_uuid, content_digest)."""
    sources = packets.groupBy("file_id").agg(F.first("source").alias("source"))  # constant in a file
    m = measure(packets.withColumn("time", F.when(F.col("source") != "none", F.col("time"))), sources=sources)
    # a file without a stream, or with one time only, has no facts
    out = headers.where("error IS NULL").drop("error").join(m.where("error IS NULL").drop("error"), "file_id").join(sources, "file_id")
    out = out.withColumn("declared_fps", F.when(F.col("source") == "none", F.col("elementary_stream_fps")).otherwise(F.col("declared_fps")))
    out = out.withColumn("timing_source", scalar.timing_source(F.col("source"), F.col("container"))).drop("source", "elementary_stream_fps", "video_position")
    out = out.join(moov, "file_id", "left") if moov is not None else out.withColumn("moov_at_start", F.lit(None).cast("boolean"))
    out = out.join(identity, "file_id", "left").fillna("", ["video_uuid", "content_digest"]) if identity is not None else out.withColumns({"video_uuid": F.lit(""), "content_digest": F.lit("")})
    return out.withColumns({"identity_scheme": F.lit(policy.IDENTITY_SCHEME), "prober_version": F.lit(prober)})


def as_json(facts: DataFrame, *columns: str) -> DataFrame:
    """file_id, json: the columns by name in alphabetical order."""
    names = sorted(columns or [c for c in facts.columns if c != "file_id"])
    return facts.select("file_id", F.to_json(F.struct(*names), {"ignoreNullFields": "false"}).alias("json"))

"""Several files as one run of frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import policy

#: Frames of a bucket in the join of frames with segments.
BUCKET = 1024


def canonical_fps(segments: DataFrame) -> DataFrame:
    """sequence_id, fps: all frames over all seconds, 0 without seconds."""
    s = segments.groupBy("sequence_id").agg(F.sum("frame_count").alias("n"), F.sum("duration").alias("d"))
    return s.select("sequence_id", F.when(F.col("d") > 0, F.col("n") / F.col("d")).otherwise(0.0).alias("fps"))


def uniformity(segments: DataFrame) -> DataFrame:
    """sequence_id, ordinal, field, first, other: the first mismatch with the sequence's first file; nulls where uniform."""
    names = ("width", "height", "fps", "frame_count")
    # the first file is found by an aggregate and joined back: no window holds a sequence
    heads = segments.groupBy("sequence_id").agg(F.min_by(F.struct(*names), "ordinal").alias("h"))
    s = segments.join(heads, "sequence_id")
    differs = lambda c: F.struct(F.lit(c).alias("field"), F.col(f"h.{c}").cast("double").alias("first"), F.col(c).cast("double").alias("other"))
    n = F.least("frame_count", "h.frame_count").cast("double")
    drift = F.abs(F.col("fps") - F.col("h.fps")) / F.col("h.fps") * n >= policy.MOST_DRIFT
    bad = F.when(F.col("width") != F.col("h.width"), differs("width")).when(F.col("height") != F.col("h.height"), differs("height"))
    bad = bad.when((F.col("fps") <= 0) | (F.col("h.fps") <= 0), differs("fps")).when(drift, differs("fps"))
    # the reference file isn't compared with itself
    first = F.min_by(F.struct("ordinal", "bad"), "ordinal")
    own = segments.groupBy("sequence_id").agg(F.min("ordinal").alias("_first"))
    s = s.withColumn("bad", bad).join(own, "sequence_id").withColumn("bad", F.when(F.col("ordinal") != F.col("_first"), F.col("bad")))
    found = s.where("bad IS NOT NULL").groupBy("sequence_id").agg(first.alias("m"))
    return own.select("sequence_id").join(found, "sequence_id", "left").select("sequence_id", F.col("m.ordinal").alias("ordinal"), F.col("m.bad.field").alias("field"), F.col("m.bad.first").alias("first"), F.col("m.bad.other").alias("other"))


def zipped(paths: DataFrame, facts: DataFrame | None = None, indices: DataFrame | None = None) -> DataFrame:
    """paths (sequence_id, ordinal, path) beside the facts and the index (both by sequence_id and ordinal) of the same place, with error.

    A sequence whose facts or indices aren't as many as its paths tells so in each row and gets neither; left out altogether they are no error.
    """
    keys = ["sequence_id", "ordinal"]
    out = paths.withColumn("error", F.lit(None).cast("string"))
    for what, side in (("facts", facts), ("indices", indices)):
        if side is None:
            continue
        n, m = (x.groupBy("sequence_id").agg(F.count("*").alias(c)) for x, c in ((paths, "_n"), (side, "_m")))
        lengths = n.join(m, "sequence_id", "left").withColumn("_m", F.coalesce("_m", F.lit(0)))
        told = F.when(F.col("_n") != F.col("_m"), F.format_string(f"%d {what} for %d paths", "_m", "_n"))
        out = out.join(lengths, "sequence_id").withColumn("error", F.coalesce("error", told)).drop("_n", "_m")
        more = [c for c in side.columns if c not in keys]
        out = out.join(side.withColumn("_there", F.lit(True)), keys, "left")
        out = out.withColumn("error", F.coalesce("error", F.when(F.col("_there").isNull(), f"no {what} at this place"))).drop("_there")
        out = out.withColumns({c: F.when(F.col("error").isNull(), F.col(c)) for c in more})
    return out


def with_starts(segments: DataFrame) -> DataFrame:
    """segments with start_frame: the frames of the files before."""
    w = Window.partitionBy("sequence_id").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)
    return segments.withColumn("start_frame", F.coalesce(F.sum("frame_count").over(w), F.lit(0)).cast("long"))


def segment_for_frame(segments: DataFrame, targets: DataFrame) -> DataFrame:
    """sequence_id, global_frame, ordinal, local_frame, status: the file that holds each frame.

    Segments are laid out over buckets of frames, so the join is an equality; a frame
    outside all of them has status out of range.
    """
    s = with_starts(segments).where("frame_count > 0").withColumn("end_frame", F.col("start_frame") + F.col("frame_count"))
    low, high = F.floor(F.col("start_frame") / BUCKET), F.floor((F.col("end_frame") - 1) / BUCKET)
    s = s.select("sequence_id", "ordinal", "start_frame", "end_frame", F.explode(F.sequence(low, high)).alias("bucket"))
    t = targets.select("sequence_id", "global_frame", F.floor(F.col("global_frame") / BUCKET).alias("bucket"))
    joined = t.alias("t").join(s.alias("s"), F.expr("t.sequence_id = s.sequence_id AND t.bucket = s.bucket AND global_frame >= start_frame AND global_frame < end_frame"), "left")
    return joined.select("t.sequence_id", "global_frame", "ordinal", (F.col("global_frame") - F.col("start_frame")).alias("local_frame"), F.when(F.col("ordinal").isNull(), "out of range").otherwise("ok").alias("status"))


def junctions(segments: DataFrame, around: int = 1) -> DataFrame:
    """sequence_id, global_frame: ``around`` frames on either side of each place where one file ends and another begins."""
    s = with_starts(segments)
    both = F.sequence(F.col("start_frame") - around, F.col("start_frame") + around - 1)
    return s.where("start_frame > 0").select("sequence_id", F.explode(both).alias("global_frame")).distinct()

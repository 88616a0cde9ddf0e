"""Frame rate, drift and gaps from presentation times."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import policy


def frames(packets: DataFrame, dealt: bool = False) -> DataFrame:
    """(file_id, time, keyframe): the distinct times; one is a keyframe if any packet there is.

    The packets are dealt out by file (unless ``dealt`` says they are) and sorted by time once. Of equal
    times the first row is kept, a keyframe if there is one, so nothing is held in a hash table, and
    windows by file, or by file and time, need neither a further shuffle nor a further sort.
    """
    time = F.when(F.col("time") == 0, F.abs("time")).otherwise(F.col("time")).alias("time")  # -0.0 is 0.0
    rows = packets.where("time IS NOT NULL").select("file_id", time, F.coalesce("keyframe", F.lit(False)).alias("keyframe"))
    o = Window.partitionBy("file_id").orderBy("time", F.desc("keyframe"))
    rows = (rows if dealt else rows.repartition("file_id")).withColumn("_before", F.lag("time").over(o))
    return rows.where("_before IS NULL OR _before <> time").drop("_before")


def ranked(packets: DataFrame, dealt: bool = False) -> DataFrame:
    """frames() with rank, previous time, and count, first, last and first keyframe's time of the file."""
    w = Window.partitionBy("file_id")
    o = w.orderBy("time")
    return frames(packets, dealt).select(
        "*", (F.row_number().over(o) - 1).cast("long").alias("rank"), F.lag("time").over(o).alias("previous"), F.count("*").over(w).alias("n"), F.min("time").over(w).alias("t0"), F.max("time").over(w).alias("t1"),
        F.min(F.when(F.col("keyframe"), F.col("time"))).over(w).alias("k0"),
    )


def timing(packets: DataFrame, drift: float = policy.THRESHOLDS.drift_frame_periods, dealt: bool = False) -> DataFrame:
    """One row for each file: frame_count, span, fps, duration, max_drift, constant_frame_rate, max_gap, max_instantaneous_fps, leading (frames before the first keyframe's time), error.

    With fewer than two times only frame_count and error are told. Nothing is told of a
    file without times.
    """
    n, span = F.col("n"), F.col("t1") - F.col("t0")
    rows = ranked(packets, dealt).withColumn("fps", F.when(n > 1, (n - 1) / span))
    fps = F.col("fps")
    out = rows.groupBy("file_id").agg(
        F.max("n").alias("frame_count"),
        F.max(span).alias("span"),
        F.max("fps").alias("fps"),
        F.max(F.abs((F.col("time") - F.col("t0")) - F.col("rank") / fps) * fps).alias("max_drift"),
        F.max((F.col("time") - F.col("previous")) * fps).alias("max_gap"),
        F.min(F.col("time") - F.col("previous")).alias("_least"),
        F.count_if(F.col("time") < F.col("k0")).alias("leading"),
    )
    many, constant = F.col("frame_count") > 1, F.col("max_drift") < drift
    return out.select(
        "file_id", "frame_count", F.when(many, F.col("span")).alias("span"), "fps",
        F.when(many, F.col("span") * F.col("frame_count") / (F.col("frame_count") - 1)).alias("duration"),
        "max_drift", constant.alias("constant_frame_rate"), "max_gap",
        F.when(many & ~constant, F.lit(1.0) / F.col("_least")).alias("max_instantaneous_fps"), "leading",
        F.when(~many, "fewer than two timestamps").alias("error"),
    )

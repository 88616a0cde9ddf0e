"""Presentation ranks, keyframes before them, and reads by rank."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .timing import frames


def seek_index(packets: DataFrame) -> DataFrame:
    """file_id, rank, time, is_keyframe: one row for each distinct time."""
    rank = F.row_number().over(Window.partitionBy("file_id").orderBy("time")) - 1
    return frames(packets).select("file_id", rank.cast("long").alias("rank"), "time", F.col("keyframe").alias("is_keyframe"))


def preceding_keyframe(index: DataFrame) -> DataFrame:
    """index with keyframe_rank and keyframe_time: the last keyframe up to each rank, else rank 0.

    Ranks ascend with time, and by time the rows of seek_index() are sorted already.
    """
    w = Window.partitionBy("file_id").orderBy("time").rowsBetween(Window.unboundedPreceding, 0)
    at = F.last(F.when(F.col("is_keyframe"), F.struct("rank", "time")), ignorenulls=True).over(w)
    at = F.coalesce(at, F.first(F.struct("rank", "time")).over(w))
    return index.withColumn("_at", at).select("file_id", "rank", "time", "is_keyframe", F.col("_at.rank").alias("keyframe_rank"), F.col("_at.time").alias("keyframe_time"))


def group_by_gop(index: DataFrame, targets: DataFrame) -> DataFrame:
    """file_id, keyframe_rank, targets (ascending): the distinct targets (file_id, rank) that exist, by keyframe."""
    hit = preceding_keyframe(index).join(targets.select("file_id", "rank").distinct(), ["file_id", "rank"])
    return hit.groupBy("file_id", "keyframe_rank").agg(F.sort_array(F.collect_list("rank")).alias("targets"))


def asof_keyframe(index: DataFrame, targets: DataFrame) -> DataFrame:
    """file_id, target_time, keyframe_rank, keyframe_time: the last keyframe at or before each time; null if none.

    One sort of both sides together, so no pairs are made.
    """
    keys = index.where("is_keyframe").select("file_id", F.col("time").alias("t"), F.lit(0).alias("side"), "rank", "time")
    asks = targets.select("file_id", F.col("target_time").alias("t"), F.lit(1).alias("side"), F.lit(None).cast("long").alias("rank"), F.lit(None).cast("double").alias("time"))
    w = Window.partitionBy("file_id").orderBy("t", "side").rowsBetween(Window.unboundedPreceding, 0)
    both = keys.unionByName(asks)
    both = both.select("file_id", "t", "side", F.last("rank", ignorenulls=True).over(w).alias("keyframe_rank"), F.last("time", ignorenulls=True).over(w).alias("keyframe_time"))
    return both.where("side = 1").select("file_id", F.col("t").alias("target_time"), "keyframe_rank", "keyframe_time")


def window(index: DataFrame, start: int = 0, end: int | None = None, step: int = 1) -> DataFrame:
    """Every ``step``-th rank from ``start`` below ``end``."""
    out = index.where((F.col("rank") >= max(0, start)) & ((F.col("rank") - max(0, start)) % step == 0))
    return out if end is None else out.where(F.col("rank") < end)


def batches(index: DataFrame, n: int) -> DataFrame:
    """file_id, batch, first_rank, last_rank, frames: runs of n ranks, the last may be shorter."""
    if n < 1:
        raise ValueError("n must be positive")
    return index.groupBy("file_id", F.floor(F.col("rank") / n).cast("long").alias("batch")).agg(F.min("rank").alias("first_rank"), F.max("rank").alias("last_rank"), F.count("*").alias("frames"))


def sparse_read(index: DataFrame, targets: DataFrame) -> DataFrame:
    """The frames of the distinct targets, with the keyframe to decode from."""
    return preceding_keyframe(index).join(targets.select("file_id", "rank").distinct(), ["file_id", "rank"], "left_semi")


def seek_status(rank: Column, start: Column, end: Column) -> Column:
    return F.when((rank >= start) & (rank < end), "ok").otherwise("out of range")

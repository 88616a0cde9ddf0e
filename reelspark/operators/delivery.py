"""Whether a decoder delivered what the index promises."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_c = F.col


def gap_check(delivered: DataFrame) -> DataFrame:
    """delivered (file_id, position, time, fps, max_gap) with status of each frame against the one before.

    collapsed: at the same time, looked at first; missing: further apart than the file's own
    widest step and half a period; unchecked where that can't tell, ok otherwise.
    """
    before = F.lag("time").over(Window.partitionBy("file_id").orderBy("position"))
    limit, gap = _c("max_gap") + 0.5, (_c("time") - _c("previous")) * _c("fps")
    status = F.when(_c("fps") <= 0, "unchecked").when(_c("previous").isNull(), "first").when(_c("time") == _c("previous"), "collapsed")
    status = status.when((_c("max_gap") <= 0) | (limit >= 2.0), "unchecked").when(gap > limit, "missing").otherwise("ok")
    return delivered.withColumn("previous", before).withColumn("status", status)


def shortfall(delivered: Column, start: Column, end: Column, step: Column) -> Column:
    """Frames of the window that weren't delivered, at least 0."""
    expected = F.greatest(F.lit(0), F.ceil((end - start) / step))
    return F.greatest(F.lit(0), expected - delivered).cast("long")


def landing_rank(index: DataFrame, observed: DataFrame) -> DataFrame:
    """observed (file_id, obs_id, time, fps) with rank: the first indexed time within half a period, else null.

    Times are put in buckets of a period (a second without a rate) and each observation
    looks into its own bucket and the next ones it can reach, so the join is an equality.
    """
    tolerance = F.when(_c("fps") > 0, F.lit(0.5) / _c("fps")).otherwise(0.0)
    o = observed.withColumn("tolerance", tolerance).withColumn("width", F.when(_c("fps") > 0, F.lit(1.0) / _c("fps")).otherwise(1.0))
    # the bucket's width is the file's, so it travels with the index too
    widths = o.groupBy("file_id").agg(F.max("width").alias("width"))
    i = index.select("file_id", "rank", _c("time").alias("indexed")).join(widths, "file_id").withColumn("bucket", F.floor(_c("indexed") / _c("width")))
    o = o.drop("width").join(widths, "file_id")
    reach = F.sequence(F.floor((_c("time") - _c("tolerance")) / _c("width")), F.floor((_c("time") + _c("tolerance")) / _c("width")))
    asked = o.select("*", F.explode(reach).alias("bucket"))
    near = asked.alias("o").join(i.alias("i"), F.expr("o.file_id = i.file_id AND o.bucket = i.bucket AND indexed >= time - tolerance AND abs(indexed - time) <= tolerance"))
    ranks = near.groupBy("o.file_id", "obs_id").agg(F.min("rank").alias("rank"))
    return observed.join(ranks, ["file_id", "obs_id"], "left")


def verify(index: DataFrame, delivered: DataFrame) -> DataFrame:
    """delivered (file_id, rank, time, fps) with status: ok, wrong frame, or skipped where nothing can be compared."""
    i = index.select("file_id", "rank", _c("time").alias("expected"))
    status = F.when((_c("fps") <= 0) | _c("expected").isNull(), "skipped").when(F.abs(_c("time") - _c("expected")) <= F.lit(0.5) / _c("fps"), "ok").otherwise("wrong frame")
    return delivered.join(i, ["file_id", "rank"], "left").withColumn("status", status)


def seek_landing(index: DataFrame, landings: DataFrame) -> DataFrame:
    """landings (file_id, obs_id, time, fps, keyframe_time) with rank and status: late after the keyframe, unindexed, or ok."""
    late = (_c("fps") > 0) & (_c("time") > _c("keyframe_time") + F.lit(0.5) / F.nullif(_c("fps"), F.lit(0.0)))
    out = landing_rank(index, landings)
    return out.withColumn("status", F.when(F.coalesce(late, F.lit(False)), "late").when(_c("rank").isNull(), "unindexed").otherwise("ok"))

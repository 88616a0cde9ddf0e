"""Keyframe intervals in decode order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .timing import frames


def gop_ids(packets: DataFrame) -> DataFrame:
    """packets with gop: how many keyframes came so far; 0 before the first."""
    w = Window.partitionBy("file_id").orderBy("decode_order").rowsBetween(Window.unboundedPreceding, 0)
    return packets.withColumn("gop", F.sum(F.col("keyframe").cast("long")).over(w))


def intervals(packets: DataFrame) -> DataFrame:
    """file_id, gop, bytes, frames, discarded of each keyframe interval; packets before the first keyframe are one.

    The packets are sorted by decode order once and summed up from the file's start; an interval's
    sums are what its last packet's are more than those of the interval before. No hash table by interval is held.
    """
    o = Window.partitionBy("file_id").orderBy("decode_order")
    w = o.rowsBetween(Window.unboundedPreceding, 0)
    sums = {"gop": F.sum(F.col("keyframe").cast("long")), "bytes": F.sum("size"), "_sized": F.count("size"), "frames": F.count("*"), "discarded": F.count_if("discard")}
    rows = packets.select("file_id", "decode_order", *[x.over(w).alias(k) for k, x in sums.items()])
    ends = rows.withColumns({"_next": F.lead("gop").over(o), "_more": F.lead("frames").over(o)}).where("_more IS NULL OR NOT _next <=> gop")
    own = {k: F.col(k) - F.coalesce(F.lag(k).over(o), F.lit(0)) for k in ("bytes", "_sized", "frames", "discarded")}
    each = ends.select("file_id", "gop", *[x.alias(k) for k, x in own.items()])
    return each.select("file_id", "gop", F.when(F.col("_sized") > 0, F.col("bytes")).alias("bytes"), "frames", "discarded")


def gop_stats(packets: DataFrame) -> DataFrame:
    """file_id, max_gop_bytes, max_keyframe_interval_frames; packets before the first keyframe count as an interval."""
    return intervals(packets).groupBy("file_id").agg(F.max("bytes").alias("max_gop_bytes"), F.max("frames").alias("max_keyframe_interval_frames"))


def decode_facts(packets: DataFrame) -> DataFrame:
    """What decode order tells of each file, by one sort: gop_stats() and packets, discarded, before (its first keyframe), keyframes."""
    return intervals(packets).groupBy("file_id").agg(
        F.max("bytes").alias("max_gop_bytes"), F.max("frames").alias("max_keyframe_interval_frames"), F.sum("frames").alias("packets"),
        F.sum("discarded").alias("discarded"), F.sum(F.when(F.col("gop") == 0, F.col("frames")).otherwise(0)).alias("before"), F.max("gop").alias("keyframes"),
    )


def discard_count(packets: DataFrame) -> DataFrame:
    return packets.groupBy("file_id").agg(F.count_if("discard").alias("discard_flagged_packets"))


def leading_frames(packets: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """file_id, leading_non_keyframe_frames.

    sources (file_id, source): where the source is none, packets before the first keyframe
    in decode order count, else distinct times below the first keyframe's. 0 without keyframes.
    """
    w = Window.partitionBy("file_id")
    first = F.min(F.when(F.col("keyframe"), F.col("time"))).over(w)
    if sources is None:
        timed = frames(packets).withColumn("first", first).groupBy("file_id").agg(F.count_if(F.col("time") < F.col("first")).alias("timed"))
        return timed.select("file_id", F.col("timed").alias("leading_non_keyframe_frames"))
    # one sort, by time, serves both: which packets come before the first keyframe in decode order follows from its place
    place = lambda keys: F.min(F.when(keys, F.col("decode_order"))).over(w)
    dealt = packets.select("file_id", "decode_order", "time", "keyframe").repartition("file_id")
    rows = dealt.withColumn("_before", F.lag("time").over(w.orderBy("time"))).withColumns({"first": first, "_told": place(F.col("keyframe").isNotNull()), "_key": place(F.col("keyframe"))})
    new = F.col("time").isNotNull() & (F.col("_before").isNull() | (F.col("_before") != F.col("time")))
    n = rows.groupBy("file_id").agg(
        F.count_if(new & (F.col("time") < F.col("first"))).alias("timed"),
        F.count_if((F.col("decode_order") >= F.col("_told")) & (F.col("decode_order") < F.col("_key"))).alias("untimed"),
    )
    return n.join(sources, "file_id").select("file_id", F.when(F.col("source") == "none", F.col("untimed")).otherwise(F.col("timed")).alias("leading_non_keyframe_frames"))

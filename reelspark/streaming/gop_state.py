"""Keyframe intervals of packets that arrive as a stream.

State is one mergeable summary for each contiguous run of packets seen so far: what came
before its first keyframe, after its last, the best inside, and whether it had one. Runs
merge when the packets between them arrive, so files need not arrive in order.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OUT = "file_id long, max_gop_bytes long, max_keyframe_interval_frames long, runs long"
#: Files share a state if their ids are equal without so many last bits; at most 64 do.
NEAR = 6


def summary(seq: int, size: int, keyframe: bool) -> list:
    """[from, to, keyframes, head bytes, head frames, tail bytes, tail frames, best bytes, best frames]."""
    return [seq, seq, 1, 0, 0, size, 1, 0, 0] if keyframe else [seq, seq, 0, size, 1, 0, 0, 0, 0]


def join(a: list, b: list) -> list:
    """The summary of a followed by b."""
    if not a[2] and not b[2]:
        return [a[0], b[1], 0, a[3] + b[3], a[4] + b[4], 0, 0, 0, 0]
    if not b[2]:
        return [a[0], b[1], a[2], a[3], a[4], a[5] + b[3], a[6] + b[4], a[7], a[8]]
    if not a[2]:
        return [a[0], b[1], b[2], a[3] + b[3], a[4] + b[4], b[5], b[6], b[7], b[8]]
    return [a[0], b[1], a[2] + b[2], a[3], a[4], b[5], b[6], max(a[7], b[7], a[5] + b[3]), max(a[8], b[8], a[6] + b[4])]


def merge(runs: list[list]) -> list[list]:
    out: list[list] = []
    for r in sorted(runs, key=lambda r: (r[0], -r[1])):
        if out and out[-1][1] + 1 == r[0]:
            out[-1] = join(out[-1], r)
        elif not out or r[0] > out[-1][1]:
            out.append(r)
    return out


def totals(runs: list[list]) -> tuple[int, int]:
    """Most bytes and frames of an interval, as if the runs followed each other."""
    whole = runs[0]
    for r in runs[1:]:
        whole = join(whole, r)
    return max(whole[3], whole[5], whole[7]), max(whole[4], whole[6], whole[8])


def _update(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    """The files of one state: what came of each is merged, and those that got packets are told."""
    files, came = json.loads(state.get[0]) if state.exists else {}, {}
    for b in batches:
        for f, s, n, k in zip(*(b[c].tolist() for c in ("file_id", "seq", "size", "keyframe"))):
            came.setdefault(None if pd.isna(f) else int(f), []).append(summary(int(s), int(n), bool(k)))
    for f, runs in came.items():
        files[str(f)] = merge(files.get(str(f), []) + runs)
    state.update((json.dumps(files),))
    rows = [(f, *totals(files[str(f)]), len(files[str(f)])) for f in came]
    yield pd.DataFrame(rows, columns=["file_id", "max_gop_bytes", "max_keyframe_interval_frames", "runs"])


def gop_stream(packets: DataFrame) -> DataFrame:
    """Streaming packets (file_id, seq, size, keyframe) -> a row for each file that got packets.

    seq counts a file's packets from 0 in decode order. A packet that comes twice counts once.
    The result equals the batch operator's when runs is 1, in whatever order packets came.
    A call into Python costs far more than a packet does, so files of neighbouring ids share a state and a call.
    """
    near = F.shiftright(F.col("file_id").cast("long"), NEAR)
    return packets.select("file_id", "seq", "size", "keyframe", near.alias("near")).groupBy("near").applyInPandasWithState(_update, OUT, "runs string", "update", "NoTimeout")


def replayed(packets: DataFrame, files: int = 4) -> DataFrame:
    """Packets (file_id, seq, size, keyframe) of a table sent through gop_stream() in at most so many batches as ``files``: what it tells at the end.

    Each batch asks for the state of all its files, so their number mustn't grow with the tasks that wrote the packets.
    The batches, the query's state and its output are in the folder named in spark.checkpoint.dir.
    """
    from ..live.shared import shared_folder

    spark = packets.sparkSession
    top = shared_folder(spark, "gop-stream")
    packets.withColumn("part", F.pmod(F.xxhash64("file_id", "seq"), F.lit(files)).cast("int")).write.partitionBy("part").parquet(f"{top}/in")
    each = -(-len(spark.read.schema(packets.schema).option("recursiveFileLookup", "true").parquet(f"{top}/in").inputFiles()) // max(1, files))
    stream = spark.readStream.schema(packets.schema).option("maxFilesPerTrigger", max(1, each)).option("recursiveFileLookup", "true").parquet(f"{top}/in")
    writer = gop_stream(stream).writeStream.outputMode("update").option("checkpointLocation", f"{top}/state").trigger(availableNow=True)
    # each batch's rows are written as they are; a file's last row is the one whose runs have all been joined
    query = writer.foreachBatch(lambda rows, n: rows.withColumn("_batch", F.lit(n)).write.mode("overwrite").parquet(f"{top}/out/{n}")).start()
    query.awaitTermination()
    last = F.max_by(F.struct("max_gop_bytes", "max_keyframe_interval_frames"), "_batch").alias("m")
    return spark.read.parquet(f"{top}/out/*").groupBy("file_id").agg(last).select("file_id", "m.max_gop_bytes", "m.max_keyframe_interval_frames")

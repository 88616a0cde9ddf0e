"""Reading what probing and converting tools print: headers as JSON, packets as CSV, boxes, progress lines."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import policy
from ..functions import scalar

STREAM = (
    "struct<codec_type:string,codec_name:string,pix_fmt:string,color_range:string,color_primaries:string,color_transfer:string,width:string,height:string,"
    "sample_aspect_ratio:string,field_order:string,nb_frames:string,start_time:string,avg_frame_rate:string,r_frame_rate:string,has_b_frames:string,"
    "disposition:map<string,int>,side_data_list:array<map<string,string>>>"
)
HEADER = f"struct<streams:array<{STREAM}>,format:struct<format_name:string,duration:string>>"
_c = F.col


def scan_argv(path: str, position: int) -> list[str]:
    """The packet scan that packets() reads: six entries of one video stream, no frame decoded."""
    return f"ffprobe -v error -select_streams v:{position} -show_data_hash MD5 -show_entries packet=pts_time,dts_time,size,pos,flags,data_hash -of csv=p=0".split() + [path]


def selected_streams(headers: DataFrame) -> DataFrame:
    """headers (file_id, json) with s (the first video stream that isn't cover art), video_position, video_stream_count.

    The position counts covers too; s is null where there is no such stream.
    """
    h = headers.withColumn("h", F.from_json("json", HEADER))
    videos = F.filter(F.coalesce(_c("h.streams"), F.array().cast(f"array<{STREAM}>")), lambda s: s["codec_type"] == "video")
    cover = lambda s: F.coalesce(F.try_element_at(s["disposition"], F.lit("attached_pic")) == 1, F.lit(False))
    h = h.withColumn("v", F.transform(videos, lambda s, i: F.struct(i.alias("i"), cover(s).alias("cover"), s.alias("s"))))
    real = F.filter("v", lambda x: ~x["cover"])
    h = h.withColumn("real", real)
    return h.select("file_id", "h", F.get("real", F.lit(0))["s"].alias("s"), F.get("real", F.lit(0))["i"].alias("video_position"), F.size("real").alias("video_stream_count"))


def headers(raw: DataFrame) -> DataFrame:
    """One row for each file: 20 header columns and error ("no video stream" leaves them null)."""
    text = lambda c, d="": F.coalesce(_c(f"s.{c}"), F.lit(d))
    side = F.filter(_c("s.side_data_list"), lambda m: F.map_contains_key(m, "rotation"))
    turn = F.coalesce(scalar.rotation(scalar.number(F.try_element_at(F.get(side, F.lit(0)), F.lit("rotation")))), F.lit(0))
    container, codec = F.coalesce(_c("h.format.format_name"), F.lit("")), F.lower(text("codec_name"))
    out = {
        "container": container, "codec_name": codec, "pixel_format": text("pix_fmt"), "color_range": text("color_range", "unknown"), "color_primaries": text("color_primaries", "unknown"), "color_transfer": text("color_transfer", "unknown"),
        "width": scalar.number(_c("s.width")).cast("int"), "height": scalar.number(_c("s.height")).cast("int"), "rotation_degrees": turn,
        "square_pixels": scalar.square_pixels(_c("s.sample_aspect_ratio")), "progressive": scalar.progressive(_c("s.field_order")),
        "has_audio": F.exists(_c("h.streams"), lambda s: F.coalesce(s["codec_type"] == "audio", F.lit(False))),
        "start_time": scalar.number(_c("s.start_time")), "declared_duration": scalar.number(_c("h.format.duration")), "declared_fps": scalar.parse_fraction(text("avg_frame_rate", "0/1")),
        "elementary_stream_fps": scalar.elementary_fps(text("r_frame_rate", "0/1"), container, codec), "declared_frame_count": scalar.number(_c("s.nb_frames")).cast("long"), "coded_reordering_depth": scalar.number(_c("s.has_b_frames")).cast("int"),
    }
    found = _c("s").isNotNull()
    return selected_streams(raw).select("file_id", "video_stream_count", "video_position", *[F.when(found, v).alias(k) for k, v in out.items()], F.when(~found, "no video stream").alias("error"))


def packets(lines: DataFrame) -> DataFrame:
    """(file_id, decode_order, pts, dts, size, pos, keyframe, discard, data_hash) of lines (file_id, line_no, line).

    Lines with under six columns or without a whole size are passed over; N/A is null,
    an unknown place -1.
    """
    c = F.split("line", ",")
    at = lambda i: F.get(c, F.lit(i))
    stamp = lambda i: F.when(~at(i).isin(*scalar.ABSENT), at(i)).try_cast("double")
    rows = lines.where((F.size(c) >= 6) & at(2).rlike("^[0-9]+$"))
    pos = F.when(at(3).rlike("^-*[0-9]+$"), at(3).try_cast("long"))
    return rows.select("file_id", _c("line_no").alias("decode_order"), stamp(0).alias("pts"), stamp(1).alias("dts"), at(2).cast("long").alias("size"), F.coalesce(pos, F.lit(-1)).alias("pos"), at(4).contains("K").alias("keyframe"), at(4).contains("D").alias("discard"), at(5).alias("data_hash"))


def timed(raw: DataFrame) -> DataFrame:
    """packets() with source and time: pts if any packet of the file has one, else dts, else none with time 0.

    The source holds for the whole file: packets without it are dropped.
    """
    w = Window.partitionBy("file_id")
    some = lambda x: F.max(_c(x).isNotNull()).over(w)
    out = raw.withColumn("source", F.when(some("pts"), "pts").when(some("dts"), "dts").otherwise("none"))
    out = out.withColumn("time", F.when(_c("source") == "pts", _c("pts")).when(_c("source") == "dts", _c("dts")).otherwise(0.0))
    return out.where("time IS NOT NULL")


def scan_errors(lines: DataFrame) -> DataFrame:
    """file_id, error of the files whose lines hold no packet: no hash column, or none at all."""
    n = F.size(F.split("line", ","))
    fine = (n >= 6) & F.get(F.split("line", ","), F.lit(2)).rlike("^[0-9]+$")
    g = lines.groupBy("file_id").agg(F.count_if(fine).alias("fine"), F.count_if(n == 5).alias("unhashed"))
    return g.select("file_id", F.when(_c("fine") > 0, F.lit(None)).when(_c("unhashed") > 0, "no payload hashes").otherwise("no packets").alias("error"))


def moov_first(boxes: DataFrame) -> DataFrame:
    """file_id, moov_at_start of boxes (file_id, ordinal, box_type): null unless ftyp is first and moov is there."""
    first = lambda t: F.min(F.when(_c("box_type") == t, _c("ordinal")))
    g = boxes.where(_c("ordinal") < policy.MOST_BOXES).groupBy("file_id").agg(first("ftyp").alias("f"), first("moov").alias("m"), first("mdat").alias("d"))
    told = (_c("f") == 0) & _c("m").isNotNull()
    return g.select("file_id", F.when(told, F.coalesce(_c("m") < _c("d"), F.lit(True))).alias("moov_at_start"))


def top_boxes(data: bytes) -> list[str]:
    """Types of the first boxes at the top level; stops where a size can't be followed."""
    out, at = [], 0
    while len(out) < policy.MOST_BOXES and at + 8 <= len(data):
        size, kind = struct.unpack_from(">I4s", data, at)
        out.append(kind.decode("latin-1"))
        if out[0] != "ftyp" or size == 0:
            break
        if size == 1:
            if at + 16 > len(data):
                break
            size = struct.unpack_from(">Q", data, at + 8)[0]
            if size < 16:
                break
        elif size < 8:
            break
        at += size
    return out


def boxes_at(path: str) -> list[str]:
    """top_boxes() of a file, of which only the boxes' heads are read."""
    out, at = [], 0
    with open(path, "rb") as f:
        end = f.seek(0, 2)
        while len(out) < policy.MOST_BOXES and at + 8 <= end:
            f.seek(at)
            head = f.read(16)
            one = top_boxes(head)
            if not one:
                break
            out.append(one[0])
            size = int.from_bytes(head[:4], "big")
            size = int.from_bytes(head[8:16], "big") if size == 1 else size
            if out[0] != "ftyp" or size < (16 if head[:4] == b"\0\0\0\1" else 8):
                break
            at += size
    return out


def boxes(files: DataFrame) -> DataFrame:
    """(path, box_type array) of files (path, content), as the binaryFile source gives them."""

    @F.pandas_udf("array<string>")
    def read(content: pd.Series) -> pd.Series:
        return content.map(lambda b: top_boxes(bytes(b)))

    return files.select("path", read("content").alias("box_types"))


def candidates(paths: DataFrame) -> DataFrame:
    """paths with candidate: whether the last suffix names a video."""
    return paths.withColumn("candidate", scalar.suffix(_c("path")).isin(*policy.VIDEO_SUFFIXES))


def progress(lines: DataFrame) -> DataFrame:
    """(run_id, block, out_time, fps, speed, fraction) of lines (run_id, line_no, line, duration).

    A progress line closes a block; what follows "end" is not read, nor lines without "=".
    Of a key that comes twice in a block the last counts.
    """
    key, value = F.substring_index(F.trim("line"), "=", 1), F.regexp_replace(F.trim("line"), "^[^=]*=", "")
    rows = lines.where(_c("line").contains("=")).select("run_id", "line_no", "duration", key.alias("key"), value.alias("value"))
    w = Window.partitionBy("run_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    closes, ends = _c("key") == "progress", (_c("key") == "progress") & (_c("value") == "end")
    rows = rows.select("*", F.coalesce(F.sum(closes.cast("long")).over(w), F.lit(0)).alias("block"), F.coalesce(F.max(ends).over(w), F.lit(False)).alias("over")).where("NOT over")
    pick = lambda k: F.max_by("value", F.when(_c("key") == k, _c("line_no")))
    g = rows.groupBy("run_id", "block").agg(F.max(closes).alias("closed"), F.max("duration").alias("duration"), *[pick(k).alias(k) for k in ("out_time_us", "out_time", "fps", "speed")])
    return readings(g.where("closed"))


def readings(blocks: DataFrame) -> DataFrame:
    """run_id, block, out_time, fps, speed, fraction; the fraction is null without a duration or an out time."""
    out = F.coalesce(scalar.reading(_c("out_time_us")) / 1e6, scalar.clock(_c("out_time")))
    b = blocks.withColumn("t", out)
    part = F.when(_c("duration") > 0, _c("t") / _c("duration"))
    return b.select("run_id", "block", _c("t").alias("out_time"), scalar.reading(_c("fps")).alias("fps"), scalar.reading(_c("speed")).alias("speed"), part.alias("fraction"))


def known(*columns: str) -> Column:
    """Whether all of these are told."""
    out = F.lit(True)
    for c in columns:
        out = out & _c(c).isNotNull()
    return out

"""Content and timing identity, and duplicates by it."""

from __future__ import annotations

import hashlib
import json
import struct
import uuid
from array import array
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import policy
from ..functions import scalar

STRINGS = ("codec_name", "pixel_format", "color_range", "color_primaries", "color_transfer")
INTEGERS = ("width", "height", "rotation_degrees")
FLAGS = ("square_pixels", "progressive")


def _sized(value: bytes) -> bytes:
    return struct.pack("<I", len(value)) + value


def content_head(header: dict, packets: int, tag: bytes) -> bytes:
    """Tag, five strings, three integers, two flags, the count of packets."""
    head = [_sized(tag), *(_sized(header[c].encode()) for c in STRINGS), *(struct.pack("<q", header[c]) for c in INTEGERS), *(struct.pack("<?", header[c]) for c in FLAGS)]
    return b"".join([*head, struct.pack("<q", packets)])


def packet_bytes(size: int, keyframe: bool, data_hash: str) -> bytes:
    return struct.pack("<q?", size, bool(keyframe)) + _sized(data_hash.encode())


def content_input(header: dict, packets: list[tuple[int, bool, str]], tag: bytes) -> bytes:
    """The head, then size, flag and hash of each packet in decode order."""
    return content_head(header, len(packets), tag) + b"".join(packet_bytes(*p) for p in packets)


def video_input(content: bytes, supplied: bool, times: list[float], tag: bytes) -> bytes:
    return _sized(tag) + _sized(content) + struct.pack("<?q", bool(supplied), len(times)) + struct.pack(f"<{len(times)}d", *times)


def digest(payload: bytes) -> bytes:
    return hashlib.blake2b(payload, digest_size=16).digest()


def as_uuid8(value: bytes) -> str:
    """The digest as a UUID of version 8: four version bits and two variant bits are set."""
    n = int.from_bytes(value, "big")
    n = n & ~(0xF << 76) | 8 << 76
    return str(uuid.UUID(int=n & ~(3 << 62) | 2 << 62))


_MINTED = "file_id long, video_uuid string, content_digest string"


def _mint(content_tag: bytes, video_tag: bytes, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows by file: its header, then its packets in decode order. Of a file only the times are held."""
    held: tuple | None = None

    def told(file_id: int, supplied: bool, content, times: array) -> tuple:
        own = content.digest()
        return file_id, as_uuid8(digest(video_input(own, supplied, times, video_tag))), own.hex()

    def as_batch(rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows)) or [()] * 3
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.string()))], ["file_id", "video_uuid", "content_digest"])

    for b in batches:
        out = []
        for file_id, head, size, keyframe, data_hash, time in zip(*(c.to_pylist() for c in b.columns)):
            if head is not None:
                if held:
                    out.append(told(*held))
                header = json.loads(head)
                held = file_id, header["supplied"], hashlib.blake2b(content_head(header, header["packets"], content_tag), digest_size=16), array("d")
            elif held and held[0] == file_id:  # a file without a header is passed over
                held[2].update(packet_bytes(size, keyframe, data_hash))
                held[3].append(time)
        yield as_batch(out)
    if held:
        yield as_batch([told(*held)])


def mint(packets: DataFrame, headers: DataFrame, tags: policy.Tags = policy.Tags()) -> DataFrame:
    """file_id, video_uuid, content_digest of the files that have packets and a header. headers: file_id (once), the hashed columns, timing_source.

    A file's header goes before its packets in one sorted stream, so a file of any length is hashed
    as it passes; its times are held until its content is known.
    """
    n = packets.groupBy("file_id").agg(F.count("*").alias("packets"))
    head = F.to_json(F.struct(*STRINGS, *INTEGERS, *FLAGS, scalar.supplied(F.col("timing_source")).alias("supplied"), "packets"), {"ignoreNullFields": "false"})
    none = lambda t: F.lit(None).cast(t)
    heads = headers.join(n, "file_id").select("file_id", head.alias("head"), none("long").alias("decode_order"), none("long").alias("size"), none("boolean").alias("keyframe"), none("string").alias("data_hash"), none("double").alias("time"))
    rows = packets.select("file_id", none("string").alias("head"), F.col("decode_order").cast("long").alias("decode_order"), F.col("size").cast("long").alias("size"), F.coalesce("keyframe", F.lit(False)).alias("keyframe"), F.coalesce("data_hash", F.lit("")).alias("data_hash"), F.coalesce("time", F.lit(0.0)).cast("double").alias("time"))
    stream = heads.unionByName(rows).repartition("file_id").sortWithinPartitions("file_id", F.col("head").isNull(), "decode_order")
    return stream.select("file_id", "head", "size", "keyframe", "data_hash", "time").mapInArrow(partial(_mint, tags.content, tags.video), _MINTED)


def content_md5(packets: DataFrame) -> DataFrame:
    """file_id, content_digest: MD5 over what identifies the packets, in decode order, by built-in functions."""
    text = F.concat_ws(":", F.col("size").cast("string"), F.col("keyframe").cast("string"), F.coalesce("data_hash", F.lit("")))
    rows = F.sort_array(F.collect_list(F.struct("decode_order", text.alias("x"))))
    return packets.groupBy("file_id").agg(F.md5(F.array_join(F.transform(rows, lambda r: r["x"]), "|")).alias("content_digest"))


def compare(pairs: DataFrame, fps_tolerance: float | None = None, duration_tolerance: float | None = None) -> DataFrame:
    """pairs with verdict, fps_delta, duration_delta, fps_tolerance, duration_tolerance.

    pairs: left_ and right_ content_digest, timing_source, fps, duration. Both tolerances come
    from the left side, so the order matters, unless they are given.
    """
    side = lambda c: (F.col(f"left_{c}"), F.col(f"right_{c}"))
    (ld, rd), (lt, rt), (lf, rf), (ll, rl) = side("content_digest"), side("timing_source"), side("fps"), side("duration")
    unminted = (F.coalesce(ld, F.lit("")) == "") | (F.coalesce(rd, F.lit("")) == "")
    unknown = ~scalar.supplied(lt) | ~scalar.supplied(rt) | (ll <= 0)
    told = ~unminted & (ld == rd) & ~unknown
    deltas = {"fps_delta": F.abs(lf - rf), "duration_delta": F.abs(ll - rl), "fps_tolerance": scalar.timing_tolerance(lf, ll), "duration_tolerance": scalar.timing_tolerance(ll, ll)}
    deltas |= {k: F.lit(float(v)) for k, v in (("fps_tolerance", fps_tolerance), ("duration_tolerance", duration_tolerance)) if v is not None}
    out = pairs.withColumns({k: F.when(told, v) for k, v in deltas.items()})
    within = (F.col("fps_delta") <= F.col("fps_tolerance")) & (F.col("duration_delta") <= F.col("duration_tolerance"))
    return out.withColumn("verdict", F.when(unminted, "unminted").when(ld != rd, "distinct").when(unknown, "timing_unknown").when(within, "duplicate").otherwise("different_timing"))


def duplicates(facts: DataFrame) -> DataFrame:
    """Each file against the first of its digest: left_file_id, right_file_id, verdict; as many rows as files, never pairs of a group.

    The first of a digest is found by an aggregate with partial sums and joined back.
    """
    cols = ("file_id", "content_digest", "timing_source", "fps", "duration")
    minted = facts.where("content_digest <> ''").select(*cols)
    first = minted.groupBy("content_digest").agg(F.min_by(F.struct(*cols), "file_id").alias("l"))
    pairs = minted.join(first, "content_digest").where(F.col("file_id") != F.col("l.file_id"))
    pairs = pairs.select(*[F.col(f"l.{c}").alias(f"left_{c}") for c in cols], *[F.col(c).alias(f"right_{c}") for c in cols])
    return compare(pairs)


def exact_groups(texts: DataFrame) -> DataFrame:
    """id, digest, first_id, copies for rows (id, digest) whose digest occurs again."""
    g = texts.groupBy("digest").agg(F.min("id").alias("first_id"), F.count("*").alias("copies")).where("copies > 1")
    return texts.join(g, "digest").where("id <> first_id").select("id", "digest", "first_id", "copies")


def exit_code(verdict):
    out = F.lit(None).cast("int")
    for k, v in policy.EXIT_CODES.items():
        out = F.when(verdict == k, v).otherwise(out)
    return out


def ordered(packets: DataFrame) -> DataFrame:
    """packets with position: their place in decode order."""
    return packets.withColumn("position", F.row_number().over(Window.partitionBy("file_id").orderBy("decode_order")) - 1)

"""Packets, facts and segments read from the star-schema tables.

The mappings are SQL text that any engine reads, so a result can be checked elsewhere.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

PACKETS_A = """
SELECT user_id AS file_id, event_id AS decode_order, {micros} / 1e6 AS time, CAST(floor(value * 100) AS BIGINT) AS size,
       coalesce(event_type = 'view', false) AS keyframe, coalesce(event_type = 'error', false) AS discard,
       'MD5:' || md5(coalesce(props, '')) AS data_hash
FROM events
"""

PACKETS_B = """
SELECT l_suppkey AS file_id, CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_shipdate) - 1 AS BIGINT) AS decode_order,
       {micros} / 1e6 AS time, CAST(l_quantity AS BIGINT) AS size, l_returnflag = 'R' AS keyframe, l_tax > 0.07e0 AS discard,
       'MD5:' || md5(CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING)) AS data_hash
FROM lineitem
"""

_FPS = "CASE o_orderkey % 6 WHEN 0 THEN 0e0 WHEN 1 THEN 24e0 WHEN 2 THEN 25e0 WHEN 3 THEN 29.97e0 WHEN 4 THEN 30e0 ELSE 60e0 END"
_FACTS = {
    "file_id": "o_orderkey",
    "container": "CASE o_orderkey % 11 WHEN 0 THEN 'avi' WHEN 1 THEN 'matroska,webm' WHEN 2 THEN 'h264' WHEN 3 THEN 'obu' ELSE 'mov,mp4,m4a,3gp,3g2,mj2' END",
    "codec_name": "CASE o_custkey % 17 WHEN 0 THEN 'hevc' WHEN 1 THEN 'mpeg4' WHEN 2 THEN 'vp8' WHEN 3 THEN 'ffv1' WHEN 4 THEN 'av1' ELSE 'h264' END",
    "pixel_format": "CASE WHEN o_custkey % 13 = 0 THEN 'yuv422p10le' ELSE 'yuv420p' END",
    "color_range": "'tv'",
    "color_primaries": "'bt709'",
    "color_transfer": "'unknown'",
    "width": "CAST(320 + o_orderkey % 9 * 160 AS INT)",
    "height": "CAST(240 + o_custkey % 7 * 120 AS INT)",
    "rotation_degrees": "CASE o_orderkey % 23 WHEN 0 THEN 90 WHEN 1 THEN 270 WHEN 2 THEN 180 WHEN 3 THEN 45 ELSE 0 END",
    "square_pixels": "o_orderkey % 17 <> 0",
    "progressive": "o_orderstatus <> 'P' OR o_orderkey % 4 <> 0",
    "has_audio": "o_custkey % 2 = 0",
    "video_stream_count": "1",
    "duration": "o_totalprice / 1e3",
    "fps": _FPS,
    "frame_count": "1 + o_custkey * 7 % 5000",
    "start_time": "CASE o_orderkey % 10 WHEN 0 THEN 0.5e0 WHEN 1 THEN -0.007e0 ELSE 0e0 END",
    "constant_frame_rate": "o_orderkey % 5 <> 0",
    "max_instantaneous_fps": "CASE WHEN o_orderkey % 5 = 0 THEN 120e0 END",
    "declared_duration": "o_totalprice / 1e3 * CASE o_custkey % 10 WHEN 0 THEN 1.2e0 WHEN 1 THEN 0e0 ELSE 1e0 END",
    "declared_fps": f"CASE o_custkey % 12 WHEN 0 THEN 0e0 WHEN 1 THEN 50e0 ELSE {_FPS} END",
    "declared_frame_count": "CASE o_custkey % 14 WHEN 0 THEN 100 WHEN 1 THEN 0 ELSE 1 + o_custkey * 7 % 5000 END",
    "moov_at_start": "CASE o_custkey % 6 WHEN 0 THEN false WHEN 1 THEN CAST(NULL AS BOOLEAN) ELSE true END",
    "max_keyframe_interval_frames": "10 + o_custkey % 210",
    "max_gop_bytes": "o_orderkey * 97 % 600000",
    "discard_flagged_packets": "CASE WHEN o_orderkey % 19 = 0 THEN 3 ELSE 0 END",
    "leading_non_keyframe_frames": "CASE WHEN o_custkey % 29 = 0 THEN 2 ELSE 0 END",
    "coded_reordering_depth": "CAST(o_orderkey % 3 AS INT)",
    "max_timestamp_gap_frame_periods": "CASE o_orderkey % 4 WHEN 0 THEN 0e0 WHEN 1 THEN 1.1e0 WHEN 2 THEN 1.6e0 ELSE 1e0 END",
    "timing_source": "CASE o_orderkey % 13 WHEN 0 THEN 'absent' WHEN 1 THEN 'synthesized' WHEN 2 THEN 'decode' ELSE 'presentation' END",
    "video_uuid": "md5(CAST(o_orderkey AS STRING))",
    "content_digest": "CASE WHEN o_orderkey % 31 = 0 THEN '' ELSE md5(CAST(o_orderkey % 500 AS STRING)) END",
    "identity_scheme": "'2'",
    "prober_version": "'none'",
}
FACTS = "SELECT " + ", ".join(f"{v} AS {k}" for k, v in _FACTS.items()) + " FROM orders"

SEGMENTS = """
SELECT CAST(c_nationkey AS BIGINT) AS sequence_id, c_custkey AS ordinal, 'clip' || CAST(c_custkey AS STRING) || '.mp4' AS path,
       CAST(50 + c_custkey * 13 % 211 AS BIGINT) AS frame_count,
       CASE WHEN c_nationkey % 4 = 0 AND c_custkey % 40 = 7 THEN 25e0 WHEN c_nationkey % 4 = 3 AND c_custkey % 50 = 9 THEN 0e0 ELSE 30e0 END AS fps,
       CASE WHEN c_nationkey % 4 = 1 AND c_custkey % 30 = 11 THEN 1280 ELSE 640 END AS width, CASE WHEN c_nationkey % 4 = 2 AND c_custkey % 60 = 13 THEN 720 ELSE 480 END AS height,
       (50 + c_custkey * 13 % 211) / 30e0 AS duration
FROM customer
"""

#: One column of time as microseconds, as Spark and as another engine write it.
MICROS = {"A": ("unix_micros(CAST(ts AS TIMESTAMP))", "epoch_us(ts)"), "B": ("unix_micros(CAST(l_shipdate AS TIMESTAMP))", "epoch_us(l_shipdate)")}


def read_sql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """The rows of a SELECT from one of the tables."""
    name = text.split("FROM ")[-1].split()[0]
    return spark.sql(text.replace(f"FROM {name}", f"FROM parquet.`{sf_dir}/{name}.parquet`"))


def packets_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packets of few per file, times ascending."""
    return read_sql(spark, sf_dir, PACKETS_A.replace("{micros}", MICROS["A"][0]))


def packets_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packets of many per file, strongly reordered, with repeated times."""
    return read_sql(spark, sf_dir, PACKETS_B.replace("{micros}", MICROS["B"][0]))


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_sql(spark, sf_dir, FACTS)


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_sql(spark, sf_dir, SEGMENTS)

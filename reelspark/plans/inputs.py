"""Inputs of the catalogue's queries from the driver's tables, as SQL text that both engines read."""

PARTNER = "CASE WHEN file_id % 3 = 0 THEN file_id + 500 WHEN file_id % 3 = 1 THEN file_id ELSE file_id + 31 END"

HEADER_JSON = """
SELECT o_orderkey AS file_id,
 '{"streams":[' || CASE WHEN o_orderkey % 4 = 0 THEN '{"codec_type":"video","codec_name":"mjpeg","disposition":{"attached_pic":1}},' ELSE '' END
 || CASE WHEN o_orderkey % 9 = 0 THEN '' ELSE '{"codec_type":"video","codec_name":"' || CASE WHEN o_custkey % 2 = 0 THEN 'H264' ELSE 'vp9' END || '","width":' || CAST(o_custkey % 1000 AS STRING)
   || CASE WHEN o_custkey % 5 = 0 THEN ',"sample_aspect_ratio":"4:3"' WHEN o_custkey % 5 = 1 THEN ',"sample_aspect_ratio":"0:1"' ELSE '' END || CASE WHEN o_custkey % 7 = 0 THEN ',"field_order":"tt"' ELSE '' END
   || CASE WHEN o_orderkey % 6 = 1 THEN ',"side_data_list":[{"rotation":' || CAST(o_custkey % 5 * 90 - 180 AS STRING) || '}]' ELSE '' END || CASE WHEN o_orderkey % 5 = 0 THEN ',"nb_frames":"N/A"' WHEN o_orderkey % 5 = 1 THEN ',"nb_frames":"' || CAST(o_custkey AS STRING) || '"' ELSE '' END
   || ',"avg_frame_rate":"' || CAST(24 + o_custkey % 7 AS STRING) || '000/1001","disposition":{"attached_pic":0}},' END
 || '{"codec_type":"' || CASE WHEN o_orderkey % 2 = 0 THEN 'audio' ELSE 'data' END || '"}],"format":{"format_name":"mov,mp4"}}' AS json
FROM orders
"""

PACKET_LINES = """
SELECT user_id AS file_id, event_id AS line_no,
 CASE WHEN user_id % 9 = 7 THEN CAST(event_id AS STRING) || ',N/A,12,3,K' WHEN user_id % 9 = 8 THEN 'x' ELSE
  CASE WHEN user_id % 4 = 0 OR event_id % 10 = 0 THEN 'N/A' ELSE CAST(event_id AS STRING) || '.5' END || ',' || CASE WHEN user_id % 8 = 0 THEN 'N/A' ELSE CAST(event_id AS STRING) || '.25' END || ','
  || CASE WHEN event_id % 13 = 0 THEN 'N/A' ELSE CAST(event_id % 997 AS STRING) END || ',' || CASE WHEN event_id % 7 = 0 THEN 'N/A' WHEN event_id % 7 = 1 THEN '-1' ELSE CAST(event_id * 188 AS STRING) END || ','
  || CASE event_type WHEN 'view' THEN 'K__' WHEN 'error' THEN '_D_' ELSE '___' END || ',MD5:' || md5(coalesce(props, '')) || CASE WHEN user_id % 3 = 0 THEN ',' ELSE '' END END AS line
FROM events
"""

TARGETS = "SELECT l_suppkey AS file_id, l_orderkey % 300 AS rank FROM lineitem"
GLOBAL_TARGETS = "SELECT CAST(c_nationkey AS BIGINT) AS sequence_id, c_custkey * 53 % 9000 - 20 AS global_frame FROM customer"
OBSERVED = """
SELECT user_id AS file_id, event_id AS obs_id, {micros} / 1e6 + CASE event_id % 4 WHEN 0 THEN 0e0 WHEN 1 THEN 200e0 WHEN 2 THEN -700e0 ELSE 5e4 END AS time,
 CASE user_id % 3 WHEN 0 THEN 0e0 WHEN 1 THEN 1e0 / 1000 ELSE 1e0 / 2000 END AS fps, {micros} / 1e6 - CASE WHEN event_id % 5 = 0 THEN 5e3 ELSE 0e0 END AS keyframe_time
FROM events
"""
OUTPUTS = """
SELECT o_orderkey AS file_id, 'in/' || CAST(o_orderkey AS STRING) || CASE o_orderkey % 3 WHEN 0 THEN '.MOV' WHEN 1 THEN '.mp4' ELSE '.tar.avi' END AS source,
 CASE o_orderkey % 5 WHEN 0 THEN 'out' WHEN 1 THEN 'in/' || CAST(o_orderkey AS STRING) || '.mp4' WHEN 2 THEN 'a/b.mkv' WHEN 3 THEN 'a/b.MP4' ELSE 'in' END AS output, o_orderkey % 5 IN (0, 4) AS is_dir
FROM orders
"""
FRACTIONS = "SELECT o_orderkey AS id, CASE o_orderkey % 6 WHEN 0 THEN '' WHEN 1 THEN 'N/A' WHEN 2 THEN CAST(o_custkey AS STRING) || '/0' WHEN 3 THEN CAST(o_custkey AS STRING) WHEN 4 THEN '/7' ELSE CAST(o_custkey AS STRING) || '/1001' END AS v FROM orders"
RATES = "SELECT o_orderkey AS id, o_custkey * 3 AS num, 1 + o_orderkey % 50 AS den, CASE o_orderkey % 3 WHEN 0 THEN 'h264' WHEN 1 THEN 'hevc' ELSE 'mov' END AS container, CASE o_custkey % 2 WHEN 0 THEN 'h264' ELSE 'hevc' END AS codec FROM orders"
SOURCES = "SELECT o_orderkey AS id, CASE o_custkey % 3 WHEN 0 THEN 'none' WHEN 1 THEN 'pts' ELSE 'dts' END AS src, CASE o_orderkey % 4 WHEN 0 THEN 'obu' WHEN 1 THEN 'h263' ELSE 'avi' END AS container FROM orders"
ANGLES = "SELECT o_orderkey AS id, (o_custkey % 1441 - 720) / 2e0 AS angle FROM orders"
PROGRESS_FIELDS = """
SELECT o_orderkey AS id, CASE o_orderkey % 3 WHEN 0 THEN 'N/A' WHEN 1 THEN CAST(o_custkey * 1000 AS STRING) ELSE '' END AS us,
 CASE o_custkey % 4 WHEN 0 THEN 'N/A' WHEN 1 THEN '1:2' ELSE '01:' || CAST(o_custkey % 60 AS STRING) || ':07.5' END AS ck, CASE o_orderkey % 5 WHEN 0 THEN ' 1.5x' WHEN 1 THEN 'N/A' WHEN 2 THEN 'abc' ELSE '2' END AS sp, CASE WHEN o_orderkey % 7 = 0 THEN 0e0 ELSE 100e0 END AS d
FROM orders
"""
QUALITY = "SELECT o_orderkey AS id, CAST(o_custkey % 90 - 15 AS INT) AS crf, CASE o_orderkey % 5 WHEN 0 THEN 'ultrafast' WHEN 1 THEN 'fast' WHEN 2 THEN 'medium' WHEN 3 THEN 'veryslow' ELSE 'odd' END AS preset, CASE WHEN o_custkey % 10 = 0 THEN 40 ELSE 30 END AS own FROM orders"
PATHS = "SELECT c_custkey AS id, 'd.x/' || c_name || CASE c_custkey % 8 WHEN 0 THEN '.MP4' WHEN 1 THEN '.mp4.txt' WHEN 2 THEN '.ogv' WHEN 3 THEN '.ogg' WHEN 4 THEN '/.mp4' WHEN 5 THEN '' WHEN 6 THEN '.a.264' ELSE '.webm' END AS path FROM customer"
BOXES = "SELECT l_orderkey AS file_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate) - 1 AS BIGINT) AS ordinal, CASE WHEN l_linenumber = 1 THEN 'ftyp' WHEN l_partkey % 3 = 0 THEN 'moov' WHEN l_partkey % 3 = 1 THEN 'mdat' ELSE 'free' END AS box_type FROM lineitem"
PROGRESS_LINES = """
SELECT user_id AS run_id, event_id AS line_no, CASE WHEN user_id % 5 = 0 THEN 0e0 ELSE 2000e0 END AS duration,
 CASE WHEN event_type = 'view' THEN 'progress=continue' WHEN event_type = 'error' AND event_id % 3 = 0 THEN 'progress=end' WHEN event_type = 'error' THEN 'noise' WHEN event_id % 3 = 0 THEN 'out_time_us=' || CAST(event_id AS STRING)
  WHEN event_id % 3 = 1 THEN 'fps=30.5' ELSE 'speed= 1.25x' END AS line
FROM events
"""
ENCODER_LINES = "SELECT c_custkey AS line_no, CASE c_custkey % 4 WHEN 0 THEN ' V....D av1_nvenc NVIDIA (codec av1)' WHEN 1 THEN '------' WHEN 2 THEN ' V..... libsvtav1  SVT' ELSE ' V..... encoder' || CAST(c_custkey AS STRING) || ' x' END AS line FROM customer"
#: Frames of 3 x 2 pixels in three channels, cut from two hashes.
FRAMES = """
SELECT user_id AS file_id, event_id AS frame_index, 2 AS height, 3 AS width, 3 AS channels, md5(CAST(event_id AS STRING)) || substr(md5(coalesce(props, '')), 1, CASE WHEN event_id % 97 = 5 THEN 2 ELSE 4 END) AS hexed
FROM events
"""
ZIPPED = "SELECT CAST(c_nationkey AS BIGINT) AS sequence_id, c_custkey AS ordinal, 'clip' || CAST(c_custkey AS STRING) || '.mp4' AS path FROM customer"

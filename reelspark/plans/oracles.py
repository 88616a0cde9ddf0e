"""DuckDB SQL for the engine's queries."""

from __future__ import annotations

from .. import policy
from ..sources import driver_tables as D
from . import inputs as I

PA = "pa AS (" + D.PACKETS_A.replace("{micros}", D.MICROS["A"][1]) + ")"
PB = "pb AS (" + D.PACKETS_B.replace("{micros}", D.MICROS["B"][1]) + ")"
FACTS = f"facts AS ({D.FACTS})"
SEG = f"seg AS ({D.SEGMENTS})"
STARTS = SEG + ", st AS (SELECT *, coalesce(sum(frame_count) OVER (PARTITION BY sequence_id ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start_frame FROM seg)"


def _times(p: str) -> str:
    return f"""t AS (SELECT file_id, time, bool_or(keyframe) AS is_keyframe FROM {p} WHERE time IS NOT NULL GROUP BY ALL),
r AS (SELECT *, row_number() OVER w - 1 AS rank, lag(time) OVER w AS prev, count(*) OVER (PARTITION BY file_id) AS n, min(time) OVER (PARTITION BY file_id) AS t0, max(time) OVER (PARTITION BY file_id) AS t1 FROM t WINDOW w AS (PARTITION BY file_id ORDER BY time)),
f AS (SELECT *, CASE WHEN n > 1 THEN (n - 1) / (t1 - t0) END AS fps FROM r),
fit AS (SELECT file_id, max(n) AS frame_count, max(fps) AS fps, max(t1 - t0) * max(n) / (max(n) - 1) AS duration, max(abs((time - t0) - rank / fps) * fps) AS max_drift,
        max((time - prev) * fps) AS max_gap, min(time - prev) AS least FROM f GROUP BY file_id)"""


_INDEX = """k AS (SELECT file_id, rank, time, is_keyframe, coalesce(max(CASE WHEN is_keyframe THEN rank END) OVER (PARTITION BY file_id ORDER BY rank), 0) AS keyframe_rank FROM r),
pk AS (SELECT k.*, b.time AS keyframe_time FROM k JOIN r b ON b.file_id = k.file_id AND b.rank = k.keyframe_rank)"""
_GOP = """g AS (SELECT file_id, size, sum(keyframe::INT) OVER (PARTITION BY file_id ORDER BY decode_order) AS gop, discard FROM {p}),
gg AS (SELECT file_id, gop, sum(size) AS b, count(*) AS c FROM g GROUP BY ALL),
gop AS (SELECT file_id, max(b)::BIGINT AS max_gop_bytes, max(c)::BIGINT AS max_keyframe_interval_frames FROM gg GROUP BY file_id)"""
_LEAD = "lead_t AS (SELECT file_id, count(*) FILTER (time < (SELECT min(time) FROM t b WHERE b.file_id = t.file_id AND is_keyframe)) AS timed FROM t GROUP BY file_id)"



def _in(names) -> str:
    return "(" + ", ".join(f"'{n}'" for n in names) + ")"


_LIES = "CASE WHEN frame_count <= 0 OR fps <= 0 THEN false ELSE (declared_frame_count > 0 AND abs(declared_frame_count - frame_count) / frame_count > 0.01e0) OR (declared_fps > 0 AND abs(declared_fps - fps) / fps > 0.05e0) END"
_TRUNC = "CASE WHEN declared_duration > 0 THEN duration / declared_duration < 0.95e0 ELSE false END"
_RULES = [
    ("unsupported_container", f"container NOT IN {_in(policy.BROWSER_CONTAINERS)}", "SH"),
    ("unsupported_codec", f"codec_name NOT IN {_in(policy.BROWSER_CODECS)}", "SHR"),
    ("variable_frame_rate", "timing_source IN ('presentation', 'decode') AND NOT constant_frame_rate", "SHRAQ"),
    ("rotated", "rotation_degrees <> 0", "SHRAQ"),
    ("non_square_pixels", "NOT square_pixels", "SHRAQ"),
    ("non_zero_start_time", "fps > 0 AND abs(start_time) > 0.5e0 / CASE WHEN fps > 0 THEN fps END", "SHR"),
    ("interlaced", "NOT progressive", "SRAQ"),
    ("unverified_frame_correspondence", f"codec_name NOT IN {_in(policy.FRAME_EXACT_CODECS)}", "AQ"),
    ("client_dependent_decode", "codec_name = 'hevc' OR pixel_format NOT IN ('yuv420p', 'yuvj420p')", "SR"),
    ("moov_not_at_start", "moov_at_start IS NOT NULL AND NOT moov_at_start", "S"),
    ("large_seek_payload", "max_gop_bytes > 524288", "SR"),
    ("sparse_keyframes", "max_keyframe_interval_frames > 200", "SR"),
    ("unreliable_timing_metadata", f"(NOT ({_TRUNC}) AND ({_LIES})) OR timing_source IN ('absent', 'synthesized')", "A"),
    ("presentation_timing_requires_decode", "timing_source = 'synthesized' OR (coded_reordering_depth > 0 AND timing_source IN ('decode', 'absent'))", "SHRAQ"),
]


def _any(flags: str) -> str:
    return " OR ".join(f"coalesce({c}, false)" for _, c, f in _RULES if set(flags) <= set(f))


def _names(flag: str) -> str:
    return "concat_ws(',', " + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c, f in sorted(_RULES) if flag in f) + ")"


VERDICT = (
    FACTS
    + f""", v AS (SELECT *, {_names("S")} AS s_reasons, {_names("A")} AS a_reasons, {_any("SH")} AS hard, {_any("SR")} AS s_reencode, {_any("AQ")} AS a_reencode, {_TRUNC} AS truncated FROM facts),
d AS (SELECT *, CASE WHEN hard THEN 'required' WHEN s_reasons <> '' THEN 'recommended' END AS stream_transcode, CASE WHEN a_reasons <> '' THEN 'required' END AS analysis_transcode FROM v),
m AS (SELECT *, CASE WHEN a_reencode THEN 'reencode_av1' WHEN contains(a_reasons, 'unreliable_timing_metadata') THEN 'remux_timebase' END AS a_least,
      CASE WHEN s_reencode THEN 'reencode_av1' WHEN contains(s_reasons, 'unsupported_container') THEN 'remux_container' WHEN contains(s_reasons, 'moov_not_at_start') THEN 'remux_faststart' END AS s_least,
      codec_name NOT IN {_in(policy.MP4_COPY_CODECS)} OR discard_flagged_packets > 0 OR leading_non_keyframe_frames > 0 AS stuck FROM d),
o AS (SELECT *, CASE WHEN a_least IS NOT NULL AND stuck THEN 'reencode_av1' ELSE a_least END AS a_op, CASE WHEN s_least IS NOT NULL AND stuck THEN 'reencode_av1' ELSE s_least END AS s_op FROM m)"""
)


def _command(p: str, quality: int, preset: int, group: str, audio: str, reasons: str) -> str:
    rate = "CASE WHEN fps > 0 THEN fps ELSE declared_fps END"
    return f"""SELECT file_id, {p} AS operation,
 CASE WHEN {p} IS NULL OR (timing_source = 'absent' AND declared_fps <= 0) THEN NULL
  WHEN {p} = 'reencode_av1' THEN 'ffmpeg -hide_banner -v error -y -flags2 +showall' || CASE WHEN discard_flagged_packets > 0 THEN ' -ignore_editlist 1' ELSE '' END || ' -i in/' || file_id || '.bin'
   || CASE WHEN NOT progressive AND NOT square_pixels THEN ' -vf yadif,scale=trunc(iw*sar/2)*2:trunc(ih/2)*2,setsar=1' WHEN NOT progressive THEN ' -vf yadif' WHEN NOT square_pixels THEN ' -vf scale=trunc(iw*sar/2)*2:trunc(ih/2)*2,setsar=1' ELSE '' END
   || CASE WHEN {rate} > 0 THEN printf(' -r %.6f -fps_mode cfr', {rate}) ELSE '' END || ' -c:v libsvtav1 -preset {preset} -crf {quality} -pix_fmt yuv420p{group}' || {audio} || ' -movflags +faststart out/' || file_id || '.mp4'
  ELSE 'ffmpeg -hide_banner -v error -y' || CASE WHEN {p} = 'remux_timebase' AND timing_source <> 'absent' THEN ' -fflags +genpts' ELSE '' END || ' -i in/' || file_id || '.bin -c copy'
   || CASE WHEN timing_source = 'absent' THEN printf(' -bsf:v setts=ts=N/%.6f/TB', declared_fps) ELSE '' END || ' -movflags +faststart out/' || file_id || '.mp4' END AS argv,
 CASE WHEN {p} IS NOT NULL AND timing_source = 'absent' AND declared_fps <= 0 THEN 'states no frame rate' END AS error,
 CASE WHEN {p} IS NOT NULL AND NOT (timing_source = 'absent' AND declared_fps <= 0) THEN CASE WHEN {p} = 'reencode_av1' THEN 'libsvtav1' ELSE '' END END AS encoder_name,
 CASE WHEN {p} IS NOT NULL THEN {reasons} END AS reasons FROM o"""


_PAIRS = f"""{FACTS}, l AS (SELECT *, o_next AS right_id FROM (SELECT *, {I.PARTNER} AS o_next FROM facts)),
pairs AS (SELECT l.file_id AS left_id, r.file_id AS right_id, l.content_digest AS ld, r.content_digest AS rd, l.timing_source IN ('presentation', 'decode') AND r.timing_source IN ('presentation', 'decode') AND l.duration > 0 AS known,
   l.fps AS lf, r.fps AS rf, l.duration AS ll, r.duration AS rl FROM l JOIN facts r ON r.file_id = l.right_id),
c AS (SELECT *, CASE WHEN ld = '' OR rd = '' THEN 'unminted' WHEN ld <> rd THEN 'distinct' WHEN NOT known THEN 'timing_unknown'
   WHEN abs(lf - rf) <= 4e0 * lf * 0.001e0 / ll AND abs(ll - rl) <= 4e0 * ll * 0.001e0 / ll THEN 'duplicate' ELSE 'different_timing' END AS verdict FROM pairs)"""
_HEADERS = f"h AS ({I.HEADER_JSON}), j AS (SELECT file_id, json::JSON AS j FROM h)"
_STREAMS = """x AS (SELECT file_id, j, unnest(range(json_array_length(j, '$.streams')::BIGINT)) AS n FROM j),
s AS (SELECT file_id, j, n, json_extract(j, '$.streams[' || n || ']') AS s FROM x),
vid AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY n) - 1 AS pos, coalesce((s->>'$.disposition.attached_pic') = '1', false) AS cover FROM s WHERE (s->>'$.codec_type') = 'video'),
sel AS (SELECT *, count(*) OVER (PARTITION BY file_id) AS cnt, row_number() OVER (PARTITION BY file_id ORDER BY pos) AS k FROM vid WHERE NOT cover)"""
_LINES = f"ln AS ({I.PACKET_LINES}), sp AS (SELECT *, string_split(line, ',') AS c FROM ln)"
_SCAN = """scan AS (SELECT file_id, line_no AS decode_order, CASE WHEN c[1] NOT IN ('', 'N/A') THEN c[1]::DOUBLE END AS pts, CASE WHEN c[2] NOT IN ('', 'N/A') THEN c[2]::DOUBLE END AS dts, c[3]::BIGINT AS size,
  CASE WHEN regexp_full_match(c[4], '-*[0-9]+') THEN c[4]::BIGINT ELSE -1 END AS pos, contains(c[5], 'K') AS keyframe, contains(c[5], 'D') AS discard, c[6] AS data_hash FROM sp WHERE len(c) >= 6 AND regexp_full_match(c[3], '[0-9]+'))"""
_DELIVERED = "dl AS (SELECT file_id, row_number() OVER (PARTITION BY file_id ORDER BY decode_order) AS position, time, CASE file_id % 4 WHEN 0 THEN 0e0 WHEN 1 THEN 1e0 / 500 WHEN 2 THEN 1e0 / 3000 ELSE 1e0 / 2000 END AS fps, CASE file_id % 3 WHEN 0 THEN 0e0 WHEN 1 THEN 1.2e0 ELSE 1.4e0 END AS max_gap FROM pa)"
_TARGETS = f"tg AS (SELECT DISTINCT * FROM ({I.TARGETS}))"
_OBS = f"obs AS ({I.OBSERVED.replace('{micros}', D.MICROS['A'][1])})"
_LAND = "land AS (SELECT obs.*, (SELECT min(rank) FROM r WHERE r.file_id = obs.file_id AND r.time >= obs.time - tol AND abs(r.time - obs.time) <= tol) AS rank FROM (SELECT *, CASE WHEN fps > 0 THEN 0.5e0 / fps ELSE 0e0 END AS tol FROM obs) obs)"
_T = _times

_HEADER_PARSE = f"""{_HEADERS}, {_STREAMS}, a AS (SELECT file_id, bool_or((s->>'$.codec_type') = 'audio') AS audio FROM s GROUP BY file_id),
hp AS (SELECT j.file_id, CASE WHEN s IS NOT NULL THEN coalesce(j.j->>'$.format.format_name', '') END AS container, CASE WHEN s IS NOT NULL THEN lower(coalesce(s->>'$.codec_name', '')) END AS codec_name, try_cast(s->>'$.width' AS INT) AS width, CASE WHEN s IS NOT NULL THEN coalesce(s->>'$.sample_aspect_ratio', '') IN ('', 'N/A', '0:1', '1:1') END AS square_pixels,
 CASE WHEN s IS NOT NULL THEN coalesce(s->>'$.field_order', '') IN ('', 'N/A', 'progressive') END AS progressive, CASE WHEN s IS NOT NULL THEN audio END AS has_audio,
 CASE WHEN s IS NOT NULL THEN coalesce(((round_even((s->>'$.side_data_list[0].rotation')::DOUBLE, 0)::INT % 360) + 360) % 360, 0) END AS rotation_degrees, CASE WHEN s IS NOT NULL THEN (string_split(s->>'$.avg_frame_rate', '/')[1])::DOUBLE / (string_split(s->>'$.avg_frame_rate', '/')[2])::DOUBLE END AS declared_fps,
 CASE WHEN s IS NOT NULL THEN coalesce(try_cast(s->>'$.nb_frames' AS BIGINT), 0) END AS declared_frame_count, CASE WHEN s IS NULL THEN 'no video stream' END AS error FROM j LEFT JOIN (SELECT file_id, s FROM sel WHERE k = 1) USING (file_id) LEFT JOIN a USING (file_id))"""
SQL_MOOV = f"WITH b AS ({I.BOXES}), g AS (SELECT file_id, min(CASE WHEN box_type = 'ftyp' THEN ordinal END) AS f, min(CASE WHEN box_type = 'moov' THEN ordinal END) AS m, min(CASE WHEN box_type = 'mdat' THEN ordinal END) AS d FROM b WHERE ordinal < 16 GROUP BY file_id) SELECT file_id, CASE WHEN f = 0 AND m IS NOT NULL THEN coalesce(m < d, true) END AS moov_at_start FROM g"

_PRESET = "CASE preset WHEN 'ultrafast' THEN 13 WHEN 'fast' THEN 9 WHEN 'medium' THEN 8 WHEN 'veryslow' THEN 2 END"
_BYTE = "('0x' || substr(hexed, {} + 1, 2))::INT"
_FRAMES = f"WITH fr AS ({I.FRAMES}), fit AS (SELECT * FROM fr WHERE length(hexed) = 36) "


def _media() -> str:
    """Facts of the files that have a header and packets with times, or none at all."""
    head = _HEADER_PARSE
    timed = "w AS (SELECT *, CASE WHEN count(pts) OVER (PARTITION BY file_id) > 0 THEN 'pts' WHEN count(dts) OVER (PARTITION BY file_id) > 0 THEN 'dts' ELSE 'none' END AS source FROM scan), q AS (SELECT *, CASE source WHEN 'pts' THEN pts WHEN 'dts' THEN dts END AS time FROM w), z AS (SELECT * FROM q WHERE source = 'none' OR time IS NOT NULL)"
    return f"""WITH {head}, {_LINES}, {_SCAN}, {timed}, {_times('z')}, {_LEAD}, {_GOP.format(p='z')},
 u AS (SELECT file_id, count(*) AS packets, count(*) FILTER (discard) AS dis, count(*) FILTER (gop = 0) AS n, max(gop) AS m FROM g GROUP BY file_id), so AS (SELECT file_id, min(source) AS source FROM z GROUP BY file_id), mv AS ({SQL_MOOV})
SELECT file_id, container, codec_name, width, rotation_degrees, square_pixels, progressive, has_audio, declared_frame_count, CASE WHEN source = 'none' THEN 0e0 ELSE declared_fps END AS declared_fps,
 CASE WHEN source = 'none' THEN 'absent' WHEN source = 'pts' THEN 'presentation' ELSE 'decode' END AS timing_source,
 CASE WHEN source = 'none' THEN 0e0 ELSE duration END AS duration, CASE WHEN source = 'none' THEN 0e0 ELSE fps END AS fps, CASE WHEN source = 'none' THEN packets ELSE frame_count END AS frame_count,
 CASE WHEN source = 'none' THEN false ELSE max_drift < 0.5e0 END AS constant_frame_rate, CASE WHEN source <> 'none' AND max_drift >= 0.5e0 THEN 1e0 / least END AS max_instantaneous_fps,
 CASE WHEN source = 'none' THEN 0e0 ELSE max_gap END AS max_timestamp_gap_frame_periods, max_keyframe_interval_frames, max_gop_bytes, dis AS discard_flagged_packets,
 CASE WHEN source = 'none' THEN CASE WHEN m > 0 THEN n ELSE 0 END ELSE coalesce(timed, 0) END AS leading_non_keyframe_frames, moov_at_start, '' AS pixel_format, 'unknown' AS color_range, 0 AS coded_reordering_depth, '2' AS identity_scheme
FROM hp JOIN so USING (file_id) JOIN u USING (file_id) JOIN gop USING (file_id) LEFT JOIN fit USING (file_id) LEFT JOIN lead_t USING (file_id) LEFT JOIN mv USING (file_id)
WHERE hp.error IS NULL AND (source = 'none' OR frame_count > 1)"""

_MEDIA = _media()

SQL = {
    "timing_fit": f"WITH {PB}, {_T('pb')} SELECT file_id, frame_count, fps, duration FROM fit",
    "frame_drift": f"WITH {PB}, {_T('pb')} SELECT file_id, max_drift, max_drift < 0.5 AS constant_frame_rate FROM fit",
    "timestamp_gap": f"WITH {PB}, {_T('pb')} SELECT file_id, max_gap FROM fit",
    "instantaneous_fps": f"WITH {PA}, {_T('pa')} SELECT file_id, CASE WHEN NOT max_drift < 0.5 THEN 1e0 / least END AS max_instantaneous_fps FROM fit",
    "gop_stats": f"WITH {PB}, {_GOP.format(p='pb')} SELECT * FROM gop",
    "discard_count": f"WITH {PB} SELECT file_id, count(*) FILTER (discard) AS discard_flagged_packets FROM pb GROUP BY file_id",
    "leading_frames": f"WITH {PB}, {_T('pb')}, {_LEAD}, {_GOP.format(p='pb')}, u AS (SELECT file_id, count(*) FILTER (gop = 0) AS n, max(gop) AS m FROM g GROUP BY file_id) SELECT file_id, CASE WHEN file_id % 5 = 0 THEN CASE WHEN m > 0 THEN n ELSE 0 END ELSE timed END AS leading_non_keyframe_frames FROM u JOIN lead_t USING (file_id)",
    "untimed_facts": f"""WITH {PB}, {_T('pb')}, {_LEAD}, {_GOP.format(p='pb')}, u AS (SELECT file_id, count(*) AS packets, count(*) FILTER (discard) AS dis, count(*) FILTER (gop = 0) AS n, max(gop) AS m FROM g GROUP BY file_id)
SELECT file_id, CASE WHEN z THEN 0e0 ELSE duration END AS duration, CASE WHEN z THEN 0e0 ELSE fps END AS fps, CASE WHEN z THEN packets ELSE frame_count END AS frame_count, CASE WHEN z THEN false ELSE max_drift < 0.5 END AS constant_frame_rate,
 CASE WHEN NOT z AND NOT max_drift < 0.5 THEN 1e0 / least END AS max_instantaneous_fps, CASE WHEN z THEN 0e0 ELSE max_gap END AS max_timestamp_gap_frame_periods, max_keyframe_interval_frames, max_gop_bytes, dis AS discard_flagged_packets,
 CASE WHEN z THEN CASE WHEN m > 0 THEN n ELSE 0 END ELSE timed END AS leading_non_keyframe_frames, NULL::VARCHAR AS error
FROM (SELECT *, file_id % 5 = 0 AS z FROM u JOIN fit USING (file_id) JOIN gop USING (file_id) JOIN lead_t USING (file_id))""",
    "probe_facts": f"""WITH {PA}, {_T('pa')}, {_LEAD}, {_GOP.format(p='pa')}, u AS (SELECT file_id, count(*) FILTER (discard) AS dis FROM pa GROUP BY file_id)
SELECT file_id, duration, fps, frame_count, max_drift < 0.5 AS constant_frame_rate, CASE WHEN NOT max_drift < 0.5 THEN 1e0 / least END AS max_instantaneous_fps, max_gap AS max_timestamp_gap_frame_periods, max_keyframe_interval_frames, max_gop_bytes,
 dis AS discard_flagged_packets, timed AS leading_non_keyframe_frames, NULL::VARCHAR AS error FROM fit JOIN gop USING (file_id) JOIN lead_t USING (file_id) JOIN u USING (file_id)""",
    "content_digest_md5": f"WITH {PA} SELECT file_id, md5(string_agg(concat_ws(':', size, keyframe::VARCHAR, data_hash), '|' ORDER BY decode_order)) AS content_digest FROM pa GROUP BY file_id",
    "canonical_fps": f"WITH {SEG} SELECT sequence_id, round(sum(frame_count) / sum(duration), 6) AS fps FROM seg GROUP BY sequence_id",
    "sequence_uniformity": f"""WITH {SEG}, n AS (SELECT *, row_number() OVER (PARTITION BY sequence_id ORDER BY ordinal) AS k FROM seg), b AS (SELECT a.sequence_id, a.ordinal, CASE WHEN a.width <> h.width THEN 'width' WHEN a.height <> h.height THEN 'height'
 WHEN a.fps <= 0 OR h.fps <= 0 THEN 'fps' WHEN abs(a.fps - h.fps) / h.fps * least(a.frame_count, h.frame_count) >= 0.5 THEN 'fps' END AS field, h.width AS hw, h.height AS hh, h.fps AS hf, a.width AS w, a.height AS hgt, a.fps AS f
 FROM n a JOIN n h ON h.sequence_id = a.sequence_id AND h.k = 1 WHERE a.k > 1), first AS (SELECT * FROM b WHERE field IS NOT NULL QUALIFY row_number() OVER (PARTITION BY sequence_id ORDER BY ordinal) = 1)
SELECT s.sequence_id, ordinal, field, (CASE field WHEN 'width' THEN hw WHEN 'height' THEN hh ELSE hf END)::DOUBLE AS first, (CASE field WHEN 'width' THEN w WHEN 'height' THEN hgt ELSE f END)::DOUBLE AS other FROM (SELECT DISTINCT sequence_id FROM seg) s LEFT JOIN first USING (sequence_id)""",
    "presentation_rank": f"WITH {PB}, {_T('pb')} SELECT file_id, time, rank FROM r",
    "seek_index": f"WITH {PB}, {_T('pb')} SELECT file_id, rank, time, is_keyframe FROM r",
    "preceding_keyframe": f"WITH {PB}, {_T('pb')}, {_INDEX} SELECT file_id, rank, time, is_keyframe, keyframe_rank, keyframe_time FROM pk",
    "group_by_gop": f"WITH {PB}, {_T('pb')}, {_INDEX}, {_TARGETS} SELECT file_id, keyframe_rank, string_agg(rank::VARCHAR, ',' ORDER BY rank) AS targets FROM pk JOIN tg USING (file_id, rank) GROUP BY ALL",
    "asof_keyframe": f"WITH {PA}, {_T('pa')}, kf AS (SELECT file_id, time, rank FROM r WHERE is_keyframe), a AS (SELECT file_id, time + 30e0 AS target_time FROM pa WHERE discard) SELECT a.file_id, a.target_time, kf.rank AS keyframe_rank, kf.time AS keyframe_time FROM a ASOF LEFT JOIN kf ON kf.file_id = a.file_id AND kf.time <= a.target_time",
    "segment_starts": f"WITH {STARTS} SELECT sequence_id, ordinal, frame_count, start_frame FROM st",
    "segment_for_frame": f"WITH {STARTS}, tg AS ({I.GLOBAL_TARGETS}) SELECT tg.sequence_id, global_frame, ordinal, global_frame - start_frame AS local_frame, CASE WHEN ordinal IS NULL THEN 'out of range' ELSE 'ok' END AS status FROM tg LEFT JOIN st ON st.sequence_id = tg.sequence_id AND global_frame >= start_frame AND global_frame < start_frame + frame_count",
    "multi_frame_space": f"WITH {STARTS}, b AS (SELECT sequence_id, ordinal, start_frame, start_frame + frame_count AS end_frame, sum(frame_count) OVER (PARTITION BY sequence_id)::BIGINT AS total_frames FROM st) SELECT * FROM b",
    "junction_read": f"WITH {STARTS}, tg AS (SELECT sequence_id, start_frame - 1 AS global_frame FROM st WHERE start_frame > 0 UNION SELECT sequence_id, start_frame FROM st WHERE start_frame > 0) SELECT tg.sequence_id, global_frame, ordinal, global_frame - start_frame AS local_frame, 'ok' AS status FROM tg JOIN st ON st.sequence_id = tg.sequence_id AND global_frame >= start_frame AND global_frame < start_frame + frame_count",
    "decode_gap_check": f"WITH {PA}, {_DELIVERED}, p AS (SELECT *, lag(time) OVER (PARTITION BY file_id ORDER BY position) AS previous FROM dl) SELECT file_id, position, CASE WHEN fps <= 0 THEN 'unchecked' WHEN previous IS NULL THEN 'first' WHEN time = previous THEN 'collapsed' WHEN max_gap <= 0 OR max_gap + 0.5 >= 2 THEN 'unchecked' WHEN (time - previous) * fps > max_gap + 0.5 THEN 'missing' ELSE 'ok' END AS status FROM p",
    "delivery_shortfall": f"WITH {FACTS} SELECT file_id, greatest(0, len(range(2, frame_count, 3)) - (frame_count // 3 - file_id % 3))::BIGINT AS shortfall FROM facts",
    "landing_rank": f"WITH {PA}, {_T('pa')}, {_OBS}, {_LAND} SELECT file_id, obs_id, rank FROM land",
    "seek_landing": f"WITH {PA}, {_T('pa')}, {_OBS}, {_LAND} SELECT file_id, obs_id, rank, CASE WHEN fps > 0 AND time > keyframe_time + tol THEN 'late' WHEN rank IS NULL THEN 'unindexed' ELSE 'ok' END AS status FROM land",
    "verify_delivery": f"WITH {PA}, {_T('pa')}, {_DELIVERED} SELECT dl.file_id, dl.position - 1 AS rank, CASE WHEN dl.fps <= 0 OR r.time IS NULL THEN 'skipped' WHEN abs(dl.time + (dl.file_id % 3) * 100 - r.time) <= 0.5e0 / dl.fps THEN 'ok' ELSE 'wrong frame' END AS status FROM dl LEFT JOIN r ON r.file_id = dl.file_id AND r.rank = dl.position - 1",
    "frame_window": f"WITH {PB}, {_T('pb')} SELECT file_id, rank, time FROM r WHERE rank >= 10 AND rank < 40",
    "strided_read": f"WITH {PB}, {_T('pb')} SELECT file_id, rank, time FROM r WHERE rank >= 5 AND rank < 200 AND (rank - 5) % 7 = 0",
    "read_batch": f"WITH {PB}, {_T('pb')} SELECT file_id, rank // 32 AS batch, min(rank) AS first_rank, max(rank) AS last_rank, count(*) AS frames FROM r GROUP BY ALL",
    "sparse_read": f"WITH {PB}, {_T('pb')}, {_INDEX}, {_TARGETS} SELECT file_id, rank, time, keyframe_rank FROM pk JOIN tg USING (file_id, rank)",
    "seek_point": f"WITH {FACTS} SELECT file_id, CASE WHEN file_id % 3000 >= 5 AND file_id % 3000 < least(2500, frame_count) THEN 'ok' ELSE 'out of range' END AS status FROM facts",
    "derive_verdict": f"WITH {VERDICT} SELECT file_id, NOT hard AS playable, stream_transcode, analysis_transcode, s_reasons AS stream_reasons, a_reasons AS analysis_reasons, truncated FROM d",
    "metadata_lies": f"WITH {FACTS} SELECT file_id, {_LIES} AS lies FROM facts",
    "truncation": f"WITH {FACTS} SELECT file_id, {_TRUNC} AS truncated FROM facts",
    "minimum_operation": f"WITH {VERDICT} SELECT file_id, a_least AS analysis, s_least AS playback FROM m",
    "select_operation": f"WITH {VERDICT} SELECT file_id, a_op AS analysis, s_op AS playback FROM o",
    "build_command": f"WITH {VERDICT} " + _command("a_op", 14, 6, "", "' -an'", "a_reasons"),
    "build_command_playback": f"WITH {VERDICT} " + _command("s_op", 26, 8, " -g 50", "CASE WHEN has_audio THEN ' -c:a aac' ELSE ' -an' END", "s_reasons"),
    "select_encoder": f"WITH {FACTS} SELECT file_id, CASE WHEN file_id % 2 = 0 AND has_audio THEN 'av1_nvenc' ELSE 'libsvtav1' END AS encoder FROM facts",
    "resolve_output": f"WITH p AS ({I.OUTPUTS}), t AS (SELECT *, CASE WHEN is_dir THEN output || '/' || regexp_replace(string_split(source, '/')[-1], '\\.[^.]+$', '') || '.mp4' ELSE output END AS destination FROM p) SELECT file_id, destination, CASE WHEN NOT ends_with(lower(destination), '.mp4') THEN 'not an mp4' WHEN destination = source THEN 'would overwrite the source' END AS error FROM t",
    "acceptance_gate": f"WITH {VERDICT} SELECT file_id, CASE WHEN a_reasons <> '' THEN 'still needs an analysis transcode: ' || a_reasons END AS analysis_error, CASE WHEN hard THEN 'still cannot play: ' || s_reasons END AS playback_error, NOT hard AND s_reasons <> '' AS residual_recommended FROM d",
    "recovery_options": f"WITH {FACTS}, s AS (SELECT *, CASE WHEN discard_flagged_packets > 0 THEN 'edit_list_ignored' ELSE 'container_default' END AS space, CASE file_id % 4 WHEN 0 THEN 'container_default' WHEN 1 THEN 'edit_list_ignored' WHEN 2 THEN 'container_default' END AS given, CASE WHEN file_id % 4 = 2 THEN 'ffprobe' ELSE 'in_process' END AS src FROM facts) SELECT file_id, space, CASE WHEN given IS NOT NULL AND (given <> space OR src <> 'in_process') THEN 'index of another space' END AS error FROM s",
    "output_geometry": f"WITH {FACTS}, g AS (SELECT *, file_id % 5 = 0 AS rz, rotation_degrees IN (90, 270) AS turned FROM facts) SELECT file_id, CASE WHEN rz THEN 64 WHEN turned THEN height ELSE width END AS out_width, CASE WHEN rz THEN 48 WHEN turned THEN width ELSE height END AS out_height, CASE WHEN rotation_degrees NOT IN (0, 90, 180, 270) THEN 'unsupported rotation' END AS error FROM g",
    "duplicate_compare": f"WITH {_PAIRS} SELECT left_id, right_id, verdict, CASE WHEN verdict IN ('duplicate', 'different_timing') THEN abs(lf - rf) END AS fps_delta, CASE WHEN verdict IN ('duplicate', 'different_timing') THEN 4e0 * lf * 0.001e0 / ll END AS fps_tolerance, CASE WHEN verdict IN ('duplicate', 'different_timing') THEN abs(ll - rl) END AS duration_delta, CASE WHEN verdict IN ('duplicate', 'different_timing') THEN 4e0 * ll * 0.001e0 / ll END AS duration_tolerance FROM c",
    "exit_code": f"WITH {_PAIRS} SELECT left_id, right_id, CASE verdict WHEN 'duplicate' THEN 0 WHEN 'distinct' THEN 3 WHEN 'different_timing' THEN 4 WHEN 'timing_unknown' THEN 5 ELSE 6 END AS code FROM c",
    "duplicate_facts": f"""WITH {FACTS}, a AS (SELECT *, first_value(file_id) OVER w AS l_id, first_value(timing_source) OVER w AS l_src, first_value(fps) OVER w AS lf, first_value(duration) OVER w AS ll FROM facts WHERE content_digest <> '' WINDOW w AS (PARTITION BY content_digest ORDER BY file_id))
SELECT l_id AS left_file_id, file_id AS right_file_id, CASE WHEN l_src NOT IN ('presentation', 'decode') OR timing_source NOT IN ('presentation', 'decode') OR ll <= 0 THEN 'timing_unknown' WHEN abs(lf - fps) <= 4e0 * lf * 0.001e0 / ll AND abs(ll - duration) <= 4e0 * ll * 0.001e0 / ll THEN 'duplicate' ELSE 'different_timing' END AS verdict FROM a WHERE file_id <> l_id""",
    "duplicate_groups": "SELECT conv_id * 1000 + turn AS id, md5(role) AS digest, f AS first_id, n AS copies FROM (SELECT *, min(conv_id * 1000 + turn) OVER (PARTITION BY role) AS f, count(*) OVER (PARTITION BY role) AS n FROM conversations) WHERE n > 1 AND conv_id * 1000 + turn <> f",
    "parse_fraction": f"WITH x AS ({I.FRACTIONS}) SELECT id, CASE WHEN v IN ('', 'N/A') OR string_split(v, '/')[1] IN ('', 'N/A') THEN 0e0 WHEN NOT contains(v, '/') THEN v::DOUBLE WHEN string_split(v, '/')[2]::DOUBLE = 0 THEN 0e0 ELSE string_split(v, '/')[1]::DOUBLE / string_split(v, '/')[2]::DOUBLE END AS value FROM x",
    "elementary_fps": f"WITH x AS ({I.RATES}), y AS (SELECT *, num::DOUBLE / den / CASE WHEN container = 'h264' AND codec = 'h264' THEN 2 WHEN container = 'hevc' AND codec = 'hevc' THEN 1 END AS f FROM x) SELECT id, CASE WHEN f > 0 AND f <= 1000 THEN f ELSE 0e0 END AS fps FROM y",
    "timing_source": f"WITH x AS ({I.SOURCES}), y AS (SELECT *, CASE WHEN src = 'none' THEN 'absent' WHEN container IN {_in(policy.INVENTED_TIMING_CONTAINERS)} THEN 'synthesized' WHEN src = 'pts' THEN 'presentation' ELSE 'decode' END AS s FROM x) SELECT id, s AS timing_source, s IN ('presentation', 'decode') AS supplied FROM y",
    "rotation_normalize": f"WITH x AS ({I.ANGLES}) SELECT id, ((round_even(angle, 0)::INT % 360) + 360) % 360 AS rotation_degrees FROM x",
    "displayed_dims": f"WITH {FACTS} SELECT file_id, CASE WHEN rotation_degrees % 180 = 90 THEN height ELSE width END AS width, CASE WHEN rotation_degrees % 180 = 90 THEN width ELSE height END AS height FROM facts",
    "thumbnail_dims": "WITH d AS (SELECT p_partkey AS id, (p_size * 37 + 1)::INT AS w, floor(p_retailprice)::INT AS h FROM part), l AS (SELECT *, greatest(w, h) AS m FROM d) SELECT id, (CASE WHEN m <= 320 THEN w ELSE greatest(1, round_even(w * (320e0 / m), 0)::INT) END)::INT AS width, (CASE WHEN m <= 320 THEN h ELSE greatest(1, round_even(h * (320e0 / m), 0)::INT) END)::INT AS height FROM l",
    "timing_tolerance": f"WITH {FACTS} SELECT file_id, CASE WHEN duration > 0 THEN 4e0 * fps * 0.001e0 / duration END AS fps_tolerance, CASE WHEN duration > 0 THEN 4e0 * duration * 0.001e0 / duration END AS duration_tolerance FROM facts",
    "measured_or_none": f"WITH {FACTS} SELECT file_id, CASE WHEN moov_at_start IS NOT NULL AND max_instantaneous_fps IS NOT NULL THEN fps END AS fps, CASE WHEN moov_at_start IS NOT NULL AND max_instantaneous_fps IS NOT NULL THEN width END AS width FROM facts",
    "progress_parse": f"WITH x AS ({I.PROGRESS_FIELDS}), y AS (SELECT *, try_cast(regexp_replace(trim(us), 'x$', '') AS DOUBLE) / 1e6 AS u, CASE WHEN len(string_split(ck, ':')) = 3 THEN try_cast(string_split(ck, ':')[1] AS INT) * 3600 + try_cast(string_split(ck, ':')[2] AS INT) * 60 + try_cast(string_split(ck, ':')[3] AS DOUBLE) END AS c, try_cast(regexp_replace(trim(sp), 'x$', '') AS DOUBLE) AS s FROM x) SELECT id, coalesce(u, c) AS out_time, s AS speed, CASE WHEN d > 0 THEN coalesce(u, c) / d END AS fraction FROM y",
    "quality_map": f"WITH x AS ({I.QUALITY}) SELECT id, least(63, greatest(0, crf + 7)) AS av1_crf, {_PRESET} AS av1_preset FROM x",
    "quality_errors": f"WITH x AS ({I.QUALITY}), y AS (SELECT id, CASE WHEN id % 3 > 0 THEN crf END AS crf, CASE WHEN id % 4 > 0 THEN preset END AS preset, own, CASE WHEN id % 11 = 0 THEN 5 ELSE 8 END AS ownp FROM x), e AS (SELECT *, CASE WHEN (crf IS NOT NULL AND own <> 30) OR (preset IS NOT NULL AND ownp <> 8) THEN 'both scales' WHEN preset = 'odd' THEN 'unknown preset' END AS error FROM y) SELECT id, CASE WHEN error IS NULL THEN coalesce(least(63, greatest(0, crf + 7)), own) END AS av1_crf, CASE WHEN error IS NULL THEN coalesce({_PRESET}, ownp) END AS av1_preset, error FROM e",
    "stream_offset": f"WITH {PA} SELECT file_id, decode_order, round_even((time - 1704067200e0) / (1e0 / 90000), 0)::BIGINT AS \"offset\" FROM pa",
    "candidate_filter": f"WITH x AS ({I.PATHS}) SELECT id, path, regexp_matches(lower(path), '[^/]\\.({'|'.join(x[1:] for x in policy.VIDEO_SUFFIXES)})$') AS candidate FROM x",
    "moov_order": SQL_MOOV,
    "packet_scan": f"WITH {_LINES}, {_SCAN} SELECT * FROM scan",
    "timestamp_source": f"WITH {_LINES}, {_SCAN}, w AS (SELECT *, CASE WHEN count(pts) OVER (PARTITION BY file_id) > 0 THEN 'pts' WHEN count(dts) OVER (PARTITION BY file_id) > 0 THEN 'dts' ELSE 'none' END AS source FROM scan), z AS (SELECT file_id, decode_order, source, CASE source WHEN 'pts' THEN pts WHEN 'dts' THEN dts ELSE 0e0 END AS time FROM w) SELECT * FROM z WHERE time IS NOT NULL",
    "scan_errors": f"WITH {_LINES} SELECT file_id, CASE WHEN count(*) FILTER (len(c) >= 6 AND regexp_full_match(c[3], '[0-9]+')) > 0 THEN NULL WHEN count(*) FILTER (len(c) = 5) > 0 THEN 'no payload hashes' ELSE 'no packets' END AS error FROM sp GROUP BY file_id",
    "stream_select": f"WITH {_HEADERS}, {_STREAMS} SELECT j.file_id, pos::INT AS video_position, coalesce(cnt, 0)::INT AS video_stream_count FROM j LEFT JOIN (SELECT * FROM sel WHERE k = 1) s USING (file_id)",
    "header_parse": f"WITH {_HEADER_PARSE} SELECT * FROM hp",
    "progress_blocks": f"""WITH ln AS ({I.PROGRESS_LINES}), kv AS (SELECT *, string_split(line, '=')[1] AS k, string_split(line, '=')[2] AS v FROM ln WHERE contains(line, '=')),
b AS (SELECT *, coalesce(sum((k = 'progress')::INT) OVER w, 0)::BIGINT AS block, coalesce(max((k = 'progress' AND v = 'end')::INT) OVER w, 0) AS over_ FROM kv WINDOW w AS (PARTITION BY run_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
g AS (SELECT run_id, block, max(duration) AS d, max(k = 'progress') AS closed, max(CASE WHEN k = 'out_time_us' THEN try_cast(v AS DOUBLE) END) AS us, max(CASE WHEN k = 'fps' THEN try_cast(v AS DOUBLE) END) AS fps, max(CASE WHEN k = 'speed' THEN try_cast(regexp_replace(v, 'x$', '') AS DOUBLE) END) AS speed FROM b WHERE over_ = 0 GROUP BY ALL)
SELECT run_id, block, us / 1e6 AS out_time, fps, speed, CASE WHEN d > 0 THEN us / 1e6 / d END AS fraction FROM g WHERE closed""",
    "gop_stream": f"WITH {PA}, {_GOP.format(p='pa')} SELECT * FROM gop",
    "media_facts": _MEDIA,
    "grey_raw": _FRAMES + f"SELECT file_id, frame_index, height, width, 1 AS channels, upper(array_to_string(list_transform(range(6), lambda k: lpad(to_hex((114 * {_BYTE.format('6 * k')} + 587 * {_BYTE.format('6 * k + 2')} + 299 * {_BYTE.format('6 * k + 4')} + 500) // 1000), 2, '0')), '')) AS data FROM fit",
    "first_frames": _FRAMES + "SELECT file_id, min(frame_index) AS frame_index, upper(min_by(hexed, frame_index)) AS data FROM fit GROUP BY file_id",
    "frame_batches": _FRAMES + ", n AS (SELECT *, (row_number() OVER (PARTITION BY file_id ORDER BY frame_index) - 1) // 16 AS batch FROM fit) SELECT file_id, batch, count(*) AS frames, string_agg(frame_index::VARCHAR, ',' ORDER BY frame_index) AS indices, upper(string_agg(hexed, '' ORDER BY frame_index)) AS data FROM n GROUP BY ALL",
    "rotate_raw": f"""WITH {FACTS}, f AS (SELECT file_id, rotation_degrees // 90 AS q, substr(md5(file_id::VARCHAR), 1, 12) AS d FROM facts WHERE rotation_degrees % 90 = 0)
SELECT file_id, 0::BIGINT AS frame_index, CASE WHEN q % 2 = 1 THEN 4 ELSE 3 END AS height, CASE WHEN q % 2 = 1 THEN 3 ELSE 4 END AS width, 1 AS channels,
 hex(array_to_string(list_transform(range(12), lambda k: d[(CASE q WHEN 0 THEN k WHEN 1 THEN (2 - k % 3) * 4 + k // 3 WHEN 2 THEN 11 - k ELSE (k % 3) * 4 + 3 - k // 3 END + 1)::INT]), '')) AS data FROM f""",
    "writer_counts": _FRAMES + ", b AS (SELECT file_id, min(frame_index) FILTER (length(hexed) <> 36) AS first_refused FROM fr GROUP BY file_id) SELECT fr.file_id, count(*) FILTER (first_refused IS NULL OR frame_index < first_refused) AS frames_written, max(first_refused) AS first_refused FROM fr JOIN b USING (file_id) GROUP BY fr.file_id",
    "zipped_sequences": f"WITH {SEG}, p AS ({I.ZIPPED}), f AS (SELECT sequence_id, ordinal, frame_count FROM seg WHERE sequence_id % 3 > 0 OR ordinal % 5 > 0), n AS (SELECT sequence_id, count(*) AS n FROM p GROUP BY ALL), m AS (SELECT sequence_id, count(*) AS m FROM f GROUP BY ALL), e AS (SELECT sequence_id, CASE WHEN n <> coalesce(m, 0) THEN coalesce(m, 0) || ' facts for ' || n || ' paths' END AS error FROM n LEFT JOIN m USING (sequence_id)) SELECT p.sequence_id, p.ordinal, path, error, CASE WHEN error IS NULL THEN frame_count END AS frame_count FROM p JOIN e USING (sequence_id) LEFT JOIN f ON f.sequence_id = p.sequence_id AND f.ordinal = p.ordinal",
    "encoder_listed": f"WITH ln AS ({I.ENCODER_LINES}), n AS (SELECT unnest(['av1', 'av1_nvenc', 'libsvtav1', 'h264_nvenc', 'encoder3']) AS name) SELECT name, EXISTS (SELECT 1 FROM ln WHERE regexp_split_to_array(trim(line), '\\s+')[2] = name) AS listed FROM n",
}

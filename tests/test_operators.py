"""The cases of FIXTURES.md, and random packets against plain Python."""

import hashlib
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from reelspark import frames as raw_frames
from reelspark import policy
from reelspark.operators import delivery, facts, gop, identity, index, planner, sequence, timing, verdict
from reelspark.sources import probe_text

PACKET = "file_id long, decode_order long, time double, size long, keyframe boolean, discard boolean, data_hash string"


def packets(spark, *files):
    """files: lists of (time, size, keyframe)."""
    return spark.createDataFrame([(f, i, t, n, k, False, "MD5:00") for f, rows in enumerate(files) for i, (t, n, k) in enumerate(rows)], PACKET)


def at(times):
    return [(float(t), 10, i == 0) for i, t in enumerate(times)]


def test_timing_cases(spark):
    grid = [i / 25 for i in range(250)]
    ms = [round(i / 29.97, 3) for i in range(450)]
    dropped = [i / 30 + (i > 50) * 3 / 30 for i in range(100)]
    twice = [0.0] + [i / 25 for i in range(100)]
    jitter = [i / 30 for i in range(99)] + [98 / 30 + 1.2 / 30]
    crammed = [0.0] + [2 + i / 1000 for i in range(98)] + [4.0]
    got = {r.file_id: r for r in timing.timing(packets(spark, *map(at, (grid, ms, dropped, twice, grid[::-1], jitter, crammed, [1.0])))).collect()}
    assert got[0].constant_frame_rate and got[0].fps == pytest.approx(25) and got[0].duration == pytest.approx(10) and got[0].max_instantaneous_fps is None
    assert got[1].constant_frame_rate
    assert not got[2].constant_frame_rate and got[2].max_instantaneous_fps is not None
    assert got[3].frame_count == 100
    assert got[4].fps == got[0].fps
    assert got[5].constant_frame_rate
    assert got[6].max_drift > 10
    assert got[7].error and got[7].fps is None and got[7].frame_count == 1


def test_gop_cases(spark):
    worst = [(0.0, 5000, True), (0.1, 5, False), (0.2, 5, False), (0.3, 10, True), (0.4, 10, False)]
    none = [(i / 10, 100, False) for i in range(10)]
    mixed = [(0.0, 100, True), (0.2, 9000, True), (0.1, 100, False), (0.3, 50, True)]
    late = [(0.0, 1, False), (0.1, 1, False), (0.2, 1, True)]
    p = packets(spark, worst, none, mixed, late)
    got = {r.file_id: (r.max_gop_bytes, r.max_keyframe_interval_frames) for r in gop.gop_stats(p).collect()}
    assert got == {0: (5010, 3), 1: (1000, 10), 2: (9100, 2), 3: (2, 2)}
    lead = {r.file_id: r.leading_non_keyframe_frames for r in gop.leading_frames(p).collect()}
    assert lead == {0: 0, 1: 0, 2: 0, 3: 2}
    m = {r.file_id: r for r in facts.measure(p, sources=spark.createDataFrame([(i, "none") for i in range(4)], "file_id long, source string")).collect()}
    assert m[3].leading_non_keyframe_frames == 2 and m[3].fps == 0 and m[3].frame_count == 3 and not m[3].constant_frame_rate
    assert facts.measure(p.limit(0)).count() == 0


def test_index_cases(spark):
    p = packets(spark, [(0.0, 1, True), (0.2, 1, False), (0.1, 1, True), (0.3, 1, False)], [(i / 10, 1, i % 12 == 0) for i in range(40)])
    rows = index.seek_index(p)
    assert sorted(r["rank"] for r in rows.where("file_id = 0 AND is_keyframe").collect()) == [0, 1]
    got = {r["rank"]: r.keyframe_rank for r in index.preceding_keyframe(rows).where("file_id = 1").collect()}
    assert (got[15], got[24], got[5]) == (12, 24, 0)
    targets = spark.createDataFrame([(1, 15), (1, 13), (1, 15), (1, 30), (1, 99)], "file_id long, rank long")
    assert {r.keyframe_rank: r.targets for r in index.group_by_gop(rows, targets).collect()} == {12: [13, 15], 24: [30]}


CLEAN = dict(
    file_id=1, container="matroska,webm", codec_name="h264", pixel_format="yuv420p", duration=10.0, fps=25.0, frame_count=250, start_time=0.0, constant_frame_rate=True, declared_duration=10.0, declared_fps=25.0, declared_frame_count=250, moov_at_start=None, rotation_degrees=0,
    square_pixels=True, progressive=True, max_keyframe_interval_frames=50, max_gop_bytes=1000, discard_flagged_packets=0, leading_non_keyframe_frames=0, coded_reordering_depth=0, timing_source="presentation", has_audio=False, source="a.mkv", destination="a.mp4",
)
_TYPES = {str: "string", float: "double", int: "long", bool: "boolean", type(None): "boolean"}


def derived(spark, *overrides):
    rows = [{**CLEAN, "file_id": i, **o} for i, o in enumerate(overrides)]
    schema = ", ".join(f"{k} {_TYPES[type(v)]}" for k, v in CLEAN.items())
    return verdict.derive(spark.createDataFrame([tuple(r.values()) for r in rows], schema))


def test_verdict_cases(spark):
    cases = [
        ({}, [], []),
        ({"container": "avi"}, ["unsupported_container"], []),
        ({"codec_name": "mpeg4"}, ["unsupported_codec"], ["unverified_frame_correspondence"]),
        ({"codec_name": "hevc"}, ["client_dependent_decode"], []),
        ({"declared_frame_count": 9603, "frame_count": 9070}, [], ["unreliable_timing_metadata"]),
        ({"duration": 5.04}, [], []),
        ({"start_time": -0.007, "fps": 30.0, "declared_fps": 30.0}, [], []),
        ({"start_time": 0.5}, ["non_zero_start_time"], []),
        ({"moov_at_start": False}, ["moov_not_at_start"], []),
        ({"timing_source": "absent", "constant_frame_rate": False, "coded_reordering_depth": 2}, ["presentation_timing_requires_decode"], ["presentation_timing_requires_decode", "unreliable_timing_metadata"]),
        ({"max_gop_bytes": 600000, "max_keyframe_interval_frames": 201}, ["large_seek_payload", "sparse_keyframes"], []),
    ]
    got = {r.file_id: r for r in derived(spark, *[c[0] for c in cases]).collect()}
    for i, (_, stream, analysis) in enumerate(cases):
        assert (got[i].stream_reasons, got[i].analysis_reasons) == (stream, analysis), i
    assert got[5].truncated and got[0].playable and got[3].playable and got[3].stream_transcode == "recommended" and not got[1].playable


def test_commands(spark):
    v = derived(spark, {}, {"declared_fps": 30.0}, {"timing_source": "absent", "declared_fps": 0.0}, {"progressive": False, "square_pixels": False, "discard_flagged_packets": 1}, {"declared_fps": 30.0, "leading_non_keyframe_frames": 1})
    got = {r.file_id: r for r in planner.build_command(v, "analysis", policy.ANALYSIS).collect()}
    assert got[0].argv is None and got[0].operation is None
    assert " ".join(got[1].argv) == "ffmpeg -hide_banner -v error -y -fflags +genpts -i a.mkv -c copy -movflags +faststart a.mp4"
    assert got[2].argv is None and got[2].error
    assert "-ignore_editlist 1 -i a.mkv -vf yadif,scale=trunc(iw*sar/2)*2:trunc(ih/2)*2,setsar=1 -r 25.000000 -fps_mode cfr -c:v libsvtav1 -preset 6 -crf 14 -pix_fmt yuv420p -an" in " ".join(got[3].argv)
    assert got[4].operation == "reencode_av1"


def test_policy_of_the_callers_own(spark):
    v = derived(spark, {}, {"codec_name": "theora"}).drop("stream_reasons", "analysis_reasons")
    own = policy.PlaybackProfile(containers=("ogg",), codecs=("theora",), baseline_pixel_formats=())
    limits = policy.Thresholds(max_gop_bytes=999, max_keyframe_interval_frames=49, frame_exact_codecs=("theora",))
    got = {r.file_id: r for r in verdict.derive(v, own, limits).collect()}
    assert got[0].stream_reasons == ["client_dependent_decode", "large_seek_payload", "sparse_keyframes", "unsupported_codec", "unsupported_container"]
    assert got[0].analysis_reasons == ["unverified_frame_correspondence"] and got[1].analysis_reasons == [] and "unsupported_codec" not in got[1].stream_reasons
    assert policy.THRESHOLDS.max_gop_bytes == 524288 and policy.PLAYBACK.keyframe_interval == 50 and policy.ANALYSIS.encoder is None


def test_encoders(spark):
    from pyspark.sql import functions as F

    v = derived(spark, {"progressive": False})
    argv = lambda e, *more: " ".join(planner.build_command(v, "playback", e, *more).first().argv)
    assert "-c:v av1_nvenc -preset p5 -cq 26 -pix_fmt yuv420p -g 50" in argv(policy.PLAYBACK, True, F.lit(True))
    assert "-c:v libsvtav1" in argv(policy.PLAYBACK, True, F.lit(False)) and "-c:v libsvtav1" in argv(policy.PLAYBACK, False, F.lit(True))
    assert "-c:v x265 -preset 6 -crf 20" in argv(policy.Encoding(encoder="x265", quality=20))


def test_golden_identity():
    head = dict(codec_name="h264", pixel_format="yuv420p", color_range="tv", color_primaries="bt709", color_transfer="bt709", width=640, height=480, rotation_degrees=0, square_pixels=True, progressive=True)
    content = identity.content_input(head, [(10, True, "MD5:aa"), (20, False, "MD5:bb")], b"t")
    assert content[:5] == b"\x01\0\0\0t" and len(content) == 5 + sum(4 + len(head[c]) for c in identity.STRINGS) + 24 + 2 + 8 + 2 * (9 + 4 + 6)
    one = identity.digest(content)
    assert one == hashlib.blake2b(content, digest_size=16).digest()
    u = identity.as_uuid8(one)
    assert u[14] == "8" and u[19] in "89ab"


def test_minted_as_the_bytes_say(spark):
    """Against the whole inputs hashed at once; files without a header or without packets aren't minted."""
    import random

    rng = random.Random(6)
    files = [[(rng.random() * 9, rng.randrange(1, 10**6), rng.random() < 0.3) for _ in range(n)] for n in (1, 7, 300, 5)]
    p = packets(spark, *files).repartition(5)
    cols = "file_id long, codec_name string, pixel_format string, color_range string, color_primaries string, color_transfer string, width long, height long, rotation_degrees long, square_pixels boolean, progressive boolean, timing_source string"
    heads = [(i, "h264", "é\"x", "tv", "", "y", i, -2, 90, i % 2 == 0, True, "absent" if i == 1 else "presentation") for i in (0, 1, 2, 9)]
    got = {r.file_id: r for r in identity.mint(p, spark.createDataFrame(heads, cols)).collect()}
    assert set(got) == {0, 1, 2}
    tags = policy.Tags()
    for h in heads[:3]:
        rows = sorted(p.where(f"file_id = {h[0]}").collect(), key=lambda r: r.decode_order)
        head = dict(zip([c.split()[0] for c in cols.split(", ")], h))
        content = identity.digest(identity.content_input(head, [(r["size"], r.keyframe, r.data_hash) for r in rows], tags.content))
        video = identity.digest(identity.video_input(content, h[-1] == "presentation", [r.time for r in rows], tags.video))
        assert (got[h[0]].content_digest, got[h[0]].video_uuid) == (content.hex(), identity.as_uuid8(video))


def test_identity_of_rewrites(spark):
    rows = [(i / 25, 10 + i, i % 5 == 0) for i in range(20)]
    p = packets(spark, rows, [(t + 1, n, k) for t, n, k in rows], rows, rows[:-1])
    cols = "file_id long, codec_name string, pixel_format string, color_range string, color_primaries string, color_transfer string, width long, height long, rotation_degrees long, square_pixels boolean, progressive boolean, timing_source string"
    heads = spark.createDataFrame([(i, "h264", "yuv420p", "tv", "x", "y", 1, 2, 0, True, True, "decode" if i == 2 else "presentation") for i in range(4)], cols)
    got = {r.file_id: r for r in identity.mint(p, heads).collect()}
    assert got[0].content_digest == got[1].content_digest == got[2].content_digest != got[3].content_digest
    assert got[0].video_uuid == got[2].video_uuid != got[1].video_uuid


def test_sequences(spark):
    seg = spark.createDataFrame([(1, 0, 3000, 30.0, 640, 480, 100.0), (1, 1, 250, 30.00000021, 640, 480, 10.0), (2, 0, 10, 30.0, 640, 480, 1.0), (2, 1, 10, 0.0, 640, 480, 1.0), (2, 2, 10, 30.0, 1, 480, 1.0)], "sequence_id long, ordinal long, frame_count long, fps double, width int, height int, duration double")
    assert {r.sequence_id: (r.ordinal, r.field) for r in sequence.uniformity(seg).collect()} == {1: (None, None), 2: (1, "fps")}
    assert {r.sequence_id: r.fps for r in sequence.canonical_fps(seg).collect()}[1] == pytest.approx(3250 / 110)
    t = spark.createDataFrame([(1, 0), (1, 2999), (1, 3000), (1, 3249), (1, 3250), (1, -1)], "sequence_id long, global_frame long")
    got = {r.global_frame: (r.ordinal, r.local_frame, r.status) for r in sequence.segment_for_frame(seg, t).collect()}
    assert got == {0: (0, 0, "ok"), 2999: (0, 2999, "ok"), 3000: (1, 0, "ok"), 3249: (1, 249, "ok"), 3250: (None, None, "out of range"), -1: (None, None, "out of range")}


def test_boxes(spark):
    box = lambda kind, n=8: n.to_bytes(4, "big") + kind + bytes(n - 8)
    assert probe_text.top_boxes(box(b"ftyp", 16) + box(b"moov", 24) + box(b"mdat")) == ["ftyp", "moov", "mdat"]
    assert probe_text.top_boxes(box(b"RIFF") + box(b"moov")) == ["RIFF"]
    large = (1).to_bytes(4, "big") + b"mdat" + (24).to_bytes(8, "big") + bytes(8)
    assert probe_text.top_boxes(box(b"ftyp") + large + box(b"moov")) == ["ftyp", "mdat", "moov"]
    assert probe_text.top_boxes(b"") == []
    df = spark.createDataFrame([("x", bytearray(box(b"ftyp") + box(b"moov")))], "path string, content binary")
    assert probe_text.boxes(df).first().box_types == ["ftyp", "moov"]


def test_rotate(spark):
    data = bytes(range(6))
    assert raw_frames.rotated(data, 2, 3, 1, 90) == (bytes([3, 0, 4, 1, 5, 2]), 3, 2)
    df = spark.createDataFrame([(1, 0, 2, 3, 1, bytearray(data), 180)], "file_id long, frame_index long, height int, width int, channels int, data binary, rotation_degrees int")
    assert bytes(raw_frames.rotate(df).first().data) == data[::-1]
    assert raw_frames.checked(df, 2, 3, 3).first().error == "shape"


def test_gap_and_landing(spark):
    d = spark.createDataFrame([(1, i, t, 10.0, 1.0) for i, t in enumerate([0.0, 0.1, 0.3, 0.3])], "file_id long, position long, time double, fps double, max_gap double")
    assert [r.status for r in delivery.gap_check(d).orderBy("position").collect()] == ["first", "ok", "missing", "collapsed"]
    i = spark.createDataFrame([(1, k, k / 10) for k in range(50)], "file_id long, rank long, time double")
    o = spark.createDataFrame([(1, 1, 0.31, 10.0), (1, 2, 9.0, 10.0), (1, 3, 0.34, 10.0)], "file_id long, obs_id long, time double, fps double")
    assert {r.obs_id: r["rank"] for r in delivery.landing_rank(i, o).collect()} == {1: 3, 2: None, 3: 3}


def plain_gop(rows):
    best, size, n = (0, 0), 0, 0
    for _, bytes_, key in [*rows, (0, 0, True)]:
        if key:
            best = max(best[0], size), max(best[1], n)
            size, n = 0, 0
        size, n = size + bytes_, n + 1
    return best


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.integers(0, 10**6))
def test_random_packets(spark, seed):
    rng = random.Random(seed)
    files = [[(rng.randrange(30) / 10, rng.randrange(1, 99), rng.random() < 0.2) for _ in range(rng.randrange(1, 40))] for _ in range(12)]
    p = packets(spark, *files)
    got = {r.file_id: (r.max_gop_bytes, r.max_keyframe_interval_frames) for r in gop.gop_stats(p).collect()}
    assert got == {i: plain_gop(f) for i, f in enumerate(files)}
    fit = {r.file_id: r for r in timing.timing(p).collect()}
    for i, f in enumerate(files):
        t = sorted({x[0] for x in f})
        assert fit[i].frame_count == len(t)
        if len(t) > 1:
            assert fit[i].fps == (len(t) - 1) / (t[-1] - t[0])
            assert fit[i].max_gap == max((b - a) * fit[i].fps for a, b in zip(t, t[1:]))


def test_preceding_keyframes_hold_one_sort(spark):
    """Each row stands once in a task's memory: in one sort, in no hash table."""
    nan = float("nan")
    p = packets(spark, [(0.5, 1, False), (-0.0, 1, None), (0.0, 1, True), (0.5, 1, True), (nan, 1, False), (nan, 1, None), (None, 1, True), (1.5, 1, None)], [(2.0, 1, None), (2.0, 1, False), (1.0, 1, False)])
    got = index.preceding_keyframe(index.seek_index(p))
    assert sorted((r.file_id, r["rank"], str(r.time), r.is_keyframe, r.keyframe_rank, str(r.keyframe_time)) for r in got.collect()) == [
        (0, 0, "0.0", True, 0, "0.0"), (0, 1, "0.5", True, 1, "0.5"), (0, 2, "1.5", False, 1, "0.5"), (0, 3, "nan", False, 1, "0.5"), (1, 0, "1.0", False, 0, "1.0"), (1, 1, "2.0", False, 0, "1.0"),
    ]
    steps = got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert "Aggregate" not in steps and steps.count("Sort [") == 1


def hashed(df):
    """The hash tables of the plan that are keyed by time or interval."""
    return [x for x in df._jdf.queryExecution().executedPlan().toString().splitlines() if "HashAggregate(keys=[" in x and ("time#" in x.split("]")[0] or "gop#" in x.split("]")[0])]


def test_sparse_reads_hold_no_times_in_hash_tables(spark):
    p = packets(spark, [(i % 20 / 10, 1, i % 12 == 0) for i in range(40)])
    got = index.sparse_read(index.seek_index(p), spark.createDataFrame([(0, 15), (0, 15), (0, 3), (0, 20)], "file_id long, rank long"))
    assert not hashed(got)
    assert sorted((r["rank"], r.time, r.keyframe_rank) for r in got.collect()) == [(3, 0.3, 0), (15, 1.5, 12)]


def test_groups_by_keyframe_hold_no_times_in_hash_tables(spark):
    p = packets(spark, [(i % 20 / 10, 1, i % 12 == 0) for i in range(40)])
    got = index.group_by_gop(index.seek_index(p), spark.createDataFrame([(0, 15), (0, 15), (0, 13), (0, 3), (0, 20)], "file_id long, rank long"))
    assert not hashed(got)
    assert {r.keyframe_rank: r.targets for r in got.collect()} == {0: [3], 12: [13, 15]}


def test_facts_hold_no_times_or_intervals_in_hash_tables(spark):
    rng = random.Random(7)
    p = packets(spark, *[[(rng.choice([None, *map(float, range(12))]), rng.choice([None, *range(9)]), rng.choice([None, True, False, False])) for _ in range(rng.randrange(1, 30))] for _ in range(60)]).withColumn("discard", F.col("size") % 2 == 1)
    assert not hashed(facts.measure(p)) and not hashed(gop.gop_stats(p))
    plain = "SELECT file_id, gop, sum(size), count(*), count_if(discard) FROM {g} GROUP BY file_id, gop"
    assert sorted(map(repr, gop.intervals(p).collect())) == sorted(map(repr, spark.sql(plain, g=gop.gop_ids(p)).toDF("file_id", "gop", "bytes", "frames", "discarded").collect()))


def test_leading_frames_hold_one_sort(spark):
    rng = random.Random(11)
    p = packets(spark, *[[(rng.choice([None, 0.0, -0.0, *map(float, range(1, 9))]), 1, rng.choice([None, True, *[False] * 5])) for _ in range(rng.randrange(1, 15))] for _ in range(80)])
    for source in ("none", "pts"):
        got = gop.leading_frames(p, spark.createDataFrame([(i, source) for i in range(80)], "file_id long, source string"))
        steps = got._jdf.queryExecution().executedPlan().toString()
        assert sum("Sort [" in x and ("time#" in x or "decode_order#" in x) for x in steps.splitlines()) == 1 and not hashed(got)
        lead = {r.file_id: r.leading_non_keyframe_frames for r in got.collect()}
        rows = {}
        for r in p.orderBy("file_id", "decode_order").collect():
            rows.setdefault(r.file_id, []).append(r)
        for f, own in rows.items():
            keys = [r.time for r in own if r.keyframe and r.time is not None]
            timed = len({r.time for r in own if keys and r.time is not None and r.time < min(keys)})
            flags = [r.keyframe for r in own]
            untold = next((i for i, k in enumerate(flags) if k is not None), 0)
            assert lead[f] == (timed if source == "pts" else flags.index(True) - untold if True in flags else 0), (f, source)

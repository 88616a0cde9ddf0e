"""Programs, files and the command line, with small scripts in place of the media tools."""

import json
import os
import stat
import struct
import sys
import time
import types
from fractions import Fraction

import numpy as np
import pytest

from reelspark import __main__ as cli
from reelspark import frames, policy
from reelspark.frames import pixels
from reelspark.live import processes, tools
from reelspark.operators import convert, facts
from reelspark.plans import catalogue
from reelspark.sources import media, probe_text
from tests.compare import DATA


def script(tmp_path, name, body):
    path = tmp_path / name
    path.write_text(f"#!{sys.executable}\n{body}")
    path.chmod(path.stat().st_mode | stat.S_IEXEC)
    return str(path)


def test_run(tmp_path):
    assert processes.run([sys.executable, "-c", "print('x')"], 20, "printing") == "x\n"
    for argv, seconds, says in (
        (["no-such-tool"], 5, "no-such-tool not found"),
        ([sys.executable, "-c", "import time; time.sleep(9)"], 0.2, f"{sys.executable} timed out sleeping"),
        ([sys.executable, "-c", "import sys; sys.exit('broken ')"], 20, f"{sys.executable} failed sleeping: broken"),
        ([sys.executable, "-c", "import sys; sys.exit(3)"], 20, f"{sys.executable} failed sleeping: unknown error"),
    ):
        with pytest.raises(processes.ToolError) as e:
            processes.run(argv, seconds, "sleeping")
        assert str(e.value) == says
    with pytest.raises(processes.ToolError, match="no output"):
        processes.require_output(str(tmp_path / "none"), ["t"])
    (tmp_path / "empty").touch()
    with pytest.raises(processes.ToolError, match="no output"):
        processes.require_output(str(tmp_path / "empty"), ["t"])


def test_published_whole_or_not_at_all(tmp_path):
    path = str(tmp_path / "new" / "out.mp4")
    with processes.published(path) as part:
        assert part.endswith(".mp4") and os.path.dirname(part) == os.path.dirname(path) and not os.path.exists(path)
        open(part, "w").write("whole")
    assert open(path).read() == "whole" and os.listdir(tmp_path / "new") == ["out.mp4"]
    with pytest.raises(RuntimeError), processes.published(path) as part:
        open(part, "w").write("half")
        raise RuntimeError
    assert open(path).read() == "whole" and os.listdir(tmp_path / "new") == ["out.mp4"]


def test_watch(tmp_path):
    tool = script(tmp_path, "tool", "import sys, time\nfor x in sys.argv[1].split(','): print(x, flush=True)\ntime.sleep(float(sys.argv[2]))\nsys.exit(int(sys.argv[3]))")
    blocks = []
    processes.watch([tool, "fps=1,noise,out_time_us=5,progress=continue,fps=2,progress=end,fps=9", "0", "0"], 20, "testing", blocks.append)
    assert blocks == [{"fps": "1", "out_time_us": "5"}, {"fps": "2"}]
    with pytest.raises(processes.ToolError, match="failed"):
        processes.watch([tool, "a=1", "0", "4"], 20, "testing")
    with pytest.raises(processes.ToolError, match="not found"):
        processes.watch(["no-such-tool"], 20, "testing")
    for kind, extra in (("timed out after 0.5s", {"seconds": 0.5}), ("cancelled", {"seconds": 30, "cancelled": lambda: True})):
        began = time.monotonic()
        with pytest.raises(processes.ToolError, match=kind):
            processes.watch([tool, "a=1", "30", "0"], action="testing", **extra)
        assert time.monotonic() - began < 10
    with pytest.raises(KeyError):  # a caller's own error stops the child too
        processes.watch([tool, "progress=continue", "30", "0"], 20, "testing", lambda b: b["none"])


def test_capabilities(tmp_path, monkeypatch):
    assert tools.listed("av1_nvenc", " V....D av1_nvenc NVIDIA (codec av1)\n x") and not tools.listed("av1", " V....D av1_nvenc NVIDIA (codec av1)")
    assert not tools.present("no-such-tool") and not tools.encoder_usable("x", "no-such-tool") and not tools.hardware_decoding("no-such-tool") and tools.version("no-such-tool") == ""
    script(tmp_path, "fake", "import sys\na = sys.argv\nif '-encoders' in a: print(' V..... good it\\n V..... bad it')\nelif '-show_library_versions' in a: print('library_version,Lavf1.2.3,x')\nelif 'bad' in a or 'cuda' in a: sys.exit(1)")
    monkeypatch.setenv("PATH", f"{tmp_path}:{os.environ['PATH']}")
    assert tools.encoder_listed("bad", "fake") and tools.encoder_usable("good", "fake") and not tools.encoder_usable("bad", "fake") and not tools.encoder_usable("worse", "fake")
    assert not tools.hardware_decoding("fake") and tools.version("fake") == "fake Lavf1.2.3"


PACKETS = ["0.0,0.0,10,48,K__,MD5:a", "0.04,0.04,5,58,___,MD5:b", "0.08,0.08,5,63,___,MD5:c", "x"]


def test_packet_source(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"{i}.csv").write_text("\n".join(PACKETS[i:]))
    spark.dataSource.register(media.PacketLogs)
    paths = json.dumps([f"{tmp_path}/{i}.csv" for i in range(3)])
    by_log = spark.read.format("packet_logs").option("paths", paths).load()
    by_command = spark.read.format("packet_logs").options(paths=paths, by="command", argv=json.dumps(["cat", "{path}"])).load()
    assert by_log.rdd.getNumPartitions() == 3 and sorted(by_log.collect()) == sorted(by_command.collect())
    assert {r.file_id: r.n for r in probe_text.packets(by_log).groupBy("file_id").count().withColumnRenamed("count", "n").collect()} == {0: 3, 1: 2, 2: 1}
    with pytest.raises(Exception, match="can't read packets by magic"):
        spark.read.format("packet_logs").options(paths=paths, by="magic").load().collect()


def test_demuxed_packets(monkeypatch):
    class Packet(types.SimpleNamespace):
        pass

    p = lambda pts, dts, size=5, pos=1, key=False: Packet(pts=pts, dts=dts, size=size, pos=pos, is_keyframe=key, is_discard=False)
    stream = types.SimpleNamespace(time_base=Fraction(1, 25))

    class Container:
        def __init__(self, packets):
            self.packets, self.streams = packets, types.SimpleNamespace(video=[stream])

        def __enter__(self):
            return self

        def __exit__(self, *a):
            pass

        def demux(self, s):
            return iter(self.packets)

    opened = {}
    av = types.ModuleType("av")
    av.open = lambda path, options: opened.update({path: options}) or Container([p(0, 0, key=True), p(None, 1, pos=None), p(None, None, size=0)] if path == "a" else [p(None, None)])
    monkeypatch.setitem(sys.modules, "av", av)
    assert list(media.demuxed("a", True)) == [(0, 0.0, 0.0, 5, 1, True, False), (1, None, 0.04, 5, -1, False, False)] and opened["a"] == {"ignore_editlist": "1"}
    with pytest.raises(RuntimeError, match="no packet times"):
        list(media.demuxed("b", False))
    monkeypatch.setitem(sys.modules, "av", None)
    with pytest.raises(RuntimeError, match="needs the av library"):
        list(media.demuxed("a", False))


def box(kind, n=8):
    return struct.pack(">I4s", n, kind) + b"x" * (n - 8)


def test_boxes_by_seeking(tmp_path):
    wide = struct.pack(">I4sQ", 1, b"mdat", 40) + b"y" * 24
    for data in (box(b"ftyp", 20) + wide + box(b"moov", 30), box(b"moov") + box(b"ftyp"), box(b"ftyp") + struct.pack(">I4s", 0, b"mdat") + b"rest", b"", b"short", box(b"ftyp") * 20, box(b"ftyp") + struct.pack(">I4s", 3, b"free") + b"z" * 9):
        (tmp_path / "f").write_bytes(data)
        assert probe_text.boxes_at(str(tmp_path / "f")) == probe_text.top_boxes(data)


def test_plans_are_run_whole(spark, tmp_path):
    tool = script(tmp_path, "conv", "import sys\nif sys.argv[1] == 'bad': sys.exit('no such codec')\nprint('progress=end')\nopen(sys.argv[-1], 'w').write('' if sys.argv[1] == 'empty' else 'done')")
    rows = [(i, f"s{i}", f"{tmp_path}/out/{i}.mp4", argv and [tool, argv, f"{tmp_path}/out/{i}.mp4"], error) for i, (argv, error) in enumerate([("ok", None), ("bad", None), ("empty", None), (None, None), ("ok", "refused")])]
    got = {r.file_id: r for r in convert.run_plans(spark.createDataFrame(rows, "file_id long, source string, destination string, argv array<string>, error string")).collect()}
    assert [got[i].performed for i in range(5)] == [True, False, False, False, False]
    assert got[1].error.endswith("failed converting s1: no such codec") and "no output" in got[2].error and got[3].error is None and got[4].error == "refused"
    assert os.listdir(tmp_path / "out") == ["0.mp4"] and (tmp_path / "out" / "0.mp4").read_text() == "done"


def test_facts_have_all_columns(spark):
    out = catalogue.queries()["probe_media"](spark, DATA)
    assert len(set(out.columns)) == 35 and out.columns.count("file_id") == 1
    rows = out.collect()
    assert rows and all(len(r.content_digest) == 32 and len(r.video_uuid) == 36 for r in rows)
    assert len({r.content_digest for r in rows}) == len(rows)
    assert facts.as_json(out).count() == len(rows)


def test_command_line(spark, tmp_path, capsys):
    header = {"streams": [{"codec_type": "video", "codec_name": "h264", "pix_fmt": "yuv420p", "width": 64, "height": 48, "avg_frame_rate": "25/1", "nb_frames": "3"}], "format": {"format_name": "mov,mp4,m4a,3gp,3g2,mj2", "duration": "0.12"}}
    body = f"import sys, json\nh = {header!r}\np = {PACKETS!r}\nf = sys.argv[-1]\nif 'broken' in f: sys.exit('bad data')\nif 'other' in f: p[1] = p[1].replace('MD5:b', 'MD5:z')\nif 'turned' in f: h['streams'][0]['side_data_list'] = [{{'rotation': 90}}]\nprint(json.dumps(h) if '-show_format' in sys.argv else chr(10).join(p))"
    prober = script(tmp_path, "prober", body)
    names = ["a", "b", "other", "turned"]
    for n in names:
        (tmp_path / f"{n}.mp4").write_bytes(box(b"ftyp", 20) + box(b"moov") + box(b"mdat"))
    table = f"{tmp_path}/facts"
    assert cli.main(["measure", table, *[f"{tmp_path}/{n}.mp4" for n in names], "--prober", prober], spark) == 0
    assert cli.main(["probe", table, "--file", "0"], spark) == 0
    told = json.loads(capsys.readouterr().out)
    assert list(told) == sorted(told) and told["frame_count"] == 3 and told["fps"] == 25.0 and told["moov_at_start"] is True and told["analysis_reasons"] == []
    assert cli.main(["compare", table, "0", "1"], spark) == policy.EXIT_CODES["duplicate"] == 0
    assert cli.main(["compare", table, "0", "2"], spark) == policy.EXIT_CODES["distinct"]
    assert cli.main(["compare", table, "0", "1", "--fps-tolerance", "-1"], spark) == policy.EXIT_CODES["different_timing"]
    assert cli.main(["compare", table, "0", "77"], spark) == 1
    with pytest.raises(SystemExit) as e:
        cli.main(["plan", table, "out", "--target", "neither"], spark)
    assert e.value.code == 2
    assert cli.main(["plan", table, f"{tmp_path}/plans", "--target", "analysis"], spark) == 0
    ops = {r.file_id: r.operation for r in spark.read.parquet(f"{tmp_path}/plans").collect()}
    assert ops == {0: None, 1: None, 2: None, 3: "reencode_av1"}
    capsys.readouterr()
    out = tmp_path / "done"
    out.mkdir()
    script(tmp_path, "ffmpeg", "import sys\nopen(sys.argv[-1], 'w').write('video')")
    old = os.environ["PATH"]
    os.environ["PATH"] = f"{tmp_path}:{old}"
    try:
        # workers that are running already keep their path, so the command names the tool in full
        base = cli.planner.BASE
        cli.planner.BASE = (f"{tmp_path}/ffmpeg", *base[1:])
        assert cli.main(["transcode", table, str(out), "--target", "analysis"], spark) == 0
    finally:
        os.environ["PATH"] = old
        cli.planner.BASE = base
    said = capsys.readouterr().out
    assert said.count("nothing to do") == 3 and f"wrote {out}/turned.mp4 (reencode_av1, libsvtav1)" in said and os.listdir(out) == ["turned.mp4"]
    assert cli.main(["transcode", table, f"{tmp_path}/one.mp4", "--target", "analysis"], spark) == 1


def test_probe_failure_exits_with_one(spark, tmp_path, capsys):
    prober = script(tmp_path, "prober", "import sys\nsys.exit('bad data') if '-show_format' in sys.argv else print('')")
    (tmp_path / "broken.mp4").write_bytes(b"")
    assert cli.main(["measure", f"{tmp_path}/facts", f"{tmp_path}/broken.mp4", "--prober", prober], spark) == 1
    assert "bad data" in capsys.readouterr().err and spark.read.parquet(f"{tmp_path}/facts").count() == 0


def plain_resize(picture, height, width):
    h, w, c = picture.shape
    out = np.zeros((height, width, c))

    def taps(n, to, i):
        step, got = n / to, {}
        middle, wide = (i + 0.5) * step - 0.5, max(1.0, step)
        for j in range(int(np.floor(middle - 2 * wide)), int(np.ceil(middle + 2 * wide)) + 1):
            at = min(max(j, 0), n - 1)
            got[at] = got.get(at, 0) + pixels.cubic((j - middle) / wide)
        total = sum(got.values())
        return {k: v / total for k, v in got.items()}

    for y in range(height):
        for x in range(width):
            for ky, vy in taps(h, height, y).items():
                for kx, vx in taps(w, width, x).items():
                    out[y, x] += vy * vx * picture[ky, kx]
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)


def test_pixels_against_plain_loops():
    rng = np.random.default_rng(4)
    picture = rng.integers(0, 256, (9, 7, 3), dtype=np.uint8)
    for size in ((9, 7), (4, 3), (18, 5), (1, 1), (20, 21)):
        assert np.array_equal(pixels.resized(picture, *size), plain_resize(picture, *size))
    flat = np.full((5, 6, 1), 77, np.uint8)
    assert np.array_equal(pixels.resized(flat, 3, 9), np.full((3, 9, 1), 77, np.uint8))
    g = pixels.grey(picture)
    assert all(g[y, x, 0] == (114 * int(b) + 587 * int(gr) + 299 * int(r) + 500) // 1000 for y in range(9) for x in range(7) for b, gr, r in [picture[y, x]])
    assert pixels.cubic(0) == 1 and abs(pixels.cubic(1)) < 1e-12 and pixels.cubic(2) == 0
    import zlib

    data = pixels.png(picture)
    assert data[:8] == b"\x89PNG\r\n\x1a\n" and struct.unpack(">II", data[16:24]) == (7, 9)
    at = data.index(b"IDAT")
    lines = zlib.decompress(data[at + 4 : at + 4 + struct.unpack(">I", data[at - 4 : at])[0]])
    assert lines[1:4] == bytes(picture[0, 0][::-1]) and len(lines) == 9 * 22


def test_frames(spark):
    rng = np.random.default_rng(5)
    rows = [(f, i, 4, 6, 3, rng.integers(0, 256, 72, dtype=np.uint8).tobytes()) for f in (1, 2) for i in (7, 3, 5)]
    df = spark.createDataFrame(rows, frames.OUT)
    assert {(r.file_id, r.frame_index) for r in pixels.first_frames(df).collect()} == {(1, 3), (2, 3)}
    small = pixels.thumbnails(df, 3).collect()
    assert {(r.height, r.width, len(r.data)) for r in small} == {(2, 3, 18)}
    got = {(r.file_id, r.batch): r for r in pixels.read_batches(df, 2).collect()}
    by = {(f, i): d for f, i, *_, d in rows}
    assert got[1, 0].indices == [3, 5] and bytes(got[1, 0].data) == by[1, 3] + by[1, 5] and got[2, 1].indices == [7]
    assert all(r.png[:4] == b"\x89PNG" for r in pixels.as_png(pixels.to_grey(df)).collect())
    bad = df.unionByName(spark.createDataFrame([(1, 6, 4, 5, 3, b"x")], frames.OUT))
    assert {r.file_id: (r.frames_written, r.first_refused) for r in pixels.written(bad, 4, 6).collect()} == {1: (2, 6), 2: (3, None)}


def y4m(path, rng, n, h, w, kind="420", extra=""):
    """A file of random frames, and its planes."""
    ch, cw = {"420": (2, 2), "444": (1, 1), "422": (1, 2), "mono": (0, 0)}[kind]
    shape = (-(-h // ch), -(-w // cw)) if ch else (0, 0)
    planes = [(rng.integers(0, 256, (h, w), dtype=np.uint8), rng.integers(0, 256, shape, dtype=np.uint8), rng.integers(0, 256, shape, dtype=np.uint8)) for _ in range(n)]
    with open(path, "wb") as f:
        f.write(f"YUV4MPEG2 W{w} H{h} F30000:1001 Ip A1:1 C{kind}{extra}\n".encode())
        for p in planes:
            f.write(b"FRAME\n" + b"".join(x.tobytes() for x in p))
    return planes, (ch, cw)


@pytest.mark.parametrize("kind, extra", [("420", ""), ("444", " XCOLORRANGE=FULL"), ("422", ""), ("mono", "")])
def test_raw_pictures_against_plain_loops(tmp_path, kind, extra):
    from reelspark.frames import raw

    planes, (ch, cw) = y4m(tmp_path / "v", np.random.default_rng(6), 2, 5, 7, kind, extra)
    own = raw.layout(str(tmp_path / "v"))
    assert (own.width, own.height, own.count, round(own.fps, 3)) == (7, 5, 2, 29.97)
    y, u, v = planes[1]
    got = raw.picture(b"".join(x.tobytes() for x in planes[1]), own, False)
    for i in range(5):
        for j in range(7):
            a, b, c = float(y[i, j]), *((float(p[i // ch, j // cw]) - 128 if ch else 0.0) for p in (u, v))
            if not extra:
                a, b, c = (a - 16) * 255 / 219, b * 255 / 224, c * 255 / 224
            r, bl = a + 1.402 * c, a + 1.772 * b
            g = (a - 0.299 * r - 0.114 * bl) / 0.587
            assert all(abs(int(got[i, j, k]) - min(255, max(0, x))) <= 0.5 + 1e-6 for k, x in enumerate((bl, g, r)))
    assert np.array_equal(raw.picture(planes[0][0].tobytes() + planes[0][1].tobytes() + planes[0][2].tobytes(), own, True)[:, :, 0], planes[0][0])


def test_raw_video_source_and_picture_sink(spark, tmp_path):
    from reelspark.frames import raw

    rng = np.random.default_rng(7)
    planes = [y4m(tmp_path / f"{i}.y4m", rng, n, 4, 6)[0] for i, n in enumerate((9, 5))]
    paths = json.dumps([f"{tmp_path}/{i}.y4m" for i in range(2)])
    for s in (raw.RawVideo, raw.Pictures):
        spark.dataSource.register(s)
    load = lambda **o: spark.read.format("raw_video").options(paths=paths, **o).load()
    every = {(r.file_id, r.frame_index): bytes(r.data) for r in load(grey="true").collect()}
    assert every == {(i, k): p[0].tobytes() for i, own in enumerate(planes) for k, p in enumerate(own)}
    part = load(grey="true", start="1", end="8", step="3", split="2")
    assert part.rdd.getNumPartitions() == 3
    assert {(r.file_id, r.frame_index): bytes(r.data) for r in part.collect()} == {k: v for k, v in every.items() if k[1] in (1, 4, 7)}
    assert sorted((r.file_id, r.frame_index) for r in load(targets="[4, 0, 4]").collect()) == [(0, 0), (0, 4), (1, 0), (1, 4)]
    for bad, says in (({"targets": "[5]"}, "out of range"), ({"step": "0"}, "step must be positive")):
        with pytest.raises(Exception, match=says):
            load(**bad).collect()
    (tmp_path / "cut.y4m").write_bytes((tmp_path / "0.y4m").read_bytes()[:-3])
    with pytest.raises(Exception, match="ends inside a frame"):
        spark.read.format("raw_video").option("paths", json.dumps([f"{tmp_path}/cut.y4m"])).load().collect()
    # the first picture of each file, as a file
    pixels.first_frames(load()).write.format("pictures").option("path", f"{tmp_path}/out").mode("append").save()
    assert sorted(os.listdir(tmp_path / "out")) == ["0", "1"] and os.listdir(tmp_path / "out" / "0") == ["0.png"]
    shown = raw.picture(b"".join(x.tobytes() for x in planes[0][0]), raw.layout(f"{tmp_path}/0.y4m"), False)
    assert (tmp_path / "out" / "0" / "0.png").read_bytes() == pixels.png(shown)
    with pytest.raises(Exception, match="doesn't fit"):
        load().write.format("pictures").options(path=f"{tmp_path}/bad", height="5").mode("append").save()

"""Uncompressed video files (YUV4MPEG2) as a source of frames, and folders of pictures as a sink.

    spark.dataSource.register(RawVideo)
    spark.read.format("raw_video").options(paths=json.dumps([...]), start="10", end="40", step="5", grey="true").load()

Frames have one size in a file, so a read goes straight to the frames it asks for: a window
(start, end), every step-th of it, or a JSON list of ``targets``. With ``split`` a file is read
in parts of so many frames by different tasks.

    frames.write.format("pictures").option("path", folder).mode("append").save()

writes each frame as folder/file_id/frame_index.png, which appears only when it is whole, so a task may
run again. A frame that doesn't fit its data, or the options height, width and channels, fails the write.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from . import OUT

#: Chroma rows and columns for one of luma, by the header's C; others aren't read.
_CHROMA = {"420": (2, 2), "420jpeg": (2, 2), "420mpeg2": (2, 2), "420paldv": (2, 2), "422": (1, 2), "444": (1, 1), "mono": None}
_MARK = b"FRAME\n"


@dataclass(frozen=True)
class Layout:
    """What a file's first line tells: size, rate, planes, where frames begin and how many there are."""

    width: int
    height: int
    fps: float
    chroma: tuple[int, int] | None
    full_range: bool
    begin: int
    count: int

    @property
    def plane(self) -> tuple[int, int]:
        """Rows and columns of a chroma plane."""
        return (-(-self.height // self.chroma[0]), -(-self.width // self.chroma[1])) if self.chroma else (0, 0)

    @property
    def size(self) -> int:
        return self.height * self.width + 2 * self.plane[0] * self.plane[1]


def layout(path: str) -> Layout:
    with open(path, "rb") as f:
        line = f.readline(1000)
        words = line.decode("ascii", "replace").split()
        if not words or words[0] != "YUV4MPEG2" or not line.endswith(b"\n"):
            raise ValueError(f"{path} is no YUV4MPEG2 file")
        tags = {w[0]: w[1:] for w in words[1:] if w[0] != "X"}
        if tags.get("C", "420") not in _CHROMA:
            raise ValueError(f"{path}: C{tags['C']} isn't read")
        top, _, bottom = tags.get("F", "0:1").partition(":")
        fps = int(top) / int(bottom) if int(bottom or 0) else 0.0
        made = Layout(int(tags["W"]), int(tags["H"]), fps, _CHROMA[tags.get("C", "420")], "XCOLORRANGE=FULL" in words, len(line), 0)
        n, rest = divmod(os.fstat(f.fileno()).st_size - made.begin, made.size + len(_MARK))
        if rest:
            raise ValueError(f"{path} ends inside a frame, or its frames have lines of their own")
    return Layout(**{**made.__dict__, "count": n})


def picture(data: bytes, own: Layout, grey: bool):
    """Blue, green and red of a frame, or its luma as stored."""
    import numpy as np

    y = np.frombuffer(data, np.uint8, own.height * own.width).reshape(own.height, own.width)
    if grey:
        return y[:, :, None]
    if own.chroma is None:
        u = v = np.full(y.shape, 128, np.uint8)
    else:
        (h, w), at = own.plane, own.height * own.width
        spread = lambda p: p.repeat(own.chroma[0], 0).repeat(own.chroma[1], 1)[: own.height, : own.width]
        u, v = (spread(np.frombuffer(data, np.uint8, h * w, at + i * h * w).reshape(h, w)) for i in range(2))
    y, u, v = y.astype(float), u.astype(float) - 128, v.astype(float) - 128
    if not own.full_range:
        y, u, v = (y - 16) * 255 / 219, u * 255 / 224, v * 255 / 224
    # luma of red, green and blue: 0.299, 0.587, 0.114
    bgr = np.stack([y + 1.772 * u, y - (0.114 * 1.772 * u + 0.299 * 1.402 * v) / 0.587, y + 1.402 * v], 2)
    return np.clip(np.rint(bgr), 0, 255).astype(np.uint8)


class Part(InputPartition):
    def __init__(self, file_id: int, path: str, indices: list[int] | range):
        self.file_id, self.path, self.indices = file_id, path, indices


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options
        if int(options.get("step", "1")) < 1 or int(options.get("start", "0")) < 0:
            raise ValueError("start must not be below 0, step must be positive")

    def partitions(self) -> list[Part]:
        o, out = self.options, []
        for i, path in enumerate(json.loads(o.get("paths", "[]"))):
            n = layout(path).count
            wanted = range(int(o.get("start", "0")), min(n, int(o.get("end", n))), int(o.get("step", "1")))
            if "targets" in o:
                wanted = sorted(set(json.loads(o["targets"])))
                if bad := [t for t in wanted if not 0 <= t < n]:
                    raise IndexError(f"frame {bad[0]} is out of range [0, {n}) of {path}")
            part = int(o.get("split", "0")) or max(1, len(wanted))
            out += [Part(i, path, wanted[k : k + part]) for k in range(0, len(wanted), part)]
        return out

    def read(self, partition: Part) -> Iterator[tuple]:
        own, grey = layout(partition.path), self.options.get("grey", "false") == "true"
        with open(partition.path, "rb") as f:
            for i in partition.indices:
                f.seek(own.begin + i * (own.size + len(_MARK)))
                if f.read(len(_MARK)) != _MARK:
                    raise ValueError(f"{partition.path} has no frame {i} where it should be")
                data = f.read(own.size)
                shown = picture(data, own, grey)
                yield partition.file_id, i, *shown.shape, shown.tobytes()


class RawVideo(DataSource):
    @classmethod
    def name(cls) -> str:
        return "raw_video"

    def schema(self) -> str:
        return OUT

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


class Written(WriterCommitMessage):
    def __init__(self, frames: int):
        self.frames = frames


class _Pictures(DataSourceWriter):
    def __init__(self, options: dict):
        self.options = options

    def write(self, rows) -> Written:
        import numpy as np

        from ..live.processes import published
        from .pixels import png

        want, n = {k: int(self.options[k]) for k in ("height", "width", "channels") if k in self.options}, 0
        for r in rows:
            if any(r[k] != v for k, v in want.items()) or len(r["data"]) != r["height"] * r["width"] * r["channels"] or r["channels"] not in (1, 3):
                raise ValueError(f"frame {r['frame_index']} of file {r['file_id']} doesn't fit")
            with published(f"{self.options['path']}/{r['file_id']}/{r['frame_index']}.png") as part, open(part, "wb") as f:
                f.write(png(np.frombuffer(r["data"], np.uint8).reshape(r["height"], r["width"], r["channels"])))
            n += 1
        return Written(n)


class Pictures(DataSource):
    @classmethod
    def name(cls) -> str:
        return "pictures"

    def schema(self) -> str:
        return OUT

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        if "path" not in self.options:
            raise ValueError("pictures need a path")
        return _Pictures(dict(self.options))

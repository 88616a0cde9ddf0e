"""Packets of many files as a Spark data source: one partition for each file, read on the executors.

    spark.dataSource.register(PacketLogs)
    spark.read.format("packet_logs").option("paths", json.dumps([...])).load()

Option ``by`` says how a file is read:

- ``log`` (the default): the path is a packet log in text
- ``command``: ``argv``, a JSON list with "{path}" in it, prints that log
- ``demux``: the av library is asked, which must be installed; ``ignore_edit_list`` (true or false)
  reads the packets that an edit list hides
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

LINES = "file_id long, path string, line_no long, line string"
DEMUXED = "file_id long, path string, decode_order long, pts double, dts double, size long, pos long, keyframe boolean, discard boolean"


class OneFile(InputPartition):
    def __init__(self, file_id: int, path: str):
        self.file_id, self.path = file_id, path


def demuxed(path: str, ignore_edit_list: bool) -> Iterator[tuple]:
    """decode_order, pts, dts, size, pos, keyframe, discard of the first video stream's packets, in exact ticks times the time base."""
    try:
        import av
    except ImportError:
        raise RuntimeError("reading by demux needs the av library") from None
    with av.open(path, options={"ignore_editlist": "1"} if ignore_edit_list else {}) as container:
        if not container.streams.video:
            raise RuntimeError(f"no video stream in {path}")
        stream = container.streams.video[0]
        if stream.time_base is None:
            raise RuntimeError(f"no time base in {path}")
        at = lambda ticks: None if ticks is None else float(ticks * stream.time_base)
        n, timed = 0, False
        for p in container.demux(stream):
            if not p.size:  # the last one only flushes
                continue
            timed |= p.pts is not None or p.dts is not None
            yield n, at(p.pts), at(p.dts), int(p.size), -1 if p.pos is None else int(p.pos), bool(p.is_keyframe), bool(p.is_discard)
            n += 1
        if n and not timed:
            raise RuntimeError(f"no packet times in {path}: a raw stream has no index")


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options
        self.by = options.get("by", "log")
        if self.by not in ("log", "command", "demux"):
            raise ValueError(f"can't read packets by {self.by}")

    def partitions(self) -> list[OneFile]:
        return [OneFile(i, p) for i, p in enumerate(json.loads(self.options.get("paths", "[]")))]

    def read(self, partition: OneFile) -> Iterator[tuple]:
        own = partition.file_id, partition.path
        if self.by == "demux":
            for row in demuxed(partition.path, self.options.get("ignore_edit_list", "false") == "true"):
                yield (*own, *row)
        elif self.by == "command":
            from ..live.processes import run

            argv = [x.replace("{path}", partition.path) for x in json.loads(self.options["argv"])]
            text = run(argv, float(self.options.get("seconds", "600")), f"scanning the packets of {partition.path}")
            yield from ((*own, i, line) for i, line in enumerate(text.splitlines()))
        else:
            with open(partition.path, encoding="utf-8", errors="replace") as f:
                yield from ((*own, i, line.rstrip("\n")) for i, line in enumerate(f))


class PacketLogs(DataSource):
    """Lines that probe_text.packets() reads, or packets where the av library reads them."""

    @classmethod
    def name(cls) -> str:
        return "packet_logs"

    def schema(self) -> str:
        return DEMUXED if self.options.get("by") == "demux" else LINES

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


def _headers(argv: list[str], seconds: float, batches):
    import pandas as pd

    from ..live.processes import ToolError, run
    from .probe_text import boxes_at

    for b in batches:
        rows = []
        for file_id, path in zip(b["file_id"], b["path"]):
            try:
                text, error = run([*argv, path], seconds, f"reading the header of {path}"), None
                boxes = boxes_at(path)
            except (ToolError, OSError) as e:
                text, error, boxes = None, str(e), []
            rows.append((file_id, path, text, boxes, error))
        yield pd.DataFrame(rows, columns=["file_id", "path", "json", "boxes", "error"])


def probed(spark, paths: list[str], prober: str = "ffprobe", seconds: float = 600.0):
    """(files, lines): files (file_id, path, json, boxes, error) and packet logs (file_id, line_no, line) of media files, read on the executors by running the prober on each."""
    from functools import partial

    from .probe_text import scan_argv

    asked = spark.createDataFrame(list(enumerate(paths)), "file_id long, path string").repartition(max(1, len(paths)), "file_id")
    argv = [prober, *"-v error -show_streams -show_format -of json".split()]
    files = asked.mapInPandas(partial(_headers, argv, seconds), "file_id long, path string, json string, boxes array<string>, error string")
    spark.dataSource.register(PacketLogs)
    scan = [prober, *scan_argv("{path}", 0)[1:]]
    lines = spark.read.format("packet_logs").options(paths=json.dumps(paths), by="command", argv=json.dumps(scan), seconds=str(seconds)).load()
    return files, lines

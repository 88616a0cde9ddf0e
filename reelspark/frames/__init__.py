"""Raw frames: (file_id, frame_index, height, width, channels, data)."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

OUT = "file_id long, frame_index long, height int, width int, channels int, data binary"


def rotated(data: bytes, height: int, width: int, channels: int, degrees: int) -> tuple[bytes, int, int]:
    """The frame turned clockwise by a multiple of 90 degrees."""
    import numpy as np

    turned = np.rot90(np.frombuffer(data, np.uint8).reshape(height, width, channels), -(degrees // 90) % 4)
    return np.ascontiguousarray(turned).tobytes(), turned.shape[0], turned.shape[1]


def _rotate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for f, i, h, w, c, data, degrees in zip(*(b.column(k).to_pylist() for k in range(7))):
            out, h, w = rotated(data, h, w, c, degrees)
            rows.append((f, i, h, w, c, out))
        types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]
        cols = list(zip(*rows)) or [()] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["file_id", "frame_index", "height", "width", "channels", "data"])


def rotate(frames: DataFrame) -> DataFrame:
    """frames turned by their column rotation_degrees, a multiple of 90."""
    cols = ["file_id", "frame_index", "height", "width", "channels", "data", "rotation_degrees"]
    return frames.select(*cols).mapInArrow(_rotate, OUT)


def checked(frames: DataFrame, height: int, width: int, channels: int) -> DataFrame:
    """frames with error: a frame of another shape can't be written with the rest."""
    from pyspark.sql import functions as F

    fits = (F.col("height") == height) & (F.col("width") == width) & (F.col("channels") == channels)
    size = F.octet_length("data") == F.col("height") * F.col("width") * F.col("channels")
    return frames.withColumn("error", F.when(~fits, "shape").when(~size, "size"))

"""Raw pictures as arrays: grey, size, files. Rows are (file_id, frame_index, height, width, channels, data); three channels are blue, green, red."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache, partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalar
from . import OUT

#: The cubic kernel's two parameters.
B, C = 0.0, 0.6
#: Luma of blue, green and red, in thousandths.
LUMA = (114, 587, 299)


def grey(picture):
    """One channel of luma, rounded."""
    import numpy as np

    if picture.shape[2] == 1:
        return picture
    return ((picture.astype(np.int64) @ np.array(LUMA) + 500) // 1000).astype(np.uint8)[:, :, None]


def cubic(x: float) -> float:
    x = abs(x)
    if x < 1:
        return ((12 - 9 * B - 6 * C) * x**3 + (12 * B + 6 * C - 18) * x**2 + 6 - 2 * B) / 6
    if x < 2:
        return ((-B - 6 * C) * x**3 + (6 * B + 30 * C) * x**2 + (-12 * B - 48 * C) * x + 8 * B + 24 * C) / 6
    return 0.0


@lru_cache(64)
def weights(n: int, to: int):
    """to x n: what each old place gives to each new one; the kernel is as wide as the step where it is over one, and ends at the edge."""
    import numpy as np

    step = n / to
    wide, out = max(1.0, step), np.zeros((to, n))
    for i in range(to):
        middle = (i + 0.5) * step - 0.5
        for j in range(int(np.floor(middle - 2 * wide)), int(np.ceil(middle + 2 * wide)) + 1):
            out[i, min(max(j, 0), n - 1)] += cubic((j - middle) / wide)
    return out / out.sum(1, keepdims=True)


def resized(picture, height: int, width: int):
    import numpy as np

    if picture.shape[:2] == (height, width):
        return picture
    out = np.einsum("ih,hwc,jw->ijc", weights(picture.shape[0], height), picture.astype(float), weights(picture.shape[1], width))
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)


def png(picture) -> bytes:
    """The picture as a PNG file."""
    h, w, c = picture.shape
    rows = picture[:, :, ::-1] if c == 3 else picture
    part = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    lines = b"".join(b"\0" + rows[i].tobytes() for i in range(h))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2 if c == 3 else 0, 0, 0, 0)) + part(b"IDAT", zlib.compress(lines)) + part(b"IEND", b"")


def _mapped(change: Callable, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import numpy as np

    names = [x.split()[0] for x in OUT.split(", ")]
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]
    for b in batches:
        rows = []
        for f, i, h, w, c, data, *more in zip(*(x.to_pylist() for x in b.columns)):
            new = np.ascontiguousarray(change(np.frombuffer(data, np.uint8).reshape(h, w, c), *more))
            rows.append((f, i, *new.shape, new.tobytes()))
        cols = list(zip(*rows)) or [()] * len(types)
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, types)], names)


def _on(frames: DataFrame, change: Callable, *more: Column) -> DataFrame:
    cols = [x.split()[0] for x in OUT.split(", ")]
    return frames.select(*cols, *[m.alias(f"_more{i}") for i, m in enumerate(more)]).mapInArrow(partial(_mapped, change), OUT)


def to_grey(frames: DataFrame) -> DataFrame:
    """frames with one channel. Frames must fit their data (see frames.checked)."""
    return _on(frames, grey)


def resize(frames: DataFrame, height: Column, width: Column) -> DataFrame:
    """frames in another size, by a cubic kernel."""
    return _on(frames, resized, height.cast("int"), width.cast("int"))


def first_frames(frames: DataFrame) -> DataFrame:
    """The frame with the least index of each file; found by its index, so pictures aren't shuffled to be compared."""
    first = frames.groupBy("file_id").agg(F.min("frame_index").alias("frame_index"))
    return frames.join(first, ["file_id", "frame_index"], "left_semi").select(*[x.split()[0] for x in OUT.split(", ")])


def thumbnails(frames: DataFrame, cap: int = 320) -> DataFrame:
    """Each file's first frame with its long edge at most ``cap``."""
    w, h = scalar.thumbnail(F.col("width"), F.col("height"), cap)
    return resize(first_frames(frames), h, w)


def as_png(frames: DataFrame) -> DataFrame:
    """(file_id, frame_index, png)."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for b in batches:
            made = [png(np.frombuffer(d, np.uint8).reshape(h, w, c)) for h, w, c, d in zip(*(b.column(i).to_pylist() for i in range(2, 6)))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(made, pa.binary())], ["file_id", "frame_index", "png"])

    return frames.select(*[x.split()[0] for x in OUT.split(", ")]).mapInArrow(encode, "file_id long, frame_index long, png binary")


def read_batches(frames: DataFrame, n: int) -> DataFrame:
    """(file_id, batch, indices, height, width, channels, data): runs of n frames as one array, in the order of their index; the last may be shorter.

    Frames of a file must have one shape; a batch holds n pictures in one task.
    """
    if n < 1:
        raise ValueError("n must be positive")
    # an equal share of each file's ranks: counted as ranks, as indices may have gaps
    from pyspark.sql.window import Window

    rank = F.row_number().over(Window.partitionBy("file_id").orderBy("frame_index")) - 1
    places = frames.select("file_id", "frame_index").withColumn("batch", F.floor(rank / n).cast("long"))
    rows = F.sort_array(F.collect_list(F.struct("frame_index", "data"))).alias("rows")
    g = frames.join(places, ["file_id", "frame_index"]).groupBy("file_id", "batch").agg(rows, *[F.max(c).alias(c) for c in ("height", "width", "channels")])
    data = F.expr("unhex(array_join(transform(rows, r -> hex(r.data)), ''))")
    return g.select("file_id", "batch", F.col("rows.frame_index").alias("indices"), "height", "width", "channels", data.alias("data"))


def written(frames: DataFrame, height: int, width: int, channels: int = 3) -> DataFrame:
    """(file_id, frames_written, first_refused): a writer takes frames in order until one doesn't fit its shape or data."""
    from . import checked

    c = checked(frames, height, width, channels)
    g = c.groupBy("file_id").agg(F.min(F.when(F.col("error").isNotNull(), F.col("frame_index"))).alias("first_refused"))
    n = c.join(g, "file_id").groupBy("file_id").agg(F.count_if(F.col("first_refused").isNull() | (F.col("frame_index") < F.col("first_refused"))).alias("frames_written"), F.first("first_refused").alias("first_refused"))
    return n

"""Removal of long repeated byte strings, by prefix-free parsing.

Texts are parsed into phrases that end where the rolling hash of a window of 16 bytes
triggers. A trigger depends on these bytes only, so equal strings are parsed alike, and where a
string of ``length`` bytes starts inside a phrase says how far its first trigger is. So a start is
the end of a phrase (a suffix of the dictionary's) followed by what the parse goes on with, and the
order of all starts is the order of these two together:

1. starts are taken in blocks, mostly one for each phrase (up to 128 starts, a third of ``length`` if that is
   less). The ``core`` is what all strings that start in a block share of the parse. A block with a core of
   its own repeats nothing; most text ends here;
2. if phrase and parse agree with another block's for all its strings, all its starts repeat. One block
   stands for all that are so equal, so highly repetitive text comes down to its distinct phrases in
   their distinct surroundings: the dictionary;
3. what is left is at the edges of repeats. For each core the phrase ends are sorted from the core
   backwards (the suffix array of the dictionary) and what follows the core forwards (that of the parse), each with the
   lengths that neighbours agree for. Two starts with the same distance to the core are neighbours in
   corpus order for ``length`` bytes if their phrase ends and their rests are, and all their
   distances are told from the two arrays.

Cores are counted with partial sums before any shuffle, so a passage in a third of all rows costs one
row a task. A hot core, with more than ``MOST`` different blocks at edges, isn't sorted in one task:
there each start is a group of its own, counted by hash with partial sums.

Where no trigger comes within ``length`` bytes a start is a block of its own. Such stretches are
mostly runs of a short period: what repeats inside one text is told there and then, and only one start
of each different string goes on.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .util import Scratch, beside, column, typed

GRAM = 16
#: More blocks than these at edges of one core are compared start by start; so many are sorted at a time.
MOST, SORTED = 4096, 20_000
_BLOCKS = "doc_id long, fp int, first int, last int, lead int, core long, reach long"


def _block(length: int) -> int:
    return min(128, length // 3)


def _every(length: int) -> int:
    """A trigger in so many places on average: few starts have none within ``length``."""
    return min(64, length // 6)


def triggers(data: bytes, every: int):
    """Ascending places of the windows of 16 bytes whose rolling hash is a trigger.

    The hash is the polynomial of the window's bytes modulo 2**64, built for all windows at once by doubling their length.
    """
    import numpy as np

    h, width, power = np.frombuffer(data, np.uint8).astype(np.uint64), 1, 0xD6E8FEB86659FD93
    if len(h) < GRAM:
        return np.zeros(0, np.int64)
    while width < GRAM:
        h = h[:-width] * np.uint64(power) + h[width:]
        width, power = 2 * width, power * power % 2**64
    h ^= h >> np.uint64(32)
    return np.flatnonzero((h * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) < np.uint64((1 << 24) // every))


def blocks(data: bytes, length: int) -> Iterator[tuple[int, int, int]]:
    """(first, last, q) of each block of starts; the core begins at q. q = -1 where there is no trigger near."""
    end = len(data) - length
    if end < 0:
        return
    at, lead, block = 0, length - GRAM, _block(length)
    for t in [*triggers(data, _every(length)).tolist(), None]:
        if t is None or t - at >= lead:  # too far off
            stop = min(end + 1, t - lead + 1 if t is not None else end + 1)
            for p in range(at, stop):
                yield p, p, -1
            at = max(at, stop)
            if t is None:
                return
        q = t - (t - at) // block * block
        while q <= t and at <= end:
            yield at, min(q, end), q
            at, q = q + 1, q + block
        if at > end:
            return


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def ranges(places: list[int]) -> Iterator[tuple[int, int]]:
    """(first, last) of the runs of ascending places."""
    for i, p in enumerate(places):
        if not i or places[i - 1] != p - 1:
            first = p
        if i + 1 == len(places) or places[i + 1] != p + 1:
            yield first, p


def parse(data: bytes, length: int) -> Iterator[tuple[int, int, int, int | None, int | None]]:
    """(first, last, lead, core, reach) of each block; the core begins lead bytes after first. core is None where starts are known to repeat inside the text."""
    from xxhash import xxh3_64_intdigest as digest

    core_n, view = length - _block(length) + 1, memoryview(data)
    alone: dict[int, list[int]] = {}
    for first, last, q in blocks(data, length):
        if q < 0:
            alone.setdefault(_signed(digest(view[first : first + length])), []).append(first)
        else:
            yield first, last, q - first, _signed(digest(view[q : q + core_n], 1)), _signed(digest(view[first : last + length], ((q - first) << 8) + q - last + 2))
    for hashed, places in alone.items():
        yield places[0], places[0], 0, hashed, hashed
    for first, last in ranges(sorted(p for places in alone.values() if len(places) > 1 for p in places)):
        yield first, last, 0, None, None


def _parse(length: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in _BLOCKS.split(", ")]
    types = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
    for b in batches:
        out: list[tuple] = []
        for doc, fp, text in zip(*(b.column(i).to_pylist() for i in range(3))):
            out += [(doc, fp, *block) for block in parse((text or "").encode("utf-8", "replace"), length)]
            if len(out) > 20000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)


_EDGES = "doc_id long, fp int, at int, low int, high int, core long, left binary, right binary"
_SPANS = "doc_id long, fp int, start int, end int"


def _edges(length: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each block at an edge: where its core is, the least and most bytes from a start to it, the bytes before the core and after it."""
    core_n = length - _block(length) + 1
    names = [x.split()[0] for x in _EDGES.split(", ")]
    types = [pa.int64(), *[pa.int32()] * 4, pa.int64(), pa.binary(), pa.binary()]
    for b in batches:
        out = []
        for doc, fp, edges, text in zip(*(b.column(i).to_pylist() for i in range(4))):
            data = text.encode("utf-8", "replace")
            for e in edges:
                at = e["first"] + e["lead"]
                out.append((doc, fp, at, at - e["last"], e["lead"], e["core"], data[e["first"] : at], data[at + core_n : e["last"] + length]))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)


def _order(cores, strings: list[bytes], width: int):
    """(order, agree): the order by core and bytes, and for how many bytes each agrees with the one before; -1 where the core changes."""
    import numpy as np

    table = np.full((len(strings), width), 255, np.uint8)  # no byte of UTF-8, so a string that has ended agrees with none
    for i, x in enumerate(strings):
        table[i, : len(x)] = np.frombuffer(x, np.uint8)
    keys = np.concatenate([cores.astype(">i8").view(np.uint8).reshape(-1, 8), table], 1)
    order = np.argsort(np.ascontiguousarray(keys).view(f"S{8 + width}").ravel(), kind="stable")
    same = table[order[1:]] == table[order[:-1]]
    agree = np.where(same.all(1), width, same.argmin(1))
    agree[cores[order[1:]] != cores[order[:-1]]] = -1
    return order, np.concatenate([[-1], agree])


def repeated_in_order(cores, lefts: list[bytes], rights: list[bytes], low, high, width: int):
    """A row for each block and a column for each distance 0..width to its core: whether the string there starts in another block too."""
    import numpy as np

    n = len(cores)
    by_left, left_agree = _order(cores, [x[::-1] for x in lefts], width)
    by_right, right_agree = _order(cores, rights, width)
    flags, left, right = np.zeros((n, width + 1), bool), np.zeros(n, np.int64), np.zeros(n, np.int64)
    for d in range(width + 1):
        some = np.flatnonzero((low <= d) & (d <= high))
        if len(some) < 2:
            continue
        # the stretches of the two arrays that agree for the d bytes before the core and the rest after it
        left[by_left] = np.cumsum(left_agree < d)
        right[by_right] = np.cumsum(right_agree < width - d)
        _, which, count = np.unique(left[some] * (n + 1) + right[some], return_inverse=True, return_counts=True)
        flags[some, d] = count[which] > 1
    return flags


def _sort(length: int, at_once: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans of the starts that repeat, of blocks that come in the order of their cores."""
    import numpy as np

    width = _block(length) - 1
    names, types = [x.split()[0] for x in _SPANS.split(", ")], [pa.int64(), pa.int32(), pa.int32(), pa.int32()]

    def told(rows: pa.Table) -> pa.RecordBatch:
        doc, fp, at, low, high, cores = (rows.column(i).to_numpy() for i in range(6))
        flags = repeated_in_order(cores, rows.column(6).to_pylist(), rows.column(7).to_pylist(), low, high, width)
        edge = np.diff(np.pad(flags, ((0, 0), (1, 1))).astype(np.int8), axis=1)
        (row, near), (_, beyond) = np.nonzero(edge == 1), np.nonzero(edge == -1)
        cols = doc[row], fp[row], at[row] - beyond + 1, at[row] - near + length
        return pa.RecordBatch.from_arrays([pa.array(c).cast(t) for c, t in zip(cols, types)], names)

    held: list[pa.RecordBatch] = []
    for b in batches:
        held.append(b)
        if sum(x.num_rows for x in held) >= at_once:
            rows = pa.Table.from_batches(held).combine_chunks()
            cores = rows.column(5).to_numpy()
            cut = int(np.searchsorted(cores, cores[-1]))  # the last core may go on
            if cut:
                yield told(rows.slice(0, cut))
            held = rows.slice(cut).to_batches()
    if held:
        yield told(pa.Table.from_batches(held).combine_chunks())


_STARTS = "doc_id long, fp int, core long, start int, start_hash long"


def _each(length: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A hash for each start in the blocks of hot cores."""
    from xxhash import xxh3_64_intdigest as digest

    width = _block(length) - 1
    names, types = [x.split()[0] for x in _STARTS.split(", ")], [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64()]
    for b in batches:
        for i in range(0, b.num_rows, 500):
            out = []
            for doc, fp, at, low, high, core, left, right in zip(*(c.to_pylist() for c in b.slice(i, 500).columns)):
                out += [(doc, fp, core, at - d, _signed(digest(left[len(left) - d :] + right[: width - d], d))) for d in range(low, high + 1)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)


def merged(spans: list) -> list[tuple[int, int]]:
    """The maximal runs that these [start, end) cover."""
    out: list[tuple[int, int]] = []
    for a, e in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((a, e))
    return out


def repeated_spans(docs: DataFrame, length: int = 400) -> DataFrame:
    """(doc_id, fp, spans): [start, end) of bytes in strings that start anywhere else too, not yet merged.

    fp is the CRC-32 of the text as a signed int; with doc_id it names a text.
    """
    if length < 4 * GRAM:
        raise ValueError(f"length must be at least {4 * GRAM}")
    spark = docs.sparkSession
    scratch = Scratch(spark)
    texts = docs.select("doc_id", "fp", "text").where(F.octet_length("text") >= length)
    parsed = scratch.save(texts.mapInArrow(partial(_parse, length), _BLOCKS))
    cores = scratch.save(parsed.groupBy("core").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("core"))
    again = scratch.save(parsed.join(cores, "core", "left_semi"))
    known = scratch.save(parsed.where("core IS NULL").select("doc_id", "fp", F.col("first").alias("start"), (F.col("last") + length).alias("end")))
    scratch.drop(parsed, cores)
    places = F.struct("doc_id", "fp", "first", "last", "lead")
    whole = again.groupBy("core", "reach").agg(F.count(F.lit(1)).alias("n"), F.min(places).alias("at")).where("n > 1")
    whole = scratch.save(whole.select("core", "reach", "at", F.lit(True).alias("whole")))
    told = scratch.save(again.join(whole.drop("at"), ["core", "reach"], "left"))
    scratch.drop(again)
    inside = told.where("whole").select("doc_id", "fp", F.col("first").alias("start"), (F.col("last") + length).alias("end"))
    edges = told.where("whole IS NULL").select("doc_id", "fp", "first", "last", "lead", "core")
    # an edge may repeat a start of blocks that repeat as a whole: one block stands for each of these
    sides = scratch.save(edges.select("core").distinct())
    stand = whole.join(sides, "core").select("at.*", "core")
    edges = scratch.save(edges.unionByName(stand).groupBy("doc_id", "fp").agg(F.collect_set(F.struct("first", "last", "lead", "core")).alias("edges")))
    rows = edges.join(texts.select("doc_id", "fp", "text"), ["doc_id", "fp"]).select("doc_id", "fp", "edges", "text")
    tried = scratch.save(rows.mapInArrow(partial(_edges, length), _EDGES))
    scratch.drop(edges, sides, whole)
    sizes = scratch.save(tried.groupBy("core").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    few = tried.join(sizes.where(F.col("n") <= MOST).select("core"), "core", "left_semi").select(*tried.columns)
    ordered = few.repartition("core").sortWithinPartitions("core").mapInArrow(partial(_sort, length, SORTED), _SPANS)
    hot = tried.join(sizes.where(F.col("n") > MOST).select("core"), "core", "left_semi").select(*tried.columns)
    each = scratch.save(hot.mapInArrow(partial(_each, length), _STARTS))
    met = each.groupBy("core", "start_hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("core", "start_hash")
    single = each.join(met, ["core", "start_hash"], "left_semi").select("doc_id", "fp", "start", (F.col("start") + length).cast("int").alias("end"))
    spans = inside.unionByName(ordered).unionByName(single).unionByName(known).groupBy("doc_id", "fp").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    spans = scratch.save(spans)
    scratch.drop(told, tried, sizes, each, known)
    return spans


def without(data: bytes, runs: list[tuple[int, int]]) -> bytes:
    """The bytes outside these ascending runs."""
    kept, at = [], 0
    for a, e in [*runs, (len(data), len(data))]:
        kept.append(data[at:a])
        at = e
    return b"".join(kept)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for doc, text, spans in zip(*(b.column(i).to_pylist() for i in range(3))):
            data = (text or "").encode("utf-8", "replace")
            runs = merged([(s["start"], s["end"]) for s in spans or []])
            rest = without(data, runs)
            rows.append((doc, len(data), sum(e - a for a, e in runs), len(runs), hashlib.sha256(rest).hexdigest(), rest.decode("utf-8", "ignore")))
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        cols = list(zip(*rows)) or [()] * len(types)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "text"])


def _named(doc_id: Column, text: Column) -> list[Column]:
    """What names a text: _id and fp."""
    fp = F.crc32(F.coalesce(text, F.lit(""))) - F.lit(2**31)
    return [F.coalesce(doc_id, F.lit(-(2**63))).alias("_id"), fp.cast("int").alias("fp")]


def cut_repeats(docs: DataFrame, length: int = 400) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, text: one row for each row of ``docs``.

    Each byte goes that a ``length``-byte string covers which also starts anywhere else,
    in the same or another row. Null text is empty. Matches never cross rows; a repeated
    row is an occurrence of its own. Other columns are ignored. text is
    what is left, without the characters that a cut splits; kept_sha256 is of the bytes. An empty table gives an empty result.
    """
    docs = typed(docs, doc_id="long", text="string").select("doc_id", "text", *_named(F.col("doc_id"), F.col("text")))
    spans = repeated_spans(docs.select(F.col("_id").alias("doc_id"), "fp", "text"), length)
    joined = docs.join(spans.withColumnRenamed("doc_id", "_id"), ["_id", "fp"], "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(_cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, text string")


def _retext(text: int, n_chars: int | None, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        last = b.num_columns - 1
        cols = [b.column(i) for i in range(last)]
        out = []
        for t, spans in zip(cols[text].to_pylist(), b.column(last).to_pylist()):
            if spans:
                t = without(t.encode("utf-8", "replace"), merged([(s["start"], s["end"]) for s in spans])).decode("utf-8", "ignore")
            out.append(t)
        cols[text] = pa.array(out, cols[text].type)
        if n_chars is not None:
            cols[n_chars] = pa.array([None if t is None else len(t) for t in out], cols[n_chars].type)
        yield pa.RecordBatch.from_arrays(cols, b.schema.names[:last])


def drop_repeats(docs: DataFrame, length: int = 400) -> DataFrame:
    """``docs`` with the repeated bytes taken out of text and n_chars counted anew.

    Every row stays, a text that is repeated as a whole becomes empty, null stays null.
    A character that a cut splits goes. Other columns may have any names. A table without
    a text is returned as it is; an empty one gives an empty result.
    """
    if "text" not in {c.lower() for c in docs.columns}:
        return docs
    spans = repeated_spans(typed(docs, doc_id="long", text="string").select(*_named(F.col("doc_id"), F.col("text")), "text").withColumnRenamed("_id", "doc_id"), length)
    own_id, own_fp = _named(column(docs, "doc_id", "long"), column(docs, "text", "string"))
    left, right = beside(docs, doc_id=own_id, fp=own_fp), spans
    joined = left.join(right, ["doc_id", "fp"], "left").select(*[F.col("row").getField(c).alias(f"c{i}") for i, c in enumerate(docs.columns)], "spans")
    at = [c.lower() for c in docs.columns]
    cut = partial(_retext, at.index("text"), at.index("n_chars") if "n_chars" in at else None)
    plain = T.StructType([T.StructField(f"c{i}", f.dataType, True) for i, f in enumerate(docs.schema)])
    return joined.mapInArrow(cut, plain).toDF(*docs.columns)

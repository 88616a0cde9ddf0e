"""Mixture-controlled packing.

Documents wait in one queue for each source. Windows of ``window`` tokens are filled by
deficit round-robin: every queue is owed its share of each window, and what rounding
left it short of is carried to the next window. Where ``p`` of the T tokens of a phase have
been packed, a queue has been served floor(p*B/T) - floor(p*A/T) of them, A and B being the
tokens that the queues before it and up to it give to the phase. It is owed one token a window at least,
so this never falls from window to window, its deficit never exceeds one token, every window is full, and a task can tell the windows of its documents from a few
sums, as the deficit at any window follows from them: it is carried across partitions by arithmetic.

Without targets there is one phase, and shares are the sources' shares of all tokens; a source
that would be owed less than one token a window waits in a common queue with others. With
targets a phase ends where a queue runs dry, and the queues left share the windows in the
proportions of their targets, so every token is still packed once (see ``phases``).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from fractions import Fraction
from functools import partial

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .tokens import encoder
from .util import Scratch, typed

END = (0).to_bytes(4, "little")
_TOKENS = "doc_id long, queue string, block int, at long, n long, ids binary"
_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source_queue string, window_id long"


def _tokenize(path: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids of each document, and how many of the same queue came before it in this task.

    Where every id fits two bytes they are kept as such.
    """
    enc, before, block = encoder(path), {}, TaskContext.get().partitionId()
    import numpy as np

    for whole in batches:
        for i in range(0, whole.num_rows, 500):
            b = whole.slice(i, 500)
            docs, queues = b.column(0), b.column(1).to_pylist()
            ids, at, n = [], [], []
            for q, text in zip(queues, b.column(2).to_pylist()):
                got = np.frombuffer(enc.encode(text or "") + END, "<u4")
                at.append(before.get(q, 0))
                n.append(len(got))
                before[q] = at[-1] + len(got)
                ids.append(b"2" + got.astype("<u2").tobytes() if got.max() < 65536 else b"4" + got.tobytes())
            yield pa.RecordBatch.from_arrays([docs, pa.array(queues, pa.string()), pa.array([block] * len(n), pa.int32()), pa.array(at, pa.int64()), pa.array(n, pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "queue", "block", "at", "n", "ids"])


def phases(tokens: dict[str, int], targets: dict[str, float], window: int) -> list[dict[str, int]]:
    """The tokens that each queue gives to each phase.

    In a phase the queues that hold tokens are served in the proportions of their targets; it ends
    where the first of them runs dry. A queue that is owed less than one token a window waits for
    a phase in which it is owed more. Those left at the end, as their target is 0, come one after another.
    """
    share = {q: Fraction(repr(targets.get(q, 0))) for q in tokens}
    left, out = {q: n for q, n in tokens.items() if n}, []
    while left:
        owed = {q: share[q] for q in left if share[q] > 0}
        owed = {q: w for q, w in owed.items() if w * window >= sum(owed.values())} or {min(left): Fraction(1)}
        lasts = min(Fraction(left[q]) / w for q, w in owed.items())
        # whole tokens: what each is owed, rounded down; the one that runs dry gives all it has
        phase = {q: int(w * lasts) for q, w in owed.items()}
        while any(n * window < sum(phase.values()) for n in phase.values()):
            phase = {q: n for q, n in phase.items() if n * window >= sum(phase.values())}
        out.append(phase)
        left = {q: n for q in left if (n := left[q] - phase.get(q, 0))}
    return out


def share_windows(first: int, n: int, a: int, b: int, total: int, window: int, origin: int = 0) -> Iterator[tuple[int, int, int]]:
    """(window, tokens, place among all tokens) of tokens first..first+n of the queue between a and b, in a phase of ``total`` tokens from place ``origin`` on."""
    at = lambda k: min(max(k * window - origin, 0), total)
    served = lambda k: (p := at(k)) * b // total - p * a // total
    k = (origin + first * total // (b - a)) // window if b > a else 0
    while served(k) > first:
        k -= 1
    while served(k + 1) <= first:
        k += 1
    while n > 0:
        begin, end = at(k), at(k + 1)
        ahead = end * a // total - begin * a // total
        take = min(n, served(k + 1) - first)
        if take > 0:
            yield k, take, origin + begin + ahead + first - served(k)
            first, n = first + take, n - take
        k += 1


def in_phases(queue: str, first: int, n: int, plan: list[dict[str, int]], window: int) -> Iterator[tuple[int, int, int]]:
    """share_windows() of tokens first..first+n of a queue, through the phases that it gives tokens to."""
    origin, gone = 0, 0
    for phase in plan:
        total, own = sum(phase.values()), phase.get(queue, 0)
        lo, hi = max(first, gone), min(first + n, gone + own)
        if lo < hi:
            a = sum(c for q, c in phase.items() if q < queue)
            yield from share_windows(lo - gone, hi - lo, a, a + own, total, window, origin)
        origin, gone = origin + total, gone + own


def sequences(place: int, n: int, total: int, size: int) -> Iterator[tuple[int, int, int]]:
    """(sequence, offset, tokens) of n tokens from this place on.

    The last tokens that don't fill a sequence go to sequences whose lengths are powers
    of two, largest first, so that no sequence needs padding.
    """
    whole = total // size
    while n > 0:
        s, o = divmod(place, size)
        room = size - o
        if s == whole:
            rest, o = total - whole * size, place - whole * size
            start, i = 0, 0
            for bit in reversed(range(rest.bit_length())):
                if rest >> bit & 1:
                    if o < start + (1 << bit):
                        break
                    start, i = start + (1 << bit), i + 1
            s, room, o = whole + i, start + (1 << bit) - o, o - start
        take = min(n, room)
        yield s, o, take
        place, n = place + take, n - take


def _pieces(size: int, window: int, plan: list[dict[str, int]] | None, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import numpy as np

    names = [x.split()[0] for x in _PIECES.split(", ")]
    types = [pa.string() if x.split()[1] == "string" else pa.int64() for x in _PIECES.split(", ")]
    for whole in batches:
        for i in range(0, whole.num_rows, 500):
            b, rows = whole.slice(i, 500), []
            for doc, queue, at, n, raw, base, line, a, e, total in zip(*(c.to_pylist() for c in b.columns)):
                ids = raw[1:] if raw[:1] == b"4" else np.frombuffer(raw, "<u2", offset=1).astype("<u4").tobytes()
                start = 0
                told = share_windows(base + at, n, int(a), int(e), int(total), window) if plan is None else in_phases(line, base + at, n, plan, window)
                for k, take, place in told:
                    for s, o, m in sequences(place, take, int(total), size):
                        rows.append((doc, start, m, zlib.crc32(ids[4 * start : 4 * (start + m)]), n, s, o, queue, k))
                        start += m
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)


def pack(docs: DataFrame, tokenizer: str, size: int = 1024, window: int = 64 * 1024, source: str = "source", targets: dict[str, float] | None = None) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, source_queue, window_id.

    Null and empty texts are one token, the end mark 0. Documents without a source share
    a queue. Repeated rows and equal ids are packed once each; other columns are ignored.
    An empty table gives an empty result. ``window`` is a multiple of ``size``.

    ``targets`` gives sources' shares of each window, in any unit; without it each has its share
    of all tokens. Sources that aren't named wait in a common queue whose share is what is
    left to 1, none if the targets come to 1 or more. If a source runs dry, those that
    still hold tokens share the windows in the proportions of their targets.
    """
    if window % size:
        raise ValueError("window must be a multiple of size")
    if targets is not None and (any(not 0 <= x < float("inf") for x in targets.values()) or not sum(targets.values())):
        raise ValueError("targets must be finite, none below 0 and some above 0")
    spark = docs.sparkSession
    scratch = Scratch(spark)
    rows = typed(docs, doc_id="long", **{source: "string"}, text="string")
    rows = rows.select("doc_id", F.coalesce(F.concat(F.lit("="), F.col(source)), F.lit("-")).alias("queue"), "text")
    held = scratch.save(rows.mapInArrow(partial(_tokenize, tokenizer), _TOKENS))
    parts = scratch.save(held.groupBy("queue", "block").agg(F.sum("n").alias("n")))
    total = parts.agg(F.sum("n")).first()[0] or 0
    sums = parts.groupBy("queue").agg(F.sum("n").alias("tokens"))
    small = F.col("tokens").cast("decimal(38,0)") * window < F.lit(total).cast("decimal(38,0)")
    plan = None
    if targets is not None:
        wanted = {f"={k}": v for k, v in targets.items()}
        named = sums.withColumn("served_as", F.when(F.col("queue").isin(list(wanted)), F.col("queue")).otherwise(F.lit("")))
        held_by = {r[0]: r[1] for r in named.groupBy("served_as").agg(F.sum("tokens")).collect()}  # a row for each target and one more
        plan = phases(held_by, wanted | {"": max(0.0, 1 - sum(wanted.values()))}, window)
    else:
        named = sums.withColumn("served_as", F.when(small, F.lit("")).otherwise(F.col("queue")))
    # at most ``window`` queues are owed a token a window, so these sums fit one task
    lines = named.groupBy("served_as").agg(F.sum("tokens").alias("tokens"))
    least = lines.where(F.col("served_as") != "").agg(F.min(F.struct("tokens", "served_as")).alias("m")).select("m.served_as").first()
    alone = lines.where((F.col("served_as") == "") & (F.col("tokens").cast("decimal(38,0)") * window < F.lit(total).cast("decimal(38,0)"))).count()
    if plan is None and alone and least and least[0] is not None:  # even together they are owed less than a token
        named = named.withColumn("served_as", F.when(F.col("served_as") == "", F.lit(least[0])).otherwise(F.col("served_as")))
        lines = named.groupBy("served_as").agg(F.sum("tokens").alias("tokens"))
    upto = F.sum("tokens").over(Window.orderBy("served_as").rowsBetween(Window.unboundedPreceding, 0))
    lines = lines.withColumn("b", upto).withColumn("a", F.col("b") - F.col("tokens"))
    before = F.sum("n").over(Window.partitionBy("served_as").orderBy("queue", "block").rowsBetween(Window.unboundedPreceding, -1))
    base = parts.join(named.select("queue", "served_as"), "queue").withColumn("base", F.coalesce(before, F.lit(0)))
    base = scratch.save(base.join(lines, "served_as").select("queue", "block", "base", "served_as", "a", "b"))
    out = held.join(base, ["queue", "block"]).select("doc_id", "queue", "at", "n", "ids", "base", "served_as", "a", "b", F.lit(total).alias("total"))
    return out.mapInArrow(partial(_pieces, size, window, plan), _PIECES)

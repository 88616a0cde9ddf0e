"""MinHash near-duplicates by a signature-coordinate inverted join.

A document's signature has ``K`` coordinates. It is posted under each (coordinate, value)
pair, and two documents that share at least ``MATCHES`` pairs are candidates; the links
among them are confirmed on the full shingle sets.

Sharing MATCHES of K pairs means sharing one of any K - MATCHES + 1 pairs when all
documents order theirs alike. They are ordered by how many documents post them, so a
document is posted only under its rarest pairs, and skips pairs that nobody else has.
A true link at similarity 0.8 has fewer than 33 of 64 equal coordinates once in two
million times.

Documents with equal sets stand for each other. Only what joins components matters, so a
few times each posting list takes a head. A document's lists are merged and the collisions
with each head counted; it is compared with the head it collides with most, and takes that
head's label if they are similar. Lists whose members all have one label are skipped from then
on. At last all pairs in the open lists are compared whose labels differ, unless their
signatures or parity sketches rule out a link: each member of a set flips one bit of its
sketch, so two sketches never differ in more bits than the sets in members. No list is
expanded into pairs of documents already known to belong together.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial, reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import components
from .util import Scratch, beside, column, fingerprint, gapless, typed, unpacked

K, MATCHES = 64, 33
#: Longs of a parity sketch.
PARITY = 16
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def shingles(text: str | None, width: int) -> set[bytes]:
    """Distinct runs of ``width`` words; fewer words count as one run, none as no run."""
    words = (text or "").encode("utf-8", "replace").translate(_LOWER).split()
    if len(words) < width:
        return {b" ".join(words)} if words else set()
    return set(map(b" ".join, zip(*(words[i:] for i in range(width)))))


def _hashes(text: str | None, width: int):
    import numpy as np
    from xxhash import xxh3_64_intdigest

    found = shingles(text, width)
    return np.fromiter(map(xxh3_64_intdigest, found), np.uint64, len(found))


def _family():
    import numpy as np

    rng = np.random.default_rng(20)
    return rng.integers(1, 2**63, K, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 2**63, K, dtype=np.uint64)


def _sums(h) -> tuple[int, int]:
    """Two sums over the hashes that stand for the set."""
    import numpy as np

    m = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    both = np.array([np.bitwise_xor.reduce(h), np.add.reduce(m ^ (m >> np.uint64(32)))], np.uint64)
    return tuple(both.view(np.int64).tolist())


def _parity(h):
    """Longs whose bits tell whether an odd number of hashes falls on them."""
    import numpy as np

    odd = np.bincount(((h ^ (h >> np.uint64(31))) % np.uint64(64 * PARITY)).astype(np.int64), minlength=64 * PARITY) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _sign(width: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, n, f1, f2, pairs, odd): set size, two sums that stand for the set, a long for each coordinate and value, a parity sketch."""
    import numpy as np

    mul, add = _family()
    low, each = np.uint64(K - 1), np.arange(K, dtype=np.uint64)
    for b in batches:
        for i in range(0, b.num_rows, 1000):
            part = b.slice(i, 1000)
            n, f1, f2, sigs, odd = [], [], [], [], []
            for text in part.column(1).to_pylist():
                h = _hashes(text, width)
                n.append(len(h))
                odd.append(_parity(h))
                for to, x in zip((f1, f2), _sums(h)):
                    to.append(x)
                sig = np.full(K, 2**64 - 1, np.uint64)
                for j in range(0, len(h), 4096):
                    sig = np.minimum(sig, (h[j : j + 4096, None] * mul + add).min(0))
                sigs.append((sig & ~low) | each)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(n, pa.int64()), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()),
                 pa.FixedSizeListArray.from_arrays(pa.array(np.concatenate(sigs).view(np.int64)), K).cast(pa.list_(pa.int64())),
                 pa.FixedSizeListArray.from_arrays(pa.array(np.concatenate(odd)), PARITY).cast(pa.list_(pa.int64()))],
                ["doc_id", "n", "f1", "f2", "pairs", "odd"],
            )


def _sets(width: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import numpy as np

    for b in batches:
        for i in range(0, b.num_rows, 500):
            part = b.slice(i, 500)
            sets = [np.sort(_hashes(t, width)).tobytes() for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.binary())], ["id", "set"])


_PAIRS = "a long, b long, la long, lb long"


def _confirm(percent: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs (a, b) whose sets are similar enough, with their labels."""
    import numpy as np

    for b in batches:
        keep = []
        for x, y in zip(b.column(4), b.column(5)):
            x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            small, large = sorted((x, y), key=len)
            if 100 * len(small) < percent * len(large):
                keep.append(False)
                continue
            at = np.minimum(np.searchsorted(large, small), len(large) - 1)
            both = int((large[at] == small).sum())
            keep.append(100 * both >= percent * (len(x) + len(y) - both))
        yield pa.RecordBatch.from_arrays([b.column(i) for i in range(4)], ["a", "b", "la", "lb"]).filter(pa.array(keep, pa.bool_()))


#: So many ids of documents to compare are sent to every executor; more are joined by a shuffle.
SENT = 1_000_000
_WORDS = [f"w{i}" for i in range(K // 8)]


def _packed(pairs: str) -> list:
    """A byte of each coordinate, eight to a long."""
    return [F.expr(" | ".join(f"shiftleft(shiftright({pairs}[{8 * i + j}], 24) & 255, {8 * j})" for j in range(8))).alias(w) for i, w in enumerate(_WORDS)]


def _differ(x: str, y: str) -> str:
    """How many coordinates of x and y differ; a byte that differs leaves a bit in its lowest place."""
    terms = []
    for w in _WORDS:
        v = f"({x}.{w} ^ {y}.{w})"
        for n in (4, 2, 1):
            v = f"({v} | shiftrightunsigned({v}, {n}))"
        terms.append(f"bit_count({v} & {0x0101010101010101}L)")
    return " + ".join(terms)


def _alike(x: str, y: str, percent: int) -> str:
    """Whether sizes and coordinates of x and y allow a link."""
    return f"100 * least({x}.n, {y}.n) >= {percent} * greatest({x}.n, {y}.n) AND {_differ(x, y)} <= {K - MATCHES}"


def _near_sets(x: str, y: str, percent: int) -> str:
    """Whether the parity sketches of x and y allow a link."""
    bits = " + ".join(f"bit_count({x}.odd[{i}] ^ {y}.odd[{i}])" for i in range(PARITY))
    return f"{100 + percent} * ({bits}) <= {100 - percent} * ({x}.n + {y}.n)"


def _confirmed(scratch: Scratch, docs: DataFrame, pairs: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b, la, lb) whose full sets are similar enough."""
    pairs = scratch.save(pairs)
    ids = scratch.save(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct())
    sent = F.broadcast(ids) if ids.count() <= SENT else ids
    sets = scratch.save(docs.select(F.col("doc_id").alias("id"), "text").join(sent, "id", "left_semi").mapInArrow(partial(_sets, width), "id long, set binary"))
    one, two = (sets.select(F.col("id").alias(x), F.col("set").alias(f"set_{x}")) for x in "ab")
    full = pairs.join(one, "a").join(two, "b").select("a", "b", "la", "lb", "set_a", "set_b")
    found = scratch.save(full.mapInArrow(partial(_confirm, percent), _PAIRS))
    scratch.drop(sets, ids, pairs)
    return found


def links(scratch: Scratch, docs: DataFrame, signed: DataFrame, width: int, percent: int, pivots: int = 2) -> DataFrame:
    """(a, b): edges between class representatives that connect what is similar, and nothing else."""
    pairs = signed.where("n > 0 AND doc_id = rep").select(F.col("doc_id").alias("id"), F.explode("pairs").alias("pair"))
    common = scratch.save(pairs.groupBy("pair").agg(F.count(F.lit(1)).alias("df")).where("df > 1"))
    shared = pairs.join(common, "pair").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("df", "pair"))).alias("p"))
    # pairs that nobody else posts come first in the order: only what is left of the prefix is posted
    left = F.size("p") - (MATCHES - 1)
    lists = scratch.save(shared.where(left > 0).select("id", F.transform(F.slice("p", F.lit(1), left), lambda p: p["pair"]).alias("posted")))
    scratch.drop(common)
    signs = signed.where("n > 0 AND doc_id = rep").select(F.col("doc_id").alias("id"), "n", *_packed("pairs"), "odd")
    signs = scratch.save(signs.join(lists.select("id"), "id", "left_semi"))
    likely = F.expr(f"{_alike('x', 'y', percent)} AND {_near_sets('x', 'y', percent)}")

    placed, found = lists.select("id", F.col("id").alias("label"), F.explode("posted").alias("pair")), []
    for i in range(pivots):
        # the smallest id first, then others by hash, so that lists of the same documents take the same head
        head = F.struct((F.col("id") if i == 0 else F.xxhash64("id", F.lit(i))).alias("o"), F.col("id").alias("to"), F.col("label").alias("lb"))
        heads = placed.groupBy("pair").agg(F.min(head).alias("h"), F.min("label").alias("lo"), F.max("label").alias("hi"))
        met = scratch.save(placed.join(heads.where("lo <> hi").select("pair", "h.to", "h.lb"), "pair"))
        hits = met.where("label <> lb").groupBy("id", "to").agg(F.count(F.lit(1)).alias("c"), F.min("label").alias("la"), F.min("lb").alias("lb"))
        best = F.max(F.struct("c", F.bitwise_not("to").alias("o"), F.struct("to", "la", "lb").alias("t"))).alias("m")
        tries = hits.groupBy("id").agg(best).select(F.col("id").alias("a"), F.col("m.t.to").alias("b"), "m.t.la", "m.t.lb")
        tries = tries.join(signs.alias("x"), F.col("a") == F.col("x.id")).join(signs.alias("y"), (F.col("b") == F.col("y.id")) & likely)
        new = _confirmed(scratch, docs, tries.select("a", "b", "la", "lb"), width, percent)
        found.append(new.select(F.col("la").alias("a"), F.col("lb").alias("b")))
        # labels move to smaller ones that they are tied to, two steps at once
        moves = scratch.save(new.groupBy(F.greatest("la", "lb").alias("label")).agg(F.min(F.least("la", "lb")).alias("m")))
        further = moves.join(moves.select(F.col("label").alias("m"), F.col("m").alias("n")), "m", "left").select("label", F.coalesce("n", "m").alias("m"))
        placed = scratch.save(met.select("id", "label", "pair").join(further, "label", "left").select("id", F.coalesce("m", "label").alias("label"), "pair"))
        scratch.drop(met)
    open_ = placed.groupBy("pair").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("pair")
    rows = scratch.save(placed.join(open_, "pair", "left_semi").join(signs, "id"))
    rest = rows.alias("x").join(rows.alias("y"), (F.col("x.pair") == F.col("y.pair")) & F.expr("x.id < y.id AND x.label <> y.label") & likely)
    rest = rest.select(F.col("x.id").alias("a"), F.col("y.id").alias("b"), F.col("x.label").alias("la"), F.col("y.label").alias("lb")).distinct()
    found.append(_confirmed(scratch, docs, rest, width, percent).select(F.col("la").alias("a"), F.col("lb").alias("b")))
    scratch.drop(rows, signs, placed, lists)
    return reduce(DataFrame.unionByName, found)


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row for each row of ``docs``.

    Links are sets of ``width``-word shingles with 100 * intersection >= percent * union.
    component_id is the smallest doc_id reachable over links; null texts and texts without
    words are linked with nothing. Rows with equal ids count as one document. A row without
    an id is linked with equal sets only; its component_id is theirs or null, and it is kept
    if that is null. Other columns are ignored. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    docs = typed(docs, doc_id="long", text="string")
    signed = scratch.save(docs.mapInArrow(partial(_sign, width), "doc_id long, n long, f1 long, f2 long, pairs array<long>, odd array<long>"))
    same = signed.where("n > 0").groupBy("n", "f1", "f2").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("c")).where("c > 1").drop("c")
    signed = scratch.save(signed.join(same, ["n", "f1", "f2"], "left").withColumn("rep", F.coalesce("rep", "doc_id")))
    again = signed.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).where("a <> b").select("a", "b")
    found = links(scratch, docs, signed, width, percent).unionByName(again)
    comps = components(scratch, found)
    out = signed.select("doc_id", "rep", "n").join(comps.withColumnRenamed("id", "rep"), "rep", "left")
    out = out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "rep").alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _own_ids(scratch: Scratch, docs: DataFrame) -> tuple[DataFrame | None, DataFrame | None]:
    """(id, h1, h2, own) for texts whose id is null or names other texts too, and (own) of texts that stand in several rows.

    own is a number that no other text has as its id; any other text's own is its id. None stands for no rows.
    """
    named = typed(docs, doc_id="long", text="string").select(F.col("doc_id").alias("id"), *fingerprint("text"))
    keys = scratch.save(named.groupBy("id", "h1", "h2").agg(F.count(F.lit(1)).alias("n")))
    shared = keys.where("id IS NOT NULL").groupBy("id").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("id")
    odd = scratch.save(keys.where("id IS NULL").unionByName(keys.join(shared, "id", "left_semi")))
    rows = odd.count()
    lo, hi = keys.agg(F.min("id"), F.max("id")).first()
    if lo is None or hi + rows < 2**63:
        first = 0 if lo is None else hi + 1
    elif lo - rows >= -(2**63):
        first = lo - rows
    else:  # no such stretch of numbers is free, so all texts are numbered anew
        odd, rows, first = keys, keys.count(), 0
    if rows:
        own = (F.col("_rank") + F.lit(first).cast("long")).alias("own")
        odd = scratch.save(gapless(scratch, odd, [], [], ["id", "h1", "h2"], rows, "_rank").select("id", "h1", "h2", own))
    else:
        odd = None
    many = keys.where("n > 1")
    if not many.limit(1).count():
        return odd, None
    if odd is None:
        return odd, scratch.save(many.select(F.col("id").alias("own")))
    left, right = many.alias("l"), odd.alias("r")
    same = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in ("id", "h1", "h2")]
    return odd, scratch.save(left.join(right, same, "left").select(F.coalesce("r.own", "l.id").alias("own")))


def _with_own(docs: DataFrame, odd: DataFrame | None) -> DataFrame:
    """Each row of ``docs`` (see beside()) with its text and own, see _own_ids()."""
    id_, text = column(docs, "doc_id", "long"), column(docs, "text", "string")
    if odd is None:
        return beside(docs, own=id_, text=text)
    h1, h2 = fingerprint(text)
    left, right = beside(docs, id=id_, text=text, h1=h1, h2=h2).alias("l"), odd.alias("r")
    same = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in ("id", "h1", "h2")]
    return left.join(right, same, "left").select("l.row", F.coalesce("r.own", "l.id").alias("own"), "l.text")


def drop_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """One row of each component, with all its columns.

    Here each text is a document of its own: ids may be null or name several texts, and of
    rows with equal ids and texts one stays. Null texts, texts without words and rows of a table
    without a text are linked with nothing. Other columns may have any names. An empty table gives an
    empty result.
    """
    scratch = Scratch(docs.sparkSession)
    odd, many = _own_ids(scratch, docs)
    rows = _with_own(docs, odd)
    texts = rows.select(F.col("own").alias("doc_id"), "text")
    kept = near_duplicates(scratch.save(texts) if odd is not None else texts, **options).where("kept").select(F.col("doc_id").alias("own")).distinct()
    left = rows.join(kept, "own", "left_semi")
    if many is not None:
        left = left.join(many, "own", "left_anti").unionByName(left.join(many, "own", "left_semi").dropDuplicates(["own"]))
    return unpacked(left, docs.columns)

"""Benchmark decontamination with spaced seeds.

Test and training texts become token hashes. A seed hashes six of twelve token positions,
by three fixed masks of two blocks of three:

    ######......   ###...###...   ###......###

If two windows of twelve tokens differ in at most two places, two of their four blocks are
equal, and these are the blocks of some mask at some shift: so no overlap of ten equal tokens
in twelve places is missed. Seeds of both sides are joined; around each hit the
item is laid over the document on that diagonal, and it counts if some window of twelve
has ten equal tokens. Items of 1 to 11 tokens must occur whole as they are; where the
benchmark has items of under six tokens, a mask as long as each such item is added for them.
Items without a token match nothing.

DataFrame functions only. The seeds of the benchmark go to every executor while there are
at most ``SENT``; a longer list is joined by a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .util import Scratch, beside, column, typed, unpacked

WINDOW, EQUAL = 12, 10
MASKS = ((0, 1, 2, 3, 4, 5), (0, 1, 2, 6, 7, 8), (0, 1, 2, 9, 10, 11))
#: So many seeds of 40 bytes are sent to every executor.
SENT = 1_000_000


def token_hashes(text: Column) -> Column:
    """A hash for each lower-case run of letters, marks and digits."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{M}\p{N}]+"), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def _seeded(df: DataFrame, keys: list[str], masks: list[tuple], seed: str, at: str) -> DataFrame:
    """A row for each seed of the token hashes ``h`` by each mask that fits: keys, the seed, where it begins."""
    n = F.size("h")
    places = df.where(n > 0).select(*keys, "h", F.explode(F.sequence(F.lit(0), n - 1)).alias(at))
    each = [F.when(F.col(at) + m[-1] < n, F.xxhash64(F.lit(len(m)), F.lit(i), *[F.get("h", F.col(at) + k) for k in m])) for i, m in enumerate(masks)]
    return places.select(*keys, at, F.explode(F.array(*each)).alias(seed)).where(F.col(seed).isNotNull())


_EQUAL = "filter(sequence(greatest(0, -diag), least(size(ih), size(h) - diag) - 1), i -> get(h, i + diag) = get(ih, i))"
_NEAR = f"CASE WHEN size(ih) < {WINDOW} THEN size(eq) = size(ih) WHEN size(eq) < {EQUAL} THEN false ELSE exists(sequence(0, size(eq) - {EQUAL}), j -> get(eq, j + {EQUAL - 1}) - get(eq, j) < {WINDOW}) END"


def _texts(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.coalesce("doc_id", F.lit(-(2**63))).alias("_id"), F.crc32(text).alias("_fp"), F.col("doc_id"), text.alias("text"))


def overlaps(scratch: Scratch, texts: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(_id, _fp, item_id, n_equal): the items found in each text; n_equal is the most equal tokens on a diagonal.

    Items with the same tokens stand for each other under their smallest id.
    """
    items = typed(benchmark, item_id="long", text="string").select("item_id", token_hashes(F.coalesce("text", F.lit(""))).alias("ih"))
    items = scratch.save(items.groupBy("ih").agg(F.min("item_id").alias("item_id")).where(F.size("ih") > 0))
    least = len(MASKS[0])
    short = [r[0] for r in items.where(F.size("ih") < least).select(F.size("ih")).distinct().collect()]  # at most five lengths
    masks = [*MASKS, *(tuple(range(n)) for n in sorted(short))]
    own = items.withColumnRenamed("ih", "h")
    seeds = _seeded(own.where(F.size("h") >= least), ["item_id"], masks[: len(MASKS)], "seed", "ipos")
    if short:  # an item is told by the mask of its own length
        whole = [F.when(F.size("h") == len(m), F.xxhash64(F.lit(len(m)), F.lit(len(MASKS) + i), *[F.get("h", F.lit(k)) for k in m])) for i, m in enumerate(masks[len(MASKS) :])]
        seeds = seeds.unionByName(own.where(F.size("h") < least).select("item_id", F.lit(0).alias("ipos"), F.coalesce(*whole).alias("seed")))
    seeds = scratch.save(seeds)
    n_seeds = seeds.count()
    tokens = texts.select("_id", "_fp", token_hashes(F.col("text")).alias("h"))
    placed = _seeded(tokens, ["_id", "_fp"], masks, "seed", "pos")
    hits = placed.join(F.broadcast(seeds) if n_seeds <= SENT else seeds, "seed").select("_id", "_fp", "item_id", (F.col("pos") - F.col("ipos")).alias("diag"))
    hits = scratch.save(hits.distinct())
    hit = hits.join(F.broadcast(items) if n_seeds <= SENT else items, "item_id")
    own = tokens.join(hits.select("_id", "_fp").distinct(), ["_id", "_fp"], "left_semi").dropDuplicates(["_id", "_fp"])
    laid = hit.join(own, ["_id", "_fp"]).select("_id", "_fp", "item_id", "ih", F.expr(_EQUAL).alias("eq"))
    near = laid.where(F.expr(_NEAR)).groupBy("_id", "_fp", "item_id").agg(F.max(F.size("eq")).alias("n_equal"))
    return scratch.save(near)


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, contaminated, n_items, items, n_equal: one row for each row of ``docs``.

    items: ids of the items found, ascending, joined by commas (of items with the same
    tokens the smallest); n_equal: the most equal tokens of one of them. Null and empty
    texts hold nothing. Each row is judged by its own text, repeated ids too; other columns
    are ignored. An empty table gives an empty result, an empty benchmark finds nothing.
    """
    scratch = Scratch(docs.sparkSession)
    texts = _texts(typed(docs, doc_id="long", text="string"))
    found = overlaps(scratch, texts, benchmark)
    told = found.groupBy("_id", "_fp").agg(F.sort_array(F.collect_list("item_id")).alias("items"), F.max("n_equal").cast("long").alias("n_equal"))
    out = texts.select("_id", "_fp", "doc_id").join(told, ["_id", "_fp"], "left")
    n = F.coalesce(F.size("items"), F.lit(0))
    n = F.when(F.col("items").isNull(), 0).otherwise(n).cast("long")
    return out.select("doc_id", (n > 0).alias("contaminated"), n.alias("n_items"), F.coalesce(F.concat_ws(",", F.col("items").cast("array<string>")), F.lit("")).alias("items"), F.coalesce("n_equal", F.lit(0)).cast("long").alias("n_equal"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows whose own text holds no item, with all their columns.

    Null and empty texts hold nothing; ids may repeat or be null; other columns may have any names.
    An empty table gives an empty result, an empty benchmark leaves all rows.
    """
    scratch = Scratch(docs.sparkSession)
    found = overlaps(scratch, _texts(typed(docs, doc_id="long", text="string")), benchmark).select("_id", "_fp").distinct()
    key = F.coalesce(column(docs, "doc_id", "long"), F.lit(-(2**63)))
    fp = F.crc32(F.coalesce(column(docs, "text", "string"), F.lit("")))
    return unpacked(beside(docs, _id=key, _fp=fp).join(found, ["_id", "_fp"], "left_anti"), docs.columns)

"""Balanced label propagation over equal texts.

Documents with the same text are linked. Every document starts in a shard by the hash
of its id; then, until nothing moves, documents move to the shard where most of their copies
are, or where that is full to the best one with room, as far as the shard's quota has room
for linked documents. No document moves to where fewer of its copies are, so each round
brings more of them together.

All copies of a text that started in one shard are alike, so what moves is a count: a cell
(group, shard at the start, shard now, documents). Rounds are joins of the table of cells with
itself; the documents are read twice only, to count the cells and to follow them at the end,
and a group is never held in one place. At last the shards' row counts are made at most one
apart, unlinked documents being the first to leave a full shard.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .util import Scratch, gapless, typed


def _counts(placed: DataFrame, shards: int) -> list[int]:
    """Rows in each shard: ``shards`` numbers."""
    got = {r["shard"]: r["count"] for r in placed.groupBy("shard").count().collect()}
    return [got.get(s, 0) for s in range(shards)]


def _pick(values: list[int], at=None):
    """A column that looks up its shard's number, or that at place ``at``."""
    return F.element_at(F.array(*[F.lit(v).cast("long") for v in values]), (F.col("_to") if at is None else at) + 1)


def granted(flow: list[list[int]], room: list[int]) -> list[list[int]]:
    """How many of the ``flow[s][t]`` documents that want to go from s to t may go.

    Shard t takes ``room[t]`` more than leave it; room is below 0 where a shard is too full.
    """
    n = len(room)
    flow = [list(x) for x in flow]
    for turn in range(1001):
        fits = True
        for t in range(n):
            # if it takes long to settle, nothing is lent on those that leave
            free = max(0, room[t] + (sum(flow[t]) if turn < 1000 else 0))
            want = sum(flow[s][t] for s in range(n))
            if want > free:
                fits = False
                # in proportion, what rounding leaves going to the first, so that no room stays unused
                upto, cut = 0, 0
                for s in range(n):
                    upto += flow[s][t]
                    flow[s][t] = -(-upto * free // want) - cut
                    cut += flow[s][t]
        if fits:
            break
    return flow


_GROUP = ["g1", "g2", "size"]
#: So many cells are moved in one task, as shuffles would cost more than the work; more over all tasks.
FEW = 200_000


def propagate(scratch: Scratch, cells: DataFrame, shards: int, quotas: list[int], rows: int, few: bool = False) -> tuple[DataFrame, int]:
    """One round over cells (g1, g2, size, start, shard, n): the cells after it, and how many documents moved. few: they fit one task."""
    save = lambda df: scratch.save(df).coalesce(1) if few else scratch.save(df)
    saved, cells = cells, cells.coalesce(1) if few else cells
    there = save(cells.groupBy(*_GROUP, "shard").agg(F.sum("n").alias("n")))
    now = {r["shard"]: r["n"] for r in there.groupBy("shard").agg(F.sum("n").alias("n")).collect()}
    room = [quotas[s] - now.get(s, 0) for s in range(shards)]
    open_ = [s for s in range(shards) if room[s] > 0]
    # a group goes to its best shard with room; if none of its shards has any, to its best,
    # which can take a document for each one that leaves it
    best = F.struct("n", F.xxhash64("g1", "shard").alias("h"), F.col("shard").alias("s"))
    goals = there.groupBy(*_GROUP).agg(F.max(best).alias("best"), F.max(F.when(F.col("shard").isin(open_), best)).alias("room"))
    to = F.coalesce("room", "best")
    goals = goals.select(*_GROUP, to["s"].alias("_to"), to["n"].alias("_to_n"))
    want = there.join(goals, _GROUP).where("shard <> _to AND n <= _to_n")
    want = save(want.select(*_GROUP, "shard", "_to", "n"))
    flow = [[0] * shards for _ in range(shards)]
    for r in want.groupBy("shard", "_to").agg(F.sum("n").alias("n")).collect():
        flow[r["shard"]][r["_to"]] = r["n"]
    go = granted(flow, room)
    moving = sum(map(sum, go))
    if not moving:
        return saved, 0
    movers = save(cells.join(want.drop("n"), [*_GROUP, "shard"]))
    ahead = gapless(scratch, movers, ["shard", "_to"], [], [*_GROUP, "start"], rows, "_ahead", "n")
    may = _pick([x for line in go for x in line], F.col("shard") * shards + F.col("_to"))
    cut = ahead.withColumn("_k", F.greatest(F.lit(0).cast("long"), F.least("n", may - F.col("_ahead"))))
    split = cut.select(*_GROUP, "start", F.explode(F.array(F.struct("shard", (F.col("n") - F.col("_k")).alias("n")), F.struct(F.col("_to").alias("shard"), F.col("_k").alias("n")))).alias("c"))
    stay = cells.join(want.select(*_GROUP, "shard"), [*_GROUP, "shard"], "left_anti")
    out = stay.select(*_GROUP, "start", "shard", "n").unionByName(split.select(*_GROUP, "start", "c.shard", "c.n").where("n > 0"))
    out = out.coalesce(1) if few else out
    out = scratch.save(out.groupBy(*_GROUP, "start", "shard").agg(F.sum("n").alias("n")))
    scratch.drop(saved)
    return out, moving


def follow(scratch: Scratch, placed: DataFrame, cells: DataFrame, rows: int) -> DataFrame:
    """The documents, each in the shard that a cell of its group and first shard is in."""
    way = F.sort_array(F.collect_list(F.struct(F.col("shard").alias("to"), "n"))).alias("way")  # a shard at most once
    routes = cells.groupBy(*_GROUP, F.col("start").alias("shard")).agg(way)
    routed = scratch.save(placed.join(routes, [*_GROUP, "shard"], "left"))
    whole = routed.where("way IS NULL OR size(way) = 1").withColumn("shard", F.coalesce(F.expr("way[0].to"), "shard"))
    parted = scratch.save(routed.where("size(way) > 1"))
    ranked = gapless(scratch, parted, [*_GROUP, "shard"], [], ["row"], rows, "_rank")
    # the place in the route is the number of stretches that end before the rank
    upto = "transform(sequence(1, size(way)), i -> aggregate(slice(way, 1, i), 0L, (a, c) -> a + c.n))"
    ranked = ranked.withColumn("shard", F.expr(f"way[size(filter({upto}, e -> e <= _rank))].to"))
    return scratch.save(whole.select(*placed.columns).unionByName(ranked.select(*placed.columns)))


def even_out(scratch: Scratch, placed: DataFrame, shards: int, quotas: list[int], rows: int) -> DataFrame:
    """Moves surplus rows of each shard to shards that lack some; unlinked rows go first."""
    ranked = gapless(scratch, placed.withColumn("alone", ~F.col("linked")), ["shard"], ["alone"], ["row"], rows, "_rank")
    ranked = scratch.save(ranked.withColumn("_to", F.col("shard")))
    now = _counts(placed, shards)
    stay = ranked.where(F.col("_rank") < _pick(quotas))
    surplus = scratch.save(ranked.where(F.col("_rank") >= _pick(quotas)).drop("_rank", "_to"))
    ends, at = [], 0
    for s in range(shards):
        at += max(0, quotas[s] - now[s])
        ends.append(at)
    full = F.array(*[F.lit(e).cast("long") for e in ends])
    spread = gapless(scratch, surplus, [], [], ["row"], rows, "_rank")
    spread = spread.withColumn("shard", F.size(F.filter(full, lambda e: e <= F.col("_rank"))).cast("int"))
    return scratch.save(stay.drop("_rank", "_to").select(*placed.columns).unionByName(spread.select(*placed.columns)))


def shard(docs: DataFrame, shards: int = 24, rounds: int | None = None, few: int = FEW) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard: one row for each row of ``docs``.

    The law is ``rows``: the shards' row counts differ by at most one. size is the UTF-8
    bytes of the text plus 8; a null text has no bytes and the checksum 0, and is linked
    with nothing. ``rounds`` is the most rounds of moves; without it they go on until no
    document moves. Up to ``few`` cells are moved in one task. Rows may repeat, ids too. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    text = F.coalesce("text", F.lit(""))
    rows_of = typed(docs, doc_id="long", text="string").select(
        "doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("g2"), F.xxhash64(text).alias("g1"), F.col("text").isNotNull().alias("has_text"), F.monotonically_increasing_id().alias("row")
    )
    base = scratch.save(rows_of)
    rows = base.count()
    groups = scratch.save(base.where("has_text").groupBy("g1", "g2", "size").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("g1", "g2", "size", F.lit(True).alias("linked")))
    placed = base.join(groups, ["g1", "g2", "size"], "left").select(
        "doc_id", "size", "g1", "g2", "row", (F.coalesce("linked", F.lit(False)) & F.col("has_text")).alias("linked"), F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int").alias("shard")
    )
    placed = scratch.save(placed)
    quotas = [rows // shards + (s < rows % shards) for s in range(shards)]
    cells = scratch.save(placed.where("linked").groupBy(*_GROUP, F.col("shard").alias("start"), "shard").agg(F.count(F.lit(1)).alias("n")))
    moved, done, small = 1, 0, cells.count() <= few  # no round makes more than shards times as many
    while moved and (rounds is None or done < rounds):
        cells, moved = propagate(scratch, cells, shards, quotas, rows, small)
        done += 1
    placed = follow(scratch, placed, cells, rows)
    placed = even_out(scratch, placed, shards, quotas, rows)
    out = gapless(scratch, placed, ["shard"], [], ["row"], rows, "slot")
    return out.select("doc_id", "size", F.col("g2").alias("text_crc32"), F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"))


def cut_links(sharded: DataFrame) -> DataFrame:
    """groups, linked rows, and rows outside the shard that holds most of their group."""
    n = sharded.groupBy("text_crc32", "size", "shard").agg(F.count(F.lit(1)).alias("n"))
    g = n.groupBy("text_crc32", "size").agg(F.sum("n").alias("rows"), F.max("n").alias("together")).where("rows > 1")
    return g.agg(F.count(F.lit(1)).alias("groups"), F.sum("rows").alias("rows"), F.sum(F.col("rows") - F.col("together")).alias("apart"))

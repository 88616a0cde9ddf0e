import random

from reelspark.operators import gop
from reelspark.streaming import gop_state
from tests.test_operators import packets, plain_gop


def test_merging_in_any_order():
    rng = random.Random(3)
    for _ in range(200):
        rows = [(0, rng.randrange(1, 50), rng.random() < 0.3) for _ in range(rng.randrange(1, 30))]
        seen = list(enumerate(rows)) * 2
        rng.shuffle(seen)
        runs = []
        for i, (_, n, k) in seen:
            runs = gop_state.merge([*runs, gop_state.summary(i, n, k)])
        assert len(runs) == 1 and gop_state.totals(runs) == plain_gop(rows)


def test_stream_equals_batch(spark, tmp_path):
    rng = random.Random(5)
    p = packets(spark, *[[(i / 10, rng.randrange(1, 99), rng.random() < 0.2) for i in range(40)] for _ in range(4)])
    batch = {r.file_id: (r.max_gop_bytes, r.max_keyframe_interval_frames) for r in gop.gop_stats(p).collect()}
    rows = p.selectExpr("file_id", "decode_order AS seq", "size", "keyframe")
    # parts arrive out of order
    for k, (a, b) in enumerate([(20, 40), (0, 10), (10, 20)]):
        rows.where(f"seq >= {a} AND seq < {b}").coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    q = gop_state.gop_stream(stream).writeStream.format("memory").queryName("gops").outputMode("update").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {r.file_id: (r.max_gop_bytes, r.max_keyframe_interval_frames) for r in spark.table("gops").where("runs = 1").collect()}
    assert got == batch


def test_replayed_batches_do_not_grow_with_tasks(spark):
    rng = random.Random(9)
    p = packets(spark, *[[(i / 10, rng.randrange(1, 99), rng.random() < 0.2) for i in range(30)] for _ in range(6)])
    got = gop_state.replayed(p.selectExpr("file_id", "decode_order AS seq", "size", "keyframe").repartition(9), 3)
    assert 1 < len({path.split("/out/")[1].split("/")[0] for path in got.inputFiles()}) <= 3
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, gop.gop_stats(p).collect()))


def test_neighbouring_files_share_a_state():
    import pandas as pd

    class State:
        exists, get = False, None

        def update(self, value):
            self.exists, self.get = True, value

    state, told = State(), {}
    for seqs in ((1, 3), (0, 2)):
        for f in ((64, 65, None) if 0 in seqs else (64, 65)):
            rows = pd.DataFrame({"file_id": [f] * 2, "seq": seqs, "size": [10, 20], "keyframe": [True, False]})
            for out in gop_state._update((1,), iter([rows]), state):
                told |= {None if pd.isna(r.file_id) else r.file_id: (r.max_gop_bytes, r.max_keyframe_interval_frames, r.runs) for r in out.itertuples()}
    assert told == {64: (50, 3, 1), 65: (50, 3, 1), None: (30, 2, 2)}

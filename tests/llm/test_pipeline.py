import corpus_pipeline
import pytest

from reelspark.llm import minhash
from tests.llm.fixtures import frame, rng, words
from tests.llm.test_decontam import plain as leaks


def test_stages(spark, tmp_path):
    r = rng(12)
    passage, item = words(r, 70, 10**5), words(r, 30, 10**5)
    clean = [words(r, 120, 10**5) for _ in range(30)]
    copies = [clean[0], clean[0] + " more", clean[1].upper()]
    shared = [words(r, 90, 10**5) + " " + passage + " " + words(r, 60, 10**5) for _ in range(3)]
    texts = [*clean, *copies, *shared, words(r, 80, 10**5) + " " + item, "too short", None]
    docs = frame(spark, texts, sources=["a"])
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept, ids = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, str(tmp_path))
        assert kept.columns == docs.columns, name
        ids.append({x.doc_id: x.text for x in kept.collect()})
    n = len(clean)
    assert set(ids[0]) == set(range(n + 7))
    assert set(ids[1]) == set(range(n + 7)) - {n, n + 1, n + 2}
    assert set(ids[2]) == set(ids[1])
    for i, t in ids[2].items():
        assert passage[5:-5] not in t and (t == texts[i]) == (i not in range(n + 3, n + 6))
    assert set(ids[3]) == set(ids[2]) - {n + 6} and leaks(texts[n + 6], [(1, item)])
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {x.doc_id for x in pieces} == set(ids[3])
    assert sum(x.length for x in pieces) == sum({x.doc_id: x.doc_tokens for x in pieces}.values())
    assert corpus_pipeline.ORACLE_SQL is None and minhash.K == 64


def test_rows_without_an_id_of_their_own(spark, tmp_path):
    """Repeated rows, null ids and ids that name several texts."""
    r = rng(13)
    t = [words(r, 120, 10**5) for _ in range(9)]
    bad = "too short"
    rows = [(1, t[0]), (1, t[0]), (2, t[1]), (None, t[2]), (None, t[2]), (None, t[3]), (None, bad), (3, t[4]), (3, bad), (4, t[5]), (4, t[6]), (5, t[7]), (5, t[8]), (6, t[8] + " more"), (None, t[1] + " more"), *[(10 + i, words(r, 120, 10**5)) for i in range(9)]]
    rows += [(2**63 - 1, words(r, 120, 10**5))]
    spark.createDataFrame([(1, words(r, 30, 10**5))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for extra in ([], [(-(2**63), words(r, 120, 10**5))]):
        docs, good = frame(spark, rows + extra, sources=["a"]), sorted(x[1] for x in rows + extra if x[1] != bad)
        first = corpus_pipeline.keep_good_text(spark, docs, str(tmp_path))
        assert first.columns == docs.columns and sorted(x.text for x in first.collect()) == good
        left = docs
        for name, stage in corpus_pipeline.STAGES[:-1]:
            left = stage(spark, left, str(tmp_path))
            got = [x.text for x in left.collect()]
            if name != "quality rules":
                # one row of each text, one of the two texts that are nearly equal, and no text cut
                assert len(got) == len(set(got)) == len(set(good)) - 2, name
                assert set(good) - {t[1], t[8], t[1] + " more", t[8] + " more"} < set(got), name
                assert len({t[1], t[1] + " more"} & set(got)) == len({t[8], t[8] + " more"} & set(got)) == 1


@pytest.mark.parametrize("columns", [["doc_id", "text", "_own", "own", "id", "host"], ["text", "row", "h1", "_id", "_fp"], ["doc_id", "TEXT", "source", "n_chars", "spans", "rep"]])
def test_stages_with_odd_columns_and_without_rows(spark, tmp_path, columns):
    r = rng(17)
    good = [words(r, 120, 10**5) for _ in range(4)]
    rows = [tuple(i if c == "doc_id" else t if c.lower() == "text" else "s" if c == "source" else 9 for c in columns) for i, t in enumerate([*good, None, ""])]
    docs = spark.createDataFrame(rows, ", ".join(f"`{c}` {'string' if c.lower() in ('text', 'source') else 'long'}" for c in columns))
    spark.createDataFrame([(1, words(r, 30, 10**5))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for some, texts in ((docs, sorted(good)), (docs.limit(0), [])):
        kept = some
        for name, stage in corpus_pipeline.STAGES[:-1]:
            kept = stage(spark, kept, str(tmp_path))
            assert kept.columns == columns and sorted(x[columns.index("TEXT" if "TEXT" in columns else "text")] for x in kept.collect()) == texts, name
        pieces = corpus_pipeline.STAGES[-1][1](spark, kept, str(tmp_path))
        assert (pieces.count() > 0) == bool(texts)


def test_run_on_an_empty_table(spark, tmp_path):
    frame(spark, ["x"]).limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_scratch_is_named_by_the_session(spark):
    from reelspark.llm.util import Scratch, shared_dir

    scratch = Scratch(spark)
    saved = scratch.save(spark.range(3))
    assert scratch.top.startswith(shared_dir(spark)) and saved.count() == 3
    scratch.drop(saved)

from reelspark.llm import quality, queries, sql
from tests.compare import DATA, by_spark, by_sql, tables
from tests.llm.fixtures import ODD, frame, rng, words

OUT = ["doc_id", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "base_failed", "host_rejected", "kept"]


def test_same_as_sql(spark):
    assert by_spark(queries.op1_quality_rules(spark, DATA)) == by_sql(tables(), sql.QUALITY)


def test_odd_rows_against_sql(spark):
    r = rng()
    texts = [*ODD, *(words(r, 80, 30) + "\nsame\nsame\n" for _ in range(40)), *("#%&| " * r.randrange(90) for _ in range(9))]
    docs = frame(spark, texts)
    con = tables()
    rows = docs.select("doc_id", "text", "source").collect()
    con.execute("CREATE OR REPLACE TABLE odd (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO odd VALUES (?, ?, ?)", [tuple(x) for x in rows])
    assert by_spark(quality.quality_rules(docs)) == by_sql(con, sql.QUALITY.replace("documents", "odd"))


def test_repeat_words():
    assert quality.repeat_words(b"a b c d a b c".split()) == 6
    assert quality.repeat_words(b"a a a a".split()) == 4
    assert quality.repeat_words(b"a b c".split()) == 0


def test_bad_host_loses_good_documents(spark):
    r = rng(2)
    good, bad = [words(r, 100) for _ in range(60)], ["no"] * 30
    docs = frame(spark, [*good[:58], *bad, *good[58:]], sources=["x"] * 58 + ["bad"] * 32)
    kept = {x.doc_id: x.kept for x in quality.quality_rules(docs).collect()}
    assert all(kept[i] for i in range(58)) and not any(kept[i] for i in range(58, 90))


def test_empty(spark):
    docs = frame(spark, ["x"])
    assert quality.quality_rules(docs.limit(0)).count() == 0
    assert quality.reject_low_quality(docs).columns == docs.columns

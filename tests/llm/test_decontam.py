from reelspark.llm import decontam, queries, sql
from tests.compare import DATA, by_spark, by_sql, tables
from tests.llm.fixtures import ODD, frame, rng, words


def plain(text, items):
    import regex

    tok = lambda t: [w for w in regex.split(r"[^\p{L}\p{M}\p{N}]+", (t or "").lower()) if w]
    own, found = tok(text), set()
    for i, t in items:
        item = tok(t)
        for d in range(-len(item), len(own)) if item else ():
            eq = [q for q in range(len(item)) if 0 <= q + d < len(own) and own[q + d] == item[q]]
            near = any(b - a < 12 for a, b in zip(eq, eq[9:]))
            if len(eq) == len(item) if len(item) < 12 else near:
                found.add(i)
    return found


def test_same_as_sql(spark):
    assert by_spark(queries.op6_decontamination(spark, DATA)) == by_sql(tables(), sql.DECONTAMINATION)


def test_against_brute_force(spark):
    r = rng(4)
    items = [(i, words(r, n)) for i, n in enumerate([3, 6, 8, 12, 14, 40, 5, 6, 8, 12, 14, 40])] + [(90, None), (91, "")]
    texts = list(ODD)
    for _ in range(150):
        w = r.choice(items[:12])[1].split()
        a = r.randrange(len(w))
        part = w[a : a + r.randrange(1, 41)]
        for _ in range(r.randrange(0, 5)):
            part[r.randrange(len(part))] = "zz"
        texts.append(words(r, r.randrange(20)) + ", " + " ".join(part).upper() + "! " + words(r, r.randrange(20)))
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, ih string")
    docs = frame(spark, [*texts, (0, texts[60])])
    got = sorted((x.doc_id, x.contaminated, x["items"]) for x in decontam.contamination(docs, bench).collect())
    want = sorted((i, bool(f), ",".join(map(str, sorted(f)))) for i, t in [*enumerate(texts), (0, texts[60])] for f in [plain(t, items)])
    assert got == want and 20 < sum(x[1] for x in got) < 140
    kept = decontam.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns and kept.count() == sum(not x[1] for x in got)


def test_by_shuffle(spark, monkeypatch):
    monkeypatch.setattr(decontam, "SENT", 0)
    bench = spark.createDataFrame([(1, "a b c d e f g h i j k l m")], "item_id long, text string")
    docs = frame(spark, ["z a b c d e x g h i j k l m", "a b c"])
    assert [x.contaminated for x in decontam.contamination(docs, bench).orderBy("doc_id").collect()] == [True, False]


def test_empty(spark):
    bench = spark.createDataFrame([], "item_id long, text string")
    docs = frame(spark, ODD)
    assert not any(x.contaminated for x in decontam.contamination(docs, bench).collect())
    assert decontam.contamination(docs.limit(0), bench).count() == 0


def test_short_items_whole_only(spark):
    items = [(1, "one"), (2, "two words"), (3, "a b c d e"), (4, "a b c d e f"), (5, "!")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    texts = ["One", "two. Words!", "two other words", "x a b c d e", "a b c d", "a b c d e f", "", None, "words two"]
    got = {x.doc_id: x["items"] for x in decontam.contamination(frame(spark, texts), bench).collect()}
    assert got == {0: "1", 1: "2", 2: "", 3: "3", 4: "", 5: "3,4", 6: "", 7: "", 8: ""}
    assert all(set(filter(None, got[i].split(","))) == {str(k) for k in plain(t, items)} for i, t in enumerate(texts))

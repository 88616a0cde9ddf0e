"""Language and toxicity on documents that weren't learned from."""

import numpy as np
import regex
from pyspark.sql import functions as F

from reelspark.llm import langid, queries, toxicity
from tests.llm.fixtures import ODD, frame, rng, words

SF = "/root/testdata/sf0.01"


def test_languages_held_out(spark):
    out = queries.op2_language_id(spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert out.count() == docs.count() and out.columns[:4] == ["doc_id", "held_out", "lang_pred", "score"]
    both = out.join(docs.where("lang IS NOT NULL AND length(text) > 60"), "doc_id")
    assert both.where("held_out").agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("int"))).first()[0] > 0.97
    assert out.where("score < 0 OR score > 1").count() == 0


def test_languages_of_odd_rows(spark):
    got = {x.doc_id: (x.lang_pred, x.score) for x in langid.identify(frame(spark, [*ODD, "12 34 !"])).collect()}
    assert got[0] == got[1] == got[2] == got[len(ODD)] == ("und", 0.0) and got[3][0] == "en"
    assert langid.identify(frame(spark, ODD).limit(0)).count() == 0
    unlabelled = frame(spark, ODD).withColumn("lang", F.lit(None).cast("string"))
    assert {x.lang_pred for x in langid.identify(unlabelled).collect()} == {"und"}


def test_toxic_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    test = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    out = toxicity.toxicity(docs, labels.where(~test))
    both = out.join(labels.where(test).select("doc_id", F.col("toxic").alias("truth")), "doc_id")
    hit, told, true = both.agg(F.count_if(F.expr("toxic AND truth = 1")), F.count_if("toxic"), F.count_if(F.expr("truth = 1"))).first()
    assert out.count() == docs.count() and hit >= 0.9 * true and hit >= 0.9 * told


def test_toxicity_without_labels(spark):
    docs = frame(spark, ODD)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert not any(x.toxic for x in toxicity.toxicity(docs, none).collect())
    one = spark.createDataFrame([(3, 1, 1), (3, 1, 1), (4, None, 0)], "doc_id long, quality int, toxic int")
    assert not any(x.toxic for x in toxicity.toxicity(docs, one).collect())
    assert toxicity.toxicity(docs.limit(0), one).count() == 0


def test_toxicity_learns_from_rows_with_one_label(spark):
    """No document has both labels; each category learns from its own."""
    r = rng(21)
    bad = [i % 2 == 0 for i in range(160)]
    docs = frame(spark, [words(r, 40) + (" vile filth" if b else " mild grace") for b in bad])
    labels = [(i, None, int(b)) if i % 4 < 2 else (i, int(not b), None) for i, b in enumerate(bad)]
    got = toxicity.toxicity(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert len(got) == len(bad) and sum(x.toxic == bad[x.doc_id] for x in got) >= 150
    other = next(c for c in toxicity.CATEGORIES if c != "toxic")
    assert {x[other] for x in got} == {True, False}


def grams_of(text):
    """The n-grams by plain slicing."""
    t = regex.sub(r"[^\p{L}\p{M}]+", " ", text.lower())
    return {t[i : i + n] for n in (1, 2, 3) for i in range(len(t) - n + 1)}


def kernel_of(a, b):
    a, b = grams_of(a), grams_of(b)
    return len(a & b) / (len(a) * len(b)) ** 0.5


def test_kernel_and_models_against_plain_ones():
    """With every text a landmark the Nyström map is exact: scores are those of ridge regression in the plain kernel."""
    r = rng(31)
    stems = {"aa": "lo ma ti ras en".split(), "bb": "wex kro ull zan".split(), "日本": list("日本語文字数")}
    say = lambda g: "".join(r.choice(stems[g]) + r.choice(["", " ", ", "]) for _ in range(25))
    langs = [g for g in stems for _ in range(12)]
    texts = [say(g) for g in langs]
    model = langid.fit(texts, langs, landmarks=len(texts), ridge=1.0)
    gram = np.array([[kernel_of(a, b) for b in texts] for a in texts]) + 1
    y = np.array([[1.0 if g == c else -1.0 for c in sorted(stems)] for g in langs])
    dual = np.linalg.solve(gram + 1.0 * len(texts) / 100 * np.eye(len(texts)), y)
    asked = [say(g) for g in langs] + ["नमस्ते दुनिया", "xyz 12"]
    finder, presence, sizes = langid.Grams(), [], []
    for t in asked:
        own = finder.distinct(t)
        assert len(own) == len(grams_of(t))
        presence.append(np.isin(model.grams, own))
        sizes.append(len(own))
    got = model.scores(np.array(presence, np.float32), np.array(sizes, np.float32))
    want = (np.array([[kernel_of(a, b) for b in texts] for a in asked]) + 1) @ dual
    assert np.abs(got - want).max() < 0.02
    assert (got.argmax(1) == want.argmax(1))[: len(langs)].all()


def test_more_languages_than_the_sample(spark):
    """Every language can be predicted; scripts with more characters than a small alphabet aren't merged."""
    r = rng(32)
    base = [0x4E00 + 300 * k for k in range(25)]
    docs = [(i, " ".join("".join(chr(base[i % 25] + r.randrange(80)) for _ in range(4)) for _ in range(20)), f"l{i % 25:02}") for i in range(400)]
    got = langid.identify(spark.createDataFrame(docs, "doc_id long, text string, lang string"), most=10, landmarks=4).collect()
    assert sum(x.lang_pred == f"l{x.doc_id % 25:02}" for x in got) > 380 and all(0 <= x.score <= 1 for x in got)


def test_linear_models_meet_the_conditions_of_the_minimum():
    """At the minimum each weight's slope is the penalty, or below it where the weight is 0."""
    r = rng(33)
    rows = [{f"n{r.randrange(30)}" for _ in range(6)} | ({"bad"} if r.random() < 0.3 else set()) for _ in range(300)]
    labels = [("bad" in x) != (r.random() < 0.1) for x in rows]
    numbers = [[r.uniform(-3, 3)] for _ in rows]
    penalty = 0.004
    m = toxicity.fit_linear(rows, numbers, labels, penalty=penalty, steps=4000)
    every = {k: sum(k in x for x in rows) for k in set().union(*rows)}
    slack = [1 / (1 + np.exp(-m.logit(x, v))) - y for x, v, y in zip(rows, numbers, labels)]
    for k, c in every.items():
        if c < 5:
            continue
        scale = min(3.0, (len(rows) / c) ** 0.5 / 2)
        slope = scale * sum(g for g, x in zip(slack, rows) if k in x) / len(rows)
        w = m.weights.get(k, 0.0)
        assert abs(slope + penalty * np.sign(w)) < 1e-4 if w else abs(slope) < penalty + 1e-4, k
    assert abs(sum(slack)) / len(rows) < 1e-4 and m.weights["bad"] > 0


def test_chain_against_a_plain_refit():
    """Each model is refitted in the open: folds, out-of-fold log-odds, then the next category."""
    r = rng(34)
    texts = [words(r, 30, 60) + (" awful" if i % 3 == 0 else "") + (" vile" if i % 4 == 0 else "") for i in range(120)]
    labels = [[i % 3 == 0 for i in range(120)], [None if i % 7 == 0 else i % 4 == 0 for i in range(120)]]
    chain = toxicity.fit_chain(texts, labels)
    found = [toxicity.features(t) for t in texts]
    for f in found[:5]:
        assert "w1" not in f or any(w == "w1" for w in texts[found.index(f)].split())
    before = [[] for _ in texts]
    for c, own in enumerate(labels):
        known = [i for i, y in enumerate(own) if y is not None]
        fit = lambda ids: toxicity.fit_linear([found[i] for i in ids], [before[i] for i in ids], [own[i] for i in ids])  # noqa: B023, E731
        plain = fit(known)
        assert plain.weights == chain.models[c].weights and plain.extra == chain.models[c].extra
        parts = [fit([i for i in known if i % toxicity.FOLDS != k]) for k in range(toxicity.FOLDS)]
        before = [[*b, parts[i % toxicity.FOLDS].logit(found[i], b)] for i, b in enumerate(before)]
    for t in texts[:20]:
        logits, f = [], toxicity.features(t)
        for m in chain.models:
            logits.append(m.bias + sum(w for k, w in m.weights.items() if k in f) + sum(a * b for a, b in zip(m.extra, logits)))
        assert np.allclose(chain.logits(t), logits)


def test_toxicity_of_long_texts_and_repeated_ids(spark):
    r = rng(35)
    docs = [(i, words(r, 40) + (" vile filth" if i % 2 else " mild grace")) for i in range(120)]
    docs += [(1, "other text of this id"), (500, words(r, 60000) + " vile filth"), (501, None), (502, "")]
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(120)] + [(500, 1, 1)], "doc_id long, quality int, toxic int")
    got = [toxicity.toxicity(frame(spark, docs, parts=p), labels).collect() for p in (1, 4)]
    assert all(len(x) == len(docs) for x in got)
    assert sorted((x.doc_id, x.p_toxic) for x in got[0]) == sorted((x.doc_id, x.p_toxic) for x in got[1])

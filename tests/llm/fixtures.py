"""Small tables with odd rows."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, ids int, h string, spans string, row int, seed long, pos int"


def frame(spark, texts, parts=3, sources=None):
    """documents with extra columns whose names clash with inner ones; texts: text by place, or (id, text)."""
    rows = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
    rows = [(i, t, "en", (sources or ["a", "b", None])[k % len(sources or "abc")], len(t or ""), 1, "x", "y", 2, 3, 4) for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(rows, SCHEMA).repartition(parts)


def words(rng, n, size=400):
    return " ".join(f"w{rng.randrange(size)}" for _ in range(n))


ODD = [None, "", " \n\t", "one", "one two", "Straße é 日本語 \U0001f600", "x" * 5000, "a b " * 700, "same text here", "same text here"]


def rng(seed=1):
    return random.Random(seed)

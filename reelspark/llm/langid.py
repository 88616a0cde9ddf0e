"""Language identification with string kernels.

The kernel of two texts is the number of character n-grams (one to three characters) that
both hold, over the square root of the product of how many each holds: a blended
spectrum of presence. An n-gram is known by a hash of its code points, so every script counts
by its own characters. A bounded sample of labelled texts gives the landmarks of a Nyström map,
and ridge regression of one language against the rest is solved on the mapped sample.
Texts are scored in batches: presence times landmarks, then times the models, as matrix products.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache, partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .util import Scratch, typed

GRAMS = (1, 2, 3)
#: n-grams have ids of so many bits.
BITS = 22
#: Code points from here on are no letters or marks.
POINTS = 0x34000


@lru_cache(1)
def _letters():
    """By code point, whether it is a letter or a mark."""
    import numpy as np

    return np.array([unicodedata.category(chr(i))[0] in "LM" for i in range(POINTS)] + [False])


def _points(text: str):
    """Code points of the lower-case text; each run of what is no letter or mark is one space."""
    import numpy as np

    points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), "<u4")
    told = _letters()[np.minimum(points, POINTS)]
    keep = told.copy()
    keep[1:] |= told[:-1]
    keep[:1] = True
    return np.where(told, points, 32)[keep]


class Grams:
    """Marks which n-grams a text holds, in one reused array of flags."""

    def __init__(self):
        import numpy as np

        self.flags = np.zeros(1 << BITS, bool)

    def found(self, text: str):
        """Ids of the n-grams, which may repeat; their flags are set."""
        import numpy as np

        c = _points(text).astype(np.uint32)
        out = []
        for n in GRAMS:
            if len(c) >= n:
                code = c[: len(c) - n + 1] + np.uint32(n << 24)
                for k in range(1, n):
                    code = (code * np.uint32(0x9E3779B1)) ^ (code >> np.uint32(15)) ^ c[k : len(c) - n + 1 + k]
                code = code * np.uint32(0x85EBCA6B)
                out.append((code ^ (code >> np.uint32(13))) * np.uint32(0xC2B2AE35) >> np.uint32(32 - BITS))
        ids = np.concatenate(out).astype(np.int64) if out else np.zeros(0, np.int64)
        self.flags[ids] = True
        return ids

    def distinct(self, text: str):
        import numpy as np

        ids = np.unique(self.found(text))
        self.flags[ids] = False
        return ids


LANDMARKS = 96


class Model:
    def __init__(self, grams, landmarks, weights, languages: list[str]):
        self.grams, self.landmarks, self.weights, self.languages = grams, landmarks, weights, languages

    def scores(self, presence, sizes):
        """presence: texts by the landmarks' n-grams; sizes: all n-grams of each text."""
        import numpy as np

        kernel = (presence @ self.landmarks) / np.sqrt(np.maximum(sizes, 1))[:, None]
        return np.concatenate([kernel, np.ones((len(kernel), 1), np.float32)], 1) @ self.weights


def fit(texts: list[str], langs: list[str], landmarks: int = LANDMARKS, ridge: float = 1e-3) -> Model | None:
    """Landmarks are taken in turn from the languages, one of each at least. None without texts."""
    import numpy as np

    if not texts:
        return None
    finder = Grams()
    sets = [finder.distinct(t) for t in texts]
    languages = sorted(set(langs))
    own = {g: [i for i, x in enumerate(langs) if x == g] for g in languages}
    chosen = [own[g][k] for k in range(max(map(len, own.values()))) for g in languages if k < len(own[g])][: max(landmarks, len(languages))]
    grams = np.unique(np.concatenate([sets[i] for i in chosen]))
    rows = lambda idx: np.array([np.isin(grams, sets[i], assume_unique=True) for i in idx], np.float32).reshape(len(idx), len(grams))
    marks = rows(chosen) / np.sqrt(np.maximum([len(sets[i]) for i in chosen], 1))[:, None].astype(np.float32)
    blocks = range(0, len(texts), 256)
    k_nm = np.concatenate([(rows(range(b, min(b + 256, len(texts)))) @ marks.T) / np.sqrt(np.maximum([len(s) for s in sets[b : b + 256]], 1))[:, None] for b in blocks]).astype(float)
    values, vectors = np.linalg.eigh(k_nm[chosen])
    root = vectors / np.sqrt(np.maximum(values, 1e-6)) @ vectors.T
    z = np.concatenate([k_nm @ root, np.ones((len(texts), 1))], 1)
    y = np.array([[1.0 if x == g else -1.0 for g in languages] for x in langs])
    w = np.linalg.solve(z.T @ z + ridge * len(texts) / 100 * np.eye(z.shape[1]), z.T @ y)
    weights = np.concatenate([root @ w[:-1], w[-1:]]).astype(np.float32)
    return Model(grams, np.ascontiguousarray(marks.T), weights, languages)


def _predict(model: Model | None, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import numpy as np

    finder = Grams() if model else None
    for b in batches:
        for i in range(0, b.num_rows, 256):
            part = b.slice(i, 256)
            texts = part.column(2).to_pylist()
            langs, scores = ["und"] * len(texts), np.zeros(len(texts))
            known = [j for j, t in enumerate(texts) if t and any(map(str.isalpha, t))] if model else []
            if known:
                presence, sizes = np.zeros((len(known), len(model.grams)), np.float32), []
                for r, j in enumerate(known):
                    ids = finder.found(texts[j])
                    presence[r] = finder.flags[model.grams]
                    # counts each n-gram where it is cleared first
                    sizes.append(np.count_nonzero(finder.flags))
                    finder.flags[ids] = False
                got = model.scores(presence, np.array(sizes, np.float32))
                e = np.exp(4 * (got - got.max(1, keepdims=True)))
                best = got.argmax(1)
                for r, j in enumerate(known):
                    langs[j] = model.languages[best[r]]
                    scores[j] = min(1.0, float(e[r, best[r]] / e[r].sum()))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])


def identify(docs: DataFrame, per_language: int = 300, most: int = 3000, longest: int = 20000, landmarks: int = LANDMARKS) -> DataFrame:
    """doc_id, held_out, lang_pred, score: one row for each row of ``docs``.

    A document is held out if crc32 of its id as text leaves 2 when divided by 4. Of the
    others, with a language, a letter and at most ``longest`` characters, at most ``most`` are learned
    from and at most ``per_language`` of each language, by the hash of their ids; every language has
    one text at least, even if there are more languages than ``most``. Texts that are null or
    without a letter are ``und`` with score 0, and so is every text if there is nothing to
    learn from. Rows may repeat; other columns are ignored.
    """
    rows = typed(docs, doc_id="long", text="string", lang="string")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    usable = rows.where(~held & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & (F.length("text") <= longest))
    counts = Scratch(docs.sparkSession).save(usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n")))
    each = min(per_language, max(1, most // max(1, counts.count())))
    # hashes below a language's limit leave about twice as many texts as are wanted, so only few are sorted
    low = (F.col("hash") / F.lit(2.0**64) + F.lit(0.5)) < F.lit(2.0 * each + 40) / F.col("n")
    near = usable.withColumn("hash", F.xxhash64("doc_id")).join(counts, "lang").where(low)
    order = Window.partitionBy("lang").orderBy("hash", "doc_id", "text")
    picked = near.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= each).select("doc_id", "lang", "text").collect()
    train = sorted({(r["doc_id"] if r["doc_id"] is not None else -(2**63), r["lang"], r["text"]) for r in picked})
    model = fit([t for _, _, t in train], [g for _, g, _ in train], landmarks)
    return rows.select("doc_id", held.alias("held_out"), "text").mapInArrow(partial(_predict, model), "doc_id long, held_out boolean, lang_pred string, score double")

"""Toxicity by a classifier chain of linear models.

Categories are predicted one after the other. Each model sees which words and word
beginnings a text holds, which beginnings it holds more than once, and the log-odds of the
categories before it; for training those are out-of-fold predictions, so a later model
learns how far to trust them.
Models are logistic with an L1 penalty, fitted on a bounded sample of labelled documents;
every document is scored by its whole text.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .util import typed

_WORD = re.compile(r"[^\W_]+")
STEMS = (4, 5, 6)
#: Names of categories in the order of the chain, each with its rule on the labels.
CATEGORIES = {"low_quality": "quality = 0", "toxic": "toxic = 1", "toxic_low_quality": "toxic = 1 AND quality = 0"}
FOLDS = 4


def features(text: str | None) -> set[str]:
    """The text's words, their beginnings (ending in a star), and those of two words or more (ending in two)."""
    words = Counter(_WORD.findall((text or "").lower()))
    stems: Counter = Counter()
    for w, c in words.items():
        for n in STEMS:
            if len(w) > n:
                stems[w[:n]] += c
    return words.keys() | {s + "*" for s in stems} | {s + "**" for s, c in stems.items() if c > 1}


def _sigmoid(x):
    import numpy as np

    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Linear:
    """Logistic model over a set of names plus some numbers; weights of names without use are left out."""

    def __init__(self, weights: dict[str, float], extra: list[float], bias: float):
        self.weights, self.extra, self.bias = weights, extra, bias

    def logit(self, found: set[str], numbers: list[float]) -> float:
        get = self.weights.get
        return self.bias + sum(map(get, found & self.weights.keys())) + sum(a * b for a, b in zip(self.extra, numbers))


def fit_linear(rows: list[set[str]], numbers: list[list[float]], labels: list[bool], most: int = 2000, penalty: float = 0.001, steps: int = 200) -> Linear:
    """Accelerated proximal gradient over the ``most`` names whose counts differ most between the classes.

    A name weighs the more in the fit the rarer it is, so rare telling ones are learned as fast as common ones.
    """
    import numpy as np

    n, y = len(rows), np.array(labels, float)
    pos = int(y.sum())
    prior = float(np.log((pos + 0.5) / (n - pos + 0.5)))
    width = len(numbers[0]) if numbers else 0
    if pos == 0 or pos == n:
        return Linear({}, [0.0] * width, prior)
    inside, every = Counter(), Counter()
    for r, label in zip(rows, labels):
        every.update(r)
        if label:
            inside.update(r)
    score = lambda k: abs(inside[k] / pos - (every[k] - inside[k]) / (n - pos)) / (every[k] / n + 10 / n) ** 0.5
    names = sorted((k for k, c in every.items() if c >= min(5, n // 20 + 1)), key=lambda k: (-score(k), k))[:most]
    at = {k: i for i, k in enumerate(names)}
    cols = [np.array([at[k] for k in r & at.keys()], np.int64) for r in rows]
    row = np.repeat(np.arange(n), [len(c) for c in cols])
    col = np.concatenate(cols) if cols else np.zeros(0, np.int64)
    dense = np.array(numbers, float).reshape(n, width) / 10
    m = len(names)
    scale = np.array([min(3.0, (n / every[k]) ** 0.5 / 2) for k in names])
    forward = lambda w: np.bincount(row, (w[:m] * scale)[col], n) + dense @ w[m:-1] + w[-1]
    backward = lambda r: np.concatenate([np.bincount(col, r[row], m) * scale, dense.T @ r, [r.sum()]])
    v = np.ones(m + width + 1)
    for _ in range(15):
        v = backward(forward(v))
        norm = np.linalg.norm(v)
        v = v / norm
    rate = 1 / (0.25 * norm / n * 1.1)
    w = np.zeros(m + width + 1)
    w[-1] = prior
    ahead, t = w.copy(), 1.0
    for _ in range(steps):
        g = backward(_sigmoid(forward(ahead)) - y) / n
        new = ahead - rate * g
        new[:m] = np.sign(new[:m]) * np.maximum(np.abs(new[:m]) - rate * penalty, 0)
        s = (1 + (1 + 4 * t * t) ** 0.5) / 2
        ahead, w, t = new + (t - 1) / s * (new - w), new, s
    return Linear({k: float(x) for k, x in zip(names, w[:m] * scale) if x}, (w[m:-1] / 10).tolist(), float(w[-1]))


class Chain:
    def __init__(self, models: list[Linear], cuts: list[float]):
        self.models, self.cuts = models, cuts

    def logits(self, text: str | None) -> list[float]:
        found, out = features(text), []
        for m in self.models:
            out.append(m.logit(found, out))
        return out


def _best_cut(logits: list[float], labels: list[bool]) -> float:
    """The log-odds that give the best F1 out of fold, halfway between its neighbours; 0 without examples."""
    if not any(labels) or all(labels):
        return 0.0
    order = sorted(zip(logits, labels), reverse=True)
    total, hit, best = sum(labels), 0, (-1.0, 0.0)
    for i, (x, label) in enumerate(order):
        hit += label
        below = order[i + 1][0] if i + 1 < len(order) else x
        if below < x or i + 1 == len(order):
            best = max(best, (2 * hit / (i + 1 + total), (x + below) / 2), key=lambda b: b[0])
    return best[1]


def fit_chain(texts: list[str], labels: list[list[bool | None]]) -> Chain:
    """labels: one list for each category, in the order of the chain; a category learns nothing from its Nones."""
    rows = [features(t) for t in texts]
    numbers: list[list[float]] = [[] for _ in rows]
    fold = [i % FOLDS for i in range(len(rows))]
    models, cuts = [], []
    for own in labels:
        known = [i for i in range(len(rows)) if own[i] is not None]
        models.append(fit_linear([rows[i] for i in known], [numbers[i] for i in known], [own[i] for i in known]))
        out = [0.0] * len(rows)
        for k in range(FOLDS):
            rest = [i for i in known if fold[i] != k]
            part = fit_linear([rows[i] for i in rest], [numbers[i] for i in rest], [own[i] for i in rest])
            for i in range(len(rows)):
                if fold[i] == k:
                    out[i] = part.logit(rows[i], numbers[i])
        cuts.append(_best_cut([out[i] for i in known], [own[i] for i in known]))
        numbers = [[*a, b] for a, b in zip(numbers, out)]
    return Chain(models, cuts)


def sample(docs: DataFrame, labels: DataFrame, rule: Column, positive: int, negative: int, longest: int) -> DataFrame:
    """Labelled documents of at most ``longest`` characters: so many that meet the rule and that don't, by the hash of their id.

    Where labels leave the rule open, ``negative`` more are taken of those, so they take no other's place.
    """
    known = labels.join(docs.where(F.length("text") <= longest).select("doc_id").distinct(), "doc_id")
    pick = lambda part, n: part.orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    ids = pick(known.where(rule), positive).unionByName(pick(known.where(~rule), negative)).unionByName(pick(known.where(rule.isNull()), negative))
    return docs.where(F.length("text") <= longest).join(F.broadcast(ids), "doc_id")


def _score(chain: Chain, names: list[str], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import numpy as np

    for b in batches:
        got = [chain.logits(t) for t in b.column(1).to_pylist()]
        x = np.array(got, float).reshape(len(got), len(names))
        cols = [pa.array(_sigmoid(x[:, i])) for i in range(len(names))] + [pa.array(x[:, i] >= chain.cuts[i]) for i in range(len(names))]
        yield pa.RecordBatch.from_arrays([b.column(0), *cols], ["doc_id", *(f"p_{n}" for n in names), *names])


def toxicity(docs: DataFrame, labels: DataFrame, categories: dict[str, str] = CATEGORIES, main: str = "toxic", positive: int = 1500, negative: int = 2500, longest: int = 20000) -> DataFrame:
    """doc_id, p_<category> and <category> for each: one row for each row of ``docs``.

    Trained on at most ``positive`` + ``negative`` labelled documents of at most ``longest``
    characters, and on at most ``negative`` more whose label of ``main`` is null. A null
    label is left out of its own category only. Null and empty texts are scored as texts
    without words. Repeated rows of labels don't count twice; with fewer than ``FOLDS`` examples
    of either kind a category can't be tried out of fold and is never flagged. Other columns are ignored.
    """
    docs = typed(docs, doc_id="long", text="string")
    known = typed(labels, doc_id="long", quality="int", toxic="int").dropna("all", subset=["quality", "toxic"]).groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    train = sample(docs.where("text IS NOT NULL"), known, F.expr(categories[main]), positive, negative, longest)
    once = train.groupBy("doc_id", "quality", "toxic").agg(F.min("text").alias("text"))  # of texts with one id the first
    picked = once.select("doc_id", "text", *[F.expr(r).alias(c) for c, r in categories.items()]).collect()
    picked.sort(key=lambda r: r["doc_id"])
    names = list(categories)
    chain = fit_chain([r["text"] for r in picked], [[r[c] for r in picked] for c in names])
    for i, c in enumerate(names):
        if min(sum(r[c] is kind for r in picked) for kind in (True, False)) < FOLDS:
            chain.cuts[i] = float("inf")
    out = "doc_id long, " + ", ".join(f"p_{n} double" for n in names) + ", " + ", ".join(f"{n} boolean" for n in names)
    return docs.mapInArrow(partial(_score, chain, names), out)

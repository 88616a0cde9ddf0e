import pytest

from reelspark.llm import minhash
from reelspark.llm.graph import components
from reelspark.llm.util import Scratch
from tests.llm.fixtures import ODD, frame, rng, words


def plain(rows, width, percent=80):
    sets = [minhash.shingles(t, width) for _, t in rows]
    top = list(range(len(rows)))

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if rows[i][0] == rows[j][0] or a and b and 100 * len(a & b) >= percent * len(a | b):
                top[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(d, least.get(root(i), d))
    return sorted((d, len(s), least[root(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets)))


def near_copies(r):
    texts = list(ODD)
    for k in range(25):
        base = words(r, r.randrange(30, 200), 5000).split()
        for _ in range(r.randrange(1, 8)):
            w = list(base)
            for _ in range(r.randrange(0, max(2, len(w) // 12))):
                w[r.randrange(len(w))] = f"n{r.randrange(10**6)}"
            texts.append(" ".join(w) if r.random() < 0.7 else " ".join(w).upper())
    return texts


@pytest.mark.parametrize("width", [2, 5])
def test_against_brute_force(spark, width):
    rows = list(enumerate(near_copies(rng(width))))
    rows += [(7, rows[40][1]), (1000, rows[41][1])]
    got = minhash.near_duplicates(frame(spark, rows), width=width).collect()
    assert sorted((x.doc_id, x.n_shingles, x.component_id) for x in got) == plain(rows, width)
    assert all(x.kept == (x.doc_id == x.component_id) for x in got)


def test_chain_without_pairs(spark):
    """Each is near the next one only."""
    r = rng(8)
    w = words(r, 200, 10**6).split()
    texts = []
    for _ in range(30):
        texts.append(" ".join(w))
        w = w[9:] + [f"c{r.randrange(10**6)}" for _ in range(9)]
    got = minhash.near_duplicates(frame(spark, texts), width=2).collect()
    assert sorted((x.doc_id, x.n_shingles, x.component_id) for x in got) == plain(list(enumerate(texts)), 2)


def test_empty_and_kept_columns(spark):
    docs = frame(spark, ODD)
    assert minhash.near_duplicates(docs.limit(0)).count() == 0
    out = minhash.drop_near_duplicates(docs)
    assert out.columns == docs.columns and out.count() == len(ODD) - 1


@pytest.mark.parametrize("few", [0, 10**6])
def test_components_in_one_task_and_by_joins(spark, few):
    r = rng(9)
    pairs = [(r.randrange(300), r.randrange(300)) for _ in range(160)] + [(i, i + 1) for i in range(400, 450)] + [(7, 7)]
    ids = sorted({x for p in pairs if p[0] != p[1] for x in p})
    least = {i: i for i in ids}
    for _ in ids:
        for a, b in pairs:
            if a != b:
                least[a] = least[b] = min(least[a], least[b])
    scratch = Scratch(spark)
    got = components(scratch, spark.createDataFrame(pairs, "a long, b long"), few=few).collect()
    assert sorted((x.id, x.component) for x in got) == [(i, least[i]) for i in ids]
    assert components(scratch, spark.createDataFrame([], "a long, b long"), few=few).count() == 0


def test_rows_without_ids_join_equal_sets(spark):
    r = rng(10)
    a, b = words(r, 60, 10**5), words(r, 60, 10**5)
    rows = [(3, a), (None, a), (None, b), (None, b.upper()), (None, None), (5, None)]
    got = minhash.near_duplicates(frame(spark, rows), width=2).collect()
    assert sorted((x.doc_id or -1, x.component_id or -1, x.kept) for x in got) == [(-1, -1, True), (-1, -1, True), (-1, -1, True), (-1, 3, False), (3, 3, True), (5, 5, True)]


def test_hot_group_of_edited_copies(spark):
    """Copies of one text with more and more words changed: many are candidates of each other, fewer are linked."""
    r = rng(11)
    base = words(r, 150, 10**6).split()
    texts = []
    for k in range(160):
        w = list(base)
        for _ in range(k // 5):
            w[r.randrange(len(w))] = f"e{r.randrange(10**6)}"
        texts.append(" ".join(w))
    got = minhash.near_duplicates(frame(spark, texts), width=2).collect()
    assert sorted((x.doc_id, x.n_shingles, x.component_id) for x in got) == plain(list(enumerate(texts)), 2)


def test_ids_at_both_ends(spark):
    r = rng(12)
    a = words(r, 80, 10**5)
    rows = [(-(2**63), a), (2**63 - 1, a + " one"), (-5, a + " one two"), (7, a + " one two three"), (8, words(r, 80, 10**5))]
    got = minhash.near_duplicates(frame(spark, rows), width=2).collect()
    assert sorted((x.doc_id, x.n_shingles, x.component_id) for x in got) == plain(rows, 2)

import hashlib
from collections import Counter

import pytest

from reelspark.llm import suffixdedup
from tests.llm.fixtures import ODD, frame, rng


def plain(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    for d in data:
        cut = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                cut[i : i + length] = b"\1" * length
        runs = sum(c and not (i and cut[i - 1]) for i, c in enumerate(cut))
        rest = bytes(b for b, c in zip(d, cut) if not c)
        yield len(d), sum(cut), runs, hashlib.sha256(rest).hexdigest()


def corpus(r, length, letters):
    make = lambda n: "".join(r.choice(letters) for _ in range(n))
    shared = [make(r.randrange(length - 3, 3 * length)) for _ in range(8)]
    texts = [t and t[: 3 * length] for t in ODD]
    for _ in range(60):
        pieces = [make(r.randrange(2 * length)) for _ in range(3)]
        for _ in range(r.randrange(3)):
            s = r.choice(shared)
            a = r.randrange(len(s))
            pieces.insert(r.randrange(3), s if r.random() < 0.5 else s[a:])
        texts.append("".join(pieces))
    return [*texts, *texts[20:24], "q" * 4 * length, "ab" * 2 * length]


@pytest.mark.parametrize("length, letters", [(400, "abcdefgh é"), (240, "abcdefgh é"), (64, "ab")])
def test_against_brute_force(spark, length, letters):
    texts = corpus(rng(length), length, letters)
    rows = suffixdedup.cut_repeats(frame(spark, texts), length).collect()
    got = {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in rows}
    assert len(rows) == len(texts) and got == dict(enumerate(plain(texts, length)))


def test_texts_and_equal_ids(spark):
    r = rng(9)
    make = lambda n: "".join(r.choice("abcdefgh é") for _ in range(n))
    shared = make(500)
    docs = frame(spark, [(1, "x" + shared), (1, shared + make(900)), (None, shared), (2, None), (3, "short"), (3, "short")])
    out = suffixdedup.drop_repeats(docs)
    assert out.schema == docs.schema
    rows = out.collect()
    assert sorted((x.doc_id or -1, x.n_chars, x.text is None) for x in rows if x.doc_id != 1) == [(-1, 0, False), (2, None, True), (3, 5, False), (3, 5, False)]
    assert sorted(x.n_chars for x in rows if x.doc_id == 1)[0] <= 1


def test_empty(spark):
    assert suffixdedup.cut_repeats(frame(spark, ["x"]).limit(0)).count() == 0
    assert suffixdedup.drop_repeats(frame(spark, ["x"]).limit(0)).count() == 0


def test_rolling_hash_of_every_window():
    r = rng(14)
    data = bytes(r.randrange(256) for _ in range(3000))
    got = set(suffixdedup.triggers(data, 8).tolist())
    for i in range(len(data) - suffixdedup.GRAM + 1):
        h = 0
        for b in data[i : i + suffixdedup.GRAM]:  # one byte after the other
            h = (h * 0xD6E8FEB86659FD93 + b) % 2**64
        h ^= h >> 32
        assert (i in got) == (h * 0x9E3779B97F4A7C15 % 2**64 >> 40 < (1 << 24) // 8)
    assert suffixdedup.triggers(b"short", 8).size == 0


@pytest.mark.parametrize("data", [b"a" * 100_000, b"0123456789" * 10_000, b"ab" * 50_000])
def test_a_run_goes_on_as_few_starts(data):
    rows = list(suffixdedup.parse(data, 400))
    assert len(rows) < 3000
    told = [r for r in rows if r[2] is None]
    if told:
        assert min(r[0] for r in told) == 0 and max(r[1] for r in told) == len(data) - 400


def test_runs_within_and_across_rows(spark):
    r = rng(15)
    make = lambda n: "".join(r.choice("abcdefgh é") for _ in range(n))
    texts = ["a" * 401, "a" * 400, "b" * 400, "x" * 399 + "y", make(300) + "ab" * 500 + make(300), "ab" * 300, "c" * 900 + make(200), "0123456789" * 300, "z" * 399]
    rows = suffixdedup.cut_repeats(frame(spark, texts)).collect()
    assert {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in rows} == dict(enumerate(plain(texts, 400)))
    for x in rows:
        if texts[x.doc_id].isascii():
            assert hashlib.sha256(x.text.encode()).hexdigest() == x.kept_sha256


def test_any_column_names(spark):
    docs = spark.createDataFrame([(1, "t" * 900, "u", 1, 2, 3), (2, "own text", "v", 4, 5, 6)], "doc_id long, text string, spans string, _own_id long, _key_id long, `a.b` long")
    out = suffixdedup.drop_repeats(docs)
    assert out.schema == docs.schema and {(x.doc_id, x.text, x["a.b"]) for x in out.collect()} == {(1, "", 3), (2, "own text", 6)}
    assert suffixdedup.drop_repeats(docs.drop("text")).columns == docs.drop("text").columns
    assert suffixdedup.drop_repeats(docs.drop("doc_id")).count() == 2


@pytest.mark.parametrize("most, at_once", [(0, 20_000), (3, 20_000), (4096, 5)])
def test_hot_cores_and_small_portions(spark, monkeypatch, most, at_once):
    """Start by start, or sorted, or some of each: the same spans."""
    monkeypatch.setattr(suffixdedup, "MOST", most)
    monkeypatch.setattr(suffixdedup, "SORTED", at_once)
    texts = corpus(rng(77), 240, "abcdefgh é")
    make = lambda r, n: "".join(r.choice("abcdefgh ") for _ in range(n))
    r = rng(78)
    core = make(r, 225)  # a passage shorter than the length in many surroundings, some of which agree
    texts += [make(r, 40)[: r.randrange(40)] + x[: r.randrange(1, 60)][::-1] + core + y[: r.randrange(60)] + make(r, 40) for x, y in [(make(rng(79 + i % 3), 60), make(rng(89 + i % 4), 60)) for i in range(40)]]
    rows = suffixdedup.cut_repeats(frame(spark, texts), 240).collect()
    assert {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in rows} == dict(enumerate(plain(texts, 240)))


def test_orders_against_plain_comparison():
    import numpy as np

    r = rng(16)
    for _ in range(60):
        width, n = r.randrange(1, 9), r.randrange(1, 30)
        cores = np.array([r.randrange(-2, 2) for _ in range(n)], np.int64)
        high = np.array([r.randrange(width + 1) for _ in range(n)])
        low = np.array([r.randrange(h + 1) for h in high])
        byte = lambda k: bytes(r.choice(b"\0ab") for _ in range(k))
        lefts, rights = [byte(h) for h in high], [byte(width - x) for x in low]
        got = suffixdedup.repeated_in_order(cores, lefts, rights, low, high, width)
        all_ = [(c, d, left[len(left) - d :], right[: width - d]) for c, lo, hi, left, right in zip(cores.tolist(), low, high, lefts, rights) for d in range(lo, hi + 1)]
        seen = Counter(all_)
        for i in range(n):
            for d in range(width + 1):
                there = low[i] <= d <= high[i]
                assert got[i, d] == (there and seen[cores[i].item(), d, lefts[i][len(lefts[i]) - d :], rights[i][: width - d]] > 1)

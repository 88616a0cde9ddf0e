import zlib
from array import array
from collections import defaultdict

import public_tokenizers
from tokenizers import Tokenizer

from reelspark.llm import packing
from tests.llm.fixtures import rng

PATH = public_tokenizers.path("byte_bpe_50k.json")


def check(docs, rows, size):
    """Every id in exactly one piece, sequences without gaps, right checksums."""
    plain = Tokenizer.from_file(PATH)
    plain.encode_special_tokens = True
    ids = {d: [*plain.encode(t or "", add_special_tokens=False).ids, 0] for d, t in docs}
    pieces, places = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        places[r.sequence_id].append((r.offset, r.length))
    assert pieces.keys() == ids.keys()
    for d, own in pieces.items():
        at = 0
        for r in sorted(own, key=lambda r: r.start):
            assert r.start == at and r.length > 0 and r.doc_tokens == len(ids[d])
            assert r.ids_crc32 == zlib.crc32(array("I", ids[d][at : at + r.length]).tobytes())
            at += r.length
        assert at == len(ids[d])
    for own in places.values():
        at = 0
        for o, n in sorted(own):
            assert o == at
            at += n
        assert at <= size and (at == size or at & (at - 1) == 0)


def test_all_ids_once_and_windows_follow_shares(spark):
    docs = [(i, f"word {i} " * (i % 17) + "Überzug, it's  two\n lines", "ab"[i % 3 == 0]) for i in range(300)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string").repartition(3)
    rows = packing.pack(df, PATH, size=64, window=256).collect()
    check([(d, t) for d, t, _ in docs], rows, 64)
    total = sum(r.length for r in rows)
    owed = defaultdict(int)
    for r in rows:
        owed[r.source_queue] += r.length
    for q, n in owed.items():
        got = 0
        for k in range(total // 256):
            got += sum(r.length for r in rows if r.source_queue == q and r.window_id == k)
            assert abs(got - (k + 1) * 256 * n / total) <= 1


def test_odd_rows(spark):
    docs = [(1, None, None), (2, "", "a"), (3, "x" * 30000, "a"), (4, "<|endoftext|> a", "b"), (5, "same", "c"), (6, "same", "d")]
    df = spark.createDataFrame([(*d, 7) for d in docs], "doc_id long, text string, source string, ids int")
    check([(d, t) for d, t, _ in docs], packing.pack(df, PATH, size=1024).collect(), 1024)
    assert packing.pack(df.limit(0), PATH).count() == 0


def test_phases_serve_the_targets_until_a_queue_is_dry():
    plan = packing.phases({"a": 100, "b": 1000, "c": 50, "": 70}, {"a": 0.5, "b": 0.3, "c": 0.2}, 64)
    assert plan[0] == {"a": 100, "b": 60, "c": 40} and plan[-1] == {"": 70}
    assert {q: sum(p.get(q, 0) for p in plan) for q in ("a", "b", "c", "")} == {"a": 100, "b": 1000, "c": 50, "": 70}
    assert packing.phases({}, {"a": 1.0}, 64) == []
    r = rng(3)
    for _ in range(100):
        held = {q: r.randrange(0, 5000) for q in "abcde"}
        plan = packing.phases(held, {q: r.choice([0, 0.1, 0.25, 3]) for q in "abcd"}, 64)
        assert all(sum(p.get(q, 0) for p in plan) == n for q, n in held.items()) and all(p for p in plan)
        # every token has a place of its own
        places = [x for q, n in held.items() for k, take, at in packing.in_phases(q, 0, n, plan, 64) for x in range(at, at + take) if k == x // 64]
        assert sorted(places) == list(range(sum(held.values())))


def test_windows_follow_targets_and_carry_deficits(spark):
    docs = [(i, f"word {i} " * (i % 23), "abcd"[i % 4] if i % 9 else None) for i in range(400)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string").repartition(3)
    rows = packing.pack(df, PATH, size=64, window=256, targets={"a": 0.5, "b": 0.25, "c": 0.125, "none such": 0.0}).collect()
    check([(d, t) for d, t, _ in docs], rows, 64)
    got, share = defaultdict(lambda: defaultdict(int)), {"=a": 0.5, "=b": 0.25, "=c": 0.125}
    for x in rows:
        got[x.window_id][x.source_queue] += x.length
    held = {q: sum(w[q] for w in got.values()) for q in share}
    dry = min(int(held[q] / s) for q, s in share.items()) // 256  # windows until a named source runs dry
    assert dry > 5
    for q, s in share.items():
        served = 0
        for k in range(dry):
            served += got[k][q]
            assert abs(served - s * 256 * (k + 1)) <= 1.5, (q, k)
    assert min(w for w in got if not got[w]["=a"]) >= dry and max(got) > dry

import hashlib
import random

import numpy as np

from terrane.llm import repeats
from terrane.llm.repeats import anchors_of, removal_report
from tests.llm.data import empty, frame


def _brute(docs, size=50):
    big, first = 2 ** 63 - 1, {}
    for i, t in docs:
        b, i = (t or "").encode(), big if i is None else i
        for p in range(len(b) - size + 1):
            k = b[p:p + size]
            first[k] = min(first.get(k, i), i)
    out = []
    for i, t in docs:
        b, j = (t or "").encode(), big if i is None else i
        cut = bytearray(len(b))
        for p in range(len(b) - size + 1):
            if first[b[p:p + size]] < j:
                cut[p:p + size] = b"\1" * size
        runs = sum(1 for q in range(len(cut)) if cut[q] and not (q and cut[q - 1]))
        kept = bytes(x for x, c in zip(b, cut) if not c)
        out.append((i, len(b), sum(cut), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(map(str, out))


def _agree(df, **settings):
    got = sorted(str(tuple(r)) for r in removal_report(df, **settings).collect())
    assert got == _brute([(r.doc_id, r.text) for r in df.collect()])


def test_hard_rows(spark):
    _agree(frame(spark))
    assert removal_report(empty(spark)).count() == 0


def test_passages_over_batches(spark):
    rnd = random.Random(2)
    shared = ["".join(rnd.choice("abcde é") for _ in range(rnd.randint(40, 160))) for _ in range(12)]
    rows = []
    for i in range(200):
        t = "".join(rnd.choice(shared) if rnd.random() < 0.5 else
                    "".join(rnd.choice("abcdefgh ") for _ in range(rnd.randint(0, 120)))
                    for _ in range(rnd.randint(0, 8)))
        rows.append((i if i % 29 else rnd.choice([5, None]), "a" * rnd.randint(30, 200) if i % 17 == 0 else t))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    _agree(df, batch_rows=20, run_entries=1)
    _agree(df, batch_rows=20, contexts=1)         # nearly every key by its windows
    _agree(df, batch_rows=500)


def test_long_texts_in_pieces(monkeypatch):
    rnd = random.Random(3)
    texts = ["".join(rnd.choice("ab ") for _ in range(n)).encode() for n in (10, 49, 50, 51, 700, 2000, 90)]
    pick = lambda parts: sorted(
        (int(r), int(p), int(n), int(k), int(b)) for a in parts
        for r, p, n, k, b in zip(a.row, a.left, a.size, a.key, a.block))
    whole = pick(anchors_of(texts))
    monkeypatch.setattr(repeats, "_PIECE", 128)
    assert pick(anchors_of(texts)) == whole
    # every window is in a block
    starts = {(r, s) for r, p, n, *_ in whole for s in range(p, p + n - 49)}
    assert starts == {(r, s) for r, t in enumerate(texts) for s in range(len(t) - 49)}


def test_batches_by_bytes_and_many_buckets(spark):
    rnd = random.Random(4)
    shared = ["".join(rnd.choice("abc") for _ in range(200)) for _ in range(3)]
    rows = [(i, rnd.choice(shared) * rnd.randint(0, 3) + str(rnd.random())) for i in range(120)]
    rows += [(3, rows[3][1]), (None, shared[0]), (2 ** 63 - 1, shared[0] + "x"), (2 ** 63 - 1, "y" * 60),
             (None, "y" * 61), (-2 ** 63, shared[1][20:120])]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    _agree(df, batch_bytes=1_500, batch_rows=5, bucket_bytes=2_000)
    _agree(df, batch_bytes=1, contexts=2, run_entries=5)         # one row a batch


def test_periodic_texts(spark):
    unit = "".join(random.Random(5).choice("abcdefgh") for _ in range(61))
    rows = [(1, "z" * 3_000), (2, "z" * 9_000 + "end"), (3, "ab" * 4_000), (4, "q" + "ab" * 100), (5, unit * 40),
            (6, "head" + unit * 30 + "tail"), (7, unit[:49]), (8, unit[5:] + unit[:5]), (0, "ba" * 40), (2, "z" * 70)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    _agree(df)
    _agree(df, batch_rows=1)
    _agree(df, batch_rows=2, contexts=1, run_entries=1)


def test_a_run_of_one_letter_sends_few_entries():
    """However long the text, a key holds one entry a batch, and occurrences
    that overlap are one."""
    s = repeats.Suffixes([b"a" * 3_000_000], np.array([1]), repeats.CONTEXTS)
    assert s.begins.sum() < 60 and len(s.key) < 60 + 60 * (3_000_000 // repeats._PIECE + 1)


def _run(rnd, n, keys, blocks):
    pairs = np.unique(np.column_stack((rnd.integers(0, keys, n), rnd.integers(0, blocks, n))), axis=0)
    return pairs[:, 0].astype(np.uint64), pairs[:, 1].astype(np.uint64), rnd.integers(0, 40, len(pairs)), np.arange(len(pairs))


def test_every_run_is_scanned_against_the_levels():
    """Cuts and asks gathered run by run are those of a look at all entries."""
    rnd = np.random.default_rng(7)
    for contexts in (1_000, None):
        family, entries = repeats.RunFamily(contexts), []
        for batch in range(30):
            run = _run(rnd, 20, 150, 3)
            family.add(*run[:3], np.full(len(run[0]), batch), run[3])
            entries += [(batch, *(int(c[i]) for c in run)) for i in range(len(run[0]))]
            sizes = [len(x[0]) for x in family.levels]
            assert all(a >= 2 * b for a, b in zip(sizes, sizes[1:]))
            # one earliest holder of each block is left
            live = [(int(k), int(b), int(i)) for lv in family.levels
                    for k, b, i, on in zip(lv[0], lv[1], lv[2], lv[repeats._LIVE]) if on]
            least = {}
            for _, k, b, i, _ in entries:
                least[k, b] = min(least.get((k, b), i), i)
            assert {(k, b): i for k, b, i in live} == least and all(least[k, b] == i for k, b, i in live)
        named = lambda found: {(int(b), int(n)) for x in found for b, n in zip(*x)}
        assert named(family.cuts) == {(t, n) for t, k, b, i, n in entries if i > least[k, b]}
        if contexts:
            by_key = {}
            for (k, b), i in least.items():
                by_key.setdefault(k, []).append(i)
            need = {(t, n) for t, k, b, i, n in entries
                    if i == least[k, b] and len(by_key[k]) > 1 and len(set(by_key[k])) > 1}
            assert need <= named(family.asks)


def test_a_key_with_many_entries_becomes_a_mark():
    family = repeats.RunFamily(4)
    one = np.ones(1, np.uint64)
    for batch in range(50):
        family.add(one, one * np.uint64(batch), np.array([batch]), np.array([batch]), np.array([0]))
        assert sum(int(lv[repeats._LIVE].sum()) for lv in family.levels) <= 5
    assert {int(b) for x in family.asks for b in x[0]} == set(range(50)) and not sum(len(x[0]) for x in family.cuts)

import math
import random
from collections import Counter

import numpy as np
import pytest

from terrane.llm import negatives
from terrane.llm.negatives import Columns, TopRanks, Windows, hard_negatives, vertical_scan

SCHEMA = "vec_id long, embedding array<double>, label int, row long, shard string, rank int"


def _rows(n=420, dim=9, seed=1, labels=4):
    rnd = random.Random(seed)
    same = [rnd.gauss(0, 1) for _ in range(dim)]
    out = []
    for i in range(n):
        mid = [math.cos(i % labels + j) for j in range(dim)]
        v = same if i % 3 == 0 else [m + rnd.gauss(0, 0.8) for m in mid]
        out.append((i, v, rnd.choice([0, 0, rnd.randrange(labels)])))
    out += [(1000, None, 1), (1100, [None] + same[1:], 1), (1200, [float("nan")] + same[1:], 1),
            (1300, [float("inf")] + same[1:], 1), (None, same, 1), (1400, same, None), (100, same, 1), (1500, same[:3], 2),
            (1600, [], 3), (1700, [-x for x in same], 77), (1800, [0.0] * dim, 0)]
    return [(*r, 5, "x", 1) for r in out]


def _brute(rows, every=100, positives=5, k=10):
    v = [(i, [math.floor(256 * x) for x in e], c) for i, e, c, *_ in rows
         if i is not None and c is not None and e is not None and all(x is not None and math.isfinite(x) for x in e)]
    out = Counter()
    for a, (i, q, c) in enumerate(v):
        if i % every:
            continue
        s = [(-sum(x * y for x, y in zip(q, e)), j, d == c) for b, (j, e, d) in enumerate(v) if a != b]
        for p, j, _ in sorted(x for x in s if x[2])[:positives]:
            fit = sorted(x for x in s if not x[2] and 30 * -p <= 100 * -x[0] <= 90 * -p)[:k]
            out.update((i, j, r + 1, m, -p, -score) for r, (score, m, _) in enumerate(fit))
    return out


def _got(df):
    return Counter((r.anchor_id, r.positive_id, r.rank, r.negative_id, r.positive_score, r.negative_score)
                   for r in df.collect())


@pytest.mark.parametrize("size", [16_384, 12])
def test_against_brute_force(spark, monkeypatch, size):
    """Also with many small shards, blocks and copies of a shard."""
    if size < 100:
        monkeypatch.setattr(negatives, "BLOCK", 7)
        monkeypatch.setattr(negatives, "GUESTS", 2)
    rows = _rows()
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = hard_negatives(df, size=size)
    assert _got(got) == _brute(rows)
    per_row = Counter((r.anchor_row, r.positive_rank, r.rank) for r in got.collect())
    assert max(per_row.values()) == 1


def test_empty_and_alone(spark):
    assert hard_negatives(spark.createDataFrame([], SCHEMA)).count() == 0
    one = spark.createDataFrame([(0, [1.0], 1, 5, "x", 1), (1, [2.0], 2, 5, "x", 1)], SCHEMA)
    assert hard_negatives(one).count() == 0           # no positive, so no window


def test_large_values(spark):
    rows = [(i, [float(2 ** 12 + i), -3.0 * i], i % 2, 5, "x", 1) for i in range(0, 300, 5)]
    assert _got(hard_negatives(spark.createDataFrame(rows, SCHEMA))) == _brute(rows)


def test_scan_prunes_and_is_exact():
    rng = np.random.default_rng(4)
    data = rng.integers(-300, 300, (32, 800)) * (np.arange(32, 0, -1) ** 2)[:, None]
    shard = Columns(data, rng.permutation(800), np.arange(800))
    q = rng.integers(-300, 300, 32) * np.arange(32, 0, -1) ** 2
    score = q @ data
    read = []

    class Seen(TopRanks):
        def keep(self, lower, upper):
            read.append(len(lower))
            return super().keep(lower, upper)

    (_, at, s), = vertical_scan(q, shard, Seen(5, None), but=int(np.argmax(score)))
    want = sorted((-x, i, k) for k, (x, i) in enumerate(zip(score, shard.ids)) if k != np.argmax(score))[:5]
    assert [(-x, shard.ids[a], a) for a, x in zip(at, s)] == want
    assert read[0] == 799 and read[-1] < 50           # the bitmap shrinks as dimensions are read
    positives = [int(np.sort(score)[-1]), int(np.sort(score)[-40]), 0, -5]
    for i, at, s in vertical_scan(q, shard, Windows(10, positives, [None] * 4)):
        p = positives[i]
        fit = sorted((-x, j) for x, j in zip(score, shard.ids) if 30 * p <= 100 * x <= 90 * p)[:10]
        assert [(-x, shard.ids[a]) for a, x in zip(at, s)] == fit

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from terrane.llm import packing
from terrane.llm.packing import best_fit_decreasing, lower_bound, pack, pack_documents
from tests.llm.data import empty, frame

PATH = public_tokenizers.path("byte_bpe_50k.json")


def _check_offsets(rows, capacity=1024):
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= capacity
    return len(by)


def test_documents(spark):
    docs, library = frame(spark), Tokenizer.from_file(PATH)
    got = pack_documents(docs, PATH).collect()
    want = []
    for r in docs.collect():
        ids = np.array(library.encode(r.text or "", add_special_tokens=False).ids + [2], "<u4")
        first = len(ids) % 1024 or 1024
        cuts = [0, *range(first, len(ids) + 1, 1024)]
        want += [(r.doc_id, k, a, b - a, zlib.crc32(ids[a:b].tobytes()))
                 for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    assert sorted(map(str, want)) == sorted(
        str((r.doc_id, r.piece, r.start, r.length, r.ids_crc32)) for r in got)
    bins = _check_offsets(got)
    assert bins <= lower_bound(np.array([r.length for r in got])) + 1


def test_many_partitions_stay_near_the_bound(spark):
    rnd = random.Random(2)
    sizes = [rnd.choice([rnd.randint(1, 1024), 700, 330]) for _ in range(30_000)]
    cut = spark.createDataFrame([(i, 0, 0, n, 0) for i, n in enumerate(sizes)],
                                "doc_id long, piece int, start long, length long, ids_crc32 long")
    rows = pack(cut).collect()
    assert len(rows) == len(sizes)
    assert _check_offsets(rows) <= lower_bound(np.array(sizes)) * 1.01


def test_exchange_until_nothing_is_saved(spark, monkeypatch):
    monkeypatch.setattr(packing, "PARTITION_ITEMS", 40)
    rnd = random.Random(4)
    sizes = [rnd.randint(150, 600) for _ in range(2_000)]
    cut = spark.createDataFrame([(i, 0, 0, n, 0) for i, n in enumerate(sizes)],
                                "doc_id long, piece int, start long, length long, ids_crc32 long").coalesce(1)
    rows = pack(cut).collect()
    assert len(rows) == len(sizes)
    assert _check_offsets(rows) < _check_offsets(pack(cut, rounds=3).collect())


def test_bounds_hold():
    rnd = random.Random(3)
    for _ in range(200):
        sizes = np.array([rnd.randint(1, 20) for _ in range(rnd.randint(1, 30))])
        bins, _ = best_fit_decreasing(sizes, 20)
        assert lower_bound(sizes, 20) <= bins.max() + 1
        assert (np.bincount(bins, sizes) <= 20).all()
    assert lower_bound(np.array([11] * 7), 20) == 7
    assert lower_bound(np.array([7] * 10), 20) == 5


def test_empty(spark):
    assert pack_documents(empty(spark), PATH).count() == 0

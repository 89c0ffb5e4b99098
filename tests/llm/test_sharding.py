import math
import zlib
from collections import Counter, defaultdict

import pytest
import xxhash

from terrane.llm.sharding import assign_shards, shard_documents
from tests.llm.data import empty, frame


def test_shards_slots_and_growth(spark):
    docs = frame(spark)
    got = shard_documents(docs, [1.0] * 7).collect()
    assert len(got) == docs.count()
    texts = Counter((r.doc_id, len((r.text or "").encode()) + 16, zlib.crc32((r.text or "").encode()))
                    for r in docs.collect())
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == texts
    slots = defaultdict(list)
    by_key = defaultdict(set)
    for r in got:
        slots[r.shard].append(r.slot)
        by_key[r.doc_id].add(r.shard)
        assert r.law == "key" and 0 <= r.shard < 7
        assert r.grown_shard in (r.shard, 7)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(s) == 1 for s in by_key.values())


def _scores(key, weights):
    """-weight / ln(u) of every shard, u from the key's and the shard's hash."""
    out = []
    for i, w in enumerate(weights):
        h = xxhash.xxh64("\0null" if key is None else str(key), seed=42).intdigest()
        for number in (i, 0):
            h = xxhash.xxh64(number.to_bytes(4, "little"), seed=h).intdigest()
        out.append(-w / math.log(((h >> 11) + 0.5) / 2 ** 53))
    return out


def test_every_row_goes_to_the_shard_of_its_largest_score(spark):
    weights = [1.0, 2.5, 0.5, 1.0, 4.0, 1.0]
    got = shard_documents(frame(spark), weights, 2.0).collect()
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got += shard_documents(docs, weights, 2.0).collect()
    assert len(got) > 500
    for r in got:
        *own, added = _scores(r.doc_id, [*weights, 2.0])
        best = max(range(len(own)), key=lambda i: (own[i], -i))
        assert (r.shard, r.grown_shard) == (best, len(own) if added > own[best] else best), r.doc_id


def test_more_shards_agree_with_growth(spark):
    keys = spark.range(3000).withColumnRenamed("id", "doc_id")
    before = {r.doc_id: r for r in assign_shards(keys, "doc_id", [1.0] * 10).collect()}
    after = {r.doc_id: r.shard for r in assign_shards(keys, "doc_id", [1.0] * 11).collect()}
    assert all(after[k] == r.grown_shard for k, r in before.items())
    moved = sum(after[k] != r.shard for k, r in before.items())
    assert moved == pytest.approx(3000 / 11, rel=0.25)


def test_weights(spark):
    keys = spark.range(6000).withColumnRenamed("id", "doc_id")
    n = Counter(r.shard for r in assign_shards(keys, "doc_id", [1.0, 2.0, 3.0]).collect())
    assert n[1] / n[0] == pytest.approx(2, rel=0.2) and n[2] / n[0] == pytest.approx(3, rel=0.2)


def test_empty(spark):
    assert shard_documents(empty(spark), [1.0] * 3).count() == 0

import hashlib
import re
from collections import defaultdict

from terrane.llm.exact import DigestIndex, batch_groups, drop_exact_copies, exact_decisions
from terrane.session import shared_dir
from tests.llm.data import empty, frame


def _norm(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


def test_decisions(spark):
    docs = frame(spark)
    groups = defaultdict(list)
    for r in docs.collect():
        groups[hashlib.sha256(_norm(r.text).encode()).hexdigest()].append(r.doc_id)
    for batches in (1, 2, 5):
        got = defaultdict(list)
        for r in exact_decisions(docs, batches=batches).collect():
            got[r.text_sha256].append(r)
        assert got.keys() == groups.keys()
        for h, rows in got.items():
            assert sorted(map(str, (r.doc_id for r in rows))) == sorted(map(str, groups[h]))
            known = [i for i in groups[h] if i is not None]
            assert {r.keep_id for r in rows} == {min(known) if known else None}
            assert {r.group_size for r in rows} == {len(rows)}
            assert sum(r.kept for r in rows) == 1


def test_stored_index_takes_later_batches(spark):
    docs = frame(spark).filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    path = shared_dir(spark, "index")
    first = DigestIndex(spark, path, 4)
    exact_decisions(docs.filter("doc_id < 60"), first, batches=1).count()
    n = first.read().count()
    again = DigestIndex(spark, path, 4)           # taken up again by its folder
    assert again.read().count() == n
    rows = exact_decisions(docs, again, batches=1)
    assert again.read().count() == len({_norm(r.text) for r in docs.collect()})
    plan = batch_groups(rows.withColumnRenamed("text_sha256", "digest")).join(
        again.read().select("digest"), "digest", "left_anti")
    assert plan is not None


def test_drop(spark):
    docs = frame(spark)
    kept = drop_exact_copies(docs)
    assert kept.columns == docs.columns
    texts = [_norm(r.text) for r in kept.collect()]
    assert len(texts) == len(set(texts)) == len({_norm(r.text) for r in docs.collect()})
    assert drop_exact_copies(empty(spark)).count() == 0

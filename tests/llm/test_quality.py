import math
import zlib

import numpy as np

from terrane.llm.quality import FactorisationMachine, classify, fit_quality, quality_scores, statistics_and_words
SF_LLM = "/root/testdata/sf0.01"
from tests.llm.data import empty, frame


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF_LLM}/documents.parquet")
    labels = spark.read.parquet(f"{SF_LLM}/labels.parquet")
    quality = {r.doc_id: r.quality for r in labels.collect()}
    got = classify(docs, labels).collect()
    assert len(got) == docs.count()
    right = n = 0
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
        if r.held_out and r.doc_id in quality:
            n += 1
            right += r.predicted == quality[r.doc_id]
    assert n > 30 and right / n >= 0.97


def test_labels_of_the_held_out_fold_are_not_learned(spark):
    docs = spark.read.parquet(f"{SF_LLM}/documents.parquet")
    labels = spark.read.parquet(f"{SF_LLM}/labels.parquet")
    from pyspark.sql import functions as F
    from terrane.llm.quality import held_out
    turned = labels.withColumn("quality", F.when(held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (FactorisationMachine.from_bytes(fit_quality(docs, x)) for x in (labels, turned))
    assert np.array_equal(a.w, b.w) and np.array_equal(a.v, b.v)


def test_pair_sum_identity():
    rng = np.random.default_rng(1)
    fm = FactorisationMachine(np.zeros(16), np.ones(16), np.zeros((16, 8)), 0.1,
                              rng.normal(size=FactorisationMachine.size()),
                              rng.normal(0, 0.1, (FactorisationMachine.size(), 4)))
    stats, words = statistics_and_words("Ein kleiner Text, ein Text!".encode())
    at, x = fm.vector(stats, words)
    y = fm.w0 + fm.w[at] @ x + sum(fm.v[at[i]] @ fm.v[at[j]] * x[i] * x[j]
                                   for i in range(len(at)) for j in range(i))
    assert np.isclose(fm.score(stats, words), 1 / (1 + np.exp(-y)))


def test_every_score_is_the_sum_over_all_pairs(spark):
    """Scores of all rows from the fitted weights, pair by pair."""
    labels = spark.read.parquet(f"{SF_LLM}/labels.parquet")
    docs = spark.read.parquet(f"{SF_LLM}/documents.parquet").select("doc_id", "text")
    model = fit_quality(docs, labels)
    fm = FactorisationMachine.from_bytes(model)
    n = 0
    for some in (docs, frame(spark).select("doc_id", "text")):
        for r in quality_scores(some, model).collect():
            at, x = fm.vector(*statistics_and_words((r.text or "").encode()))
            v = fm.v[at]
            y = fm.w0 + sum(fm.w[a] * b for a, b in zip(at, x))
            y += sum(float((v[:i] @ v[i] * x[:i]).sum() * x[i]) for i in range(1, len(at)))
            want = 1 / (1 + math.exp(-max(-30.0, min(30.0, y))))
            assert math.isclose(r.score, want, rel_tol=1e-9, abs_tol=1e-12), r.doc_id
            assert r.predicted == int(r.score >= 0.3)
            n += 1
    assert n > 500


def test_hard_rows(spark):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(100)] + [(None, 1, 0), (3, None, 0)],
                                   "doc_id long, quality int, toxic int")
    docs = frame(spark)
    assert classify(docs, labels).count() == docs.count()
    assert classify(empty(spark), labels).count() == 0
    none = classify(docs, labels.limit(0)).collect()
    assert {r.score for r in none} == {0.5}
    scored = quality_scores(docs, fit_quality(docs, labels))
    assert scored.columns == [*(c for c in docs.columns if c != "score"), "score", "predicted"]
    assert scored.count() == docs.count()

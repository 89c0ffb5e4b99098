import zlib
from collections import Counter

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from terrane.llm import tokenfile
from tests.llm.data import empty, frame

PATH = public_tokenizers.path("word_bpe_49k.json")


def _check(spark, docs, path):
    library = Tokenizer.from_file(PATH)
    tokenfile.write_token_files(docs, path, PATH)
    got = [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in tokenfile.read_token_files(spark, path).collect()]
    want = Counter()
    for r in docs.collect():
        ids = np.array(library.encode(r.text or "", add_special_tokens=False).ids + [2], "<u4")
        want[(r.doc_id, len(ids), zlib.crc32(ids.tobytes()))] += 1
    assert Counter((a, c, d) for a, _, c, d in got) == want
    at = 0
    for _, start, n, _ in sorted(got, key=lambda r: r[1]):
        assert start == at
        at += n
    keys = [10 ** 18 if r[0] is None else r[0] for r in sorted(got, key=lambda r: r[1])]
    assert keys == sorted(keys)


def test_files_in_order(spark, tmp):
    _check(spark, frame(spark), f"{tmp}/a")


def test_hot_id_is_split(spark, tmp):
    docs = frame(spark).withColumn("doc_id", F.when(F.col("doc_id") % 3 == 0, 40).otherwise(F.col("doc_id")))
    _check(spark, docs, f"{tmp}/a")
    asked = spark.createDataFrame([(40,), (4,), (999,), (None,)], "doc_id long")
    found = Counter(r.doc_id for r in tokenfile.lookup_ids(spark, f"{tmp}/a", asked).collect())
    assert found == Counter(r.doc_id for r in docs.filter("doc_id IN (40, 4)").collect())


def test_empty(spark, tmp):
    _check(spark, empty(spark), f"{tmp}/a")


def test_perfect_hash():
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 17, 5000):
        h = tokenfile.key_hash(rng.choice(10 ** 9, n, replace=False), np.zeros(n, np.int64))
        pilots, slots = tokenfile.build_mph(h)
        assert sorted(slots.tolist()) == list(range(n))
        assert (tokenfile.find_slots(h, pilots, n) == slots).all()

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from terrane.llm.bpe import PairIndexBpe, PartitionEncoder, bpe_decode, bpe_encode, bpe_roundtrip_digests
from terrane.llm.fastids import FastIds
from tests.llm.data import empty, frame

NAMES = ["byte_bpe_50k.json", "word_bpe_49k.json"]


def _texts(n=1500):
    rnd = random.Random(4)
    parts = list("abcABC  \t\n\r\x0b\x0c\x1c\x85\xa0'sd're0123.,!?#é́èßŒÅΣσςÉ中文日本🙂👍🏽İı​<|endoftext|>_\\@\x01") + [
        "<|endoftext|>", "<|startoftext|>", "'ll", "aaaa", "  ", "\n\n", "ŉ", "ĸſ", "ÿÀ×÷"]
    return ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 60))) for _ in range(n)] + ["", "a" * 5000]


@pytest.mark.parametrize("name", NAMES)
def test_ids_equal_the_library(name):
    path = public_tokenizers.path(name)
    library, texts = Tokenizer.from_file(path), _texts()
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [r.tolist() for r in PartitionEncoder(PairIndexBpe(path)).encode(texts)] == want
    fast = FastIds(path)
    assert [fast.ids(t).tolist() for t in texts] == want
    assert [np.frombuffer(fast.id_bytes(t), fast.kind).tolist() for t in texts] == want


def test_decode_equals_the_library():
    path = public_tokenizers.path(NAMES[0])
    library, model = Tokenizer.from_file(path), PairIndexBpe(path)
    for ids in ([], [50256, 1, 2], list(range(0, 50257, 7)), [200, 201]):
        assert model.decode(np.array(ids, np.int64)) == library.decode(ids, skip_special_tokens=False)


def test_roundtrip_query(spark):
    path = public_tokenizers.path(NAMES[0])
    library, docs = Tokenizer.from_file(path), frame(spark)
    got = sorted(map(tuple, bpe_roundtrip_digests(docs, path).collect()), key=str)
    want = []
    for r in docs.collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        want.append((r.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                     hashlib.sha256(text.encode()).hexdigest()))
    assert got == sorted(want, key=str)
    assert bpe_roundtrip_digests(empty(spark), path).count() == 0


def test_encode_then_decode(spark):
    path = public_tokenizers.path(NAMES[0])
    docs = frame(spark).select("doc_id", "text")
    back = bpe_decode(bpe_encode(docs, path), path)
    assert sorted(map(str, ((r.doc_id, r.text) for r in back.collect()))) == sorted(
        map(str, ((r.doc_id, r.text or "") for r in docs.collect())))

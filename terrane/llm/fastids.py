"""Ids of whole texts as the ``tokenizers`` library gives them, by the faster
public ``tiktoken`` merge routine on the same vocabulary.

Two kinds of tokenizer file are read: byte-level BPE, and word BPE with an
end-of-word mark (lower case, white space dropped). For the second, words get
a one-byte end mark, and the pairs (byte, mark) are the first merges. Texts
that hold a special token, the mark itself or (word BPE) letters outside
ASCII and Latin-1/Latin Extended-A go through the ``tokenizers`` library
itself, so results are the library's for every text.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np

from terrane.llm.bpe import PairIndexBpe, _byte_symbols

_MARK = "\x01"
_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\w\s]|_)+").findall
#: ASCII, and the letters of Latin-1 and Latin Extended-A without those whose
#: lower case is two characters or that NFC changes.
_PLAIN = re.compile("[\x00\x02-\x1b\x20-\x7f\xc0-\xd6\xd8-\xf6\xf8-įıĴ-ľŁ-ňŊ-ſ]*").fullmatch


class FastIds:
    def __init__(self, path: str):
        import tiktoken
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        special = {t["content"] for t in spec["added_tokens"]}
        byte_of = {c: b for b, c in enumerate(_byte_symbols())}
        suffix = spec["model"].get("end_of_word_suffix") or ""
        vocab = {t: i for t, i in spec["model"]["vocab"].items() if t not in special}
        self.marked = bool(suffix)
        self.special = re.compile("|".join(map(re.escape, special))).search if special else (lambda t: None)

        def raw(token: str) -> bytes:
            ends = self.marked and token.endswith(suffix)
            body = token[:-len(suffix)] if ends else token
            return bytes(byte_of[c] for c in body) + (_MARK.encode() if ends else b"")

        ranks = {raw(t): i for t, i in vocab.items()}
        if len(ranks) != len(vocab):
            # (mark byte itself, plain) is the only token the mark shadows
            raise ValueError("vocabulary is not a byte-level BPE")
        pattern = r"[^\x01]*\x01" if self.marked else PairIndexBpe.BYTE_LEVEL
        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        #: the file type of ids: two bytes where the vocabulary allows
        self.kind = "<u2" if max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])]) < 2 ** 16 else "<u4"

    def id_bytes(self, text: str) -> bytes:
        """The ids as little-endian integers of ``kind``."""
        return self.ids(text).astype(self.kind).tobytes()

    def ids(self, text: str) -> np.ndarray:
        if self.special(text):
            return self._by_library(text)
        if self.marked:
            if not _PLAIN(text):
                return self._by_library(text)
            words = _WORDS(text.lower())
            if not words:
                return np.zeros(0, np.uint32)
            words.append("")
            text = _MARK.join(words)
        return self.encoding.encode_to_numpy(text, disallowed_special=())

    def _by_library(self, text: str) -> np.ndarray:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)


_known: dict[str, FastIds] = {}


def ids_of(path: str) -> FastIds:
    """The encoder of a file, made once per Python worker."""
    if path not in _known:
        _known[path] = FastIds(path)
    return _known[path]

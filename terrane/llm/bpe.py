"""BPE encoding and decoding with a pair occurrence index.

The distinct words of a partition are laid out as one flat symbol sequence.
An index maps every mergeable pair to all its positions there. The merges run
in ascending rank over the whole sequence: the lowest active rank is taken,
all its positions are merged at once, and only the neighbours of the merged
symbols are looked up again and filed under their new pairs. Words are
independent, so taking the lowest rank of all words is taking the lowest rank
of each. A document's ids are then gathered from its words' ids.

Edge cases: null and empty texts encode to no ids; a text may be of any
length (memory per task is one bounded chunk of texts plus its distinct
words); repeated rows give repeated results; an empty table gives no rows;
columns of the input that are not asked for are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
import json
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.llm.common import gather_slices, runs_by_size, texts_of

_CHUNK_CHARS = 6_000_000      # texts worked on at a time
_MAX_WORDS = 400_000          # distinct words kept; beyond, the word store starts anew


def _byte_symbols() -> list[str]:
    """The printable character that stands for each byte in the vocabulary:
    the byte's own Latin-1 character if printable, else the next free one
    from U+0100 on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    out, free = [], 0x100
    for b in range(256):
        if b in own:
            out.append(chr(b))
        else:
            out.append(chr(free))
            free += 1
    return out


class PairIndexBpe:
    """A byte-level BPE model read from a tokenizers JSON file."""

    #: Split patterns of the two public families (fixed values).
    BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

    def __init__(self, path: str):
        import regex
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab = {**model["vocab"], **{t["content"]: t["id"] for t in spec["added_tokens"]}}
        pre = spec["pre_tokenizer"]
        self.lower = bool(spec["normalizer"])
        if pre["type"] == "Sequence":
            pattern = pre["pretokenizers"][0]["pattern"]["Regex"]
        else:
            pattern = self.BYTE_LEVEL
        self.split = regex.compile(pattern).findall
        specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.specials = specials
        self.special_split = regex.compile(
            "(" + "|".join(map(regex.escape, specials)) + ")").split if specials else None
        suffix = model.get("end_of_word_suffix") or ""
        symbols = _byte_symbols()
        self.first_ids = np.array([vocab[c] for c in symbols], np.int32)
        self.last_ids = np.array([vocab[c + suffix] for c in symbols], np.int32)
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in merges], np.int64)
        right = np.array([vocab[b] for _, b in merges], np.int64)
        made = np.array([vocab[a + b] for a, b in merges], np.int64)
        # 32-bit pair codes where the vocabulary allows: half the memory to search
        size = max(vocab.values()) + 1
        self.code_type = np.uint32 if size * size < 2 ** 32 else np.uint64
        self.size = self.code_type(size)
        codes = left.astype(self.code_type) * self.size + right.astype(self.code_type)
        order = np.argsort(codes, kind="stable")
        self.left, self.right, self.made = left, right, made
        self.codes = codes[order]
        # 16-bit ranks where they fit: numpy sorts those by radix
        self.ranks = order.astype(np.uint16 if len(order) < 2 ** 16 else np.int64)
        byte_of = {c: b for b, c in enumerate(symbols)}
        pieces: list[bytes] = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            body = token[:-len(suffix)] + " " if suffix and token.endswith(suffix) else token
            if token in specials:
                pieces[i] = token.encode()
            else:
                pieces[i] = bytes(byte_of.get(c, 0x20) for c in body)
        self.piece_bytes = np.frombuffer(b"".join(pieces), np.uint8)
        self.piece_lens = np.array([len(p) for p in pieces], np.int64)
        self.piece_starts = np.cumsum(self.piece_lens) - self.piece_lens

    # --- words ---------------------------------------------------------
    def normal(self, text: str) -> str:
        if not self.lower:
            return text
        text = unicodedata.normalize("NFC", text)
        # lower-casing is per character: no context rule for the final sigma
        return "".join(c.lower() for c in text) if "Σ" in text else text.lower()

    def words(self, text: str) -> list:
        """The text's words in order; a special token is its id (an int)."""
        if self.special_split is None or "<|" not in text:
            return self.split(self.normal(text))
        out: list = []
        for piece in self.special_split(text):
            if piece in self.specials:
                out.append(self.specials[piece])
            elif piece:
                out.extend(self.split(self.normal(piece)))
        return out

    # --- merges --------------------------------------------------------
    def _pairs(self, sym, nxt, at):
        """Positions of ``at`` that start a mergeable pair, with its rank."""
        code = sym[at].astype(self.code_type) * self.size + sym[nxt[at]].astype(self.code_type)
        k = np.searchsorted(self.codes, code)
        k[k == len(self.codes)] = 0
        hit = self.codes[k] == code
        return at[hit], self.ranks[k[hit]]

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words one after the other, number of ids per word)."""
        raw = [w.encode() for w in words]
        lens = np.fromiter(map(len, raw), np.int64, len(raw))
        flat = np.frombuffer(b"".join(raw), np.uint8)
        n = len(flat)
        if n == 0:
            return np.zeros(0, np.int32), lens
        ends = np.cumsum(lens)[lens > 0] - 1
        begins = np.concatenate(([0], ends[:-1] + 1))
        sym = self.first_ids[flat]
        sym[ends] = self.last_ids[flat[ends]]
        nxt = np.arange(1, n + 1, dtype=np.int32)
        nxt[ends] = -1
        prv = np.arange(-1, n - 1, dtype=np.int32)
        prv[begins] = -1
        merged = np.full(n, -1, np.int32)     # the rank last merged at a position
        where: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def file_under(at, ranks):
            order = np.argsort(ranks, kind="stable")
            at, ranks = at[order], ranks[order]
            cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
            firsts = ranks[np.concatenate(([0], cuts))].tolist()
            edges = [0, *cuts.tolist(), len(at)]
            for j, r in enumerate(firsts):
                some = at[edges[j]:edges[j + 1]]
                if r in where:
                    where[r].append(some)
                else:
                    where[r] = [some]
                    heapq.heappush(heap, r)

        at, ranks = self._pairs(sym, nxt, np.flatnonzero(nxt >= 0).astype(np.int32))
        if len(at):
            file_under(at, ranks)
        while heap:
            r = heapq.heappop(heap)
            lists = where.pop(r)
            a, b, new = self.left[r], self.right[r], self.made[r]
            at = lists[0] if len(lists) == 1 else np.concatenate(lists)
            at = at[sym[at] == a]
            follow = nxt[at]
            ok = follow >= 0
            ok &= sym[follow] == b
            at = at[ok]
            if not len(at):
                continue
            if a == b and len(at) > 1:
                at = self._left_to_right(np.sort(at), nxt)
            gone = nxt[at]
            after = nxt[gone]
            sym[at] = new
            sym[gone] = -1
            nxt[at] = after
            has = after >= 0
            prv[after[has]] = at[has]
            merged[at] = r
            before = prv[at]
            before = before[before >= 0]
            # a left neighbour merged just now is looked up as itself
            look = np.concatenate((before[merged[before] != r], at[has]))
            if len(look):
                look, ranks = self._pairs(sym, nxt, look)
                if len(look):
                    file_under(look, ranks)
        alive = sym >= 0
        owner = np.repeat(np.arange(len(lens)), lens)
        return sym[alive], np.bincount(owner[alive], minlength=len(lens))

    @staticmethod
    def _left_to_right(at, nxt):
        """Of overlapping positions (a pair of equal symbols), every other one
        from the left of each run."""
        out, taken = [], -1
        for p, q in zip(at.tolist(), nxt[at].tolist()):
            if p != taken:
                out.append(p)
                taken = q
        return np.array(out, np.int32)

    # --- decoding ------------------------------------------------------
    def decode_bytes(self, ids: np.ndarray) -> bytes:
        return gather_slices(self.piece_bytes, self.piece_starts[ids], self.piece_lens[ids]).tobytes()

    def decode(self, ids: np.ndarray) -> str:
        """Text of ids (vocabularies with a word-end mark give a space there)."""
        return self.decode_bytes(ids).decode("utf-8", "replace")


class _Numbered(dict):
    def __missing__(self, key):
        self[key] = n = len(self)
        return n


class PartitionEncoder:
    """Encodes a partition's texts chunk by chunk; each distinct word is merged
    once. The word store is bounded: it starts anew beyond ``_MAX_WORDS``."""

    def __init__(self, model: PairIndexBpe):
        self.model = model
        self._reset()

    def _reset(self):
        self.number = _Numbered()
        self.flat = np.zeros(0, np.int32)
        self.lens = np.zeros(0, np.int64)
        self.starts = np.zeros(0, np.int64)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.number) > _MAX_WORDS:
            self._reset()
        known, words = len(self.number), self.model.words
        look = self.number.__getitem__
        rows = []
        for t in texts:
            found = words(t)
            rows.append(np.fromiter(map(look, found), np.int32, len(found)))
        if len(self.number) > known:
            self._add(list(itertools.islice(self.number, known, None)))
        return [gather_slices(self.flat, self.starts[r], self.lens[r]) for r in rows]

    def _add(self, words: list) -> None:
        """Encode new words; an int is a special token's id."""
        flat, lens = self.model.encode_words([w if isinstance(w, str) else "" for w in words])
        fixed = [(i, w) for i, w in enumerate(words) if not isinstance(w, str)]
        if fixed:
            ends = np.cumsum(lens)
            flat = np.insert(flat, [ends[i] for i, _ in fixed], [k for _, k in fixed])
            lens[[i for i, _ in fixed]] = 1
        self.flat = np.concatenate((self.flat, flat.astype(np.int32)))
        self.lens = np.concatenate((self.lens, lens))
        self.starts = np.cumsum(self.lens) - self.lens


_models: dict[str, PairIndexBpe] = {}
_coders: dict[str, PartitionEncoder] = {}


def model_of(path: str) -> PairIndexBpe:
    """The model of a file, read once per Python worker."""
    if path not in _models:
        _models[path] = PairIndexBpe(path)
    return _models[path]


def encoded_batches(batches, path: str, text_col: str = "text"):
    """(record batch, its rows' ids) in chunks of bounded text size."""
    coder = _coders.setdefault(path, PartitionEncoder(model_of(path)))   # lasts as long as the worker
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text_col))
        sizes = [0 if v is None else v for v in pc.binary_length(column).to_pylist()]
        for lo, hi in runs_by_size(sizes, _CHUNK_CHARS):
            part = batch.slice(lo, hi - lo)
            yield part, coder.encode(texts_of(column.slice(lo, hi - lo)))


def bpe_encode(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and ``ids`` (array of int) of every row's whole text."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        for part, rows in encoded_batches(batches, tokenizer):
            offsets = np.concatenate(([0], np.cumsum([len(r) for r in rows])))
            flat = np.concatenate(rows) if rows else np.zeros(0)
            ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()),
                                           pa.array(flat.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([part.column(0), ids], ["key", "ids"])

    return (docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
            .mapInArrow(run, f"key {kind}, ids array<int>").withColumnRenamed("key", key))


def bpe_decode(encoded: DataFrame, tokenizer: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """``key`` and ``text`` of every row's ids (null ids: empty text)."""
    kind = encoded.schema[key].dataType.simpleString()

    def run(batches):
        model = model_of(tokenizer)
        for b in batches:
            texts = [model.decode(np.array(r or [], np.int64)) for r in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())],
                                             ["key", "text"])

    return (encoded.select(F.col(key).alias("key"), F.col(ids).alias("ids"))
            .mapInArrow(run, f"key {kind}, text string").withColumnRenamed("key", key))


def bpe_roundtrip_digests(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Encode every whole text, decode the ids again, and return doc_id,
    n_tokens, ids_sha256 and decoded_sha256; ids never leave the task."""

    def run(batches):
        for part, rows in encoded_batches(batches, tokenizer):
            model = model_of(tokenizer)
            yield pa.RecordBatch.from_arrays([
                part.column(0),
                pa.array([len(r) for r in rows], pa.int64()),
                pa.array([hashlib.sha256(r.astype("<u4").tobytes()).hexdigest() for r in rows]),
                pa.array([hashlib.sha256(model.decode(r).encode()).hexdigest() for r in rows]),
            ], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")

"""Removal of long byte strings that an earlier document holds.

Every byte covered by a ``LENGTH``-byte string that also starts in a document
with a smaller id is removed. Strings are judged on the whole input.

The suffixes of all texts would be far larger than the input, so the suffix
index is sparse: in each window of ``LENGTH`` bytes the ``GRAM``-byte gram with
the smallest hash is an anchor, so two equal windows hold the same anchor at
the same place. A suffix is indexed where an anchor begins, under the hash of
the gram (its key), with the hash of its surroundings: all windows in which the
anchor's gram is the smallest together are one block.

Documents come in batches of at most ``BATCH_ROWS`` rows and ``BATCH_BYTES``
bytes, texts of like size together (one longer text is a batch of its own). A batch's suffixes are sorted (its
suffix array in key order); bucket of keys by bucket, the new run is scanned
against each level of a logarithmic family of sorted runs (a binary search for
its keys) and then joins the family: it is merged with the last level as long as
that is less than twice as long, so each level is at least twice the next. The scan
finds equal blocks (everything in a later one is removed; a family keeps the
earliest holder only) and keys with more than one block. Only for the first
document of each such block are single windows compared, again by a family.

Hot strings: a batch settles repeats among its own documents and sends one entry
for a block or window, whatever the number of its occurrences; these stay on the
batch's side, and an answer names the entry by its number in the batch's order.
A key with more than ``CONTEXTS`` blocks in one batch, or entries in the family
(the edge of a passage that very many documents share), becomes a mark, and its
windows are compared directly. So a key has at most ``CONTEXTS`` entries per batch
and a window one, however many documents hold it and however often one text
repeats it. Where a text has an anchor at nearly every byte (a run of one letter),
overlapping occurrences of a block are one.

Keys are 48-bit, blocks 40-bit (within a key) and windows 64-bit hashes.

Edge cases: null and empty texts, and texts under ``LENGTH`` bytes, lose
nothing; rows without an id count as if they had the largest long; rows with one
id never cover each other; very long texts are worked on in pieces that overlap; an
empty table gives no rows; other columns play no part.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.llm.common import fanout, mix64, utf8_of
from terrane.session import materialize, scratch, shared_dir

LENGTH = 50
GRAM = 24
CONTEXTS = 16
BATCH_ROWS = 512
BATCH_BYTES = 32 << 20
#: Entries of a run; batches with fewer in a bucket enter its family together.
RUN_ENTRIES = 1 << 15
#: Bytes of text whose entries a bucket of keys holds.
BUCKET_BYTES = 32 << 20
#: One anchor in so many bytes or fewer: a text that repeats itself closely.
DENSE = 6
_PIECE = 1 << 17
_EDGE = 2 * LENGTH
_LAST = 2 ** 63 - 1
_MARK = np.uint64(1 << 40)                      # above all blocks

_BASE = np.uint64(0x9E3779B97F4A7C15) | np.uint64(1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 2 ** 64))
_BYTES = mix64(np.arange(1, 257, dtype=np.uint64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_POW = _powers(_BASE, 1)
_INV = _powers(_INVERSE, 1)


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _POW, _INV
    if len(_POW) < n:
        _POW, _INV = _powers(_BASE, n), _powers(_INVERSE, n)
    return _POW, _INV


class Hashed:
    """Prefix sums of a byte buffer from which any slice's hash follows."""

    def __init__(self, raw: np.ndarray):
        power, self.inverse = _tables(len(raw) + 1)
        self.sums = np.concatenate((np.zeros(1, np.uint64),
                                    np.cumsum(_BYTES[raw] * power[:len(raw)], dtype=np.uint64)))

    def of(self, start, end) -> np.ndarray:
        return mix64((self.sums[end] - self.sums[start]) * self.inverse[start])

    def grams(self, size: int) -> np.ndarray:
        """Hashes of all slices of ``size`` bytes."""
        n = len(self.sums) - size
        return mix64((self.sums[size:] - self.sums[:n]) * self.inverse[:n]) if n > 0 else np.zeros(0, np.uint64)


def _sliding(a: np.ndarray, width: int, pick) -> np.ndarray:
    """pick (np.minimum or np.maximum) over each run of ``width`` elements."""
    span = 1
    while span * 2 <= width:
        a = pick(a[:-span], a[span:])
        span *= 2
    rest = width - span
    return pick(a[:-rest], a[rest:]) if rest else a


def pieces_of(texts: list[bytes]):
    """Buffers of about ``_PIECE`` bytes: (bytes, pieces), a piece being (row,
    begin and end of what it answers for in the text, its first byte's place
    in the text, its place in the buffer, its size)."""
    buffer, pieces, size = [], [], 0
    for row, t in enumerate(texts):
        if len(t) < LENGTH:
            continue
        for a in range(0, len(t), _PIECE):
            b = min(a + _PIECE, len(t))
            lo, hi = max(0, a - _EDGE), min(len(t), b + _EDGE)
            if size and size + hi - lo > _PIECE + 2 * _EDGE:
                yield b"".join(buffer), pieces
                buffer, pieces, size = [], [], 0
            pieces.append((row, a, b, lo, size, hi - lo))
            buffer.append(t[lo:hi])
            size += hi - lo
    if pieces:
        yield b"".join(buffer), pieces


class Anchors:
    """Anchors of a buffer: row, key, block, and the block's place in the text
    and size."""

    def __init__(self, raw: bytes, pieces):
        data = np.frombuffer(raw, np.uint8)
        self.hashed = h = Hashed(data)
        n = len(data)
        table = np.array(pieces, np.int64)
        rows, begin, end, lo, at, size = table.T
        owner = np.repeat(np.arange(len(table)), size)
        stop = (at + size)[owner]                               # end of the piece, per byte
        place = np.arange(n)
        gram = h.grams(GRAM)
        gram[(place[:len(gram)] + GRAM) > stop[:len(gram)]] = np.uint64(2 ** 64 - 1)
        wide = LENGTH - GRAM + 1
        least = _sliding(gram, wide, np.minimum)                # per window start
        least[(place[:len(least)] + LENGTH) > stop[:len(least)]] = 0
        most = _sliding(np.concatenate((np.zeros(wide - 1, np.uint64), least, np.zeros(wide - 1, np.uint64))),
                        wide, np.maximum)
        p = np.flatnonzero((most == gram) & (gram != np.uint64(2 ** 64 - 1)))
        o = owner[p]
        inside = p - at[o] + lo[o]
        mine = (inside >= begin[o]) & (inside < end[o])
        p, o, inside = p[mine], o[mine], inside[mine]
        # the anchor's windows: those in which its gram is the smallest, a run of starts
        starts = p[:, None] + np.arange(1 - wide, 1)
        own = least[np.clip(starts, 0, max(len(least) - 1, 0))] == gram[p][:, None]
        own &= (starts >= 0) & (starts < len(least))
        first = starts[np.arange(len(p)), own.argmax(1)]
        self.row, self.left = rows[o].astype(np.int32), inside - (p - first)
        self.size = (own.sum(1) + LENGTH - 1).astype(np.int32)
        # anchors are the smallest hashes: mixed once more, keys spread evenly over buckets
        self.key = mix64(gram[p] + _BASE) >> np.uint64(16)
        self.block = mix64(h.of(first, first + self.size) + (p - first).astype(np.uint64)) >> np.uint64(24)
        if len(p) > n // DENSE:
            self._join()

    def _join(self) -> None:
        """Overlapping occurrences of a block in one text become one."""
        order = np.lexsort((self.left, self.row, self.block, self.key))
        key, block, row, left, size = (x[order] for x in (self.key, self.block, self.row, self.left, self.size))
        apart = np.concatenate(([True], (key[1:] != key[:-1]) | (block[1:] != block[:-1]) | (row[1:] != row[:-1])
                                | (left[1:] > left[:-1] + size[:-1])))
        first = np.flatnonzero(apart)
        last = np.append(first[1:], len(left)) - 1
        size = (left[last] + size[last] - left[first]).astype(np.int32)
        back = np.lexsort((left[first], row[first]))            # rows in order again
        self.key, self.block, self.row, self.left, self.size = (
            x[back] for x in (key[first], block[first], row[first], left[first], size))


def anchors_of(texts: list[bytes]):
    for raw, pieces in pieces_of(texts):
        yield Anchors(raw, pieces)


# --- stored runs -----------------------------------------------------------
def _shrink(a: np.ndarray, kind: str) -> bytes:
    """Bytes of an array, all first bytes first: small numbers shrink well."""
    a = np.ascontiguousarray(a.astype(kind))
    return a.view(np.uint8).reshape(len(a), -1).T.tobytes()


def _to_blob(*columns: tuple[np.ndarray, str]) -> bytes:
    import zstandard
    head = np.array([len(a) for a, _ in columns], "<u8").tobytes()
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(_shrink(a, k) for a, k in columns))


def _from_blob(blob: bytes, *kinds: str) -> list[np.ndarray]:
    import zstandard
    raw = zstandard.ZstdDecompressor().decompress(blob)
    sizes = np.frombuffer(raw, "<u8", len(kinds)).tolist()
    at, out = 8 * len(kinds), []
    for n, k in zip(sizes, kinds):
        width = np.dtype(k).itemsize
        out.append(np.frombuffer(raw, np.uint8, n * width, at).reshape(width, n).T.copy().view(k).reshape(-1))
        at += n * width
    return out


def _entries_blob(key, sub, ids, number) -> bytes:
    """Entries of a batch, sorted by key."""
    used, where = np.unique(ids, return_inverse=True)
    return _to_blob((np.diff(key, prepend=np.uint64(0)), "<u8"), (sub, "<u8"), (where, "<u4"),
                    (np.diff(number, prepend=0), "<u4"), (np.diff(used, prepend=0), "<i8"))


def _entries(blob: bytes):
    key, sub, where, number, ids = _from_blob(blob, "<u8", "<u8", "<u4", "<u4", "<i8")
    return np.cumsum(key, dtype=np.uint64), sub, np.cumsum(ids)[where], np.cumsum(number.astype(np.int64))


def _numbers_blob(number) -> bytes:
    return _to_blob((np.diff(np.sort(number), prepend=0), "<u4"))


def _numbers(blobs: list[bytes]) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.int64)]
                          + [np.cumsum(_from_blob(x, "<u4")[0].astype(np.int64)) for x in blobs])


def _by_bucket(key: np.ndarray, bits: int, buckets: int) -> np.ndarray:
    """Bucket of each key; rises with the key."""
    return ((key >> np.uint64(bits - 32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _runs(values: np.ndarray):
    """(begin, end) of each run of equal values."""
    if not len(values):
        return []
    cuts = np.flatnonzero(values[1:] != values[:-1]) + 1
    return list(zip([0, *cuts.tolist()], [*cuts.tolist(), len(values)]))


def _later(ids: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Whether an entry's id exceeds that of its group's first entry (entries
    are sorted by group, then id)."""
    first = np.maximum.accumulate(np.where(begins, np.arange(len(ids)), 0))
    return ids > ids[first]


def _spread(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """begin[i], begin[i] + 1, ... (count[i] of them) for every i."""
    return np.repeat(begin - np.cumsum(count) + count, count) + np.arange(count.sum())


_KEY, _SUB, _IDS, _BATCH, _NUMBER, _ASKED, _LIVE = range(7)


class RunFamily:
    """Sorted runs in levels of geometrically falling size. ``cuts`` and
    ``asks`` gather (batch, number) of entries with an earlier equal and of
    those whose windows are to be compared."""

    def __init__(self, contexts: int | None):
        self.contexts = contexts
        self.levels: list[list[np.ndarray]] = []
        self.cuts, self.asks = [], []

    def add(self, key, sub, ids, batch, number) -> None:
        """Scan a run, in order of its keys, against every level, then take it in."""
        n = len(key)
        run = [key, sub, ids, batch, number, np.zeros(n, bool), np.ones(n, bool)]
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        count = np.diff(np.append(first, n))
        met, found = count > 1, []
        for level in self.levels:
            low, high = (np.searchsorted(level[_KEY], key[first], side) for side in ("left", "right"))
            met |= high > low
            at = _spread(low, high - low)
            found.append(at[level[_LIVE][at]])
        mine = np.flatnonzero(np.repeat(met, count))
        if len(mine):
            self._judge([run, *self.levels], [mine, *found])
        while self.levels and len(self.levels[-1][_KEY]) < 2 * len(run[_KEY]):
            run = self._merged(self.levels.pop(), run)
        self.levels.append(run)

    @staticmethod
    def _merged(a, b):
        both = [np.concatenate((x[a[_LIVE]], y[b[_LIVE]])) for x, y in zip(a, b)]
        order = np.argsort(both[_KEY], kind="stable")           # two sorted runs: one merge
        return [x[order] for x in both]

    def _judge(self, runs, spots) -> None:
        """Compare the entries at ``spots`` of ``runs``, all there are of their keys."""
        key, sub, ids, batch, number, asked = (
            np.concatenate([r[c][s] for r, s in zip(runs, spots)]) for c in range(_LIVE))
        order = np.lexsort((ids, sub, key))
        key, sub, ids, batch, number, asked = (x[order] for x in (key, sub, ids, batch, number, asked))
        mark = sub == _MARK
        new_key = np.concatenate(([True], key[1:] != key[:-1]))
        begins = new_key | np.concatenate(([True], sub[1:] != sub[:-1]))
        later = _later(ids, begins) & ~mark
        self.cuts.append((batch[later], number[later]))
        dead = later | (mark & ~begins)
        if self.contexts is not None:
            alive = ~dead & ~mark
            group, starts = np.cumsum(new_key) - 1, np.flatnonzero(new_key)
            marked = np.bincount(group, mark) > 0
            many = marked | (np.bincount(group, alive) > self.contexts)
            least = np.minimum.reduceat(np.where(alive, ids, _LAST), starts)
            most = np.maximum.reduceat(np.where(alive, ids, -_LAST - 1), starts)
            several = many | ((np.bincount(group, begins & ~mark) > 1) & (most > least))
            ask = alive & several[group] & ~asked
            self.asks.append((batch[ask], number[ask]))
            asked |= ask
            # all that a key with many entries needs from now on is its mark
            gone = np.flatnonzero(alive & many[group])
            dead[gone] = True
            kept = gone[np.unique(group[gone], return_index=True)[1]]
            kept = kept[~marked[group[kept]]]
            dead[kept], sub[kept] = False, _MARK
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        at = 0
        for r, s in zip(runs, spots):
            mine = back[at:at + len(s)]
            r[_SUB][s], r[_ASKED][s], r[_LIVE][s] = sub[mine], asked[mine], ~dead[mine]
            at += len(s)


# --- passes ----------------------------------------------------------------
_OUT = "kind string, batch long, bucket int, data binary"
_ANCHOR, _WINDOW, _CUT, _ASK = "anchor", "window", "cut", "ask"


def _table(rows: list[tuple]) -> pa.Table:
    cols = list(zip(*rows)) or [[]] * 4
    return pa.table({"kind": pa.array(cols[0], pa.string()), "batch": pa.array(cols[1], pa.int64()),
                     "bucket": pa.array(cols[2], pa.int32()), "data": pa.array(cols[3], pa.binary())})


def _places(row, place, size) -> bytes:
    order = np.lexsort((place, row))
    return _to_blob((row[order], "<u4"), (place[order], "<u4"), (size[order], "<u4"))


def _places_from(blobs: list[bytes]):
    at = [_from_blob(x, "<u4", "<u4", "<u4") for x in blobs]
    return [np.concatenate([np.zeros(0, np.int64), *x]).astype(np.int64) for x in (zip(*at) if at else [()] * 3)]


def _in_order(t: pa.Table):
    """A batch's ids and texts, and the batch, by id then row number."""
    t = t.sort_by([("doc_id", "ascending"), ("rid", "ascending")])
    return t.column("doc_id").fill_null(_LAST).to_numpy(), utf8_of(t.column("text").combine_chunks()), t


def _to_buckets(kind: str, batch: int, bucket: np.ndarray, *columns) -> list[tuple]:
    return [(kind, batch, int(bucket[a]), _entries_blob(*(c[a:b] for c in columns))) for a, b in _runs(bucket)]


class Suffixes:
    """A batch's suffixes in key order: their occurrences (row, left, size),
    whether an earlier row of the batch has the same block (``later``), whether
    the key has many blocks in it (``hot``), and the block's ``number``."""

    def __init__(self, texts: list[bytes], ords: np.ndarray, contexts: int):
        parts = [(a.key, a.block, a.row, a.left, a.size) for a in anchors_of(texts)]
        self.found = bool(parts)
        if not parts:
            return
        key, block, row, left, size = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((block, key))                        # stable: ids stay in order
        self.key, self.block, self.row, self.left, self.size = (x[order] for x in (key, block, row, left, size))
        self.new_key = np.concatenate(([True], self.key[1:] != self.key[:-1]))
        self.begins = self.new_key | np.concatenate(([True], self.block[1:] != self.block[:-1]))
        self.later = _later(ords[self.row], self.begins)
        group = np.cumsum(self.new_key) - 1
        self.hot = (np.bincount(group, self.begins) > contexts)[group]
        self.number = np.cumsum(self.begins) - 1


def _anchor_pass(buckets: int, contexts: int):
    """The entries of a batch's suffixes, one a block; a mark for a hot key."""
    def run(t: pa.Table) -> pa.Table:
        ords, texts, _ = _in_order(t)
        s = Suffixes(texts, ords, contexts)
        if not s.found:
            return _table([])
        sent = np.where(s.hot, s.new_key, s.begins)
        key, number, ids = s.key[sent], s.number[sent], ords[s.row[sent]]
        return _table(_to_buckets(_ANCHOR, t.column("batch")[0].as_py(), _by_bucket(key, 48, buckets), key,
                                  np.where(s.hot[sent], _MARK, s.block[sent]), ids, number))
    return run


def _windows_at(texts: list[bytes], row: np.ndarray, left: np.ndarray, size: np.ndarray):
    """row, place and hash of all windows of the given stretches, by hash, then
    row and place."""
    count = size - LENGTH + 1
    code = np.unique((np.repeat(row, count) << 40) | _spread(left, count))
    want = np.unique(row)
    found = []
    for raw, pieces in pieces_of([texts[r] for r in want.tolist()]):
        hashed = Hashed(np.frombuffer(raw, np.uint8))
        for r, a, b, lo, at, _ in pieces:
            base = int(want[r]) << 40
            x, y = np.searchsorted(code, [base | a, base | b])
            if x < y:
                spot = code[x:y] - base - lo + at
                found.append((code[x:y], hashed.of(spot, spot + LENGTH)))
    code, h = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.uint64))
    order = np.lexsort((code, h))
    return code[order] >> 40, code[order] & ((1 << 40) - 1), h[order]


def _settle_pass(buckets: int, contexts: int):
    """What a batch removes by its own suffixes and by the answers about them;
    the stretches whose windows are asked for, and these windows' entries. The
    suffixes are worked out again, which costs less than storing them."""
    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        if not len(docs):
            return _table([])
        batch = docs.column("batch")[0].as_py()
        ords, texts, _ = _in_order(docs)
        s = Suffixes(texts, ords, contexts)
        if not s.found:
            return _table([])
        kinds, blobs = answers.column("kind").to_pylist(), answers.column("data").to_pylist()
        told = {k: np.zeros(s.number[-1] + 1, bool) for k in (_CUT, _ASK)}
        for kind, flags in told.items():
            flags[_numbers([x for k, x in zip(kinds, blobs) if k == kind])] = True
        cut = s.later | told[_CUT][s.number]
        ask = ~cut & (s.hot | told[_ASK][s.number])
        out = [(kind, batch, None, _places(s.row[on], s.left[on], s.size[on]))
               for kind, on in ((_CUT, cut), (_ASK, ask)) if on.any()]
        if ask.any():
            row, _, h = _windows_at(texts, s.row[ask].astype(np.int64), s.left[ask], s.size[ask].astype(np.int64))
            first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
            h, ids = h[first], ords[row[first]]
            out += _to_buckets(_WINDOW, batch, _by_bucket(h, 64, buckets), h, np.zeros(len(h), np.uint64), ids,
                               np.arange(len(h)))
        return _table(out)
    return run


def _answers(kind: str, found: list) -> list[tuple]:
    if not found:
        return []
    batch, number = (np.concatenate(x) for x in zip(*found))
    order = np.argsort(batch, kind="stable")
    batch, number = batch[order], number[order]
    return [(kind, int(batch[a]), None, _numbers_blob(number[a:b])) for a, b in _runs(batch)]


def _scan(contexts: int | None, run_entries: int):
    """A bucket's runs through the family, one after the other."""
    def run(t: pa.Table) -> pa.Table:
        family, waiting, size = RunFamily(contexts), [], 0
        t = t.sort_by("batch")
        for i, (batch, blob) in enumerate(zip(t.column("batch"), t.column("data")), 1):
            key, sub, ids, number = _entries(blob.as_py())
            waiting.append((key, sub, ids, np.full(len(key), batch.as_py()), number))
            size += len(key)
            if size >= run_entries or i == len(t):
                columns = [np.concatenate(x) for x in zip(*waiting)]
                order = np.argsort(columns[0], kind="stable")
                family.add(*(x[order] for x in columns))
                waiting, size = [], 0
        return _table(_answers(_CUT, family.cuts) + _answers(_ASK, family.asks))
    return run


def _cut_pass(docs: pa.Table, cuts: pa.Table) -> pa.Table:
    if not len(docs):
        return pa.table({"rid": pa.array([], pa.int64()), "doc_id": pa.array([], pa.int64()),
                         "n_bytes": pa.array([], pa.int64()), "spans": pa.array([], pa.list_(pa.int64())),
                         "kept_sha256": pa.array([], pa.string())})
    ords, texts, t = _in_order(docs)
    lens = np.array([len(x) for x in texts], np.int64)
    kinds, blobs = cuts.column("kind").to_pylist(), cuts.column("data").to_pylist()
    of = lambda kind: [x for k, x in zip(kinds, blobs) if k == kind]
    row, a, size = _places_from(of(_CUT))
    asked = _places_from(of(_ASK))
    if len(asked[0]):
        at, place, h = _windows_at(texts, *asked)
        begins = np.concatenate(([True], h[1:] != h[:-1]))
        number = np.cumsum(begins) - 1
        told = np.zeros(number[-1] + 1, bool)
        told[_numbers(of(_WINDOW))] = True
        gone = _later(ords[at], begins) | told[number]
        row, a = np.concatenate((row, at[gone])), np.concatenate((a, place[gone]))
        size = np.concatenate((size, np.full(gone.sum(), LENGTH)))
    spans: list[list[int]] = [[] for _ in texts]
    if len(row):
        b = a + size
        order = np.lexsort((a, row))
        row, a, b = row[order], a[order], b[order]
        # runs of touching intervals, row by row, on one line of all texts
        base = np.cumsum(lens + 1) - lens - 1
        a, b = a + base[row], b + base[row]
        reach = np.maximum.accumulate(b)
        begins = np.concatenate(([True], a[1:] > reach[:-1]))
        first = np.flatnonzero(begins)
        last = np.concatenate((first[1:] - 1, [len(a) - 1]))
        for r, x, y in zip(row[first].tolist(), (a[first] - base[row[first]]).tolist(),
                           (reach[last] - base[row[first]]).tolist()):
            spans[r] += [x, y]
    digests = []
    for text, s in zip(texts, spans):
        kept, at = hashlib.sha256(), 0
        for x, y in zip(s[::2], s[1::2]):
            kept.update(text[at:x])
            at = y
        kept.update(text[at:])
        digests.append(kept.hexdigest())
    return pa.table({"rid": t.column("rid"), "doc_id": t.column("doc_id"), "n_bytes": pa.array(lens),
                     "spans": pa.array(spans, pa.list_(pa.int64())), "kept_sha256": pa.array(digests)})


def _batches(docs: DataFrame, batch_rows: int, batch_bytes: int) -> DataFrame:
    """rid, doc_id, text, size and batch of every row, stored in buckets of
    batches so that each pass finds a batch's texts without a shuffle."""
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"),
                       text.alias("text"), F.octet_length(text).alias("size"))
    # texts of up to 16^k times a row's share of the bytes are in batches of 1 / 16^k of the rows
    share = max(1, batch_bytes // batch_rows)
    step = F.when(F.col("size") > share, F.least(F.lit(28), 4 * F.ceil(F.log2(F.col("size") / share) / 4))).otherwise(0).cast("int")
    rows = rows.withColumn("step", step).withColumn("batch", F.expr(
        f"shiftleft(shiftright(rid, 33), 38) + shiftleft(bigint(step), 33)"
        f" + (rid & {(1 << 33) - 1}L) div greatest(1, shiftright({batch_rows}, step))")).drop("step")
    path = shared_dir(spark, "repeat-batches")
    name = "repeat_batches_" + path[-12:]
    (rows.write.format("parquet").option("path", path).bucketBy(fanout(spark), "batch").sortBy("batch")
     .saveAsTable(name))
    return spark.table(name)


def repeated_spans(docs: DataFrame, batch_rows: int = BATCH_ROWS, contexts: int = CONTEXTS,
                   batch_bytes: int = BATCH_BYTES, bucket_bytes: int = BUCKET_BYTES,
                   run_entries: int = RUN_ENTRIES) -> DataFrame:
    """rid, doc_id, n_bytes, spans (begin, end of each removed run, in bytes)
    and kept_sha256 of every row."""
    spark = docs.sparkSession
    texts = _batches(docs, batch_rows, batch_bytes)
    total = texts.agg(F.sum(F.col("size").cast("long"))).first()[0] or 0
    buckets = max(2 * fanout(spark), -(-total // bucket_bytes))
    with scratch(spark):
        entries = texts.groupBy("batch").applyInArrow(_anchor_pass(buckets, contexts), _OUT)
        answers = materialize(entries.groupBy("bucket").applyInArrow(_scan(contexts, run_entries), _OUT), "anchor-scan")
        settled = materialize(texts.groupBy("batch").cogroup(answers.groupBy("batch"))
                              .applyInArrow(_settle_pass(buckets, contexts), _OUT), "settled", keep=True)
    windows = settled.filter(F.col("kind") == _WINDOW)
    again = materialize(windows.groupBy("bucket").applyInArrow(_scan(None, run_entries), _OUT), "window-scan", keep=True)
    told = (settled.filter(F.col("kind") != _WINDOW).select("kind", "batch", "data")
            .unionByName(again.select(F.lit(_WINDOW).alias("kind"), "batch", "data")))
    return texts.groupBy("batch").cogroup(told.groupBy("batch")).applyInArrow(
        _cut_pass, "rid long, doc_id long, n_bytes long, spans array<long>, kept_sha256 string")


def removal_report(docs: DataFrame, **settings) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document."""
    spans = F.col("spans")
    total = F.aggregate(F.transform(spans, lambda x, i: F.when(i % 2 == 1, x).otherwise(-x)),
                        F.lit(0).cast("long"), lambda a, x: a + x)
    return repeated_spans(docs, **settings).select(
        "doc_id", "n_bytes", total.alias("n_removed"), (F.size(spans) / 2).cast("long").alias("n_spans"), "kept_sha256")

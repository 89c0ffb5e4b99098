"""Bound-certified best-fit packing of token sequences.

Documents become pieces of at most ``capacity`` ids: only a longer document is
cut, its first piece being the remainder. Full pieces are sequences by
themselves. All others are dealt into partitions by a hash of their row and
packed there by best-fit decreasing. Each partition also computes a lower
bound on its bins from dual-feasible functions; where the two agree the
partition is certified optimal. The documents of partitions with a gap, and
those in the loosest bin of each certified partition, are exchanged (dealt
anew among fresh partitions) and packed again, as long as that saves bins.

Edge cases: null and empty texts are documents of the end id alone; texts may
be of any length (memory per task is one document's ids plus one Arrow batch);
repeated rows are packed each for itself; an empty table gives no rows; other
columns play no part.
"""

from __future__ import annotations

import zlib
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.llm.common import texts_of
from terrane.llm.fastids import ids_of
from terrane.session import materialize

CAPACITY = 1024
END_ID = 2
PARTITION_ITEMS = 8_192      # mean number of pieces packed together


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every document's pieces."""

    def run(batches):
        encode = ids_of(tokenizer).ids
        for b in batches:
            rows = []
            for key, text in zip(b.column(0).to_pylist(), texts_of(b.column(1))):
                ids = np.append(encode(text), end_id).astype("<u4")
                first = len(ids) % capacity or capacity
                start, size = 0, first
                for piece in range(-(-len(ids) // capacity)):
                    rows.append((key, piece, start, size, zlib.crc32(ids[start:start + size].tobytes())))
                    start, size = start + size, capacity
            cols = list(zip(*rows)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([
                pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()),
                *(pa.array(c, pa.int64()) for c in cols[2:])],
                ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def lower_bound(lengths: np.ndarray, capacity: int = CAPACITY) -> int:
    """Bins that any packing needs, by dual-feasible functions f: for a
    feasible bin the f-values sum to 1 at most, so their total is a bound."""
    if not len(lengths):
        return 0
    count = np.bincount(lengths, minlength=capacity + 1)
    size = np.arange(capacity + 1)
    best = int(np.ceil(count @ size / capacity))
    # thresholds: sizes above capacity - t count as full, sizes below t as nothing
    for t in range(1, capacity // 2 + 1):
        f = np.where(size > capacity - t, capacity, np.where(size >= t, size, 0))
        best = max(best, -(-int(count @ f) // capacity))
    # rounding to multiples of 1 / (k + 1)
    for k in range(1, 64):
        scaled = size * (k + 1)
        whole = scaled % capacity == 0
        # in units of 1 / (capacity * k), so that all is in whole numbers
        f = np.where(whole, size * k, scaled // capacity * capacity)
        best = max(best, -(-int(count @ f) // (capacity * k)))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset in it) of each length: largest first, each into the bin it
    leaves least room in."""
    bins = np.zeros(len(lengths), np.int64)
    offsets = np.zeros(len(lengths), np.int64)
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0                                  # bit r: some bin has room r
    opened = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        fits = rooms >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
        else:
            room, b = capacity, opened
            opened += 1
        bins[i], offsets[i] = b, capacity - room
        left = room - n
        if left:
            by_room[left].append(b)
            rooms |= 1 << left
    return bins, offsets


def _pack_parts(items: DataFrame, parts: int, salt: int, capacity: int) -> DataFrame:
    """row, length, part, bin, offset, bins, bound, loose (in the loosest bin)."""

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("length", "descending"), ("row", "ascending")])
        lengths = t.column("length").to_numpy()
        bins, offsets = best_fit_decreasing(lengths, capacity)
        fill = np.bincount(bins, lengths)
        n = len(lengths)
        full = lambda x: pa.array(np.full(n, x), pa.int64())
        return pa.table({
            "row": t.column("row"), "length": t.column("length"), "part": t.column("part"),
            "bin": pa.array(bins), "offset": pa.array(offsets), "bins": full(len(fill)),
            "bound": full(lower_bound(lengths, capacity)),
            "loose": pa.array(bins == int(fill.argmin()))})

    dealt = items.select("row", "length", F.pmod(F.xxhash64("row", F.lit(salt)), F.lit(parts)).alias("part"))
    return dealt.groupBy("part").applyInArrow(
        run, "row long, length long, part long, bin long, offset long, bins long, bound long, loose boolean")


def _bins_of(packed: DataFrame) -> tuple[int, int, int]:
    """(rows, bins, partitions)."""
    per = packed.groupBy("part").agg(F.count("*").alias("n"), F.countDistinct("bin").alias("bins"))
    r = per.agg(F.sum("n"), F.sum("bins"), F.count("*")).first()
    return (r[0] or 0, r[1] or 0, r[2])


def pack(cut: DataFrame, capacity: int = CAPACITY, rounds: int | None = None) -> DataFrame:
    """``cut`` (rows of ``pieces``) plus sequence_id and offset. Exchanges go on
    until one saves no bin, or for ``rounds`` at most where that is given."""
    stored = materialize(cut.withColumn("row", F.monotonically_increasing_id()), "pieces")
    items = stored.filter(F.col("length") < capacity).select("row", "length")
    n = items.count()
    parts = max(1, -(-n // PARTITION_ITEMS))
    done: list[tuple[int, DataFrame]] = []
    packed = materialize(_pack_parts(items, parts, 0, capacity), "packed-0")
    for k in count(1) if rounds is None else range(1, rounds + 1):
        pool = packed.filter((F.col("bins") > F.col("bound")) | F.col("loose"))
        size, old, _ = _bins_of(pool)
        if old <= 1:
            break
        again = materialize(_pack_parts(pool, max(1, -(-size // PARTITION_ITEMS)), k, capacity), f"packed-{k}")
        _, new, _ = _bins_of(again)
        if new >= old:
            break
        done.append((k - 1, packed.filter((F.col("bins") <= F.col("bound")) & ~F.col("loose"))))
        packed = again
    done.append((len(done), packed))
    place = None
    for k, some in done:
        # 15 bits of round, 24 of partition and 24 of bin
        some = some.select("row", (F.lit(k).cast("long") * (1 << 48) + F.col("part") * (1 << 24)
                                   + F.col("bin")).alias("sequence_id"), "offset")
        place = some if place is None else place.unionByName(some)
    full = stored.filter(F.col("length") >= capacity).select(
        "*", (-F.col("row") - 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = stored.filter(F.col("length") < capacity).join(place, "row")
    return full.unionByName(rest).drop("row")


def pack_documents(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack(pieces(docs, tokenizer)).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")

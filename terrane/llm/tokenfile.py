"""Token files: raw id payloads under a minimal perfect hash index.

Documents are dealt to shards by ranges of ascending id and sorted there. A
shard is a run of segments; a segment is one stored row that holds the raw
little-endian ids of its documents one after the other, and an index over
their keys: a minimal perfect hash (buckets of keys with a pilot each) gives a
key its slot, and the slot holds a fingerprint of the key and the place of its
ids in the payload. A lookup hashes once, reads one pilot, one fingerprint and
one slice, whatever the number of documents. A foreign key fails the
fingerprint, and the stored key settles the rest.

Edge cases: null and empty texts are documents of the end id alone; rows
without an id come last; a repeated id is stored as often as it occurs, its
occurrences numbered within the segment; an id of any share of the rows is
split over shards by a hash of the text; texts may be of any length (a segment
ends with the document that fills it); an empty table gives no segments;
other columns play no part.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terrane.llm.common import fanout, mix64, text_or_empty, texts_of
from terrane.llm.fastids import ids_of
from terrane.session import shared_dir

END_ID = 2
SEGMENT_BYTES = 4 << 20
KEYS_PER_BUCKET = 4
_NO_ID = 2 ** 63 - 1          # stands for a null id: after all others
_PILOTS = mix64(np.arange(1, 65, dtype=np.uint64))

_SCHEMA = ("shard int, segment int, base long, n_docs long, n_ids long, width int, keys binary, "
           "pilots binary, fingerprints binary, places binary, payload binary")


def key_hash(keys: np.ndarray, nth: np.ndarray) -> np.ndarray:
    """64-bit hash of (id, number of its occurrence in the segment)."""
    return mix64(mix64(keys.astype(np.int64).view(np.uint64)) + mix64(nth.astype(np.uint64) + np.uint64(1)))


def _slots(h: np.ndarray, pilot: np.ndarray, n: int) -> np.ndarray:
    return (mix64(h ^ mix64(pilot.astype(np.uint64) + np.uint64(7))) % np.uint64(n)).astype(np.int64)


def build_mph(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(pilots per bucket, slot per key) of distinct hashes: large buckets
    first, each with the first pilot that sends its keys to free slots; a
    bucket of one key names its slot directly (as -1 - slot)."""
    n = len(h)
    m = -(-n // KEYS_PER_BUCKET)
    bucket = (h % np.uint64(max(m, 1))).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    sizes = np.bincount(bucket, minlength=m)
    starts = np.cumsum(sizes) - sizes
    pilots, slots, taken = np.zeros(m, np.int64), np.zeros(n, np.int64), np.zeros(n, bool)
    by_size = np.argsort(-sizes, kind="stable")
    for b in by_size[sizes[by_size] > 1].tolist():
        mine = order[starts[b]:starts[b] + sizes[b]]
        first = 0
        while True:
            tries = np.arange(first, first + 64)
            at = _slots(h[mine][None, :], tries[:, None], n)
            rows = np.sort(at, axis=1)
            ok = ~taken[at].any(1) & (rows[:, 1:] != rows[:, :-1]).all(1)
            if ok.any():
                k = int(ok.argmax())
                pilots[b], slots[mine] = tries[k], at[k]
                taken[at[k]] = True
                break
            first += 64
    single = by_size[sizes[by_size] == 1]
    free = np.flatnonzero(~taken)
    mine = order[starts[single]]
    slots[mine] = free[:len(mine)]
    pilots[single] = -1 - free[:len(mine)]
    return pilots, slots


def find_slots(h: np.ndarray, pilots: np.ndarray, n: int) -> np.ndarray:
    """The slot that the index gives each hash (any hash gets one)."""
    p = pilots[(h % np.uint64(len(pilots))).astype(np.int64)]
    return np.where(p < 0, -1 - p, _slots(h, np.maximum(p, 0), n))


def _occurrence(keys: np.ndarray) -> np.ndarray:
    """0, 1, 2 ... within each run of equal keys (keys are sorted)."""
    begins = np.concatenate(([True], keys[1:] != keys[:-1]))
    first = np.maximum.accumulate(np.where(begins, np.arange(len(keys)), 0))
    return np.arange(len(keys)) - first


def _segment(shard: int, number: int, base: int, width: int, keys: list[int], parts: list[bytes]) -> dict:
    k = np.array(keys, np.int64)
    h = key_hash(k, _occurrence(k))
    pilots, slots = build_mph(h)
    lens = np.array([len(p) for p in parts], np.int64)
    places = np.zeros((len(k), 2), "<u8")
    places[slots, 0], places[slots, 1] = np.cumsum(lens) - lens, lens
    prints = np.zeros(len(k), "<u4")
    prints[slots] = (h >> np.uint64(32)).astype(np.uint32)
    return {"shard": shard, "segment": number, "base": base, "n_docs": len(k), "n_ids": int(lens.sum()) // width,
            "width": width, "keys": k.astype("<i8").tobytes(), "pilots": pilots.astype("<i8").tobytes(),
            "fingerprints": prints.tobytes(), "places": places.tobytes(), "payload": b"".join(parts)}


class SegmentIndex:
    """Keyed access to one stored segment."""

    def __init__(self, row: dict):
        self.n, self.width, self.payload = row["n_docs"], row["width"], row["payload"]
        self.keys = np.frombuffer(row["keys"], "<i8")
        self.pilots = np.frombuffer(row["pilots"], "<i8")
        self.prints = np.frombuffer(row["fingerprints"], "<u4")
        self.places = np.frombuffer(row["places"], "<u8").reshape(-1, 2)

    def places_of(self, keys: np.ndarray, nth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(found, place in bytes as start and length) of each key."""
        h = key_hash(keys, nth)
        slot = find_slots(h, self.pilots, self.n)
        return self.prints[slot] == (h >> np.uint64(32)).astype(np.uint32), self.places[slot].astype(np.int64)

    def ids(self, start: int, size: int) -> np.ndarray:
        return np.frombuffer(self.payload, f"<u{self.width}", size // self.width, start)


def _shards(ids: np.ndarray, part: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Shard of each id: the number of bounds below it; rows whose id is a
    bound (as often as a hot id takes) spread over its shards by ``part``."""
    low, high = np.searchsorted(bounds, ids, "left"), np.searchsorted(bounds, ids, "right")
    return low + np.minimum((part * (high - low + 1)).astype(np.int64), high - low)


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID,
                      shards: int | None = None) -> None:
    """Encode every whole text, append ``end_id`` and write the segments."""
    spark = docs.sparkSession
    shards = shards or fanout(spark)
    slim = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("doc_id"), "text")
    steps = [(i + 1) / shards for i in range(shards - 1)]
    found = slim.agg(F.percentile_approx("doc_id", steps).alias("b")).first()["b"] if steps else []
    bounds = np.array(sorted(found or []), np.int64)

    def encode(batches):
        coder = ids_of(tokenizer)
        end = np.array([end_id], coder.kind).tobytes()
        for b in batches:
            keys, tie = b.column(0).to_numpy(), b.column(2).to_numpy()
            shard = _shards(keys, tie / 2.0 ** 63, bounds)
            ids = [coder.id_bytes(t) + end for t in texts_of(b.column(1))]
            yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), b.column(0), b.column(2),
                                              pa.array(ids, pa.binary())], ["shard", "doc_id", "tie", "ids"])

    def write(batches):
        width = int(ids_of(tokenizer).kind[-1])
        shard, number, base, keys, parts, size = None, 0, 0, [], [], 0
        row = lambda: pa.RecordBatch.from_pylist(
            [_segment(shard, number, base, width, keys, parts)], schema=stored)
        for b in batches:
            for s, key, ids in zip(*(b.column(i).to_pylist() for i in range(3))):
                if keys and (s != shard or size >= SEGMENT_BYTES):
                    yield row()
                    number, base, keys, parts, size = number + 1, base + size // width, [], [], 0
                if s != shard:
                    shard, number, base = s, 0, 0
                keys.append(key)
                parts.append(ids)
                size += len(ids)
        if keys:
            yield row()

    stored = pa.schema([("shard", pa.int32()), ("segment", pa.int32()), ("base", pa.int64()),
                        ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("width", pa.int32()),
                        *((c, pa.binary()) for c in ("keys", "pilots", "fingerprints", "places", "payload"))])
    tie = F.shiftrightunsigned(F.xxhash64(text_or_empty()), 1)
    (slim.withColumn("tie", tie).mapInArrow(encode, "shard int, doc_id long, tie long, ids binary")
     .repartition(shards, "shard").sortWithinPartitions("shard", "doc_id", "tie")
     .select("shard", "doc_id", "ids").mapInArrow(write, _SCHEMA)
     .write.option("compression", "zstd").parquet(f"{path}/segments"))
    spark.createDataFrame([(bounds.tolist(),)], "bounds array<long>").coalesce(1).write.parquet(f"{path}/bounds")


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens and ids_crc32 of
    every stored document, each found through its segment's index."""
    segments = spark.read.parquet(f"{path}/segments")
    # one row per shard: what all earlier shards hold
    totals = segments.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shard_start"))

    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                index = SegmentIndex(r)
                found, places = index.places_of(index.keys, _occurrence(index.keys))
                if not found.all():
                    raise ValueError(f"shard {r['shard']}, segment {r['segment']}: a key is not in its index")
                crcs = [zlib.crc32(index.ids(s, n).astype("<u4").tobytes()) for s, n in places.tolist()]
                yield pa.RecordBatch.from_arrays([
                    pa.array([None if k == _NO_ID else k for k in index.keys.tolist()], pa.int64()),
                    pa.array(r["shard_start"] + r["base"] + places[:, 0] // index.width),
                    pa.array(places[:, 1] // index.width), pa.array(crcs, pa.int64())],
                    ["doc_id", "start", "n_tokens", "ids_crc32"])

    return segments.join(starts, "shard").mapInArrow(
        run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def lookup_ids(spark: SparkSession, path: str, keys: DataFrame) -> DataFrame:
    """doc_id and ids of every stored document whose id is in ``keys`` (column
    doc_id; each asked for once). The stored bounds send a key to its shard,
    or shards where an id fills several; each segment there looks it up in
    constant time."""
    bounds = np.array(spark.read.parquet(f"{path}/bounds").first()["bounds"], np.int64)
    asked = keys.select(F.col("doc_id").cast("long").alias("doc_id")).filter("doc_id IS NOT NULL").distinct()

    def route(batches):
        for b in batches:
            k = b.column(0).to_numpy()
            low, high = np.searchsorted(bounds, k, "left"), np.searchsorted(bounds, k, "right")
            n = high - low + 1
            shard = np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(k, n)), pa.array(shard, pa.int32())],
                                             ["doc_id", "shard"])

    wanted = (asked.mapInArrow(route, "doc_id long, shard int")
              .groupBy("shard").agg(F.collect_list("doc_id").alias("asked")))

    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                index = SegmentIndex(r)
                some, nth, keys_found, ids = np.array(r["asked"], np.int64), 0, [], []
                while len(some):
                    hit, places = index.places_of(some, np.full(len(some), nth))
                    # the stored key settles what the fingerprint lets through
                    at = np.searchsorted(index.keys, some) + nth
                    hit &= index.keys[np.minimum(at, index.n - 1)] == some
                    keys_found += some[hit].tolist()
                    ids += [index.ids(s, n).tolist() for s, n in places[hit].tolist()]
                    some, nth = some[hit], nth + 1
                yield pa.RecordBatch.from_arrays([pa.array(keys_found, pa.int64()),
                                                  pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return spark.read.parquet(f"{path}/segments").join(wanted, "shard").mapInArrow(
        run, "doc_id long, ids array<int>")


def token_file_report(docs: DataFrame, tokenizer: str, path: str | None = None) -> DataFrame:
    """Write the files (to a new shared folder if none is given), read them back."""
    spark = docs.sparkSession
    path = path or shared_dir(spark, "token-files")
    write_token_files(docs, path, tokenizer)
    return read_token_files(spark, path)

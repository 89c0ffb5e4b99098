"""WARC archives of Zstandard frames with a dictionary of their own.

An archive is a ``.warc.zst`` file: a leading skippable frame that holds a
Zstandard dictionary (itself a Zstandard frame), then one frame per record, so
that a record can be read by itself. The dictionary is built from records of
the same archive: up to ``DICT_SAMPLE`` bytes, in pieces taken at equal steps
over the whole archive; it bears on the size of the file only.

Of records with equal payloads of at least ``MIN_REVISIT`` bytes the first one
by (id, place in the input), ids before nulls, is a response; the others are revisit records
that name it and carry no payload. Which is which is settled on digests, and
payloads move once, dealt out by the number of the row, so a payload that a third of the
rows share is spread over all tasks.

A task cuts its rows into archives of about ``ARCHIVE_BYTES`` of payload and
writes each under a name of its own; the names that count are those in the
manifest, a table that Spark commits. A file that a lost or repeated task left
behind is in no manifest and is never read. Writers and readers open files by
their URI (``pyarrow.fs``). A reader takes one frame after the other.

Edge cases: a null payload is empty; null ids and urls are left out of the
header (a record without a url has its record id for a target); control
characters and blanks in a url are percent-encoded; rows that repeat an id are
records of their own; one payload of any size makes an archive by itself if it
fills one; an empty table gives an empty manifest; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrane.llm.common import fanout, numbered, small_batches
from terrane.session import materialize, shared_dir

MIN_REVISIT = 100
ARCHIVE_BYTES = 24 << 20
DICT_BYTES = 64 << 10
DICT_SAMPLE = 2 << 20
LEVEL = 3
DATE = "1970-01-01T00:00:00Z"            # the tables hold no time of capture

# fixed values of the formats
_SKIPPABLE = 0x184D2A5D                   # frame that holds a dictionary
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

_MANIFEST = "path string, n_records long, n_bytes long, dict_bytes long"
_RECORDS = ("page_id long, record_id string, url string, record_type string, refers_record string, "
            "declared_digest string, declared_bytes long, payload binary")


# --- records ---------------------------------------------------------------

def record_id(corpus: str, file: int, at: int) -> str:
    """The URN of a row's record in the archives at ``corpus``: the same one in
    every attempt to write it."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{corpus}#{file}.{at}')}>"


def _target(url: str | None, rid: str) -> str:
    if not url:
        return rid[1:-1]
    return "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url)


def _fields(*pairs: tuple[str, object]) -> bytes:
    return "".join(f"{k}: {v}\r\n" for k, v in pairs if v is not None).encode()


def warc_record(page_id: int | None, rid: str, url: str | None, payload: bytes, digest: str,
                refers: str | None) -> bytes:
    """One record: a response, or a revisit of the record ``refers``."""
    http = (b"HTTP/1.1 200 OK\r\n" + _fields(("Content-Type", "text/html; charset=utf-8"),
                                             ("Content-Length", len(payload))) + b"\r\n")
    block = http if refers is not None else http + payload
    head = _fields(
        ("WARC-Type", "response" if refers is None else "revisit"), ("WARC-Record-ID", rid), ("WARC-Date", DATE),
        ("WARC-Target-URI", _target(url, rid)), ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("WARC-Profile", None if refers is None else _PROFILE),
        ("WARC-Refers-To", refers), ("X-Page-ID", page_id),
        ("Content-Type", "application/http; msgtype=response"), ("Content-Length", len(block)))
    return b"WARC/1.1\r\n" + head + b"\r\n" + block + b"\r\n\r\n"


def _split_head(raw: bytes) -> tuple[str, dict[str, str], bytes]:
    """First line, fields and rest of a header block."""
    head, gap, rest = raw.partition(b"\r\n\r\n")
    if not gap:
        raise ValueError("a header without an end")
    first, *lines = head.decode().split("\r\n")
    return first, dict(x.split(": ", 1) for x in lines), rest


def parse_record(raw: bytes) -> dict:
    """The parts of one record; its length and its end mark are checked."""
    version, h, rest = _split_head(raw)
    n = int(h["Content-Length"])
    if version != "WARC/1.1" or rest[n:] != b"\r\n\r\n":
        raise ValueError("not a WARC record of the stated length")
    out = {"type": h["WARC-Type"], "record_id": h["WARC-Record-ID"], "target": h.get("WARC-Target-URI"),
           "refers": h.get("WARC-Refers-To"), "page_id": int(h["X-Page-ID"]) if "X-Page-ID" in h else None}
    if out["type"] in ("response", "revisit"):
        _, http, payload = _split_head(rest[:n])
        out |= {"digest": h["WARC-Payload-Digest"].removeprefix("sha256:"), "bytes": int(http["Content-Length"]),
                "payload": payload if out["type"] == "response" else None}
    return out


# --- archives --------------------------------------------------------------

def build_dictionary(records: list[bytes]) -> bytes:
    """A dictionary from pieces at equal steps over ``records``; empty where
    there is too little to train on."""
    import zstandard
    total = sum(map(len, records))
    piece = 1 << 12
    step = max(1, -(-total // DICT_SAMPLE))
    samples, at = [], 0
    for r in records:
        for lo in range(0, len(r), piece):
            if at % step == 0:
                samples.append(r[lo:lo + piece])
            at += 1
    size = min(DICT_BYTES, sum(map(len, samples)) // 8)
    if size < 1024 or len(samples) < 8:
        return b""
    try:
        return zstandard.train_dictionary(size, samples, k=256, d=8).as_bytes()
    except zstandard.ZstdError:               # samples without anything in common
        return b""


def archive_frames(records: list[bytes]) -> Iterator[bytes]:
    """The dictionary's frame (left out if there is none), then a frame a record."""
    import zstandard
    raw = build_dictionary(records)
    if raw:
        packed = zstandard.ZstdCompressor(level=19).compress(raw)
        yield struct.pack("<II", _SKIPPABLE, len(packed)) + packed
    known = zstandard.ZstdCompressionDict(raw) if raw else None
    pack = zstandard.ZstdCompressor(level=LEVEL, dict_data=known)
    for r in records:
        yield pack.compress(r)


def read_archive(source, chunk: int = 1 << 20) -> Iterator[bytes]:
    """The records of an open archive, one frame after the other."""
    import zstandard
    head = source.read(8)
    known, left = None, head
    if len(head) == 8 and struct.unpack("<I", head[:4])[0] == _SKIPPABLE:
        raw = source.read(struct.unpack("<I", head[4:])[0])
        known = zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(raw))
        left = b""
    unpack = zstandard.ZstdDecompressor(dict_data=known)
    frame, parts = unpack.decompressobj(), []
    while left or (left := source.read(chunk)):
        parts.append(frame.decompress(left))
        left = frame.unused_data if frame.eof else b""
        if frame.eof:
            yield b"".join(parts)
            frame, parts = unpack.decompressobj(), []
    if parts:
        raise ValueError("the archive ends within a record")


def _opened(uri: str) -> tuple[pafs.FileSystem, str]:
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri.removeprefix("file:")
    return pafs.FileSystem.from_uri(uri)


def _info(name: str) -> bytes:
    body = _fields(("software", "terrane"), ("format", "WARC File Format 1.1"))
    return (b"WARC/1.1\r\n" + _fields(
        ("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>"),
        ("WARC-Date", DATE), ("WARC-Filename", name), ("Content-Type", "application/warc-fields"),
        ("Content-Length", len(body))) + b"\r\n" + body + b"\r\n\r\n")


# --- Spark side ------------------------------------------------------------

def record_plan(pages: DataFrame, key: str = "page_id", payload: str = "html") -> tuple[DataFrame, DataFrame]:
    """(rows, revisits): the input as page_id, url, payload, number, and for
    each revisit its number and that of its response (refers)."""
    rows = numbered(pages, F.col(key).cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                    F.coalesce(F.col(payload), F.lit("")).cast("binary").alias("payload"), name="warc-input")
    long = materialize(rows.filter(F.octet_length("payload") >= MIN_REVISIT)
                       .select("page_id", "number", F.unhex(F.sha2("payload", 256)).alias("digest")), "warc-digests")
    first = F.min(F.struct(F.col("page_id").isNull().alias("none"), F.col("page_id").alias("id"), "number"))
    groups = materialize(long.groupBy("digest").agg(first.alias("f"), F.count("*").alias("n")).filter("n > 1")
                         .select("digest", F.col("f.number").alias("refers")), "warc-groups")
    again = materialize(long.join(groups, "digest").filter("number <> refers").select("number", "refers"),
                        "warc-revisits")
    return rows, again


def write_archives(pages: DataFrame, folder: str | None = None, key: str = "page_id", payload: str = "html") -> DataFrame:
    """Write every row as a record under ``folder`` (a new one in the shared
    folder, if none is given); the stored manifest of the archives."""
    spark = pages.sparkSession
    small_batches(spark)
    folder = folder or shared_dir(spark, "warc")
    rows, again = record_plan(pages, key, payload)
    dealt = (rows.join(again.hint("merge"), "number", "left")
             .select("page_id", "number.file", "number.at", "url", "payload",
                     F.col("refers.file").alias("r_file"), F.col("refers.at").alias("r_at")))

    def write(batches):
        fs, base = _opened(folder)
        fs.create_dir(base, recursive=True)
        attempt = uuid.uuid4().hex

        def flush(records):
            name = f"{attempt}-{flush.n:05d}.warc.zst"
            flush.n += 1
            path, size, own = f"{base}/{name}", 0, 0
            with fs.open_output_stream(path, compression=None) as out:
                for i, frame in enumerate(archive_frames([_info(name), *records])):
                    out.write(frame)
                    size += len(frame)
                    if i == 0 and frame[:4] == struct.pack("<I", _SKIPPABLE):
                        own = len(frame) - 8
            return pa.RecordBatch.from_arrays(
                [pa.array([name]), *(pa.array([x], pa.int64()) for x in (len(records), size, own))],
                ["path", "n_records", "n_bytes", "dict_bytes"])

        flush.n = 0
        records, held = [], 0
        for b in batches:
            for page_id, file, at, url, raw, r_file, r_at in zip(*(c.to_pylist() for c in b.columns)):
                refers = None if r_at is None else record_id(folder, r_file, r_at)
                records.append(warc_record(page_id, record_id(folder, file, at), url, raw,
                                           hashlib.sha256(raw).hexdigest(), refers))
                held += len(records[-1])
                if held >= ARCHIVE_BYTES:
                    yield flush(records)
                    records, held = [], 0
        if records:
            yield flush(records)

    manifest = dealt.mapInArrow(write, _MANIFEST)
    return materialize(manifest.withColumn("path", F.concat(F.lit(folder + "/"), "path")), "warc-manifest")


def read_records(manifest: DataFrame) -> DataFrame:
    """All records (but the archives' own) of the archives of a manifest; a
    revisit has no payload. Archives are dealt to tasks by their name."""
    names = [f.split()[0] for f in _RECORDS.split(", ")]

    def read(batches):
        kept: dict[str, list] = {n: [] for n in names}
        size = 0
        for b in batches:
            for uri in b.column(0).to_pylist():
                fs, path = _opened(uri)
                with fs.open_input_stream(path, compression=None) as source:
                    for raw in read_archive(source):
                        r = parse_record(raw)
                        if r["type"] not in ("response", "revisit"):
                            continue
                        url = r["target"] if r["target"] != r["record_id"][1:-1] else None
                        for n, v in zip(names, (r["page_id"], r["record_id"], url, r["type"], r["refers"],
                                                r["digest"], r["bytes"], r["payload"])):
                            kept[n].append(v)
                        size += len(raw)
                        if size >= 8 << 20:
                            yield _batch(kept)
                            kept, size = {n: [] for n in names}, 0
        if kept["record_id"]:
            yield _batch(kept)

    def _batch(kept):
        kinds = (pa.int64(), *(pa.string(),) * 5, pa.int64(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(kept[n], k) for n, k in zip(names, kinds)], names)

    spark = manifest.sparkSession
    return manifest.select("path").repartition(fanout(spark), "path").mapInArrow(read, _RECORDS)


def archive_report(manifest: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every
    record, the digest and size of a response from its payload, those of a
    revisit from its response, which must agree with what it declares."""
    n = F.octet_length("payload")
    rows = materialize(read_records(manifest).select(
        "page_id", "record_id", "record_type", "refers_record", "declared_digest", "declared_bytes",
        F.sha2("payload", 256).alias("digest"), n.cast("long").alias("bytes")), "warc-records")
    first = rows.filter("record_type = 'response'").withColumn("refers_to", F.lit(None).cast("long"))
    again = rows.filter("record_type = 'revisit'").drop("digest", "bytes")
    # one row for each response that is referred to, however often
    asked = materialize(again.select("refers_record").distinct(), "warc-asked")
    named = materialize(first.select(F.col("record_id").alias("refers_record"), F.col("page_id").alias("refers_to"),
                                     "digest", "bytes").join(asked, "refers_record", "left_semi"), "warc-referred")
    told = first.unionByName(again.join(named, "refers_record", "left").select(*first.columns))
    same = (F.col("digest") == F.col("declared_digest")) & (F.col("bytes") == F.col("declared_bytes"))
    broken = F.raise_error(F.concat(F.lit("payload and header differ in "), "record_id"))
    return told.select("page_id", F.col("bytes").alias("payload_bytes"),
                       F.when(F.coalesce(same, F.lit(False)), F.col("digest")).otherwise(broken.cast("string"))
                       .alias("payload_digest"), "record_type", "refers_to")


def warc_report(pages: DataFrame) -> DataFrame:
    """Write the archives of ``pages`` and report what they read back as."""
    return archive_report(write_archives(pages))

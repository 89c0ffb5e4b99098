import glob
import hashlib
import io
import random
import struct
from collections import Counter

import pytest
import zstandard

from terrane.llm import warc
from terrane.llm.warc import archive_report, parse_record, read_archive, read_records, warc_report, write_archives
from terrane.session import shared_dir

SCHEMA = "page_id long, url string, html string, number long, refers int, path string"


def _rows(seed=3, n=150):
    rnd = random.Random(seed)
    same = ["<p>" + " ".join(rnd.choice(["alpha", "beta", "Été", "\U0001f600"]) for _ in range(60)) for _ in range(4)]
    out = []
    for i in range(n):
        html = rnd.choice(same) if rnd.random() < 0.5 else f"<html>page {i} " + "lorem ipsum " * rnd.randint(0, 80)
        out.append((i * 3, f"http://a.example/{i}", html))
    out += [(1, None, None), (2, "", ""), (4, "http://x/a b\r\nWARC-Type: bogus", "x" * 99), (5, "u", "x" * 99),
            (7, "u", "y" * 100), (8, "u", "y" * 100), (8, "u", "y" * 100), (None, "u", "y" * 100), (None, None, None),
            (None, "u", "z" * 200), (None, "u", "z" * 200), (10, "é", "head\r\n\r\nWARC/1.1\r\n\r\n" * 9),
            (11, "u", "\x00\x0b" * 70), (12, "u", "big " * 300_000)]
    rnd.shuffle(out)
    return [(*r, 1, 2, "p") for r in out]


def _brute(rows):
    """As often as each row occurs; of equal rows any may be the response."""
    first = {}
    for i, _, t, *_ in rows:
        raw = (t or "").encode()
        if len(raw) >= 100:
            first.setdefault(raw, []).append(i)
    out = Counter()
    for raw, ids in first.items():
        order = sorted(ids, key=lambda i: (i is None, i or 0))
        h = hashlib.sha256(raw).hexdigest()
        out[order[0], len(raw), h, "response", None] += 1
        for i in order[1:]:
            out[i, len(raw), h, "revisit", order[0]] += 1
    for i, _, t, *_ in rows:
        raw = (t or "").encode()
        if len(raw) < 100:
            out[i, len(raw), hashlib.sha256(raw).hexdigest(), "response", None] += 1
    return out


def _got(df):
    return Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect())


def test_round_trip(spark):
    rows = _rows()
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert _got(warc_report(df)) == _brute(rows)
    stored = shared_dir(spark, "pages")
    df.write.parquet(stored)                  # numbered by file and place, without a copy
    assert _got(warc_report(spark.read.parquet(stored))) == _brute(rows)
    assert warc_report(df.limit(0)).count() == 0


def test_payloads_and_headers_come_back(spark):
    rows = [r for r in _rows() if r[0] is not None]
    folder = shared_dir(spark, "archives")
    manifest = write_archives(spark.createDataFrame(rows, SCHEMA).repartition(2), folder)
    back = read_records(manifest).collect()
    want = Counter((i, (t or "").encode()) for i, _, t, *_ in rows)
    kept = Counter((r.page_id, bytes(r.payload)) for r in back if r.record_type == "response")
    assert kept <= want and set(kept) >= {k for k in want if len(k[1]) < 100}
    urls = {r.page_id: r.url for r in back}
    assert urls[4] == "http://x/a%20b%0D%0AWARC-Type:%20bogus" and urls[1] is None and urls[2] is None and urls[10] == "é"
    responses = {r.record_id for r in back if r.record_type == "response"}
    assert all(r.refers_record in responses for r in back if r.record_type == "revisit")
    assert len({r.record_id for r in back}) == len(rows)
    # what a lost attempt left behind is not read
    with open(folder.removeprefix("file://") + "/lost.warc.zst", "wb") as f:
        f.write(b"half a file")
    assert archive_report(manifest).count() == len(rows)


def test_archive_format(spark, monkeypatch):
    folder = shared_dir(spark, "archives").removeprefix("file://")
    manifest = write_archives(spark.createDataFrame(_rows(), SCHEMA).coalesce(1), folder).collect()
    files = glob.glob(folder + "/*.warc.zst")
    assert sorted(r.path.removeprefix("file://") for r in manifest) == sorted(files)
    big = max(manifest, key=lambda r: r.n_records)
    assert big.dict_bytes > 0
    with open(big.path.removeprefix("file://"), "rb") as f:
        raw = f.read()
    assert len(raw) == big.n_bytes
    magic, n = struct.unpack("<II", raw[:8])
    assert magic == 0x184D2A5D and n == big.dict_bytes
    known = zstandard.ZstdDecompressor().decompress(raw[8:8 + n])
    assert known[:4] == b"\x37\xa4\x30\xec"              # a dictionary with its own magic number
    unpack, at, seen = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(known)), 8 + n, []
    while at < len(raw):                                 # each record is a frame that can be read by itself
        frame = unpack.decompressobj()
        seen.append(frame.decompress(raw[at:]))
        at = len(raw) - len(frame.unused_data)
    assert parse_record(seen[0])["type"] == "warcinfo" and len(seen) == big.n_records + 1
    assert list(read_archive(io.BytesIO(raw), chunk=7)) == seen
    with pytest.raises(ValueError):
        list(read_archive(io.BytesIO(raw[:-3])))
    plain = sum(len(zstandard.ZstdCompressor(level=warc.LEVEL).compress(r)) for r in seen)
    assert len(raw) - 8 - n < plain


def test_small_archives(spark, monkeypatch):
    """Records are cut into archives by their bytes; a single one has too
    little for a dictionary and is read all the same."""
    one = warc.warc_record(1, "<urn:uuid:1>", None, b"x", "00", None)
    assert list(read_archive(io.BytesIO(b"".join(warc.archive_frames([one]))))) == [one]
    with pytest.raises(ValueError):
        parse_record(one[:-1])
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 2_000)
    rows = _rows()
    manifest = write_archives(spark.createDataFrame(rows, SCHEMA).coalesce(1))
    assert _got(archive_report(manifest)) == _brute(rows)

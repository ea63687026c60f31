import hashlib
import random
import struct

import pytest
import zstandard

from pyspark.sql import functions as F

from waymesh.llm import warc
from waymesh.llm.common import fresh_path

PAGE = "page_id long, url string, html string"


def pages():
    rng = random.Random(1)
    body = lambda: "<html>" + " ".join(rng.choice(["<p>", "é", "word", "\r\n\r\n"]) for _ in range(rng.randint(0, 400)))
    rows = [(i, f"http://x/{i}", body()) for i in range(120)]
    rows += [(200 + i, "http://copy", rows[i % 5][2]) for i in range(20)]
    rows += [(300, None, None), (301, "a\nb", ""), (302, "u", "short"), (303, "u", "short"), (1, "http://x/1", rows[1][2]), (None, "n", rows[2][2]), (None, "n", "z" * 150)]
    rows += [(400, "u", "x" * 99), (401, "u", "x" * 99), (402, "u", "y" * 100), (399, "u", "y" * 100), (500, "long", "w" * 300_000)]
    return rows


def test_archive_layout():
    records = [warc.make_record(str(i), "u", b"payload %d" % i * 50, "d", None) for i in range(200)]
    archive = warc.write_archive(records)
    magic, size = struct.unpack_from("<II", archive)
    assert magic == 0x184D2A5D and 0 < size <= warc.DICTIONARY_BYTES
    assert list(warc.read_archive(archive)) == records
    # every record is a frame of its own, readable with the dictionary alone
    frames = archive[8 + size :]
    one = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(archive[8 : 8 + size])).decompressobj()
    assert one.decompress(frames) == records[0]
    assert list(warc.read_archive(warc.write_archive([b"tiny"]))) == [b"tiny"]
    with pytest.raises(ValueError):
        list(warc.read_archive(archive[:-3]))


def test_record_round_trip():
    record = warc.make_record("7", "http://a b", b"\r\n\r\nx\r\n\r\n", "ff", None)
    headers, payload = warc.parse_record(record)
    assert payload == b"\r\n\r\nx\r\n\r\n" and headers["X-Page-ID"] == "7" and headers["WARC-Target-URI"] == "http://ab"
    headers, payload = warc.parse_record(warc.make_record("8", "u", b"gone", "ff", "7"))
    assert payload == b"" and headers["WARC-Refers-To"] == warc.record_id("7") and headers["WARC-Type"] == "revisit"


def test_payloads_come_back(spark):
    rows = pages()
    folder = fresh_path(spark, "warc")
    manifest = warc.write_archives(spark.createDataFrame([(*r, "x") for r in rows], PAGE + ", digest string"), folder, archive_bytes=20_000)
    assert manifest.count() > 2 and sum(r.n_records for r in manifest.collect()) == len(rows)
    got = warc.read_archives(manifest, folder).filter("record_type = 'response'").collect()
    have = {(r.page_id, bytes(r.payload)) for r in got}
    assert all((str(i), h.encode()) in have for i, _, h in rows[:120])


def test_round_trip(spark):
    rows = pages()
    got = sorted(tuple(map(str, r)) for r in warc.round_trip(spark, spark.createDataFrame(rows, PAGE)).collect())
    want = []
    for i, _, h in rows:
        raw = (h or "").encode()
        same = [j for j, _, g in rows if (g or "").encode() == raw and j is not None] if len(raw) >= 100 else []
        first = min(same, default=None)
        again = first is not None and i != first
        want.append(tuple(map(str, (i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", first if again else None))))
    assert got == sorted(want)
    assert warc.round_trip(spark, spark.createDataFrame([], PAGE)).collect() == []


def test_many_archives_are_read_by_many_tasks_and_orphans_go(spark, monkeypatch):
    monkeypatch.setattr(warc, "READ_BYTES", 2000)
    folder = fresh_path(spark, "warc")
    df = spark.createDataFrame([(*r, "x", "y") for r in pages()], PAGE + ", refers_to string, name string")
    manifest = warc.write_archives(df, folder, archive_bytes=20_000)
    assert warc.read_archives(manifest, folder).rdd.getNumPartitions() > 3
    names = sorted(r.name for r in manifest.collect())
    some = manifest.filter(F.col("name") > names[1])
    assert warc.remove_orphans(some, folder) == 2 and warc.remove_orphans(some, folder) == 0
    assert warc.read_archives(some, folder).count() == sum(r.n_records for r in some.collect())

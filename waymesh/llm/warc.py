"""WARC archives in Zstandard frames with an embedded dictionary.

Each archive starts with a skippable frame (magic 0x184D2A5D) that holds a dictionary built from the archive's own
records; every record is then a frame of its own, compressed with it. Archives are written by the tasks that hold the
records, under a name of their own for each attempt, and a manifest lists those of the attempts that succeeded, so a lost
executor leaves at most files that nobody reads. An archive is closed at ARCHIVE_BYTES, which bounds a task's memory.

Of equal payloads of at least REVISIT_BYTES the one with the smallest page_id is stored; the others become revisit
records. Only (page_id, digest) meet by digest; the payloads move once, by page.
"""

from __future__ import annotations

import hashlib
import posixpath
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymesh.llm.common import column, cut, fresh_path, remove_folder

SKIPPABLE = 0x184D2A5D
ARCHIVE_BYTES = 16 << 20
READ_BYTES = 4 << 20  # of archives that a task reads back, about; compressed, so several times as much when unpacked
REVISIT_BYTES = 100
DICTIONARY_BYTES = 64 << 10
SAMPLE_BYTES = 1 << 20
LEVEL = 3
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record_id(page_id: str | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def make_record(page_id: str | None, url: str | None, payload: bytes, digest: str, refers_to: str | None, date: str = DATE) -> bytes:
    """A response record, or a revisit of the page refers_to, whose block has no payload."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(page_id)}",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {''.join((url or 'urn:page:none').split())}",
        f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}", f"X-Refers-To-Page: {refers_to}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(record: bytes) -> tuple[dict[str, str], bytes]:
    """(headers, payload)."""
    head, _, rest = record.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    headers = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[: int(headers["Content-Length"])]
    if rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("a record's length is wrong")
    return headers, block.partition(b"\r\n\r\n")[2]


def build_dictionary(records: list[bytes], size: int = DICTIONARY_BYTES, sample: int = SAMPLE_BYTES) -> bytes:
    """A dictionary from records spread evenly over the archive, of at most `sample` bytes; their raw bytes where there
    are too few to train on."""
    total = sum(map(len, records))
    step = max(1, -(-total // sample))
    chosen = [r[:16384] for r in records[::step]]
    try:
        return zstandard.train_dictionary(min(size, max(1024, sum(map(len, chosen)) // 8)), chosen, k=256, d=8).as_bytes()
    except zstandard.ZstdError:
        return b"".join(chosen)[:size]


def write_archive(records: list[bytes]) -> bytes:
    data = build_dictionary(records)
    pack = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(data))
    return b"".join([struct.pack("<II", SKIPPABLE, len(data)), data, *(pack.compress(r) for r in records)])


def read_archive(archive: bytes) -> Iterator[bytes]:
    """Its records."""
    magic, size = struct.unpack_from("<II", archive)
    if magic != SKIPPABLE:
        raise ValueError("no dictionary frame")
    unpack = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(archive[8 : 8 + size]))
    at = 8 + size
    while at < len(archive):
        frame, out, step = unpack.decompressobj(), [], 1 << 16
        while not frame.eof:
            part = archive[at : at + step]
            if not part:
                raise ValueError("the archive ends within a record")
            out.append(frame.decompress(part))
            at += len(part) - (len(frame.unused_data) if frame.eof else 0)
        yield b"".join(out)


def _file(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    if "://" not in uri and not uri.startswith("file:"):
        return pyarrow.fs.LocalFileSystem(), uri
    scheme, _, rest = uri.partition(":")
    scheme = {"s3a": "s3", "s3n": "s3"}.get(scheme, scheme)
    if scheme == "file":
        return pyarrow.fs.LocalFileSystem(), "/" + rest.lstrip("/")
    return pyarrow.fs.FileSystem.from_uri(f"{scheme}:{rest}")


def _writer(folder: str, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _file(folder)
        store.create_dir(base, recursive=True)
        task = uuid.uuid4().hex  # an attempt of its own

        def close(records: list[bytes], n: int) -> pa.RecordBatch:
            info = b"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:%s>\r\nWARC-Date: %s\r\nContent-Type: application/warc-fields\r\nContent-Length: 0\r\n\r\n\r\n\r\n" % (str(uuid.uuid5(uuid.NAMESPACE_URL, f"{task}-{n}")).encode(), DATE.encode())
            archive = write_archive([info, *records])
            name = f"{task}-{n:05d}.warc.zst"
            with store.open_output_stream(posixpath.join(base, name), compression=None) as f:
                f.write(archive)
            return pa.record_batch([pa.array([name]), pa.array([len(records)]), pa.array([len(archive)])], ["name", "n_records", "n_bytes"])

        records: list[bytes] = []
        size = n = 0
        for batch in batches:
            for a in range(0, batch.num_rows, 200):
                for page_id, url, html, digest, refers_to in zip(*(batch.column(c).slice(a, 200).to_pylist() for c in ("page_id", "url", "html", "digest", "refers_to"))):
                    records.append(make_record(page_id, url, html.encode("utf-8", "surrogatepass"), digest, refers_to))
                    size += len(records[-1])
                    if size >= most:
                        yield close(records, n)
                        records, size, n = [], 0, n + 1
        if records:
            yield close(records, n)

    return run


def write_archives(df: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes every row of df to archives in folder (a URI all executors can write to). The manifest: name, n_records,
    n_bytes.

    Null html is an empty payload, a null url becomes urn:page:none. Rows with a null id are written; a payload that only
    they have is a response each time. Repeated rows are records of one name, all of one type. An empty table gives no
    archive.
    """
    pages = df.select(df[id_col].cast("string").alias("page_id"), df[id_col].alias("id"), column(df, url_col, "string").alias("url"), F.coalesce(column(df, html_col, "string"), F.lit("")).alias("html"))
    keyed = pages.withColumn("digest", F.sha2("html", 256))
    small = keyed.filter(F.octet_length("html") >= REVISIT_BYTES).select("id", "page_id", "digest")
    small = cut(small)
    # Only digests that repeat; kept apart, so that a hot one can be split in the join.
    winners = cut(small.groupBy(F.col("digest").alias("d")).agg(F.min("id").alias("best"), F.count("*").alias("n")).filter("best is not null and n > 1").select("d", "best"))
    again = small.join(winners, F.col("digest") == F.col("d")).filter(~F.col("id").eqNullSafe(F.col("best")))
    again = again.select(F.col("page_id").alias("__page"), F.col("digest").alias("__digest"), F.col("best").cast("string").alias("refers_to")).distinct()
    full = keyed.join(again, keyed.page_id.eqNullSafe(again["__page"]) & (keyed.digest == again["__digest"]), "left").select("page_id", "url", "html", "digest", "refers_to")
    return cut(full.mapInArrow(_writer(folder, archive_bytes), "name string, n_records long, n_bytes long"))


def _reader(folder: str, with_payload: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _file(folder)
        for batch in batches:
            for name in batch.column("name").to_pylist():
                with store.open_input_file(posixpath.join(base, name)) as f:
                    archive = f.read()
                rows = []
                for record in read_archive(archive):
                    headers, payload = parse_record(record)
                    if headers["WARC-Type"] == "warcinfo":
                        continue
                    digest = headers["WARC-Payload-Digest"].removeprefix("sha256:")
                    response = headers["WARC-Type"] == "response"
                    if response and hashlib.sha256(payload).hexdigest() != digest:
                        raise ValueError(f"{name}: a payload does not match its digest")
                    rows.append((headers.get("X-Page-ID"), headers["WARC-Type"], digest, headers.get("X-Refers-To-Page"), len(payload) if response else None, payload if with_payload and response else None))
                columns = list(zip(*rows)) if rows else [()] * 6
                kinds = (pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.binary())
                yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], ["page_id", "record_type", "payload_digest", "refers_to", "payload_bytes", "payload"])

    return run


def read_archives(manifest: DataFrame, folder: str, with_payload: bool = True) -> DataFrame:
    """page_id, record_type, payload_digest, refers_to (page ids as text), payload_bytes, payload (null for revisits).

    A record whose payload doesn't match its digest, or a cut archive, is an error. The bytes of the archives decide how
    many tasks read them; names alone are so small that they would all be dealt to one."""
    schema = "page_id string, record_type string, payload_digest string, refers_to string, payload_bytes long, payload binary"
    tasks = -(-(manifest.agg(F.sum("n_bytes")).first()[0] or 0) // READ_BYTES)
    return manifest.select("name").repartition(max(1, tasks), "name").mapInArrow(_reader(folder, with_payload), schema)


def _remover(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _file(folder)
        for batch in batches:
            for name in batch.column("name").to_pylist():
                store.delete_file(posixpath.join(base, name))
            yield batch

    return run


def remove_orphans(manifest: DataFrame, folder: str) -> int:
    """Deletes the archives in folder that the manifest doesn't list: those of attempts that failed or were given up. How
    many they were. No writer may be at work there."""
    spark = manifest.sparkSession
    there = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("name"))
    lost = there.join(manifest.select(F.col("name").alias("known")), F.col("name") == F.col("known"), "left_anti")
    return lost.mapInArrow(_remover(folder), "name string").count()


def round_trip(spark: SparkSession, df: DataFrame, id_col: str = "page_id") -> DataFrame:
    """Writes df to archives in the shared folder, reads them back and removes them: page_id, payload_bytes,
    payload_digest, record_type, refers_to. A revisit's payload_bytes come from the record that it refers to."""
    folder = fresh_path(spark, "warc")
    kind = df.schema[id_col].dataType
    manifest = write_archives(df, folder, id_col)
    rows = cut(read_archives(manifest, folder, with_payload=False).drop("payload"))
    remove_folder(spark, folder)
    stored = rows.filter("record_type = 'response' and page_id is not null").select(F.col("page_id").alias("r"), F.col("payload_digest").alias("d"), F.col("payload_bytes").alias("n")).distinct()
    both = rows.join(stored, (F.col("refers_to") == F.col("r")) & (F.col("payload_digest") == F.col("d")), "left")
    return both.select(F.col("page_id").cast(kind).alias("page_id"), F.coalesce("payload_bytes", "n").alias("payload_bytes"), "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"))

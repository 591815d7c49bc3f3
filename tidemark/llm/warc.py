"""WARC archives with one Zstandard dictionary per file.

A ``.warc.zst`` file begins with a skippable frame (magic 0x184D2A5D) that
holds the dictionary; every WARC record is then a frame of its own, compressed
with it, so one record can be fetched and decoded alone.  The dictionary is
built from the first records of the file that it opens, within a byte bound.

Equal payloads are found by digest with a partial minimum per digest; payloads
go to no driver, and a digest that a third of the pages share is a skewed join
key that Spark splits, not a group that one task gathers.
"""

from __future__ import annotations

import hashlib
import io
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import filesystem, scratch_path, staged

SKIPPABLE = 0x184D2A5D
DATE = "2024-01-01T00:00:00Z"  # records carry no crawl time; a fixed date keeps reruns equal
MANIFEST = "part int, path string, n_records long, n_bytes long"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def with_record_types(pages: DataFrame, least_bytes: int = 100) -> DataFrame:
    """``page_id, url, payload`` (binary, null for revisits) ``, payload_bytes,
    payload_digest, record_type, refers_to``."""
    payload = F.coalesce(F.encode("html", "UTF-8"), F.lit(b""))
    pages = pages.select("page_id", "url", payload.alias("payload"))
    pages = pages.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": F.sha2("payload", 256)})
    first = pages.where(F.col("payload_bytes") >= least_bytes).groupBy("payload_digest").agg(
        F.min("page_id").alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    again = F.col("_first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_first"))
    return pages.join(first, "payload_digest", "left").select(
        "page_id", "url", F.when(~again, F.col("payload")).alias("payload"), "payload_bytes", "payload_digest",
        F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("_first")).alias("refers_to"))


def _header(fields: list[tuple[str, object]]) -> bytes:
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None) + "\r\n").encode()


def record(row: dict) -> bytes:
    """The WARC record of one page."""
    http = b""
    if row["record_type"] == "response":
        http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % row["payload_bytes"] + row["payload"]
    url = quote(row["url"] or "urn:unknown", safe=":/?#[]@!$&'()*+,;=%-._~")
    name = uuid.uuid5(uuid.NAMESPACE_URL, f"{row['page_id']} {url} {row['payload_digest']}")
    return _header([
        ("WARC-Type", row["record_type"]), ("WARC-Record-ID", f"<urn:uuid:{name}>"), ("WARC-Date", DATE), ("WARC-Target-URI", url),
        ("WARC-Payload-Digest", f"sha256:{row['payload_digest']}"), ("WARC-Profile", PROFILE if row["record_type"] == "revisit" else None),
        ("Page-ID", row["page_id"]), ("Page-Refers-To", row["refers_to"]), ("Payload-Length", row["payload_bytes"]),
        ("Content-Type", "application/http; msgtype=response"), ("Content-Length", len(http))]) + http + b"\r\n\r\n"


def dictionary(samples: list[bytes], size: int) -> zstandard.ZstdCompressionDict:
    """A trained dictionary; where the samples are too few to train on, their
    own bytes as plain content."""
    try:
        return zstandard.train_dictionary(size, samples, k=512, d=8, f=18, accel=4)
    except zstandard.ZstdError:
        return zstandard.ZstdCompressionDict(b"".join(samples)[-size:], dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def write_warc(rows: DataFrame, folder: str, file_bytes: int = 128 << 20, sample_bytes: int = 4 << 20,
               dict_bytes: int = 64 << 10, level: int = 3) -> DataFrame:
    """Writes the output of ``with_record_types`` below ``folder``, files of at
    most about ``file_bytes`` uncompressed, and returns the manifest.  Names
    hold the task's attempt; only files of the manifest count."""
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = filesystem(folder)
        fs.create_dir(root, recursive=True)
        part, attempt, done = TaskContext.get().partitionId(), uuid.uuid4().hex[:12], []
        stream = (record(r) for b in batches for i in range(0, b.num_rows, 256) for r in b.slice(i, 256).to_pylist())
        one = next(stream, None)
        while one is not None:
            first, size = [], 0
            while one is not None and size < sample_bytes:
                first.append(one)
                size += len(one)
                one = next(stream, None)
            made = dictionary(first, dict_bytes)
            packer = zstandard.ZstdCompressor(level=level, dict_data=made)
            packed = zstandard.ZstdCompressor(level=level).compress(made.as_bytes())
            path = f"{root}/part-{part:06d}-{len(done):04d}-{attempt}.warc.zst"
            info = b"software: tidemark\r\nformat: WARC File Format 1.1\r\n"
            opening = _header([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, path)}>"),
                               ("WARC-Date", DATE), ("Content-Type", "application/warc-fields"), ("Content-Length", len(info))]) + info + b"\r\n\r\n"
            n = 0
            with fs.open_output_stream(path, compression=None) as out:
                out.write(struct.pack("<II", SKIPPABLE, len(packed)) + packed)
                out.write(packer.compress(opening))
                for x in first:
                    out.write(packer.compress(x))
                n += len(first)
                del first
                while one is not None and size < file_bytes:
                    out.write(packer.compress(one))
                    n, size = n + 1, size + len(one)
                    one = next(stream, None)
            done.append({"part": part, "path": path, "n_records": n, "n_bytes": size})
        yield pa.RecordBatch.from_pylist(done, pa.schema([("part", pa.int32()), ("path", pa.string()), ("n_records", pa.int64()), ("n_bytes", pa.int64())]))

    return staged(rows.mapInArrow(write, MANIFEST), "warc-manifest")


def opened(f) -> io.BufferedReader:
    """The records of an archive as one stream of plain WARC."""
    magic, size = struct.unpack("<II", f.read(8))
    if magic != SKIPPABLE:
        raise ValueError("the archive does not begin with a dictionary")
    raw = zstandard.ZstdDecompressor().decompress(f.read(size))
    kind = zstandard.DICT_TYPE_FULLDICT if raw[:4] == b"\x37\xa4\x30\xec" else zstandard.DICT_TYPE_RAWCONTENT
    packer = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw, dict_type=kind))
    return io.BufferedReader(packer.stream_reader(f, read_across_frames=True), 1 << 20)


def records(f) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and block of every record."""
    stream = opened(f)
    while stream.readline():
        head = {}
        while (line := stream.readline()) not in (b"\r\n", b""):
            k, _, v = line.decode().partition(":")
            head[k] = v.strip()
        block = stream.read(int(head["Content-Length"]))
        stream.read(4)
        yield head, block


def read_warc(manifest: DataFrame, with_payload: bool = False) -> DataFrame:
    """One row per page of the manifest's archives: ``page_id, url,
    payload_bytes, payload_digest, record_type, refers_to`` and, if asked for,
    ``payload`` (null for revisits, whose length and digest are of the payload
    that they refer to).  A response that does not match its digest raises."""
    fields = [("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
              ("record_type", pa.string()), ("refers_to", pa.int64())] + [("payload", pa.binary())] * with_payload
    n = max(1, min(manifest.count(), 8 * int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    number = lambda x: None if x is None else int(x)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for path in (p for b in batches for p in b.column("path").to_pylist()):
            fs, path = filesystem(path)
            rows, size = [], 0
            with fs.open_input_stream(path, compression=None) as f:
                for head, block in records(f):
                    if head["WARC-Type"] == "warcinfo":
                        continue
                    digest, length = head["WARC-Payload-Digest"].removeprefix("sha256:"), int(head["Payload-Length"])
                    payload = block.partition(b"\r\n\r\n")[2] if head["WARC-Type"] == "response" else None
                    if payload is not None and (len(payload) != length or hashlib.sha256(payload).hexdigest() != digest):
                        raise ValueError(f"{head['WARC-Record-ID']} does not match its digest")
                    rows.append({"page_id": number(head.get("Page-ID")), "url": head["WARC-Target-URI"], "payload_bytes": length, "payload_digest": digest,
                                 "record_type": head["WARC-Type"], "refers_to": number(head.get("Page-Refers-To")), "payload": payload})
                    size += len(block)
                    if len(rows) >= 5000 or size > 8 << 20:
                        yield pa.RecordBatch.from_pylist(rows, pa.schema(fields))
                        rows, size = [], 0
            yield pa.RecordBatch.from_pylist(rows, pa.schema(fields))

    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * with_payload
    return manifest.repartitionByRange(n, "part", "path").mapInArrow(read, schema)


def warc_round_trip(pages: DataFrame) -> DataFrame:
    """Archives ``pages`` (``page_id, url, html``) and reads the archives back.

    Of equal payloads of at least 100 bytes the smallest page_id is the
    response, others revisit it; rows that repeat that page_id are responses
    too, a null id revisits any other, and where all ids are null all are
    responses.  A null html is an empty payload, a null url ``urn:unknown``.  An
    empty table gives no archive and no rows; other columns are not read.
    """
    folder = scratch_path(pages.sparkSession, "warc")
    return read_warc(write_warc(with_record_types(pages), folder))

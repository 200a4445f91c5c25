"""WARC archives compressed record by record with a Zstandard dictionary.

``write`` archives one record per page into ``.warc.zst`` files: a leading skippable frame (magic
0x184D2A5D) holds the dictionary, every record after it is a frame of its own.  The dictionary is
trained once on a bounded hash sample of the records to be archived (``SAMPLE_RECORDS`` of them,
``SAMPLE_BYTES`` of each) and is at most ``DICTIONARY_BYTES`` long, so it can travel to the tasks.

Of the records with equal payloads of at least ``MIN_REVISIT_BYTES``, the one with the largest page id
holds the payload (``response``); the others are ``revisit`` records that name it and hold none.  Which
payloads are shared is settled by a map-side combined count per digest; pages join those digests by a
plain equi-join, whose hot keys AQE splits.

``read`` streams the archives back, checks the digest of every payload it finds, and returns one row
per record.

Files are written under a temporary name and published by a rename; their names depend on the
partition alone, so a retried task replaces its own files.  ``write`` stores the list of archives as a
table on shared storage, so archives are written once however often the result is used.

Defined results: a null page is an empty payload; payloads below the limit are never revisits; rows that
repeat both payload and largest page id are all responses; a null page id never is the referred one
unless the group has no other (then all its rows are responses); an empty table gives no archives and
no rows; a page longer than an archive's size limit gets an archive of its own; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from migrata.llm.common import col, scratch, small_batches
from migrata.llm.files import open_fs, write_file

MIN_REVISIT_BYTES = 1000
SAMPLE_RECORDS = 1000
SAMPLE_BYTES = 16_384
DICTIONARY_BYTES = 112_640
ARCHIVE_BYTES = 256 << 20   # of records before compression, per archive
LEVEL = 3
DATE = "1970-01-01T00:00:00Z"
# fixed values of the format
DICTIONARY_MAGIC = 0x184D2A5D
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MAX_READ_TASKS = 20_000

MANIFEST = T.StructType([T.StructField("archive", T.StringType()), T.StructField("records", T.LongType()),
                         T.StructField("bytes", T.LongType())])


def _record_id(page_id: Any) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def record(page_id: Any, url: str | None, payload: bytes, refers_to: Any = None, revisit: bool = False, date: str = DATE) -> bytes:
    """One WARC/1.1 record; a revisit keeps the HTTP header block and names the response."""
    digest = "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_record_id(page_id)}",
            f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(c if c > " " else f"%{ord(c):02X}" for c in url))
    head += [f"WARC-Payload-Digest: {digest}", "Content-Type: application/http;msgtype=response"]
    if revisit:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {_record_id(refers_to)}"]
    else:
        block += payload
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def build_dictionary(records: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A dictionary trained on records; too few to train on serve as raw content (none: no dictionary)."""
    try:
        return zstandard.train_dictionary(size, records, k=200, d=8, level=LEVEL).as_bytes()
    except (zstandard.ZstdError, ValueError):
        raw = b"".join(records)[-size:]
        return raw if len(raw) >= 8 else b""


def _leading_frame(dictionary: bytes) -> bytes:
    return struct.pack("<II", DICTIONARY_MAGIC, len(dictionary)) + dictionary


def _tools(dictionary: bytes):
    return zstandard.ZstdCompressionDict(dictionary) if dictionary else None


def decide(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
           min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """(page_id, url, html, revisit, refers_to) per page."""
    rows = pages.select(col(id_col).alias("page_id"), col(url_col).cast("string").alias("url"), col(html_col).alias("html")).withColumn(
        "digest", F.when(F.octet_length("html") >= min_bytes, F.sha1(F.col("html").cast("binary"))))
    shared = (rows.where("digest is not null").groupBy("digest").agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
              .where("n > 1 and first is not null").drop("n"))
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return rows.join(shared, "digest", "left").select(
        "page_id", "url", "html", revisit.alias("revisit"), F.when(revisit, F.col("first")).alias("refers_to"))


def train(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
          sample: int = SAMPLE_RECORDS) -> bytes:
    """The dictionary for ``pages``, from a hash sample of about ``sample`` of them (of a long one, a stretch of ``SAMPLE_BYTES``
    characters from a place anywhere in it)."""
    n = pages.count()
    text = col(html_col)
    start = F.pmod(F.xxhash64(text), F.greatest(F.char_length(text) - SAMPLE_BYTES, F.lit(0)) + 1).cast("int") + 1
    rows = pages.select(col(id_col).alias("k"), col(url_col).cast("string").alias("u"), F.substring(text, start, F.lit(SAMPLE_BYTES)).alias("h"))
    if n > sample:
        # one row in n / sample, by its position in the input rather than its id: ids may repeat
        rows = rows.where(F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(1 << 30)) < int(sample / n * (1 << 30)))
    records = [record(r["k"], r["u"], (r["h"] or "").encode("utf-8", "surrogatepass")) for r in rows.collect()]
    return build_dictionary(sorted(records))


def write(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", folder: str | None = None,
          min_bytes: int = MIN_REVISIT_BYTES, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Archives ``pages`` below ``folder`` (default: shared scratch storage); the stored list of archives."""
    spark = pages.sparkSession
    small_batches(spark)
    folder = (folder or scratch(spark, "warc")).rstrip("/")
    shipped = spark.sparkContext.broadcast(train(pages, id_col, url_col, html_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        dictionary = shipped.value
        compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=_tools(dictionary), write_content_size=True, write_checksum=True)
        stream = publish = None
        uri, seq, n, used, size = "", 0, 0, 0, 0
        done: list[tuple[str, int, int]] = []

        def close() -> None:
            nonlocal stream, seq
            stream.close()
            publish()
            done.append((uri, n, size))
            stream, seq = None, seq + 1

        for batch in batches:
            cols = [batch.column(i) for i in range(batch.num_columns)]
            for i in range(batch.num_rows):
                key, url, page, revisit, refers = (c[i].as_py() for c in cols)
                data = record(key, url, (page or "").encode("utf-8", "surrogatepass"), refers, revisit)
                if stream is not None and used + len(data) > archive_bytes:
                    close()
                if stream is None:
                    uri = f"{folder}/part-{task.partitionId():06d}-{seq:04d}.warc.zst"
                    stream, publish = write_file(uri, str(task.taskAttemptId()))
                    n = used = size = 0
                    if dictionary:
                        size += stream.write(frame := _leading_frame(dictionary)) or len(frame)
                frame = compressor.compress(data)
                stream.write(frame)
                n, used, size = n + 1, used + len(data), size + len(frame)
        if stream is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64()),
                                          pa.array([d[2] for d in done], pa.int64())], names=MANIFEST.names)

    manifest = f"{folder}/manifest.parquet"
    decide(pages, id_col, url_col, html_col, min_bytes).mapInArrow(run, MANIFEST).write.parquet(manifest)
    return spark.read.schema(MANIFEST).parquet(manifest)


class _Reader(io.RawIOBase):
    """The records of one archive as a plain stream of bytes."""

    def __init__(self, source) -> None:
        head = source.read(8)
        dictionary = b""
        rest = head
        if len(head) == 8:
            magic, n = struct.unpack("<II", head)
            if magic == DICTIONARY_MAGIC:
                dictionary, rest = source.read(n), b""
        self._source, self._rest = source, rest
        self._stream = zstandard.ZstdDecompressor(dict_data=_tools(dictionary)).stream_reader(self, read_across_frames=True)
        self.records = io.BufferedReader(_Plain(self._stream), 1 << 18)

    def readable(self) -> bool:
        return True

    def read(self, n: int = -1) -> bytes:
        if self._rest:
            out, self._rest = self._rest, b""
            return out
        return self._source.read(n)


class _Plain(io.RawIOBase):
    def __init__(self, stream) -> None:
        self._stream = stream

    def readable(self) -> bool:
        return True

    def readinto(self, buffer) -> int:
        return self._stream.readinto(buffer)


def records_of(source) -> Iterator[tuple[dict[str, str], bytes]]:
    """(lower-case header fields, block) of every record of an open archive."""
    lines = _Reader(source).records
    while True:
        first = lines.readline()
        if not first:
            return
        if not first.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {first[:40]!r}")
        fields: dict[str, str] = {}
        while (line := lines.readline()) not in (b"\r\n", b""):
            name, _, value = line.decode("utf-8", "surrogatepass").partition(":")
            fields[name.strip().lower()] = value.strip()
        n = int(fields["content-length"])
        block = lines.read(n)
        if len(block) != n or lines.read(4) != b"\r\n\r\n":
            raise ValueError("truncated WARC record")
        yield fields, block


def parse(fields: dict[str, str], block: bytes) -> tuple[str | None, str | None, int, str, str, str | None, bytes | None]:
    """(page id, url, payload bytes, hex digest, type, referred page id, payload) of a record, its payload checked."""
    def page(value: str | None) -> str | None:
        key = value[len("<urn:page:"):-1] if value else ""
        return key or None

    digest = base64.b32decode(fields["warc-payload-digest"].split(":", 1)[1]).hex()
    head, _, payload = block.partition(b"\r\n\r\n")
    length = next(int(x.split(b":")[1]) for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    kind = fields["warc-type"]
    if kind == "response" and (hashlib.sha1(payload).hexdigest() != digest or len(payload) != length):
        raise ValueError(f"payload digest of {fields['warc-record-id']} does not match")
    return (page(fields["warc-record-id"]), fields.get("warc-target-uri"), length, digest, kind,
            page(fields.get("warc-refers-to")), payload if kind == "response" else None)


def read(archives: DataFrame, id_type: T.DataType | None = None, payloads: bool = False) -> DataFrame:
    """One row per record of the listed archives; ``payloads`` adds the payload of responses as text."""
    spark = archives.sparkSession
    n = archives.count()
    fields = [T.StructField("page_id", T.StringType()), T.StructField("url", T.StringType()), T.StructField("payload_bytes", T.LongType()),
              T.StructField("payload_digest", T.StringType()), T.StructField("record_type", T.StringType()), T.StructField("refers_to", T.StringType())]
    if payloads:
        fields.append(T.StructField("payload", T.BinaryType()))
    schema = T.StructType(fields)
    types = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary()][:len(fields)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                system, path = open_fs(uri)
                rows: list[tuple] = []
                held = 0
                with system.open_input_stream(path, compression=None) as source:
                    for head, block in records_of(source):
                        row = parse(head, block)
                        rows.append(row[:len(types)])
                        held += len(block) if payloads else 200
                        if held > 4 << 20:
                            yield _rows(rows, types, schema.names)
                            rows, held = [], 0
                if rows:
                    yield _rows(rows, types, schema.names)

    out = archives.select("archive").repartition(max(1, min(n, MAX_READ_TASKS))).mapInArrow(run, schema)
    kind = id_type or T.StringType()
    return out.withColumn("page_id", F.col("page_id").cast(kind)).withColumn("refers_to", F.col("refers_to").cast(kind))


def _rows(rows: list[tuple], types: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)], names=names)


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """The archive's own account of every page: written, read back, payloads checked."""
    archives = write(pages, id_col, url_col, html_col)
    return read(archives, pages.schema[id_col].dataType).select(
        F.col("page_id").alias(id_col), "payload_bytes", "payload_digest", "record_type", "refers_to")

"""WARC archives whose records are Zstandard frames of their own, with the dictionary in a leading skippable frame."""

from __future__ import annotations

import base64
import hashlib
import io
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldmarch.session import cut, shared_dir

#: Magic number of the skippable frame that holds the dictionary of a compressed archive (fixed value).
DICTIONARY_FRAME = 0x184D2A5D
DICTIONARY_BYTES = 64 << 10
#: Records held for one archive: the dictionary is built from all of them before the first is compressed.
ARCHIVE_BYTES = 32 << 20
LEVEL = 6
DATE = "1970-01-01T00:00:00Z"
_CONTROL = re.compile(r"[\x00-\x20\x7f]")
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()  # noqa: S324


def record(page: dict) -> bytes:
    """One WARC record: the payload behind an HTTP header, or for a revisit the header alone."""
    payload = page["html"].encode()
    revisit = page["record_type"] == "revisit"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {page['record_type']}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'page {page['page_id']}')}>", f"WARC-Date: {DATE}"]
    if page["url"]:
        head.append("WARC-Target-URI: " + _CONTROL.sub(lambda m: f"%{ord(m[0]):02X}", page["url"]))
    if page["page_id"] is not None:
        head.append(f"X-Page-Id: {page['page_id']}")
    head += [f"WARC-Payload-Digest: sha1:{digest(payload)}", f"X-Payload-Length: {len(payload)}"]
    if revisit:
        head += [f"WARC-Profile: {_REVISIT}", f"WARC-Refers-To: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'page {page['refers_to']}')}>", f"X-Refers-To-Page-Id: {page['refers_to']}"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def build_dictionary(records: list[bytes]) -> zstandard.ZstdCompressionDict:
    """Trained on the records; where they are too few or too alike to train on, their first bytes serve as plain content."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, records)
    except zstandard.ZstdError:
        return zstandard.ZstdCompressionDict(b"".join(records)[:DICTIONARY_BYTES] or b"\0" * 8, dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def archive(records: list[bytes]) -> bytes:
    found = build_dictionary(records)
    packed = zstandard.ZstdCompressor(level=LEVEL).compress(found.as_bytes())
    compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=found)
    return b"".join([struct.pack("<II", DICTIONARY_FRAME, len(packed)), packed, *map(compressor.compress, records)])


def read_archive(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and block of each record, a record at a time."""
    magic, size = struct.unpack("<II", stream.read(8))
    if magic != DICTIONARY_FRAME:
        raise ValueError("the archive does not begin with a dictionary frame")
    packed = stream.read(size)
    found = zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(packed))
    plain = io.BufferedReader(zstandard.ZstdDecompressor(dict_data=found).stream_reader(stream, read_across_frames=True), 1 << 20)
    while line := plain.readline():
        if line != b"WARC/1.1\r\n":
            raise ValueError(f"no record begins with {line[:40]!r}")
        fields = {}
        while (line := plain.readline()) != b"\r\n":
            name, _, value = line.decode().rstrip("\r\n").partition(": ")
            fields[name] = value
        block = plain.read(int(fields["Content-Length"]))
        if plain.read(4) != b"\r\n\r\n":
            raise ValueError("a record is cut short")
        yield fields, block


def plan_records(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """``page_id, url, html, record_type, refers_to``: of equal payloads of ``least_bytes`` or more, the smallest page id is the response.

    Rows that repeat that id are responses too; a group without any id is all responses. Null html is an empty payload.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("payload", F.sha1(F.encode("html", "utf-8")))
    large = F.octet_length("html") >= least_bytes
    again = rows.filter(large).groupBy("payload").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1 and first is not null")
    joined = rows.join(again.select(F.col("payload").alias("same"), "first"), (F.col("payload") == F.col("same")) & large, "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return joined.select("page_id", "url", "html", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("first")).alias("refers_to"))


def write(pages: DataFrame, folder: str, least_bytes: int = 0) -> DataFrame:
    """Write archives of all pages to ``folder`` (a URI that all executors share) and return the manifest ``path, records, bytes``.

    Tasks close an archive at about 32 MB of records. Names are unique to each attempt, and the manifest is itself a written table, so
    only archives of finished tasks are in it; what a lost task left behind is never read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = pyarrow.fs.FileSystem.from_uri(folder)
        files.create_dir(root, recursive=True)

        def close(records: list[bytes]) -> pa.RecordBatch:
            name, content = f"{uuid.uuid4().hex}.warc.zst", archive(records)
            with files.open_output_stream(f"{root}/{name}", compression=None) as out:
                out.write(content)
            return pa.record_batch([pa.array([f"{folder}/{name}"]), pa.array([len(records)]), pa.array([len(content)])], names=["path", "records", "bytes"])

        held, size = [], 0
        for batch in batches:
            for page in batch.to_pylist():
                held.append(record(page))
                size += len(held[-1])
                if size >= ARCHIVE_BYTES:
                    yield close(held)
                    held, size = [], 0
        if held:
            yield close(held)

    return cut(plan_records(pages, least_bytes).mapInArrow(run, "path string, records long, bytes long"))


def read(manifest: DataFrame) -> DataFrame:
    """``page_id, url, record_type, refers_to, payload_bytes, payload_digest, html`` of all records; a revisit's html is null.

    Digests and lengths of responses are worked out anew from what was read and must agree with the record's own.
    """
    schema = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, html string"
    types = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("html", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = lambda x: None if x is None else int(x)
        for batch in batches:
            for path in batch.column("path").to_pylist():
                files, at = pyarrow.fs.FileSystem.from_uri(path)
                with files.open_input_stream(at, compression=None) as stream:
                    rows, size = [], 0
                    for fields, block in read_archive(stream):
                        kind, payload = fields["WARC-Type"], block.partition(b"\r\n\r\n")[2]
                        named, length = fields["WARC-Payload-Digest"].removeprefix("sha1:"), int(fields["X-Payload-Length"])
                        if kind == "response" and (digest(payload) != named or len(payload) != length):
                            raise ValueError(f"a payload in {path} is damaged")
                        rows.append((number(fields.get("X-Page-Id")), fields.get("WARC-Target-URI"), kind, number(fields.get("X-Refers-To-Page-Id")), length, named, payload.decode() if kind == "response" else None))
                        size += len(block)
                        if size >= 4 << 20:
                            yield pa.RecordBatch.from_pylist([dict(zip(types.names, r, strict=True)) for r in rows], types)
                            rows, size = [], 0
                    yield pa.RecordBatch.from_pylist([dict(zip(types.names, r, strict=True)) for r in rows], types)

    files = max(1, manifest.count())
    return manifest.select("path").repartition(files).mapInArrow(run, schema)


def round_trip(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Archives of all pages in a new folder of the shared one, read back."""
    folder = shared_dir(pages.sparkSession)
    folder = folder if "://" in folder or folder.startswith("/") else f"/{folder}"
    return read(write(pages, f"{folder.rstrip('/')}/warc-{uuid.uuid4().hex}", least_bytes))

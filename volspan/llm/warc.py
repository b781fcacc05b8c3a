"""Dictionary-compressed WARC archives: writing and reading.

An archive is a Zstandard stream: a leading skippable frame that holds the
dictionary, then one frame per record. The dictionary is trained from the archive's own
first records (at most `SAMPLE_BYTES`); with too few of them to train on there is no
dictionary frame. Records with equal payloads are deduplicated over all archives:
the one with the largest id is the response, the others are revisit records that
name it and carry no payload.

Writing tasks put their archives into the shared folder under names of their own,
and report them in a manifest table. Only archives that the manifest names count, so
what a lost or repeated task left behind is never read.

Defined results: a null payload counts as empty; a null id or url stays null and is
told from an empty one; control characters of a url are percent-encoded; of equal payloads whose ids are all null every record is a response;
rows that repeat the largest id are all responses (and share a record id); ids that
repeat elsewhere are revisits each; an empty table gives an empty manifest and no record; very large payloads
are one frame each.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from volspan.llm.arrowmap import quoted
from volspan.llm.shared import stored

#: Fixed values of the formats.
DICTIONARY_MAGIC = 0x184D2A5D
VERSION = b"WARC/1.1"
#: Would break a header line: written percent-encoded.
CONTROL = re.compile(r"[\x00-\x1f\x7f]")
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

DICTIONARY_BYTES = 64 << 10
SAMPLE_BYTES = 4 << 20
LEVEL = 6
#: Hashes of repeated payloads that are broadcast; beyond, they are joined by shuffle.
BROADCAST_HASHES = 1_000_000
#: A task starts a new archive beyond this.
ARCHIVE_BYTES = 256 << 20


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(record_id: str, url: str | None, payload: bytes, date: str, refers_to: str | None = None) -> bytes:
    """One WARC record. A revisit keeps the HTTP head, with the full payload's length, alone."""
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    lines = [
        ("WARC-Type", "revisit" if refers_to is not None else "response"),
        ("WARC-Record-ID", f"<{record_id}>"),
        ("WARC-Date", date),
        ("WARC-Payload-Digest", "sha1:" + payload_digest(payload)),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    if url is not None:
        lines.append(("WARC-Target-URI", CONTROL.sub(lambda m: f"%{ord(m[0]):02X}", url)))
    if refers_to is not None:
        lines += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", f"<{refers_to}>")]
    block = head if refers_to is not None else head + payload
    lines.append(("Content-Length", str(len(block))))
    return VERSION + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines).encode() + b"\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """Header fields, HTTP fields and payload of a record."""
    cut = raw.index(b"\r\n\r\n")
    version, *lines = raw[:cut].decode().split("\r\n")
    if version != VERSION.decode():
        raise ValueError(f"not a WARC record: {version[:20]!r}")
    fields = dict(line.split(": ", 1) for line in lines)
    block = raw[cut + 4 : cut + 4 + int(fields["Content-Length"])]
    end = block.index(b"\r\n\r\n")
    http = dict(line.split(": ", 1) for line in block[:end].decode().split("\r\n")[1:])
    return fields, http, block[end + 4 :]


def train(samples: list[bytes]) -> zstandard.ZstdCompressionDict | None:
    if len(samples) < 16 or sum(map(len, samples)) < 16 * 1024:
        return None
    try:
        return zstandard.train_dictionary(min(DICTIONARY_BYTES, sum(map(len, samples)) // 8), samples, k=200, d=8)
    except zstandard.ZstdError:  # too little variety to train on
        return None


class Archive:
    """An archive being written: the first records wait until the dictionary is made of them."""

    def __init__(self, store: fs.FileSystem, path: str):
        self.path, self.sink = path, store.open_output_stream(path, compression=None)
        self.waiting: list[bytes] | None = []
        self.waiting_bytes = self.bytes = self.records = self.dictionary_bytes = 0
        self.press = zstandard.ZstdCompressor(level=LEVEL)

    def begin(self) -> None:
        samples, self.waiting = self.waiting or [], None
        made = train(samples)
        if made is not None:
            held = zstandard.ZstdCompressor(level=19).compress(made.as_bytes())
            self.put(struct.pack("<II", DICTIONARY_MAGIC, len(held)) + held)
            self.dictionary_bytes = len(held)
            self.press = zstandard.ZstdCompressor(level=LEVEL, dict_data=made)
        for x in samples:
            self.put(self.press.compress(x))

    def put(self, raw: bytes) -> None:
        self.sink.write(raw)
        self.bytes += len(raw)

    def add(self, raw: bytes) -> None:
        self.records += 1
        if self.waiting is None:
            self.put(self.press.compress(raw))
            return
        self.waiting.append(raw)
        self.waiting_bytes += len(raw)
        if self.waiting_bytes > SAMPLE_BYTES:
            self.begin()

    def close(self) -> dict:
        if self.waiting is not None:
            self.begin()
        self.sink.close()
        return {"archive": self.path, "records": self.records, "bytes": self.bytes, "dictionary_bytes": self.dictionary_bytes}


def frames(source, chunk: int = 1 << 20) -> Iterator[bytes]:
    """The records of an archive, one after another."""
    buffer = source.read(8)
    press = zstandard.ZstdDecompressor()
    if len(buffer) == 8 and struct.unpack("<I", buffer[:4])[0] == DICTIONARY_MAGIC:
        size = struct.unpack("<I", buffer[4:])[0]
        raw = zstandard.ZstdDecompressor().decompress(source.read(size))
        press, buffer = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw)), b""
    while buffer or (buffer := source.read(chunk)):
        one, parts = press.decompressobj(), []
        while not one.eof:
            if not buffer and not (buffer := source.read(chunk)):
                raise ValueError("the archive ends within a record")
            parts.append(one.decompress(buffer))
            buffer = one.unused_data if one.eof else b""
        yield b"".join(parts)


MANIFEST = "archive string, records long, bytes long, dictionary_bytes long"


def with_responses(pages: DataFrame, id_col: str, url_col: str, payload_col: str, least_bytes: int) -> DataFrame:
    """(id, url, payload, refers_to): the id of the response for rows that revisit one."""
    payload = F.coalesce(F.col(quoted(payload_col)).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(url_col)).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("same", F.sha2("payload", 256))
    # only hashes that repeat matter; payloads stay where they are read as long as these are few
    last = rows.groupBy("same").agg(F.max("id").alias("last"), F.count("*").alias("copies")).where("copies > 1")
    last = stored(last.select("same", "last"), "repeated-payloads")
    joined = rows.join(F.broadcast(last) if last.count() <= BROADCAST_HASHES else last, "same", "left")
    revisits = (F.octet_length("payload") >= least_bytes) & F.coalesce(F.col("id") != F.col("last"), F.col("last").isNotNull())
    return joined.select("id", "url", "payload", F.when(revisits, F.col("last")).alias("refers_to"), revisits.alias("revisit"))


def write_archives(
    pages: DataFrame,
    path: str,
    id_col: str = "page_id",
    url_col: str = "url",
    payload_col: str = "html",
    least_bytes: int = 0,
    date: str = "2024-01-01T00:00:00Z",
    archive_bytes: int = ARCHIVE_BYTES,
) -> DataFrame:
    """Write one record per row below `path` (a folder that all machines share) and return the manifest.

    Payloads of at least `least_bytes` bytes are deduplicated.
    """
    rows = with_responses(pages, id_col, url_col, payload_col, least_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = fs.FileSystem.from_uri(path)
        store.create_dir(folder, recursive=True)
        archive, done = None, []
        name = lambda i: "urn:page:" + ("" if i is None else str(i))
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                for i, url, payload, refers, revisit in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    if archive is None:
                        archive = Archive(store, f"{folder}/part-{uuid.uuid4().hex}.warc.zst")
                    archive.add(record(name(i), url, payload, date, name(refers) if revisit else None))
                    if archive.bytes > archive_bytes:
                        done.append(archive.close())
                        archive = None
        if archive is not None:
            done.append(archive.close())
        yield pa.RecordBatch.from_pylist(done, schema=pa.schema([("archive", pa.string()), ("records", pa.int64()), ("bytes", pa.int64()), ("dictionary_bytes", pa.int64())]))

    return stored(rows.mapInArrow(run, MANIFEST), "warc-manifest")


RECORDS = "page_id string, url string, record_type string, payload_bytes long, payload_digest string, refers_to string, payload binary"


def read_archives(spark: SparkSession, manifest: DataFrame, path: str, with_payload: bool = True) -> DataFrame:
    """The records of the archives that the manifest names; `payload` is null for revisits.

    Archives are dealt out to as many tasks, and each is read as a stream; digest and length of
    every response are checked against its payload.
    """
    n_archives = manifest.count()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(path)
        bare = lambda x: None if x in (None, "<urn:page:>") else x[len("<urn:page:") : -1]
        schema = pa.schema([(n, {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[t]) for n, t in (x.split(" ") for x in RECORDS.split(", "))])
        for batch in batches:
            for archive in batch.column(0).to_pylist():
                rows, held = [], 0
                with store.open_input_stream(archive, compression=None) as source:
                    for raw in frames(source):
                        fields, http, payload = parse(raw)
                        kind, digest, size = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:"), int(http["Content-Length"])
                        if kind == "response" and (len(payload) != size or payload_digest(payload) != digest):
                            raise ValueError(f"{archive}: {fields['WARC-Record-ID']} does not match its digest")
                        url = fields.get("WARC-Target-URI")
                        rows.append(
                            {
                                "page_id": bare(fields["WARC-Record-ID"]),
                                "url": url,
                                "record_type": kind,
                                "payload_bytes": size,
                                "payload_digest": digest,
                                "refers_to": bare(fields.get("WARC-Refers-To")),
                                "payload": payload if with_payload and kind == "response" else None,
                            }
                        )
                        held += len(raw)
                        if held > 8 << 20 or len(rows) >= 5000:
                            yield pa.RecordBatch.from_pylist(rows, schema=schema)
                            rows, held = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return manifest.select("archive").repartition(max(1, n_archives)).mapInArrow(run, RECORDS)

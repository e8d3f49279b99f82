"""WARC archives with a Zstandard dictionary (.warc.zst).

An archive starts with a skippable frame (magic 0x184D2A5D) that holds the dictionary; then
every record is a Zstandard frame of its own, compressed with it, so any record can be read
alone.  The dictionary is built from records of the archive itself: as many, evenly spaced, as
make up ``DICT_SOURCES`` times its size.

Equal payloads of ``min_revisit`` bytes or more are archived once: the record with the least
page_id is the response, others are revisits that name it.

Archives are written by tasks into the shared folder under names no other attempt uses; the
manifest, a table that Spark commits, lists those that count.  A task that is run again or
twice leaves files that no manifest names.  Reading goes by the manifest, archive by archive,
frame by frame.

Defined results: a null html is an empty payload, a null url leaves the target out; a null
page_id is kept as null and is a response only where no other id has the payload; rows with the
same page_id and payload have the same record type; an empty table gives archives without
records and an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import new_path, stored

DICT_BYTES = 32 << 10
DICT_SOURCES = 60
ARCHIVE_BYTES = 64 << 20
LEVEL = 3
MIN_REVISIT = 100
SKIPPABLE = 0x184D2A5D
_ZSTD_MAGIC = b"\x28\xb5\x2f\xfd"
_DATE = "1970-01-01T00:00:00Z"
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


def _record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'page:{page_id}:{digest}')}>"


def _clean(value: str) -> str:
    """A header value on one line: control characters and white space percent-encoded."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A response record, or a revisit record if ``refers_to`` names another page."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_record_id(page_id, digest)}", f"WARC-Date: {_DATE}",
        f"WARC-Page-ID: {'' if page_id is None else page_id}", f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response",
    ]
    if url is not None:
        head.append(f"WARC-Target-URI: {_clean(url)}")
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_record_id(refers_to, digest)}", f"WARC-Refers-To-Page-ID: {refers_to}"]
        payload = b""
    head.append(f"Content-Length: {len(http) + len(payload)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + http + payload + b"\r\n\r\n"


def build_dictionary(records: list[bytes], size: int = DICT_BYTES) -> bytes:
    """A trained dictionary; from few or tiny records, their text itself."""
    total, step = sum(map(len, records)), 1
    while total / step > size * DICT_SOURCES:
        step += 1
    chosen = records[::step]
    if len(chosen) >= 16 and total > 8 * size:
        try:
            return zstandard.train_dictionary(size, chosen, k=256, d=8, steps=1).as_bytes()
        except zstandard.ZstdError:
            pass
    return b"".join(chosen)[-size:]


def _dictionary(raw: bytes) -> zstandard.ZstdCompressionDict:
    trained = raw[:4] == b"\x37\xa4\x30\xec"
    return zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_FULLDICT if trained else zstandard.DICT_TYPE_RAWCONTENT)


def archive_bytes(records: list[bytes], level: int = LEVEL) -> Iterator[bytes]:
    """The parts of an archive: dictionary frame, then a frame for each record."""
    raw = build_dictionary(records)
    yield SKIPPABLE.to_bytes(4, "little") + len(raw).to_bytes(4, "little") + raw
    compressor = zstandard.ZstdCompressor(level=level, dict_data=_dictionary(raw) if raw else None, write_content_size=True)
    for r in records:
        yield compressor.compress(r)


def _open(path: str):
    fs, inner = pyarrow.fs.FileSystem.from_uri(path)
    return fs, inner


def _writer(folder: str, archive_limit: int):
    def write(rows: list[bytes]) -> pa.RecordBatch:
        name = f"{folder}/{uuid.uuid4().hex}.warc.zst"
        fs, inner = _open(name)
        with fs.open_output_stream(inner, compression=None) as out:
            for part in archive_bytes(rows):
                out.write(part)
        return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(rows)], pa.int64())], ["archive", "n_records"])

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, inner = _open(folder)
        fs.create_dir(inner, recursive=True)
        rows: list[bytes] = []
        used = 0
        for batch in batches:
            for page_id, url, payload, digest, refers_to in zip(*(batch.column(i) for i in range(5)), strict=True):
                r = record(page_id.as_py(), url.as_py(), payload.as_py(), digest.as_py(), refers_to.as_py())
                rows.append(r)
                used += len(r)
                if used >= archive_limit:
                    yield write(rows)
                    rows, used = [], 0
        if rows:
            yield write(rows)

    return go


def with_revisits(pages: DataFrame, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """page_id, url, payload, digest and refers_to (null for responses)."""
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
        F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8").alias("payload"),
    ).withColumn("digest", F.sha2("payload", 256))
    # digests that several ids have; written, so that the join sees two plain exchanges and may split a hot digest
    ids = rows.where(F.octet_length("payload") >= min_revisit).select("digest", "page_id")
    shared = ids.groupBy("digest").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last"), F.count("*").alias("n"))
    shared = stored(shared.where("n > 1 and first is not null").select("digest", "first"), "digests")
    joined = rows.join(shared, "digest", "left")
    refers_to = F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    return joined.select("page_id", "url", "payload", "digest", refers_to.alias("refers_to"))


def write(pages: DataFrame, folder: str | None = None, archive_limit: int = ARCHIVE_BYTES, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """Write ``pages`` (page_id, url, html) as archives; returns the manifest (archive, n_records)."""
    folder = folder or new_path(pages.sparkSession, "warc")
    return stored(with_revisits(pages, min_revisit).mapInArrow(_writer(folder, archive_limit), "archive string, n_records long"), "manifest")


def read_frames(stream) -> Iterator[bytes]:
    """Records of an archive, one at a time."""
    head = stream.read(8)
    raw = stream.read(int.from_bytes(head[4:], "little")) if int.from_bytes(head[:4], "little") == SKIPPABLE else b""
    reader = zstandard.ZstdDecompressor(dict_data=_dictionary(raw) if raw else None)
    rest = b"" if raw or head[:4] != _ZSTD_MAGIC else head
    while True:
        frame = reader.decompressobj()
        parts = []
        while not frame.eof:
            rest = rest or stream.read(1 << 20)
            if not rest:
                if parts:
                    raise ValueError("archive ends within a record")
                return
            parts.append(frame.decompress(rest))
            rest = frame.unused_data if frame.eof else b""
        yield b"".join(parts)


def parse_record(data: bytes) -> dict:
    """Headers (lower-case names), HTTP headers and payload of a record."""
    head, _, block = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    headers = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    block = block[: int(headers["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return {"headers": headers, "http": {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in http.decode("latin-1").split("\r\n")[1:])}, "payload": payload}


_RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary"


def _reader(with_payload: bool):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = lambda s: int(s) if s else None
        for batch in batches:
            for path in batch.column(0).to_pylist():
                fs, inner = _open(path)
                rows: list[tuple] = []
                with fs.open_input_stream(inner, compression=None) as stream:
                    for data in read_frames(stream):
                        r = parse_record(data)
                        h, kind = r["headers"], r["headers"]["warc-type"]
                        digest = h["warc-payload-digest"].removeprefix("sha256:")
                        if kind == "response" and hashlib.sha256(r["payload"]).hexdigest() != digest:
                            raise ValueError(f"payload of {h['warc-record-id']} in {path} is not what its digest says")
                        rows.append((number(h["warc-page-id"]), int(r["http"]["content-length"]), digest, kind, number(h.get("warc-refers-to-page-id")), h.get("warc-target-uri"), r["payload"] if with_payload else None))
                        if len(rows) >= 2000:
                            yield _batch(rows)
                            rows = []
                if rows:
                    yield _batch(rows)

    return go


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], [c.split()[0] for c in _RECORDS.split(", ")])


def read(spark: SparkSession, manifest: DataFrame, with_payload: bool = True) -> DataFrame:
    """A row for each record of the archives a manifest lists, payload digests verified."""
    rows = manifest.select("archive").repartition(max(1, spark.sparkContext.defaultParallelism * 2)).mapInArrow(_reader(with_payload), _RECORDS)
    return rows if with_payload else rows.drop("payload")

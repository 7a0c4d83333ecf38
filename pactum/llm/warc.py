"""WARC archives in Zstandard: one frame a record, dictionary in a leading skippable frame.

Writing: each task turns its rows into archives of bounded size in the shared folder,
under names of their own, and returns their names and record counts. Spark keeps these
of one attempt a task only, and reading follows this list, so what a lost or repeated
attempt left in the folder is never read. Reading: a task decodes an archive frame by
frame and checks version, headers, lengths and digests of each record, and their
number. Archives of others are read from a folder (``binaryFile``) by the same steps.
"""

from __future__ import annotations

import hashlib
import posixpath
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_path, stored

DICTIONARY_MAGIC, FRAME_MAGIC = 0x184D2A5D, 0xFD2FB528
#: Uncompressed bytes after which a task starts its next archive.
ARCHIVE_BYTES = 32 << 20
#: The first records of an archive, bounded in number and bytes, train its dictionary.
SAMPLE_RECORDS, SAMPLE_BYTES, DICTIONARY_BYTES = 200, 2 << 20, 32 << 10
#: Payloads shorter than this are always written whole.
REVISIT_FROM = 100
DATE = "2020-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
REQUIRED = ("WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length")


def record(page_id, url, payload: bytes, refers_to) -> bytes:
    """One WARC/1.1 record. A revisit holds the HTTP header, and the digest and length of
    the payload it leaves out; a null id or URL leaves out its header field."""
    kind = "response" if refers_to is None else "revisit"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    fields = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"), ("WARC-Date", DATE), ("Content-Type", "application/http; msgtype=response")]
    if url is not None:
        fields.append(("WARC-Target-URI", " ".join(url.split())))
    fields.append(("WARC-Payload-Digest", f"sha256:{hashlib.sha256(payload).hexdigest()}"))
    if refers_to is not None:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
    fields.append(("Content-Length", str(len(block))))
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode("utf-8", "surrogatepass") + b"\r\n" + block + b"\r\n\r\n"


def _dictionary(records: list[bytes]) -> zstandard.ZstdCompressionDict:
    samples, size = [], 0
    for r in records[:SAMPLE_RECORDS]:
        samples.append(r[: max(0, SAMPLE_BYTES - size)])
        size += len(samples[-1])
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, k=200, d=8, steps=1, split_point=1.0)
    except zstandard.ZstdError:  # too few or too short: their plain bytes serve as the dictionary
        return zstandard.ZstdCompressionDict(b"".join(samples)[:DICTIONARY_BYTES], dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def archive(records: list[bytes]) -> bytes:
    d = _dictionary(records)
    packed = zstandard.ZstdCompressor(level=9).compress(d.as_bytes())
    c = zstandard.ZstdCompressor(level=3, dict_data=d, write_checksum=True)
    return b"".join([struct.pack("<II", DICTIONARY_MAGIC, len(packed)), packed, *map(c.compress, records)])


def frames(content: bytes) -> Iterator[bytes]:
    """The decoded frames of an archive; raises ValueError on what is no such archive."""
    if len(content) < 8:
        raise ValueError("no dictionary frame")
    magic, size = struct.unpack_from("<II", content)
    if magic != DICTIONARY_MAGIC or len(content) < 8 + size:
        raise ValueError("no dictionary frame")
    raw = content[8 : 8 + size]
    if raw[:4] == struct.pack("<I", FRAME_MAGIC):
        raw = zstandard.ZstdDecompressor().decompress(raw)
    d = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw))
    at, view = 8 + size, memoryview(content)
    while at < len(content):
        one, parts = d.decompressobj(), []
        while not one.eof:
            if at >= len(content):
                raise ValueError("cut frame")
            piece = view[at : at + (1 << 16)]
            parts.append(one.decompress(piece))
            at += len(piece) - len(one.unused_data)
        yield b"".join(parts)


def parse(data: bytes) -> dict:
    """Header fields and payload of a record, validated."""
    head, found, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not found or lines[0] != "WARC/1.1":
        raise ValueError("no WARC/1.1 header")
    fields: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon or name in fields:
            raise ValueError(f"bad or repeated field {name!r}")
        fields[name] = value.strip()
    if missing := [k for k in REQUIRED if k not in fields]:
        raise ValueError(f"missing {missing}")
    length = int(fields["Content-Length"])
    if len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
        raise ValueError("block length differs from Content-Length")
    http, found, payload = rest[:length].partition(b"\r\n\r\n")
    sizes = [int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")]
    if not found or len(sizes) != 1:
        raise ValueError("no HTTP header")
    digest = fields.get("WARC-Payload-Digest", "").removeprefix("sha256:")
    if fields["WARC-Type"] == "response" and (len(payload) != sizes[0] or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError("payload differs from its length or digest")
    if fields["WARC-Type"] == "revisit" and (payload or "WARC-Refers-To" not in fields):
        raise ValueError("revisit with a payload or without a target")
    return fields | {"payload": payload, "bytes": sizes[0], "digest": digest}


def plan_revisits(pages: DataFrame) -> DataFrame:
    """``pages`` (page_id, url, html) with ``refers_to``: the smallest page_id with an equal
    payload of at least REVISIT_FROM bytes, null for that page itself and short payloads.
    Only ids and digests are grouped; the pages join the few rows that are revisits."""
    payload = F.coalesce("html", F.lit("")).cast("binary")
    slim = pages.filter(F.col("page_id").isNotNull()).select("page_id", F.sha2(payload, 256).alias("d"), F.length(payload).alias("n")).filter(F.col("n") >= REVISIT_FROM)
    first = slim.groupBy("d", "n").agg(F.min("page_id").alias("refers_to"))
    revisits = slim.join(first, ["d", "n"]).filter("page_id != refers_to").select("page_id", "d", "refers_to").distinct()
    return pages.withColumn("d", F.sha2(payload, 256)).join(revisits, ["page_id", "d"], "left").select("page_id", "url", "html", "refers_to")


def write(pages: DataFrame, directory: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes archives of (page_id, url, html, refers_to) and returns (path, records)."""

    def run(batches):
        fs, base = pafs.FileSystem.from_uri(directory)
        held, size = [], 0

        def flush():
            name = f"{uuid.uuid4().hex}.warc.zst"
            with fs.open_output_stream(posixpath.join(base, name), compression=None) as f:
                f.write(archive(held))
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(held)], pa.int64())], ["path", "records"])

        for batch in batches:
            for row in batch.to_pylist():
                held.append(record(row["page_id"], row["url"], (row["html"] or "").encode("utf-8", "surrogatepass"), row["refers_to"]))
                size += len(held[-1])
                if size >= archive_bytes:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    fs, base = pafs.FileSystem.from_uri(directory)
    fs.create_dir(base, recursive=True)
    return pages.select("page_id", "url", "html", "refers_to").mapInArrow(run, "path string, records long")


NAMES = ["page_id", "url", "record_type", "refers_to", "payload", "payload_bytes", "payload_digest", "error"]
TYPES = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.int64(), pa.string(), pa.string()]
SCHEMA = "page_id long, url string, record_type string, refers_to long, payload binary, payload_bytes long, payload_digest string, error string"


def _rows(content: bytes, expected: int | None = None) -> Iterator[tuple]:
    """The records of an archive as rows, errors too; ``expected`` is how many there must be."""
    number = lambda x: int(x.removeprefix("<urn:page:").removesuffix(">") or -1) if x else None
    n = 0
    try:
        for data in frames(content):
            n += 1
            try:
                r = parse(data)
                own = None if r["WARC-Record-ID"] == "<urn:page:>" else number(r["WARC-Record-ID"])
                yield own, r.get("WARC-Target-URI"), r["WARC-Type"], number(r.get("WARC-Refers-To")), r["payload"] if r["WARC-Type"] == "response" else None, r["bytes"], r["digest"], None
            except ValueError as e:
                yield (*[None] * 7, str(e))
        if expected is not None and n != expected:
            yield (*[None] * 7, f"{n} records instead of {expected}")
    except (ValueError, zstandard.ZstdError) as e:
        yield (*[None] * 7, str(e))


def _batches(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    """Rows in batches of bounded size."""
    out = lambda held: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), TYPES, strict=True)], NAMES)
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[4] or b"")
        if size > 4 << 20 or len(held) >= 5000:
            yield out(held)
            held, size = [], 0
    if held:
        yield out(held)


def read(spark: SparkSession, directory: str) -> DataFrame:
    """One row a record of the archives in ``directory``: page_id, url, record_type, refers_to,
    payload (null for revisits), payload_bytes, payload_digest, error. A record that
    fails validation has its error there; an archive cut short ends in an error row."""

    def run(batches):
        for batch in batches:
            for content in batch.column(0):
                yield from _batches(_rows(content.as_py()))

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(directory).select("content")
    return files.mapInArrow(run, SCHEMA)


def read_written(manifest: DataFrame, directory: str) -> DataFrame:
    """``read`` of the archives that ``write`` returned, and of no other; an archive whose records
    are not as many as were written ends in an error row."""

    def run(batches):
        fs, base = pafs.FileSystem.from_uri(directory)
        for batch in batches:
            for path, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with fs.open_input_stream(posixpath.join(base, path), compression=None) as f:
                    yield from _batches(_rows(f.read(), n))

    # The list is a small table, dealt out so that a task decodes about two archives.
    dealt = manifest.select("path", "records").repartition(max(1, -(-manifest.count() // 2)))
    return dealt.mapInArrow(run, SCHEMA)


def archive_round_trip(pages: DataFrame) -> DataFrame:
    """Writes ``pages`` to archives in shared storage and returns what reading them gives.

    Null html is an empty payload. Rows that repeat id and payload are each a record of
    the same kind. An empty table gives an empty result. Extra columns are ignored.
    """
    directory = shared_path(pages.sparkSession, "warc")
    written = write(plan_revisits(pages.select("page_id", "url", "html")), directory)
    return read_written(stored(written, "warc-manifest"), directory)


def page_digests(pages: DataFrame) -> DataFrame:
    """The digest columns of each page; a record that fails validation fails the query."""
    checked = F.when(F.col("error").isNotNull(), F.raise_error(F.col("error")).cast("string")).otherwise(F.col("record_type"))
    return archive_round_trip(pages).select("page_id", "payload_bytes", "payload_digest", checked.alias("record_type"), "refers_to")

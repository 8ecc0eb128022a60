"""WARC archives: writing, monolithic gzip normalisation, and reading by sidecar index.

Pages become records with revisit deduplication by payload digest: of records with equal payloads
the largest page_id is a response and the others revisit it. Tasks write archives as one gzip
stream each. The normaliser inflates such a stream once, in bounded pieces, rewrites every record
as a gzip member of its own and writes the members' offsets to a sidecar index; records are then
read back member by member.

A null payload is empty; a null url is written as an empty target. Repeated rows of one page_id
get equal record types: among equal payloads those with the largest id are all responses. Null
page_ids never become the response of a group that has an id. Empty tables write empty archives.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import Scratch, column, delete_path
from ._files import open_read, open_write

#: Payloads shorter than this are never revisits.
MIN_REVISIT_BYTES = 0
PIECE = 1 << 20
LEVEL_ROUGH, LEVEL_FINAL = 1, 6
_DATE = "1970-01-01T00:00:00Z"


def record_bytes(page_id: int | None, url: str, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record; a revisit has headers only."""
    kind = "response" if refers_to is None else "revisit"
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {_DATE}", f"WARC-Target-URI: {url}", f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
    ]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + (payload if refers_to is None else b"")
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def split_records(pieces: Iterator[bytes]) -> Iterator[bytes]:
    """Whole records from inflated pieces of any size, holding one record at a time."""
    held, need = bytearray(), 0
    for piece in pieces:
        held += piece
        while len(held) >= need:
            end = held.find(b"\r\n\r\n")
            if end < 0:
                break
            length = next(int(line[15:]) for line in bytes(held[:end]).split(b"\r\n") if line[:15].lower() == b"content-length:")
            need = end + 4 + length + 4
            if len(held) < need:
                break
            yield bytes(held[:need])
            del held[:need]
            need = 0
    if held:
        raise ValueError("archive ends inside a record")


def inflate(file) -> Iterator[bytes]:
    """Content of a gzip file of one or more members, in pieces of at most PIECE bytes."""
    inflater = zlib.decompressobj(31)
    data = file.read(PIECE)
    while data:
        out = inflater.decompress(data, PIECE)
        if out:
            yield out
        data = inflater.unconsumed_tail
        if inflater.eof:
            data = inflater.unused_data or file.read(PIECE)
            if data:
                inflater = zlib.decompressobj(31)
        elif not data:
            data = file.read(PIECE)
    tail = inflater.flush()
    if tail:
        yield tail
    if not inflater.eof:
        raise ValueError("gzip stream is cut short")


def parse_record(record: bytes) -> dict:
    """Header fields in lower case, and the payload under ``payload``."""
    head, _, block = record.partition(b"\r\n\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in head.decode().split("\r\n")[1:])}
    fields["payload"] = block[:-4].partition(b"\r\n\r\n")[2]
    return fields


def _write_rough(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    """Write one whole-file gzip stream for the task; a row with its path and record count."""
    path, n, out = f"{folder}/rough-{TaskContext.get().partitionId():06d}.warc.gz", 0, None
    deflater = zlib.compressobj(LEVEL_ROUGH, wbits=31)
    for batch in batches:
        for page_id, url, html, refers_to in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
            out = out or open_write(path)
            payload = (html or "").encode()
            digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
            out.write(deflater.compress(record_bytes(page_id, (url or "").replace("\r", "%0D").replace("\n", "%0A"), payload, digest, refers_to)))
            n += 1
    if out is not None:
        out.write(deflater.flush())
        out.close()
        yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([n], pa.int64())], ["path", "n"])


def _normalise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rough archive -> archive of one member per record; yields the sidecar index."""
    names = ["path", "offset", "length", "record_id", "record_type", "digest"]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
    for batch in batches:
        for rough in batch.column(0).to_pylist():
            head, _, name = rough.rpartition("/")
            path = f"{head}/records-{name.removeprefix('rough-')}"
            rows: list[tuple] = []
            offset = 0
            with open_read(rough) as source, open_write(path) as out:
                for record in split_records(inflate(source)):
                    deflater = zlib.compressobj(LEVEL_FINAL, wbits=31)
                    member = deflater.compress(record) + deflater.flush()
                    out.write(member)
                    fields = parse_record(record)
                    rows.append((path, offset, len(member), fields["warc-record-id"], fields["warc-type"], fields["warc-payload-digest"]))
                    offset += len(member)
                    if len(rows) == 4096:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                        rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def normalise_gzip(archives: DataFrame) -> DataFrame:
    """Rewrite whole-file gzip WARC files (column ``path``) with one member per record, beside them.

    Returns the sidecar index: path, offset, length, record_id, record_type, digest. Memory holds one
    record; a file that is cut short raises an error. The sources stay, so a task can run again.
    """
    return archives.select("path").mapInArrow(_normalise, "path string, offset long, length long, record_id string, record_type string, digest string")


def _page(value: str | None) -> int | None:
    number = (value or "").removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


def _read_members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["page_id", "url", "record_type", "payload_digest", "refers_to", "own_bytes", "payload"]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary()]
    for batch in batches:
        file, current = None, None
        spots = list(zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True))
        for low in range(0, len(spots), 256):
            rows = []
            for path, offset, length in spots[low : low + 256]:
                if path != current:
                    if file is not None:
                        file.close()
                    file, current = open_read(path), path
                file.seek(offset)
                f = parse_record(zlib.decompress(file.read(length), 31))
                revisit = f["warc-type"] == "revisit"
                rows.append((_page(f["warc-record-id"]), f["warc-target-uri"], f["warc-type"], f["warc-payload-digest"].removeprefix("sha1:"), _page(f.get("warc-refers-to")), None if revisit else len(f["payload"]), None if revisit else f["payload"]))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
        if file is not None:
            file.close()


def read_records(index: DataFrame) -> DataFrame:
    """Records at the places of ``index``: page_id, url, record_type, payload_digest, refers_to, own_bytes, payload."""
    return index.select("path", "offset", "length").mapInArrow(_read_members, "page_id long, url string, record_type string, payload_digest string, refers_to long, own_bytes long, payload binary")


def write_archives(pages: DataFrame, folder: str, *, min_revisit_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """Write ``pages`` as whole-file gzip WARC archives in the shared ``folder``: path, n."""
    rows = pages.select(column(pages, "page_id", "bigint").alias("page_id"), column(pages, "url", "string").alias("url"), column(pages, "html", "string").alias("html"))
    rows = rows.withColumn("digest", F.sha1(F.coalesce("html", F.lit(""))))
    long_enough = F.octet_length(F.coalesce("html", F.lit(""))) >= min_revisit_bytes
    copies = rows.filter(long_enough).groupBy("digest").agg(F.max("page_id").alias("last"), F.count("*").alias("n")).filter("n > 1").select("digest", "last")
    rows = rows.join(copies, "digest", "left")
    refers_to = F.when(long_enough & ~F.col("page_id").eqNullSafe(F.col("last")), F.col("last"))
    return rows.select("page_id", "url", "html", refers_to.alias("refers_to")).mapInArrow(lambda it: _write_rough(it, folder), "path string, n long")


def archive_round_trip(pages: DataFrame, folder: str | None = None, *, min_revisit_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """Write, normalise, read back; one row per page: page_id, payload_bytes, payload_digest, record_type, refers_to.

    The payload size of a revisit comes from the response it refers to, as read from the archive.
    """
    scratch = Scratch(pages.sparkSession, "warc")
    folder = folder or scratch.path("archives")
    rough = scratch.table(write_archives(pages, folder, min_revisit_bytes=min_revisit_bytes), "rough")
    n = max(1, rough.count())
    index = scratch.table(normalise_gzip(rough.repartition(n, "path")), "index")
    for row in rough.select("path").toLocalIterator():  # a row per writing task
        delete_path(pages.sparkSession, row["path"])
    # A record's digest is taken anew from the payload that was read.
    read = read_records(index).withColumn("digest_read", F.sha1("payload")).drop("payload", "url")
    read = scratch.table(read, "read")
    sizes = read.filter("record_type = 'response'").groupBy(F.col("page_id").alias("refers_to"), "payload_digest").agg(F.min("own_bytes").alias("their_bytes"))
    out = read.join(sizes, ["refers_to", "payload_digest"], "left")
    return out.select("page_id", F.coalesce("own_bytes", "their_bytes").alias("payload_bytes"), "payload_digest", "record_type", "refers_to", F.col("digest_read").alias("payload_sha1"))

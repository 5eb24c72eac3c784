"""WARC archives: writing, and normalising whole-file gzip streams into one member a record.

An archive is a row (archive, content) of a Spark table, so Spark's commit decides which
attempt of a task counts and any store that Spark writes will do; ``export`` copies them
to files.  Archives close after ``ARCHIVE_BYTES`` of records, headers included, which bounds
a task's memory by that and by the longest record.
"""

from __future__ import annotations

import hashlib
import io
import zlib
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, materialise

ARCHIVE_BYTES = 8 << 20
#: Payloads from this size on are stored once; records with equal ones refer to it.
REVISIT_BYTES = 1000
LEVEL = 4
_READ = 1 << 16
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record_id(page_id) -> str:
    return f"<urn:x-page:{page_id}>" if page_id is not None else "<urn:x-page:none>"


def _head(pairs: Iterable[tuple[str, object]]) -> bytes:
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in pairs) + "\r\n").encode()


def response_record(page_id, url: str | None, payload: bytes, digest: str | None = None) -> bytes:
    """A response record; line ends in the URL are written as %0D and %0A."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    target = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    digest = digest or hashlib.sha1(payload).hexdigest()
    head = [("WARC-Type", "response"), ("WARC-Record-ID", record_id(page_id)), ("WARC-Date", "2024-01-01T00:00:00Z"), ("WARC-Target-URI", target)]
    head += [("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Payload-Length", len(payload)), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", len(http) + len(payload))]
    return _head(head) + http + payload + b"\r\n\r\n"


def revisit_record(record: bytes, refers_to: int) -> bytes:
    """The revisit record for a response record: its headers, without the payload."""
    fields, body = split_record(record)
    http = body[: body.index(b"\r\n\r\n") + 4]
    fields |= {"WARC-Type": "revisit", "WARC-Profile": _PROFILE, "WARC-Refers-To": record_id(refers_to), "Content-Length": str(len(http))}
    return _head(fields.items()) + http + b"\r\n\r\n"


def split_record(record: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and block of one record."""
    end = record.index(b"\r\n\r\n")
    lines = record[:end].decode().split("\r\n")[1:]
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines)
    return fields, record[end + 4 : end + 4 + int(fields["Content-Length"])]


def inflate(source) -> Iterator[bytes]:
    """Inflated pieces of a gzip stream of one or more members, read once from front to end."""
    z = zlib.decompressobj(31)
    while data := source.read(_READ):
        while data:
            if piece := z.decompress(data):
                yield piece
            data = z.unused_data
            if z.eof:
                z = zlib.decompressobj(31)
            else:
                break
    if tail := z.flush():
        yield tail


def records(source) -> Iterator[bytes]:
    """The records of a gzip stream, one in memory at a time."""
    held, pieces = bytearray(), inflate(source)

    def fill() -> bool:
        piece = next(pieces, None)
        if piece is not None:
            held.extend(piece)
        return piece is not None

    while True:
        while (end := held.find(b"\r\n\r\n")) < 0:
            if not fill():
                if held.strip():
                    raise ValueError("an archive ends inside a record's header")
                return
        length = next(int(line.split(b":", 1)[1]) for line in bytes(held[:end]).split(b"\r\n") if line.lower().startswith(b"content-length:"))
        need = end + 4 + length + 4
        while len(held) < need:
            if not fill():
                raise ValueError("an archive ends inside a record's block")
        yield bytes(held[:need])
        del held[:need]


def normalise(source, revisits: dict[int, int], sink) -> list[tuple[int, int, int]]:
    """Rewrite every record of ``source`` as a gzip member of its own in ``sink``.

    ``revisits`` maps record numbers to the page that holds their payload.  Returns the
    sidecar index: (record number, offset, length) of each member.
    """
    index, at = [], 0
    for number, record in enumerate(records(source)):
        if number in revisits:
            record = revisit_record(record, revisits[number])
        z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
        member = z.compress(record) + z.flush()
        sink.write(member)
        index.append((number, at, len(member)))
        at += len(member)
    return index


_ITEMS = pa.list_(pa.struct([("page_id", pa.int64()), ("bytes", pa.int64()), ("digest", pa.string())]))


def write_monolithic(pages: DataFrame) -> DataFrame:
    """One gzip stream an archive; ``items`` lists its records' page, size and digest."""

    def run(batches):
        part, seq = TaskContext.get().partitionId(), 0
        z, out, items, size = zlib.compressobj(LEVEL, zlib.DEFLATED, 31), io.BytesIO(), [], 0

        def close():
            out.write(z.flush())
            return pa.RecordBatch.from_arrays([pa.array([f"{part:06d}-{seq:06d}"]), pa.array([out.getvalue()], pa.binary()), pa.array([items], _ITEMS)], ["archive", "content", "items"])

        for batch in batches:
            for page, url, html in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                payload = (html or "").encode("utf-8", "replace")
                digest = hashlib.sha1(payload).hexdigest()
                record = response_record(page, url, payload, digest)
                out.write(z.compress(record))
                items.append({"page_id": page, "bytes": len(payload), "digest": digest})
                size += len(record)
                if size >= ARCHIVE_BYTES:
                    yield close()
                    seq += 1
                    z, out, items, size = zlib.compressobj(LEVEL, zlib.DEFLATED, 31), io.BytesIO(), [], 0
        if items:
            yield close()

    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return rows.mapInArrow(run, "archive string, content binary, items array<struct<page_id:long,bytes:long,digest:string>>")


def revisits(archives: DataFrame) -> DataFrame:
    """(archive, number, refers_to) of the records that repeat another's payload.

    Of equal payloads of at least REVISIT_BYTES, rows with the largest page_id are responses;
    rows without a page_id are responses too.  The table of repeated digests is written out
    before it is joined, so both sides of the join are plain exchanges and a digest that
    holds a third of all records is split over tasks.
    """
    items = archives.select("archive", F.posexplode("items").alias("number", "i")).select("archive", "number", "i.*").filter(F.col("bytes") >= REVISIT_BYTES)
    top = items.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).filter("n > 1").drop("n")
    return items.join(materialise(top, "warc-repeated"), "digest").filter("page_id < refers_to").select("archive", "number", "refers_to")


def normalise_archives(archives: DataFrame, found: DataFrame) -> DataFrame:
    """Archives of one member a record, with their sidecar index."""
    lists = found.groupBy("archive").agg(F.collect_list(F.struct("number", "refers_to")).alias("found"))

    def run(frames):
        for pdf in frames:
            for archive, content, listed in zip(pdf["archive"], pdf["content"], pdf["found"], strict=True):
                sink = io.BytesIO()
                index = normalise(io.BytesIO(content), {} if listed is None else {x["number"]: x["refers_to"] for x in listed}, sink)
                yield pd.DataFrame({"archive": [archive], "content": [sink.getvalue()], "index": [[{"number": n, "offset": o, "length": x} for n, o, x in index]]})

    return archives.select("archive", "content").join(lists, "archive", "left").mapInPandas(run, "archive string, content binary, index array<struct<number:long,offset:long,length:long>>")


_READ_AS = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64()}


def read_members(archives: DataFrame) -> DataFrame:
    """Every record by its index entry: page, size, digest, type and the page referred to.

    The digest of a response is computed from the stored payload and must equal its header.
    Records are inflated one at a time; a record without a page has a null page_id, and an
    archive without records gives no rows.
    """

    def page_of(text: str | None):
        tail = (text or "").rstrip(">").rpartition(":")[2]
        return int(tail) if tail.lstrip("-").isdigit() else None

    def run(batches):
        for batch in batches:
            for content, index in zip(batch.column(0), batch.column(1), strict=True):
                content, out = content.as_py(), []
                for entry in index.as_py():
                    fields, block = split_record(zlib.decompress(content[entry["offset"] : entry["offset"] + entry["length"]], 31))
                    size, digest = int(fields["X-Payload-Length"]), fields["WARC-Payload-Digest"].partition(":")[2]
                    if fields["WARC-Type"] == "response":
                        payload = block[block.index(b"\r\n\r\n") + 4 :]
                        if len(payload) != size or hashlib.sha1(payload).hexdigest() != digest:
                            raise ValueError(f"record {fields['WARC-Record-ID']} is damaged")
                    out.append((page_of(fields["WARC-Record-ID"]), size, digest, fields["WARC-Type"], page_of(fields.get("WARC-Refers-To"))))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*out, strict=True), _READ_AS.values(), strict=True)], list(_READ_AS))

    return archives.select("content", "index").mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def export(archives: DataFrame, folder: str) -> DataFrame:
    """Copy archives and their sidecar indexes to ``folder`` (any address pyarrow knows)."""

    def run(frames):
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder)
        for pdf in frames:
            for archive, content, index in zip(pdf["archive"], pdf["content"], pdf["index"], strict=True):
                lines = "".join(f"{x['number']}\t{x['offset']}\t{x['length']}\n" for x in index)
                for name, data in ((f"{archive}.warc.gz", content), (f"{archive}.idx", lines.encode())):
                    with store.open_output_stream(f"{base}/{name}.part") as f:
                        f.write(data)
                    store.move(f"{base}/{name}.part", f"{base}/{name}")
                yield pd.DataFrame({"archive": [archive], "records": [len(index)]})

    return archives.mapInPandas(run, "archive string, records long")


def archive_pages(pages: DataFrame) -> DataFrame:
    """Write, find repeated payloads, normalise; returns the normalised archives.

    Every row is a record: a null html is an empty payload, a null url an empty target, a null
    page_id a record without a page, which is always a response.  Rows that repeat a page_id
    are records each; of equal payloads all rows with the largest page_id are responses.  A
    page of any length is one record, held whole with its archive in one task.  No pages
    give no archives; further columns are not read.
    """
    mono = materialise(write_monolithic(pages), "warc-monolithic", "none")
    out = materialise(normalise_archives(mono, revisits(mono)), "warc-members", "none")
    discard(mono)
    return out


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_members(archive_pages(spark.read.parquet(f"{sf_dir}/pages.parquet")))


OP2_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, sha1(b) AS payload_digest FROM p),
t AS (SELECT payload_digest, max(page_id) AS top FROM d WHERE payload_bytes >= 1000 GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id < top THEN top END AS refers_to FROM d LEFT JOIN t USING (payload_digest)
"""

"""WARC archives: writing pages, and normalising archives that are one gzip stream.

:func:`write_archives` writes response and revisit records into archives that are each a single gzip stream.
:func:`normalise` inflates such a file once, front to back, rewrites every record as a gzip member of its own and puts
a sidecar index beside it (one line a record: offset, length, record id). :func:`read_archives` reads normalised
archives through their index and checks every payload against its digest.

A response's block is an HTTP header and the payload; a revisit's block is that header alone, so Content-Length still
tells the full payload's size. Files are written under a name of the attempt and listed in a manifest table; only what
a committed task listed is ever read, so retried or lost tasks leave no wrong record.

Defined cases: a null html is an empty payload; null urls are left out; rows that repeat the smallest page_id of a
payload are all responses; a null page_id refers to the payload's smallest page_id if there is one, else is a response;
an empty table gives no archives and no rows; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, partitions, read_bytes, write_bytes

RECORD_URN = "urn:page:"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "archive string, records long"
NORMALISED = "archive string, index string, records long"
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_bytes(page_id, url, payload: bytes, refers_to, is_revisit: bool, date: str) -> bytes:
    name = lambda i: f"<{RECORD_URN}{'' if i is None else i}>"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if is_revisit else http + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if is_revisit else 'response'}",
        f"WARC-Record-ID: {name(page_id)}",
        f"WARC-Date: {date}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{payload_digest(payload)}",
    ]
    if url is not None:
        lines.append("WARC-Target-URI: " + "".join(c if c > " " else f"%{ord(c):02X}" for c in url))
    if is_revisit:
        lines += [f"WARC-Refers-To: {name(refers_to)}", f"WARC-Profile: {PROFILE}"]
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_headers(head: bytes) -> dict[str, str]:
    pairs = (line.split(":", 1) for line in head.decode("utf-8").split("\r\n")[1:] if ":" in line)
    return {k.strip().lower(): v.strip() for k, v in pairs}


def split_records(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """Whole records out of a stream of inflated bytes; holds one record and one chunk at a time."""
    held = bytearray()
    need = None
    for chunk in chunks:
        held += chunk
        while True:
            if need is None:
                end = held.find(b"\r\n\r\n")
                if end < 0:
                    break
                need = end + 4 + int(parse_headers(bytes(held[:end]))["content-length"]) + 4
            if len(held) < need:
                break
            yield bytes(held[:need])
            del held[:need]
            need = None
    if held.strip():
        raise ValueError("archive ends within a record")


def inflate(data: bytes, step: int = 1 << 20) -> Iterator[bytes]:
    """The inflated bytes of a gzip file, whether one stream or many members, in pieces."""
    at = 0
    while at < len(data):
        z = zlib.decompressobj(31)
        while not z.eof:
            fed = z.unconsumed_tail
            if not fed:
                if at >= len(data):
                    raise ValueError("gzip stream is cut short")
                fed = data[at : at + step]
                at += len(fed)
            out = z.decompress(fed, step)
            if out:
                yield out
        at -= len(z.unused_data)


def gzip_member(data: bytes, level: int) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def mark_revisits(pages: DataFrame, min_payload: int = 0) -> DataFrame:
    """pages with ``refers_to``: the smallest page_id of an equal payload where that is another page, else null.

    Payloads are compared by SHA-1 and size on narrow rows; a payload that very many pages share is summed up before
    the shuffle, and pages meet the outcome by page_id, so no shared payload gathers pages in one task.
    """
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    page = F.col("page_id").cast("long")
    narrow = pages.select(page.alias("page_id"), F.sha1(payload).alias("__sha"), F.octet_length(payload).alias("__n"))
    narrow = narrow.where(F.col("__n") >= min_payload)
    first = narrow.groupBy("__sha", "__n").agg(F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("__c")).where("__c > 1")
    later = (
        narrow.join(first.drop("__c"), ["__sha", "__n"])
        .where(F.col("refers_to").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("refers_to")))
        .select(F.col("page_id").alias("__p"), F.col("__sha").alias("__s"), "refers_to")
        .distinct()
    )
    marked = pages.select(page.alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("html"))
    on = F.col("page_id").eqNullSafe(F.col("__p")) & (F.sha1("html") == F.col("__s"))
    return marked.join(later, on, "left").drop("__p", "__s")


def write_archives(
    pages: DataFrame, ws: Workspace, min_payload: int = 0, archive_bytes: int = 64 << 20, date: str = "2024-01-01T00:00:00Z"
) -> DataFrame:
    """Archives of about ``archive_bytes`` payload, each one gzip stream; returns their manifest."""
    folder = ws.path("archives")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z, out, size, count, done = None, [], 0, 0, []

        def close():
            out.append(z.flush())
            uri = f"{folder}/pages-{uuid.uuid4().hex}.warc.gz"
            write_bytes(uri, b"".join(out))
            done.append((uri, count))

        for batch in batches:
            for row in batch.to_pylist():
                if z is None:
                    z, out, size, count = zlib.compressobj(1, zlib.DEFLATED, 31), [], 0, 0
                payload = row["html"].encode("utf-8")
                revisit = row["refers_to"] is not None
                out.append(z.compress(record_bytes(row["page_id"], row["url"], payload, row["refers_to"], revisit, date)))
                size, count = size + len(payload), count + 1
                if size >= archive_bytes:
                    close()
                    z = None
        if z is not None:
            close()
        yield pa.RecordBatch.from_pydict(
            {"archive": pa.array([x[0] for x in done], pa.string()), "records": pa.array([x[1] for x in done], pa.int64())}
        )

    return ws.save(mark_revisits(pages, min_payload).mapInArrow(write, MANIFEST), "manifest")


def normalise_file(data: bytes, level: int = 6) -> tuple[bytes, str, int]:
    """(archive with a member per record, index text, records) of one archive."""
    out, index, at, count = [], [], 0, 0
    for record in split_records(inflate(data)):
        member = gzip_member(record, level)
        head = parse_headers(record[: record.find(b"\r\n\r\n")])
        index.append(f"{at} {len(member)} {head['warc-record-id']}\n")
        out.append(member)
        at, count = at + len(member), count + 1
    return b"".join(out), "".join(index), count


def normalise(manifest: DataFrame, ws: Workspace, level: int = 6) -> DataFrame:
    """Rewrite the listed archives, one task each at a time; returns archive, index and record count of each."""
    folder = ws.path("normalised")

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for uri in batch["archive"]:
                data, index, count = normalise_file(read_bytes(uri), level)
                target = f"{folder}/{uuid.uuid4().hex}.warc.gz"
                write_bytes(target, data)
                write_bytes(target + ".idx", index.encode())
                rows.append((target, target + ".idx", count))
            yield pd.DataFrame(rows, columns=["archive", "index", "records"])

    spread = manifest.repartition(partitions(ws.spark), "archive")
    return ws.save(spread.mapInPandas(work, NORMALISED), "normalised-manifest")


def parse_record(record: bytes) -> tuple:
    end = record.find(b"\r\n\r\n")
    head = parse_headers(record[:end])
    block = record[end + 4 : end + 4 + int(head["content-length"])]
    cut = block.find(b"\r\n\r\n")
    size = int(parse_headers(block[:cut])["content-length"])
    digest = head["warc-payload-digest"].removeprefix("sha1:")
    number = lambda k: int(x) if (x := head[k].strip("<>").removeprefix(RECORD_URN)) else None
    if head["warc-type"] == "revisit":
        return number("warc-record-id"), size, digest, "revisit", number("warc-refers-to")
    payload = block[cut + 4 :]
    if len(payload) != size or payload_digest(payload) != digest:
        raise ValueError(f"payload of {head['warc-record-id']} does not match its digest")
    return number("warc-record-id"), size, digest, "response", None


def read_archives(normalised: DataFrame) -> DataFrame:
    """The records of normalised archives, each inflated by itself at the place its index gives."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, index, count in zip(*(batch[c].to_pylist() for c in ("archive", "index", "records")), strict=True):
                data, rows = read_bytes(uri), []
                for line in read_bytes(index).decode().splitlines():
                    at, length, _ = line.split(" ", 2)
                    rows.append(parse_record(zlib.decompress(data[int(at) : int(at) + int(length)], 31)))
                if len(rows) != count:
                    raise ValueError(f"{uri}: {len(rows)} records, {count} expected")
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
                names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
                columns = list(zip(*rows, strict=True)) or [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    spread = normalised.repartition(partitions(normalised.sparkSession), "archive")
    return spread.mapInArrow(work, RECORDS)


def archive_pages(pages: DataFrame, min_payload: int = 0) -> DataFrame:
    """Write, normalise and read back; one row per page."""
    ws = Workspace(pages.sparkSession, "warc")
    normalised = normalise(write_archives(pages, ws, min_payload), ws)
    return read_archives(normalised)

"""WARC archives: writing pages as records, and reading archives with segment reassembly.

Writing: one response record for a page, its payload in chunked transfer framing; a page whose payload of at least LEAST_SHARED bytes
also belongs to a page with a larger id becomes a revisit record of the largest one. Blocks of more than SEGMENT_BYTES are cut into
a first segment and continuation records, cut between characters. A part file of the text writer with the record terminator as line
separator is a WARC file, compressed as a whole, so that the archives lie in any store that Spark writes to.

Reading works on bytes and on archives of any origin (WARC/1.x). Spark's text source cuts the files at the word that begins a version
line; a record is as long as its Content-Length says, so that what was cut inside a block is put together again. Records of a file are
read as a stream, one at a time. Continuation records, of any file, are grouped by origin identifier and ordered by segment number,
their total length is checked, and the chunked framing is decoded. A record that fails a check is returned with complete = false.
Records of types other than response, revisit and resource are passed over. Uncompressed files are read in several splits, and a block
in which that word stands where a split begins comes out incomplete; compressed files are never split.

Null html is an empty payload, a null url leaves out the target. A null page id never becomes the record that others revisit.
Rows with the same id and payload are all kept; where they hold the largest id of a group, all of them are responses, and revisits name
its target but no record. Empty tables give empty results; texts of any length are segmented. Extra columns are ignored, whatever their
names.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import re
import uuid
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import SLICE_BYTES, scratch, sliced, text_or_empty, written

SEGMENT_BYTES = 65_536
CHUNK_BYTES = 8_192
LEAST_SHARED = 1_000

#: Fixed values of the format.
VERSION = "WARC/1.1"
BEGINS = "WARC/1."
END = "\r\n\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
PAYLOADS = ("response", "revisit", "resource")


def cut(data: bytes, size: int) -> Iterator[bytes]:
    """Pieces of at most ``size`` bytes (4 at least), cut between UTF-8 characters."""
    at = 0
    while at < len(data):
        end = min(at + max(size, 4), len(data))
        while end < len(data) and data[end] & 0xC0 == 0x80:
            end -= 1
        yield data[at:end]
        at = end


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    """Chunked transfer framing."""
    return b"".join(b"%x\r\n%b\r\n" % (len(c), c) for c in cut(payload, size)) + b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes:
    """The payload of chunked framing; ValueError if it is cut short or malformed."""
    out, at = [], 0
    while True:
        line = body.index(b"\r\n", at)
        size = int(body[at:line].split(b";")[0], 16)
        at = line + 2
        if size == 0:
            return b"".join(out)
        if len(body) < at + size + 2 or body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("a chunk is cut short")
        out.append(body[at : at + size])
        at += size + 2


def _head(fields: list[tuple[str, object]]) -> str:
    return "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None)


def _safe(value: str | None) -> str | None:
    """A header value on one line."""
    return None if value is None else re.sub(r"[\x00-\x20\x7F]", lambda m: f"%{ord(m[0]):02X}", value)


def _identity(page: str, digest: str) -> str:
    """The record id of the page that others of equal payload refer to."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{digest} {page}')}>"


def records(page: str | None, url: str | None, payload: bytes, owner: str | None, owner_url: str | None, named: bool, segment_bytes: int, date: str) -> Iterator[str]:
    """The WARC records of one page, each without its terminator. ``owner`` is the page of equal payload that stands for it, itself if
    there is none; ``named`` tells whether one record alone has the owner's id."""
    sha = hashlib.sha1(payload)
    first = owner is None or owner == page
    identity = _identity(page, sha.hexdigest()) if named and owner is not None and first else f"<urn:uuid:{uuid.uuid4()}>"
    target, http = _safe(url), "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    common: list[tuple[str, object]] = [("WARC-Date", date), ("WARC-Target-URI", target)]
    fields = [("WARC-Type", "response" if first else "revisit"), ("WARC-Record-ID", identity), *common, ("WARC-Payload-Digest", "sha1:" + base64.b32encode(sha.digest()).decode()), ("X-Page-ID", _safe(page))]
    if first:
        block = http.encode() + b"Transfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    else:
        fields += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", _identity(owner, sha.hexdigest()) if named else None), ("WARC-Refers-To-Target-URI", _safe(owner_url)), ("WARC-Refers-To-Date", date), ("X-Refers-To-Page", _safe(owner))]
        block = f"{http}Content-Length: {len(payload)}\r\n\r\n".encode()
    pieces = [*cut(block, segment_bytes)]
    if len(pieces) > 1:
        fields.append(("WARC-Segment-Number", 1))
    for number, piece in enumerate(pieces, 1):
        if number > 1:
            fields = [("WARC-Type", "continuation"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), *common, ("WARC-Segment-Origin-ID", identity), ("WARC-Segment-Number", number)]
            fields += [("WARC-Segment-Total-Length", len(block))] * (number == len(pieces))
        head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Type", "application/http; msgtype=response"), ("Content-Length", len(piece))] if v is not None)
        yield f"{VERSION}\r\n{head}\r\n{piece.decode()}"


def write_archives(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html", segment_bytes: int = SEGMENT_BYTES, date: str | None = None) -> None:
    """Write the pages as gzipped WARC files below ``path``, captured at ``date`` (by default now)."""
    date = date or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    rows = pages.select(F.col(page_id).alias("page"), F.col(url).cast("string").alias("url"), text_or_empty(html).alias("html"))
    sha = F.sha1(F.encode("html", "UTF-8"))
    long = F.octet_length("html") >= LEAST_SHARED
    each = rows.where(long).groupBy(sha.alias("digest"), "page").agg(F.count("*").alias("n"), F.max("url").alias("url"))
    shared = each.groupBy("digest").agg(F.max("page").alias("owner"), F.max_by("url", "page").alias("owner_url"), (F.max_by("n", "page") == 1).alias("named"), F.sum("n").alias("n"))
    # Written first: the join then sees the table's size, and both its sides can be split where a digest is hot.
    shared = written(shared.where((F.col("n") > 1) & F.col("owner").isNotNull()).drop("n"), "shared")
    joined = rows.withColumn("digest", F.when(long, sha)).join(shared, "digest", "left")
    joined = joined.select(F.col("page").cast("string").alias("page"), "url", "html", F.col("owner").cast("string").alias("owner"), "owner_url", "named")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 2):
            found = [x for r in batch.to_pylist() for x in records(r["page"], r["url"], r["html"].encode(), r["owner"], r["owner_url"], bool(r["named"]), segment_bytes, date)]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string())], names=["value"])

    joined.mapInArrow(run, "value string").write.option("lineSep", END).option("compression", "gzip").text(path)


def frames(pieces: Iterator[tuple[bytes, str]]) -> Iterator[bytes]:
    """Records, without the word that begins them, from what the files hold between such words, each piece with its file."""
    held: list[bytes] = []
    size, need, file = 0, None, None  # bytes held, bytes of the whole record (unknown until its head is there)
    for piece, of in pieces:
        if held and of == file and (need is None or size < need):
            held += [BEGINS.encode(), piece]
            size += len(BEGINS) + len(piece)
        else:
            if held:
                yield b"".join(held)
            held, size, need, file = [piece], len(piece), None, of
            if not re.match(rb"\d\r?\n", piece):  # what stands before a file's first record
                held = []
                continue
        if need is None:
            whole = b"".join(held)
            end = whole.find(END.encode())
            if end >= 0:
                length = re.search(rb"(?im)^content-length:[ \t]*(\d+)", whole[: end + 2])
                held, need = [whole], end + len(END) + (int(length[1]) if length else 0)
    if held:
        yield b"".join(held)


def _sha(field: str | None) -> str | None:
    """A digest of the header as lower-case hex, from base 32 or hex; null for other kinds of digest."""
    kind, _, value = (field or "").partition(":")
    if kind.lower() != "sha1":
        return None
    try:
        return value.lower() if len(value) == 40 else base64.b32decode(value.upper()).hex()
    except (binascii.Error, ValueError):
        return None


def parse(record: bytes) -> dict:
    """Header fields and block of one record."""
    head, _, block = record.partition(END.encode())
    fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n")[1:])}

    def number(name: str) -> int | None:
        return int(fields[name]) if fields.get(name, "").isdigit() else None

    length = number("content-length")
    return {
        "type": fields.get("warc-type"),
        "page": fields.get("x-page-id"),
        "refers_to": fields.get("x-refers-to-page"),
        "url": fields.get("warc-target-uri"),
        "digest": _sha(fields.get("warc-payload-digest")),
        "origin": fields.get("warc-segment-origin-id", fields.get("warc-record-id")),
        "segment": number("warc-segment-number"),
        "total": number("warc-segment-total-length"),
        "block": block[: length or 0],
        "complete": length is not None and length <= len(block),
    }


def decode(row: dict) -> dict:
    """The payload of a whole record, checked against its digest."""
    body, complete, http = row["block"], row["complete"], {}
    if row["type"] != "resource":
        head, _, body = body.partition(END.encode())
        http = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in head.decode("latin-1").split("\r\n")[1:])}
    named, payload = row["digest"], None
    if row["type"] == "revisit":
        size = int(http["content-length"]) if http.get("content-length", "").isdigit() else 0
    else:
        try:
            payload = unchunked(body) if http.get("transfer-encoding", "").lower() == "chunked" else body
        except ValueError:
            payload, complete = b"", False
        size, found = len(payload), hashlib.sha1(payload).hexdigest()
        complete, named = complete and named in (None, found), found if complete else named
    return {"page": row["page"], "url": row["url"], "record_type": row["type"], "refers_to": row["refers_to"], "payload_bytes": size, "payload_digest": named, "complete": complete, "payload": payload}


_KINDS = {"payload_bytes": "bigint", "complete": "boolean", "payload": "binary", "segment": "bigint", "total": "bigint", "block": "binary"}
_ARROW = {"bigint": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary(), "string": pa.string()}
_READ = ("page", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "complete", "payload")
_SEGMENT = ("origin", "segment", "total", "block")


def _schema(names: tuple[str, ...]) -> str:
    return ", ".join(f"{n} {_KINDS.get(n, 'string')}" for n in names)


def _batch(rows: list[dict], names: tuple[str, ...]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], _ARROW[_KINDS.get(n, "string")]) for n in names], names=[*names])


def _batches(rows: Iterator[dict], names: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 200 + len(row.get("payload") or b"") + len(row.get("block") or b"")
        if size > SLICE_BYTES:
            yield _batch(held, names)
            held, size = [], 0
    yield _batch(held, names)


def read_archives(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """Per page record: page, url, record_type, refers_to, payload_bytes, payload_digest, complete and, if wanted, payload."""
    # The word alone: its first letter doesn't come again in it, so that a match which breaks off hides no other one.
    pieces = spark.read.option("lineSep", BEGINS).text(path).select(F.col("value").cast("binary").alias("value"), "_metadata.file_path")
    names = _READ if payload else _READ[:-1]
    both = (*names, *_SEGMENT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = ((v, f) for batch in batches for v, f in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))

        def rows() -> Iterator[dict]:
            for r in map(parse, frames(parts)):
                if r["segment"] is not None:
                    yield {"record_type": r["type"], "payload_digest": r["digest"], **{n: r[n] for n in ("page", "url", "refers_to", "complete", *_SEGMENT)}}
                elif r["type"] in PAYLOADS:
                    yield {n: v for n, v in decode(r).items() if n in names}

        yield from _batches(rows(), both)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[dict]:
            for batch in batches:
                for r in batch.to_pylist():
                    parts = r["parts"]
                    block = b"".join(p["block"] for p in parts)
                    in_order = [p["segment"] for p in parts] == [*range(1, len(parts) + 1)]
                    r |= {"type": r["record_type"], "digest": r["payload_digest"], "block": block, "complete": in_order and r["complete"] and r["total"] == len(block)}
                    if r["type"] in PAYLOADS:
                        yield {n: v for n, v in decode(r).items() if n in names}

        yield from _batches(rows(), names)

    found = written(pieces.mapInArrow(run, _schema(both)), "records")
    first = lambda name: F.min_by(name, "segment").alias(name)
    grouped = found.where("segment IS NOT NULL").groupBy("origin")
    grouped = grouped.agg(*map(first, ("page", "url", "record_type", "refers_to", "payload_digest")), F.max("total").alias("total"), F.min("complete").alias("complete"), F.sort_array(F.collect_list(F.struct("segment", "block"))).alias("parts"))
    return found.where("segment IS NULL").select(*names).unionByName(grouped.mapInArrow(joined, _schema(names)))


def archive(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """Write the pages to archives in the shared folder and return what reading them back gives, without payloads."""
    spark = pages.sparkSession
    path = scratch(spark, "warc")
    write_archives(pages, path, page_id, url, html, segment_bytes)
    kind = pages.schema[page_id].dataType
    found = read_archives(spark, path, payload=False)
    return found.select(F.col("page").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"), "complete")

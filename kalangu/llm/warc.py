"""WARC archives of pages: records with segments, revisits, and their reassembly.

Writing: every page is one response record with an HTTP block whose payload is
in chunked transfer framing, or, if a page of smaller id has the same payload,
a revisit record without it. A block longer than ``segment`` bytes goes on in
continuation records. Spark's text writer lays the records one after the other
into gzip files, so a task that is run again replaces its files as a whole.

Reading: the records of each file are parsed by their Content-Length. Whole
responses are decoded at once. Segments meet by their origin's identifier, are
put in order of their number, and give a block if numbers and total length are
right; then the chunks are decoded and the digest is compared. Revisits get
size and digest of the response they refer to.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kalangu.session import through_table

SEGMENT = 32 << 10
CHUNK = 8 << 10
RECORDS_PER_FILE = 2_000
DATE = "2024-01-01T00:00:00Z"
_SPACE = uuid.UUID("7d0f8a52-4c64-5f0e-9b52-7a0e2f0c6a11")
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
_BARE_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def record_id(page: object, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'{page}/{digest}')}>"


def _cut(block: bytes, size: int) -> list[bytes]:
    """Parts of at most ``size`` bytes that end between characters, as the text writer takes whole characters."""
    parts, at = [], 0
    while len(block) - at > size:
        end = at + size
        while end > at + 1 and block[end] & 0xC0 == 0x80:
            end -= 1
        parts.append(block[at:end])
        at = end
    return [*parts, block[at:]]


def _framed(payload: bytes, size: int) -> bytes:
    return b"".join(b"%x\r\n%b\r\n" % (len(p), p) for p in _cut(payload, size) if p) + b"0\r\n\r\n"


def unframed(body: bytes) -> bytes | None:
    """The payload of a chunked body; None if the framing is broken."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        if end < 0:
            return None
        try:
            size = int(body[at:end].split(b";")[0].strip() or b"?", 16)
        except ValueError:
            return None
        at = end + 2
        if size == 0:
            return b"".join(out)
        if size < 0 or body[at + size:at + size + 2] != b"\r\n":
            return None
        out.append(body[at:at + size])
        at += size + 2


def payload_of(block: bytes) -> bytes | None:
    """The payload of an HTTP block, chunked or plain; None if it is no such block."""
    head, blank, body = block.partition(b"\r\n\r\n")
    if not blank:
        return None
    chunked = any(line.lower().startswith(b"transfer-encoding:") and b"chunked" in line.lower() for line in head.split(b"\r\n"))
    return unframed(body) if chunked else body


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    """One record but for its last line end, which the text writer adds."""
    lines = [f"{k}: {v}" for k, v in [*fields, ("Content-Length", len(block))] if v is not None]
    return ("WARC/1.1\r\n" + "\r\n".join(lines) + "\r\n\r\n").encode() + block + b"\r\n"


def _one_line(url: str | None) -> str | None:
    return None if url is None else "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url)


def records(page: int | None, url: str | None, html: str, first: int | None, segment: int = SEGMENT, chunk: int = CHUNK,
            date: str = DATE) -> list[bytes]:
    """The records of one page; ``first`` is the page it revisits, or None."""
    payload = html.encode()
    digest = base32_sha1(payload)
    own = record_id(page, digest)
    common = [("WARC-Target-URI", _one_line(url)), ("WARC-Date", date), ("WARC-Page-ID", page), ("WARC-Payload-Digest", f"sha1:{digest}")]
    if first is not None:
        return [_record([("WARC-Type", "revisit"), ("WARC-Record-ID", own), *common, ("WARC-Profile", _PROFILE),
                         ("WARC-Refers-To", record_id(first, digest)), ("Content-Type", "application/http; msgtype=response")], _BARE_HTTP)]
    block = _HTTP + _framed(payload, chunk)
    parts = _cut(block, max(8, segment))
    out = [_record([("WARC-Type", "response"), ("WARC-Record-ID", own), *common, ("WARC-Segment-Number", 1 if len(parts) > 1 else None),
                    ("Content-Type", "application/http; msgtype=response")], parts[0])]
    for k, part in enumerate(parts[1:], 2):
        out.append(_record([("WARC-Type", "continuation"), ("WARC-Record-ID", record_id(own, str(k))), ("WARC-Date", date),
                            ("WARC-Segment-Origin-ID", own), ("WARC-Segment-Number", k),
                            ("WARC-Segment-Total-Length", len(block) if k == len(parts) else None)], part))
    return out


def write(pages: DataFrame, path: str, id: str = "page_id", url: str = "url", html: str = "html", least_bytes: int = 0,
          segment: int = SEGMENT, chunk: int = CHUNK, per_file: int = RECORDS_PER_FILE) -> None:
    """Write ``pages`` as gzip archives below ``path``.

    Of equal payloads of at least ``least_bytes`` the one of the smallest id is
    a response, the others revisit it. A null payload is empty; a null url is
    left out; a page without an id never stands for others and always is a
    response of its own. Rows that repeat id and payload have one identity and
    are read back as one page. Other columns are not read.
    """
    rows = pages.select(F.col(f"`{id}`").alias("page"), F.col(f"`{url}`").alias("url"), F.coalesce(F.col(f"`{html}`"), F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha1("html"))
    first = rows.groupBy("digest").agg(F.min("page").alias("first"), F.count("*").alias("n")).filter("n > 1").select("digest", "first")
    revisit = (F.octet_length("html") >= least_bytes) & (F.col("page") > F.col("first"))
    placed = rows.join(first, "digest", "left").select("page", "url", "html", F.when(revisit, F.col("first")).alias("first"))

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[bytes] = []
            held = 0
            for row in zip(*(batch[c].to_pylist() for c in ("page", "url", "html", "first"))):
                made = records(*row, segment, chunk)
                out += made
                held += sum(map(len, made))
                if held > 1 << 24:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()).cast(pa.string())], ["value"])
                    out, held = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()).cast(pa.string())], ["value"])

    (placed.mapInArrow(lines, "value string").write.option("lineSep", "\r\n").option("compression", "gzip")
     .option("maxRecordsPerFile", per_file).text(path))


def inflated(archive: bytes) -> tuple[bytes, bool]:
    """What can be read of the gzip members of an archive, and whether that is all; others as they are."""
    if archive[:2] != b"\x1f\x8b":
        return archive, True
    out, rest = [], archive
    while rest:
        member, at = zlib.decompressobj(31), 0
        try:
            while at < len(rest) and not member.eof:
                out.append(member.decompress(rest[at:at + (1 << 16)]))
                at += 1 << 16
        except zlib.error:
            return b"".join(out), False
        if not member.eof:
            return b"".join(out), False
        rest = member.unused_data + rest[at:]
    return b"".join(out), True


def parsed(archive: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Fields (names in lower case) and block of each record of an archive, compressed or not.

    Of a damaged archive the records before the damage, then one of type
    ``damaged`` that says where it is.
    """
    data, whole = inflated(archive)
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        if end < 0 or not data.startswith(b"WARC/", at):
            break
        fields = {}
        for line in data[at:end].split(b"\r\n")[1:]:
            name, _, value = line.decode(errors="replace").partition(":")
            fields[name.strip().lower()] = value.strip()
        size, start = fields.get("content-length", ""), end + 4
        if not size.isdecimal() or "warc-record-id" not in fields or data[start + int(size):start + int(size) + 4] != b"\r\n\r\n":
            break
        at = start + int(size) + 4
        yield fields, data[start:at - 4]
    if at < len(data) or not whole:
        yield {"warc-type": "damaged", "warc-record-id": f"damaged:{hashlib.sha1(archive).hexdigest()}:{at}"}, b""


_PARTS = pa.schema([("record", pa.string()), ("kind", pa.string()), ("page", pa.int64()), ("url", pa.string()), ("digest", pa.string()),
                    ("refers", pa.string()), ("number", pa.int32()), ("total", pa.int64()), ("block", pa.binary()),
                    ("size", pa.int64()), ("status", pa.string())])


def _checked(block: bytes, digest: str | None) -> tuple[int | None, str | None, str]:
    payload = payload_of(block)
    if payload is None:
        return None, digest, "broken framing"
    real = base32_sha1(payload)
    return len(payload), real, "ok" if digest in (None, real) else "wrong digest"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows(archive: bytes) -> Iterator[tuple]:
        for f, block in parsed(archive):
            kind, page = f.get("warc-type"), f.get("warc-page-id")
            digest = f.get("warc-payload-digest", "").removeprefix("sha1:") or None
            number, total = f.get("warc-segment-number"), f.get("warc-segment-total-length")
            about = (int(page) if page and page.removeprefix("-").isdecimal() else None, f.get("warc-target-uri"))
            if kind == "response" and number is None:
                size, digest, status = _checked(block, digest)
                yield (f["warc-record-id"], kind, *about, digest, None, None, None, None, size, status)
            elif kind == "revisit":
                yield (f["warc-record-id"], kind, *about, digest, f.get("warc-refers-to"), None, None, None, None, "ok")
            elif kind == "damaged":
                yield (f["warc-record-id"], kind, None, None, None, None, None, None, None, None, "truncated")
            elif kind in ("response", "continuation"):
                yield (f.get("warc-segment-origin-id", f["warc-record-id"]), kind, *about, digest, None, int(number or 1),
                       int(total) if total else None, block, None, None)

    for batch in batches:
        for archive in batch["content"]:
            out, held = [], 0
            for row in rows(archive.as_py()):
                out.append(row)
                held += len(row[8] or b"")
                if len(out) >= 10_000 or held > 1 << 24:
                    yield pa.RecordBatch.from_pylist([dict(zip(_PARTS.names, r)) for r in out], _PARTS)
                    out, held = [], 0
            yield pa.RecordBatch.from_pylist([dict(zip(_PARTS.names, r)) for r in out], _PARTS)


def assembled(parts: list[dict]) -> tuple[bytes | None, str]:
    """The block of a segmented record from its parts in any order; a part that comes twice counts once."""
    by = {p["number"]: p for p in parts}
    ordered = [by[k] for k in sorted(by)]
    if [p["number"] for p in ordered] != list(range(1, len(ordered) + 1)) or ordered[-1]["total"] is None:
        return None, "missing segment"
    block = b"".join(p["block"] for p in ordered)
    return (block, "ok") if len(block) == ordered[-1]["total"] else (None, "wrong length")


def read(spark: SparkSession, path: str) -> DataFrame:
    """Pages of the archives below ``path``: page_id, url, record_type, payload_bytes, payload_digest, refers_to, status.

    ``status`` is ok, missing segment, wrong length, broken framing, wrong
    digest or, for a revisit, no response; sizes are null where they cannot be
    known. A record that comes twice is read once. A damaged archive gives its
    records up to the damage and one row of record_type damaged and status
    truncated; an empty file gives nothing. Files are read whole, so keep them to some ten megabytes, as
    ``write`` does.
    """
    files = spark.read.format("binaryFile").load(path).select("content")
    ddl = ("record string, kind string, page bigint, url string, digest string, refers string, number int, total bigint, "
           "block binary, size bigint, status string")
    parts = through_table(files.mapInArrow(_read, ddl), "records")

    @F.arrow_udf("struct<size:bigint,digest:string,status:string>")
    def join(lists: pa.Array, digests: pa.Array) -> pa.Array:
        out = []
        for some, digest in zip(lists, digests.to_pylist()):
            block, status = assembled(some.as_py())
            size, real = None, digest
            if block is not None:
                size, real, status = _checked(block, digest)
            out.append({"size": size, "digest": real, "status": status})
        return pa.array(out, pa.struct([("size", pa.int64()), ("digest", pa.string()), ("status", pa.string())]))

    # from here on every row is small, but for the segments of long records
    whole = parts.filter("number is null").groupBy("record").agg(*[
        F.first(c).alias(c) for c in ("kind", "page", "url", "digest", "refers", "size", "status")])
    grouped = parts.filter("number is not null").groupBy("record").agg(
        F.first("page", ignorenulls=True).alias("page"), F.first("url", ignorenulls=True).alias("url"),
        F.first("digest", ignorenulls=True).alias("digest"), F.collect_list(F.struct("number", "total", "block")).alias("parts"))
    grouped = grouped.withColumn("j", join("parts", "digest")).select(
        "record", F.lit("response").alias("kind"), "page", "url", F.col("j.digest").alias("digest"), F.lit(None).cast("string").alias("refers"),
        F.col("j.size").alias("size"), F.col("j.status").alias("status"))
    return _linked(through_table(whole.union(grouped), "pages"))


def _linked(found: DataFrame) -> DataFrame:
    answers = found.filter("kind = 'response'").select(F.col("record").alias("r"), F.col("page").alias("r_page"), F.col("size").alias("r_size"))
    lost = (F.col("kind") == "revisit") & F.col("r").isNull()
    return found.join(answers, F.col("refers") == F.col("r"), "left").select(
        F.col("page").alias("page_id"), "url", F.col("kind").alias("record_type"), F.coalesce("size", "r_size").alias("payload_bytes"),
        F.col("digest").alias("payload_digest"), F.col("r_page").alias("refers_to"), F.when(lost, "no response").otherwise(F.col("status")).alias("status"))

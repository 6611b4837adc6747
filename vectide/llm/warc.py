"""WARC: archives are written, and read back with their segments put together.

A record per page. Its block is an HTTP response with the html in UTF-8 (null: empty) in chunked transfer coding, its
digest the SHA-256 of the html. Of pages with equal payloads of at least `MIN_REVISIT` bytes the smallest page_id is the
response; the others are revisits that hold headers only and refer to it. A page with null page_id is larger than any
other; it revisits the one with a page_id, and among equal pages that all have none each is a response.

Blocks over `segment` bytes are cut: the first record has WARC-Segment-Number 1, the others are continuations with the
first one's id in WARC-Segment-Origin-ID, and the last has WARC-Segment-Total-Length. A task rolls to a new archive every
`ARCHIVE` bytes (1 GB, so mostly one archive a task); segments of one block can be in different archives. Archives are gzip files, one member a record. A task's
archives count only if it ends: their names are its result, kept in a manifest that Spark commits. What a lost attempt
has written under other names is never read.

Reading goes through the archives of the manifest, one record at a time, with `PACK` bytes of archives to a task; as long as
there are fewer tasks than cores, an archive each. Whole records are decoded on the spot. Only
segments are shuffled: grouped by their origin, ordered by number, checked against the total length (and for gaps), then
decoded. A block that fails a check raises MalformedRecord. A group is one record, so its size has nothing to do with how
often a payload repeats. Other columns of the pages aren't read; repeated page_ids and rows are records of their own. An empty
table gives a manifest without archives and an empty result.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, materialize, new_path, small

MIN_REVISIT = 100
SEGMENT, CHUNK, ARCHIVE = 32 << 10, 8 << 10, 1 << 30
#: Bytes of archives that a task reads, about.
PACK = 256 << 20
CRLF = b"\r\n"
#: Names of header fields of this writer, beside the standard's.
PAGE, LENGTH, REFERS = "X-Page-ID", "X-Payload-Length", "X-Refers-To-Page"


class MalformedRecord(ValueError):
    """An archive that can't be read: a gap in the segments, a wrong length or bad chunk framing."""


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    parts = []
    for i in range(0, len(payload), size):
        part = payload[i : i + size]
        parts += [b"%x\r\n" % len(part), part, CRLF]
    return b"".join([*parts, b"0\r\n\r\n"])


def unchunked(body: bytes) -> bytes:
    """The payload of a body in chunked transfer coding; extensions and trailers are passed over."""
    parts, at = [], 0
    while True:
        end = body.find(CRLF, at)
        size = body[at:end].split(b";")[0].strip() if end >= 0 else b""
        if not re.fullmatch(rb"[0-9A-Fa-f]+", size):
            raise MalformedRecord(f"no chunk size at byte {at}")
        n = int(size, 16)
        if not n:
            return b"".join(parts)
        at = end + 2 + n
        if body[at : at + 2] != CRLF:
            raise MalformedRecord(f"chunk of {n} bytes has no end at byte {at}")
        parts.append(body[end + 2 : at])
        at += 2


def record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + head.encode() + CRLF + block + CRLF + CRLF


def records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """The header fields (names in lower case) and blocks of a stretch of records."""
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        if not data.startswith(b"WARC/1.", at) or end < 0:
            raise MalformedRecord(f"no record at byte {at}")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in data[at:end].decode().split("\r\n")[1:])}
        start = end + 4
        stop = start + int(fields["content-length"])
        if data[stop : stop + 4] != b"\r\n\r\n":
            raise MalformedRecord(f"record at byte {at} doesn't end at byte {stop}")
        yield fields, data[start:stop]
        at = stop + 4


def record_id(*parts: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, '/'.join(map(str, parts)))}>"


def page_records(number: str, page: int | None, url: str | None, payload: bytes, digest: str, refers: int | None, segment: int) -> list[bytes]:
    """The record of a page, or its segments. number tells records of one page_id apart."""
    own = record_id(number)
    base = [("WARC-Date", "2024-01-01T00:00:00Z"), ("WARC-Payload-Digest", f"sha256:{digest}"), (PAGE, "" if page is None else str(page)), (LENGTH, str(len(payload)))]
    base += [("WARC-Target-URI", re.sub(r"[\x00-\x20]", "", url))] if url else []
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
    if refers is not None:
        fields = [("WARC-Type", "revisit"), ("WARC-Record-ID", own), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), (REFERS, str(refers))]
        return [record(fields + base, head)]
    block = head + chunked(payload)
    kind = ("Content-Type", "application/http; msgtype=response")
    if len(block) <= segment:
        return [record([("WARC-Type", "response"), ("WARC-Record-ID", own), kind, *base], block)]
    cuts = range(0, len(block), segment)
    out = [record([("WARC-Type", "response"), ("WARC-Record-ID", own), kind, ("WARC-Segment-Number", "1"), *base], block[:segment])]
    for i, at in enumerate(cuts[1:], 2):
        last = [("WARC-Segment-Total-Length", str(len(block)))] if i == len(cuts) else []
        out.append(record([("WARC-Type", "continuation"), ("WARC-Record-ID", record_id(number, i)), ("WARC-Segment-Number", str(i)), ("WARC-Segment-Origin-ID", own), *last, base[0]], block[at : at + segment]))
    return out


def put_together(segments: list[tuple[int, int | None, bytes]]) -> bytes:
    """The block of (number, total length, part) rows, in any order; a repeated number must repeat its part."""
    parts: dict[int, bytes] = {}
    totals = {total for _, total, _ in segments if total is not None}
    for number, _, part in segments:
        if parts.setdefault(number, part) != part:
            raise MalformedRecord(f"two different segments {number}")
    if sorted(parts) != list(range(1, len(parts) + 1)):
        raise MalformedRecord(f"segments {sorted(parts)[:9]} have a gap")
    block = b"".join(parts[i] for i in sorted(parts))
    if totals != {len(block)}:
        raise MalformedRecord(f"segments have {len(block)} bytes, not {sorted(totals)}")
    return block


def payload_of(block: bytes) -> bytes:
    head, _, body = block.partition(b"\r\n\r\n")
    return unchunked(body) if re.search(rb"(?im)^transfer-encoding:\s*chunked\s*$", head) else body


def store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def revisits(pages: DataFrame) -> DataFrame:
    """(page_id, refers_to) of the pages that revisit another, from digests only."""
    digests = materialize(pages.select("page_id", F.sha2(F.coalesce("html", F.lit("")).cast("binary"), 256).alias("digest"), F.octet_length(F.coalesce("html", F.lit(""))).alias("n")).where(F.col("n") >= MIN_REVISIT).drop("n"), "digests")
    firsts = digests.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).where((F.col("n") > 1) & F.col("refers_to").isNotNull())
    return materialize(digests.join(small(firsts.select("digest", "refers_to")), "digest").where(~F.col("page_id").eqNullSafe(F.col("refers_to"))).select("page_id", "refers_to", "digest").distinct(), "revisits")


def write_archives(pages: DataFrame, path: str, segment: int = SEGMENT) -> DataFrame:
    """Writes the archives into a folder of the shared store; the manifest (archive, records, bytes) tells which count."""
    bound_batches(pages.sparkSession)
    store_path = path

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, folder = store(store_path)
        files.create_dir(folder, recursive=True)
        out, name, size, n = None, "", 0, 0
        attempt = uuid.uuid4().hex
        done: list[tuple[str, int, int]] = []
        for batch in batches:
            for page, url, html, refers in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                payload = (html or "").encode()
                number = f"{attempt}/{len(done)}/{n}" if page is None else f"{page}/{attempt}/{len(done)}/{n}"
                for x in page_records(number, page, url, payload, hashlib.sha256(payload).hexdigest(), refers, segment):
                    if out is None:
                        name, size, n = f"{attempt}-{len(done)}.warc.gz", 0, 0
                        out = files.open_output_stream(f"{folder}/{name}", compression=None)
                    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
                    data = packer.compress(x) + packer.flush()
                    out.write(data)
                    size, n = size + len(data), n + 1
                    if size >= ARCHIVE:
                        out.close()
                        done.append((name, n, size))
                        out, n = None, 0
        if out is not None:
            out.close()
            done.append((name, n, size))
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in done], k) for i, k in enumerate((pa.string(), pa.int64(), pa.int64()))], names=["archive", "records", "bytes"])

    again = small(revisits(pages.select("page_id", "html")))
    # the payload's digest is compared too: rows may repeat a page_id with other payloads
    ids = again.select(F.col("page_id").alias("again"), "refers_to", "digest")
    same = pages["page_id"].eqNullSafe(ids["again"]) & (F.sha2(pages["html"].cast("binary"), 256) == ids["digest"])
    marked = pages.select("page_id", "url", "html").join(ids, same, "left").select("page_id", "url", "html", "refers_to")
    return materialize(marked.mapInArrow(write, "archive string, records long, bytes long"), "manifest")


def read_archives(manifest: DataFrame, path: str, *, payloads: bool = True) -> DataFrame:
    """page_id, record_type, refers_to, payload_bytes, payload_digest and (payloads=True) payload of every page's record.

    Size and digest of a response are taken from the payload that was read, and must be those of its header; a revisit's are
    its header's, and its payload is null.
    """
    spark = manifest.sparkSession
    bound_batches(spark)
    names = ["page_id", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload", "origin", "segment", "total"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.string(), pa.int32(), pa.int64()]
    schema = "page_id long, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary, origin string, segment int, total long"

    def decoded(known: tuple, block: bytes) -> tuple:
        payload = payload_of(block)
        if (own := (len(payload), hashlib.sha256(payload).hexdigest())) != known[3:5]:
            raise MalformedRecord(f"page {known[0]}: payload {own}, header {known[3:5]}")
        return (*known, payload if payloads else None)

    def members(file) -> Iterator[bytes]:
        opener, parts = zlib.decompressobj(31), []
        while data := file.read(1 << 18):
            while data:
                parts.append(opener.decompress(data))
                data = opener.unused_data
                if opener.eof:
                    yield b"".join(parts)
                    opener, parts = zlib.decompressobj(31), []
        if any(parts):
            raise MalformedRecord("the archive is cut off")

    def row(fields: dict[str, str], block: bytes) -> tuple:
        number = lambda k: int(fields[k]) if fields.get(k) else None
        digest = fields.get("warc-payload-digest", "").removeprefix("sha256:") or None
        known = (number(PAGE.lower()), fields["warc-type"], number(REFERS.lower()), number(LENGTH.lower()), digest)
        if "warc-segment-number" in fields:
            return (*known, block, fields.get("warc-segment-origin-id", fields["warc-record-id"]), number("warc-segment-number"), number("warc-segment-total-length"))
        return (*(decoded(known, block) if known[1] == "response" else (*known, None)), None, None, None)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, folder = store(path)
        rows, size = [], 0
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with files.open_input_stream(f"{folder}/{name}", compression=None) as file:
                    for member in members(file):
                        for fields, block in records(member):
                            rows.append(row(fields, block))
                            size += len(block)
                            if size >= 4 << 20 or len(rows) >= 1000:
                                yield as_batch(rows)
                                rows, size = [], 0
        yield as_batch(rows)

    def as_batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows, strict=True) if rows else [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    def assemble(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        first = next((r for r in rows if r["segment"] == 1), None)
        if first is None:
            raise MalformedRecord(f"{rows[0]['origin']} has no first segment")
        block = put_together([(r["segment"], r["total"], r["payload"]) for r in rows])
        return pa.table([pa.array([x], k) for x, k in zip((*decoded(tuple(first[n] for n in names[:5]), block), None, None, None), kinds, strict=True)], names=names)

    # archives are dealt out evenly; read once: without payloads only the segments' parts are in this table
    n, size = manifest.agg(F.count(F.lit(1)), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    tasks = max(1, min(n, max(spark.sparkContext.defaultParallelism, -(-size // PACK))))
    parts = materialize(manifest.select("archive").repartition(tasks).mapInArrow(read, schema), "records")
    whole = parts.where(F.col("origin").isNull())
    segments = parts.where(F.col("origin").isNotNull()).groupBy("origin").applyInArrow(assemble, schema)
    return whole.union(segments).select(*names[: 5 + payloads])


def roundtrip(pages: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """Writes the pages' archives to the shared folder and reads them back."""
    path = new_path(pages.sparkSession, "warc")
    found = read_archives(write_archives(pages, path, segment), path, payloads=False)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")

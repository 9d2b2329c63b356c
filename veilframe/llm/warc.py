"""WARC archives: writing with revisits and segments, reading with reassembly.

Writing: a page becomes a response record, or a revisit record if a page with
a smaller id has an equal payload. The block of a response is an HTTP message
with chunked transfer framing. Blocks over SEGMENT_BYTES are split: the
response holds the first segment, continuation records hold the others, with
the origin's id, their number and, on the last, the total length.

Reading: records are parsed file by file; of other types than response,
revisit and continuation they are skipped. Whole responses are decoded at once.
Segments are grouped by the origin's id, ordered by number, checked to be
complete and as long as the total says, joined and decoded. A SHA-1 payload
digest is verified where a record has one. Revisits are resolved by a join of
WARC-Refers-To with the responses' record ids, and their digest is compared
with the response's; one whose response is not in the files keeps what its own
headers say and refers to nothing. Page-ID is a header of our own; records of
other archives have no page_id.

Every record is a gzip member of its own. Files are written by Spark's text
sink, one value a file, through the commit protocol and Hadoop's file system;
the line separator is an empty gzip member (its bytes, and the value's, pass
through the sink unchanged, as it writes strings' bytes unchecked; the files'
names end in .txt). The binaryFile source reads them, and archives of others.

Defined results: a null html is an empty payload; a null url an empty target;
rows without a page_id are response records unless a row with an id has the
same payload; repeated rows are all response records, if none with a smaller
id has their payload; an empty table makes no files and an empty result.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.llm.common import join_null_safe, lookup, scratch, written

SEGMENT_BYTES = 16 << 10
CHUNK_BYTES = 4 << 10
FILE_BYTES = 8 << 20
LEVEL = 4
DATE = "2024-01-01T00:00:00Z"
#: The profile of revisits by payload, and an empty gzip member.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
EMPTY_MEMBER = bytes.fromhex("1f8b08000000000000ff03000000000000000000")
#: Payloads of at least so many bytes are revisited.
MIN_REVISIT_BYTES = 0


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>"


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    parts = [b"%x\r\n%s\r\n" % (len(part), part) for part in (payload[i : i + size] for i in range(0, len(payload), size))]
    return b"".join(parts) + b"0\r\n\r\n"


def dechunked(body: bytes) -> bytes:
    """The payload of a chunked body; extensions and trailers are skipped."""
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0].strip(), 16)
        at = end + 2
        if not size:
            return b"".join(out)
        if body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("chunk without its end")
        out.append(body[at : at + size])
        at += size + 2


def record(kind: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Date: {DATE}", *(f"{k}: {v}" for k, v in headers), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def page_records(page_id: int | None, url: str | None, html: str | None, refers_to: int | None, revisit: bool, segment_bytes: int = SEGMENT_BYTES) -> Iterator[bytes]:
    """The records of one page."""
    payload = (html or "").encode("utf-8", "surrogatepass")
    digest = payload_digest(payload)
    name = record_id(page_id, digest)
    target = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    about = [("WARC-Record-ID", name), ("WARC-Target-URI", target), ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http;msgtype=response")]
    about += [("Page-ID", str(page_id))] * (page_id is not None)
    message = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    if revisit:
        about += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to, digest))]
        yield record("revisit", about, f"{message}Content-Length: {len(payload)}\r\n\r\n".encode())
        return
    block = f"{message}Transfer-Encoding: chunked\r\n\r\n".encode() + chunked(payload)
    if len(block) <= segment_bytes:
        yield record("response", about, block)
        return
    parts = [block[i : i + segment_bytes] for i in range(0, len(block), segment_bytes)]
    yield record("response", [*about, ("WARC-Segment-Number", "1")], parts[0])
    for number, part in enumerate(parts[1:], 2):
        own = f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{name}#{number}')}>"
        more = [("WARC-Record-ID", own), ("WARC-Target-URI", target), ("WARC-Segment-Origin-ID", name), ("WARC-Segment-Number", str(number))]
        yield record("continuation", more + [("WARC-Segment-Total-Length", str(len(block)))] * (number == len(parts)), part)


def parse_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers with lower-case names, block) of each record of a file of gzip members."""
    while data:
        member = zlib.decompressobj(wbits=31)
        raw = member.decompress(data) + member.flush()
        if not member.eof:
            raise ValueError("cut gzip member")
        data = memoryview(data)[len(data) - len(member.unused_data) :]
        at = 0
        while at < len(raw):
            end = raw.index(b"\r\n\r\n", at)
            first, *lines = raw[at:end].decode("utf-8", "replace").split("\r\n")
            if not first.startswith("WARC/1."):
                raise ValueError("no WARC record")
            headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
            size = int(headers["content-length"])
            block = raw[end + 4 : end + 4 + size]
            if len(block) != size or raw[end + 4 + size : end + 8 + size] != b"\r\n\r\n":
                raise ValueError("record without its end")
            yield headers, block
            at = end + 8 + size


def http_payload(block: bytes) -> bytes:
    head, _, body = block.partition(b"\r\n\r\n")
    return dechunked(body) if b"transfer-encoding: chunked" in head.lower() else body


_RECORD = pa.schema(
    [("record_id", pa.string()), ("target_uri", pa.string()), ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to_id", pa.string())]
)
_SEGMENT = pa.schema([("origin", pa.string()), ("number", pa.int64()), ("total", pa.int64()), ("headers", pa.map_(pa.string(), pa.string())), ("block", pa.binary())])
_OUT = "record_id string, target_uri string, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to_id string"


def _decoded(headers: dict[str, str], block: bytes) -> tuple | None:
    """A row of _RECORD for a whole record; None for other types than response and revisit."""
    kind = headers.get("warc-type")
    if kind not in ("response", "revisit"):
        return None
    name, value = headers.get("warc-payload-digest", "").partition(":")[::2]
    said = value if name.lower() == "sha1" else None
    page_id = int(headers["page-id"]) if "page-id" in headers else None
    about = headers.get("warc-record-id"), headers.get("warc-target-uri"), page_id
    if kind == "revisit":
        length = next((int(x.partition(b":")[2]) for x in block.split(b"\r\n") if x.lower().startswith(b"content-length:")), None)
        return *about, length, said, kind, headers.get("warc-refers-to")
    payload = http_payload(block) if headers.get("content-type", "").startswith("application/http") else block
    found = payload_digest(payload)
    if said is not None and found != said:
        raise ValueError(f"payload of {about[0]} does not have its digest")
    return *about, len(payload), found, kind, None


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Files to rows: whole records, and segments with their headers."""
    schema = pa.schema([*_RECORD, *_SEGMENT])
    for batch in batches:
        for content in batch.column("content"):
            rows = []
            for headers, block in parse_records(content.as_py()):
                if "warc-segment-number" not in headers:
                    found = _decoded(headers, block)
                    if found is not None:
                        rows.append((*found, *[None] * len(_SEGMENT)))
                    continue
                total = headers.get("warc-segment-total-length")
                origin = headers.get("warc-segment-origin-id", headers.get("warc-record-id"))
                rows.append((*[None] * len(_RECORD), origin, int(headers["warc-segment-number"]), int(total) if total else None, list(headers.items()), block))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


def _reassembled(table: pa.Table) -> pa.Table:
    """The segments of one origin to a row of _RECORD."""
    rows = sorted(table.to_pylist(), key=lambda r: r["number"])
    # a repeated row of the input wrote the same segments again
    copies = len(rows) // len({r["number"] for r in rows})
    rows = rows[::copies]
    block = b"".join(r["block"] for r in rows)
    total = rows[-1]["total"]
    if [r["number"] for r in rows] != list(range(1, len(rows) + 1)) or total != len(block):
        raise ValueError(f"segments of {rows[0]['origin']} are not complete")
    found = _decoded(dict(rows[0]["headers"]), block)
    return pa.Table.from_pylist([dict(zip(_RECORD.names, found, strict=True))] * copies if found else [], _RECORD)


def _archives(segment_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        size = 0
        for batch in batches:
            for row in batch.to_pylist():
                for r in page_records(row["page_id"], row["url"], row["html"], row["refers_to"], row["revisit"], segment_bytes):
                    held.append(gzip.compress(r, LEVEL, mtime=0))
                    size += len(held[-1])
                if size >= FILE_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], names=["value"])
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], names=["value"])

    return run


def write_archives(pages: DataFrame, path: str, segment_bytes: int = SEGMENT_BYTES, min_revisit_bytes: int = MIN_REVISIT_BYTES) -> None:
    """Writes pages (page_id, url, html) as WARC files under path.

    Only digests are shuffled to find the first page of each payload, with
    partial minima; then the pages that revisit are joined to the html by id.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    keyed = pages.select(F.col("page_id").cast("long").alias("page_id"), F.sha1(payload).alias("sha"), F.octet_length(payload).alias("bytes"))
    firsts = keyed.where(F.col("bytes") >= min_revisit_bytes).groupBy("sha").agg(F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1 and refers_to is not null")
    firsts = lookup(written(firsts.select("sha", "refers_to"), "firsts"))
    again = keyed.join(firsts, "sha").where(~F.col("page_id").eqNullSafe(F.col("refers_to"))).select("page_id", "sha", "refers_to").distinct()
    again = lookup(written(again, "revisits"))
    ready = join_null_safe(pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", F.sha1(payload).alias("sha")), again, ["page_id", "sha"], "left")
    ready = ready.select("page_id", "url", "html", "refers_to", F.col("refers_to").isNotNull().alias("revisit"))
    packed = ready.mapInArrow(_archives(segment_bytes), "value binary")
    packed.select(F.col("value").cast("string").alias("value")).write.option("maxRecordsPerFile", 1).option("lineSep", EMPTY_MEMBER.decode("latin-1")).option("encoding", "ISO-8859-1").text(path)


def read_records(spark, path: str, glob: str = "*") -> DataFrame:
    """Every response and revisit in the files: record_id, target_uri, page_id, payload_bytes, payload_digest, record_type, refers_to_id."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("content")
    parsed = written(files.mapInArrow(_parsed, f"{_OUT}, origin string, number long, total long, headers map<string,string>, block binary"), "parsed")
    whole = parsed.where("origin is null").select(*_RECORD.names)
    joined = parsed.where("origin is not null").select(*_SEGMENT.names).groupBy("origin").applyInArrow(_reassembled, _OUT)
    return whole.union(joined)


def read_archives(spark, path: str, glob: str = "*") -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every response and revisit in the files, revisits resolved."""
    records = written(read_records(spark, path, glob), "records")
    revisits = records.where("record_type = 'revisit'")
    wanted = lookup(written(revisits.select(F.col("refers_to_id").alias("record_id")).where("record_id is not null").distinct(), "referred"))
    responses = records.where("record_type = 'response'").join(wanted, "record_id", "left_semi")
    origins = responses.groupBy("record_id").agg(F.min(F.struct(F.col("page_id").alias("refers_to"), F.col("payload_bytes").alias("bytes"), F.col("payload_digest").alias("digest"))).alias("origin"))
    origins = lookup(written(origins.withColumnRenamed("record_id", "refers_to_id"), "origins"))
    found = revisits.join(origins, "refers_to_id", "left")
    differs = F.concat(F.lit("the digest of a revisit is not that of its response: "), F.coalesce("record_id", F.lit("")))
    digest = F.when(F.col("payload_digest") != F.col("origin.digest"), F.raise_error(differs).cast("string")).otherwise(F.coalesce("payload_digest", "origin.digest"))
    resolved = found.select("page_id", F.coalesce("origin.bytes", "payload_bytes").alias("payload_bytes"), digest.alias("payload_digest"), "record_type", F.col("origin.refers_to").alias("refers_to"))
    whole = records.where("record_type = 'response'").select("page_id", "payload_bytes", "payload_digest", "record_type", F.lit(None).cast("long").alias("refers_to"))
    return whole.union(resolved)


def archive_and_read(pages: DataFrame, **settings) -> DataFrame:
    """Writes pages to a new shared folder and returns what reading the archives gives."""
    path = scratch(pages.sparkSession, "warc")
    write_archives(pages, path, **settings)
    return read_archives(pages.sparkSession, path)

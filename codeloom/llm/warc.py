"""WARC archives: writing with revisits and segments, reading with reassembly.

Records are built and parsed in tasks; Spark's text writer and binary-file
reader move the bytes, so archives can lie wherever Spark can write.  A record
is a gzip member of its own; to the text writer it is a line, and the line ends
are empty members.

Long blocks are written as segments: a first record and continuations that name
its id.  On reading, the segments of a record are grouped by that origin id,
ordered by segment number, joined when the total length agrees, and the chunked
transfer framing of the HTTP message is undone.  Archives of other writers are
read as well: names, digests and numbers of any form, and a record that is
broken is told so and does not end the job.
"""

from __future__ import annotations

import base64
import binascii
import re
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm.staging import stage

DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
PARSED = "record_id string, type string, page_id long, refers_to long, digest string, origin string, segment int, total long, http boolean, ok boolean, block binary"
RECORD = "record_id string, record_type string, page_id long, refers_to long, digest string, payload binary, valid boolean"


#: A gzip member without content.
EMPTY = bytes.fromhex("1f8b08000000000000ff03000000000000000000")


def _member(record: bytes) -> bytes:
    """A record and the blank lines that close it as one gzip member."""
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(record) + z.compress(b"\r\n\r\n") + z.flush()


def _head(fields: list[tuple[str, object]]) -> bytes:
    return "\r\n".join(["WARC/1.0", *(f"{k}: {v}" for k, v in fields if v is not None)]).encode() + b"\r\n\r\n"


def _one_line(url: str | None) -> str | None:
    return None if url is None else " ".join(url.split())


def chunked(payload: bytes, size: int) -> bytes:
    """HTTP chunked framing."""
    parts = [b"%x\r\n%b\r\n" % (len(payload[a : a + size]), payload[a : a + size]) for a in range(0, len(payload), size)]
    return b"".join(parts) + b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes:
    """The payload of a chunked body; ValueError if the framing is broken."""
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0], 16)
        if size == 0:
            return b"".join(out)
        part = body[end + 2 : end + 2 + size]
        if len(part) < size or body[end + 2 + size : end + 4 + size] != b"\r\n":
            raise ValueError("broken chunk")
        out.append(part)
        at = end + 4 + size


def _records(number: int, page_id, url, payload: bytes, digest: str, refers_to, segment_bytes: int, chunk_bytes: int):
    """The records of one page, each without the blank lines that close it."""
    name = f"<urn:page:{'' if page_id is None else page_id}:{number}>"
    sha1 = "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()
    common = [("WARC-Record-ID", name), ("WARC-Date", DATE), ("WARC-Target-URI", _one_line(url)), ("WARC-Payload-Digest", sha1)]
    if refers_to is not None:
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
        more = [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
        yield _head([("WARC-Type", "revisit"), *common, *more, ("Content-Type", "application/http; msgtype=response"), ("Content-Length", len(block))]) + block
        return
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(payload, chunk_bytes)
    parts = [block[a : a + segment_bytes] for a in range(0, len(block), segment_bytes)]
    http = ("Content-Type", "application/http; msgtype=response")
    first = ("WARC-Segment-Number", 1 if len(parts) > 1 else None)
    yield _head([("WARC-Type", "response"), *common, http, first, ("Content-Length", len(parts[0]))]) + parts[0]
    for k, part in enumerate(parts[1:], 2):
        total = ("WARC-Segment-Total-Length", len(block) if k == len(parts) else None)
        fields = [("WARC-Type", "continuation"), ("WARC-Record-ID", f"{name[:-1]}:{k}>"), ("WARC-Date", DATE)]
        yield _head([*fields, ("WARC-Segment-Origin-ID", name), ("WARC-Segment-Number", k), total, ("Content-Length", len(part))]) + part


def write_archive(
    pages: DataFrame, path: str, least: int = 1000, segment_bytes: int = 32 << 10, chunk_bytes: int = 4096, records_per_file: int = 5000
) -> None:
    """Write a record for each row of ``pages`` (page_id, url, html) to gzipped WARC files under ``path``.

    Of rows with equal payloads of at least ``least`` bytes that with the
    largest page_id is a response, and rows with another page_id are revisits
    of it; all others are responses.

    * Null html: an empty payload.  Null page_id: written without one; it is a
      revisit if an equal payload has an id.  Null url: no target field.
    * Rows that repeat a page_id are written each as a record of their own.
    """
    payload = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload")).withColumn("bytes", F.octet_length("payload").cast("long"))
    same = rows.where(F.col("bytes") >= least).groupBy("digest", "bytes").agg(F.max("page_id").alias("first"), F.count("*").alias("n"))
    same = stage(same.where("n > 1 and first is not null").select("digest", "bytes", "first"), "equal-payloads")
    rows = rows.join(same, ["digest", "bytes"], "left").select(
        F.monotonically_increasing_id().alias("number"), "page_id", "url", "payload", "digest",
        F.when(F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("page_id")), F.col("first")).alias("refers_to"),
    )

    def build(batches):
        for b in batches:
            out, size = [], 0
            for row in zip(*(b.column(k).to_pylist() for k in range(6))):
                for record in _records(*row, segment_bytes, chunk_bytes):
                    out.append(_member(record))
                    size += len(out[-1])
                if size > 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])
                    out, size = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])

    lines = rows.mapInArrow(build, "record binary").select(F.col("record").cast("string").alias("value"))
    bytes_ = lines.write.option("encoding", "ISO-8859-1").option("lineSep", EMPTY.decode("latin-1"))  # both as they are
    bytes_.option("compression", "none").option("maxRecordsPerFile", records_per_file).text(path)


def _stream(content: bytes):
    """Bytes of a gzip file of any number of members, or of a plain one, part by part; what cannot be unpacked ends it."""
    if content[:2] != b"\x1f\x8b":
        yield content
        return
    at, whole = 0, memoryview(content)
    while content[at : at + 2] == b"\x1f\x8b":
        member = zlib.decompressobj(31)
        while at < len(content) and not member.eof:
            given = whole[at : at + (1 << 16)]
            try:
                part = member.decompress(given)
            except zlib.error:
                return
            at += len(given) - len(member.unused_data)
            if part:
                yield part


def _number(text: str | None) -> tuple[int | None, bool]:
    """A number below 10**18, and whether the field is absent or one."""
    if text is None:
        return None, True
    return (int(text), True) if re.fullmatch(r"[0-9]{1,18}", text) else (None, False)


def parse(content: bytes):
    """(header fields in lower case, block, whether it is as long as announced) of each record of one archive file.

    Behind a record without a usable length the next one is looked for by its first line.
    """
    held, parts = bytearray(), _stream(content)

    def fill(n: int) -> bool:
        while len(held) < n:
            part = next(parts, None)
            if part is None:
                return False
            held.extend(part)
        return True

    def find(mark: bytes, start: int = 0) -> int:
        at = held.find(mark, start)
        while at < 0:
            seen = max(start, len(held) - len(mark) + 1)
            if not fill(len(held) + 1):
                return -1
            at = held.find(mark, seen)
        return at

    while True:
        end = find(b"\r\n\r\n")
        if end < 0:
            return
        lines = bytes(held[:end]).decode("utf-8", "replace").lstrip("\r\n").split("\r\n")
        fields = {k.strip().lower(): v.strip() for k, v in (x.split(":", 1) for x in lines[1:] if ":" in x)}
        size, known = _number(fields.get("content-length", ""))
        if not known:
            after = find(b"\r\n\r\nWARC/", end)
            block = bytes(held[end + 4 : after if after >= 0 else len(held)])
            yield fields, block, False
            if after < 0:
                return
            del held[: after + 4]
            continue
        whole = fill(end + 4 + size)
        yield fields, bytes(held[end + 4 : end + 4 + size]), whole
        if not whole:
            return
        fill(end + 8 + size)
        del held[: end + 8 + size]


def _page(name: str | None):
    """The page number in a record's name, if it is one of ours."""
    found = re.fullmatch(r"<?urn:page:(-?[0-9]{1,18})(?::[0-9:]*)?>?", name or "")
    return int(found[1]) if found else None


def _sha1(digest: str | None) -> str | None:
    """A SHA-1 field in base 32 or hexadecimal as hexadecimal; other digests are not looked at."""
    found = re.fullmatch(r"(?i)sha-?1:([a-z2-7]{32}|[0-9a-f]{40})", digest or "")
    if not found:
        return None
    if len(found[1]) == 40:
        return found[1].lower()
    try:
        return base64.b32decode(found[1].upper()).hex()
    except binascii.Error:
        return None


def _parsed(path_batches):
    names = [x.split()[0] for x in PARSED.split(", ")]
    kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.bool_(), pa.bool_(), pa.binary()]

    def table(rows):
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows) if rows else [[]] * len(kinds), kinds)], names=names)

    for b in path_batches:
        for content in b.column(0).to_pylist():
            rows, size = [], 0
            for f, block, whole in parse(content):
                name = f.get("warc-record-id")
                number, fine = _number(f.get("warc-segment-number"))
                total, fit = _number(f.get("warc-segment-total-length"))
                small = number is None or number < 1 << 31
                rows.append((
                    name, f.get("warc-type"), _page(name), _page(f.get("warc-refers-to")), _sha1(f.get("warc-payload-digest")),
                    f.get("warc-segment-origin-id", name), number if small else None, total,
                    f.get("content-type", "application/http").lower().startswith("application/http"), whole and fine and fit and small, block,
                ))
                size += len(block)
                if size > 4 << 20:
                    yield table(rows)
                    rows, size = [], 0
            yield table(rows)


def _decoded(rows):
    """One record batch of (record_id, type, page_id, refers_to, digest, block or None, whether it is an HTTP message, whole)."""
    out = []
    for name, kind, page, refers, digest, block, http, whole in rows:
        payload, valid = None, whole
        if kind == "response" and whole and not http:
            payload = block
        elif kind == "response" and whole:
            try:
                head, body = block.split(b"\r\n\r\n", 1)
                payload = unchunked(body) if b"transfer-encoding: chunked" in head.lower() else body
            except ValueError:
                valid = False
        out.append((name, kind, page, refers, digest, payload, valid))
    kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.bool_()]
    names = [x.split()[0] for x in RECORD.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*out) if out else [[]] * 7, kinds)], names=names)


def _whole(batches):
    for b in batches:
        yield _decoded(zip(*(b.column(c).to_pylist() for c in ("record_id", "type", "page_id", "refers_to", "digest", "block", "http", "ok"))))


def _joined(batches):
    """Segments sorted by origin and number: whole records."""
    held: list = []

    def close():
        first = held[0]
        blocks = [x["block"] for x in held]
        in_order = [x["segment"] for x in held] == list(range(1, len(held) + 1))
        whole = in_order and first["type"] != "continuation" and held[-1]["total"] == sum(map(len, blocks)) and all(x["ok"] for x in held)
        kind = "response" if first["type"] == "continuation" else first["type"]
        return (first["origin"], kind, first["page_id"], first["refers_to"], first["digest"], b"".join(blocks), first["http"], whole)

    for b in batches:
        done = []
        for row in b.to_pylist():
            if held and held[0]["origin"] != row["origin"]:
                done.append(close())
                held = []
            held.append(row)
        yield _decoded(done)
    if held:
        yield _decoded([close()])


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """One row per response and revisit record: its names, digest, payload and whether it is whole.

    ``valid`` is false, and the payload null, if segments are missing, repeated
    or of another total length than announced, or if the chunked framing is
    broken, a number is none, or the record is shorter than announced.  A revisit has no payload of its
    own.  ``page_id`` and ``refers_to`` are null unless the names are those of
    :func:`write_archive`; ``digest`` is null unless it is a SHA-1.  What follows
    a part of a file that cannot be unpacked is not there.
    """
    files = spark.read.format("binaryFile").load(path).select("content")
    records = files.mapInArrow(_parsed, PARSED).where("type in ('response', 'revisit', 'continuation')")
    whole = records.where("segment is null").mapInArrow(_whole, RECORD)
    parts = records.where("segment is not null").repartition("origin").sortWithinPartitions("origin", "segment")
    return whole.union(parts.mapInArrow(_joined, RECORD))


def page_records(records: DataFrame, strict: bool = False) -> DataFrame:
    """One row per record: page_id, payload_bytes, payload_digest, record_type, refers_to, valid.

    A revisit has the bytes of its response.  ``valid`` is false for a record
    that is not whole or whose payload has another digest than announced;
    ``strict`` raises for such a one instead.  A response that announces none
    has the digest of its payload.
    """
    own = records.select(
        "page_id", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("found"), "digest", "record_type", "refers_to", "valid"
    )
    own = own.withColumn("valid", F.col("valid") & F.coalesce(F.col("digest") == F.col("found"), F.lit(True)))
    own = stage(own.withColumn("digest", F.coalesce("digest", "found")), "records")
    if strict and (row := own.where("not valid").select("page_id").first()):
        raise ValueError(f"record of page {row.page_id} is not whole")
    full = own.where("record_type = 'response' and valid").groupBy(F.col("page_id").alias("refers_to"), "digest").agg(F.max("payload_bytes").alias("full"))
    return own.join(full, ["refers_to", "digest"], "left").select(
        "page_id", F.coalesce("payload_bytes", "full").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", "refers_to", "valid"
    )

"""Reassembly of segmented WARC records, and decoding of the chunked framing of their HTTP payload.

A record that was too long for one place is a first record with `WARC-Segment-Number: 1` and continuation records with
`WARC-Segment-Origin-ID`, the last of which has `WARC-Segment-Total-Length`. Records are grouped by their origin, ordered
by segment number, joined and checked against the total length; then the HTTP head is split off and the chunked
transfer coding is removed. One shuffle, by origin; a group holds one record's segments.

Defined results, in `status`: `ok`; `missing` (a segment number is absent, or the last one isn't known); `length` (the sum
isn't the total length); `conflict` (two different contents with one segment number); `framing` (malformed or truncated
chunks; the body is what was decoded before the fault). Equal segments given twice count once. A record without segment
number is whole by itself. A null record id or a segment number below 1 is dropped by records(), as the format forbids
both. A null or empty page has an empty body, and `page_id` null is kept out of the archive's names but not out of the
result. Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RECORD = "record_id string, warc_type string, target_uri string, segment_number int, origin_id string, total_length long, content binary"
RESULT = "origin_id string, target_uri string, segments int, payload_bytes long, body binary, status string"
_CRLF = b"\r\n"
PIECE = 4 << 20


def _rows(b: pa.RecordBatch, step: int = 64):
    """The rows of a batch as Python values, few at a time."""
    for at in range(0, b.num_rows, step):
        yield from zip(*(c.to_pylist() for c in b.slice(at, step).columns), strict=True)


def frame(body: bytes, chunk: int) -> bytes:
    """body under chunked transfer coding."""
    parts = [b"%x\r\n%b\r\n" % (len(x), x) for x in (body[i : i + chunk] for i in range(0, len(body), chunk))]
    return b"".join([*parts, b"0\r\n\r\n"])


def unframe(data: bytes, at: int = 0) -> tuple[bytes, bool]:
    """The body of a chunked coding that begins at `at`, and whether the framing was sound. Chunk extensions and trailers are skipped."""
    parts = []
    while True:
        eol = data.find(_CRLF, at)
        if eol < 0:
            return b"".join(parts), False
        digits = data[at:eol].split(b";", 1)[0].strip()
        if not digits or digits.strip(b"0123456789abcdefABCDEF"):
            return b"".join(parts), False
        n, at = int(digits, 16), eol + 2
        if not n:
            return b"".join(parts), data[at : at + 2] == _CRLF or data.find(b"\r\n\r\n", at) >= 0
        piece = data[at : at + n]
        parts.append(piece)
        at += n
        if len(piece) < n or data[at : at + 2] != _CRLF:
            return b"".join(parts), False
        at += 2


def body_of(payload: bytes) -> tuple[bytes, bool]:
    """The body of an HTTP response, without its head and its chunked coding."""
    end = payload.find(b"\r\n\r\n")
    if not payload.startswith(b"HTTP/") or end < 0:
        return payload, True
    head = payload[:end].lower()
    for line in head.split(_CRLF)[1:]:
        name, _, value = line.partition(b":")
        if name.strip() == b"transfer-encoding" and value.strip().endswith(b"chunked"):
            return unframe(payload, end + 4)
    return payload[end + 4 :], True


def _record(head: dict[str, object], content: bytes) -> bytes:
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items() if v is not None)
    return b"WARC/1.0\r\n" + lines.encode() + b"Content-Length: %d\r\n\r\n" % len(content) + content + b"\r\n\r\n"


def archive(pages: DataFrame, segment_bytes: int = 2048, chunk_bytes: int = 1000) -> DataFrame:
    """(archive binary): pages (page_id, url, html) as chunked HTTP responses in WARC records of at most segment_bytes, in byte strings of whole records of about PIECE bytes, with the segments of a page in falling order."""

    def run(batches):
        for b in batches:
            out, size = [], 0
            for page, key, url, html in _rows(b):
                payload = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\nTransfer-Encoding: chunked\r\n\r\n" + frame(html or b"", chunk_bytes)
                origin = f"<urn:x-page:{'null' if page is None else page}:{key & (1 << 64) - 1:016x}>"
                n = -(-len(payload) // segment_bytes)
                for k in range(n, 0, -1):
                    piece = payload[(k - 1) * segment_bytes : k * segment_bytes]
                    head = {"WARC-Type": "response" if k == 1 else "continuation", "WARC-Record-ID": origin if k == 1 else f"{origin[:-1]}:{k}>", "WARC-Target-URI": None if url is None else url.replace("\r", "%0D").replace("\n", "%0A")}
                    if n > 1:
                        head["WARC-Segment-Number"] = k
                        if k > 1:
                            head["WARC-Segment-Origin-ID"] = origin
                        if k == n:
                            head["WARC-Segment-Total-Length"] = len(payload)
                    out.append(_record(head, piece))
                    size += len(out[-1])
                    if size >= PIECE:
                        yield pa.RecordBatch.from_arrays([pa.array([b"".join(out)], pa.binary())], names=["archive"])
                        out, size = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([b"".join(out)], pa.binary())], names=["archive"])

    html = F.col("html").cast("binary")
    cols = pages.select(F.col("page_id").cast("long").alias("page_id"), F.xxhash64("page_id", "url", html).alias("key"), F.col("url").cast("string").alias("url"), html.alias("html"))
    return cols.mapInArrow(run, "archive binary")


def _parse(data: bytes):
    at = 0
    while (at := data.find(b"WARC/", at)) >= 0:
        end = data.find(b"\r\n\r\n", at)
        if end < 0:
            return
        head = {}
        for line in data[at:end].split(_CRLF)[1:]:
            name, _, value = line.partition(b":")
            head[name.strip().lower()] = value.strip().decode("utf-8", "replace")
        n = head.get(b"content-length", "")
        n = int(n) if n.isdigit() else 0
        at = end + 4 + n
        yield head, data[end + 4 : at]


def _batch(columns: list[list], schema: str) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    names = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, names, strict=True)], names=[n for n, _ in names])


def records(archives: DataFrame, column: str = "archive") -> DataFrame:
    """The records of uncompressed WARC byte strings, such as `content` of spark.read.format("binaryFile")."""

    def run(batches):
        for b in batches:
            for raw in b.column(0):
                rows, size = [[] for _ in range(7)], 0
                for head, content in _parse(raw.as_py() or b""):
                    rid, seg, total = head.get(b"warc-record-id"), head.get(b"warc-segment-number"), head.get(b"warc-segment-total-length")
                    if rid is None or (seg is not None and not (seg.isdigit() and int(seg) > 0)):
                        continue
                    row = (rid, head.get(b"warc-type"), head.get(b"warc-target-uri"), seg and int(seg), head.get(b"warc-segment-origin-id"), int(total) if total and total.isdigit() else None, content)
                    for c, v in zip(rows, row, strict=True):
                        c.append(v)
                    size += len(content)
                    if size >= PIECE:
                        yield _batch(rows, RECORD)
                        rows, size = [[] for _ in range(7)], 0
                if rows[0]:
                    yield _batch(rows, RECORD)

    return archives.select(F.col(column).alias("archive")).mapInArrow(run, RECORD)


def reassemble(found: DataFrame) -> DataFrame:
    """One row for each origin: its segments joined in order, their body and a status."""

    def run(batches):
        for b in batches:
            out, size = [[] for _ in range(6)], 0
            for origin, parts in _rows(b):
                by: dict[int, bytes] = {}
                total, status, uri = None, "ok", None
                for p in sorted(parts, key=lambda p: (p["n"], p["content"] or b"")):
                    content = p["content"] or b""
                    if by.setdefault(p["n"], content) != content:
                        status = "conflict"
                    if p["total"] is not None:
                        status = "conflict" if total not in (None, p["total"]) else status
                        total = p["total"]
                    if uri is None:
                        uri = p["uri"]
                single = all(p["alone"] for p in parts)
                payload = b"".join(by[n] for n in sorted(by))
                if status == "ok" and not single:
                    if total is None or sorted(by) != list(range(1, len(by) + 1)) or len(payload) < total:
                        status = "missing" if total is None or sorted(by) != list(range(1, len(by) + 1)) else "length"
                    elif len(payload) != total:
                        status = "length"
                body, sound = body_of(payload)
                if status == "ok" and not sound:
                    status = "framing"
                for c, v in zip(out, (origin, uri, len(by), len(payload), body, status), strict=True):
                    c.append(v)
                size += len(body)
                if size >= PIECE:
                    yield _batch(out, RESULT)
                    out, size = [[] for _ in range(6)], 0
            if out[0]:
                yield _batch(out, RESULT)

    part = F.struct(F.coalesce("segment_number", F.lit(1)).alias("n"), F.col("segment_number").isNull().alias("alone"), F.col("total_length").alias("total"), F.col("target_uri").alias("uri"), "content")
    return (
        found.filter("record_id is not null and (segment_number is null or segment_number > 0)")
        .select(F.coalesce("origin_id", "record_id").alias("origin_id"), part.alias("part"))
        .groupBy("origin_id")
        .agg(F.collect_list("part").alias("parts"))
        .mapInArrow(run, RESULT)
    )



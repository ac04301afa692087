"""WARC records as rows, their writer with rotation by size, and their reader."""

from __future__ import annotations

import gzip
import posixpath
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TYPES = ("warcinfo", "response", "resource", "request", "metadata", "revisit", "continuation")
SCHEMA = "record_id string, type string, date string, headers map<string,string>, content binary"


def record_id(seed: Column | None = None) -> Column:
    """A random id, or one that follows from seed."""
    if seed is None:
        return F.concat(F.lit("<urn:uuid:"), F.uuid(), F.lit(">"))
    h = F.sha2(seed, 256)
    cuts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cuts), F.lit(">"))


def warc_date(at: Column) -> Column:
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def fields(m: Column) -> Column:
    """A block of `name: value` lines, by name."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat(e["key"], F.lit(": "), e["value"], F.lit("\r\n"))), "")


def _record(rows: DataFrame, kind: str, rid: Column, at: Column, headers: dict[str, Column], content: Column) -> DataFrame:
    pairs = [x for k, v in headers.items() for x in (F.lit(k), v)]
    return rows.select(rid.alias("record_id"), F.lit(kind).alias("type"), warc_date(at).alias("date"), F.create_map(*pairs).alias("headers"), content.cast("binary").alias("content"))


def resource(pages: DataFrame, at: Column, mime: str = "application/http") -> DataFrame:
    """Resource records of pages (url, html)."""
    return _record(pages, "resource", record_id(F.concat(F.lit("resource:"), "url")), at, {"content-type": F.lit(mime), "warc-target-uri": F.col("url")}, F.col("html"))


def metadata(fetched: DataFrame, at: Column) -> DataFrame:
    """Metadata records of fetched (url, ttr_ms)."""
    body = F.concat(F.lit("fetchTimeMs: "), F.col("ttr_ms").cast("string"), F.lit("\r\n"))
    return _record(fetched, "metadata", record_id(F.concat(F.lit("metadata:"), "url")), at, {"content-type": F.lit("application/warc-fields"), "warc-target-uri": F.col("url")}, body)


def capture(base: DataFrame, concurrent: DataFrame) -> DataFrame:
    """concurrent with the date of the base record of the same target, and a link to it."""
    target = F.element_at("headers", "warc-target-uri")
    own = base.select(target.alias("__t"), F.col("record_id").alias("__id"), F.col("date").alias("__date"))
    linked = concurrent.join(own, target == F.col("__t"))
    headers = F.map_concat("headers", F.create_map(F.lit("warc-concurrent-to"), F.col("__id")))
    return linked.select("record_id", "type", F.col("__date").alias("date"), headers.alias("headers"), "content")


def rotation(sizes: DataFrame, most: int) -> DataFrame:
    """sizes (part, seq, n_bytes) with `bucket`: a file ends with the record that reaches `most` bytes. One pass over sorted partitions, which holds a batch at a time."""

    def fold(batches):
        last, total, bucket = None, 0, 0
        for pdf in batches:
            out = []
            for part, n in zip(pdf["part"], pdf["n_bytes"], strict=True):
                if part != last:
                    last, total, bucket = part, 0, 0
                out.append(bucket)
                total += n
                if total >= most:
                    total, bucket = 0, bucket + 1
            yield pdf.assign(bucket=out)[["part", "seq", "n_bytes", "bucket"]]

    return sizes.select("part", "seq", "n_bytes").repartition("part").sortWithinPartitions("part", "seq").mapInPandas(fold, "part long, seq long, n_bytes long, bucket long")


def serialize(kind: str, rid: str, date: str, headers: dict[str, str] | None, content: bytes) -> bytes:
    head = {"warc-type": kind, "warc-record-id": rid, "warc-date": date, **(headers or {}), "content-length": str(len(content))}
    return b"WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + content + b"\r\n\r\n"


def parse(raw: bytes):
    """(record_id, type, date, other headers, content) of each record of a file, gzipped or not."""
    data = gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw
    at = 0
    while (at := data.find(b"WARC/", at)) >= 0 and (end := data.find(b"\r\n\r\n", at)) >= 0:
        head = dict(re.findall(r"(?m)^([^:\s]+):[ \t]*(.*?)\r?$", data[at:end].decode("utf-8", "replace").partition("\n")[2]))
        head = {k.lower(): v for k, v in head.items()}
        n = int(head.pop("content-length", "0"))
        at = end + 4 + n
        yield head.pop("warc-record-id", None), head.pop("warc-type", None), head.pop("warc-date", None), head, data[end + 4 : at]


def write(records: DataFrame, folder: str, most: int = 1_000_000_000) -> DataFrame:
    """Writes records as gzipped files (a member a record) of about `most` bytes before compression, each with a warcinfo record first; returns (file, records).

    The task that writes a file names it by its partition, so a repeated task replaces its own files. `folder` is shared by all executors.
    """

    def run(batches):
        import os

        from pyspark import TaskContext

        part, bucket, out, size, n = TaskContext.get().partitionId(), 0, None, 0, 0
        os.makedirs(folder, exist_ok=True)
        done, name = [], ""

        def close():
            out.close()
            os.replace(f"{name}.open", name)
            done.append((name, n))

        for pdf in batches:
            for r in pdf.itertuples(index=False):
                if out is None:
                    name = posixpath.join(folder, f"part-{part:05d}-{bucket:05d}.warc.gz")
                    out, size, n = open(f"{name}.open", "wb"), 0, 0  # noqa: SIM115
                    out.write(gzip.compress(serialize("warcinfo", f"<urn:x-file:{part}:{bucket}>", r.date, {"content-type": "application/warc-fields"}, b""), mtime=0))
                one = serialize(r.type, r.record_id, r.date, dict(r.headers) if r.headers is not None else None, r.content or b"")
                out.write(gzip.compress(one, mtime=0))
                size, n = size + len(one), n + 1
                if size >= most:
                    close()
                    out, bucket = None, bucket + 1
        if out is not None:
            close()
        yield pd.DataFrame(done, columns=["file", "records"])

    return records.select("record_id", "type", "date", "headers", "content").mapInPandas(run, "file string, records long")


def read(spark: SparkSession, path: str) -> DataFrame:
    """The records of WARC files, gzipped or not."""

    def run(batches):
        for pdf in batches:
            rows = [x for raw in pdf["content"] for x in parse(bytes(raw))]
            yield pd.DataFrame(rows, columns=["record_id", "type", "date", "headers", "content"])

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, SCHEMA)

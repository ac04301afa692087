"""Bloom filters by host: a sketch of the seen set."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from ..sources.shared import cut

RATE = 0.01
MOST = 1_000_000  # URLs a filter; a host with more has several, by hash


def _places(h: np.ndarray, bits: int, n: int) -> np.ndarray:
    u = h.astype(np.int64).view(np.uint64)
    a, b = u & np.uint64(0xFFFFFFFF), (u >> np.uint64(32)) | np.uint64(1)
    return (a[:, None] + np.arange(max(1, round(bits / n * math.log(2))), dtype=np.uint64)[None, :] * b[:, None]) % np.uint64(bits)


def build(seen: DataFrame, rate: float = RATE, most: int = MOST) -> DataFrame:
    """(host, parts, bucket, n, bits, bloom): the filters of each host, sized for its number of distinct URLs. They are plain rows, so a table of them is their export."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        h = np.unique(pdf["h"].to_numpy())
        bits = max(64, math.ceil(len(h) * -math.log(rate) / math.log(2) ** 2))
        mask = np.zeros(bits, np.uint8)
        mask[_places(h, bits, len(h)).ravel()] = 1
        return pd.DataFrame({"host": [pdf["host"].iloc[0]], "parts": [pdf["parts"].iloc[0]], "bucket": [pdf["bucket"].iloc[0]], "n": [len(h)], "bits": [bits], "bloom": [np.packbits(mask).tobytes()]})

    urls = seen.select("host", F.xxhash64("url").alias("h")).distinct()
    parts = urls.groupBy("host").agg(F.ceil(F.count("*") / most).cast("long").alias("parts"))
    own = urls.join(parts, "host").withColumn("bucket", F.pmod("h", "parts"))
    return own.groupBy("host", "bucket").applyInPandas(one, "host string, parts long, bucket long, n long, bits long, bloom binary")


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    """The filters of two owners of disjoint hosts, as after a hand-over; a host that both have keeps those of b."""
    return a.join(b.select("host").distinct(), "host", "left_anti").unionByName(b)


def probe(urls: DataFrame, blooms: DataFrame) -> DataFrame:
    """urls with `maybe`: false only if the URL was never seen; a host without a filter has seen nothing.

    Filters and URLs are sorted together, each filter before its URLs, so a task holds one filter and a batch, whatever the host's size.
    """
    shape = StructType([*urls.schema.fields, StructField("maybe", BooleanType())])
    names = urls.columns

    def run(batches):
        group, bloom, bits, n = None, None, 0, 0
        for b in batches:
            key = b.column("g").to_numpy(zero_copy_only=False)
            first = b.column("first").to_numpy(zero_copy_only=False)
            h = b.column("h").to_numpy(zero_copy_only=False)
            out = np.zeros(len(key), bool)
            cuts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else []
            for a, z in zip(cuts, [*cuts[1:], len(key)], strict=True):
                if key[a] != group:
                    group, bloom = key[a], None
                if not first[a]:
                    bloom, bits, n = (b.column(c)[a].as_py() for c in ("bloom", "bits", "n"))
                    bloom, a = np.frombuffer(bloom, np.uint8), a + 1
                if bloom is not None and a < z:
                    at = _places(h[a:z].astype(np.int64), bits, n).astype(np.int64)
                    out[a:z] = ((bloom[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).all(1)
            asked = pa.array(np.flatnonzero(first))
            rows = b.column("row").take(asked)
            yield pa.RecordBatch.from_arrays([*rows.flatten(), pa.array(out).take(asked)], names=[*names, "maybe"])

    blooms = cut(blooms)  # read twice, built once
    parts = blooms.groupBy("host").agg(F.max("parts").alias("__parts"))
    own = urls.select("host", F.xxhash64("url").alias("h"), F.struct(*urls.columns).alias("row")).join(parts, "host", "left")
    asked = own.select(F.xxhash64("host", F.coalesce(F.pmod("h", "__parts"), F.lit(0))).alias("g"), F.lit(1).alias("first"), "h", "row")
    filters = blooms.select(F.xxhash64("host", "bucket").alias("g"), F.lit(0).alias("first"), F.lit(0).cast("long").alias("h"), "n", "bits", "bloom")
    both = filters.unionByName(asked, allowMissingColumns=True).repartition("g").sortWithinPartitions("g", "first")
    return both.mapInArrow(run, shape)

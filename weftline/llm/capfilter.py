"""Near duplicates of embeddings by spherical-cap filters.

A filter is a cap around a random direction. Directions form a product code: the turned space is cut into up to BLOCKS
blocks, each with a codebook of random unit vectors, and a direction is one codeword of every block; CODES such codes are independent. A vector belongs to
each filter whose direction its inner product exceeds `bar`; list decoding finds all of them without visiting the rest:
half sums that can't reach the bar with the best other half are dropped, and the rest is looked up in sorted
order. The codebooks grow with the number of vectors of a length so that filters outnumber them by `fill`, and the bar, from the measure of a cap in that
dimension, leaves each vector `lists` filters of each code on average, so chance meetings stay in proportion to the input. They stop growing
where a vector at cosine `least` would leave more than 1 - STAY of its neighbour's filters: from there on filters fill up instead, so that recall
does not fall with the number of vectors (64 dimensions and cosine .95: from some 2 million on). Below NARROW dimensions a direction is one codeword.
Postings carry a vector's number and SIGNS signs of random projections, not the vector. Of two vectors that share a filter the signs must agree about as
often as at cosine `least` (a closer pair fails this once in a million); only such pairs are joined with their vectors and verified by their cosine.

Equal vectors are folded first, so copies cost one row. Links between different vectors are all kept, as they are counted. Only vectors of equal length are compared.

Defined results. Null, empty, zero and non-finite embeddings (or with a null in them) are nobody's duplicate and have no row. Rows are the distinct pairs of
vec_id and embedding; repeated rows are one. A group is a connected component of close vectors; its keeper is the smallest vec_id (null last; of equal ones
the smallest hash of the vector). Extra columns are ignored.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .session import cut

BLOCKS = 2
CODES = 3
NARROW = 8
STAY = 0.4
SEED = 31
SIGNS = 128


@lru_cache(64)
def _angles(dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Angles to a direction, their density on the sphere, and the share of the sphere within each."""
    a = np.linspace(0, np.pi, 50_001)
    f = np.exp((dim - 2) * np.log(np.maximum(np.sin(a), 1e-300)))
    c = np.concatenate([[0], np.cumsum((f[1:] + f[:-1]) / 2)])
    return a, f, c / c[-1]


def cap(dim: int, t) -> np.ndarray:
    """The share of the unit sphere whose inner product with a direction exceeds t."""
    if dim == 1:
        return np.where(np.less(t, -1), 1, np.where(np.less(t, 1), 0.5, 0))
    a, _, c = _angles(dim)
    return np.interp(np.arccos(np.clip(t, -1, 1)), a, c)


def bar_of(dim: int, share: float) -> float:
    """The inner product with a direction that the given share of the unit sphere exceeds."""
    if dim == 1:
        return 0.0
    a, _, c = _angles(dim)
    return float(np.cos(np.interp(share, c, a)))


def stays(dim: int, least: float, bar: float) -> float:
    """The chance that a vector at cosine `least` from one in a cap is in the cap as well."""
    if dim == 1:
        return 1.0
    a, f, _ = _angles(dim)
    at = np.unique(np.linspace(0, max(1, np.searchsorted(a, np.arccos(bar))), 1000).astype(int))
    need = (bar - least * np.cos(a[at])) / np.maximum(np.sqrt(max(0, 1 - least**2)) * np.sin(a[at]), 1e-12)
    return float(np.trapezoid(f[at] * cap(dim - 1, need), a[at]) / np.trapezoid(f[at], a[at]))


def book_size(dim: int, n: int, least: float, lists: float, fill: float) -> int:
    """Codewords a block for n vectors."""
    lo, hi = 0.0, 1 - 1e-6
    for _ in range(30):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if stays(dim, least, mid) >= STAY else (lo, mid)
    total = min(fill * max(n, 1), lists / max(float(cap(dim, lo)), 1e-300))
    return max(4, int(np.ceil(total ** (1 / _blocks(dim)))))


def _blocks(dim: int) -> int:
    return 1 if dim < NARROW else BLOCKS


def unit(vectors: DataFrame) -> DataFrame:
    """(vec_id, vh, dim, v): unit vectors as bytes with their hash; unusable ones are left out."""

    def run(batches):
        for b in batches:
            col = b.column(1)
            if not len(col):
                continue
            size = np.diff(col.offsets.to_numpy())
            flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            size = np.where(np.asarray(col.is_null()), 0, size)
            at = np.cumsum(size) - size
            ok = size > 0
            sums = np.zeros(len(size))
            if len(flat):
                sums[ok] = np.add.reduceat(flat**2, at[ok])
            ok &= np.isfinite(sums) & (sums > 0)
            rows = np.flatnonzero(ok)
            flat = (flat / np.sqrt(np.repeat(np.where(ok, sums, 1), size))).astype(np.float32)
            out = [flat[at[i] : at[i] + size[i]].tobytes() for i in rows]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows)), pa.array(size[rows], pa.int32()), pa.array(out, pa.binary())], names=["vec_id", "dim", "v"])

    own = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e"))
    return own.mapInArrow(run, "vec_id long, dim int, v binary").withColumn("vh", F.xxhash64("dim", "v")).dropDuplicates(["vec_id", "vh"])


class Code:
    """The product code for one dimension."""

    def __init__(self, dim: int, which: int, size: int, lists: float):
        rng = np.random.default_rng([SEED, dim, which])
        self.turn = np.linalg.qr(rng.standard_normal((dim, dim)))[0].astype(np.float32)
        self.m = _blocks(dim)
        self.size = size
        self.cuts = np.linspace(0, dim, self.m + 1).astype(int)
        self.books = []
        for a, b in zip(self.cuts[:-1], self.cuts[1:], strict=True):
            c = rng.standard_normal((b - a, size))
            self.books.append((c / np.linalg.norm(c, axis=0) * np.sqrt((b - a) / dim)).astype(np.float32))
        total = size**self.m
        self.bar = bar_of(dim, min(0.5, lists / total))

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, filter) of every filter that a row of x exceeds."""
        y = x @ self.turn
        p = [y[:, a:b] @ c for a, b, c in zip(self.cuts[:-1], self.cuts[1:], self.books, strict=True)]
        n = len(x)

        def half(parts):
            s = np.zeros((n, 1), np.float32)
            for q in parts:
                s = (s[:, :, None] + q[:, None, :]).reshape(n, -1)
            return s

        left, right = half(p[: self.m // 2]), half(p[self.m // 2 :])
        order = np.argsort(-right, 1, kind="stable")
        ranked = np.take_along_axis(right, order, 1)
        row, i = np.nonzero(left >= self.bar - ranked[:, :1])
        need = self.bar - left[row, i]
        # one search serves all rows: each row's sums, rising, are lifted by its number
        lift = 8.0
        keys = (ranked[:, ::-1].astype(np.float64) + lift * np.arange(n)[:, None]).ravel()
        w = right.shape[1]
        found = (row + 1) * w - np.searchsorted(keys, need.astype(np.float64) + lift * row, "left")
        found = np.clip(found, 0, w)
        who = np.repeat(np.arange(len(row)), found)
        j = order[row[who], np.arange(len(who)) - np.repeat(np.cumsum(found) - found, found)]
        return row[who], i[who].astype(np.int64) * w + j


def differing(least: float) -> int:
    """Signs in which a pair at cosine `least` may differ, so that one in a million differs in more."""
    p, n = np.arccos(np.clip(least, -1, 1)) / np.pi, SIGNS
    logs = np.cumsum(np.r_[0, np.log(np.arange(1, n + 1))])
    k = np.arange(n + 1)
    mass = np.exp(logs[n] - logs[k] - logs[n - k] + k * np.log(max(p, 1e-300)) + (n - k) * np.log1p(-min(p, 1 - 1e-16)))
    return int(np.searchsorted(np.cumsum(mass), 1 - 1e-6))


def postings(prints: DataFrame, least: float, lists: float, fill: float) -> DataFrame:
    """(dim, key, fid, s0, s1): a row for each filter of each vector, with the vector's signs."""
    size = {r["dim"]: book_size(r["dim"], r["count"], least, lists, fill) for r in prints.groupBy("dim").count().collect()}

    def run(batches):
        codes, sides = {}, {}
        for b in batches:
            dims, raw, fid = b.column("dim").to_numpy(), b.column("v"), b.column("fid")
            for dim in np.unique(dims).tolist():
                if dim not in codes:
                    codes[dim] = [Code(dim, c, size[dim], lists) for c in range(CODES)]
                    sides[dim] = np.random.default_rng([SEED, dim, CODES]).standard_normal((dim, SIGNS)).astype(np.float32)
                own = np.flatnonzero(dims == dim)
                for at in range(0, len(own), 256):
                    part = own[at : at + 256]
                    x = np.frombuffer(b"".join(raw.take(pa.array(part)).to_pylist()), np.float32).reshape(len(part), -1)
                    signs = np.packbits(x @ sides[dim] > 0, axis=1).view(np.int64)
                    found = [code.decode(x) for code in codes[dim]]
                    row = np.concatenate([r for r, _ in found])
                    key = np.concatenate([key * CODES + c for c, (_, key) in enumerate(found)])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(row), dim), pa.int32()), pa.array(key, pa.int64()), fid.take(pa.array(part[row])), pa.array(signs[row, 0]), pa.array(signs[row, 1])], names=["dim", "key", "fid", "s0", "s1"]
                    )

    return prints.select("fid", "dim", "v").mapInArrow(run, "dim int, key long, fid long, s0 long, s1 long")


def links(prints: DataFrame, least: float, lists: float, fill: float) -> DataFrame:
    """(a, b), a < b: the close pairs of different vectors that share a filter; prints are (fid, dim, v)."""

    def verify(batches):
        for b in batches:
            size = b.column("dim").to_numpy()
            x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.float32) for c in ("va", "vb"))
            at = np.cumsum(size) - size
            keep = pa.array(np.flatnonzero(np.add.reduceat(x.astype(np.float64) * y, at) >= least) if len(at) else at)
            yield pa.RecordBatch.from_arrays([b.column("a").take(keep), b.column("b").take(keep)], names=["a", "b"])

    own = postings(prints, least, lists, fill)
    apart = F.bit_count(F.col("x.s0").bitwiseXOR(F.col("y.s0"))) + F.bit_count(F.col("x.s1").bitwiseXOR(F.col("y.s1")))
    met = own.alias("x").join(own.alias("y"), (F.col("x.dim") == F.col("y.dim")) & (F.col("x.key") == F.col("y.key")) & (F.col("x.fid") < F.col("y.fid")) & (apart <= differing(least)))
    met = met.select(F.col("x.fid").alias("a"), F.col("y.fid").alias("b")).distinct()
    met = met.join(prints.select(F.col("fid").alias("a"), "dim", F.col("v").alias("va")), "a").join(prints.select(F.col("fid").alias("b"), F.col("v").alias("vb")), "b")
    return met.select("a", "b", "dim", "va", "vb").mapInArrow(verify, "a long, b long")


def groups(vectors: DataFrame, least: float = 0.95, lists: float = 12, fill: float = 4) -> DataFrame:
    """(vec_id, group, links, copies, kept), a row for each usable vector: group is the vec_id of the one that its group keeps, links the number of other
    vectors close to it, copies that of other rows with the same vector."""
    rows = cut(unit(vectors))
    prints = cut(rows.groupBy(F.col("vh").alias("fid")).agg(F.min("dim").alias("dim"), F.min("v").alias("v"), F.count("*").alias("size")))
    pairs = cut(links(prints, least, lists, fill))
    labels = components(pairs)
    ends = pairs.select(F.col("a").alias("fid")).unionAll(pairs.select(F.col("b").alias("fid"))).groupBy("fid").agg(F.count("*").alias("links"))
    about = prints.select("fid", "size").join(labels, "fid", "left").join(ends, "fid", "left")
    about = about.select("fid", F.coalesce("label", "fid").alias("comp"), F.coalesce("links", F.lit(0).cast("long")).alias("links"), (F.col("size") - 1).alias("copies"))
    joined = cut(rows.select("vec_id", "vh").join(about, F.col("vh") == F.col("fid")).drop("fid"))
    best = joined.groupBy("comp").agg(F.min(F.struct(F.col("vec_id").isNull().alias("z"), "vec_id", "vh")).alias("k"))
    kept = F.col("vec_id").eqNullSafe(F.col("k.vec_id")) & (F.col("vh") == F.col("k.vh"))
    return joined.join(best, "comp").select("vec_id", F.col("k.vec_id").alias("group"), "links", "copies", kept.alias("kept"))

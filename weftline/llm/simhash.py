"""Near duplicates by SimHash: every pair of fingerprints within `most` bits, by pigeonring chains that start at covered segments.

A text's features are its distinct case-folded words; its fingerprint has BITS bits.
These are cut into segments on a ring, and each may differ in so many bits that these numbers, each plus one, add up to `most` + 1. If two fingerprints differ in at most
`most` bits, some segment starts a chain in which every run of segments from there keeps the sum of its numbers plus one, less one bit (the pigeonring principle); of the whole
ring that is the Hamming check itself. The first segment of a chain may differ, too, in up to t bits. So each of its bits gets a code of t + 1 bits, and each of the 2^(t + 1) - 1
masks holds the bits whose codes have an odd number of ones in common with its number. The codes of t bits leave out some dimension, hence some mask meets none of the
differing bits, and the two agree on it: no pair is missed (covering, Pagh 2016). A mask holds about half of a segment, and segments widen with the number of rows, so that
chance meetings stay few. Of the masks and segments that find a pair, the first gives it.

A task holds up to TASK rows and some of the masks; it sorts the rows under each of them. More fingerprints are cut into blocks, and every two blocks meet in a task.
Equal fingerprints are folded into one before the search, so thousands of exact copies cost one row.

Defined results. Documents are the distinct pairs of doc_id and text: repeated rows are one document and share its row.
Null, empty and wordless texts have no fingerprint and are nobody's duplicate. A group is a connected component of
close pairs; its keeper is the smallest doc_id (a null one is last; of equal ones the smallest hash of the text). Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textcore as T
from .components import components
from .session import cut, without

BITS = 256
WORDS = BITS // 64
ROWS = 20  # bits that number the rows of a slice
TASK = 1 << 20  # rows that a task of the search holds
TASKS = 12  # tasks of the search, unless there are more pairs of blocks
WORK = 1 << 20  # rows times masks that are worth a task


def width_of(n: int) -> int:
    """Bits of a segment for n rows of a task: half of them are in a mask, so that some n keys may differ."""
    return min(64, max(16, int(2 * np.log2(max(n, 2)))))


def ring(width: int, most: int) -> list[tuple[int, int, int]]:
    """(first bit, last bit + 1, number of bits that may differ) of each segment; -1 where no chain starts. Narrower ones where over 10 bits might differ."""
    n = max(BITS // width, -(-(most + 1) // 11))
    return [(k * BITS // n, (k + 1) * BITS // n, (most + 1) // n + (k < (most + 1) % n) - 1) for k in range(n)]


@lru_cache(64)
def masks_of(bits: int, may: int, tries: int = 1000) -> np.ndarray:
    """Masks over a segment of so many bits, one of which meets none of any `may` bits; codes are drawn, then changed one by one, until masks are about as wide as each other."""
    if may < 1:
        return np.full(may + 1, (1 << bits) - 1, np.uint64)
    rng = np.random.default_rng(20)
    number = np.arange(1, 2 << may)
    odd = lambda code: np.bitwise_count(number[:, None] & code) & 1
    best, least = None, np.inf
    for k in range(tries):
        if k < tries // 4:
            code = np.concatenate([rng.permutation(number) for _ in range(-(-bits // len(number)))])[:bits]
        else:
            code = best.copy()
            code[rng.integers(bits)] = rng.choice(number)
        cost = np.ldexp(1.0, -odd(code).sum(1, dtype=int)).sum()
        if cost < least:
            best, least = code, cost
    return (odd(best).astype(np.uint64) << np.arange(bits, dtype=np.uint64)).sum(1, dtype=np.uint64)


def distinct_words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and 44-bit hash of each row's distinct words, by row."""
    _, _, row, h = T.words(data, offs)
    both = np.sort(row.astype(np.uint64) << np.uint64(64 - ROWS) | h >> np.uint64(ROWS))
    both = both[np.r_[True, both[1:] != both[:-1]]] if len(both) else both
    return (both >> np.uint64(64 - ROWS)).astype(np.int64), both & np.uint64((1 << 64 - ROWS) - 1)


def fingerprints(data: np.ndarray, offs: np.ndarray, block: int = 1 << 14) -> tuple[np.ndarray, np.ndarray]:
    """(rows, WORDS) fingerprints and the number of distinct words, for less than 2**ROWS rows."""
    n = len(offs) - 1
    row, h = distinct_words(data, offs)
    sums = np.zeros((n, BITS), np.int32)
    for at in range(0, len(h), block):
        part, r = h[at : at + block], row[at : at + block]
        full = np.stack([T.mix(part + np.uint64(k * 0x632BE59BD9B4E019 & (1 << 64) - 1)) for k in range(WORDS)], 1)
        bits = np.unpackbits(full.view(np.uint8).reshape(len(part), -1), axis=1, bitorder="little")
        first = np.flatnonzero(np.r_[True, r[1:] != r[:-1]])
        sums[r[first]] += T.run_sums(bits, np.diff(np.r_[first, len(r)]))
    count = np.bincount(row, minlength=n)
    bits = (2 * sums > count[:, None]).astype(np.uint8)
    return np.ascontiguousarray(np.packbits(bits, axis=1, bitorder="little")).view(np.uint64), count


def fingerprint(docs: DataFrame) -> DataFrame:
    """(doc_id, th, f0..f3): th hashes the text, and with doc_id it names the document; f* are null without words."""
    names = [f"f{k}" for k in range(WORDS)]

    def run(batches):
        for rows, data, offs in T.chunks(batches):
            fp, count = fingerprints(data, offs)
            none = count == 0
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), rows.column(1), *(pa.array(fp[:, k].view(np.int64), pa.int64(), mask=none) for k in range(WORDS))],
                names=["doc_id", "th", *names],
            )

    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text")).mapInArrow(
        run, "doc_id long, th long, " + ", ".join(f"{x} long" for x in names)
    )


def segment(fp: np.ndarray, first: int, end: int) -> np.ndarray:
    """Bits first to end of each fingerprint, 64 at most."""
    k, at = divmod(first, 64)
    x = fp[:, k] >> np.uint64(at)
    if at + end - first > 64:
        x |= fp[:, k + 1] << np.uint64(64 - at)
    return x & np.uint64((1 << end - first) - 1)


def starts(apart: np.ndarray, parts: list[tuple[int, int, int]], at: int) -> np.ndarray:
    """Whether a chain starts at a segment, by the differing bits (rows, WORDS); it goes round the whole ring, so all of them are within `most`."""
    ok, run, room = np.ones(len(apart), bool), np.zeros(len(apart), np.int32), -1
    for first, end, may in parts[at:] + parts[:at]:
        run += np.bitwise_count(segment(apart, first, end))
        room += may + 1
        ok &= run <= room
    return ok


def owned(fp: np.ndarray, a: np.ndarray, b: np.ndarray, parts: list[tuple[int, int, int]], masks: np.ndarray, p: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs with a chain from segment p on, but from none before it, and with none of the masks, which are those before their own."""
    apart = fp[a] ^ fp[b]
    ok = np.bitwise_count(apart).sum(1, dtype=np.int32) <= sum(may + 1 for _, _, may in parts) - 1
    a, b, apart = a[ok], b[ok], apart[ok]
    for mask in masks:
        if not len(a):
            break
        ok = segment(apart, *parts[p][:2]) & mask != 0
        a, b, apart = a[ok], b[ok], apart[ok]
    ok = starts(apart, parts, p)
    for q in range(p):
        ok &= ~starts(apart, parts, q)
    return a[ok], b[ok]


def search(fp: np.ndarray, side: np.ndarray | None, parts: list[tuple[int, int, int]], masks: list[np.ndarray], share: int, shares: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of the pairs that the masks numbered share, share + shares, ... give, each pair of one mask only; with sides, only pairs between them."""
    n = len(fp)
    low = np.uint64((1 << n.bit_length()) - 1)
    row = np.arange(n, dtype=np.uint64)
    number = -1
    for p, (first, end, may) in enumerate(parts):
        seg = segment(fp, first, end)
        for v, mask in enumerate(masks[p]):
            number += 1
            if number % shares != share:
                continue
            key = seg & mask
            key *= np.uint64(T._P)
            key &= ~low
            key |= row
            key.sort()
            at, step, met, size = np.flatnonzero((key[1:] ^ key[:-1]) <= low), 1, [], 0
            while len(at):
                a, b = (key[at] & low).astype(np.int64), (key[at + step] & low).astype(np.int64)
                ok = np.bitwise_count(seg[a] ^ seg[b]) <= may
                if side is not None:
                    ok &= side[a] != side[b]
                met.append((a[ok], b[ok]))
                size += len(met[-1][0])
                step += 1
                at = at[: np.searchsorted(at, n - step)]
                at = at[(key[at] ^ key[at + step]) <= low]
                if size and (size > 1 << 18 or not len(at)):
                    yield owned(fp, *map(np.concatenate, zip(*met, strict=True)), parts, masks[p][:v], p)
                    met, size = [], 0


def close_pairs(prints: DataFrame, most: int, recall: float) -> DataFrame:
    """(a, b) fids of all distinct fingerprints within `most` bits, a < b; `recall` is what a caller asks for at least, and all pairs are more."""
    n = prints.count()
    blocks = 1 if n <= TASK else -(-2 * n // TASK)
    parts = ring(width_of(min(n, TASK)), most)
    masks = [masks_of(end - first, may) for first, end, may in parts]
    met = blocks * (blocks + 1) // 2
    shares = min(-(-TASKS // met), -(-min(n, TASK) * sum(map(len, masks)) // WORK) or 1)
    names = [f"f{k}" for k in range(WORDS)]

    def run(batches):
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        task = got[0].column("task")[0].as_py()
        assert all(pc.all(pc.equal(b.column("task"), task)).as_py() for b in got)
        fp = np.empty((sum(b.num_rows for b in got), WORDS), np.uint64)
        for k, name in enumerate(names):
            fp[:, k] = np.concatenate([b.column(name).to_numpy() for b in got]).view(np.uint64)
        fid = np.concatenate([b.column("fid").to_numpy() for b in got])
        block = np.concatenate([b.column("block").to_numpy() for b in got])
        got.clear()
        second = int((np.sqrt(8 * (task // shares) + 1) - 1) / 2)  # of two blocks; the first is equal or less
        inner = task // shares == second * (second + 1) // 2 + second
        for a, b in search(fp, None if inner else block == second, parts, masks, task % shares, shares):
            a, b = fid[a], fid[b]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    # of two blocks i <= j, task (j * (j + 1) / 2 + i) * shares + share
    rows = prints.select("fid", *names, F.pmod("fid", F.lit(blocks)).cast("int").alias("block"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(blocks * shares - 1))).alias("x")).withColumn("other", F.expr(f"cast(x div {shares} as int)"))
    task = f"cast((greatest(block, other) * (greatest(block, other) + 1) div 2 + least(block, other)) * {shares} + x % {shares} as int)"
    rows = rows.select("fid", *names, "block", F.expr(task).alias("task"))
    return rows.repartitionById(met * shares, "task").mapInArrow(run, "a long, b long")


def classes(docs: DataFrame, most: int = 40, recall: float = 0.95) -> DataFrame:
    """(doc_id, th, group, links, copies, kept): every document with words; th is the hash of its text, group the doc_id of the one document
    of its class that stays, links the number of other fingerprints close to its own, copies that of other documents with the same."""
    prints = cut(fingerprint(docs).filter("f0 is not null").distinct())
    own = prints.withColumn("fid", F.xxhash64(*(f"f{k}" for k in range(WORDS))))
    distinct = cut(own.groupBy("fid").agg(*(F.min(f"f{k}").alias(f"f{k}") for k in range(WORDS)), F.count("*").alias("size")))
    pairs = cut(close_pairs(distinct, most, recall))
    labels = components(pairs)
    ends = pairs.select(F.col("a").alias("fid")).unionAll(pairs.select(F.col("b").alias("fid"))).groupBy("fid").agg(F.count("*").alias("links"))
    about = distinct.select("fid", "size").join(labels, "fid", "left").join(ends, "fid", "left")
    about = about.select("fid", F.coalesce("label", "fid").alias("comp"), F.coalesce("links", F.lit(0).cast("long")).alias("links"), (F.col("size") - 1).alias("copies"))
    joined = cut(own.select("doc_id", "th", "fid").join(about, "fid").drop("fid"))
    best = joined.groupBy("comp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "th")).alias("k"))
    kept = F.col("doc_id").eqNullSafe(F.col("k.doc_id")) & (F.col("th") == F.col("k.th"))
    return joined.join(best, "comp").select("doc_id", "th", F.col("k.doc_id").alias("group"), "links", "copies", kept.alias("kept"))


def groups(docs: DataFrame, most: int = 40, recall: float = 0.95) -> DataFrame:
    """(doc_id, group, links, copies, kept), one row a document with words; a document without a near duplicate is a group of its own."""
    return classes(docs, most, recall).drop("th")


def drop(docs: DataFrame, most: int = 40, recall: float = 0.95) -> DataFrame:
    """docs without all but one document of each group; of rows repeated with doc_id and text, all go or stay."""
    return without(docs, classes(docs, most, recall).filter("not kept"))

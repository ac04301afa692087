"""Vectorised text access for the Arrow workers: bytes, folded case, word spans and word hashes.

Texts stay in Arrow's own UTF-8 buffer; every helper works on whole chunks of rows with numpy, so no
Python code runs per row. A null text reads as an empty one.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

CHUNK = 2 << 20

_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = True
_WORD[128:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_P = 0x9E3779B97F4A7C15
_POW = np.ones(1, np.uint64)
BLOCK = 1 << 16
_BACK = np.full(BLOCK + 1, pow(_P, -1, 1 << 64), np.uint64)
_BACK[0] = 1
_BACK = np.multiply.accumulate(_BACK)


def powers(n: int) -> np.ndarray:
    """The first n powers of the hash base modulo 2**64, kept between calls up to 1M."""
    global _POW
    if n <= len(_POW):
        return _POW[:n]
    p = np.full(n, _P, np.uint64)
    p[0] = 1
    p = np.multiply.accumulate(p)
    if n <= 1 << 20:
        _POW = p
    return p


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (the public-domain splitmix64 one)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def uniform(h: np.ndarray) -> np.ndarray:
    """Numbers strictly between 0 and 1 from 64-bit hashes."""
    return ((h >> np.uint64(12)).astype(np.float64) + 0.5) * 2.0**-52


def chunks(batches: Iterable[pa.RecordBatch], size: int = CHUNK) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Rows, text bytes and row offsets, in runs of rows of about `size` bytes; a longer text is a run of its own."""
    for batch in batches:
        text = batch.column(batch.schema.get_field_index("text"))
        if pa.types.is_dictionary(text.type):
            text = text.dictionary_decode()
        if not (pa.types.is_string(text.type) or pa.types.is_large_string(text.type)):
            text = text.cast(pa.string())
        if text.null_count:
            text = text.fill_null("")
        n = len(text)
        if not n:
            continue
        kind = np.int64 if pa.types.is_large_string(text.type) else np.int32
        _, offs, raw = text.buffers()
        offs = np.frombuffer(offs, kind, n + 1, text.offset * np.dtype(kind).itemsize).astype(np.int64)
        raw = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
        at = 0
        while at < n:
            to = max(at + 1, int(np.searchsorted(offs, offs[at] + size, "right")) - 1)
            yield batch.slice(at, to - at), raw[offs[at] : offs[to]], offs[at : to + 1] - offs[at]
            at = to


def fold(data: np.ndarray) -> np.ndarray:
    """Lower case for ASCII and for the accented Latin-1 letters."""
    low = _LOWER[data]
    at = np.flatnonzero(data[:-1] == 0xC3) + 1
    nxt = low[at]
    low[at[(nxt >= 0x80) & (nxt <= 0x9E) & (nxt != 0x97)]] += 0x20
    return low


def spans(data: np.ndarray, offs: np.ndarray, word: np.ndarray = _WORD) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of word bytes; a run never crosses a row."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    m = word[data]
    edge = np.empty(len(m) + 1, bool)
    edge[1:-1] = m[1:] != m[:-1]
    edge[0], edge[-1] = m[0], m[-1]
    cut = offs[1:-1]
    cut = cut[(cut > 0) & (cut < len(m))]
    cut = np.unique(cut[m[cut] & m[cut - 1]])
    at = np.flatnonzero(edge)
    if len(cut):
        at = np.sort(np.concatenate([at, cut, cut]))
    return at[::2], at[1::2]


def span_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans that don't overlap, follow each other and hold at least a byte."""
    out = np.empty(len(start), np.uint64)
    at = 0
    while at < len(start):
        base = int(start[at])
        to = max(at + 1, int(np.searchsorted(end, base + BLOCK, "right")))
        n = int(end[to - 1]) - base
        v = np.zeros(n + 1, np.uint64)
        v[:n] = data[base : base + n]
        v[:n] += np.uint64(1)
        v[:n] *= powers(n)
        cuts = np.empty(2 * (to - at), np.int64)
        cuts[::2], cuts[1::2] = start[at:to] - base, end[at:to] - base
        # powers count from the block's first byte; dividing by the span's own first power makes them count from the span's
        out[at:to] = np.add.reduceat(v, cuts)[::2] * (_BACK[cuts[::2]] if to > at + 1 else np.uint64(1))
        at = to
    return mix(out)


class Lookup:
    """Places of hashes in a sorted array of distinct ones, by a table over their leading bits."""

    def __init__(self, known: np.ndarray):
        self.known = known
        bits = min(20, max(8, 5 + int(len(known)).bit_length()))
        self.shift = np.uint64(64 - bits)
        heads = np.arange(1 << bits, dtype=np.uint64) << self.shift
        self.first = np.r_[np.searchsorted(known, heads), len(known)].astype(np.int32)
        self.most = int(np.diff(self.first).max(initial=0))

    def find(self, h: np.ndarray) -> np.ndarray:
        """The place of each hash, or -1."""
        out = np.full(len(h), -1, np.int64)
        slot = (h >> self.shift).astype(np.int64)
        at, last = self.first[slot], self.first[slot + 1]
        for _ in range(self.most):
            on = np.flatnonzero(at < last)
            hit = on[self.known[at[on]] == h[on]]
            out[hit] = at[hit]
            at[on] += 1
        return out


def words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word starts, ends, rows and hashes, case folded; words are runs of letters, digits and non-ASCII."""
    start, end = spans(data, offs)
    return start, end, np.searchsorted(offs, start, "right") - 1, span_hash(fold(data) if len(data) else data, start, end)


def hash_words(text: str) -> np.ndarray:
    """The hashes of one string's words."""
    raw = np.frombuffer(text.encode(), np.uint8)
    return words(raw, np.array([0, len(raw)]))[3]


def segment_sum(v: np.ndarray, seg: np.ndarray, n: int) -> np.ndarray:
    """Sums of the rows of v by segment number."""
    if v.ndim == 1:
        return np.bincount(seg, v, n)
    return np.stack([np.bincount(seg, v[:, k], n) for k in range(v.shape[1])], 1)


def run_sums(table: np.ndarray, size: np.ndarray, part: int = 128, step: int = 4096) -> np.ndarray:
    """Sums of the rows of a uint8 table of zeros and ones over runs of rows, which follow each other. Runs are walked side by side, a long one in parts."""
    n_parts = -(-size // part)
    own = np.full(int(n_parts.sum()), part)
    own[(np.cumsum(n_parts) - 1)[n_parts > 0]] = (size - (n_parts - 1) * part)[n_parts > 0]
    order = np.argsort(-own, kind="stable")
    start, own = (np.cumsum(own) - own)[order], own[order]
    small = np.zeros((len(own), table.shape[1]), table.dtype)
    for k in range(int(own.max(initial=0))):
        n = int(np.searchsorted(-own, -k))
        for a in range(0, n, step):
            small[a : min(n, a + step)] += table[start[a : min(n, a + step)] + k]
    back = np.empty(len(own), np.int64)
    back[order] = np.arange(len(own))
    total = np.zeros((len(size), table.shape[1]), np.int32)
    first = np.cumsum(n_parts) - n_parts
    for k in range(int(n_parts.max(initial=0))):
        rows = np.flatnonzero(n_parts > k)
        total[rows] += small[back[first[rows] + k]]
    return total


def record(schema: pa.Schema, *cols) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)


def lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column from flat values and the length of each list."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(values, kind))

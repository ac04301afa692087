"""Benchmark decontamination by latent semantic retrieval and alignment.

A first pass writes every document as word numbers of the benchmark's vocabulary (0 for other words, which can match no
item). Documents are cut into blocks of BLOCK words; a passage is a block or two neighbouring ones, so each place is in
several passages. Weights are tf-idf with frequencies over all blocks, less a floor that silences words in more than a share
`common` of the blocks; each item's rarest words, up to a third of its length, keep a weight all the same. The latent space is a randomised
SVD of the blocks of all documents together with the items: a random test matrix goes once through A^T A in a distributed
pass, and the Nystrom form of the product gives the leading singular vectors. Every passage is then compared with every item in
the latent space, as products of blocks of rows; the items at a cosine of `near` or more are its candidates, and so are those of which its surroundings
hold as many weighted words as a copy must have.

A candidate's surroundings (the passage and an item's length on either side) are aligned with the item by their longest common
subsequence of words. A share of `copy` is a copy. From `paraphrase` on, the answer must be there too: the share `answer` of the
item's answer, which is what follows "answer:", else its last third, is in the subsequence; and so must be half of its weighted words.
What can't pass any more is not aligned: an alignment takes no more of the weighted words, and of all words, than the surroundings hold.
A copy lacks at most a fifth of the words, so some of its weighted ones are always there, and no copy is missed.

Defined results. One row for each document and item, at its best place: the largest share, of equal ones that with the larger cosine, then the first. Documents are rows, so repeated rows give repeated results. Null, empty and wordless texts and items
give none. Items with equal texts are all reported. A null doc_id or item_id stays null. Extra columns are ignored. No benchmark or no
documents: no rows.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textcore as T
from .session import cut, without

BLOCK = 32
LEAST = 1 / 3  # of an item's words keep a weight
FAN = 8  # arrays that a task adds up
LONG = 64
SCHEMA = "doc_id long, th long, item_id long, start_word int, cosine double, lcs double, kind string"


@dataclass
class Items:
    ids: list
    codes: list[np.ndarray]  # word numbers from 1
    answers: list[int]  # where the answer begins
    vocab: np.ndarray  # sorted hashes

    @property
    def kind(self):
        return np.uint16 if len(self.vocab) < 65535 else np.uint32


def items(benchmark: DataFrame) -> Items:
    """The benchmark on the driver: it is a query set, whose size doesn't follow the corpus."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("text <> ''").toArrow().to_pylist()
    rows = sorted((r for r in rows), key=lambda r: (r["item_id"] is None, r["item_id"] or 0, r["text"]))
    found = [(r["item_id"], T.hash_words(r["text"]), r["text"]) for r in rows]
    found = [x for x in found if len(x[1])]
    vocab = np.unique(np.concatenate([h for _, h, _ in found])) if found else np.zeros(0, np.uint64)
    answers = []
    for _, h, text in found:
        mark = list(re.finditer(r"(?i)\banswer\s*:", text))
        after = len(T.hash_words(text[mark[-1].end() :])) if mark else 0
        answers.append(len(h) - (after or max(1, len(h) // 3)))
    return Items([x[0] for x in found], [np.searchsorted(vocab, h) + 1 for _, h, _ in found], answers, vocab)


def encode(docs: DataFrame, own: Items) -> DataFrame:
    """(doc_id, th, codes): the word numbers of each document that holds any, as bytes."""
    vocab, kind = own.vocab, own.kind

    def run(batches):
        known = T.Lookup(vocab)
        for rows, data, offs in T.chunks(batches):
            _, _, row, h = T.words(data, offs)
            if not len(h) or not len(vocab):
                continue
            code = (known.find(h) + 1).astype(kind)
            some = np.unique(row[code > 0])
            bounds = np.searchsorted(row, np.arange(rows.num_rows + 1))
            raw = [code[bounds[i] : bounds[i + 1]].tobytes() for i in some]
            pick = pa.array(some)
            yield pa.RecordBatch.from_arrays([rows.column(0).take(pick), rows.column(1).take(pick), pa.array(raw, pa.binary())], names=["doc_id", "th", "codes"])

    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text")).filter("text <> ''").mapInArrow(run, "doc_id long, th long, codes binary")


def _blocks(batch: pa.RecordBatch, kind) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All word numbers, the bounds of the rows, and the first block and the number of blocks of each row."""
    raw = batch.column("codes")
    parts = [np.frombuffer(x, kind) for x in raw.to_pylist()]
    n = np.array([len(p) for p in parts], np.int64)
    count = -(-n // BLOCK)
    return (np.concatenate(parts) if parts else np.zeros(0, kind)).astype(np.int64), np.r_[0, np.cumsum(n)], np.cumsum(count) - count, count


def _pieces(batches, words: int = 1 << 18):
    """The batches in slices of whole rows of about `words` words, so that what is held for one stays small."""
    for b in batches:
        if not b.num_rows:
            continue
        size = pc.binary_length(b.column("codes")).to_numpy(zero_copy_only=False)
        for a, z in _parts(np.maximum(size, 1), 2 * words):
            if z > a:
                yield b.slice(a, z - a)


def _terms(code: np.ndarray, bounds: np.ndarray, first: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(block, word, times) of the weighted words, by block; words count from 0."""
    at = np.flatnonzero((code > 0) & (weight[code - 1] > 0))
    row = np.searchsorted(bounds, at, "right") - 1
    key = (first[row] + (at - bounds[row]) // BLOCK) * len(weight) + code[at] - 1
    key, n = np.unique(key, return_counts=True)
    return key // len(weight), key % len(weight), n


def _sum_arrays(rows: DataFrame, shape: tuple[int, ...], part) -> np.ndarray:
    """The sum of part(batch) over all rows: one array a partition, and FAN of them a task until one is left."""

    def run(batches):
        total = np.zeros(shape)
        for b in batches:
            total += part(b)
        yield pa.RecordBatch.from_arrays([pa.array([total.astype(np.float32).tobytes()], pa.binary())], names=["x"])

    def add(batches):
        total = np.zeros(shape)
        for b in batches:
            for x in b.column(0):
                total += np.frombuffer(x.as_py(), np.float32).reshape(shape)
        yield pa.RecordBatch.from_arrays([pa.array([total.astype(np.float32).tobytes()], pa.binary())], names=["x"])

    sums, n = rows.mapInArrow(run, "x binary"), rows.rdd.getNumPartitions()
    while n > 1:
        n = -(-n // FAN)
        sums = sums.repartition(n).mapInArrow(add, "x binary")
    out = np.zeros(shape)
    for r in sums.toArrow()["x"]:
        out += np.frombuffer(r.as_py(), np.float32).reshape(shape)
    return out


def weights(encoded: DataFrame, own: Items, common: float) -> tuple[np.ndarray, float]:
    """The weight of each vocabulary word, and the number of blocks."""
    v, kind = len(own.vocab), own.kind

    def count(b):
        code, bounds, first, n = _blocks(b, kind)
        x = np.zeros(v + 1)
        _, word, _ = _terms(code, bounds, first, np.ones(v))
        x[:v] = np.bincount(word, minlength=v)
        x[v] = n.sum()
        return x

    df = _sum_arrays(encoded, (v + 1,), count)
    idf = np.log((df[-1] + 1) / (df[:-1] + 1)) + 1e-3
    w = np.maximum(idf - np.log(1 / common), 0)
    for c in own.codes:
        word, n = np.unique(c - 1, return_counts=True)
        order = np.lexsort((word, -idf[word]))
        rare = word[order][: 1 + np.searchsorted(np.cumsum(n[order]), LEAST * len(c))]
        w[rare] = np.maximum(w[rare], idf[rare] / 4)
    return w, df[-1]


def _normal(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def weighted_items(own: Items, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(size, word, x): the items' weighted words, sizes by item, scaled to unit rows."""
    size, words, values = [], [], []
    for c in own.codes:
        word, n = np.unique(c[w[c - 1] > 0] - 1, return_counts=True)
        x = n * w[word]
        size.append(len(word))
        words.append(word)
        values.append(x / max(np.linalg.norm(x), 1e-12))
    return np.array(size, np.int64), np.concatenate(words).astype(np.int64), np.concatenate(values)


def _runs(block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    start = np.flatnonzero(np.r_[True, block[1:] != block[:-1]]) if len(block) else np.zeros(0, np.int64)
    return start, np.diff(np.r_[start, len(block)])


def _parts(cost: np.ndarray, step: int) -> list[tuple[int, int]]:
    """Cuts of a range into runs of about `step` in cost."""
    if not len(cost):
        return []
    edges = np.unique(np.r_[0, np.searchsorted(np.cumsum(cost), np.arange(step, cost.sum(), step)) + 1, len(cost)]).astype(int)
    return list(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True))


def _sums(table: np.ndarray, pick: np.ndarray, x: np.ndarray, size: np.ndarray, step: int = 4096) -> np.ndarray:
    """A row for each run of entries: the sum of x times the picked rows of the table. Runs are walked side by side, a long one in parts."""
    if size.max(initial=0) > LONG:
        parts = -(-size // LONG)
        own = np.full(int(parts.sum()), LONG)
        own[(np.cumsum(parts) - 1)[parts > 0]] = (size - (parts - 1) * LONG)[parts > 0]
        return _sums(_sums(table, pick, x, own, step), np.arange(len(own)), np.ones(len(own), table.dtype), parts, step)
    order = np.argsort(-size, kind="stable")
    start, size = (np.cumsum(size) - size)[order], size[order]
    total = np.zeros((len(size), table.shape[1]), table.dtype)
    for k in range(int(size.max(initial=0))):
        n = int(np.searchsorted(-size, -k))
        for a in range(0, n, step):
            e = start[a : min(n, a + step)] + k
            y = table[pick[e]]
            y *= x[e, None]
            total[a : a + len(e)] += y
    out = np.empty_like(total)
    out[order] = total
    return out


def _gram(encoded: DataFrame, own: Items, w: np.ndarray, m: np.ndarray) -> np.ndarray:
    """A^T A m over the unit rows A of all blocks, whose entries are never made dense."""
    kind = own.kind
    m32 = m.astype(np.float32)

    def part(b):
        out = np.zeros(m.shape)
        for piece in _pieces([b]):
            block, word, n = _terms(*_blocks(piece, kind)[:3], w)
            if not len(block):
                continue
            start, size = _runs(block)
            x = n * w[word]
            x = (x / np.repeat(np.sqrt(np.add.reduceat(x * x, start)), size)).astype(np.float32)
            y = _sums(m32, word, x, size)
            order = np.argsort(word, kind="stable")
            heads, count = _runs(word[order])
            out[word[order][heads]] += _sums(y, np.repeat(np.arange(len(size)), size)[order], x[order], count)
        return out

    return _sum_arrays(encoded, m.shape, part)


def latent(encoded: DataFrame, own: Items, w: np.ndarray, n_blocks: float, rank: int, seed: int = 5) -> np.ndarray:
    """(words, rank) leading right singular vectors. The items count as rows too, with a tenth of the blocks' weight in all.

    With G = A^T A and a random Omega, G is close to (G Omega)(Omega^T G Omega)^-1 (G Omega)^T, so one pass over the blocks is enough.
    """
    size, word, x = weighted_items(own, w)
    load = max(1.0, 0.1 * n_blocks / len(size))
    l = min(rank + 32, len(w))
    omega = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(w), l)))[0]
    y = _gram(encoded, own, w, omega)
    np.add.at(y, word, load * x[:, None] * np.repeat(_sums(omega, word, x, size), size, axis=0))
    small, v = np.linalg.eigh(omega.T @ y / 2 + y.T @ omega / 2)
    some = small > 1e-6 * small[-1]
    return np.linalg.svd(y @ (v[:, some] / np.sqrt(small[some])), full_matrices=False)[0][:, :rank]


def common_words(a: np.ndarray, b: np.ndarray) -> tuple[int, np.ndarray]:
    """Length of the longest common subsequence, and which words of a it takes (word numbers above 0 match)."""
    place: dict[int, int] = {}
    for i, x in enumerate(a.tolist()):
        place[x] = place.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    rows, v = [], full
    for y in b.tolist():
        m = place.get(y, 0)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
        rows.append(v)
    n = len(a) - v.bit_count()
    used = np.zeros(len(a), bool)
    i, j = len(a), len(b)

    def length(i, j):  # LCS of a[:i] and b[:j]
        return i - (rows[j - 1] & (1 << i) - 1).bit_count() if j else 0

    while i and j and (k := length(i, j)):
        if length(i, j - 1) == k:
            j -= 1
        elif length(i - 1, j) == k:
            i -= 1
        else:
            i, j = i - 1, j - 1
            used[i] = True
    return n, used


def judge(code: np.ndarray, item: np.ndarray, answer_at: int, w: np.ndarray, lo: int, hi: int, copy: float, paraphrase: float, answer: float) -> tuple[float, str | None]:
    """The share of the item in code[lo:hi], and what it is; 0 where the words there can't be enough."""
    around, item_set = code[lo:hi], np.unique(item)
    if np.minimum(*(np.bincount(x, minlength=len(w) + 1)[item_set] for x in (item, around))).sum() < min(copy, paraphrase) * len(item):
        return 0.0, None
    n, used = common_words(item, around)
    share = n / len(item)
    if share >= copy:
        return share, "copy"
    heavy = w[item - 1] > 0
    if share >= paraphrase and used[answer_at:].mean() >= answer and used[heavy].sum() >= 0.5 * heavy.sum():
        return share, "paraphrase"
    return share, None


def leaks(docs: DataFrame, benchmark: DataFrame, rank: int = 256, common: float = 0.04, near: float = 0.4, copy: float = 0.8, paraphrase: float = 0.6, answer: float = 0.5) -> DataFrame:
    """(doc_id, th, item_id, start_word, cosine, lcs, kind) for each document that holds an item."""
    own = items(benchmark)
    encoded = encode(docs, own)
    if not own.codes:
        return encoded.select("doc_id", "th").filter("false").selectExpr("doc_id", "th", "cast(null as bigint) item_id", "0 start_word", "0D cosine", "0D lcs", "'' kind")
    encoded = cut(encoded)
    w, n_blocks = weights(encoded, own, common)
    space = latent(encoded, own, w, n_blocks, rank).astype(np.float32)
    held, word_of, x_of = weighted_items(own, w)
    target = _normal(_sums(space, word_of, x_of.astype(np.float32), held))
    kind, v, n_items = own.kind, len(w), len(own.codes)
    length = np.array([len(c) for c in own.codes])
    weighty = np.array([(w[c - 1] > 0).sum() for c in own.codes])
    # of an item's weighted words, a copy takes all but those among the words it may lack, and a paraphrase half
    if_copy = weighty - np.floor((1 - copy) * length + 1e-9)
    need = np.minimum(if_copy, np.ceil(weighty / 2))
    reach = -(-length // BLOCK)
    item_of = np.repeat(np.arange(n_items), held)
    step = max(16, min(512, (64 << 20) // v))

    def retrieve(word, times, size, live, row, first, after):
        """(first live block, item, cosine, blocks) of the candidates; first and after: the blocks that begin and follow each row."""
        z = _sums(space, word, (times * w[word]).astype(np.float32), size)
        pair = np.flatnonzero((live[1:] == live[:-1] + 1) & (row[1:] == row[:-1]))
        norm = np.einsum("ij,ij->i", z, z)
        joint = norm[pair] + norm[pair + 1] + 2 * np.einsum("ij,ij->i", z[pair], z[pair + 1])
        found = [(np.zeros(0, np.int64),) * 4]
        for a in range(0, n_items, step):
            inner = z @ target[a : a + step].T
            member = np.zeros((v, inner.shape[1]), np.float32)
            own = slice(*np.searchsorted(item_of, [a, a + step]))
            member[word_of[own], item_of[own] - a] = 1
            held_before = np.zeros((len(z) + 1, inner.shape[1]), np.float32)
            np.cumsum(_sums(member, word, times.astype(np.float32), size), axis=0, out=held_before[1:])
            for at, value, square, width in ((np.arange(len(z)), inner, norm, 1), (pair, inner[pair] + inner[pair + 1], joint, 2)):
                value = value / np.sqrt(np.maximum(square, 1e-12))[:, None]
                for q in np.unique(reach[a : a + step]).tolist():
                    k = np.flatnonzero(reach[a : a + step] == q)
                    lo = np.searchsorted(live, np.maximum(first[row[at]], live[at] - q))
                    hi = np.searchsorted(live, np.minimum(after[row[at]], live[at] + width + q))
                    shared = (held_before[hi] - held_before[lo])[:, k]
                    i, j = np.nonzero((shared >= need[a + k]) & ((value[:, k] >= near) | (shared >= if_copy[a + k])))
                    found.append((at[i], k[j] + a, value[i, k[j]], np.full(len(i), width)))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def run(batches):
        for b in _pieces(batches):
            code, bounds, first, count = _blocks(b, kind)
            block, word, times = _terms(code, bounds, first, w)
            if not len(block):
                continue
            start, size = _runs(block)
            live = block[start]
            row = np.searchsorted(first, live, "right") - 1
            at, item, cosine, width = retrieve(word, times, size, live, row, first, first + count)
            r = row[at]
            begin = (live[at] - first[r]) * BLOCK
            lo, hi = np.maximum(0, begin - length[item]), np.minimum(bounds[r + 1] - bounds[r], begin + width * BLOCK + length[item])
            out: dict[tuple[int, int], tuple] = {}
            for c in np.lexsort((begin, -cosine)).tolist():
                key = int(r[c]), int(item[c])
                had = out.get(key)
                if had and had[2] >= 1:
                    continue
                text = code[bounds[key[0]] : bounds[key[0] + 1]]
                share, found = judge(text, own.codes[key[1]], own.answers[key[1]], w, int(lo[c]), int(hi[c]), copy, paraphrase, answer)
                if found and (not had or share > had[2]):
                    out[key] = (int(begin[c]), float(cosine[c]), share, found)
            keys = sorted(out)
            if keys:
                rows = pa.array([i for i, _ in keys])
                got = [out[y] for y in keys]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(rows), b.column(1).take(rows), pa.array([own.ids[y] for _, y in keys], pa.int64()), pa.array([y[0] for y in got], pa.int32()), pa.array([round(y[1], 5) for y in got]), pa.array([y[2] for y in got], pa.float64()), pa.array([y[3] for y in got])],
                    names=[y.split()[0] for y in SCHEMA.split(", ")],
                )

    return encoded.mapInArrow(run, SCHEMA)


def drop(docs: DataFrame, benchmark: DataFrame, **params) -> DataFrame:
    """docs without those that hold an item of the benchmark."""
    return without(docs, leaks(docs, benchmark, **params))

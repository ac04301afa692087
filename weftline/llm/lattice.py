"""Sampled SentencePiece segmentations without replacement, and decoding.

The pieces of a given vocabulary span a lattice over a text's bytes: an edge is a piece, or a byte piece where a
character has none of its own. A path's weight is the product of its pieces' weights, Zipf's law over the order in
which the vocabulary ranks them, to the power alpha. Forward filtering is exact: the backward sums of a unit give the
probability of every edge at its state. A unit ends where no piece holds the two bytes on either side, so the lattice
of a text is the product of its units' lattices. A task keeps the lattices of the units it has solved, up to SOLVED bytes of them.

Top-k by Gumbel noise, without replacement: a perturbed best-first search. The best path is an ordinary sample, found
from the left; at each of its states, all edges not taken form one subtree in the queue, whose Gumbel maximum is drawn
below the path's own. The largest of the queue is opened next, and so on: the k paths popped are the k largest of all
perturbed paths, in order. The next value in the queue, kappa, gives each path's inclusion score
1 - exp(-exp(log_prob - kappa)). Noise is a hash of seed, row key, path and byte, so results don't depend on partitions.

Defined results. Null or empty text: one path without pieces and with log_prob 0. A text with fewer than k segmentations
gives them all, with inclusion 1. Repeated rows get the same paths, rows with other keys independent ones. A null doc_id
is a key like any other. No length is cut. Extra columns are ignored.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textcore as T
from .session import fresh

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SCHEMA = "doc_id long, sample int, ids array<int>, log_prob double, perturbed double, log_inclusion double, round_trip boolean"
_MULT = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0x100000001B3)
_SLOTS = 21
CHUNK = 1 << 19
SLICE = 1 << 15  # units drawn at a time
EARLY = 24  # edges of a path whose subtrees are queued before the others
HIGHEST = 37.0  # Gumbel noise from a 52-bit uniform number stays below this
SOLVED = 3 << 18  # bytes of units whose lattices are kept between chunks


class Vocabulary:
    """Pieces as bytes, with a hash table over them that numpy can probe."""

    def __init__(self, model: str, alpha: float):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        n = sp.get_piece_size()
        self.bytes: list[bytes] = [b""] * n
        self.byte_id = np.full(256, -1, np.int64)
        ids = []
        for i in range(n):
            if sp.is_byte(i):
                value = int(sp.id_to_piece(i)[3:5], 16)
                self.byte_id[value], self.bytes[i] = i, bytes([value])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.bytes[i] = sp.id_to_piece(i).replace("▁", " ").encode()
                ids.append(i)
        order = sorted(ids, key=lambda i: (-sp.get_score(i), i))
        self.logw = np.full(n, -np.log(n + 1.0))
        self.logw[order] = -np.log(np.arange(len(order)) + 2.0)
        self.logw *= alpha
        self.size = np.array([len(b) for b in self.bytes])
        self.pieces = pa.array(self.bytes, pa.binary())
        self.longest = max((len(self.bytes[i]) for i in ids), default=0)
        self.joined = np.zeros((256, 256), bool)
        hashes = np.zeros(n, np.uint64)
        for i in ids:
            b = np.frombuffer(self.bytes[i], np.uint8)
            self.joined[b[:-1], b[1:]] = True
            h = 0
            for x in self.bytes[i]:
                h = (h * int(_STEP) + x + 1) & (1 << 64) - 1
            hashes[i] = h
        self.hash = hashes
        self.tables, left = [], np.array(ids)
        while len(left):
            t = np.full(1 << _SLOTS, -1, np.int32)
            slot = self._slot(hashes[left], len(self.tables))
            t[slot[::-1]] = left[::-1]
            self.tables.append(t)
            left = left[t[slot] != left]

    def _slot(self, h: np.ndarray, k: int) -> np.ndarray:
        return (h * np.uint64((int(_MULT) + 2 * 0x5851F42D4C957F2D * k) & (1 << 64) - 1)) >> np.uint64(64 - _SLOTS)

    def find(self, h: np.ndarray) -> np.ndarray:
        """The piece with each hash, or -1. A piece is in a later table only if its slot is taken in every earlier one."""
        out = np.full(len(h), -1, np.int64)
        at = np.arange(len(h))
        for k, t in enumerate(self.tables):
            got = t[self._slot(h[at], k)]
            some = got >= 0
            at, got = at[some], got[some].astype(np.int64)
            hit = self.hash[got] == h[at]
            out[at[hit]] = got[hit]
            at = at[~hit]
            if not len(at):
                break
        return out


@lru_cache(4)
def vocabulary(model: str, alpha: float) -> Vocabulary:
    return Vocabulary(model, alpha)


class Lattice:
    """The lattices of many units, laid end to end as a table of edges by their first byte; it grows as units are added.

    Of the bytes' edges, first[x]:first[x + 1], `cum` is the running probability and `others` the log of what the rest of them have.
    """

    def __init__(self, v: Vocabulary):
        self.v = v
        self._forget()
        self.cols = {"end": np.int32, "piece": np.int32, "logp": np.float64, "cum": np.float64, "others": np.float64, "final": bool}
        for name, kind in self.cols.items():
            setattr(self, name, np.zeros(0, kind))

    def _forget(self) -> None:
        self.hash, self.lo = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.n = self.m = 0
        self.first = np.zeros(1, np.int32)

    def place(self, h: np.ndarray, text: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The first byte in here of each unit, given its hash and its place in the text; the new ones are solved."""
        kinds, which, back = np.unique(h, return_index=True, return_inverse=True)
        new = self._missing(kinds)
        size = (end - start)[which]
        if self.n and self.n + int(size[new].sum()) > SOLVED:
            self._forget()
            new = np.arange(len(kinds))
        if len(new):
            size, begin = size[new], start[which[new]]
            offs = np.r_[0, np.cumsum(size)].astype(np.int64)
            self._solve(text[np.repeat(begin - offs[:-1], size) + np.arange(int(offs[-1]))], offs)
            h = np.concatenate([self.hash, kinds[new]])
            lo = np.concatenate([self.lo, (offs[:-1] + self.n - offs[-1]).astype(np.int32)])
            order = np.argsort(h, kind="stable")
            self.hash, self.lo = h[order], lo[order]
        return self.lo[np.searchsorted(self.hash, kinds)][back]

    def _missing(self, kinds: np.ndarray) -> np.ndarray:
        if not len(self.hash):
            return np.arange(len(kinds))
        at = np.minimum(np.searchsorted(self.hash, kinds), len(self.hash) - 1)
        return np.flatnonzero(self.hash[at] != kinds)

    def _solve(self, data: np.ndarray, offs: np.ndarray) -> None:
        v, n = self.v, len(data)
        size = np.diff(offs)
        unit = np.repeat(np.arange(len(size)), size)
        rel = np.arange(n) - offs[unit]
        rest = size[unit] - rel  # bytes from here to the end of the unit
        lead = np.where(data >= 0xF0, 4, np.where(data >= 0xE0, 3, np.where(data >= 0xC0, 2, 1)))
        lead = np.minimum(lead, rest)
        bare = np.zeros(n, bool)  # characters without a piece
        count = np.zeros(n, np.int32)
        at, h = np.arange(n), np.zeros(n, np.uint64)
        start, piece, slot = [], [], []

        def add(where, what):
            start.append(where)
            piece.append(what)
            slot.append(count[where])
            count[where] += 1

        for length in range(1, v.longest + 1):
            more = np.flatnonzero(rest[at] >= length)
            if not len(more):
                break
            if len(more) < len(at):
                at, h = at[more], h[more]
            h = h * _STEP + data[at + length - 1].astype(np.uint64) + np.uint64(1)
            got = v.find(h)
            hit = got >= 0
            add(at[hit], got[hit])
            if length <= 4:
                bare[at[~hit & (lead[at] == length)]] = True
        # a continuation byte is its character's, which needs byte pieces for all of its bytes or for none
        for k in (1, 2, 3):
            bare[np.flatnonzero(lead > k) + k] = False
        heads = bare.copy()
        for k in (1, 2, 3):
            bare[np.flatnonzero(heads & (lead > k)) + k] = True
        at = np.flatnonzero(bare)
        add(at, v.byte_id[data[at]])
        start, piece, slot = np.concatenate(start), np.concatenate(piece), np.concatenate(slot)
        # from the units' ends to their beginnings: all places equally far from the beginning at once
        order = np.argsort((-rel).astype(np.int16 if len(size) and size.max() < 1 << 15 else np.int64), kind="stable")
        first = np.zeros(n + 1, np.int64)
        np.cumsum(count[order], out=first[1:])
        into = np.empty(n, np.int64)
        into[order] = first[:-1]
        place = into[start] + slot
        m = len(start)
        what, to = np.empty(m, np.int64), np.empty(m, np.int64)
        what[place], to[place] = piece, start + v.size[piece]
        beta = np.full(n + 1, -np.inf)
        ends = np.zeros(n + 1, bool)
        ends[offs[1:]] = True
        final = ends[to]
        value = v.logw[what]
        far = rel[order]
        steps = np.flatnonzero(np.r_[True, far[1:] != far[:-1], True]) if n else np.zeros(1, np.int64)
        for a, b in zip(steps[:-1].tolist(), steps[1:].tolist(), strict=True):
            lo, hi = first[a], first[b]
            own = count[order[a:b]]
            some = np.flatnonzero(own)
            if not len(some):
                continue
            own, heads = own[some], first[a:b][some] - lo
            # a unit's end is the next unit's start, so sums at ends are kept apart
            x = value[lo:hi] + np.where(final[lo:hi], 0.0, beta[to[lo:hi]])
            top = np.maximum.reduceat(x, heads)
            safe = np.where(np.isfinite(top), top, 0)
            with np.errstate(divide="ignore"):
                total = safe + np.log(np.add.reduceat(np.exp(x - np.repeat(safe, own)), heads))
            if far[a]:
                beta[order[a:b][some]] = total
            value[lo:hi] = x - np.repeat(np.where(np.isfinite(total), total, 0), own)
        # back to the order of the places, the likeliest edge of each first
        own = np.repeat(np.flatnonzero(count), count[count > 0])
        first = np.zeros(n + 1, np.int64)
        np.cumsum(count, out=first[1:])
        back = np.arange(m) + (into - first[:-1])[own]
        value, what, to, final = value[back], what[back], to[back], final[back]
        lo, hi = first[own], first[own + 1]
        heads = first[:-1][count > 0]
        if m:
            top = np.flatnonzero(value == np.repeat(np.maximum.reduceat(value, heads), count[count > 0]))
            top = top[np.r_[True, own[top[1:]] != own[top[:-1]]]]
            for x in (value, what, to, final):
                x[heads], x[top] = x[top], x[heads]
        p = np.exp(value)
        # the others are added up one by one: a difference of sums would lose the small ones
        others, on, k = np.zeros(m), np.flatnonzero(hi - lo > 1), 0
        while len(on):
            e = lo[on] + k
            others[on] += np.where(e == on, 0, p[e])
            k += 1
            on = on[e + 1 < hi[on]]
        with np.errstate(divide="ignore"):
            others = np.log(others)
        run = np.cumsum(p)
        base = (run - p)[lo]
        total = run[hi - 1] - base
        cum = np.minimum((run - base) / np.where(total > 0, total, 1), 1.0)
        self._room(self.m + m)
        for name, x in (("end", to + self.n), ("piece", what), ("logp", value), ("cum", cum), ("others", others), ("final", final)):
            getattr(self, name)[self.m : self.m + m] = x
        self.first = np.concatenate([self.first[:-1], (first + self.m).astype(np.int32)])
        self.n, self.m = self.n + n, self.m + m

    def _room(self, m: int) -> None:
        if m <= len(self.end):
            return
        size = max(m, min(2 * len(self.end), 3 * SOLVED), len(self.end) + SOLVED // 4)
        for name, kind in self.cols.items():
            new = np.zeros(size, kind)
            new[: self.m] = getattr(self, name)[: self.m]
            setattr(self, name, new)

    def start(self, edge: np.ndarray) -> np.ndarray:
        return self.end[edge] - self.v.size[self.piece[edge]]

    def draw(self, pos: np.ndarray, u: np.ndarray) -> np.ndarray:
        """An edge from each place; the likely ones come first, so most draws end at once."""
        e, top = self.first[pos], self.first[pos + 1] - 1
        on = np.flatnonzero((self.cum[e] <= u) & (e < top))
        while len(on):
            e[on] += 1
            x = e[on]
            on = on[(self.cum[x] <= u[on]) & (x < top[on])]
        return e


def units(v: Vocabulary, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Texts with the leading space that the vocabulary expects, their offsets, and the boundaries and rows of units."""
    n = len(offs) - 1
    some = np.diff(offs) > 0
    head = np.flatnonzero(some)
    out = np.insert(data, offs[:-1][some], 32) if len(head) else data
    offs = offs + np.r_[0, np.cumsum(some)]
    if not len(out):
        return out, offs, np.zeros(1, np.int64), np.zeros(0, np.int64)
    cut = np.ones(len(out), bool)
    cut[1:] = ~v.joined[out[:-1], out[1:]]
    cut[offs[:-1][some]] = True
    bounds = np.r_[np.flatnonzero(cut), len(out)]
    return out, offs, bounds, np.searchsorted(offs, bounds[:-1], "right") - 1


def _noise(seed: np.ndarray, salt: int, at: np.ndarray) -> np.ndarray:
    return T.uniform(T.mix(seed + np.uint64(salt * 0xD1342543DE82EF95 & (1 << 64) - 1) + at.astype(np.uint64) * _MULT))


def _walk(lat: Lattice, seed: np.ndarray, salt: int, pos: np.ndarray, byte: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Draws the rest of each unit from a place in it, at a byte of its text: number of the unit, edge and byte, in order."""
    toks, edges, places = [], [], []
    tok, shift = np.arange(len(pos)), byte - pos
    while len(tok):
        at = pos + shift[tok]
        e = lat.draw(pos, _noise(seed[tok], salt, at))
        toks.append(tok)
        edges.append(e)
        places.append(at)
        on = np.flatnonzero(~lat.final[e])
        tok, pos = tok[on], lat.end[e[on]].astype(np.int64)
    count = np.bincount(np.concatenate(toks), minlength=len(byte)) if toks else np.zeros(0, np.int64)
    head = np.cumsum(count) - count
    edge, at = np.empty(int(count.sum()), np.int64), np.empty(int(count.sum()), np.int64)
    for r, (tok, e, x) in enumerate(zip(toks, edges, places, strict=True)):
        to = head[tok] + r
        edge[to], at[to] = e, x
    return np.repeat(np.arange(len(byte)), count), edge, at


def _best(row: np.ndarray, value: np.ndarray, most: int) -> np.ndarray:
    """Which entries are among the `most` largest of their row; rows come in order."""
    if not len(row):
        return np.zeros(0, np.int64)
    value = value.copy()
    start = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    size = np.diff(np.r_[start, len(row)])
    keep = []
    for _ in range(most):
        top = np.repeat(np.maximum.reduceat(value, start), size)
        hit = np.flatnonzero((value == top) & (top > -np.inf))
        if not len(hit):
            break
        hit = hit[np.r_[True, row[hit[1:]] != row[hit[:-1]]]]
        keep.append(hit)
        value[hit] = -np.inf
    return np.sort(np.concatenate(keep)) if keep else np.zeros(0, np.int64)


class Paths:
    """The edges of one path a row, in order, with bounds by row."""

    def __init__(self, edge: np.ndarray, count: np.ndarray):
        self.edge, self.bounds = edge, np.r_[0, np.cumsum(count)].astype(np.int64)


class Search:
    """The k best perturbed paths of every row of a chunk.

    The queue holds subtrees: the edges not taken at one step of a path. As only the first k - t of a row can still be opened
    after t paths, and one more gives kappa, no more than these are kept.
    """

    FIELDS = {"row": np.int64, "g": np.float64, "path": np.int64, "step": np.int64, "tok": np.int64, "byte": np.int64, "before": np.float64}

    def __init__(self, lat: Lattice, data: np.ndarray, offs: np.ndarray, seed: np.ndarray, k: int):
        self.lat, self.seed, self.k, self.n = lat, seed, k, len(offs) - 1
        self.text, self.offs, bounds, self.row = units(lat.v, data, offs)
        start, end = bounds[:-1], bounds[1:]
        self.lo = lat.place(T.span_hash(self.text, start, end), self.text, start, end) if len(start) else np.zeros(0, np.int32)
        self.at = start - self.offs[self.row]  # bytes count from the text's own start, whatever chunk it is in
        self.paths: list[Paths] = []
        self.perturbed = [-np.log(-np.log(_noise(seed, 2, np.zeros(self.n))))]
        self.has = [np.ones(self.n, bool)]
        self.queue = {f: np.zeros(0, kind) for f, kind in self.FIELDS.items()} | {"taken": np.zeros((0, k), np.int64)}
        edge, count = self._rest(0, np.arange(len(start)), self.lo, self.at, np.zeros(self.n, np.int64), np.zeros(self.n), self.perturbed[0], 1, 3)
        self.paths.append(Paths(edge, count))
        for t in range(1, k):
            self._open(t)
        self.kappa = np.full(self.n, -np.inf)
        np.maximum.at(self.kappa, self.queue["row"], self.queue["g"])

    def _push(self, salt: int, mass: np.ndarray, limit: np.ndarray, most: int, **entry) -> None:
        """Queues subtrees with their Gumbel maximum below `limit`; rows come in order."""
        with np.errstate(divide="ignore", invalid="ignore"):
            u = _noise(self.seed[entry["row"]], salt, entry["byte"])
            g = mass - np.log(np.exp(np.minimum(mass - limit, 700)) - np.log(u))
        g[~(np.isfinite(mass) & np.isfinite(g))] = -np.inf
        sel = _best(entry["row"], g, most)
        entry["g"] = g
        new = {f: np.concatenate([self.queue[f], entry[f][sel]]) for f in self.FIELDS}
        taken = entry["taken"][sel]
        if taken.ndim == 1:
            taken = np.column_stack([taken, np.full((len(sel), self.k - 1), -1)])
        new["taken"] = np.concatenate([self.queue["taken"], taken])
        order = np.argsort(new["row"], kind="stable")
        keep = order[_best(new["row"][order], new["g"][order], most)]
        self.queue = {f: x[keep] for f, x in new.items()}

    def _rest(self, t, tok, pos, byte, step, before, limit, salt_walk, salt_push):
        """Draws the units `tok` from the places `pos` on for path t, a slice at a time, and queues what it leaves: edges, and their number by row.

        step and before: the number of edges that each row's path has so far, and their log probability.
        """
        lat, found, most = self.lat, [], self.k - t
        step, before, count = step.copy(), before.copy(), np.zeros(self.n, np.int64)
        begin = step + EARLY
        for a in range(0, len(tok), SLICE):
            part = tok[a : a + SLICE]
            who, edge, at = _walk(lat, self.seed[self.row[part]], salt_walk, pos[a : a + SLICE].astype(np.int64), byte[a : a + SLICE])
            found.append(edge.astype(np.int32))
            row = self.row[part][who]
            some = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
            size = np.diff(np.r_[some, len(row)])
            logp = lat.logp[edge]
            run = np.cumsum(logp)
            ahead = run - logp
            ahead += np.repeat(before[row[some]] - ahead[some], size)
            place = np.arange(len(row)) + np.repeat(step[row[some]] - some, size)
            early = place < begin[row]
            # a subtree of mass x has its maximum below x + HIGHEST, so behind the early ones most can't come among those kept
            for first in (True, False):
                sel = np.flatnonzero(early if first else ~early & (ahead > self._least(most)[row] - HIGHEST))
                sel = sel[lat.others[edge[sel]] > -np.inf]
                e, r = edge[sel], row[sel]
                self._push(salt_push, ahead[sel] + lat.others[e], limit[r], most, row=r, path=np.full(len(sel), t), step=place[sel], tok=part[who[sel]], byte=at[sel], before=ahead[sel], taken=e)
            end = some + size - 1
            step[row[some]] += size
            count[row[some]] += size
            before[row[some]] = ahead[end] + logp[end]
        return np.concatenate(found) if found else np.zeros(0, np.int32), count

    def _least(self, most: int) -> np.ndarray:
        """What an entry of each row must exceed to be kept: the smallest of the `most` that it has, if it has as many."""
        row, least = self.queue["row"], np.full(self.n, np.inf)
        np.minimum.at(least, row, self.queue["g"])
        least[np.bincount(row, minlength=self.n) < most] = -np.inf
        return least

    def _open(self, t: int) -> None:
        """Path t of every row that has one: the largest subtree of its queue is opened."""
        lat, n, q = self.lat, self.n, self.queue
        pick = _best(q["row"], q["g"], 1)
        x = {f: y[pick] for f, y in q.items()}
        self.queue = {f: np.delete(y, pick, 0) for f, y in q.items()}
        rows, parent, step, tok0, taken = x["row"], x["path"], x["step"], x["tok"], x["taken"]
        found = np.zeros(n, bool)
        found[rows] = True
        value = np.full(n, -np.inf)
        value[rows] = x["g"]
        pos = lat.start(taken[:, 0]).astype(np.int64)
        left = self._left(pos, taken)
        new = self._pick(pos, taken, _noise(self.seed[rows], 10 * t + 4, x["byte"]) * left)
        # units after the branch are drawn afresh, the branch's own from the edge's end
        on = ~lat.final[new]
        begin = tok0 + ~on
        size = np.searchsorted(self.row, rows, "right") - begin
        tok = np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        at, byte = self.lo[tok].astype(np.int64), self.at[tok].copy()
        head = (np.cumsum(size) - size)[on]
        at[head], byte[head] = lat.end[new[on]], x["byte"][on] + lat.v.size[lat.piece[new[on]]]
        steps, before = np.zeros(n, np.int64), np.zeros(n)
        steps[rows], before[rows] = step + 1, x["before"] + lat.logp[new]
        # what the opened subtree still holds
        taken = taken.copy()
        taken[np.arange(len(rows)), (taken >= 0).sum(1)] = new
        with np.errstate(divide="ignore"):
            mass = x["before"] + np.log(self._left(pos, taken))
        self._push(10 * t + 6, mass, x["g"], self.k - t, row=rows, path=parent, step=step, tok=tok0, byte=x["byte"], before=x["before"], taken=taken)
        edge, count = self._rest(t, tok, at, byte, steps, before, value, 10 * t + 5, 10 * t + 7)
        total = np.zeros(n, np.int64)
        total[rows] = step + 1 + count[rows]
        path = Paths(np.empty(int(total.sum()), np.int32), total)
        base = path.bounds[rows]
        for s in range(t):
            m = np.flatnonzero(parent == s)
            skip = np.arange(int(step[m].sum())) - np.repeat(np.cumsum(step[m]) - step[m], step[m])
            path.edge[np.repeat(base[m], step[m]) + skip] = self.paths[s].edge[np.repeat(self.paths[s].bounds[rows[m]], step[m]) + skip]
        path.edge[base + step] = new
        walked = count[rows]
        path.edge[np.repeat(base + step + 1 - (np.cumsum(walked) - walked), walked) + np.arange(len(edge))] = edge
        self.paths.append(path)
        self.perturbed.append(value)
        self.has.append(found)

    def _left(self, pos: np.ndarray, taken: np.ndarray) -> np.ndarray:
        """The probability at each place of the edges not taken; 0 exactly if there are none."""
        who, e = _expand(self.lat.first, pos)
        free = ~(e[:, None] == taken[who]).any(1)
        return np.bincount(who, np.where(free, np.exp(self.lat.logp[e]), 0), len(pos))

    def _pick(self, pos: np.ndarray, taken: np.ndarray, u: np.ndarray) -> np.ndarray:
        who, e = _expand(self.lat.first, pos)
        free = ~(e[:, None] == taken[who]).any(1) & (self.lat.logp[e] > -700)
        who, e = who[free], e[free]
        p = np.exp(self.lat.logp[e])
        run = np.cumsum(p)
        first = np.searchsorted(who, np.arange(len(pos)))
        run -= (run[first] - p[first])[who]
        below = np.bincount(who, run <= u[who], len(pos)).astype(np.int64)
        last = np.searchsorted(who, np.arange(len(pos)), "right") - 1
        return e[np.minimum(first + below, last)]


def _expand(first: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    a, n = first[pos].astype(np.int64), (first[pos + 1] - first[pos]).astype(np.int64)
    return np.repeat(np.arange(len(pos)), n), np.repeat(a - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


def decode_flat(v: Vocabulary, ids: np.ndarray) -> np.ndarray:
    """The bytes of a flat run of ids, leading spaces included."""
    raw = v.pieces.take(pa.array(ids, pa.int32())).buffers()[2] if len(ids) else None
    return np.frombuffer(raw, np.uint8)[: int(v.size[ids].sum())] if raw is not None else np.zeros(0, np.uint8)


def _same(text: np.ndarray, bounds: np.ndarray, back: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Which rows of the text equal the rows of `back`, of these sizes."""
    good = np.diff(bounds) == size
    if good.all():
        bad = np.flatnonzero(text != back)
        good[np.searchsorted(bounds, bad, "right") - 1] = False
        return good
    ends = np.cumsum(size)
    for i in np.flatnonzero(good):
        good[i] = np.array_equal(text[bounds[i] : bounds[i + 1]], back[ends[i] - size[i] : ends[i]])
    return good


def encode(docs: DataFrame, k: int = 2, alpha: float = 1.0, seed: int = 0, model: str = MODEL) -> DataFrame:
    """k distinct segmentations a document, by falling perturbed log probability; round_trip tells that its ids decode to the text."""

    def run(batches):
        v = vocabulary(model, alpha)
        lat = Lattice(v)
        for rows, data, offs in T.chunks(batches, CHUNK):
            n = len(offs) - 1
            key = T.mix(rows.column(1).to_numpy().view(np.uint64) + np.uint64(seed * 2 + 1))
            found = Search(lat, data, offs, key, k)
            for t, p in enumerate(found.paths):
                count, has = np.diff(p.bounds), found.has[t]
                ids = lat.piece[p.edge]
                total = np.bincount(np.repeat(np.arange(n), count), lat.logp[p.edge], n)
                size = np.bincount(np.repeat(np.arange(n), count), v.size[ids], n).astype(np.int64)
                sel = np.flatnonzero(has)
                want, bounds = (found.text, found.offs) if has.all() else (found.text[np.repeat(has, np.diff(found.offs))], np.r_[0, np.cumsum(np.diff(found.offs)[sel])])
                good = _same(want, bounds, decode_flat(v, ids), size[sel])
                with np.errstate(over="ignore", divide="ignore"):
                    x = np.exp(np.minimum(total - found.kappa, 700))
                    log_in = np.where(x < 1e-9, total - found.kappa, np.log(-np.expm1(-x)))
                # a row without this path has no pieces either, so the flat ids serve as they are
                yield pa.RecordBatch.from_arrays(
                    [
                        rows.column(0).take(pa.array(sel)),
                        pa.array(np.full(len(sel), t + 1), pa.int32()),
                        T.lists(ids, count[sel], pa.int32()),
                        pa.array(total[sel], pa.float64()),
                        pa.array(found.perturbed[t][sel], pa.float64()),
                        pa.array(log_in[sel], pa.float64()),
                        pa.array(good),
                    ],
                    names=["doc_id", "sample", "ids", "log_prob", "perturbed", "log_inclusion", "round_trip"],
                )

    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("doc_id").cast("long")).alias("key"), text.alias("text")).mapInArrow(run, SCHEMA)


def decode(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """Adds `decoded` (with underscores before it where that is a column already), the text of the column `ids`; null for null ids, empty for no ids."""
    from pyspark.sql.types import StringType, StructField, StructType

    name = fresh(encoded, "decoded")[0]

    def run(batches):
        v = vocabulary(model, 1.0)
        for b in batches:
            col = b.column("ids")
            offs = col.offsets.to_numpy().astype(np.int64)
            ids = col.values.to_numpy(zero_copy_only=False)[offs[0] : offs[-1]] if len(col) else np.zeros(0, np.int32)
            ends = np.r_[0, np.cumsum(v.size[ids])][offs - offs[0]] if len(col) else np.zeros(1, np.int64)
            flat = decode_flat(v, ids).tobytes()
            text = [None if none else flat[a:z][1:].decode("utf-8", "surrogateescape") for a, z, none in zip(ends[:-1], ends[1:], col.is_null().to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(text, pa.string())], names=[*b.schema.names, name])

    return encoded.mapInArrow(run, StructType([*encoded.schema.fields, StructField(name, StringType())]))

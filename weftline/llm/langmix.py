"""Language ID as inference of a mixture.

Each language is a distribution over hashed byte trigrams, counted over all labelled documents. A document is a bag
of words whose language is hidden: expectation-maximisation estimates the share of every language, and languages
leave the set one by one as long as the likelihood less 0.5 * penalty * log(words) a language doesn't fall.
One more component, `und`, spreads its mass evenly and takes what no language explains.

Defined results. Null or empty text, or one without letters: no languages, unknown_share 1, not kept. A null `lang`
only keeps the row out of the counts. Without any labelled row every text is `und`. Repeated rows give repeated
results. Ties between shares are ordered by language name. Extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textcore as T

BITS = 16
UND = "und"
SCHEMA = "doc_id long, languages array<string>, shares array<double>, top_language string, unknown_share double, n_words int, kept boolean"

_LETTER = np.full(256, 32, np.uint8)
for _c in range(97, 123):
    _LETTER[_c] = _c
_LETTER[128:] = np.arange(128, 256)


@dataclass(frozen=True)
class Profiles:
    names: list[str]
    logp: np.ndarray  # (2**BITS, languages + 1), the last column is UND


def trigrams(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of the trigram that ends at each byte, and whether it holds a letter."""
    low = _LETTER[T.fold(data)]
    a1, a2 = np.full(len(low), 32, np.uint8), np.full(len(low), 32, np.uint8)
    a1[1:], a2[2:] = low[:-1], low[:-2]
    first = offs[:-1][offs[:-1] < offs[1:]]
    a1[first] = a2[first] = 32
    second = first + 1
    a2[second[second < len(low)]] = 32
    code = (a2.astype(np.uint32) << np.uint32(16)) | (a1.astype(np.uint32) << np.uint32(8)) | low
    return (code * np.uint32(2654435761)) >> np.uint32(32 - BITS), code != 0x202020


def fit(docs: DataFrame, smoothing: float = 0.5) -> Profiles:
    """Trigram counts by language over all labelled rows; only nonzero counts, summed per partition, are shuffled."""

    def count(batches):
        sums: dict[str, np.ndarray] = {}
        for rows, data, offs in T.chunks(batches):
            lang = rows.column(1).to_pylist()
            names = sorted({x for x in lang if x})
            at = {x: i for i, x in enumerate(names)}
            which = np.array([at.get(x, len(names)) for x in lang])
            h, ok = trigrams(data, offs)
            key = np.repeat(which, np.diff(offs))[ok] << BITS | h[ok]
            n = np.bincount(key, minlength=(len(names) + 1) << BITS)
            for x in names:
                part = n[at[x] << BITS : (at[x] + 1) << BITS]
                sums[x] = sums[x] + part if x in sums else part.copy()
        for x, n in sums.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_pydict({"lang": pa.array([x] * len(at)), "bucket": pa.array(at, pa.int32()), "n": pa.array(n[at], pa.int64())})

    found = (
        docs.select("text", F.col("lang").cast("string").alias("lang"))
        .filter("text is not null and lang is not null and lang <> ''")
        .mapInArrow(count, "lang string, bucket int, n long")
        .groupBy("lang", "bucket")
        .agg(F.sum("n").alias("n"))
        .toArrow()
    )
    names = sorted(set(found["lang"].to_pylist()))
    n = np.zeros((1 << BITS, len(names)))
    if names:
        n[found["bucket"].to_numpy(), np.searchsorted(np.array(names), found["lang"].to_numpy(zero_copy_only=False).astype(str))] = found["n"].to_numpy()
    logp = np.empty((1 << BITS, len(names) + 1), np.float32)
    total = n.sum(0)
    logp[:, :-1] = np.log(n + smoothing) - np.log(total + smoothing * (1 << BITS))
    logp[:, -1] = -BITS * np.log(2)
    return Profiles(names, logp)


def _em(lik, first, count, share, rounds):
    """Shares after some rounds, and each document's log likelihood under them; all are (languages, ...), so that every step runs along contiguous words."""
    n = count.astype(np.int64)
    for _ in range(rounds + 1):
        s = np.zeros(lik.shape[1], np.float32)
        for x, y in zip(lik, share, strict=True):
            s += x * np.repeat(y, n)
        if _ < rounds:
            np.divide(1, s, out=s)
            share = np.stack([y * np.add.reduceat(x * s, first) / count if y.any() else y for x, y in zip(lik, share, strict=True)])
    return share, np.add.reduceat(np.log(s), first)


def infer(data: np.ndarray, offs: np.ndarray, p: Profiles, penalty: float, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, languages + 1) shares, zero for a language that isn't chosen, and words a row; rows without letters have zeros only."""
    n, k = len(offs) - 1, len(p.names) + 1
    shares, n_words = np.zeros((n, k), np.float32), np.zeros(n, np.int64)
    if not len(data):
        return shares, n_words
    h, ok = trigrams(data, offs)
    start, _ = T.spans(data, offs)
    if not len(start):
        return shares, n_words
    row = np.searchsorted(offs, start, "right") - 1
    ok = ok.astype(np.float32)
    seen = np.add.reduceat(ok, start) > 0  # a number is no evidence
    ll = np.stack([np.add.reduceat(col[h] * ok, start)[seen] for col in p.logp.T.copy()])
    row = row[seen]
    if not len(row):
        return shares, n_words
    n_words = np.bincount(row, minlength=n)
    lik = np.exp(np.maximum(ll - ll.max(0), -60))
    docs = np.flatnonzero(n_words)
    count = n_words[docs]
    first = np.cumsum(count) - count
    pen = 0.5 * penalty * np.log(count + 1.0)
    share, like = _em(lik, first, count.astype(np.float32), np.full((k, len(docs)), 1 / k, np.float32), rounds)
    score = like - pen * (share > 0).sum(0)
    live = np.arange(len(docs))
    whole = True
    while len(live):
        own = share[:, live]
        if whole:
            trial = np.where(own >= 0.05, own, 0)  # all that is negligible leaves at once, if the likelihood allows
        else:
            trial = own.copy()
            trial[np.where(own > 0, own, 2).argmin(0), np.arange(len(live))] = 0
        go = ((trial > 0) != (own > 0)).any(0) & (trial.sum(0) > 0)
        at, trial = live[go], trial[:, go]
        if len(at):
            trial /= trial.sum(0)
            n_at = count[at]
            begin = np.cumsum(n_at) - n_at
            pick = np.repeat(first[at] - begin, n_at) + np.arange(int(n_at.sum()))
            trial, like = _em(lik[:, pick], begin, n_at.astype(np.float32), trial, max(2, rounds // 3) if (trial > 0).sum(0).max() > 1 else 0)
            new = like - pen[at] * (trial > 0).sum(0)
            better = new >= score[at]
            share[:, at[better]], score[at[better]] = trial[:, better], new[better]
            if not whole:
                live = at[better]
        elif not whole:
            break
        live = live[(share[:, live] > 0).sum(0) > 1]
        whole = False
    share = share.T
    shares[docs] = share
    return shares, n_words


def detect(docs: DataFrame, profiles: Profiles, penalty: float = 1.0, rounds: int = 12, most_unknown: float = 0.5) -> DataFrame:
    """One row a document: chosen languages by falling share, and whether it is kept: some language explains more than 1 - most_unknown of its words."""
    names = np.array([*profiles.names, UND])

    def run(batches):
        for rows, data, offs in T.chunks(batches):
            share, n_words = infer(data, offs, profiles, penalty, rounds)
            order = np.argsort(-share, 1, kind="stable")
            ranked = np.take_along_axis(share, order, 1)
            chosen = ranked > 0
            none = n_words == 0
            unknown = np.where(none, 1.0, share[:, -1])
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": rows.column(0).cast(pa.int64()),
                    "languages": T.lists(names[order[chosen]], chosen.sum(1), pa.string()),
                    "shares": T.lists(np.round(ranked[chosen].astype(float), 5), chosen.sum(1), pa.float64()),
                    "top_language": pa.array(np.where(none, None, names[order[:, 0]].astype(object)), pa.string()),
                    "unknown_share": pa.array(np.round(unknown.astype(float), 5)),
                    "n_words": pa.array(n_words, pa.int32()),
                    "kept": pa.array(unknown < most_unknown),
                }
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)


def keep(docs: DataFrame, profiles: Profiles, penalty: float = 1.0, rounds: int = 12, most_unknown: float = 0.5) -> DataFrame:
    """The rows of docs that detect() keeps, with all their columns, in one narrow pass."""
    cols = docs.schema

    def run(batches):
        for rows, data, offs in T.chunks(batches):
            share, n_words = infer(data, offs, profiles, penalty, rounds)
            yield rows.filter(pa.array((n_words > 0) & (share[:, -1] < most_unknown)))

    return docs.mapInArrow(run, cols)

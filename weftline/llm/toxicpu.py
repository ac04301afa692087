"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic examples are the positives (at most `max_positive` of them, those with the smallest hash of doc_id);
every document of the corpus is unlabelled text. Features say whether a document holds each of some words: of the
words that `min_support` positives or more hold (near copies among the positives share one vote), those whose log-likelihood ratio of positives over the corpus
exceeds GAIN, if at least the share `least_rate` of the documents that hold the word would be toxic (prior times its rate in positives over its rate in the corpus);
`width` bounds the size of the model, the largest ratios come first, of equal ones the smallest hashes. In these
rates, the moments and the prior a document counts as one over its near copies in the corpus, be they labelled or not: documents are near copies
that agree in a band of min-hashes, and the largest band counts. One pass over the texts writes what a document holds of the candidate words, and its bands;
everything else is computed from that. The loss is
squared, so that the risk needs only means and second moments of the features: those of the unlabelled text are summed over all
documents, as one small matrix a partition. Gradient steps follow the non-negative estimator: with class prior p,
    risk = p * E_pos[l(f)] + max(0, E_unl[l(-f)] - p * E_pos[l(-f)]),
and where the bracket falls below zero a step goes against it instead of down the risk. The prior, unless it
is given, is the corpus's own: the share of positives that, mixed with the labelled negatives, gives the corpus's rates of words; without negatives, the largest
share that the rates allow; the labels' rate, where there are too few of them for that. The cut-off is the share `floor` of the way from a document without any of the words to the median positive that has some,
however many documents lie above it.

Defined results. Null and empty texts score as a document without any of the words. Null labels and doc_ids are ignored; a doc_id with several labels is
positive if any says so. A score at the cut-off isn't toxic. Without min_support positives that share a word, nothing is toxic and the score is -1. Repeated rows get the same score and count as near copies of each other. Extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textcore as T
from .session import cut

GAIN = 6.0
SCHEMA = "doc_id long, score double, toxic boolean"


@dataclass(frozen=True)
class Model:
    words: np.ndarray  # sorted hashes
    w: np.ndarray
    bias: float
    cut: float

    def score(self, x: np.ndarray) -> np.ndarray:
        return x @ self.w + self.bias


def _ids(batches):
    for rows, data, offs in T.chunks(batches):
        _, _, row, h = T.words(data, offs)
        yield rows, row, h


def presence(words: np.ndarray, row: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    """(n, words) ones and zeros."""
    x = np.zeros((n, len(words)), np.float32)
    if len(words) and len(h):
        at = np.minimum(np.searchsorted(words, h), len(words) - 1)
        hit = words[at] == h
        x[row[hit], at[hit]] = 1
    return x


def sketches(row: np.ndarray, h: np.ndarray, n: int, bands: int = 6, rows: int = 6) -> tuple[np.ndarray, np.ndarray]:
    """(document, key) of each band of min-hashes; documents without words have none. Near copies share a key."""
    some, at = np.unique(row, return_index=True)
    keys = []
    for b in range(bands if len(h) else 0):
        key = np.full(len(some), b + 1, np.uint64)
        for r in range(rows):
            odd = T.mix(np.array([b * rows + r + 1], np.uint64)) | np.uint64(1)
            key = T.mix(key + np.minimum.reduceat(h * odd, at))
        keys.append(key)
    return np.tile(some, len(keys)), np.concatenate(keys) if keys else np.zeros(0, np.uint64)


def compact(docs: DataFrame, words: np.ndarray) -> DataFrame:
    """(doc_id, keys, held): the bands of each document that has words, and which of the given words it holds, by their places."""

    def run(batches):
        known = T.Lookup(words)
        for rows, row, h in _ids(batches):
            n = rows.num_rows
            doc, key = sketches(row, h, n)
            order = np.argsort(doc, kind="stable")
            at = known.find(h)
            hit = at >= 0
            held = np.unique(row[hit] * len(words) + at[hit])
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), T.lists(key[order].view(np.int64), np.bincount(doc, minlength=n), pa.int64()), T.lists(held % len(words), np.bincount(held // len(words), minlength=n), pa.int32())],
                names=["doc_id", "keys", "held"],
            )

    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).filter("text <> ''").mapInArrow(run, "doc_id long, keys array<long>, held array<int>")


def weighted(docs: DataFrame, words: np.ndarray) -> DataFrame:
    """(doc_id, share, held): share is one over the documents in the largest of a document's bands."""
    own = cut(compact(docs, words)).withColumn("row", F.monotonically_increasing_id())
    bands = own.select("row", F.explode("keys").alias("key"))
    large = bands.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    most = bands.join(large, "key").groupBy("row").agg(F.max("n").alias("n"))
    return cut(own.join(most, "row", "left").select("doc_id", (F.lit(1.0) / F.coalesce("n", F.lit(1))).alias("share"), "held"))


def chosen(labels: DataFrame, most: int, y: int = 1) -> DataFrame:
    """(__id) of at most `most` documents that are labelled y, those with the smallest hashes."""
    known = labels.filter("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("__id")).agg(F.max(F.col("toxic").cast("int")).alias("y"))
    return known.filter(F.col("y") == y).orderBy(F.xxhash64("__id"), "__id").limit(most).select("__id")


def labelled(docs: DataFrame, known: DataFrame) -> list[np.ndarray]:
    """The distinct words of each of the chosen documents."""

    def run(batches):
        for rows, row, h in _ids(batches):
            for i, x in enumerate(np.split(h, np.searchsorted(row, np.arange(1, rows.num_rows)))):
                x = np.unique(x)
                yield pa.RecordBatch.from_arrays([rows.column(0).slice(i, 1), pa.array([x.view(np.int64)], pa.list_(pa.int64()))], names=["id", "h"])

    found = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text")).filter("text <> ''").join(F.broadcast(known), F.col("id") == F.col("__id")).select("id", "text").mapInArrow(run, "id long, h array<long>").toArrow()
    rows = [x for c in found["h"].chunks for x in np.split(c.flatten().to_numpy().view(np.uint64), c.offsets.to_numpy()[1:-1] - c.offsets.to_numpy()[0])] if len(found) else []
    return sorted(rows, key=lambda x: (len(x), x[:1].tolist()))


def votes(pos: list[np.ndarray], bands: int = 6, rows: int = 6) -> np.ndarray:
    """One over the number of near copies of each positive, itself included; copies agree in a whole band of min-hashes."""
    group = np.arange(len(pos))

    def root(i):
        while group[i] != i:
            group[i] = i = group[group[i]]
        return i

    seen: dict[tuple, int] = {}
    for i, x in enumerate(pos):
        for b in range(bands):
            key = (b, *(int(T.mix(x + np.uint64(b * rows + r + 1)).min()) if len(x) else 0 for r in range(rows)))
            j = seen.setdefault(key, i)
            if root(i) != root(j):
                group[root(i)] = root(j)
    group = np.array([root(i) for i in range(len(pos))], np.int64)
    return 1 / np.bincount(group, minlength=len(pos))[group]


def _flat(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row and place of all words that are held, and the rows' shares."""
    col = b.column("held")
    return np.repeat(np.arange(len(col)), np.diff(col.offsets.to_numpy())), col.flatten().to_numpy().astype(np.int64), b.column("share").to_numpy()


def _summed(rows: DataFrame, shape: tuple[int, ...], part, fan: int = 16) -> np.ndarray:
    """The sum of part(row, place, share) over all documents: one array a partition, and `fan` of them a task until one is left."""

    def run(batches):
        total = np.zeros(shape)
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                total += part(*_flat(b.slice(at, 4096)))
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["x"])

    def add(batches):
        total = np.zeros(shape)
        for b in batches:
            for x in b.column(0):
                total += np.frombuffer(x.as_py()).reshape(shape)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["x"])

    sums, n = rows.mapInArrow(run, "x binary"), rows.rdd.getNumPartitions()
    while n > 1:
        n = -(-n // fan)
        sums = sums.repartition(n).mapInArrow(add, "x binary")
    out = np.zeros(shape)
    for r in sums.toArrow()["x"]:
        out += np.frombuffer(r.as_py()).reshape(shape)
    return out


def train(sp: np.ndarray, su: np.ndarray, prior: float, ridge: float = 1e-3, rounds: int = 3000) -> np.ndarray:
    """Weights that minimise the non-negative risk, from the second moments of positives and unlabelled text; the last feature is 1."""
    d = len(sp)
    mp, mu = sp[:, -1], su[:, -1]
    reg = ridge * np.eye(d)
    reg[-1, -1] = 0
    w = np.zeros(d)
    w[-1] = -1
    step = 1 / (np.linalg.eigvalsh(prior * sp + su)[-1] + ridge) / 2
    best, least = w, np.inf
    speed = np.zeros(d)
    for _ in range(rounds):
        look = w + 0.9 * speed
        negative = 1 + 2 * mu @ look + look @ su @ look - prior * (1 + 2 * mp @ look + look @ sp @ look)
        grad_neg = 2 * (mu + su @ look) - 2 * prior * (mp + sp @ look)
        if negative < -1e-12:  # at the start it is 0 but for rounding, and going against it would lead nowhere
            grad = -grad_neg
        else:
            grad = 2 * prior * (sp @ look - mp) + grad_neg + 2 * reg @ look
            risk = prior * (1 - 2 * mp @ look + look @ sp @ look) + negative + look @ reg @ look
            if risk < least:
                best, least = look, risk
        speed = 0.9 * speed - step * grad / 2
        w = w + speed
    return best


def class_prior(p: np.ndarray, q: np.ndarray, r: np.ndarray, n_pos: float, n_neg: float) -> float:
    """The toxic share of a corpus from the rates of words in positives, corpus and negatives, as q = prior * p + (1 - prior) * r.

    It is fitted over the words that tell positives from negatives. Without negatives it is the largest share that the words allow, as q >= prior * p for each.
    """
    if not n_neg:
        low = p - np.sqrt(p * (1 - p) / n_pos)
        return float(np.min(q[low > 0] / low[low > 0], initial=1.0))
    noise = p * (1 - p) / n_pos + r * (1 - r) / n_neg + 1 / (n_pos * n_neg)
    diff = p - r
    use = diff > 4 * np.sqrt(noise)
    return float(np.sum((diff * (q - r) / noise)[use]) / max(np.sum((diff**2 / noise)[use]), 1e-300)) if use.any() else 1.0


def _held(rows: DataFrame, known: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row and place of the words that the chosen documents hold, and their shares; at most max_positive rows reach the driver."""
    found = rows.join(F.broadcast(known), F.col("doc_id") == F.col("__id")).select("share", "held").toArrow().combine_chunks()
    parts = [_flat(b) for b in found.to_batches()]
    first = np.cumsum([0, *(len(x[2]) for x in parts)])
    join = lambda xs, kind: np.concatenate([np.zeros(0, kind), *xs])
    return join([x[0] + at for x, at in zip(parts, first, strict=False)], np.int64), join([x[1] for x in parts], np.int64), join([x[2] for x in parts], np.float64)


def fit(docs: DataFrame, labels: DataFrame, max_positive: int = 3000, width: int = 1024, min_support: int = 8, prior: float | None = None, least_rate: float = 0.5, floor: float = 0.2) -> Model:
    toxic = chosen(labels, max_positive)
    pos = labelled(docs, toxic)
    none = Model(np.zeros(0, np.uint64), np.zeros(0), -1.0, 0.0)
    if not pos or not (prior is None or 0 < prior < 1):
        return none
    words, at = np.unique(np.concatenate(pos), return_inverse=True)
    words = words[np.bincount(at, np.repeat(votes(pos), [len(x) for x in pos]), len(words)) >= min_support - 1e-9]
    if not len(words):
        return none

    rows, n_words = weighted(docs, words), len(words)
    counts = _summed(rows, (n_words + 1,), lambda row, place, share: np.r_[np.bincount(place, share[row], n_words), share.sum()])
    row_p, place_p, weight = _held(rows, toxic)
    n_all, n_pos = counts[-1], weight.sum()
    q, p = np.clip((counts[:-1] + 0.5) / (n_all + 1), 1e-9, 1 - 1e-9), np.clip(np.bincount(place_p, weight[row_p], n_words) / n_pos, 1e-9, 1 - 1e-9)
    if prior is None:
        row_n, place_n, by = _held(rows, chosen(labels, max_positive, 0))
        prior = class_prior(p, q, np.bincount(place_n, by[row_n], n_words) / max(by.sum(), 1e-9), n_pos, by.sum())
        if not 0 < prior < 1 and len(by):  # too few labels to tell words apart
            prior = labels.filter("doc_id is not null").agg(F.avg(F.col("toxic").cast("int"))).first()[0]
        if not 0 < prior < 1:
            return none
    support = n_pos * p
    gain = np.where((p > q) & (prior * p / q >= least_rate), support * np.log(p / q) + (n_pos - support) * np.log((1 - p) / (1 - q)), 0)
    pick = np.lexsort((words, -gain))[:width]
    pick = np.sort(pick[gain[pick] > GAIN])
    if not len(pick):
        return none
    d = len(pick)
    place_of = np.full(n_words, -1)
    place_of[pick] = np.arange(d)

    def matrix(row, place, n):
        x = np.zeros((n, d + 1), np.float32)
        x[:, d] = 1
        own = place_of[place]
        x[row[own >= 0], own[own >= 0]] = 1
        return x

    def moments(row, place, share):
        x = matrix(row, place, len(share))
        return x.T @ (x * share[:, None])

    su = _summed(rows, (d + 1, d + 1), moments)
    xp = matrix(row_p, place_p, len(weight)).astype(float)
    w = train((xp * weight[:, None]).T @ xp / n_pos, su / max(su[-1, -1], 1), prior)
    score = xp @ w
    some = score[xp[:, :-1].any(1)]
    middle = np.median(some) if len(some) else w[-1]
    return Model(words[pick], w[:-1], float(w[-1]), float(floor * middle + (1 - floor) * w[-1]))


def detect(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, toxic) for every document."""

    def run(batches):
        for rows, row, h in _ids(batches):
            f = model.score(presence(model.words, row, h, rows.num_rows)).astype(float)
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(f), pa.array((f > model.cut) & (len(model.words) > 0))], names=["doc_id", "score", "toxic"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)

"""Quality by hierarchical empirical Bayes: a document classifier's evidence under host and path priors.

A logistic classifier (numpy) on shape features and hashed letter pairs is fitted to at most `max_train` labelled rows, those
with the smallest hash of doc_id. Its log odds less those of its training set are a document's evidence. Evidence under the
global prior gives each document a soft label (a known label counts as it is), and grouped sums of these over all documents give beta
posteriors: a path's mean is shrunk toward its host's and a host's toward the global rate. Both concentrations come from
the data by the method of moments over all hosts and all paths. A document's own soft label is left out of its path's and
host's sums, so that it isn't counted twice. The posterior log odds are evidence plus log odds of the path's shrunken mean.

`source` names the host: what precedes its first "/". The path is the host with the rest of source up to the next "/", or with the
language where there is none. The sums are one row a path; Spark joins them back by hash, by broadcast only if they turn out small.

Defined results. A null source is a host of its own, and a null language a path of its own. A null or empty text has no evidence, so it gets its path's
mean. Without labels of both kinds evidence is 0 and the global rate 0.5. Conflicting labels of a doc_id are averaged; null ones are ignored.
Repeated rows give repeated results. A document is kept unless its posterior falls below `least`. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textcore as T
from .session import cut

BITS = 9
SHAPES = 12
SCHEMA = "doc_id long, host string, path string, evidence double, quality double, host_mean double, path_mean double, kept boolean"


def features(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """(rows, SHAPES + 2**BITS): shape features, and the square roots of the shares of hashed letter pairs."""
    n = len(offs) - 1
    out = np.zeros((n, SHAPES + (1 << BITS)), np.float32)
    if not len(data):
        return out
    size = np.diff(offs).astype(np.float64)
    row = np.repeat(np.arange(n, dtype=np.int32), np.diff(offs))
    full = np.maximum(size, 1)

    def share(mask):
        c = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
        return (c[offs[1:]] - c[offs[:-1]]) / full

    upper, lower, digit = (data >= 65) & (data <= 90), (data >= 97) & (data <= 122), (data >= 48) & (data <= 57)
    space, newline, stop = data == 32, data == 10, (data == 46) | (data == 44)
    other = (data < 128) & ~(upper | lower | digit | space | newline | stop)
    start, end = T.spans(data, offs)
    wrow = np.searchsorted(offs, start, "right") - 1
    nw = np.maximum(np.bincount(wrow, minlength=n), 1)
    length = (end - start).astype(np.float64)
    mean = np.bincount(wrow, length, n) / nw
    spread = np.sqrt(np.maximum(np.bincount(wrow, length**2, n) / nw - mean**2, 0))
    shapes = [share(upper), share(digit), share(newline), share(stop), share(other), share(data == 33), share(data == 124), share(data >= 128), mean / 10, spread / 10, np.log1p(nw) / 10, nw / np.maximum(full, 1)]
    out[:, :SHAPES] = np.stack(shapes, 1)
    low = T.fold(data)
    pair = ((low[:-1].astype(np.uint32) << np.uint32(8)) | low[1:]) * np.uint32(2654435761) >> np.uint32(32 - BITS)
    ok = row[:-1] == row[1:]
    count = np.bincount((row[:-1][ok].astype(np.int64) << BITS) | pair[ok], minlength=n << BITS).reshape(n, -1)
    out[:, SHAPES:] = np.sqrt(count / np.maximum(count.sum(1, keepdims=True), 1))
    return out


class Classifier:
    """Logistic regression on standardised features, by Newton steps; no evidence at all unless it saw both classes."""

    def __init__(self, x: np.ndarray, y: np.ndarray, ridge: float = 30.0, rounds: int = 12):
        self.fitted = len(y) > 1 and 0 < y.mean() < 1
        if not self.fitted:
            return
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-3
        z = np.c_[(x - self.mean) / self.scale, np.ones(len(x))].astype(np.float64)
        w = np.zeros(z.shape[1])
        r = np.full(len(w), ridge)
        r[-1] = 1e-6
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(r), z.T @ (y - p) - r * w)
            w += step
            if np.abs(step).max() < 1e-6:
                break
        self.w = w
        self.prior = np.log(y.mean() / (1 - y.mean()))

    def evidence(self, x: np.ndarray) -> np.ndarray:
        if not self.fitted:
            return np.zeros(len(x))
        z = (x - self.mean) / self.scale
        return np.clip(z @ self.w[:-1] + self.w[-1] - self.prior, -12, 12)


def _labels(labels: DataFrame, column: str) -> DataFrame:
    return labels.filter(F.col("doc_id").isNotNull() & F.col(column).isNotNull()).groupBy(F.col("doc_id").cast("long").alias("__id")).agg(F.avg(F.col(column).cast("double")).alias("y"))


def fit(docs: DataFrame, labels: DataFrame, max_train: int = 6000) -> Classifier:
    """The classifier of at most max_train labelled rows: half of each class at most, each by the smallest hashes of doc_id."""
    known = _labels(labels, "quality")
    order = [F.xxhash64("__id"), "__id"]
    chosen = known.filter("y >= 0.5").orderBy(*order).limit(max_train // 2).unionAll(known.filter("y < 0.5").orderBy(*order).limit(max_train - max_train // 2))

    def run(batches):
        for rows, data, offs in T.chunks(batches):
            x = features(data, offs)
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), T.lists(x.ravel(), np.full(len(x), x.shape[1]), pa.float32())], names=["id", "y", "x"])

    text = F.col("text").cast("string")
    found = docs.select(F.col("doc_id").cast("long").alias("id"), text.alias("text")).filter("text <> ''").join(F.broadcast(chosen), F.col("id") == F.col("__id")).select("id", "y", "text").mapInArrow(run, "id long, y double, x array<float>").toArrow()
    if not found.num_rows:
        return Classifier(np.zeros((0, 1)), np.zeros(0))
    x = found["x"].combine_chunks().flatten().to_numpy().reshape(found.num_rows, -1)
    order = np.lexsort((x.sum(1), found["id"].to_numpy()))
    return Classifier(x[order], (found["y"].to_numpy()[order] >= 0.5).astype(float))


def evidence(docs: DataFrame, model: Classifier) -> DataFrame:
    """(doc_id, host, path, evidence) for every document, in one narrow pass."""

    def run(batches):
        for rows, data, offs in T.chunks(batches):
            e = model.evidence(features(data, offs))
            e[np.diff(offs) == 0] = 0
            yield pa.RecordBatch.from_arrays([*(rows.column(i) for i in range(3)), pa.array(e, pa.float64())], names=["doc_id", "host", "path", "evidence"])

    source = F.coalesce(F.col("source").cast("string"), F.lit(""))
    host = F.substring_index(source, "/", 1)
    section = F.get(F.split(source, "/"), F.lit(1))
    path = F.concat_ws("/", host, F.coalesce(section, F.col("lang").cast("string")))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), host.alias("host"), path.alias("path"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, host string, path string, evidence double")


def _concentration(groups: DataFrame, mean: str) -> float:
    """Beta concentration by moments: how much less the groups' rates vary than single documents would under `mean`."""
    m, n, s = F.col(mean), F.col("n").cast("double"), F.col("s")
    r = groups.filter("n > 1").agg(
        F.sum(n * (s / n - m) ** 2).alias("between"), F.sum(m * (1 - m)).alias("binomial"), F.sum((n - 1) * m * (1 - m)).alias("room"), F.count("*").alias("k")
    ).first()
    if not r["k"] or not r["room"]:
        return 10.0
    rho = (r["between"] - r["binomial"]) / r["room"]  # the share of a document's variance that its group explains
    return float(1 / min(max(rho, 1e-4), 0.9) - 1)


def _odds(p):
    p = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(p / (1 - p))


def posterior(scored: DataFrame, labels: DataFrame, least: float = 0.5) -> DataFrame:
    """The result from (doc_id, host, path, evidence)."""
    known = _labels(labels, "quality")
    n, y = known.agg(F.count("*"), F.sum(F.when(F.col("y") >= 0.5, 1.0).otherwise(0.0))).first()
    rate = ((y or 0) + 1) / (n + 2)
    soft = 1 / (1 + F.exp(-(F.col("evidence") + float(np.log(rate / (1 - rate))))))
    rows = cut(scored.join(known, F.col("doc_id") == F.col("__id"), "left").select("doc_id", "host", "path", "evidence", F.coalesce("y", soft).alias("p")))
    paths = cut(rows.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("p").alias("s")))
    hosts = cut(paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s")))
    total = hosts.agg(F.sum("n"), F.sum("s")).first()
    base = (total[1] + 1) / (total[0] + 2) if total[0] else 0.5
    k_host = _concentration(hosts.withColumn("m", F.lit(base)), "m")
    within = paths.join(hosts.select("host", ((F.col("s") + k_host * base) / (F.col("n") + k_host)).alias("m")), "host")
    k_path = _concentration(within, "m")
    sums = paths.join(hosts.select("host", F.col("n").alias("hn"), F.col("s").alias("hs")), "host").select("host", "path", "n", "s", "hn", "hs")
    host_mean = (F.col("hs") - F.col("p") + k_host * base) / (F.col("hn") - 1 + k_host)
    path_mean = (F.col("s") - F.col("p") + k_path * F.col("host_mean")) / (F.col("n") - 1 + k_path)
    out = rows.join(sums, ["host", "path"]).withColumn("host_mean", host_mean).withColumn("path_mean", path_mean)
    quality = 1 / (1 + F.exp(-(F.col("evidence") + _odds(F.col("path_mean")))))
    return out.withColumn("quality", quality).select("doc_id", "host", "path", "evidence", "quality", "host_mean", "path_mean", (F.col("quality") >= least).alias("kept"))


def classify(docs: DataFrame, labels: DataFrame, max_train: int = 6000, least: float = 0.5) -> DataFrame:
    return posterior(evidence(docs, fit(docs, labels, max_train)), labels, least)
